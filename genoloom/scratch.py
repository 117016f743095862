"""Tables that cut a plan's lineage: written to the folder all executors share, then read again.

The cluster names that folder in ``spark.checkpoint.dir``. Only where it is unset and Spark runs on
this machine alone (tests, a notebook) a temporary folder is used; a cluster without one is refused.
The folders this process made are deleted when it ends; ``drop`` deletes one early.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, without a slash at its end."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="genoloom-")
            _MADE.append((spark, f"{_OWN[app]}/genoloom"))
        found = _OWN[app]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/genoloom/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def kept_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses and that stays when this process ends."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: What holds while a query of ours runs: shuffle files end with it, and Python workers get Arrow
#: batches that are small beside an executor's memory.
SCOPED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


_LOCK = threading.Lock()
#: By session: how many threads are inside ``scoped``, and the values from before the first of them.
_INSIDE: dict[int, tuple[int, dict[str, str | None]]] = {}


@contextlib.contextmanager
def scoped(spark: SparkSession):
    """Queries that run in here have SCOPED; the session's own values come back after the last of them."""
    with _LOCK:
        n, before = _INSIDE.get(id(spark), (0, {}))
        if not n:
            before = {key: spark.conf.get(key, None) for key in SCOPED}
            for key, value in SCOPED.items():
                spark.conf.set(key, value)
        _INSIDE[id(spark)] = n + 1, before
    try:
        yield
    finally:
        with _LOCK:
            n, before = _INSIDE.pop(id(spark))
            if n > 1:
                _INSIDE[id(spark)] = n - 1, before
            else:
                for key, value in before.items():
                    if value is None:
                        spark.conf.unset(key)
                    else:
                        spark.conf.set(key, value)


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again (its lineage ends there)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with scoped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._genoloom_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``stage`` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_genoloom_path", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        with contextlib.suppress(Exception):
            delete(spark, path)
