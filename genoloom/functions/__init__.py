"""Column expressions: information measures, half precision, name parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half(x: Column) -> Column:
    """``x`` rounded to IEEE half precision (ties to even, subnormals, overflow to infinity)."""
    size = F.abs(x)
    exponent = F.greatest(F.floor(F.log2(F.when(size > 0, size))), F.lit(-14))
    quantum = F.pow(F.lit(2.0), exponent - 10)
    rounded = F.rint(size / quantum) * quantum
    value = F.when(size == 0, 0.0).when(rounded >= 65520, float("inf")).otherwise(rounded)
    return F.when(x < 0, -value).otherwise(value)


def half_guard(x: Column, threshold: float) -> Column:
    """A plain comparison that half(x) >= half(threshold) implies, for the Parquet scan."""
    return x >= threshold - abs(threshold) * 2.0**-9 - 2.0**-23


def entropy(ctl: Column, cas: Column) -> Column:
    """Entropy in bits of a two-class bucket; 0 unless both counts are positive."""
    n = ctl + cas
    return F.when((ctl > 0) & (cas > 0), -(ctl / n) * F.log2(ctl / n) - (cas / n) * F.log2(cas / n)).otherwise(0.0)


def file_stem(path: Column) -> Column:
    """Name of a file without folders and last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def simulation_fields(name: Column) -> dict[str, Column]:
    """heritability, maf, model and replicate of a simulated file's name, null where absent."""
    take = lambda pattern: F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    return {
        "heritability": take(r"(?:^|[_/-])her[_-]?([0-9.]*[0-9])").cast("double"),
        "maf": take(r"(?:^|[_/-])maf[_-]?([0-9.]*[0-9])").cast("double"),
        "model": take(r"EDM-([0-9]+)").cast("int"),
        "replicate": take(r"EDM-[0-9]+_([0-9]+)").cast("int"),
    }
