"""The registered queries of the twelve operators; each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm import best_fit, chat_format, decontaminate, html_extract, jaccard_join, language_id, line_dedup, packing, quality_rules, reshard, warc, whitening
from genoloom.scratch import new_path, stage

#: Public vocabulary files; the first is the one that counts, the second the same as ranks.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SHARDS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    two = F.inline(F.array(*[F.struct(F.lit(-7).alias("conv_id"), F.lit(i).alias("turn"), F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for i, role in enumerate(("user", "assistant"))]))
    extra = spark.range(1).select(two).select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])
    out = chat_format.format_trees(chat_format.thread(rows.unionByName(extra)))
    out = out.select("tree", "formatted", "loss_spans", chat_format.turns_of(F.col("formatted")).alias("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumn("learned", chat_format.learned_text(F.col("formatted"), F.col("loss_spans")))
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>' || replace(replace(replace(role, '\', '\s'), '<', '\a'), chr(10), '\b') || chr(10)
    || replace(replace(text, '\', '\s'), '<', '\a') || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


def op2_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = new_path(spark, "shards")
    reshard.write_shards(docs, reshard.old_layout(docs, SHARDS), path)
    reshard.reshard_files(spark, path, docs.schema, SHARDS)
    rows = reshard.read_shards(spark, path, docs.schema)
    return rows.select("doc_id", reshard.row_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
both_ AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM both_ JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS least FROM documents
  UNION SELECT b, least FROM reach JOIN edges ON a = node WHERE least < b
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT node, min(least) AS component_id FROM reach GROUP BY node) r ON r.node = d.doc_id
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality(docs, columns=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


OP5_SQL = r"""
WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
windows AS (
  SELECT doc_id, i, list_slice(l, i + 1, i + 3) AS w FROM (SELECT doc_id, l, unnest(range(greatest(len(l) - 2, 1))) AS i FROM lines WHERE l <> [''])
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1
), gone AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM later),
each AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM lines),
kept AS (
  SELECT e.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, string_agg(e.line, chr(10) ORDER BY e.i) FILTER (g.i IS NULL) AS text
  FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, k.n_lines, k.n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary(VOCABULARY), vocabulary(RANKS), with_ids=True)
    return packing.digests(stage(packing.sequences(packed), "sequences"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS bytes FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS least FROM p)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
  CASE WHEN bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN bytes >= 100 AND page_id <> least THEN least END AS refers_to
FROM q
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.hits(decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, list_slice(w, i + 1, i + n) AS k
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, list_slice(w, i + 1, i + n) AS k
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM words, sizes WHERE len(w) >= n)
), found AS (SELECT p.doc_id, p.n, p.i, x.item_id FROM places p JOIN windows x ON x.n = p.n AND x.k = p.k),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(n)) AS j FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM words w LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.digests(best_fit.pack_online(table(spark, sf_dir, "documents"), vocabulary(VOCABULARY), vocabulary(RANKS)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_format, op2_resharding, op3_jaccard_join, op4_quality_rules, op5_line_dedup, op6_packing, op7_warc, op8_language_id, op9_html_extract, op10_decontaminate, op11_embedding_whitening, op12_best_fit_packing)
}
#: Operators 2, 4, 6, 8, 9, 11 and 12 can't be stated in SQL; tests hold them against brute force.
ORACLES = {"op1_chat_format": OP1_SQL, "op3_jaccard_join": OP3_SQL, "op5_line_dedup": OP5_SQL, "op7_warc": OP7_SQL, "op10_decontaminate": OP10_SQL}
