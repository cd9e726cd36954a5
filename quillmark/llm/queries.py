"""The queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import embedding_dedup, lines, mixing, near_dedup, packing, ppm, quality, sstable, topk, toxicity
from quillmark.llm.common import crc_residue, scratch
from quillmark.llm.labelled import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.coalesce(crc_residue("doc_id", 10) == 0, F.lit(False))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", out)
    return ppm.score(docs, ~F.col("held_out"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link_documents(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.drop_shared_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def mixed(docs: DataFrame, keep: float = 0.7) -> DataFrame:
    """``docs`` with tokens, topic, probability and kept: sources tempered to the power 0.5, languages to 0.7, topics to equal shares."""
    return mixing.mix(mixing.measured(docs), [mixing.Margin(c, power=p) for c, p in (("source", 0.5), ("lang", 0.7), ("topic", 0.0))], keep)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixed(docs).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "kept")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = scratch(spark, "shards")
    made = sstable.write_shards(_table(spark, sf_dir, "documents"), uri)
    return sstable.read_shards(spark, uri, made).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(_table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), keep_ids=False)
    digest = F.conv(F.hex("ids"), 16, 10).cast("long")
    return pieces.select("doc_id", "start", "length", digest.alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_lm_scoring, op3_near_dedup, op4_line_dedup, op5_mixing, op6_top_k, op7_token_shards, op8_embedding_dedup, op9_quality, op10_packing)}


LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, shared.last IS NOT NULL AND shared.last <> doc_id AS gone FROM keyed LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


NEAR_DEDUP_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), grams AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM words
), sized AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), near AS (
  SELECT a, b FROM common JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * common.n >= 75 * (x.n + y.n - common.n)
), links AS (
  SELECT a, b FROM near UNION ALL SELECT b, a FROM near
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
), least AS (
  SELECT a, min(b) AS component_id FROM reached GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN sized USING (doc_id) JOIN least ON a = doc_id
"""


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


VECTOR_LINKS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), usable AS (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
    AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND list_inner_product(x, x) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.98
), reached AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) c ON c.a = vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_near_dedup": NEAR_DEDUP_SQL, "op4_line_dedup": LINE_DEDUP_SQL, "op6_top_k": TOP_K_SQL, "op8_embedding_dedup": VECTOR_LINKS_SQL}
