"""Queries on the smaller operators: casing, positions, offsets, baselines, routing schemes, histories and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions import scalars
from quillmark.functions import text as X
from quillmark.operators import models, reports, routing, sampling, segments, service
from quillmark.plans.base import CONVERSATIONS, PREP, SENTS, query, rounded, rounded_sql
from quillmark.plans.evaluation_queries import RUNS, RUNS_SQL, SCORED, SEGMENTS, _conversations, counted, scored_pairs
from quillmark.plans.sentence_queries import SQL
from quillmark.sources.readers import sentences, table

LOWERED = PREP.replace("replace(sentence, '’', '''') AS t", "replace(lower(sentence), '’', '''') AS t")


def _register(group: str) -> None:
    @query(f"WITH {LOWERED} SELECT doc_id, sent_idx, {rounded_sql(SQL[group])} FROM prep", name=f"lowered_{group}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(scalars.of_documents(table(spark, sf_dir, "documents"), [group], casing="lower"))


for _group in ("orthography", "layout"):
    _register(_group)


@query(f"WITH {SENTS} SELECT doc_id, sent_idx, lower(regexp_replace(sentence, '[^a-zA-Z]', '', 'g')) AS letters FROM sents")
def letters_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents")).select("doc_id", "sent_idx", X.letters_only(F.col("sentence")).alias("letters"))


@query(f"""WITH {SENTS}, c AS (SELECT doc_id, sent_idx, count(*) OVER (PARTITION BY doc_id) AS n FROM sents)
SELECT doc_id, sent_idx, n, floor(CASE WHEN n > 1 THEN sent_idx / (n - 1) ELSE 0 END * 1000 + 0.5::DOUBLE) / 1000 AS place FROM c""")
def sentence_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = service.with_positions(sentences(table(spark, sf_dir, "documents")).select("doc_id", "sent_idx"))
    return s.select("doc_id", "sent_idx", "n", service.shown(F.col("position")).alias("place"))


@query(f"""WITH {SEGMENTS}, s AS (SELECT doc_id, segment, count(*) AS sentences FROM seg GROUP BY ALL)
SELECT doc_id, segment, sentences, count(*) OVER (PARTITION BY doc_id) AS segments, CAST(sum(sentences) OVER (PARTITION BY doc_id ORDER BY segment) - sentences AS BIGINT) AS start FROM s""")
def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = segments.segments(segments.segment_ids(_conversations(spark, sf_dir)))
    return segments.offsets(per).select("doc_id", "segment", "sentences", "segments", "start")


@query(f"""WITH {CONVERSATIONS}, h AS (SELECT DISTINCT doc_id, md5(concat('42:', CAST(doc_id AS VARCHAR))) AS h FROM conv), r AS (SELECT *, row_number() OVER (ORDER BY h, doc_id) AS r, count(*) OVER () AS n FROM h),
p AS (SELECT doc_id, sent_idx, lead(sentence) OVER o AS second, lead(change) OVER o AS label FROM conv WINDOW o AS (PARTITION BY doc_id ORDER BY sent_idx))
SELECT doc_id, sent_idx, label, CASE WHEN r <= (n + 1) // 2 THEN 1 ELSE 2 END AS half FROM p JOIN r USING (doc_id) WHERE second IS NOT NULL""")
def half_split_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pairs with the half that their document falls into."""
    c = _conversations(spark, sf_dir)
    order = Window.partitionBy("doc_id").orderBy("sent_idx")
    near = c.select("doc_id", "sent_idx", F.lead("sentence").over(order).alias("second"), F.lead("change").over(order).alias("label")).where("second IS NOT NULL")
    docs = sampling.halves(c.select("doc_id", F.lit(0).alias("all")).distinct(), "all").select("doc_id", "half")
    return near.join(docs, "doc_id").select("doc_id", "sent_idx", "label", "half")


@query(f"WITH {SCORED} SELECT level, count(*) AS pairs, CAST(sum(label) AS BIGINT) AS switches FROM scored WHERE level IN ('easy', 'hard') GROUP BY level")
def chosen_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.sources.readers import active

    s = scored_pairs(spark, sf_dir).where(F.col("level").isin(*active("easy, hard")))
    return s.groupBy("level").agg(F.count("*").alias("pairs"), F.sum("label").alias("switches"))


@query(f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (label = 1) AS ones, count(*) FILTER (label = 0) AS zeros FROM scored)
SELECT ones, zeros, round(zeros / (2 * zeros + ones), 6) AS always_0, round(ones / (2 * ones + zeros), 6) AS always_1 FROM c""")
def constant_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.baselines(scored_pairs(spark, sf_dir)))


@query(f"""WITH {SCORED}, v AS (SELECT unnest([{{'column': 'score', 'v': CAST(score AS DOUBLE)}}, {{'column': 'label', 'v': CAST(label AS DOUBLE)}}]) AS x FROM scored)
SELECT x."column" AS "column", round(min(x.v), 6) AS least, round(max(x.v), 6) AS most, round(avg(x.v), 6) AS mean, round(stddev_pop(x.v), 6) AS deviation FROM v GROUP BY ALL""")
def column_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.feature_summary(scored_pairs(spark, sf_dir), ["score", "label"]))


CUTS = {"easy": 0.1, "medium": 0.2}
POOLED = 0.3


@query(f"""WITH {SCORED}, d AS (SELECT DISTINCT doc_id, level, CASE WHEN doc_id % 4 = 0 THEN 'hard' WHEN doc_id % 4 = 1 THEN 'medium' ELSE 'easy' END AS detected FROM scored),
v AS (SELECT detected AS vote FROM d GROUP BY detected ORDER BY count(*) DESC, detected = 'easy' DESC, detected = 'medium' DESC LIMIT 1),
k AS (SELECT doc_id, unnest([{{'s': 'pooled', 'k': NULL}}, {{'s': 'true', 'k': level}}, {{'s': 'detected', 'k': detected}}, {{'s': 'vote', 'k': vote}}]) AS x FROM d, v),
c AS (SELECT doc_id, x.s AS scheme, CASE x.k WHEN 'easy' THEN 0.1::DOUBLE WHEN 'medium' THEN 0.2::DOUBLE ELSE 0.3::DOUBLE END AS cut FROM k),
t AS (SELECT scheme, coalesce(level, 'all') AS level, {counted('score > cut')} FROM scored JOIN c USING (doc_id) GROUP BY scheme, ROLLUP (level))
SELECT scheme, level, tp, fp, fn, tn, round((CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END + CASE WHEN 2 * tn + fp + fn = 0 THEN 0 ELSE 2 * tn / (2 * tn + fp + fn) END) / 2, 6) AS macro_f1 FROM t""")
def threshold_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled, true, detected and voted thresholds over the same scores. The detector's word is a rule on the id here."""
    from quillmark.operators.levels import schemes

    s = scored_pairs(spark, sf_dir)
    sure = lambda k: F.array(*[F.lit(float(j == k)) for j in range(3)])
    said = F.when(F.col("doc_id") % 4 == 0, sure(2)).when(F.col("doc_id") % 4 == 1, sure(1)).otherwise(sure(0))
    return rounded(schemes(s, s.select("doc_id", "level").distinct().withColumn("probabilities", said), CUTS, POOLED))


@query(f"WITH {RUNS_SQL} SELECT id, trained_at, round(CAST(macro_f1 AS DOUBLE), 6) AS macro_f1, CAST(row_number() OVER (ORDER BY trained_at DESC, id DESC) AS INT) AS place FROM runs WHERE model = 'neural'")
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.createDataFrame(RUNS, "id int, model string, source string, macro_f1 double, trained_at string")
    place = F.row_number().over(Window.orderBy(F.desc("trained_at"), F.desc("id"))).alias("place")  # a model's runs
    return rounded(reports.history(runs, "neural").select("id", "trained_at", "macro_f1", place))


STUDY = [
    ("tree", "ALL", 5, 1, 0.72, 0.9, 0.5), ("tree", "ALL - LENGTH", 5, 5, 0.70, 0.88, 0.5), ("tree", "ALL - TFIDF", 10, 1, 0.719, 0.9, 0.49),
    ("neural", "ALL", 10, 5, 0.73, 0.95, 0.51), ("neural", "ALL - LENGTH", 5, 1, 0.735, 0.9, 0.53), ("neural", "ALL - TFIDF", 10, 1, 0.7, 0.94, 0.5),
]
STUDY_SQL = "study AS (SELECT model, experiment, depth, leaf, CAST(macro_f1 AS DOUBLE) AS macro_f1, CAST(easy AS DOUBLE) AS easy, CAST(hard AS DOUBLE) AS hard FROM (VALUES " + ", ".join(map(str, STUDY)) + ") AS t(model, experiment, depth, leaf, macro_f1, easy, hard))"


def _study(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STUDY, "model string, experiment string, depth int, leaf int, macro_f1 double, easy double, hard double")


@query(f"""WITH {STUDY_SQL} SELECT r.experiment, count(*) AS models, round(avg(b.easy - r.easy), 6) AS easy, round(avg(b.hard - r.hard), 6) AS hard
FROM study r JOIN study b ON b.model = r.model AND b.experiment = 'ALL' WHERE r.experiment LIKE 'ALL - %' GROUP BY r.experiment""")
def importance_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.importance_by_level(_study(spark), "easy", "hard"))


@query(f"""WITH {STUDY_SQL} SELECT experiment, round(avg(macro_f1) FILTER (model = 'tree'), 6) AS tree, round(avg(macro_f1) FILTER (model = 'neural'), 6) AS neural, round(avg(macro_f1), 6) AS mean FROM study GROUP BY experiment""")
def across_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.across_models(_study(spark), ("tree", "neural")))


@query(f"""WITH {STUDY_SQL} SELECT depth, round(avg(macro_f1) FILTER (leaf = 1), 6) AS "1", round(avg(macro_f1) FILTER (leaf = 5), 6) AS "5" FROM study GROUP BY depth""")
def depth_by_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.grid(_study(spark), "depth", "leaf", (1, 5)))


@query(f"""WITH {SCORED}, b AS (SELECT doc_id, sent_idx, label, score, CAST(score > 0.2 AS INT) AS decision FROM scored)
SELECT doc_id, sent_idx, decision, CASE WHEN decision = 1 AND label = 1 THEN 'TP' WHEN decision = 1 THEN 'FP' WHEN label = 1 THEN 'FN' ELSE 'TN' END AS outcome FROM b""")
def pair_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_pairs(spark, sf_dir)
    decided = routing.decisions(s, s.select("doc_id").distinct().withColumn("threshold", F.lit(0.2)))
    return routing.outcomes(decided).select("doc_id", "sent_idx", "decision", "outcome")


@query(f"WITH {SCORED} SELECT doc_id, round(avg(score), 6) AS mean, count(*) FILTER (score > 0.2) AS switches FROM scored GROUP BY doc_id HAVING count(*) > 5")
def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored_pairs(spark, sf_dir).groupBy("doc_id").agg(F.avg("score").alias("mean"), F.count_if(F.col("score") > 0.2).alias("switches"), F.count("*").alias("n")).where("n > 5").drop("n"))
