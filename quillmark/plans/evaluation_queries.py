"""Queries on evaluation, segments, boundaries and retrieval, over conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions import scalars
from quillmark.operators import metrics, segments
from quillmark.plans.base import CONVERSATIONS, PREP, TOKENS, query, rounded
from quillmark.sources.readers import labelled_conversations, sentences, table

LEVELS = ("easy", "medium", "hard")
THRESHOLD = 0.2


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_conversations(table(spark, sf_dir, "conversations"))


def _level(doc_id):
    return F.element_at(F.array(*map(F.lit, LEVELS)), (F.pmod(doc_id, F.lit(3)) + 1).cast("int"))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring lines of conversations, with a simple score (the step of the length) and whether the speaker changes."""
    words = F.log1p(F.size(F.split("sentence", r"[ \t\n\x0B\f\r]+")))
    order = Window.partitionBy("doc_id").orderBy("sent_idx")
    s = _conversations(spark, sf_dir).withColumn("score", F.round(F.least(F.lit(1.0), F.abs(words - F.lag(words).over(order)) / 2), 6))
    return s.where("change IS NOT NULL").select("doc_id", "sent_idx", _level(F.col("doc_id")).alias("level"), "score", F.col("change").alias("label"))


SCORED = f"""{CONVERSATIONS}, cw AS (SELECT *, ln(1 + len({TOKENS.format(t='sentence')})) AS words FROM conv),
scored AS (SELECT * FROM (SELECT doc_id, sent_idx, ['easy', 'medium', 'hard'][doc_id % 3 + 1] AS level, round(least(1, abs(words - lag(words) OVER (PARTITION BY doc_id ORDER BY sent_idx)) / 2), 6) AS score, change AS label FROM cw) WHERE label IS NOT NULL)"""


def _measures(tp: str = "tp", fp: str = "fp", fn: str = "fn", tn: str = "tn") -> dict[str, str]:
    r = lambda a, b: f"CASE WHEN ({b}) = 0 THEN 0 ELSE ({a}) / ({b}) END"
    change, same = r(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}"), r(f"2 * {tn}", f"2 * {tn} + {fp} + {fn}")
    recall, specificity = r(tp, f"{tp} + {fn}"), r(tn, f"{tn} + {fp}")
    return {
        "accuracy": r(f"{tp} + {tn}", f"{tp} + {fp} + {fn} + {tn}"), "precision": r(tp, f"{tp} + {fp}"), "recall": recall, "specificity": specificity, "balanced_accuracy": f"({recall} + {specificity}) / 2",
        "f1_change": change, "f1_same": same, "macro_f1": f"({change} + {same}) / 2", "majority": r(f"greatest({tp} + {fn}, {tn} + {fp})", f"{tp} + {fp} + {fn} + {tn}"),
    }


def counted(test: str) -> str:
    return f"count(*) FILTER ({test} AND label = 1) AS tp, count(*) FILTER ({test} AND label <> 1) AS fp, count(*) FILTER (NOT {test} AND label = 1) AS fn, count(*) FILTER (NOT {test} AND label <> 1) AS tn"


MEASURES = ", ".join(f"round(CAST({x} AS DOUBLE), 6) AS {k}" for k, x in _measures().items())
SWEEP = f"cuts AS (SELECT level, CAST(step AS INT) AS step, {counted('score > step / 200.0::DOUBLE')} FROM scored, range(1, 200) AS r(step) GROUP BY ALL), sweep AS (SELECT *, {_measures()['macro_f1']} AS macro_f1 FROM cuts)"


@query(f"WITH {SCORED}, c AS (SELECT level, {counted(f'score > {THRESHOLD}')} FROM scored GROUP BY level) SELECT level, tp, fp, fn, tn, {MEASURES} FROM c")
def confusion_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.confusion(scored_pairs(spark, sf_dir), "level", threshold=THRESHOLD))


@query(f"WITH {SCORED}, c AS (SELECT coalesce(level, 'all') AS level, {counted(f'score > {THRESHOLD}')} FROM scored GROUP BY ROLLUP (level)) SELECT level, tp, fp, fn, tn, {MEASURES} FROM c")
def confusion_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_pairs(spark, sf_dir)
    said, true = F.col("score") > THRESHOLD, F.col("label") == 1
    counts = {"tp": said & true, "fp": said & ~true, "fn": ~said & true, "tn": ~said & ~true}
    r = s.rollup("level").agg(*[F.count_if(c).alias(k) for k, c in counts.items()]).withColumn("level", F.coalesce("level", F.lit("all")))
    return rounded(r.select("level", *metrics.COUNTS, *[c.alias(k) for k, c in metrics.derived(*map(F.col, metrics.COUNTS)).items()]))


@query(f"WITH {SCORED}, {SWEEP} SELECT level, step, tp, fp, fn, tn, round(CAST(macro_f1 AS DOUBLE), 6) AS macro_f1 FROM sweep")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.sweep(scored_pairs(spark, sf_dir), "level"))


BEST = """best AS (SELECT level, max(macro_f1) AS best FROM sweep GROUP BY level), f AS (SELECT level, best, min(step) AS first FROM sweep JOIN best USING (level) WHERE macro_f1 >= best - 1e-12 GROUP BY ALL),
l AS (SELECT level, min(step) - 1 AS last FROM sweep JOIN f USING (level) WHERE step > first AND macro_f1 < best - 1e-12 GROUP BY level),
chosen AS (SELECT level, (first + coalesce(last, 199)) / 400.0::DOUBLE AS threshold, CAST(best AS DOUBLE) AS best FROM f LEFT JOIN l USING (level))"""


@query(f"WITH {SCORED}, {SWEEP}, {BEST} SELECT level, round(threshold, 6) AS threshold, round(best, 6) AS best FROM chosen")
def best_threshold_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.best_threshold(scored_pairs(spark, sf_dir), "level"))


@query(f"WITH {SCORED}, {SWEEP}, {BEST}, c AS (SELECT level, {counted('score > threshold')} FROM scored JOIN chosen USING (level) GROUP BY level) SELECT level, tp, fp, fn, tn, {MEASURES} FROM c")
def routed_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each level's pairs under the threshold chosen for that level."""
    s = scored_pairs(spark, sf_dir)
    routed = s.join(F.broadcast(metrics.best_threshold(s, "level").select("level", "threshold")), "level")
    return rounded(metrics.confusion(routed, "level", threshold=F.col("threshold")))


@query(f"""WITH {SCORED}, r AS (SELECT *, rank() OVER (PARTITION BY level ORDER BY score) + (count(*) OVER (PARTITION BY level, score) - 1) / 2 AS r FROM scored),
s AS (SELECT level, sum(r) FILTER (label = 1) AS rs, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS q FROM r GROUP BY level)
SELECT level, round(CASE WHEN p = 0 OR q = 0 THEN 0.5 ELSE (rs - p * (p + 1) / 2) / (CAST(p AS DOUBLE) * q) END, 6) AS auc FROM s""")
def auc_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auc(scored_pairs(spark, sf_dir), "level"))


@query(f"""WITH {PREP}, l AS (SELECT doc_id, list_sort(list(CAST(len(tokens) AS INT))) AS v FROM prep GROUP BY doc_id)
SELECT doc_id, v[CAST(floor(CAST(0.1 AS DOUBLE) * (len(v) - 1) + 0.5) AS INT) + 1] AS p10, v[CAST(floor(CAST(0.5 AS DOUBLE) * (len(v) - 1) + 0.5) AS INT) + 1] AS p50, v[CAST(floor(CAST(0.9 AS DOUBLE) * (len(v) - 1) + 0.5) AS INT) + 1] AS p90 FROM l""")
def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scalars.prepared(sentences(table(spark, sf_dir, "documents"))).groupBy("doc_id").agg(F.collect_list("n_words").alias("v"))
    return s.select("doc_id", *[metrics.nearest_rank(F.col("v"), f).alias(k) for k, f in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))])


@query(f"""WITH {PREP} SELECT lang, round(avg(len(tokens)), 6) AS mean, round(coalesce(stddev_pop(len(tokens)), 0), 6) AS population, round(coalesce(stddev_samp(len(tokens)), 0), 6) AS sample,
CAST(min(len(tokens)) AS INT) AS least, CAST(max(len(tokens)) AS INT) AS most FROM prep GROUP BY lang""")
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scalars.prepared(sentences(table(spark, sf_dir, "documents"), "lang"))
    n = F.col("n_words")
    return rounded(s.groupBy("lang").agg(F.avg(n).alias("mean"), F.coalesce(F.stddev_pop(n), F.lit(0.0)).alias("population"), F.coalesce(F.stddev_samp(n), F.lit(0.0)).alias("sample"), F.min(n).alias("least"), F.max(n).alias("most")))


SEGMENTS = f"{CONVERSATIONS}, seg AS (SELECT *, CAST(sum(coalesce(change, 0)) OVER (PARTITION BY doc_id ORDER BY sent_idx) AS INT) AS segment FROM conv)"


@query(f"WITH {SEGMENTS} SELECT doc_id, segment, min(sent_idx) AS first, max(sent_idx) + 1 AS \"end\", count(*) AS sentences FROM seg GROUP BY ALL")
def segments_from_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segments(segments.segment_ids(_conversations(spark, sf_dir)))


@query(f"""WITH {SCORED}, e AS (SELECT doc_id, level, 1 + count(*) FILTER (score > {THRESHOLD}) AS estimated FROM scored GROUP BY ALL), a AS (SELECT doc_id, count(DISTINCT author) AS authors FROM conv GROUP BY doc_id)
SELECT level, count(*) AS documents, round(avg(CAST(estimated = authors AS DOUBLE)), 6) AS exact, round(avg(abs(estimated - authors)), 6) AS mae, round(avg(estimated - authors), 6) AS signed FROM e JOIN a USING (doc_id) WHERE authors >= 1 GROUP BY level""")
def author_count_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    estimated = scored_pairs(spark, sf_dir).groupBy("doc_id", "level").agg((1 + F.count_if(F.col("score") > THRESHOLD)).alias("estimated"))
    authors = _conversations(spark, sf_dir).groupBy("doc_id").agg(F.count_distinct("author").alias("authors"))
    return rounded(metrics.author_counts(estimated.join(authors, "doc_id"), "level"))


@query(f"""WITH {SEGMENTS}, s AS (SELECT DISTINCT doc_id, segment FROM seg), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), a AS (SELECT doc_id, count(DISTINCT author) AS authors FROM conv GROUP BY doc_id)
SELECT i.doc_id, i.segment AS i, j.segment AS j, CASE WHEN j.segment - i.segment = 1 THEN 'different' WHEN authors = n THEN 'different' WHEN authors = 2 THEN CASE WHEN (j.segment - i.segment) % 2 = 0 THEN 'same' ELSE 'different' END ELSE 'unknown' END AS relation
FROM s i JOIN s j ON i.doc_id = j.doc_id AND i.segment < j.segment JOIN n ON n.doc_id = i.doc_id JOIN a ON a.doc_id = i.doc_id""")
def segment_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _conversations(spark, sf_dir)
    authors = c.groupBy("doc_id").agg(F.count_distinct("author").alias("authors"))
    return segments.relations(segments.segments(segments.segment_ids(c)), authors)


STYLE = ("x1", "x2", "x3", "x4")
STYLE_SQL = f"""{PREP}, v AS (SELECT doc_id, sent_idx, ln(1 + len(tokens)) AS x1, length(regexp_replace(t, '[^,]', '', 'g')) / per_token AS x2, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) / per_token / 10 AS x3, length(regexp_replace(t, '[^.!?]', '', 'g')) / per_token AS x4 FROM prep)"""


def _style(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scalars.prepared(sentences(table(spark, sf_dir, "documents")))
    count = lambda kept: F.length(F.regexp_replace("t", f"[^{kept}]", "")) / scalars.per_token()
    return s.select("doc_id", "sent_idx", F.log1p("n_words").alias("x1"), count(",").alias("x2"), (count(r"\p{L}") / 10).alias("x3"), count(".!?").alias("x4"))


def _register(window: int) -> None:
    left, right = f"ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW", f"ROWS BETWEEN 1 FOLLOWING AND {window} FOLLOWING"
    order = "PARTITION BY doc_id ORDER BY sent_idx"
    frames = ", ".join(f"sum({c}) OVER ({order} {left}) AS l{k}, sum({c}) OVER ({order} {right}) AS r{k}" for k, c in enumerate(STYLE))
    dot = lambda a, b: " + ".join(f"{a}{k} * {b}{k}" for k in range(len(STYLE)))

    @query(
        f"WITH {STYLE_SQL}, f AS (SELECT doc_id, sent_idx, {frames}, lead(sent_idx) OVER ({order}) AS nx FROM v) SELECT doc_id, sent_idx, round((1 - ({dot('l', 'r')}) / (sqrt(({dot('l', 'l')}) * ({dot('r', 'r')})) + 1e-12)) / 2, 6) AS score FROM f WHERE nx IS NOT NULL",
        name=f"boundary_scores_w{window}",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(segments.boundary_scores(_style(spark, sf_dir), list(STYLE), window))


for _w in (1, 2, 3):
    _register(_w)

PLACED = "placed AS (SELECT vec_id // 20 AS doc_id, vec_id AS idx, label AS segment, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
SIMILAR = f"""{PLACED}, sim AS (SELECT a.doc_id, a.idx AS query, b.idx AS other, a.segment AS query_segment, b.segment AS other_segment,
  list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x)) + 1e-12) AS similarity FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND a.idx <> b.idx),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, query ORDER BY similarity DESC, other) AS rank, CAST(query_segment = other_segment AS INT) AS hit FROM sim)"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.similarities(table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("doc_id"), F.col("vec_id").alias("idx"), F.col("label").alias("segment"), F.col("embedding").alias("x")))


@query(f"WITH {SIMILAR} SELECT doc_id, query, other, round(similarity, 6) AS similarity FROM sim")
def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_placed(spark, sf_dir).select("doc_id", "query", "other", "similarity"))


@query(f"WITH {SIMILAR} SELECT doc_id, query, CAST(rank AS INT) AS rank, other, round(similarity, 6) AS similarity FROM rk WHERE rank <= 5")
def nearest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.ranked(_placed(spark, sf_dir)).where("rank <= 5").select("doc_id", "query", "rank", "other", "similarity"))


@query(f"""WITH {SIMILAR}, h AS (SELECT *, sum(hit) OVER (PARTITION BY doc_id, query ORDER BY rank) AS hits FROM rk),
q AS (SELECT doc_id, query, sum(hit) AS n, coalesce(sum(hit) FILTER (rank = 1), 0) AS p1, coalesce(sum(hit) FILTER (rank <= 5), 0) AS r5, min(rank) FILTER (hit = 1) AS first, sum(hits / rank) FILTER (hit = 1) AS ap FROM h GROUP BY ALL HAVING sum(hit) > 0)
SELECT count(*) AS queries, round(avg(p1), 6) AS p_at_1, round(avg(r5 / n), 6) AS recall_at_5, round(avg(1 / first), 6) AS mrr, round(avg(ap / n), 6) AS map FROM q""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.retrieval(_placed(spark, sf_dir)))


@query(f"""WITH {SIMILAR}, m AS (SELECT doc_id, query, query_segment, other_segment, avg(similarity) AS mean FROM sim GROUP BY ALL)
SELECT count(*) AS triplets, round(avg(CAST(o.mean > b.mean AS DOUBLE)), 6) AS triplet_accuracy FROM m b JOIN m o ON o.doc_id = b.doc_id AND o.query = b.query AND o.query_segment = o.other_segment WHERE abs(b.query_segment - b.other_segment) = 1""")
def triplet_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.triplet_accuracy(_placed(spark, sf_dir)))


RUNS = [(1, "tree", "full", 0.71, "2024-01-01"), (2, "tree", "full", 0.72, "2024-02-01"), (3, "logistic", "full", 0.715, "2024-01-15"), (4, "neural", "full", 0.727, "2024-01-20"), (5, "neural", "quick", 0.7, "2024-03-01"), (6, "logistic", "full", 0.71, "2024-01-10")]
RUNS_SQL = "runs AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in RUNS) + ") AS t(id, model, source, macro_f1, trained_at))"


@query(f"WITH {RUNS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY model, source ORDER BY trained_at DESC, id DESC) AS k FROM runs) SELECT id, model, source, round(CAST(macro_f1 AS DOUBLE), 6) AS macro_f1 FROM r WHERE k = 1")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.operators.reports import latest_runs

    runs = spark.createDataFrame(RUNS, "id int, model string, source string, macro_f1 double, trained_at string")
    return rounded(latest_runs(runs).select("id", "model", "source", "macro_f1"))


ABLATIONS = [("tree", "ALL", 0.72, 0.0), ("tree", "ALL - LENGTH", 0.70, 0.001), ("tree", "ALL - TFIDF", 0.7195, 0.001), ("neural", "ALL", 0.73, 0.01), ("neural", "ALL - LENGTH", 0.735, 0.01), ("neural", "ALL - TFIDF", 0.70, 0.01)]
ABLATIONS_SQL = "runs AS (SELECT model, experiment, CAST(macro_f1 AS DOUBLE) AS macro_f1, CAST(sd AS DOUBLE) AS sd FROM (VALUES " + ", ".join(str(r) for r in ABLATIONS) + ") AS t(model, experiment, macro_f1, sd))"


@query(f"""WITH {ABLATIONS_SQL} SELECT r.model, r.experiment, round(b.macro_f1 - r.macro_f1, 6) AS importance,
CASE WHEN b.macro_f1 - r.macro_f1 > greatest(0.005, 2 * r.sd) THEN 'helps' WHEN b.macro_f1 - r.macro_f1 < -greatest(0.005, 2 * r.sd) THEN 'hurts' ELSE 'neutral' END AS verdict
FROM runs r JOIN runs b ON b.model = r.model AND b.experiment = 'ALL' WHERE r.experiment LIKE 'ALL - %'""")
def importance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.operators.reports import importances

    runs = spark.createDataFrame(ABLATIONS, "model string, experiment string, macro_f1 double, sd double")
    return rounded(importances(runs))


@query(f"""WITH {SCORED}, f AS (SELECT level, count(*) AS pairs, count(DISTINCT doc_id) AS documents, count(*) FILTER (label = 1) AS switches, round(avg(label), 6) AS switch_rate,
min(doc_id * 100000 + sent_idx) FILTER (label = 1) AS first_change, min(doc_id * 100000 + sent_idx) FILTER (label = 0) AS first_same FROM scored GROUP BY level) SELECT * FROM f""")
def dataset_explore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each level: pairs, documents, switches, their rate, and where the first pair of each class is."""
    place = F.col("doc_id") * 100000 + F.col("sent_idx")
    first = lambda y: F.min(F.when(F.col("label") == y, place))
    return rounded(scored_pairs(spark, sf_dir).groupBy("level").agg(
        F.count("*").alias("pairs"), F.count_distinct("doc_id").alias("documents"), F.count_if(F.col("label") == 1).alias("switches"), F.avg("label").alias("switch_rate"), first(1).alias("first_change"), first(0).alias("first_same")
    ))


@query(f"""WITH {SCORED}, d AS (SELECT doc_id, level, avg(score) AS m FROM scored GROUP BY ALL), p AS (SELECT level, CASE WHEN m < 0.15 THEN 'easy' WHEN m < 0.25 THEN 'medium' ELSE 'hard' END AS said FROM d)
SELECT level, count(*) FILTER (said = 'easy') AS easy, count(*) FILTER (said = 'medium') AS medium, count(*) FILTER (said = 'hard') AS hard FROM p GROUP BY level""")
def level_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True levels against said ones, three by three."""
    d = scored_pairs(spark, sf_dir).groupBy("doc_id", "level").agg(F.avg("score").alias("m"))
    said = d.withColumn("said", F.when(F.col("m") < 0.15, "easy").when(F.col("m") < 0.25, "medium").otherwise("hard"))
    return said.groupBy("level").pivot("said", list(LEVELS)).agg(F.count("doc_id")).na.fill(0)
