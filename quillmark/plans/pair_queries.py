"""Queries on profiles, scaling, pairs and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import scalars
from quillmark.operators import pairs, profiles
from quillmark.plans.base import PREP, SENTS, query, rounded
from quillmark.plans.sentence_queries import HEAD, LISTED, SQL
from quillmark.sources.readers import sentences, table

BUCKETS = 16
GROUPS = list(SQL)
SCALED = tuple(c for g in GROUPS for c in SQL[g])  # all scalars that the SQL has


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalars.of_documents(table(spark, sf_dir, "documents"), GROUPS).select("doc_id", "sent_idx", *SCALED)


HASHED = " ".join(
    ["h0 AS (SELECT doc_id, sent_idx, sentence, g, 2166136261 AS h FROM grams),"]
    + [f"h{k + 1} AS (SELECT doc_id, sent_idx, sentence, g, (xor(h, unicode(substr(sentence, CAST(g + {k} AS BIGINT), 1))) * 16777619) % 4294967296 AS h FROM h{k})," for k in range(3)]
    + ["m1 AS (SELECT doc_id, sent_idx, CAST((CAST(xor(h, h >> 16) AS HUGEINT) * 2246822507) % 4294967296 AS BIGINT) AS h FROM h3),"]
    + ["m2 AS (SELECT doc_id, sent_idx, CAST((CAST(xor(h, h >> 13) AS HUGEINT) * 3266489909) % 4294967296 AS BIGINT) AS h FROM m1),"]
    + [f"b AS (SELECT doc_id, sent_idx, CAST(xor(h, h >> 16) % {BUCKETS} AS INT) AS bucket FROM m2)"]
)
GRAMS = "grams AS (SELECT doc_id, sent_idx, sentence, g FROM sents, unnest(range(1, length(sentence) - 1)) AS u(g))"
TYPED = r"""grams AS (SELECT doc_id, sent_idx, sentence, g FROM sents, unnest(range(1, length(sentence) - 1)) AS u(g)
  WHERE regexp_matches(substr(sentence, g, 3), '[^\p{L}\p{Nd}]') OR g = 1 OR g + 2 = length(sentence)
    OR regexp_matches(substr(sentence, g - 1, 1), '[^\p{L}\p{Nd}]') OR regexp_matches(substr(sentence, g + 3, 1), '[^\p{L}\p{Nd}]'))"""
COUNTED = "ct AS (SELECT doc_id, sent_idx, bucket, count(*) AS c FROM b GROUP BY ALL), sh AS (SELECT doc_id, sent_idx, bucket, c / sum(c) OVER (PARTITION BY doc_id, sent_idx) AS p FROM ct)"
SHARES = "SELECT doc_id, sent_idx, bucket, p AS share FROM sh"


def _long(profiled: DataFrame) -> DataFrame:
    return profiled.select("doc_id", "sent_idx", F.posexplode("profile").alias("bucket", "share")).where("share > 0")


@query(f"WITH {SENTS}, {GRAMS}, {HASHED}, {COUNTED} {SHARES}")
def profile_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(profiles.char_profile(_sentences(spark, sf_dir), 3, BUCKETS))


@query(f"WITH {SENTS}, {TYPED}, {HASHED}, {COUNTED} {SHARES}")
def profile_char_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(profiles.char_profile(_sentences(spark, sf_dir), 3, BUCKETS, typed=True))


@query(f"""WITH {PREP}, parts AS (SELECT doc_id, sent_idx, n_w, unnest(flatten(list_transform(lw, lambda x:
  CASE WHEN x IN ({LISTED}) THEN [x] WHEN instr(x, '''') <= 1 THEN CAST([] AS VARCHAR[])
    WHEN ends_with(x, 'n''t') THEN list_filter([{HEAD}, 'n''t'], lambda y: y IN ({LISTED}))
    ELSE list_filter([left(x, instr(x, '''') - 1), substr(x, instr(x, ''''))], lambda y: y IN ({LISTED})) END))) AS word FROM prep)
SELECT doc_id, sent_idx, word, round(count(*) / n_w, 6) AS share FROM parts GROUP BY doc_id, sent_idx, n_w, word""")
def profile_fw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiles.function_words(scalars.prepared(_sentences(spark, sf_dir)), "doc_id", "sent_idx"))


ALL_SQL = {k: v for g in GROUPS for k, v in SQL[g].items()}
VECTORS = f"{PREP}, v AS (SELECT doc_id, sent_idx, {', '.join(f'CAST({ALL_SQL[c]} AS DOUBLE) AS {c}' for c in SCALED)} FROM prep)"
STATS = "st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) < 1e-12 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in SCALED) + " FROM v)"
Z = "z AS (SELECT doc_id, sent_idx, " + ", ".join(f"least(greatest(({c} - m_{c}) / s_{c}, -5), 5) AS {c}, {c} AS raw_{c}" for c in SCALED) + " FROM v, st)"
NEXT = "nx AS (SELECT doc_id, sent_idx, " + ", ".join(f"{p}{c} AS a_{p}{c}, lead({p}{c}) OVER o AS b_{p}{c}" for c in SCALED for p in ("", "raw_")) + ", lead(sent_idx) OVER o AS nx FROM z WINDOW o AS (PARTITION BY doc_id ORDER BY sent_idx))"


@query(f"WITH {VECTORS}, {STATS} " + " UNION ALL ".join(f"SELECT '{c}' AS scalar, round(m_{c}, 4) AS mean, round(s_{c}, 4) AS deviation FROM st" for c in SCALED))
def scaler_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = pairs.fit_scaler(_vectors(spark, sf_dir), list(SCALED))
    return rounded(spark.createDataFrame([(c, m, s) for c, (m, s) in fitted.items()], "scalar string, mean double, deviation double"), 4)


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    fitted = pairs.fit_scaler(v, list(SCALED))
    return v.select("doc_id", "sent_idx", *[pairs.zscore(c, fitted[c]).alias(c) for c in SCALED], *[F.col(c).alias(f"raw_{c}") for c in SCALED])


@query(f"WITH {VECTORS}, {STATS}, {Z} SELECT doc_id, sent_idx, {', '.join(f'round({c}, 4) AS {c}' for c in SCALED)} FROM z")
def zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scaled(spark, sf_dir).select("doc_id", "sent_idx", *SCALED), 4)


FORMS = {
    "ABSOLUTE": {"abs": "abs(a_{c} - b_{c})"}, "SIGNED": {"diff": "a_{c} - b_{c}"}, "MEAN": {"mean": "(a_{c} + b_{c}) / 2"},
    "ABSOLUTE_AND_MEAN": {"abs": "abs(a_{c} - b_{c})", "mean": "(a_{c} + b_{c}) / 2"}, "RELATIVE": {"rel": "abs(a_raw_{c} - b_raw_{c}) / (abs(a_raw_{c}) + abs(b_raw_{c}) + 1e-8)"},
    "CONCAT": {"first": "a_{c}", "second": "b_{c}", "abs": "abs(a_{c} - b_{c})"}, "ABSOLUTE_AND_PRODUCT": {"abs": "abs(a_{c} - b_{c})", "product": "a_{c} * b_{c}"},
}


def _register(representation: str) -> None:
    columns = ", ".join(f"round({x.format(c=c)}, 4) AS {k}_{c}" for c in SCALED for k, x in FORMS[representation].items())

    @query(f"WITH {VECTORS}, {STATS}, {Z}, {NEXT} SELECT doc_id, sent_idx, {columns} FROM nx WHERE nx IS NOT NULL", name=f"pairs_{representation.lower()}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        near = pairs.neighbours(_scaled(spark, sf_dir), [*SCALED, *(f"raw_{c}" for c in SCALED)])
        parts = {k: v for c in SCALED for k, v in pairs.represented(c, representation).items()}
        return rounded(near.select("doc_id", "sent_idx", *[v.alias(k) for k, v in parts.items()]), 4)


for _name in FORMS:
    _register(_name)


@query(f"WITH {VECTORS}, {STATS}, {Z}, {NEXT} SELECT doc_id, sent_idx, round(sqrt(({' + '.join(f'pow(a_{c} - b_{c}, 2)' for c in SCALED)}) / {len(SCALED)}), 6) AS distance FROM nx WHERE nx IS NOT NULL")
def pair_overall_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = pairs.neighbours(_scaled(spark, sf_dir), list(SCALED))
    return rounded(near.select("doc_id", "sent_idx", pairs.overall_distance(list(SCALED)).alias("distance")))


@query(f"""WITH {SENTS}, {GRAMS}, {HASHED}, {COUNTED},
pairs AS (SELECT doc_id, sent_idx FROM (SELECT doc_id, sent_idx, lead(sent_idx) OVER (PARTITION BY doc_id ORDER BY sent_idx) AS nx FROM sents) WHERE nx IS NOT NULL),
grid AS (SELECT pairs.doc_id, pairs.sent_idx, k, coalesce(x.p, 0) AS p, coalesce(y.p, 0) AS q FROM pairs, range({BUCKETS}) AS r(k)
  LEFT JOIN sh x ON x.doc_id = pairs.doc_id AND x.sent_idx = pairs.sent_idx AND x.bucket = k LEFT JOIN sh y ON y.doc_id = pairs.doc_id AND y.sent_idx = pairs.sent_idx + 1 AND y.bucket = k),
s AS (SELECT doc_id, sent_idx, sum(p) AS sp, sum(q) AS sq, sum(p * q) AS dot, sqrt(sum(p * p)) * sqrt(sum(q * q)) AS norms, sum(abs(p - q)) / 2 AS tv,
  sum(CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2)) ELSE 0 END) AS js,
  count(*) FILTER (p > 0 AND q > 0) AS both_, count(*) FILTER (p > 0 OR q > 0) AS either_ FROM grid GROUP BY ALL)
SELECT doc_id, sent_idx, CASE WHEN sp = 0 OR sq = 0 THEN 0 ELSE round(dot / norms, 9) END AS cosine, CASE WHEN sp = 0 OR sq = 0 THEN 1 ELSE round(sqrt(greatest(0, least(1, js))), 9) END AS js_distance,
  CASE WHEN sp = 0 OR sq = 0 THEN 1 ELSE round(least(1, tv), 9) END AS total_variation, CASE WHEN sp = 0 OR sq = 0 THEN 0 ELSE round(both_ / either_, 9) END AS jaccard FROM s""")
def pair_distance_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = pairs.neighbours(profiles.char_profile(_sentences(spark, sf_dir), 3, BUCKETS), ["profile"])
    measures = profiles.distances(F.col("a_profile"), F.col("b_profile"))
    return rounded(near.select("doc_id", "sent_idx", *[v.alias(k) for k, v in measures.items()]), 9)


@query(f"""WITH {VECTORS}, {STATS}, {Z}, {GRAMS}, {HASHED}, {COUNTED}
SELECT doc_id, sent_idx, {', '.join(f'round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 4) AS z{k}' for k, c in enumerate(SCALED))}, round(CAST(CAST(coalesce(sqrt(p), 0) * 4 AS FLOAT) AS DOUBLE), 4) AS b0
FROM z LEFT JOIN (SELECT * FROM sh WHERE bucket = 0) USING (doc_id, sent_idx)""")
def embedding_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = pairs.fit_scaler(_vectors(spark, sf_dir), list(SCALED))
    both = profiles.char_profile(scalars.measured(_sentences(spark, sf_dir), GROUPS, keep=("doc_id", "sent_idx", "sentence")), 3, BUCKETS)
    x = both.select("doc_id", "sent_idx", pairs.embedding_input(list(SCALED), fitted, "profile").alias("x"))
    return rounded(x.select("doc_id", "sent_idx", *[F.col("x")[k].cast("double").alias(f"z{k}") for k in range(len(SCALED))], F.col("x")[len(SCALED)].cast("double").alias("b0")), 4)


FILLED = ", ".join(f"coalesce(sum(p) FILTER (bucket = {k}), 0)" for k in range(BUCKETS))


@query(f"""WITH {SENTS}, {GRAMS}, {HASHED}, {COUNTED}, lists AS (SELECT doc_id, sent_idx, [{FILLED}] AS v FROM sents LEFT JOIN sh USING (doc_id, sent_idx) GROUP BY ALL),
near AS (SELECT doc_id, sent_idx, v, lead(v) OVER (PARTITION BY doc_id ORDER BY sent_idx) AS w FROM lists)
SELECT doc_id, sent_idx, CAST(unnest(range({BUCKETS})) AS INT) AS bucket, unnest(list_transform(range(1, {BUCKETS} + 1), lambda k: round(abs(v[k] - w[k]), 9))) AS difference FROM near WHERE w IS NOT NULL""")
def bucket_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = pairs.neighbours(profiles.char_profile(_sentences(spark, sf_dir), 3, BUCKETS), ["profile"])
    return rounded(near.select("doc_id", "sent_idx", F.posexplode(pairs.bucket_differences("profile")).alias("bucket", "difference")), 9)
