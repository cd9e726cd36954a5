"""Readers of documents, truth, metrics and thresholds, each with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions import text as X

TRUTH = "struct<authors:int,changes:array<int>>"
METRICS = (
    "id long, modelName string, versionName string, isFull boolean, nProblems int, f1 double, precision double, recall double, balancedAccuracy double, macroF1 double, "
    "decisionThreshold double, evaluatedOnTest boolean, nTestPairs int, difficultyBreakdownCsv string, testF1Mean double, testF1Std double, trainF1Mean double, trainF1Std double, "
    "trainedAt timestamp_ntz, trainedBy string, chosenConfig string, featureConfig string, gridResultsCsv string"
)


SPREAD = 32 << 20  # bytes for each core under which a table is dealt out anew


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt over all cores, since a file has no more splits than row groups; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SPREAD else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def sentences(docs: DataFrame, *keep: str, breaks: str = X.LINE_BREAKS) -> DataFrame:
    """``(doc_id, keep..., sent_idx, sentence)``: the lines of each text in order. A null text has none."""
    return docs.select("doc_id", *keep, F.posexplode(X.sentences_of(F.col("text"), breaks)).alias("sent_idx", "sentence"))


def _problem_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    path = F.input_file_name()
    part = lambda k: F.regexp_extract(path, r"([^/]+)/([^/]+)/(?:truth-)?problem-([^/]*)\.(?:txt|json)$", k)
    return files.select(part(1).alias("level"), part(2).alias("split"), part(3).alias("doc_id"), "value")


LEVELS = ("easy", "medium", "hard")
PARTS = ("all", "first", "second")


def active(levels: str) -> tuple[str, ...]:
    """The levels that ``all`` or a list of names means."""
    named = LEVELS if levels == "all" else tuple(x.strip() for x in levels.split(","))
    if not set(named) <= set(LEVELS):
        raise ValueError(f"levels must be all or of {LEVELS}")
    return named


def problem_ids(spark: SparkSession, root: str, split: str, level: str) -> list[str]:
    """Ids of the documents of a folder, in the order of strings."""
    return [r.doc_id for r in _problem_files(spark, f"{root}/{level}/{split}", "problem-*.txt").select("doc_id").orderBy("doc_id").collect()]


def problems(spark: SparkSession, root: str, split: str | None = None, levels: str = "all", part: str = "all", casing: str = "preserve") -> tuple[DataFrame, DataFrame]:
    """Documents of ``<root>/<level>/<split>/problem-N.txt`` with their truth, and those rejected with the reason.

    A document needs a truth file with as many changes as it has sentences, less one. Unknown author counts are 0. Only
    folders of the asked split and levels are read. ``part`` takes the first or the second half of each level's documents.
    """
    if part not in PARTS:
        raise ValueError(f"part must be one of {PARTS}")
    from quillmark.operators.sampling import halves

    folders = "{" + ",".join(active(levels)) + "}/" + (split or "*")
    texts = _problem_files(spark, f"{root}/{folders}", "problem-*.txt").withColumnRenamed("value", "text").withColumn("sentences", X.sentences_of(X.cased(F.col("text"), casing)))
    if part != "all":
        texts = halves(texts, "level").where(F.col("half") == PARTS.index(part)).drop("half")
    root = f"{root}/{folders}"
    truth = _problem_files(spark, root, "truth-problem-*.json").select("level", "split", "doc_id", F.from_json("value", TRUTH).alias("truth"))
    both = texts.join(truth, ["level", "split", "doc_id"], "left").withColumn(
        "reason",
        F.when(F.col("truth").isNull(), "no truth").when(F.col("truth.changes").isNull(), "no changes").when(F.size("sentences") - 1 != F.size("truth.changes"), "lengths differ"),
    )
    good = both.where("reason IS NULL").select("level", "split", "doc_id", "text", "sentences", "truth.changes", F.coalesce("truth.authors", F.lit(0)).alias("authors"))
    return good, both.where("reason IS NOT NULL").select("level", "split", "doc_id", "reason")


def unlabelled(spark: SparkSession, root: str, split: str, levels: str = "all") -> DataFrame:
    """``(level, split, doc_id, sent_idx, sentence)`` of all documents of a split, with or without a truth."""
    texts = _problem_files(spark, root + "/{" + ",".join(active(levels)) + "}/" + split, "problem-*.txt").withColumnRenamed("value", "text")
    return sentences(texts, "level", "split")


def problem_sentences(good: DataFrame) -> DataFrame:
    """``(doc_id, sent_idx, sentence, change, level, authors)`` of documents from ``problems``: change is that before the sentence."""
    each = good.select("doc_id", "level", "authors", "changes", F.posexplode("sentences").alias("sent_idx", "sentence"))
    return each.select("doc_id", "sent_idx", "sentence", F.when(F.col("sent_idx") > 0, F.get("changes", F.col("sent_idx") - 1)).alias("change"), "level", "authors")


def labelled_pairs(good: DataFrame) -> DataFrame:
    """``(level, doc_id, sent_idx, first, second, label)``: the neighbouring sentences of documents from ``problems``."""
    order = Window.partitionBy("level", "doc_id").orderBy("sent_idx")
    s = problem_sentences(good)
    ahead = s.select("level", "doc_id", "sent_idx", F.col("sentence").alias("first"), F.lead("sentence").over(order).alias("second"), F.lead("change").over(order).alias("label"))
    return ahead.where("second IS NOT NULL")


def synthetic_problems(books: DataFrame, number: int, least: int = 3, most: int = 8, seed: int = 42) -> DataFrame:
    """``(doc_id, sent_idx, sentence, change, authors)``: documents that take turns between two authors' consecutive sentences.

    ``books(author, sent_idx, sentence)``. A document and its authors, turns and places are hashes of its number.
    """
    spark = books.sparkSession
    draw = lambda salt, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "doc_id"), n)
    authors = books.groupBy("author").agg(F.max("sent_idx").alias("last"))
    named = authors.withColumn("k", F.row_number().over(Window.orderBy("author")) - 1)  # one row an author
    count = named.count()
    docs = spark.range(number).withColumnRenamed("id", "doc_id").withColumn("a", draw("a", F.lit(count))).withColumn("b", F.pmod(F.col("a") + 1 + draw("b", F.lit(max(1, count - 1))), F.lit(count)))
    turns = docs.withColumn("turn", F.explode(F.sequence(F.lit(0), draw("t", F.lit(3)) + 1)))
    turns = turns.withColumn("k", F.when(F.col("turn") % 2 == 0, F.col("a")).otherwise(F.col("b"))).join(F.broadcast(named), "k")
    turns = turns.withColumn("n", least + F.pmod(F.xxhash64("doc_id", "turn"), F.lit(most - least + 1)))
    turns = turns.withColumn("at", F.pmod(F.xxhash64("turn", "doc_id"), F.greatest(F.col("last") + 2 - F.col("n"), F.lit(1))))
    lines = turns.withColumn("sent", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)))
    found = lines.join(books.withColumnRenamed("sent_idx", "sent"), ["author", "sent"])
    order = Window.partitionBy("doc_id").orderBy("turn", "sent")
    numbered = found.withColumn("sent_idx", F.row_number().over(order) - 1).withColumn("change", (F.col("author") != F.lag("author").over(order)).cast("int"))
    return numbered.select("doc_id", "sent_idx", "sentence", "change", F.lit(2).alias("authors"))


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics log, a JSON object a line; a missing macroF1 is 0."""
    return spark.read.schema(METRICS).json(path).na.fill({"macroF1": 0.0})


def ablation(spark: SparkSession, path: str) -> DataFrame:
    """An ablation table with its header, quoted as in RFC 4180."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)


def levels(spark: SparkSession, path: str) -> dict[str, float]:
    """Thresholds by level from ``key=value`` lines; ``#`` starts a comment."""
    rows = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' AND NOT startswith(v, '#') AND contains(v, '=')")
    pairs = rows.select(F.trim(F.split("v", "=", 2)[0]).alias("k"), F.trim(F.split("v", "=", 2)[1]).cast("double").alias("x"))
    return {r.k: r.x for r in pairs.collect()}


def labelled_conversations(conversations: DataFrame) -> DataFrame:
    """Conversations as documents: ``(doc_id, sent_idx, sentence, author, change)``; change: the author isn't that of the sentence before."""
    lines = conversations.select(F.col("conv_id").alias("doc_id"), "turn", F.col("role").alias("author"), F.posexplode(X.sentences_of(F.col("text"))).alias("line", "sentence"))
    order = Window.partitionBy("doc_id").orderBy("turn", "line")
    numbered = lines.withColumn("sent_idx", F.row_number().over(order) - 1)
    return numbered.select("doc_id", "sent_idx", "sentence", "author", (F.col("author") != F.lag("author").over(order)).cast("int").alias("change"))
