"""Queries on sentences: splitting, counts, splits, and the scalars by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions import scalars
from quillmark.functions import text as X
from quillmark.functions.lexicon import FUNCTION_WORDS, MARKS, SENTENCE_STARTERS, frequent_words
from quillmark.plans.base import PREP, SENTS, query, rounded, rounded_sql, sentences_sql
from quillmark.sources.readers import sentences, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"WITH {SENTS} SELECT doc_id, sent_idx, sentence FROM sents")
def sentences_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(_documents(spark, sf_dir))


@query(f"WITH {sentences_sql(r'\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}]')} SELECT doc_id, sent_idx, sentence FROM sents")
def sentences_split_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(_documents(spark, sf_dir), breaks=X.WEB_LINE_BREAKS)


@query(f"""WITH {SENTS}, per AS (SELECT doc_id, lang, count(*) AS n FROM sents GROUP BY ALL)
SELECT lang, count(*) AS documents, CAST(sum(n) AS BIGINT) AS sentences, CAST(sum(n - 1) AS BIGINT) AS pairs, count(*) FILTER (n < 2) AS short_documents, max(n) AS longest FROM per GROUP BY lang""")
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _documents(spark, sf_dir).select("lang", F.size(X.sentences_of(F.col("text"))).cast("long").alias("n")).where("n > 0")
    return per.groupBy("lang").agg(
        F.count("*").alias("documents"), F.sum("n").alias("sentences"), F.sum(F.col("n") - 1).alias("pairs"), F.count_if(F.col("n") < 2).alias("short_documents"), F.max("n").alias("longest")
    )


@query("""WITH h AS (SELECT doc_id, lang, md5(concat('42:', CAST(doc_id AS VARCHAR))) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM h)
SELECT doc_id, lang, CASE WHEN r <= (n + 1) // 2 THEN 1 ELSE 2 END AS half FROM r""")
def half_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.operators.sampling import halves

    return halves(_documents(spark, sf_dir).select("doc_id", "lang"), "lang")


@query(f"""WITH {PREP} SELECT lang, doc_id, sent_idx, CAST(len(tokens) AS INT) AS n_words, {rounded_sql({
    'comma_rate': "length(regexp_replace(t, '[^,]', '', 'g')) / per_token", 'avg_word_length': r"length(regexp_replace(t, '[^\p{L}]', '', 'g')) / per_token",
    'uppercase_ratio': r"length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) / per_char", 'type_token_ratio': "CASE WHEN n_w = 0 THEN 0 ELSE len(list_distinct(lw)) / per_word END",
    'step': "abs(ln(1 + lead(len(tokens)) OVER (PARTITION BY doc_id ORDER BY sent_idx)) - ln(1 + len(tokens)))"})} FROM prep""")
def style_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a few measurements of each sentence, and the step of its length to the next one."""
    s = scalars.of_documents(_documents(spark, sf_dir), ["counts", "marks", "word_length", "orthography", "diversity"], keep=("lang", "doc_id"))
    step = F.abs(F.lead(F.log1p("n_words")).over(Window.partitionBy("doc_id").orderBy("sent_idx")) - F.log1p("n_words"))
    values = s.select("lang", "doc_id", "sent_idx", F.col("n_words").cast("int").alias("n_words"), "comma_rate", "avg_word_length", "uppercase_ratio", "type_token_ratio", step.alias("step"))
    return rounded(values)


def chars(kept: str) -> str:
    return f"length(regexp_replace(t, '[^{kept}]', '', 'g'))"


def matches(pattern: str) -> str:
    return f"len(regexp_extract_all(t, '{pattern}'))"


def part(test: str, of: str = "per_word", words: str = "w") -> str:
    return f"len(list_filter({words}, lambda x: {test})) / {of}"


def total(value: str, words: str = "w") -> str:
    return f"coalesce(list_sum(list_transform({words}, lambda x: {value})), 0)"


BARE = "length(replace(x, '''', ''))"
SYLLABLES = """(CASE WHEN v.w = '' THEN 0 ELSE greatest(v.g - CASE WHEN v.g > 1 AND regexp_matches(v.w, '[^aeiou]e$') AND NOT regexp_matches(v.w, 'le$') AND length(v.w) > 2 THEN 1 ELSE 0 END
 - CASE WHEN v.g > 1 AND regexp_matches(v.w, '[^aeioutd]ed$') AND length(v.w) > 3 THEN 1 ELSE 0 END, 1) END)"""
SYLLABLE_LIST = f"""list_transform(list_transform(w, lambda x: {{'w': lower(replace(x, '''', '')), 'g': len(regexp_extract_all(regexp_replace(lower(replace(x, '''', '')), '^y', 'b'), '[aeiouy]+'))}}), lambda v: {SYLLABLES})"""
MARK_CLASS = "".join(("\\" + m if m in "[]-" else "''" if m == "'" else m) for m in MARKS)
KINDS = " + ".join(f"CAST(contains(t, '{m.replace(chr(39), chr(39) * 2)}') AS INT)" for m in MARKS)
LISTED = ", ".join("'" + w.replace("'", "''") + "'" for w in FUNCTION_WORDS)
HEAD = "CASE left(x, length(x) - 3) WHEN 'ca' THEN 'can' WHEN 'wo' THEN 'will' WHEN 'sha' THEN 'shall' ELSE left(x, length(x) - 3) END"
IN_PARTS = f"""CASE WHEN x IN ({LISTED}) THEN 1 WHEN instr(x, '''') <= 1 THEN 0
 WHEN ends_with(x, 'n''t') THEN CAST({HEAD} IN ({LISTED}) AS INT) + CAST('n''t' IN ({LISTED}) AS INT)
 ELSE CAST(left(x, instr(x, '''') - 1) IN ({LISTED}) AS INT) + CAST(substr(x, instr(x, '''')) IN ({LISTED}) AS INT) END"""
COUNTS = "list_transform(list_distinct(lw), lambda x: len(list_filter(lw, lambda y: y = x)))"

SQL = {
    "length": {"log_word_count": "ln(1 + len(tokens))", "log_char_count": "ln(1 + length(t))"},
    "word_length": {"avg_word_length": chars(r"\p{L}") + " / per_token", "word_length_std": f"sqrt(greatest(0, {total(f'{BARE} * {BARE}')} / per_word - ({total(BARE)} / per_word) * ({total(BARE)} / per_word)))"}
    | {k: part(f"{BARE} BETWEEN {a} AND {b}") for k, (a, b) in scalars.LENGTHS.items()},
    "diversity": {
        "type_token_ratio": "CASE WHEN n_w = 0 THEN 0 ELSE len(list_distinct(lw)) / per_word END", "hapax_ratio": f"len(list_filter({COUNTS}, lambda c: c = 1)) / per_word",
        "simpson_d": f"CASE WHEN n_w < 2 THEN 0 ELSE 1 - coalesce(list_sum(list_transform({COUNTS}, lambda c: c * (c - 1))), 0) / (CAST(n_w AS DOUBLE) * (n_w - 1)) END",
        "yule_k": f"CASE WHEN n_w = 0 THEN 0 ELSE CAST(10000 AS DOUBLE) * (coalesce(list_sum(list_transform({COUNTS}, lambda c: c * c)), 0) - n_w) / (CAST(n_w AS DOUBLE) * n_w) END",
    },
    "readability": {
        "flesch_reading_ease": f"CASE WHEN n_w = 0 THEN 0 ELSE CAST(206.835 AS DOUBLE) - CAST(1.015 AS DOUBLE) * n_w - CAST(84.6 AS DOUBLE) * (list_sum({SYLLABLE_LIST}) / n_w) END",
        "gunning_fog": f"CASE WHEN n_w = 0 THEN 0 ELSE CAST(0.4 AS DOUBLE) * (n_w + CAST(100 AS DOUBLE) * (len(list_filter({SYLLABLE_LIST}, lambda c: c >= 3)) / n_w)) END",
        "flesch_kincaid_grade": f"CASE WHEN n_w = 0 THEN 0 ELSE CAST(0.39 AS DOUBLE) * n_w + CAST(11.8 AS DOUBLE) * (list_sum({SYLLABLE_LIST}) / n_w) - CAST(15.59 AS DOUBLE) END",
    },
    "punctuation": {"punctuation_density": chars(MARK_CLASS) + " / per_char", "punctuation_variety": f"({KINDS}) / {len(MARKS)}"},
    "marks": {k: f"({x}) / per_token" for k, x in {
        "comma_rate": chars(","), "period_rate": r"len(list_filter(regexp_extract_all(t, '\.+'), lambda x: length(x) = 1))", "semicolon_rate": chars(";"), "colon_rate": chars(":"),
        "exclamation_rate": chars("!"), "question_rate": chars("?"), "quote_rate": chars('"“”«»'), "apostrophe_rate": chars("''‘"), "bracket_rate": chars(r"()\[\]{}"), "dash_rate": chars(r"\-–—―"),
        "ellipsis_rate": r"len(list_filter(regexp_extract_all(t, '\.+'), lambda x: length(x) > 1)) + " + chars("…"), "repeated_punct_rate": matches(r"!{2,}|\?{2,}|,{2,}|;{2,}|:{2,}"),
    }.items()},
    "orthography": {
        "digit_ratio": chars(r"\p{Nd}") + " / per_char", "uppercase_ratio": chars(r"\p{Lu}") + " / per_char",
        "all_caps_word_ratio": part("length(regexp_replace(x, '[^A-Za-z]', '', 'g')) >= 2 AND NOT regexp_matches(x, '[a-z]')"),
        "capitalized_word_ratio": part("regexp_matches(x, '^[A-Z]')", "greatest(n_w - 1, 1)", "w[2:]"), "non_ascii_ratio": chars(r"\x{80}-\x{10FFFF}") + " / per_char",
        "elongation_ratio": part(f"regexp_matches(x, '{X.TRIPLED}')", words="lw"),
    },
    "layout": {
        "starts_with_capital": r"CAST(regexp_matches(regexp_extract(t, '[\p{L}\p{Nd}]'), '\p{Lu}') AS INT)", "ends_with_terminal": r"CAST(regexp_matches(t, '[.!?…][\"''”’)\]\s]*$') AS INT)",
        "starts_with_dialogue": "CAST(left(t, 1) IN ('\"', '“', '‘', '''', '-', '–', '—', '«') AS INT)",
        "spacing_anomaly_rate": f"(coalesce(list_sum(list_transform(regexp_extract_all(t, ' {{2,}}'), lambda x: length(x) - 1)), 0) + {matches(' [,.;:!?]')} + {matches(r'[,;!?]\p{L}')}) / per_char",
        "starts_with_conjunction": f"CASE WHEN n_w > 0 AND lw[1] IN {SENTENCE_STARTERS} THEN 1 ELSE 0 END",
    },
    "contractions": {"contraction_ratio": part("instr(x, '''') > 1 AND instr(x, '''') < length(x)")},
    "function": {"function_word_ratio": part(f"({IN_PARTS}) > 0", words="lw")},
}


def _register(group: str) -> None:
    @query(f"WITH {PREP} SELECT doc_id, sent_idx, {rounded_sql(SQL[group])} FROM prep", name=f"scalars_{group}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(scalars.of_documents(_documents(spark, sf_dir), [group]))


for _group in SQL:
    _register(_group)

FREQUENT = 100
RANKED = f"ranked AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS rank FROM (SELECT unnest(lw) AS word FROM prep) GROUP BY word QUALIFY rank <= {FREQUENT})"


@query(f"""WITH {PREP}, {RANKED},
a AS (SELECT doc_id, sent_idx, tokens, lw, per_token, per_word FROM prep),
hits AS (SELECT doc_id, sent_idx, count(rank) AS n FROM (SELECT doc_id, sent_idx, unnest(list_transform(tokens, lambda x: lower(regexp_replace(x, '[^a-zA-Z'']', '', 'g')))) AS word FROM a) LEFT JOIN ranked USING (word) GROUP BY ALL),
classes AS (SELECT doc_id, sent_idx, sum(log2(1 + coalesce(rank, {FREQUENT} + 1))) AS s FROM (SELECT doc_id, sent_idx, unnest(lw) AS word FROM a) LEFT JOIN ranked USING (word) GROUP BY ALL)
SELECT doc_id, sent_idx, round(coalesce(n, 0) / per_token, 6) AS frequent_word_ratio, round(coalesce(s, 0) / per_word, 6) AS avg_word_freq_class FROM a LEFT JOIN hits USING (doc_id, sent_idx) LEFT JOIN classes USING (doc_id, sent_idx)""")
def scalars_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return rounded(scalars.of_documents(docs, ["frequency"], frequent=frequent_words(scalars.word_counts(docs), FREQUENT)))


@query(f"""WITH {PREP}, n AS (SELECT count(*) AS n FROM prep),
counted AS (SELECT doc_id, sent_idx, word, count(*) AS c FROM (SELECT doc_id, sent_idx, unnest(w) AS word FROM prep) GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM counted GROUP BY word),
sums AS (SELECT doc_id, sent_idx, sum(CAST(c AS DOUBLE) * c * (ln((n.n + 1) / (df + 1)) + 1)) AS s FROM counted JOIN df USING (word), n GROUP BY ALL)
SELECT doc_id, sent_idx, round(coalesce(s, 0) / (CAST(per_word AS DOUBLE) * per_word), 6) AS mean_tfidf FROM prep LEFT JOIN sums USING (doc_id, sent_idx)""")
def scalars_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.operators.idf import document_frequency, mean_tfidf

    s = scalars.prepared(sentences(_documents(spark, sf_dir))).select("doc_id", "sent_idx", "w")
    return rounded(mean_tfidf(s, *document_frequency(s)))


EMOTIONS = [("the", 1, 0, 0), ("der", 0, 1, 0), ("idiot", 1, 0, 1), ("la", 0, 2, 1), ("with", 0, 0, 1)]


@query(f"""WITH {PREP}, lex AS (SELECT * FROM (VALUES {', '.join(map(str, EMOTIONS))}) AS t(word, anger, joy, trust)),
k AS (SELECT doc_id, sent_idx, unnest(list_transform(tokens, lambda x: lower(regexp_replace(x, '[^a-zA-Z'']', '', 'g')))) AS word FROM prep),
s AS (SELECT doc_id, sent_idx, [sum(anger), sum(joy), sum(trust)] AS v FROM k JOIN lex USING (word) GROUP BY ALL)
SELECT doc_id, sent_idx, round(CASE WHEN v IS NULL OR len(list_filter(v, lambda x: x > 0)) = 0 THEN 0 ELSE list_avg(list_filter(v, lambda x: x > 0)) / per_token END, 6) AS emotion_score FROM prep LEFT JOIN s USING (doc_id, sent_idx)""")
def scalars_emotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.operators.emotion import emotion_score

    lexicon = spark.createDataFrame(EMOTIONS, "word string, anger int, joy int, trust int")
    return rounded(emotion_score(scalars.prepared(sentences(_documents(spark, sf_dir))), lexicon, ("anger", "joy", "trust")))
