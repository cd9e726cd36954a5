"""The registry of queries with their SQL, and the SQL that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return register


TRIM = r"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def lines_sql(text: str, breaks: str = r"\r\n|\r|\n") -> str:
    return f"list_filter(list_transform(regexp_split_to_array({text}, '{breaks}'), lambda x: {TRIM.format(x='x')}), lambda x: x <> '')"


def sentences_sql(breaks: str = r"\r\n|\r|\n") -> str:
    return f"""split AS (SELECT doc_id, lang, source, {lines_sql('text', breaks)} AS parts FROM documents),
sents AS (SELECT doc_id, lang, source, CAST(k - 1 AS INT) AS sent_idx, parts[k] AS sentence FROM split, unnest(range(1, len(parts) + 1)) AS u(k))"""


WORDS = r"""list_filter(list_transform({tokens}, lambda x: regexp_replace(x, '[^a-zA-Z0-9'']', '', 'g')), lambda x: x <> '')"""
TOKENS = r"regexp_split_to_array({t}, '[ \t\n\x0B\f\r]+')"
SENTS = sentences_sql()
PREP = f"""{SENTS},
texts AS (SELECT doc_id, lang, sent_idx, sentence, replace(sentence, '’', '''') AS t FROM sents),
toks AS (SELECT *, {TOKENS.format(t='t')} AS tokens FROM texts),
prep AS (SELECT *, w_ AS w, list_transform(w_, lambda x: lower(x)) AS lw, greatest(len(tokens), 1) AS per_token, greatest(length(t), 1) AS per_char, greatest(len(w_), 1) AS per_word, len(w_) AS n_w
  FROM (SELECT *, {WORDS.format(tokens='tokens')} AS w_ FROM toks))"""

CONVERSATIONS = f"""turns AS (SELECT conv_id, turn, role, {lines_sql('text')} AS parts FROM conversations),
lined AS (SELECT conv_id AS doc_id, turn, role AS author, k, parts[k] AS sentence FROM turns, unnest(range(1, len(parts) + 1)) AS u(k)),
conv AS (SELECT doc_id, CAST(row_number() OVER o - 1 AS INT) AS sent_idx, sentence, author, CAST(author <> lag(author) OVER o AS INT) AS change
  FROM lined WINDOW o AS (PARTITION BY doc_id ORDER BY turn, k))"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six digits, as the SQL has them."""
    from pyspark.sql import functions as F

    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_sql(columns: dict[str, str]) -> str:
    return ", ".join(f"round(CAST({x} AS DOUBLE), 6) AS {k}" for k, x in columns.items())
