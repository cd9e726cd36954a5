"""Column functions on text: trimming, sentence splitting, tokens, syllables. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_BREAKS = r"\r\n|\r|\n"
WEB_LINE_BREAKS = r"\r\n|[\n\x0B\f\r\u0085\u2028\u2029]"
BLANK = r"[ \t\n\x0B\f\r]+"
TRIPLED = "|".join(f"{chr(c)}{{3}}" for c in range(97, 123))
LINGUISTIC = r"\p{L}[\p{L}\p{N}]*(?:['’]\p{L}+)*(?:-\p{L}[\p{L}\p{N}]*)*|\p{N}+(?:[.,]\p{N}+)*|\.{2,}|…|\S"


def trimmed(x: Column) -> Column:
    """Without the characters up to U+0020 at both ends."""
    return F.regexp_replace(x, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def sentences_of(text: Column, breaks: str = LINE_BREAKS) -> Column:
    """One sentence a line: trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, breaks), trimmed), lambda x: x != "")


def cased(x: Column, casing: str, profile: bool = False) -> Column:
    """preserve keeps case, lower folds it, hybrid folds it for profiles only."""
    return F.lower(x) if casing == "lower" or casing == "hybrid" and profile else x


def plain_apostrophes(x: Column) -> Column:
    return F.replace(x, F.lit("’"), F.lit("'"))


def raw_tokens(x: Column) -> Column:
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, BLANK))


def words_of(tokens: Column) -> Column:
    """ASCII letters, digits and apostrophes of each token, case kept, empty ones dropped."""
    return F.filter(F.transform(tokens, lambda x: F.regexp_replace(x, "[^a-zA-Z0-9']", "")), lambda x: x != "")


def letters_only(x: Column) -> Column:
    """ASCII letters, lower-cased."""
    return F.lower(F.regexp_replace(x, "[^a-zA-Z]", ""))


def lookup_key(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, "[^a-zA-Z']", ""))


def linguistic_tokens(x: Column) -> Column:
    """Words with their clitics and hyphens, numbers, ellipses, and single marks."""
    return F.regexp_extract_all(x, F.lit(f"({LINGUISTIC})"), F.lit(1))


def count_of(x: Column, pattern: str) -> Column:
    """Matches that don't overlap."""
    return F.regexp_count(x, F.lit(pattern))


def chars_of(x: Column, kept: str) -> Column:
    """How many characters of a class, given without its brackets, a text has."""
    return F.length(F.regexp_replace(x, f"[^{kept}]", ""))


def these(x: Column, characters: str) -> Column:
    """How many of the listed characters a text has."""
    return F.length(x) - F.length(F.translate(x, characters, ""))


def dot_runs(x: Column, alone: bool) -> Column:
    """Maximal runs of full stops: of length one, or longer."""
    runs = F.regexp_extract_all(x, F.lit(r"(\.+)"), F.lit(1))
    return F.size(F.filter(runs, lambda r: (F.length(r) == 1) if alone else (F.length(r) > 1)))


def syllables(word: Column) -> Column:
    """Vowel groups (y counts but for the first letter), less silent -e and -ed endings; one at least, none for ''."""
    w = F.lower(F.replace(word, F.lit("'"), F.lit("")))
    groups = F.regexp_count(F.regexp_replace(w, "^y", "b"), F.lit("[aeiouy]+"))
    silent_e = (groups > 1) & w.rlike("[^aeiou]e$") & ~w.rlike("le$") & (F.length(w) > 2)
    left = groups - F.when(silent_e, 1).otherwise(0)
    silent_ed = (left > 1) & w.rlike("[^aeioutd]ed$") & (F.length(w) > 3)
    return F.when(w == "", 0).otherwise(F.greatest(left - F.when(silent_ed, 1).otherwise(0), F.lit(1)))
