"""All measurements together: fitted on training sentences, then the same vectors of sentences and pairs for every table."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.config import FeatureConfig
from quillmark.functions import scalars, tagger
from quillmark.functions import text as X
from quillmark.functions.lexicon import EMOTIONS
from quillmark.operators import pairs, profiles
from quillmark.operators.emotion import emotion_score
from quillmark.operators.idf import document_frequency, mean_tfidf

# The groups of measurements with their family, scalars, and the beginning of their blocks' names.
_MARKS = "comma period semicolon colon exclamation question quote apostrophe bracket dash ellipsis repeated_punct"
GROUPS: dict[str, tuple[str, tuple[str, ...], str | None]] = {
    "LENGTH": ("length", ("log_word_count", "log_char_count"), None),
    "FREQUENT_WORDS": ("lexical", ("frequent_word_ratio", "avg_word_freq_class"), None),
    "WORD_LENGTH": ("lexical", ("avg_word_length", "word_length_std", *scalars.LENGTHS), None),
    "TFIDF": ("lexical", ("mean_tfidf",), None),
    "EMOTION": ("lexical", ("emotion_score",), None),
    "LEXICAL_DIVERSITY": ("lexical", ("type_token_ratio", "hapax_ratio", "simpson_d", "yule_k"), None),
    "FUNCTION_WORDS": ("lexical", ("function_word_ratio",), "fw"),
    "PUNCTUATION": ("punctuation", ("punctuation_density", "punctuation_variety"), None),
    "PUNCTUATION_MARKS": ("punctuation", tuple(f"{m}_rate" for m in _MARKS.split()), None),
    "ORTHOGRAPHY": ("orthography", ("digit_ratio", "uppercase_ratio", "all_caps_word_ratio", "capitalized_word_ratio", "non_ascii_ratio", "elongation_ratio"), None),
    "LAYOUT": ("orthography", ("starts_with_capital", "ends_with_terminal", "starts_with_dialogue", "spacing_anomaly_rate", "starts_with_conjunction"), None),
    "CONTRACTIONS": ("orthography", ("contraction_ratio",), None),
    "FLESCH_READING_EASE": ("readability", ("flesch_reading_ease",), None),
    "GUNNING_FOG": ("readability", ("gunning_fog",), None),
    "FLESCH_KINCAID": ("readability", ("flesch_kincaid_grade",), None),
    "POS_RATIOS": ("syntax", (*(f"pos_{t}" for t in tagger.TAGS[:-1]), "pos_entropy"), None),
    "POS_NGRAM": ("syntax", (), "pos"),
    "CHAR_NGRAM": ("character", (), "char"),
}
SCALARS = tuple(c for _, cs, _ in GROUPS.values() for c in cs)
MEASURES = ("cosine", "js_distance", "total_variation", "jaccard")
OVERALL = "overall_distance"
KEYS = ("doc_id", "sent_idx")


def families() -> list[str]:
    """Families in the order in which they first come."""
    return list(dict.fromkeys(f for f, _, _ in GROUPS.values()))


def groups_of(family: str) -> list[str]:
    return [g for g, (f, _, _) in GROUPS.items() if f == family]


def blocks(config: FeatureConfig) -> dict[str, int]:
    """The profile blocks of a sentence with their widths."""
    from quillmark.functions.lexicon import FUNCTION_WORDS

    out = {f"char{n}": config.char_buckets for n in config.char_orders} | {f"pos{n}": config.pos_buckets for n in config.pos_orders}
    return out | ({"fw": len(FUNCTION_WORDS)} if config.function_word_profile else {})


def pair_names(config: FeatureConfig) -> list[str]:
    """The columns of a pair, in order: the scalars' parts, the measures of each block, the overall distance, and in full
    mode an array of bucket differences for each block."""
    scalar = [k for c in SCALARS for k in pairs.represented(c, config.representation)]
    return [*scalar, *(f"{b}_{m}" for b in blocks(config) for m in MEASURES), OVERALL, *(f"diff_{b}" for b in blocks(config) if config.full)]


def pair_columns(group: str, config: FeatureConfig) -> list[str]:
    """The columns of a pair that a group owns; the overall distance is nobody's."""
    _, own, prefix = GROUPS[group]
    held = [b for b in blocks(config) if prefix and b.rstrip("12345") == prefix]
    return [*(k for c in own for k in pairs.represented(c, config.representation)), *(f"{b}_{m}" for b in held for m in MEASURES), *(f"diff_{b}" for b in held if config.full)]


def describe(config: FeatureConfig) -> str:
    width = sum(blocks(config).values())
    parts = ", ".join(f"{b}[{n}]" for b, n in blocks(config).items())
    return f"{len(SCALARS)} scalars and {width} buckets ({parts}) a sentence; {len(pair_names(config))} columns a pair, {config.representation}"


@dataclass
class Extractor:
    """What is fitted on training sentences: word frequencies, the scalers; and the lists that are given."""

    config: FeatureConfig
    frequency: DataFrame
    total: int
    frequent: tuple[str, ...] = ()
    emotions: DataFrame | None = None
    by: tagger.Tagger = field(default_factory=lambda: tagger.HEURISTIC)
    scaler: dict[str, tuple[float, float]] = field(default_factory=dict)
    difference_scaler: dict[str, tuple[list[float], list[float]]] = field(default_factory=dict)

    def vectors(self, sentences: DataFrame, *keep: str) -> DataFrame:
        """``(doc_id, sent_idx, keep..., the 63 scalars, the blocks)`` of ``sentences(doc_id, sent_idx, sentence, keep...)``."""
        config = self.config
        p = scalars.prepared(sentences, config.casing)
        p = p.withColumn("__tags", tagger.tags(X.linguistic_tokens(F.col("t")), self.by)).withColumn("__fw", profiles.function_word_parts()).withColumn("__text", X.cased(F.col("sentence"), config.casing, profile=True))
        own = scalars.columns(p, [*scalars.GROUPS, "frequency"], list(self.frequent), (*KEYS, *keep, "__tags", "__fw", "__text"))
        out = own.select("*", *[c.cast("double").alias(k) for k, c in tagger.tag_shares(F.col("__tags")).items()])
        for n in config.char_orders:
            out = profiles.char_profile(out, n, config.char_buckets, config.char_typed, "__text", f"char{n}")
        for n in config.pos_orders:
            out = profiles.tag_profile(out, n, config.pos_buckets, "__tags", f"pos{n}")
        if config.function_word_profile:
            out = profiles.function_word_profile(out)
        plain = scalars.prepared(sentences.select(*KEYS, "sentence"), config.casing)
        out = out.join(mean_tfidf(plain, self.frequency, self.total), list(KEYS))
        if self.emotions is not None:
            out = out.join(emotion_score(plain, self.emotions, EMOTIONS), list(KEYS))
        else:
            out = out.withColumn("emotion_score", F.lit(0.0))
        return out.select(*KEYS, *keep, *SCALARS, *blocks(config))

    def standardized(self, vectors: DataFrame, *keep: str) -> DataFrame:
        """The scalars as z-scores, cut at the clip; blocks stay."""
        return vectors.select(*KEYS, *keep, *[pairs.zscore(c, self.scaler[c], self.config.z_clip).alias(c) for c in SCALARS], *blocks(self.config))

    def _near(self, vectors: DataFrame, label: str | None) -> DataFrame:
        raw = [F.col(c).alias(f"raw_{c}") for c in SCALARS] if self.config.representation == "RELATIVE" else []
        order = Window.partitionBy(KEYS[0]).orderBy(KEYS[1])
        marked = vectors.withColumn("label", F.lead(label).over(order)) if label else vectors
        z = marked.select(*KEYS, *(["label"] if label else []), *[pairs.zscore(c, self.scaler[c], self.config.z_clip).alias(c) for c in SCALARS], *raw, *blocks(self.config))
        return pairs.neighbours(z, [c for c in z.columns if c not in (*KEYS, "label")], ("label",) if label else ())

    def pairs(self, vectors: DataFrame, label: str | None = None) -> DataFrame:
        """``(doc_id, sent_idx, label, the columns of pair_names)`` of neighbouring sentences; ``label`` is the second one's column."""
        near, config = self._near(vectors, label), self.config
        columns = {k: v for c in SCALARS for k, v in pairs.represented(c, config.representation).items()}
        for b in blocks(config):
            columns |= {f"{b}_{m}": v for m, v in profiles.distances(F.col(f"a_{b}"), F.col(f"b_{b}")).items()}
        columns[OVERALL] = pairs.overall_distance(list(SCALARS))
        for b in blocks(config) if config.full else ():
            columns[f"diff_{b}"] = self._difference(b)
        return near.select(*KEYS, *(["label"] if label else []), *[v.alias(k) for k, v in columns.items()])

    def _difference(self, block: str):
        gaps = pairs.bucket_differences(block)
        if block not in self.difference_scaler:
            return gaps
        mean, std = (F.lit(x) for x in self.difference_scaler[block])
        z = F.transform(F.arrays_zip(gaps.alias("g"), mean.alias("m"), std.alias("s")), lambda x: (x.g - x.m) / x.s)
        clip = self.config.z_clip
        return F.transform(z, lambda v: F.least(F.greatest(v, F.lit(-clip)), F.lit(clip))) if clip else z

    def fit_differences(self, vectors: DataFrame) -> None:
        """Mean and population deviation of each bucket's difference over neighbouring sentences, for full pairs."""
        near = self._near(vectors, None)
        for b in blocks(self.config):
            each = near.select(F.posexplode(pairs.bucket_differences(b)).alias("k", "v"))
            rows = sorted(each.groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect())
            self.difference_scaler[b] = [r.m for r in rows], [r.s if r.s >= 1e-12 else 1.0 for r in rows]


def fit(sentences: DataFrame, config: FeatureConfig = FeatureConfig(), frequent: Iterable[str] = (), emotions: DataFrame | None = None, by: tagger.Tagger = tagger.HEURISTIC) -> tuple[Extractor, DataFrame]:
    """An extractor fitted on ``sentences``, each counted once, and their vectors."""
    words = scalars.prepared(sentences.select(*KEYS, "sentence"), config.casing).select("w")
    extractor = Extractor(config, *document_frequency(words), tuple(frequent), emotions, by)
    keep = [c for c in sentences.columns if c not in (*KEYS, "sentence")]
    vectors = extractor.vectors(sentences, *keep)
    extractor.scaler = pairs.fit_scaler(vectors, list(SCALARS))
    if config.full:
        extractor.fit_differences(vectors)
    return extractor, vectors


def training_matrix(sentences: DataFrame, label: str = "change", **settings) -> tuple[DataFrame, Extractor]:
    """Pairs of the training sentences, and the extractor that was fitted on the way."""
    extractor, vectors = fit(sentences, **settings)
    return extractor.pairs(vectors, label), extractor


def evaluation_matrix(sentences: DataFrame, extractor: Extractor, label: str | None = "change") -> DataFrame:
    """Pairs of other sentences by the same extractor."""
    return extractor.pairs(extractor.vectors(sentences, *([label] if label else [])), label)


def sentence_matrix(sentences: DataFrame, extractor: Extractor) -> DataFrame:
    """Standardised vectors of sentences."""
    return extractor.standardized(extractor.vectors(sentences))
