import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, n_tokens long"
VOCABULARY = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu") for b in ("ra", "se", "ti", "") for c in ("na", "po", "")]


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def corpus(n=60, seed=3):
    """Rows with copies, near copies, shared lines, nulls, empty texts, a very long text and columns of clashing names."""
    rng = random.Random(seed)
    shared = "  This LINE stands in many of the documents of this small table  "
    texts = ["\n".join(sentence(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 6))) for _ in range(n)]
    for i in range(0, n, 5):
        texts[i] += "\n" + (shared if i % 2 else shared.lower().strip())
    texts[7] = texts[8]
    texts[9] = " ".join([*texts[8].split()[:-1], "changed"])
    texts[11], texts[12], texts[13], texts[14] = None, "", " \n\t\n", "one two"
    texts[15] = "one two"
    texts[16] = sentence(rng, 6000)
    texts[17] = "Ünïcödé <|endoftext|> don't " + "x" * 3000
    return [(i * 3 if i != 20 else None, t, ["en", "de", None][i % 3], f"src{min(i % 7, 3)}", 0, 1.0, False, -1) for i, t in enumerate(texts)]


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(3)
