"""Small written tables with the cases that every operator must take."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, bucket string, rep int, block int, hash string"


def documents(spark, extra=(), seed=3):
    """Nulls in every column, empty and long texts, repeated rows and ids, columns with clashing names."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(20, None, "en", "s0", None), (21, "", None, "s1", 0), (22, " \t\n ", "en", None, 4), (23, texts[0], "en", "s0", 5), (23, texts[0], "en", "s0", 5), (24, "solo", None, None, None)]
    rows += [(25, " ".join(rng.choice(words) for _ in range(6000)), "en", "s2", None), (26, "x" * 30_000, "en", "s0", None), (None, texts[1], "en", "s0", 3), (None, None, None, None, None), (27, texts[2].upper(), "en", "s1", 1)]
    rows += list(extra)
    return spark.createDataFrame([(*r, 7, "b", 1, 2, "h") for r in rows], DOCS)


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)
