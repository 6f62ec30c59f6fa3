"""Fuzzy equality of short texts as sets of words, pair by pair and as a join.

Two texts x and y, written as their distinct words in order, share the words s. Their score is the best of
similar(x, y) with the shared words in front, similar(s, x) and similar(s, y), where similar is 200 times the
longest common subsequence over both lengths; a text whose words are all shared scores 100.

A score of at least r = (least + 1/2) / 100 bounds lengths and shared parts, with p = r / (2 - r):

* similar(s, x) >= r only if words of at most (1 - p) |x| letters are not shared. So of x's words in any
  order, the first that together pass this length hold a shared one. A text inside another shares all its words.
* similar(x, y) >= r only if p <= |x| / |y| <= 1 / p. Written with a space around each word, both texts keep
  their pairs of letters whatever the order of words, |x| + 1 of them. At most (1 - r)(|x| + |y|) letters are
  outside the common subsequence, each ends at most one run of it, so at least (3r/2 - 1)(|x| + |y|) + 1 pairs
  are shared. So of x's pairs in any one order, the first |x| + 2 - t hold a shared one, t the bound for the least |y|.

Rare words and pairs come first in these orders, and candidates meet by an equi-join on them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

MATCH = 85


def words(text: Column) -> Column:
    """The distinct words of a text in lower case, in order: runs of letters and numerals."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))))


def common_subsequence(a: str, b: str) -> int:
    """Length of a longest common subsequence; one machine word holds 64 letters of ``a`` (Hyyrö)."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def similar(a: str, b: str) -> float:
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def word_set_score(x: list[str], y: list[str]) -> float:
    """The score of two lists of distinct words in order, rounded; 0 where one has none."""
    if not len(x) or not len(y):
        return 0.0
    in_x, in_y = set(x), set(y)
    shared = [w for w in x if w in in_y]
    if shared and (len(shared) == len(in_x) or len(shared) == len(in_y)):
        return 100.0
    head = " ".join(shared)
    with_x, with_y = (" ".join(shared + [w for w in t if w not in other]) for t, other in ((x, in_y), (y, in_x)))
    # the shared words begin both texts: what remains is compared, the head is common
    rest = 200.0 * (len(head) + common_subsequence(with_x[len(head) :], with_y[len(head) :])) / (len(with_x) + len(with_y))
    best = max(rest, *(200.0 * len(head) / (len(head) + len(t)) for t in (with_x, with_y)))
    return float(round(best))


@F.pandas_udf(DoubleType())
def _scores(x: pd.Series, y: pd.Series) -> pd.Series:
    known: dict[tuple, float | None] = {}

    def score(a, b):
        if a is None or b is None:
            return None
        key = tuple(a), tuple(b)
        if key not in known:
            known[key] = word_set_score(list(key[0]), list(key[1]))
        return known[key]

    return pd.Series([score(a, b) for a, b in zip(x, y)], dtype="float64")


def _bounds(least: float) -> tuple[float, float]:
    """r and p of the module's text."""
    r = (least + 0.5) / 100
    if r <= 2 / 3:
        raise ValueError("scores of 66 and less share no words or pairs of letters by need")
    return r, r / (2 - r)


def may_match(x: Column, y: Column, least: float = MATCH) -> Column:
    """Whether two word lists can score above ``least``: a shared word, or lengths near enough."""
    _, p = _bounds(least)
    a, b = (F.length(F.array_join(w, " ")) for w in (x, y))
    return (a > 0) & (b > 0) & (F.arrays_overlap(x, y) | (F.least(a, b) >= p * F.greatest(a, b) - 1e-9))


def score(a: Column, b: Column, least: float | None = None) -> Column:
    """The score of two texts, in Arrow batches; with ``least``, pairs that cannot score above it are 0 without being sent there."""
    x, y = words(a), words(b)
    if least is None:
        return _scores(x, y)
    near = may_match(x, y, least)
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.coalesce(_scores(F.when(near, x), F.when(near, y)), F.lit(0.0)))


def _rarest_first(rows: DataFrame, counts: DataFrame, item: list[str]) -> DataFrame:
    order = Window.partitionBy("side", "norm").orderBy("uses", *item)
    return rows.join(counts, item).withColumn("nth", F.row_number().over(order))


def candidates(texts: DataFrame, least: float = MATCH) -> DataFrame:
    """(x, y): pairs of normal forms of side 0 and side 1 that can score above ``least``, none twice.

    ``texts`` has side (0 or 1), norm (the words joined by a space) and words, distinct and with no empty norm.
    """
    r, p = _bounds(least)
    size = F.length("norm")
    token = texts.select("side", "norm", F.explode("words").alias("token"))
    used = token.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    order = Window.partitionBy("side", "norm").orderBy("uses", "token").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("token") + 1).over(order), F.lit(0))
    ranked = token.join(used, "token").withColumn("before", before)
    leads = F.col("before") <= (1 - p) * size + 1e-9
    of = lambda side, name, lead: (ranked.where(leads) if lead else ranked).where(F.col("side") == side).select("token", F.col("norm").alias(name))
    by_token = of(0, "x", True).join(of(1, "y", False), "token").unionByName(of(0, "x", False).join(of(1, "y", True), "token"))

    pair = F.flatten(F.transform("words", lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit(" "), w, F.lit(" ")).substr(i, F.lit(2)))))
    grams = texts.select("side", "norm", F.explode(pair).alias("gram")).groupBy("side", "norm", "gram").agg(F.count(F.lit(1)).alias("n"))
    grams = grams.select("side", "norm", "gram", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("copy"))
    counts = grams.groupBy("gram", "copy").agg(F.count(F.lit(1)).alias("uses"))
    shared = F.ceil((1 + p) * (1.5 * r - 1) * size + 1 - 1e-9)
    some = _rarest_first(grams, counts, ["gram", "copy"]).where(F.col("nth") <= size + 2 - shared)
    side = lambda n, name: some.where(F.col("side") == n).select("gram", "copy", F.col("norm").alias(name), size.alias(f"{name}_size"))
    near = (F.least("x_size", "y_size") >= p * F.greatest("x_size", "y_size") - 1e-9)
    by_gram = side(0, "x").join(side(1, "y"), ["gram", "copy"]).where(near)
    return by_token.select("x", "y").unionByName(by_gram.select("x", "y")).distinct()


def fuzzy_join(left: DataFrame, right: DataFrame, left_text: str, right_text: str, least: float = MATCH) -> DataFrame:
    """(left_text, right_text, score) of the distinct texts of two tables whose score is above ``least``.

    Complete, for any ``least`` from 67 on. Null texts and texts without words match nothing. Texts that are
    one set of words are compared once.
    """
    form = lambda df, c, side: df.select(F.col(c).alias("text")).where(F.col(c).isNotNull()).distinct().select(F.lit(side).alias("side"), "text", words(F.col("text")).alias("words")).withColumn("norm", F.array_join("words", " ")).where("norm <> ''")
    a, b = form(left, left_text, 0), form(right, right_text, 1)
    texts = a.unionByName(b).select("side", "norm", "words").distinct()
    pairs = candidates(texts, least)
    scored = pairs.withColumn("score", _scores(F.split("x", " "), F.split("y", " "))).where(F.col("score") > least)
    out = scored.join(a.select(F.col("norm").alias("x"), F.col("text").alias(left_text)), "x").join(b.select(F.col("norm").alias("y"), F.col("text").alias(right_text)), "y")
    return out.select(left_text, right_text, "score")

