"""Fuzzy scores and joins against the letter-by-letter rule."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import fuzzy, goals


def plain_indel(a, b):
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def plain_score(a, b):
    x, y = ({w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()} for t in (a, b))
    if not x or not y:
        return 0.0
    shared, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if shared and (not only_x or not only_y):
        return 100.0
    with_x, with_y = f"{shared} {only_x}".strip(), f"{shared} {only_y}".strip()
    scores = [plain_indel(with_x, with_y)]
    if shared:
        scores += [plain_indel(shared, with_x), plain_indel(shared, with_y)]
    return float(round(max(scores)))


def near(rng, text):
    """A text with some letters changed and its words in another order."""
    letters = list(text)
    for _ in range(rng.randint(0, 3)):
        at = rng.randint(0, len(letters))
        letters[at : at + rng.randint(0, 1)] = [rng.choice("abé z-")] * rng.randint(0, 1)
    words = "".join(letters).split(" ")
    rng.shuffle(words)
    return " ".join(words)


def texts(rng, n):
    made = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 5))) for _ in range(n // 2)]
    made += [near(rng, rng.choice(made)) for _ in range(n // 3)]
    made += [" ".join(rng.sample(m.split(" "), rng.randint(1, len(m.split(" "))))) for m in rng.choices(made, k=n // 6)]
    return made + ["", " - ", "old", "cold", "a", "A b", "b, a!", "x" * 200, "x" * 190 + " y"]


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc é") for _ in range(rng.randint(0, 150))) for _ in range(2))
        assert abs(fuzzy.similar(a, b) - plain_indel(a, b)) < 1e-9


def test_scores(spark):
    rng = random.Random(3)
    made = texts(rng, 120)
    pairs = [(rng.choice(made), rng.choice(made)) for _ in range(400)] + [(m, near(rng, m)) for m in made] + [(None, "a"), ("a", None)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy.score(F.col("a"), F.col("b")).alias("all"), fuzzy.score(F.col("a"), F.col("b"), 85).alias("high"))
    for r in df.collect():
        want = None if r.a is None or r.b is None else plain_score(r.a, r.b)
        assert r["all"] == want and (r.high == want or (want is not None and want <= 85 and r.high == 0)), r


@pytest.mark.parametrize("least", [67, 85, 95])
def test_join_is_complete(spark, least):
    rng = random.Random(least)
    left, right = texts(rng, 150), texts(rng, 150)
    right += [near(rng, t) for t in left]
    got = fuzzy.fuzzy_join(spark.createDataFrame([(t,) for t in [*left, None]], "l string"), spark.createDataFrame([(t,) for t in [*right, None]], "r string"), "l", "r", least)
    want = {(a, b, s) for a in set(left) for b in set(right) if (s := plain_score(a, b)) > least}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


def test_bound_that_is_too_low():
    with pytest.raises(ValueError):
        fuzzy._bounds(60)


def test_reward_of_purchases(spark):
    rows = [
        (1, ["blue", "soft touch"], ["navy blue"], ["red", "large"], ["red", "x large"], "a soft touch mug", 5.0, 10.0, 1.0),
        (2, ["steel"], ["wood"], [], ["red"], None, 20.0, 10.0, 0.5),
        (3, ["old"], ["cold"], ["xl"], [], "t", 1.0, 0.0, 1.0),
    ]
    df = spark.createDataFrame(rows, "k int, ga array<string>, ba array<string>, go array<string>, bo array<string>, title string, price double, upper double, r double")
    got = goals.purchase_reward(df, ["k"], ("ga", "ba"), ("go", "bo"), ["title"], F.col("price"), F.col("upper"), F.col("r")).collect()

    def plain(ga, ba, go, bo, title, price, upper, r):
        hit = lambda g, offered: any(plain_score(o, g) > 85 for o in offered)
        n = sum(hit(g, ba) or g in (title or "").lower() for g in ga) + sum(hit(g, bo) for g in go) + (upper > 0 and price <= upper)
        return n / (len(ga) + len(go) + 1) * r

    assert {r.k: pytest.approx(r.reward) for r in got} == {k: plain(*rest) for k, *rest in rows}
