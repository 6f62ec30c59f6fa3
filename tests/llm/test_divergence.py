"""The divergence audit against a plain version over dense dictionaries."""

import random
import re
from collections import Counter, defaultdict

from helpers import documents, empty_documents

from tessera.llm import divergence

UP = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain(rows, least=30, best=50):
    """rows: (text, lang, source)"""
    rows = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(UP)), lang or "", s or "") for t, lang, s in rows]
    groups, holders, counts = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for terms, lang, s in rows:
        groups[lang].add(s)
        holders[lang].update(set(terms))
        counts[lang, s].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in holders[lang].items() if n >= least]

        def prob(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {s: prob(counts[lang, s]) for s in sources}
        q = prob(sum((counts[lang, s] for s in sources), Counter()))
        utf8 = lambda x: (-x[1], x[0].encode())
        for s in sources:
            pairs = sorted(((h, sum(abs(p[s][t] - p[h][t]) for t in kept)) for h in sources if h != s), key=utf8)
            terms = sorted(((t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]), key=utf8)[:best]
            out += [(lang, s, part, item, value, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (item, value) in enumerate(found)]
    return sorted(out)


def written_rows(seed=2, n=300):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "é", "É", "straße", "漢字", "naïve", "don", "t", "x9y", "\U0001f600", "z" * 30] + [f"w{chr(97 + i)}" for i in range(20)]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(n):
        s = rng.choice(["a", "b", "é", "Z", None, ""]) if i % 3 else "hot"
        shift = len(s or "") + ord((s or "q")[0])
        text = rng.choice([" ", ", ", "_", "1"]).join(words[(words.index(w) + shift) % len(words)] if rng.random() < 0.3 else w for w in rng.choices(words, weights, k=rng.randint(0, 40)))
        rows.append((text, rng.choice(["en", "en", "fr", None]), s))
    return rows + [(None, "en", "empty"), ("", "xx", "lonely"), ("12 34", "yy", "one"), (None, "yy", "two"), ("a b c", "yy", "two")]


SCHEMA = "text string, lang string, source string"


def test_whole_rows(spark):
    rows = written_rows()
    got = sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == plain(rows)
    assert {r[2] for r in got} == {"pair", "term"} and ("yy", "one", "pair", "two", 0, 1) in got


def test_many_shards_and_small_holds(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD_BYTES", 500)
    monkeypatch.setattr(divergence, "HELD_ENTRIES", 5)
    rows = written_rows(4, 120)
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA), least_docs=3, best=4)
    assert sorted(map(tuple, got.collect())) == plain(rows, 3, 4)


def test_counts_beyond_32_bits_stay_exact(spark):
    con = divergence._database(
        kept=spark.createDataFrame([("a", "t", 9_000_000_000_000, 9_000_000_000_003), ("b", "t", 3, 9_000_000_000_003)], "source string, term string, occurrences bigint, overall bigint").toArrow(),
        groups=spark.createDataFrame([("a", 9_000_000_000_000, 1, 9_000_000_000_003), ("b", 3, 1, 9_000_000_000_003)], "source string, n bigint, v bigint, all_n bigint").toArrow(),
    )
    found = con.execute(divergence._SHARE_SQL, {"scale": 10**9, "smoothing": 5, "best": 5, "lang": "x", "first": True}).fetchall()
    assert sum(r[4] for r in found if r[2] == "pair") == 0


def test_long_text_and_other_columns(spark):
    docs = documents(spark, extra=[(99, "Word " * 200_000, "en", "s0", 1)]).selectExpr("*", "1 as occurrences", "2 as term", "3 as value")
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert sorted(map(tuple, divergence.audit(docs, least_docs=2).collect())) == plain(rows, 2)


def test_nothing(spark):
    assert divergence.audit(empty_documents(spark)).collect() == []
