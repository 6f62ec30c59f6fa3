"""Stems, coded lengths and the stored index against plain versions."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import analysis, text_index

STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "hesitanci": "hesit", "digitizer": "digit",
    "conformabli": "conform", "radicalli": "radic", "differentli": "differ", "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper",
    "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl",
    "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv",
    "allowance": "allow", "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac",
    "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "homologou": "homolog", "communism": "commun", "activate": "activ", "angulariti": "angular", "homologous": "homolog",
    "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "by": "by", "generalizations": "gener", "oscillators": "oscil",
}


def test_stems():
    assert {w: analysis.stem(w) for w in STEMS} == STEMS


def test_analysis():
    assert analysis.analyse("The Dog's running, isn't it? 3 naïve o’clock dogs") == [(1, "dog"), (2, "run"), (3, "isn't"), (5, "3"), (6, "naïv"), (7, "o’clock"), (8, "dog")]
    assert analysis.analyse("The dogs", stems=False, stop=frozenset()) == [(0, "the"), (1, "dogs")]


def test_coded_lengths(spark):
    assert [analysis.coded_length_of(n) for n in (0, 23, 24, 39, 40, 41, 42, 56, 59, 60, 1000)] == [0, 23, 24, 39, 40, 40, 42, 56, 56, 60, 984]
    rows = spark.range(3000).select(analysis.coded_length(F.col("id")).alias("c")).collect()
    assert [r.c for r in rows] == [analysis.coded_length_of(n) for n in range(3000)]
    assert len({r.c for r in rows}) <= 100


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("walk", "jump", "paint", "relat", "the", "of", "zeb") for b in ("", "s", "ing", "ed", "er", "ation")]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = []
    for i in range(n):
        shift = (i * 7) // n * 5  # neighbours are alike
        docs.append((i, " ".join(vocabulary[(vocabulary.index(w) + shift) % len(vocabulary)] for w in rng.choices(vocabulary, weights, k=rng.randint(0, 80)))))
    return docs + [(n, None), (n + 1, ""), (n + 2, "walking " * 300)]


QUERIES = [(1, "walking painted zebs"), (2, "relations of the jumper"), (3, "jumped"), (4, "nothing known"), (5, ""), (6, "walk walk walks paints"), (7, None)]


def plain_top(docs, queries, k, k1=0.9, b=0.4):
    bags = {d: Counter(t for _, t in analysis.analyse(text or "")) for d, text in docs}
    n, mean = len(docs), sum(sum(c.values()) for c in bags.values()) / len(docs)
    df = Counter(t for c in bags.values() for t in c)
    out = []
    for q, text in queries:
        asked, scores = Counter(t for _, t in analysis.analyse(text or "")), Counter()
        for d, bag in bags.items():
            length = analysis.coded_length_of(sum(bag.values()))
            for t, times in asked.items():
                if bag[t]:
                    idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                    scores[d] += times * idf * bag[t] / (bag[t] + k1 * (1 - b + b * length / mean))
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        out += [(q, d, i + 1, pytest.approx(s)) for i, (d, s) in enumerate(best)]
    return sorted(out, key=lambda r: r[:3])


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    docs = spark.createDataFrame(corpus(), "doc int, text string").repartition(3)
    text_index.write_index(docs, path, "doc", "text", order=[F.col("doc")])
    return path


@pytest.mark.parametrize("k", [1, 5, 50, 1000])
def test_top_equals_an_exhaustive_run(spark, index, k):
    asked = text_index.query_terms(spark.createDataFrame(QUERIES, "q int, text string"), "q", "text")
    search = text_index.Search(spark, index, asked, k=k)
    got = sorted((r.query_id, r.doc, r["rank"], r.score) for r in search.top().collect())
    assert got == plain_top(corpus(), QUERIES, k)
    assert [x[:3] for x in got] == sorted((r.query_id, r.doc, r["rank"]) for r in search.exhaustive().collect())


def test_blocks_are_left_out(spark, index):
    asked = text_index.query_terms(spark.createDataFrame(QUERIES, "q int, text string"), "q", "text")
    share = {r.query_id: r.postings_read / r.postings for r in text_index.Search(spark, index, asked, k=3).read_share().collect()}
    assert set(share) == {1, 2, 3, 6} and min(share.values()) < 0.7 and all(0 < s <= 1 for s in share.values())


def test_index_holds_every_position(spark, index):
    rows = spark.read.parquet(index + "/postings").where("term is not null").select("term", F.explode("postings").alias("p")).select("term", "p.*").collect()
    got = {(r.doc, r.term): (r.tf, list(r.positions)) for r in rows}
    want = {}
    for d, text in corpus():
        for at, term in analysis.analyse(text or ""):
            want.setdefault((d, term), []).append(at)
    assert got == {k: (len(p), p) for k, p in want.items()}


def test_phrases(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red wool coats and red woolen coat"), (2, "coat red wool"), (3, "red wool coat red wool coat")], "doc int, text string")
    text_index.write_index(docs, str(tmp_path / "i"), "doc", "text")
    terms = [t for _, t in analysis.analyse("red wool coats")]
    assert sorted(map(tuple, text_index.phrase_matches(spark, str(tmp_path / "i"), terms).collect())) == [(1, 0), (3, 0), (3, 3)]


def test_postings_meet_queries_in_groups(spark, index, monkeypatch):
    monkeypatch.setattr(text_index.sg, "TILE", 2)
    monkeypatch.setattr(text_index.sg, "STRIP", 7)
    asked = text_index.query_terms(spark.createDataFrame(QUERIES, "q int, text string"), "q", "text")
    found = text_index.Search(spark, index, asked, k=5).top()
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.query_id, r.doc, r["rank"], r.score) for r in found.collect()) == plain_top(corpus(), QUERIES, 5)


def test_rows_of_one_id_add_up(spark, tmp_path):
    docs = spark.createDataFrame([(d % 40, "red coat" if d == 41 else "red wool" if d == 1 else "plain coat") for d in range(80)], "doc int, text string").repartition(2)
    text_index.write_index(docs, str(tmp_path / "i"), "doc", "text", order=[F.col("text")])
    asked = text_index.query_terms(spark.createDataFrame([(1, "red")], "q int, text string"), "q", "text")
    best = text_index.Search(spark, str(tmp_path / "i"), asked, k=1).top().collect()
    idf, part = math.log(1 + (80 - 2 + 0.5) / 2.5), 1 / (1 + 0.9 * (1 - 0.4 + 0.4 * 2 / 2))
    assert [(r.doc, r.score) for r in best] == [(1, pytest.approx(2 * idf * part))]


def test_documents_are_indexed_once(spark, tmp_path):
    """Writing an index reads the documents once: no second pass finds ranges of its rows."""
    reads = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(corpus(), "doc int, text string").repartition(3).mapInArrow(read, "doc int, text string")
    text_index.write_index(docs, str(tmp_path / "i"), "doc", "text")
    assert reads.value == len(corpus())


def test_rows_of_many_blocks_at_a_time(spark, tmp_path, monkeypatch):
    asked = text_index.query_terms(spark.createDataFrame(QUERIES, "q int, text string"), "q", "text")
    for words, vocabulary in ((1, 5), (1 << 18, 1 << 18)):
        monkeypatch.setattr(text_index, "WORDS", words)
        monkeypatch.setattr(text_index, "VOCABULARY", vocabulary)
        path = str(tmp_path / str(words))
        rows = text_index.index_rows(spark.createDataFrame(corpus(), "doc int, text string").coalesce(1), "doc", "text", stems=words > 1)
        got = {(r.block, r.term): [(p.doc, p.tf, p.len, list(p.positions)) for p in r.postings] for r in rows.where("term is not null").collect()}
        want = {}
        for n, (d, text) in enumerate(corpus()):
            found, places = analysis.analyse(text or "", words > 1), {}
            for at, term in found:
                places.setdefault(term, []).append(at)
            for term, p in places.items():
                want.setdefault((n // 32, term), []).append((d, len(p), analysis.coded_length_of(len(found)), p))
        assert got == want
        impacts = {(r.block, r.term): [tuple(i) for i in r.impacts] for r in rows.where("term is not null").collect()}
        assert impacts == {k: [(tf, n) for tf, n in sorted({(p[1], p[2]) for p in ps}, key=lambda x: (-x[0], x[1])) if not any(p[1] >= tf and p[2] <= n and (p[1], p[2]) != (tf, n) for p in ps)] for k, ps in want.items()}


def test_postings_stay_where_they_are_for_the_first_scores(spark, tmp_path):
    """What read_share moves grows with the asked terms' blocks, not with postings and their positions."""
    moved = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(["red", "wool", "coat", *map(str, range(3000))], [200, 200, 200, *[1] * 3000], k=2000))) for i in range(600)]
    text_index.write_index(spark.createDataFrame(docs, "doc int, text string"), str(tmp_path / "i"), "doc", "text")
    queries = [(i, f"red wool coat {i} {i + 1} {i + 2}") for i in range(40)]
    before, limit = moved(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        search = text_index.Search(spark, str(tmp_path / "i"), text_index.query_terms(spark.createDataFrame(queries, "q int, text string"), "q", "text"), k=3)
        assert search.read_share().count() == 40
        assert moved() - before < 1_000_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
