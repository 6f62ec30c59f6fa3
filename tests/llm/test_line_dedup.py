"""Line dedup against a plain version over dictionaries."""

import hashlib
import random
from collections import defaultdict

from helpers import documents, empty_documents

from tessera.llm import line_dedup

UP = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain(rows, least_chars=40, least_docs=5):
    """[(doc_id, n_lines, n_dropped, kept text)]"""
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UP)
    rank = lambda d: (d is not None, d or 0)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(holders[key(x)]) < least_docs or rank(d) == max(map(rank, holders[key(x)]))]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def written_rows(seed=5):
    rng = random.Random(seed)
    pool = [f"shared line number {i} which is long enough to count" for i in range(6)] + ["é" * 40, "ÉÀ" * 25, "x" * 39, "x" * 40, "\x85" + "y" * 39, "short"]
    shape = lambda s: rng.choice(["", " ", "\t", "\x0b\x0c\r "]) + (s.upper() if rng.random() < 0.3 and s.isascii() else s) + rng.choice(["", "  ", "\r"])
    rows = []
    for i in range(40):
        lines = [shape(rng.choice(pool)) if rng.random() < 0.5 else f"own {i} {rng.random()}" + "z" * rng.randint(0, 50) for _ in range(rng.randint(0, 200 if i % 9 == 0 else 12))]
        rows.append((i - 3, "\n".join(lines)))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (None, pool[0]), (None, pool[1] + "\n" + pool[0]), (None, None), (30, pool[2]), (30, pool[2]), (7, pool[3] + "\n" + pool[3])]


def digests(rows):
    return sorted(((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in rows), key=repr)


def test_whole_rows(spark):
    rows = written_rows()
    got = line_dedup.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert digests(plain(rows)) == sorted(map(tuple, got), key=repr)
    assert sum(r.n_dropped for r in got) > 100


def test_texts_and_thresholds(spark):
    rows = written_rows(9)
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id int, text string, n_dropped string")
    for chars, least in ((1, 2), (40, 3), (10, 1)):
        got = line_dedup.deduplicate(docs, least_chars=chars, least_docs=least)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        kept = {(d, t or None) for d, _, _, t in plain(rows, chars, least)}
        assert {(r.doc_id, r.text or None) for r in got.collect()} == kept


def test_long_documents_and_a_hot_line(spark):
    hot = "this very line is in every single one of the documents here"
    rows = [(i, f"{hot}\nown {i}") for i in range(500)] + [(500, "\n".join(f"{hot}" if i % 3 == 0 else f"number {i}" for i in range(20_000))), (501, "w" * 300_000)]
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[500] == (20_000, 0) and got[501] == (1, 0) and all(got[i] == (2, 1) for i in range(500))


def test_other_columns(spark):
    docs = documents(spark).selectExpr("*", "1 as back", "2 as print", "3 as line_keep", "4 as plan_back__", "5 as keep", "6 as place")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, line_dedup.report(docs).collect()), key=repr) == digests(plain(rows))
    assert line_dedup.deduplicate(docs).columns == docs.columns


def test_nothing(spark):
    assert line_dedup.report(empty_documents(spark)).collect() == []


def test_stays_in_the_engine(spark):
    plan = line_dedup.report(documents(spark))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
