"""Mixing against a plain water filling and a sorted selection."""

from collections import defaultdict

import pytest
from helpers import documents, empty_documents

from tessera.llm import mixing


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s else b""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        if not rest:
            return capped
        share = (total - sum(capped.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if weight[s] * share > 3 * sizes[s]]
        if not over:
            return capped | {s: weight[s] * share for s in rest}
        capped |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, None: 100}, {"a": 1000, "b": 1, "c": 1, "d": 5}, {"a": 0, "b": 0}, {"é": 3, "z": 3, "Z": 3, None: 3}, {"only": 7}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_taken_words_come_near(spark):
    rows = [(i, "w " * (1 + i * 7 % 30), "hot" if i % 3 else (f"s{i % 12}" if i % 5 else None)) for i in range(3000)]
    docs = spark.createDataFrame([*rows, (9000, None, "hot"), (9001, "", "none")], "doc_id bigint, text string, source string")
    got = mixing.mix_report(docs).collect()
    assert len(got) == docs.count() and sorted(map(str, got)) == sorted(map(str, mixing.mix_report(docs).collect()))
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        s = source[r.doc_id]
        taken[s], target[s], largest[s] = taken[s] + r.taken, r.target, max(largest[s], r.size)
    assert set(target) == {"hot", "s0", "s3", "s6", "s9", "none", None}
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6
    assert sum(target.values()) == pytest.approx(sum(r.size for r in got))


def test_mix_repeats_rows_and_keeps_columns(spark):
    docs = documents(spark)
    report = {r.doc_id: (r.taken // r.size if r.size else None) for r in mixing.mix_report(docs).collect() if r.doc_id is not None}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.dtypes == docs.dtypes
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    rows = {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    for doc, copies in report.items():
        if copies is not None:
            assert times.get(doc, 0) == copies * rows[doc]


def test_rows_without_or_with_one_id_come_near_too(spark):
    rows = [(None, "w " * 4, "a") for _ in range(10)] + [(7, f"x{i} " * 3, "b") for i in range(20)] + [(100 + i, "y " * 5, "c") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken, target = defaultdict(int), {}
    for r in mixing.mix_report(docs).collect():
        taken[r.source_size], target[r.source_size] = taken[r.source_size] + r.taken, r.target
    assert all(abs(taken[s] - t) <= 2.5 + 1e-6 for s, t in target.items())
    mixed = defaultdict(int)
    for r in mixing.mix(docs).collect():
        mixed[{"a": 40, "b": 60, "c": 150}[r.source]] += len(r.text.split())
    assert mixed == taken


def test_clashing_names(spark):
    names = "mix_whole mix_cut mix_source mix_copies mix_copy mix_hash mix_salt _mix_source hash tie place cut_hash".split()
    docs = spark.createDataFrame([(i, "w " * (i % 9), f"s{i % 4}", *range(len(names))) for i in range(50)], "doc_id bigint, text string, source string, " + ", ".join(f"{n} int" for n in names))
    plain = mixing.mix(docs.select("doc_id", "text", "source"))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.select("mix_whole", "mix_copies", "cut_hash").distinct().collect() == [(0, 3, 11)]
    assert sorted(mixed.select("doc_id").collect()) == sorted(plain.select("doc_id").collect())
    assert len(mixing.mix_report(docs).collect()) == 50


def test_many_sources_take_the_salted_join(spark, monkeypatch):
    docs = documents(spark)
    broadcast = sorted(map(str, mixing.mix_report(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mix_report(docs).collect())) == broadcast


def test_nothing(spark):
    assert mixing.mix_report(empty_documents(spark)).collect() == []
    assert mixing.mix(empty_documents(spark)).collect() == []


def test_stays_in_the_engine(spark):
    plan = mixing.mix_report(documents(spark))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
