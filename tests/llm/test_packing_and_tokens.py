"""Token files and packing against the library's own encoding."""

import zlib

import numpy as np
import pytest
from helpers import documents, empty_documents
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing, token_files, tokens
from tessera.llm.scratch import Scratch


@pytest.fixture(scope="module")
def encode():
    encoder = tokens.Encoder(tokens.vocabulary())
    return lambda t: encoder.tokenizer.encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ENCODER = tokens.Encoder(tokens.vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abAB'.,!-_(<|>)sté́ñİΣß1² \t\n\u0085 日\x1c")), max_size=24))
def test_encoder_is_exact(text):
    want = np.array(ENCODER.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert ENCODER.encode([text]) == [want]


def test_encoder_special_tokens_and_bounds(encode):
    for t in ("<|endoftext|>x <|startoftext|>", "it's 's 'tis", "x" * 500 + " y"):
        assert ENCODER.encode([t]) == [np.array(encode(t), "<u4").tobytes()]
    small = tokens.Encoder(tokens.vocabulary())
    assert small.encode([]) == [] and small.encode([None, ""]) == [b"", b""]
    old, tokens.CACHE_WORDS = tokens.CACHE_WORDS, 3
    try:
        for t in ("a b c d e f g", "a b h i j", "a b c"):
            assert small.encode([t, t]) == [np.array(encode(t), "<u4").tobytes()] * 2
    finally:
        tokens.CACHE_WORDS = old


def test_round_trip(spark, encode):
    docs = documents(spark)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for doc, text in rows:
        ids = [*encode(text), 1]
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    got = sorted((tuple(r) for r in token_files.round_trip(docs).collect()), key=lambda r: r[1])
    assert got == want


def test_fetch_by_key(spark, encode, tmp_path):
    docs = documents(spark)
    root = f"file://{tmp_path}/set"
    manifest = token_files.write_tokens(docs, root)
    assert manifest.agg({"n_docs": "sum"}).first()[0] == docs.count()
    (tmp_path / "set" / "shard-000000-dead.ids").write_bytes(b"x")  # of a failed attempt: no reader looks at it
    asked = spark.createDataFrame([(3,), (23,), (20,), (999,), (3,), (None,)], "doc_id bigint")
    got = sorted((r.doc_id, r.ids) for r in token_files.fetch(spark, root, asked).collect())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got == sorted((k, [*encode(texts[k]), 1]) for k in (3, 20, 23, 23))


def test_token_files_of_nothing(spark):
    assert token_files.round_trip(empty_documents(spark)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300), st.sets(st.integers(-(2**63), 2**63 - 1), max_size=20))
def test_perfect_hash(keys, others):
    keys = np.array(sorted(keys), np.int64)
    table = token_files.PerfectHash.build(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    index = token_files.ShardIndex.load(token_files.ShardIndex.build(keys.tolist(), np.arange(len(keys)), 2).dump())
    first, count = index.lookup(keys)
    assert first.tolist() == list(range(len(keys))) and count.tolist() == [1] * len(keys)
    strange = np.array(sorted(others - set(keys.tolist())), np.int64)
    assert index.lookup(strange)[1].sum() <= 1  # a fingerprint errs once in 2**32


def test_packing(spark, encode):
    docs = documents(spark)
    got = packing.pack_documents(docs, keep_ids=True, pieces_per_task=9).collect()
    want = []
    for r in docs.collect():
        ids = [*encode(r.text), 0]
        want += [(r.doc_id, i, at, len(ids[at : at + 2048]), crc(ids[at : at + 2048])) for i, at in enumerate(range(0, len(ids), 2048))]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    sequences = packing.sequences(packing.pack_documents(docs, keep_ids=True))
    assert all(len(r.ids) == 4 * r.n_tokens for r in sequences.collect())


def test_packing_of_nothing(spark):
    assert packing.pack_documents(empty_documents(spark)).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 8))
def test_open_bins_are_best_fit_and_bounded(lengths, most):
    bins, free = packing.OpenBins(50, most), {}
    for n in lengths:
        fitting = [f for f in free.values() if f >= n]
        number, offset = bins.place(n)
        if fitting:
            assert free[number] == min(fitting)
        else:
            assert number not in free and offset == 0
        still = {b for some in bins.at.values() for b in some}
        for closed in set(free) - still - {number}:
            assert not fitting and len(free) == most and free[closed] == min(free.values())  # the fullest
            del free[closed]
        free[number] = 50 - offset - n
        if not free[number]:
            del free[number]
        assert bins.count == len(free) <= most


def test_packing_is_tight():
    import random

    rng = random.Random(0)
    lengths = sorted((min(2048, int(rng.lognormvariate(6.3, 0.9)) + 1) for _ in range(packing.PIECES_PER_TASK)), reverse=True)
    bins = packing.OpenBins(2048, packing.OPEN_BINS)
    for n in lengths:
        bins.place(n)
    assert bins.made <= 1.01 * sum(lengths) / 2048


def test_rows_that_share_an_id_fill_several_shards(spark, encode):
    docs = spark.createDataFrame([(None if i % 3 else 7, "one two three") for i in range(400)], "doc_id bigint, text string")
    scratch = Scratch(spark, "hot")
    manifest = token_files.write_tokens(docs, scratch.path("d"))
    assert manifest.count() >= 3
    got = sorted((r.start, r.n_tokens) for r in token_files.read_tokens(spark, scratch.path("d")).collect())
    assert got == [(4 * i, 4) for i in range(400)]
    found = token_files.fetch(spark, scratch.path("d"), spark.createDataFrame([(7,), (8,), (None,)], "doc_id bigint")).collect()
    assert [r.doc_id for r in found] == [7] * 134 and all(r.ids == [*encode("one two three"), 1] for r in found)


def test_sequences_stay_sound_when_slices_meet_in_a_task(spark):
    docs = spark.createDataFrame([(i, "a b c " * (i % 300)) for i in range(600)], "doc_id bigint, text string")
    cut = Scratch(spark, "meet").save(packing.pieces(docs).drop("ids"), "pieces")
    for rows in (packing.pack(cut, pieces_per_task=40), packing.pack(cut, pieces_per_task=40).coalesce(2)):
        found = {}
        for r in rows.collect():
            found.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert sum(map(len, found.values())) == cut.count() and len(found) >= 10
        for places in found.values():
            ends = 0
            for offset, length in sorted(places):
                assert offset == ends
                ends += length
            assert ends <= 2048
