"""Fill-in-the-middle against a plain version with a regular expression."""

import hashlib
import random
import re

from helpers import documents, empty_documents

from tessera.llm import fim

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text, units = text or "", UNITS.findall(text or "")
    h = [int(g, 16) for g in re.findall("." * 8, hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest())[:4]]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), "<S>" + suffix + "<P>" + prefix + "<M>" + middle
    return n, "psm", len(prefix), len(middle), "<P>" + prefix + "<S>" + suffix + "<M>" + middle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_texts():
    rng = random.Random(11)
    alphabet = ["a", "Bc", "é", "\U0001f600", "漢", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x85", " ", " ", "<", "P>", "<S", ">", "\x00", "﻿"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return texts + ["<P>", "x <M> y", "<S>", "a<P", " ", "\n\n", "word", " word ", "<", ">P>", "z " * 50_000, "\U0001f600" * 10_000]


def test_whole_rows(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(1, "again one"), (1, "again one"), (None, "no id here"), (None, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, fim.report(docs).collect()), key=repr)
    want = sorted(((i, *(p := plain(i, t))[:4], sha(p[4]), sha(t or "")) for i, t in rows), key=repr)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_outputs_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(fim, "BATCH_BYTES", 20)
    rows = [(i, t) for i, t in enumerate(odd_texts()[:80])]
    out = fim.transform(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {(r.doc_id, r.output) for r in out.collect()} == {(i, plain(i, t)[4]) for i, t in rows}
    again = out.select("doc_id", fim.restore(out["output"], out["form"]).alias("text"))
    assert {tuple(r) for r in again.collect()} == set(rows)


def test_rates(spark):
    docs = spark.createDataFrame([(i, "some words in a row") for i in range(200)], "doc_id bigint, text string")
    assert {r.form for r in fim.transform(docs, fim_percent=0).collect()} == {"plain"}
    assert {r.form for r in fim.transform(docs, fim_percent=100, spm_percent=0).collect()} == {"psm"}
    assert fim.transform(docs, seed="7").select("output").collect() != fim.transform(docs).select("output").collect()


def test_other_columns_and_types(spark):
    docs = documents(spark).selectExpr("*", "doc_id as n", "text as form", "1 as output", "2 as written")
    assert len(fim.report(docs).collect()) == docs.count()
    named = docs.selectExpr("concat('k', doc_id) as key", "text as body")
    got = {(r.doc_id, r.output) for r in fim.transform(named, id_col="key", text_col="body").collect()}
    assert got == {(r.key, plain(r.key, r.body)[4]) for r in named.collect()}


def test_nothing(spark):
    assert fim.report(empty_documents(spark)).collect() == []
