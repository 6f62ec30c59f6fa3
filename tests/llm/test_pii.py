"""Personal data against the plain patterns."""

import hashlib
import random
import re
import time

import pytest
import regex
from helpers import documents, empty_documents

from tessera.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s)),
        "phone": lambda s: 9 <= len(digits(s)) <= 15,
    }
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "", re.A) if ok[k](m[0])] for k, p in PLAIN.items()}


HARD = [
    "+1 (017) 555-7713 x a@b.c_d@e.fg 1.2.3.4.5.6.7.8 4111 1111 1111 1111", "4111111111111111", "x" * 20_000 + "@a.b", "9" * 20_000, "a@" + "b." * 3000 + "c",
    "é😀 a@b.co 😀 1.1.1.1", "000.1.2.256 0255.01.2.3 1..2.3.4.5", "+49-170-1234567+49-170-1234567", "4111-1111 1111-1111 4111--1111", "@@a@b.c@d.e", "1 2 3 4 5 6 7 8 9 0 1 2 3", "+" * 500 + "1 2 3 4 5 6 7 8 9",
]


def cases():
    rng = random.Random(3)
    letters = "ab1239. -@+()0,\n"
    return HARD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]


@pytest.fixture(scope="module")
def model(spark):
    return pii.detector(spark)


def test_base_spans_equal_plain_patterns(spark, model):
    docs = documents(spark, [(1000 + i, t, "en", "s", None) for i, t in enumerate(cases())])
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pii.report(docs, model=model).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            continue
        want = plain_spans(texts[r.doc_id])
        flat = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in want[k])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(want[k]) for k in pii.KINDS), texts[r.doc_id][:200]
        assert r.base_sha256 == hashlib.sha256(flat.encode()).hexdigest()
        assert set(filter(None, flat.split(","))) <= set(r.spans.split(","))


def test_trees_add_spelt_out_data_and_leave_plain_text(spark, model):
    found = ["write to anna.berg at example dot com now", "mail me: info (at) shop dot org", "card 4111.1111.1111.1111 ok", "call (555) 123-4567 today", "ip 2001:0db8:85a3:0000:0000:8a2e:0370:7334 seen"]
    clean = ["we met at noon. The end", "on 2024-01-05 at 10:20:30 it rained", "version 1.2.3 of 12.345.678 items", "th at thhablewh. Es ing", "order 1234 5678 9012 was late", "pages 10-12 and 1990 2000 2010"]
    docs = documents(spark, [(2000 + i, t, "en", "s", None) for i, t in enumerate(found + clean)])
    got = {r.doc_id: r.spans for r in pii.report(docs, model=model).collect()}
    assert [bool(got[2000 + i]) for i in range(len(found))] == [True] * len(found)
    assert [got[2000 + len(found) + i] for i in range(len(clean))] == [""] * len(clean)


def test_held_out_precision(spark, model):
    rows = pii.training_texts(800, seed=99)
    docs = spark.createDataFrame([(i, r["text"]) for i, r in enumerate(rows)], "doc_id bigint, text string")
    right = wrong = missed = 0
    for r in pii.report(docs, model=model).collect():
        row = rows[r.doc_id]
        hit = any(int(a) < row["end"] and row["start"] < int(b) for k, a, b in (s.split(":") for s in r.spans.split(",") if s))
        right += hit and row["label"]
        wrong += hit and not row["label"]
        missed += (not hit) and row["label"]
    assert right / (right + wrong) > 0.95 and right > missed


def test_redaction(spark, model):
    docs = documents(spark, [(3000, "a 1.2.3.4 b a@b.co c", "en", "s", 99), (3001, "x +1.2.3.4.5.6.7.8.9 y", "en", "s", 99), (3002, "plain", "en", "s", 99)])
    done = pii.redact(docs, model=model, recount="n_chars")
    assert done.columns == docs.columns and done.dtypes == docs.dtypes
    got = {r.doc_id: (r.text, r.n_chars) for r in done.collect()}
    assert got[3000] == ("a [IP] b [EMAIL] c", 18) and got[3002] == ("plain", 99)
    assert got[3001][0].startswith("x [PHONE]") and got[3001][0].endswith(" y") and not re.search("[0-9]", got[3001][0])
    assert got[20][0] is None and pii.redact(empty_documents(spark), model=model).collect() == []


def test_stays_in_the_engine(spark, model):
    plan = pii.report(documents(spark), model=model)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("EvalPython", "Pandas", "InArrow"))


def plain_features(kind, text, start, end):
    hit, before, after = text[start:end], text[max(0, start - pii.CONTEXT) : start], text[end : end + 2]
    digits = re.sub("[^0-9]", "", hit)
    separators = re.sub("[^ ./_:-]", "", hit)
    has = lambda pattern, s: float(bool(re.search(pattern, s, re.A)))
    return [
        len(hit), len(digits), len(re.sub("[^A-Za-z]", "", hit)), float(len(digits) > 1 and luhn(digits)), len(separators), len(set(separators)),
        has(r"[(\[{<]", hit), has(r"^[0-9]{4}([ ./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$", hit),
        has(r"^(?:19|20)[0-9]{2}[ ./-][01]?[0-9][ ./-][0-3]?[0-9]\b|^[0-3]?[0-9][ ./-][0-3]?[0-9][ ./-](?:19|20)[0-9]{2}\b|^[0-9]{2}:[0-9]{2}:[0-9]{2}", hit),
        has(pii._CUES[kind], before), has(pii._ANTI, before), has(r"[A-Za-z0-9$€£#=/_.,+-]$", before), has(r"^(?:[A-Za-z0-9%€£/_=-]|[.,][0-9])", after),
        has(r"(?i)(?:\.|dot[)\]}> ]) {0,2}(?:com|org|net|edu|gov|io|info|co|de|fr|es|uk|eu|biz|dev)$", hit),
        float(digits[0]) if digits else -1.0, has(r"^(\d)\1+$", digits), len(re.sub("[^0-9A-Za-z]+", " ", hit).split(" ")),
    ]


def plain_added(text, model):
    """Candidates by all pairs, scored by walking the trees."""
    base = [s for spans in plain_spans(text).values() for s in spans]
    found = []
    for rank, kind in enumerate(pii.KINDS):
        for start, end in {m.span() for p in pii._PROPOSED[kind] for m in regex.finditer(p, text, regex.A)}:
            if not any(a < end and start < b for a, b in base):
                over = model.trees[kind].logit([plain_features(kind, text, start, end)])[0] - model.thresholds[kind]
                if over >= 0:
                    found.append((over, start, end, rank))
    beats = lambda o, c: o[0] > c[0] + 1e-9 or (abs(o[0] - c[0]) <= 1e-9 and o[1:] < c[1:])
    kept = [c for c in found if not any(o != c and o[1] < c[2] and c[1] < o[2] and beats(o, c) for o in found)]
    return sorted((r, a, b) for _, a, b, r in kept)


def test_added_spans_equal_a_plain_version(spark, model):
    rng = random.Random(8)
    written = [r["text"] for r in pii.training_texts(400, seed=5)]
    texts = [" ".join(rng.choice(written) for _ in range(rng.randint(1, 40))) for _ in range(60)] + written + ["😀 " + t for t in written[:50]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    some = 0
    for r in pii.report(docs, model=model).collect():
        text = texts[r.doc_id]
        want = sorted([(k, a, b) for k, spans in enumerate(plain_spans(text).values()) for a, b in spans] + plain_added(text, model))
        assert r.spans == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want), text[:300]
        some += r.spans != ""
    assert some > 200


def test_a_text_of_many_hits(spark, model):
    n = 100_000
    docs = spark.createDataFrame([(1, "x@y.co " * n), (2, "call (555) 123-4567 or mail anna.berg at shop dot org " * 2_000)], "doc_id bigint, text string")
    begun = time.time()
    got = {r.doc_id: r for r in pii.report(docs, model=model).collect()}
    text = {r.doc_id: r.text for r in pii.redact(docs, model=model).collect()}
    assert time.time() - begun < 120
    assert got[1].n_email == n and got[1].base_sha256 == hashlib.sha256(",".join(f"email:{7 * i}:{7 * i + 6}" for i in range(n)).encode()).hexdigest()
    assert text[1] == "[EMAIL] " * n and text[2] == "call [PHONE] or mail [EMAIL] " * 2_000


def test_columns_that_begin_alike(spark, model):
    docs = spark.createDataFrame([(1, "a@b.co x", 7, 8, 9)], "doc_id bigint, text string, pii_email int, pii__text int, PII_added int")
    done = pii.redact(docs, model=model)
    assert done.dtypes == docs.dtypes and tuple(done.first()) == (1, "[EMAIL] x", 7, 8, 9)
