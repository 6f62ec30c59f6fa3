"""Split reading of JSON arrays against the json module and Spark's reader of whole files."""

import json
import random

import pytest

from tessera.sources import json_arrays

PIECES = ['"', "\\", '\\"', "{", "}", "[", "]", ",", ":", "é", "\U0001f600", "\n", "\r\n", "\t", " ", "plain words", '"}, {"', "\\\\", "]}"]


def value(rng, depth=0):
    kind = rng.random()
    if depth > 3 or kind < 0.5:
        return "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))
    if kind < 0.6:
        return rng.choice([None, True, 1, -2.5, ""])
    if kind < 0.8:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {f"k{i}" + rng.choice(PIECES): value(rng, depth + 1) for i in range(rng.randint(0, 4))}


def element(rng, i):
    return {"id": i, "text": value(rng, 9), "more": value(rng)}


def _loaded(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return text


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("broadcast", [True, False])
def test_elements_in_order(spark, tmp_path, small_splits, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(json_arrays, "BROADCAST_SPLITS", 0)
    rng = random.Random(8)
    files = {}
    for f, (n, options) in enumerate([(60, {}), (40, {"indent": 2}), (30, {"ensure_ascii": False, "separators": (",", ":")}), (1, {}), (0, {}), (3, {"indent": "\t"})]):
        items = [element(rng, i) for i in range(n)]
        text = json.dumps(items, **options)
        if f == 1:
            text = "﻿ \r\n" + text.replace("\n", "\r\n") + "\r\n\r\n"
        (tmp_path / f"{f}.json").write_text(text, encoding="utf-8", newline="")
        files[f"{f}.json"] = items
    (tmp_path / "one.json").write_text(json.dumps(element(rng, 5), indent=1) + "\n")
    files["one.json"] = [json.loads((tmp_path / "one.json").read_text())]
    (tmp_path / "long.json").write_text(json.dumps([{"id": 1, "text": "x" * 5_000}, 7, None, "s}", [1, [2, "]"]], {}]))
    files["long.json"] = json.loads((tmp_path / "long.json").read_text())
    got = {name: [] for name in files}
    rows = json_arrays.read_elements(spark, str(tmp_path))
    for r in sorted(rows.collect(), key=lambda r: (r.block, r.at)):
        got[r.source_file.split("/")[-1]].append(json.loads(r.text))
    assert got == files
    assert json_arrays.split_states(spark, str(tmp_path)).count() > 50


def test_rows_equal_the_plain_reader(spark, tmp_path, small_splits):
    rng = random.Random(3)
    for f in range(3):
        (tmp_path / f"{f}.json").write_text(json.dumps([element(rng, i) for i in range(50)], indent=[None, 0, 3][f]))
    schema = "id int, text string, more string"
    plain = spark.read.schema(schema).option("multiLine", True).json(str(tmp_path))
    split = json_arrays.read_rows(spark, str(tmp_path), schema)
    # a nested value as text is cut from the file by one reader and written anew by the other
    same = lambda r: (r.id, r.text, _loaded(r.more))
    assert sorted(map(same, split.collect()), key=repr) == sorted(map(same, plain.collect()), key=repr)


def test_variants_keep_what_a_schema_would_lose(spark, tmp_path):
    items = [{"d": "one"}, {"d": ["a", "b"]}, {"d": None}, {}, {"d": 5}, {"d": {"x": 1}}]
    (tmp_path / "v.json").write_text(json.dumps(items))
    rows = json_arrays.read_variants(spark, str(tmp_path), "v").selectExpr("at", "to_json(v) as v")
    assert [json.loads(r.v) for r in rows.orderBy("at").collect()] == items
