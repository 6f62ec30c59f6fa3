"""Readers, writers and streams."""

import json
import os

from pyspark.sql import functions as F

from tessera.operators import sessions
from tessera.sources import records
from tessera.streaming import sessions as streaming


def test_json_arrays_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(25)], "id int, text string")
    records.write_json_arrays(rows, str(tmp_path / "out"), ["id"], per_file=10)
    files = list((tmp_path / "out").rglob("part-*"))
    assert 1 <= len(files) <= 3 and all(isinstance(json.loads(f.read_text()), list) for f in files)
    back = spark.read.schema("id int, text string").option("multiLine", True).option("recursiveFileLookup", True).json(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_results_and_index(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "task_7.json").write_text(json.dumps({"meta": {"steps": 3, "reward": 0.5, "success": True}, "conversations": [{"from": "human", "value": "x"}]}, indent=1))
    got = records.read_results(spark, str(tmp_path / "r")).first()
    assert (got.task, got.meta.reward, got.meta.terminate_reason, got.conversations[0].value) == ("task_7", 0.5, None, "x")
    (tmp_path / "a.json").write_text('[["boil", 3], ["melt", 1]]')
    (tmp_path / "b.json").write_text("[4, 5]")
    assert [tuple(r) for r in records.read_index(spark, str(tmp_path / "a.json")).collect()] == [(0, "boil", 3), (1, "melt", 1)]
    assert [tuple(r) for r in records.read_index(spark, str(tmp_path / "b.json")).collect()] == [(0, None, 4), (1, None, 5)]


def test_index_documents(spark, tmp_path):
    rows = spark.createDataFrame([(i, str(i), f"text {i}") for i in range(1, 151)], "ord int, id string, contents string")
    records.write_index_documents(rows, str(tmp_path / "docs"), "ord", limits=(100, None))
    sizes = [records.read_json_lines(spark, str(tmp_path / "docs" / n), "id string, contents string").count() for n in ("100", "all")]
    assert sizes == [100, 150]


def test_ranked_attributes_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("mugs", "blue", 0.5), ("mugs", "steel", 0.25), ("beds", "king size", 1.0)], "category string, attribute string, score double")
    records.write_ranked_attributes(rows, str(tmp_path / "y"))
    got = records.read_ranked_attributes(spark, str(tmp_path / "y")).drop("at")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


STEPS = [(1, 1, "search[mug]"), (1, 2, "click[next >]"), (2, 1, "search[bed]"), (1, 3, "click[b001]"), (1, 4, "click[description]"), (2, 2, "click[back to search]"), (1, 5, "click[buy now]"), (1, 6, "click[b002]"), (2, 3, "think")]


def test_page_stream_equals_batch(spark, tmp_path):
    source, schema = tmp_path / "in", "session long, step long, action string"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("session", "step", "action"), r))) for r in STEPS[3 * i : 3 * i + 3]))
        os.utime(source / f"{i}.json", (1_000 + i, 1_000 + i))  # files are read in this order
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    for name, frame in (("pages", streaming.fold_pages(stream)), ("counters", streaming.session_counters(stream))):
        query = frame.writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        query.awaitTermination()
    last = {}
    for r in spark.table("pages").collect():
        last[r.session] = max(last.get(r.session, (0,)), (r.steps, r.page, r.page_number or 0, r.done))
    batch = sessions.page_states(spark.createDataFrame(STEPS, schema))
    ends = batch.groupBy("session").agg(F.max(F.struct("step", "page", F.coalesce("page_number", F.lit(0)).alias("n"), "done")).alias("e")).collect()
    assert {s: v for s, v in last.items()} == {r.session: tuple(r.e) for r in ends}
    counters = {r.session: (r.steps, r.clicks, r.searches, r.bought) for r in spark.table("counters").orderBy("steps").collect()}
    assert counters == {1: (6, 5, 1, True), 2: (3, 1, 1, False)}


def test_windowed_counts_drop_late_rows(spark, tmp_path):
    source = tmp_path / "ev"
    source.mkdir()
    batches = [[("2024-01-01T00:10:00", "view", 1.0)], [("2024-01-01T03:00:00", "view", 2.0)], [("2024-01-01T03:05:00", "view", 4.0)], [("2024-01-01T00:20:00", "view", 9.0), ("2024-01-01T06:00:00", "view", 3.0)]]
    for i, rows in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(json.dumps({"ts": t, "event_type": e, "value": x}) for t, e, x in rows))
        os.utime(source / f"{i}.json", (1_000 + i, 1_000 + i))  # files are read in this order
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).json(str(source))
    frame = streaming.windowed_counts(stream)
    query = frame.writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert sorted((r.n, r.total) for r in spark.table("windows").collect())[0] == (1, 1.0)
    assert 9.0 not in {r.total for r in spark.table("windows").collect()} and 10.0 not in {r.total for r in spark.table("windows").collect()}
