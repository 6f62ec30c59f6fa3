"""Batches in the ledger once, whatever dies or runs twice."""

import json
import os

import pytest

from tessera.sources.ledger import Ledger

SCHEMA = "id int, text string"


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"t{i}") for i in ids], SCHEMA).repartition(2)


def ids(ledger):
    return sorted(r.id for r in ledger.read().collect())


def test_replays_change_nothing(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), SCHEMA)
    assert ids(ledger) == [] and ledger.attempts() == {}
    assert ledger.append(rows(spark, 1, 2), "a") and ledger.append(rows(spark, 3), "b")
    assert not ledger.append(rows(spark, 1, 2), "a") and not Ledger(spark, str(tmp_path / "l"), SCHEMA).append(rows(spark, 9), "b")
    assert ids(ledger) == [1, 2, 3] and ledger.append(rows(spark), "none") and ids(ledger) == [1, 2, 3]
    with pytest.raises(ValueError):
        ledger.append(rows(spark, 1), "../x")


def test_what_dies_before_its_manifest_is_not_there(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, f"file://{tmp_path}/l", SCHEMA)
    ledger.append(rows(spark, 1), "a")

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Ledger, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            ledger.append(rows(spark, 2), "b")
    assert ids(ledger) == [1] and not ledger.committed("b")
    assert ledger.append(rows(spark, 2), "b") and ids(ledger) == [1, 2]
    gone = ledger.clean()
    assert len(gone) == 1 and gone[0].startswith("b--") and ids(ledger) == [1, 2]


def test_of_two_at_once_one_wins(spark, tmp_path, monkeypatch):
    ledger, other = (Ledger(spark, str(tmp_path / "l"), SCHEMA) for _ in range(2))
    commit = Ledger._commit

    def late(self, batch, attempt):
        if self is ledger:
            assert other.append(rows(spark, 7), batch)
        return commit(self, batch, attempt)

    monkeypatch.setattr(Ledger, "_commit", late)
    assert not ledger.append(rows(spark, 7), "a") and ids(ledger) == [7]
    assert len(ledger.clean()) == 1 and ids(ledger) == [7]


def test_resume(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), SCHEMA)
    tasks = rows(spark, *range(10)).select("id")
    for step in range(4):  # each run does the first three that are left
        todo = ledger.remaining(tasks, ["id"]).orderBy("id").limit(3)
        ledger.append(rows(spark, *(r.id for r in todo.collect())), f"run-{step}")
    assert ids(ledger) == list(range(10)) and ledger.remaining(tasks, ["id"]).count() == 0


def test_stream_replays_its_last_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    ledger = Ledger(spark, str(tmp_path / "l"), SCHEMA)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
        query = ledger.stream(stream, "s").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
        assert query.awaitTermination(100)

    for i in range(3):
        (source / f"{i}.json").write_text(json.dumps({"id": i, "text": "x"}))
        os.utime(source / f"{i}.json", (1_000 + i, 1_000 + i))
    run()
    last = max((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if it had died after the batch and before the stream's own record
    for crc in (tmp_path / "c" / "commits").glob(f".{last.name}.crc"):
        crc.unlink()
    (source / "3.json").write_text(json.dumps({"id": 3, "text": "x"}))
    run()
    assert ids(ledger) == [0, 1, 2, 3] and len(ledger.attempts()) == 4
