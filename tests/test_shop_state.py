"""Shop sessions: the fold against written sequences, and the stream against the fold."""

import json
import os
import random

import pytest

from tessera.operators import shop_state
from tessera.streaming import shop

SCHEMA = "session long, step long, action string, option string, at timestamp"
ACTIONS = [("search[mug]", None), ("click[b01]", None), ("click[b02]", None), ("click[next >]", None), ("click[< prev]", None), ("click[red]", "Color"), ("click[blue]", "color"), ("click[large]", "size"), ("click[description]", None), ("click[back to search]", None), ("think", None), (None, None), ("click[]", None), ("click[buy now]", None)]


def states(actions):
    s, out = shop_state.Shop(), []
    for a in actions:
        s.act(*a)
        out.append(s.row())
    return out


def test_transitions():
    got = states([("click[b01]", None), ("search[red mug]", None), ("click[< prev]", None), ("click[next >]", None), ("click[b01]", None), ("click[red]", "Color"), ("click[Features]", None), ("click[buy now]", None), ("click[< prev]", None), ("click[< prev]", None), ("click[B02]", None), ("click[next >]", None), ("click[buy now]", None), ("search[x]", None)])
    assert got[0] == ("index", None, None, "", "", "", False)
    assert got[2] == got[1] == ("search_results", 1, None, "", "", "search=1", False)
    assert got[3][:2] == ("search_results", 2)
    assert got[5] == ("item_page", 2, "B01", "color=red", "B01", "asin=1;options=1;search=2", False)
    assert got[6] == got[7] and got[6][0] == "item_sub_page"
    assert got[8][:4] == ("item_page", 2, "B01", "color=red") and got[9] == ("search_results", 2, None, "", "B01", "asin=1;features=1;options=1;search=3", False)
    assert got[11][4] == "B01,B02" and got[12][-1] and got[13] == got[12]
    assert states([("search[x]", None), ("click[b01]", None), ("click[back to search]", None)])[-1] == ("index", None, None, "", "", "", False)


def written(n=12, seed=6):
    rng = random.Random(seed)
    rows = []
    for session in range(n):
        at = 0
        for step in range(rng.randint(1, 25)):
            at += rng.randint(1, 50)
            action = ("search[mug]", None) if step == 0 else rng.choices(ACTIONS, [6, 8, 8, 4, 4, 5, 5, 5, 4, 1, 1, 1, 1, 1])[0]
            rows.append((session, step, *action, f"2024-01-01T{at // 3600:02d}:{at // 60 % 60:02d}:{at % 60:02d}"))
    return rows


def cut(rows, pieces, seed):
    """Batches that keep each session's order."""
    rng = random.Random(seed)
    batches = [[] for _ in range(pieces)]
    place = {}
    for r in rows:
        place[r[0]] = min(pieces - 1, place.get(r[0], 0) + (rng.random() < 0.4) * rng.randint(0, 2))
        batches[place[r[0]]].append(r)
    for b in batches:
        rng.shuffle(b)
    return batches


def write(folder, i, rows):
    path = folder / f"{i:03d}.json"
    path.write_text("".join(json.dumps(dict(zip(("session", "step", "action", "option", "at"), r))) + "\n" for r in rows))
    os.utime(path, (1_000 + i, 1_000 + i))


def run(spark, source, out, checkpoint, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    stream = stream.withWatermark("at", "0 seconds") if options.get("event_time") else stream
    frame = shop.sessions(stream, **options)
    query = frame.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).outputMode("append")
    # by the clock, timers may fire at any time, and "available now" would never end
    query = (query.trigger(once=True) if options and not options.get("event_time") else query.trigger(availableNow=True)).start()
    assert query.awaitTermination(100)
    return sorted(map(tuple, spark.read.parquet(str(out)).collect()), key=repr)


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    shop.use_rocksdb(spark)
    yield
    spark.conf.set(key, before)


def batch(spark, rows):
    df = spark.createDataFrame([r[:4] for r in rows], "session long, step long, action string, option string")
    return sorted(map(tuple, shop_state.fold(df).collect()), key=repr)


def test_fold_equals_plain(spark):
    rows = written()
    want = []
    for session in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == session)
        for r, state in zip(own, states([(r[2], r[3]) for r in own])):
            want.append((session, r[1], *state))
            if state[-1]:
                break
    assert batch(spark, random.Random(1).sample(rows, len(rows))) == sorted(want, key=repr)


@pytest.mark.parametrize("pieces,seed", [(1, 0), (4, 1), (7, 2)])
def test_stream_equals_batch_for_any_cuts_and_restarts(spark, tmp_path, rocksdb, pieces, seed):
    rows, source = written(), tmp_path / "in"
    source.mkdir()
    batches = cut(rows, pieces, seed)
    for i, b in enumerate(batches):  # the query ends and starts again from its checkpoint half way
        write(source, i, b)
        if i in (pieces // 2, pieces - 1):
            got = run(spark, source, tmp_path / "out", tmp_path / "check")
    assert got == batch(spark, rows)


def test_idle_sessions_expire_by_event_time(spark, tmp_path, rocksdb):
    source = tmp_path / "in"
    source.mkdir()
    step = lambda s, i, a, at: (s, i, a, None, f"2024-01-01T00:{at:02d}:00")
    for i, rows in enumerate([[step(1, 0, "search[a]", 0), step(1, 1, "click[b01]", 1), step(2, 0, "search[a]", 1)], [step(2, 1, "click[b02]", 30)], [step(3, 0, "search[z]", 31)], [step(1, 2, "click[buy now]", 32)]]):
        write(source, i, rows)
    got = run(spark, source, tmp_path / "out", tmp_path / "check", idle_ms=600_000, event_time=True)
    assert (1, 1, "expired", 1, "B01", "", "B01", "asin=1;search=1", False) in got
    # session 1 began anew after it had expired, so there was nothing to buy
    assert (1, 2, "index", None, None, "", "", "", False) in got and not any(r[-1] for r in got)
    assert (2, 1, "item_page", 1, "B02", "", "B02", "asin=1;search=1", False) in got


def test_clock_options(spark, tmp_path, rocksdb):
    source = tmp_path / "in"
    source.mkdir()
    write(source, 0, [(1, 0, "search[a]", None, "2024-01-01T00:00:00"), (1, 1, "click[b01]", None, "2024-01-01T00:00:01")])
    got = run(spark, source, tmp_path / "out", tmp_path / "check", idle_ms=3_600_000, ttl_ms=3_600_000)
    assert [r[2] for r in got] == ["search_results", "item_page"]
    with pytest.raises(ValueError):
        shop.sessions(spark.createDataFrame([], SCHEMA), ttl_ms=5, event_time=True)
