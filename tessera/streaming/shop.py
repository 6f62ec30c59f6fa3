"""Shop sessions as a stream with keyed state of several kinds.

A session's page, item and last step are a value, its visited items a list, its options and counts maps; each batch
reads and writes only what the session has. Timers close idle sessions, a time-to-live drops what was forgotten.
The state store must be RocksDB (``use_rocksdb``). Rows equal those of ``shop_state.fold`` however the steps are cut
into batches, if each session's steps come in order; a step that comes after a later one was applied is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.shop_state import STATE_ROW, Shop, advance

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_Out = Row(*(c.split()[0] for c in STATE_ROW.split(", ")))


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed state of several kinds needs, for queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class ShopSessions(StatefulProcessor):
    """``idle_ms``: a session without steps for so long is closed with a row whose page is 'expired'."""

    def __init__(self, step_type: str, idle_ms: int | None = None, ttl_ms: int | None = None, event_time: bool = False):
        self.step_type, self.idle_ms, self.ttl_ms, self.event_time = step_type, idle_ms, ttl_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", f"page string, page_number int, asin string, step {self.step_type}", self.ttl_ms)
        self.visited = handle.getListState("visited", "asin string", self.ttl_ms)
        self.options = handle.getMapState("options", "name string", "value string", self.ttl_ms)
        self.counts = handle.getMapState("counts", "kind string", "n int", self.ttl_ms)

    def _load(self) -> tuple[Shop, object]:
        if not self.now.exists():
            return Shop(), None
        page, number, asin, step = self.now.get()
        pairs = lambda state: {k[0]: v[0] for k, v in state.iterator()}
        return Shop(page, number, asin, pairs(self.options), [x[0] for x in self.visited.get()], pairs(self.counts)), step

    def _save(self, before: tuple, shop: Shop, step: object) -> None:
        """Writes what has changed: appended items, single map entries; a map or list is cleared only if it lost something."""
        self.now.update((shop.page, shop.page_number, shop.asin, step))
        visited, options, counts = before
        if shop.visited[: len(visited)] != visited:
            self.visited.clear()
            visited = []
        for asin in shop.visited[len(visited) :]:
            self.visited.appendValue((asin,))
        for state, old, new in ((self.options, options, shop.options), (self.counts, counts, shop.counts)):
            if not set(old) <= set(new):
                state.clear()
                old = {}
            for k, v in new.items():
                if old.get(k) != v:
                    state.updateValue((k,), (v,))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        shop, last = self._load()
        before = list(shop.visited), dict(shop.options), dict(shop.counts)
        fresh = sorted((r for r in rows if last is None or r.step > last), key=lambda r: r.step)
        for step, state in advance(shop, iter(fresh)):
            yield _Out(*key, step, *state)
        if fresh:
            self._save(before, shop, fresh[-1].step)
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            at = max(int(r.at.timestamp() * 1000) for r in fresh) if self.event_time and fresh else timerValues.getCurrentProcessingTimeInMs()
            if fresh or not self.event_time:
                self.handle.registerTimer(at + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        shop, last = self._load()
        if shop.page != "done":
            yield _Out(*key, last, "expired", *shop.row()[1:-1], False)
        for state in (self.now, self.visited, self.options, self.counts):
            state.clear()

    def close(self) -> None:
        pass


def sessions(steps: DataFrame, idle_ms: int | None = None, ttl_ms: int | None = None, event_time: bool = False) -> DataFrame:
    """The state after each step. ``steps`` has session, step, action and option, with ``event_time`` also at, with a watermark.

    ``idle_ms`` counts by event time or by the clock; ``ttl_ms`` by the clock only.
    """
    if event_time and ttl_ms is not None:
        raise ValueError("a time-to-live counts by the clock")
    kinds = dict(steps.dtypes)
    columns = ["session", "step", "action", "option", *(["at"] if event_time else [])]
    mode = "EventTime" if event_time else "None" if idle_ms is None and ttl_ms is None else "ProcessingTime"
    processor = ShopSessions(kinds["step"], idle_ms, ttl_ms, event_time)
    return steps.select(*columns).groupBy("session").transformWithState(processor, STATE_ROW.format(session=kinds["session"], step=kinds["step"]), "append", mode)
