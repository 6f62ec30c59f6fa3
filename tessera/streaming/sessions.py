"""Shop sessions as streams: running counters, windowed counts with late data, and the page state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_counters(steps: DataFrame) -> DataFrame:
    """Running totals per session: steps, clicks, searches, and whether it has bought. For update or complete output."""
    clicked, searched = F.col("action").startswith("click["), F.col("action").startswith("search[")
    return steps.groupBy("session").agg(F.count(F.lit(1)).alias("steps"), F.count_if(clicked).alias("clicks"), F.count_if(searched).alias("searches"), F.max(F.lower("action") == "click[buy now]").alias("bought"))


def windowed_counts(events: DataFrame, *, time: str = "ts", late: str = "10 minutes", window: str = "1 hour", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums per event-time window and key; rows later than the watermark are left out, state is dropped behind it."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


_STATE = "kind string, page_number int, steps long, done boolean"
_OUT = "session long, page string, page_number int, steps long, done boolean"


def fold_pages(steps: DataFrame, timeout: str | None = None) -> DataFrame:
    """The present page of each session after every batch: the session state machine, one small state a session.

    ``steps`` has session, step and action; a batch's steps are taken in step order. A session that is done
    ignores what follows. With ``timeout`` (milliseconds as text) an idle session's state is dropped.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        page, number, count, done = state.get if state.exists else ("index", None, 0, False)
        rows = pd.concat(list(batches)).sort_values("step")
        for action in rows["action"]:
            if done:
                break
            count += 1
            name, _, rest = action.lower().partition("[")
            arg = rest.rsplit("]", 1)[0]
            if name == "search":
                page, number = "search_results", 1
            elif name != "click":
                page = "index"
            elif arg == "buy now":
                page, done = "done", True
            elif arg == "back to search":
                page, number = "index", None
            elif arg in ("next >", "< prev"):
                if number is None:
                    page = "index"
                else:
                    page, number = "search_results", number + (1 if arg == "next >" else -1)
            else:
                page = "item_sub_page" if arg in ("description", "features", "reviews") else "item_page"
        state.update((page, number, count, done))
        if timeout is not None:
            state.setTimeoutDuration(timeout)
        yield pd.DataFrame({"session": [key[0]], "page": [page], "page_number": pd.array([None if number is None else max(1, number)], dtype="Int32"), "steps": [count], "done": [done]})

    kind = GroupStateTimeout.NoTimeout if timeout is None else GroupStateTimeout.ProcessingTimeTimeout
    return steps.groupBy("session").applyInPandasWithState(run, _OUT, _STATE, "update", kind)
