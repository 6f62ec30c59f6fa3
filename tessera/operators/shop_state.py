"""The state of a shop session, advanced by one action; batch and stream share it.

Pages are index, search_results, item_page, item_sub_page and done. What a page does not offer changes nothing:
index and done offer no clicks, results offer next, prev from the second page on and items, an item's page its options, its sub
pages, prev (to the results) and buy now, a sub page prev (to the item). A search is possible before the end at any
time. Back to search forgets everything, also the visited items and the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

SUB_PAGES = ("description", "features", "reviews", "attributes")
STATE_ROW = "session {session}, step {step}, page string, page_number int, asin string, options string, visited string, counts string, done boolean"


@dataclass
class Shop:
    page: str = "index"
    page_number: int | None = None
    asin: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    visited: list[str] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)

    def count(self, kind: str) -> None:
        self.counts[kind] = self.counts.get(kind, 0) + 1

    def results(self, number: int) -> None:
        self.page, self.page_number, self.asin, self.options = "search_results", number, None, {}
        self.count("search")

    def act(self, action: str | None, option: str | None) -> None:
        """``option`` names the option that a clicked value belongs to; null for any other action."""
        name, _, rest = (action or "").lower().partition("[")
        arg = rest.rsplit("]", 1)[0]
        if self.page == "done" or not arg:
            return
        if name == "search":
            self.results(1)
        elif name == "click" and self.page != "index":
            self.click(arg, option)

    def click(self, arg: str, option: str | None) -> None:
        on = self.page
        if arg == "back to search":
            self.__init__()
        elif arg == "next >" and on == "search_results":
            self.results(self.page_number + 1)
        elif arg == "< prev":
            if on == "item_sub_page":
                self.page = "item_page"
            elif on == "item_page":
                self.results(self.page_number)
            elif self.page_number > 1:
                self.results(self.page_number - 1)
        elif on == "item_page" and arg == "buy now":
            self.page = "done"
            self.count("purchase")
        elif on == "item_page" and arg in SUB_PAGES:
            self.page = "item_sub_page"
            self.count(arg)
        elif on == "item_page" and option is not None:
            self.options[option.lower()] = arg
            self.count("options")
        elif on == "search_results" and option is None and arg != "buy now" and arg not in SUB_PAGES:
            self.page, self.asin = "item_page", arg.upper()
            self.count("asin")
            if self.asin not in self.visited:
                self.visited.append(self.asin)

    def row(self) -> tuple:
        text = lambda pairs: ";".join(f"{k}={v}" for k, v in sorted(pairs.items()))
        return self.page, self.page_number, self.asin, text(self.options), ",".join(self.visited), text(self.counts), self.page == "done"


def fold(steps: DataFrame) -> DataFrame:
    """Per step of each session the state after it; ``steps`` has session, step, action and option.

    A session's steps are taken in order by one task, sessions are spread over all. After the end nothing is put out.
    """
    kinds = dict(steps.dtypes)
    schema = STATE_ROW.format(session=kinds["session"], step=kinds["step"])
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], step, *state) for step, state in advance(Shop(), rows.sort_values("step").itertuples(index=False))], columns=names).astype({"page_number": "Int32"})

    return steps.select("session", "step", "action", "option").groupBy("session").applyInPandas(run, schema)


def advance(shop: Shop, rows: Iterator) -> Iterator[tuple]:
    """(step, state) after each row of (step, action, option), up to the end of the session."""
    for r in rows:
        if shop.page == "done":
            return
        option = r.option if isinstance(r.option, str) else None
        shop.act(r.action if isinstance(r.action, str) else None, option)
        yield r.step, shop.row()
