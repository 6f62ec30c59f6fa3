"""Web pages as observations: visible text, clickables, listing and item records."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = " [SEP] "
_HIDDEN = ("style", "script", "head", "title", "meta")


def visible_text(html: Column) -> Column:
    """Visible text nodes joined by separators, by expressions alone: head, scripts, styles and comments go, tags split."""
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<!doctype[^>]*>|<head\b.*?</head>|<(script|style|title)\b.*?</\1>", "<>")
    parts = F.split(F.regexp_replace(text, r"(?s)<[^>]*>", "\u0001"), "\u0001", -1)
    kept = F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    return F.array_join(kept, SEPARATOR)


class _Reader(HTMLParser):
    """Text nodes with their element, its class, and whether they are shown."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []
        self.found: list[tuple[str, str, str]] = []
        self.radios: list[str] = []
        self.search = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(attrs)
        self.search = self.search or given.get("id") == "search_input"
        if tag == "input" and given.get("type") == "radio":
            self.radios.append(given.get("value") or "")
        if tag not in ("br", "img", "input", "meta", "link", "hr"):
            self.open.append((tag, given.get("class") or ""))

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                del self.open[depth:]
                break

    def handle_data(self, data: str) -> None:
        tag, cls = self.open[-1] if self.open else ("", "")
        if tag not in _HIDDEN and not any(t == "head" for t, _ in self.open) and data != "\n":
            self.found.append((data, tag, cls))


def _read(html: str | None) -> _Reader:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader


def rich_text(html: Column, url: Column, visited: Column) -> Column:
    """The text with its clickables marked, those already clicked as such; ``visited`` is an array of item ids.

    Needs a parser that knows the element of each text, so it runs in Arrow batches.
    """

    @F.pandas_udf("string")
    def run(pages: pd.Series, urls: pd.Series, seen: pd.Series) -> pd.Series:
        out = []
        for page, address, asins in zip(pages, urls, seen):
            text = ""
            for data, tag, cls in _read(page).found:
                if tag == "button":
                    shown = f"[button] {data} [button_]"
                elif tag == "label" and f'"{data}"' in (address or ""):
                    shown, text = f"  [clicked button] {data} [clicked button_]", f"You have clicked {data}.\n" + text
                elif tag == "label":
                    shown = f"  [button] {data} [button_]"
                elif cls == "product-link":
                    mark = "clicked button" if data in set(asins if asins is not None else ()) else "button"
                    shown = f"\n[{mark}] {data} [{mark}_]"
                else:
                    shown = data
                text += shown + "\n"
            out.append(text)
        return pd.Series(out)

    return run(html, url, visited)


def links(html: Column) -> Column:
    """Texts of links in page order, by expressions alone."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), lambda t: F.lower(F.trim(t)))


def clickables(html: Column) -> Column:
    """struct(has_search_bar, clickables): button and item link texts in lower case, then option values, each once."""

    @F.pandas_udf("struct<has_search_bar:boolean,clickables:array<string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            rows = []
            for page in pages:
                reader = _read(page)
                names = [d.lower() for d, _, cls in reader.found if "btn" in cls.split()] + [d.lower() for d, _, cls in reader.found if cls == "product-link"] + reader.radios
                rows.append((reader.search, list(dict.fromkeys(names))))
            yield pd.DataFrame(rows, columns=["has_search_bar", "clickables"])

    return run(html)


def listing(html: Column, item: str, fields: dict[str, str], most: int = 10) -> Column:
    """Records of a results page: array of structs of the first ``most`` pieces that match ``item``.

    ``item`` and the fields are patterns with one group; a field that a piece lacks is 'N/A'.
    """
    pieces = F.slice(F.regexp_extract_all(html, F.lit(item), F.lit(1)), 1, most)
    value = lambda p, pattern: F.when(p.rlike(pattern), F.trim(F.regexp_extract(p, pattern, 1))).otherwise("N/A")
    return F.transform(pieces, lambda p: F.struct(*(value(p, pattern).alias(name) for name, pattern in fields.items())))


def item(html: Column, fields: dict[str, str]) -> Column:
    """One record of an item page; a field that the page lacks is 'N/A'."""
    return F.struct(*(F.when(html.rlike(p), F.trim(F.regexp_replace(F.regexp_extract(html, p, 1), r"(?s)<[^>]*>", ""))).otherwise("N/A").alias(n) for n, p in fields.items()))
