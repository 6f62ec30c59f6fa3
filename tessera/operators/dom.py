"""A page as an array of its nodes, and records read from it by selectors.

Nodes stand in document order; what is inside a node are those whose place ``at`` lies between its ``at`` and its
``end``, so finding below a node is a comparison of numbers, whatever the nesting. Only parsing needs Python,
in Arrow batches; selectors are expressions on the array, so a page's record needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "array<struct<at:int,end:int,parent:int,tag:string,attributes:map<string,string>,text:string>>"
_ARROW = pa.list_(pa.struct([("at", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string())]))
MISSING = "N/A"
#: Pages of a batch that are Python objects at a time.
PAGES = 128

# Elements without an end tag, and elements that end where one of the same group begins.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
CLOSES = {"li": ("li",), "option": ("option",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: No implied end reaches beyond these.
_WALLS = ("ul", "ol", "select", "table", "dl", "div", "body", "section", "article")


class _Nodes(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[dict] = []

    def add(self, tag: str, attributes: dict[str, str], text: str | None) -> dict:
        at = len(self.nodes)
        node = {"at": at, "end": at + 1, "parent": self.open[-1]["at"] if self.open else None, "tag": tag, "attributes": attributes, "text": text}
        self.nodes.append(node)
        return node

    def shut(self, depth: int) -> None:
        for node in self.open[depth:]:
            node["end"] = len(self.nodes)
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ends = CLOSES.get(tag, ())
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.open[depth]["tag"]
            if name in ends and (tag != "tr" or name == "tr" or not any(n["tag"] == "tr" for n in self.open[:depth])):
                self.shut(depth)
                break
            if name in _WALLS:
                break
        node = self.add(tag, {k: v or "" for k, v in reversed(attrs)}, None)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.shut(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth]["tag"] == tag:
                self.shut(depth)
                return

    def handle_data(self, data: str) -> None:
        self.add("#text", {}, data)


def parse(html: str | None) -> list[dict]:
    """The nodes of one page; texts are nodes '#text'. What is never closed ends with its parent."""
    reader = _Nodes()
    reader.feed(html or "")
    reader.close()
    reader.shut(0)
    return reader.nodes


def nodes(html: Column) -> Column:
    @F.arrow_udf(NODES)
    def run(pages: pa.Array) -> pa.Array:
        parts = [pa.array([], _ARROW)]
        for at in range(0, len(pages), PAGES):  # nodes as Python objects for so many pages, whatever the batch
            rows = [[n | {"attributes": list(n["attributes"].items())} for n in parse(p)] for p in pages.slice(at, PAGES).to_pylist()]
            parts.append(pa.array(rows, _ARROW))
        return pa.concat_arrays(parts)

    return run(html)


@dataclass(frozen=True)
class Select:
    """A node by tag, id, classes it must all have, and attributes with a value (or None for any)."""

    tag: str | None = None
    id: str | None = None
    classes: tuple[str, ...] = ()
    attributes: tuple[tuple[str, str | None], ...] = ()

    def matches(self, node: Column) -> Column:
        value = lambda name: F.try_element_at(node["attributes"], F.lit(name))
        tests = [node["tag"] == self.tag if self.tag else node["tag"] != "#text"]
        tests += [value("id") == self.id] if self.id else []
        tests += [F.array_contains(F.split(F.coalesce(value("class"), F.lit("")), r"\s+"), c) for c in self.classes]
        tests += [value(n).isNotNull() if v is None else value(n) == v for n, v in self.attributes]
        out = tests[0]
        for t in tests[1:]:
            out = out & F.coalesce(t, F.lit(False))
        return out


def inside(node: Column, within: Column) -> Column:
    return (node["at"] > within["at"]) & (node["at"] < within["end"])


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often a function over the page's nodes asks for it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find_all(page: Column, select: Select, within: Column | None = None) -> Column:
    """The matching nodes in page order, of the whole page or inside one node."""
    if within is None:
        return F.filter(page, select.matches)
    return _bound(within, lambda w: F.filter(page, lambda n: inside(n, w) & select.matches(n)))


def find(page: Column, path: tuple[Select, ...], within: Column | None = None) -> Column:
    """The first match of the first selector, in it the first of the second, and so on; null if one is missing."""
    for select in path:
        within = F.get(find_all(page, select, within), F.lit(0))
    return within


def text(page: Column, node: Column) -> Column:
    """All text inside a node, null for a null node."""
    parts = lambda w: F.filter(page, lambda m: (m["tag"] == "#text") & inside(m, w))
    return _bound(node, lambda w: F.when(w.isNotNull(), F.array_join(F.transform(parts(w), lambda m: m["text"]), "")))


def attribute(node: Column, name: str) -> Column:
    return F.try_element_at(node["attributes"], F.lit(name))


def tidy(value: Column) -> Column:
    return F.btrim(value, F.lit(" \t\n\r\x0b\x0c"))


def numbers(value: Column) -> Column:
    """The decimal numbers of a text, thousands separated by commas or not."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(value, r"(?<=\d),(?=\d{3})", ""), F.lit(r"(\d*\.?\d+)"), F.lit(1)), lambda n: n.cast("double"))


@dataclass(frozen=True)
class Field:
    """A value of a record: the text or an attribute (``take``) of the node at the end of ``path``, then ``clean``; an empty path is the record's own node."""

    name: str
    path: tuple[Select, ...]
    take: str = "text"
    clean: Callable[[Column], Column] = tidy

    def value(self, page: Column, within: Column | None) -> Column:
        node = find(page, self.path, within) if self.path else within
        raw = text(page, node) if self.take == "text" else attribute(node, self.take)
        return self.clean(raw)


def _after_colon(value: Column) -> Column:
    return tidy(F.regexp_replace(tidy(F.substring_index(value, ":", -1)), r"^\$+|\$+$", ""))


def _item_number(link: Column) -> Column:
    """The end of a link's path."""
    return F.regexp_extract(F.substring_index(link, "?", 1), "/itm/(.*)$", 1)


# What marks a record and its fields on results pages of the three sites.
RESULTS: dict[str, tuple[Select, tuple[Field, ...]]] = {
    "shop": (
        Select("div", classes=("list-group-item",)),
        (Field("asin", (Select("a", classes=("product-link",)),)), Field("title", (Select("h4", classes=("product-title",)),)), Field("price", (Select("h5", classes=("product-price",)),))),
    ),
    "market": (
        Select("div", attributes=(("data-component-type", "s-search-result"),)),
        (Field("asin", (), "data-asin"), Field("title", (Select("h2", classes=("a-size-mini",)),)), Field("price", (Select("div", classes=("s-price-instructions-style",)), Select("span", classes=("a-offscreen",))))),
    ),
    "auction": (
        Select(classes=("s-item__wrapper", "clearfix")),
        (Field("asin", (Select(classes=("s-item__link",)),), "href", _item_number), Field("title", (Select(classes=("s-item__title",)),)), Field("price", (Select(classes=("s-item__price",)),))),
    ),
}

# The same of item pages.
ITEMS: dict[str, tuple[Field, ...]] = {
    "shop": (
        Field("title", (Select("h2"),)), Field("image", (Select("img"),), "src"),
        Field("description", (Select("p", classes=("product-info",)),)), Field("features", (Select("ul"),)),
    ),
    "market": (
        Field("title", (Select("span", id="productTitle"),), clean=lambda c: F.replace(tidy(c), F.lit(","), F.lit(""))), Field("price", (Select("span", classes=("apexPriceToPay",)), Select("span", classes=("a-offscreen",)))),
        Field("rating", (Select("span", id="acrPopover"),)), Field("image", (Select("img", id="landingImage"),), "src"),
        Field("description", (Select("div", id="productDescription_feature_div"), Select("div", id="productDescription"))), Field("features", (Select("div", id="feature-bullets"),)),
    ),
    "auction": (
        Field("title", (Select("h1", classes=("x-item-title__mainTitle",)),)), Field("price", (Select("div", classes=("mainPrice",)),)),
        Field("rating", (Select("span", classes=("reviews-star-rating",)),), "title", lambda c: F.substring_index(tidy(c), " ", 1)),
        Field("image", (Select("div", id="mainImgHldr"), Select("img", id="icImg")), "src"), Field("features", (Select("div", classes=("x-about-this-item",)),)),
    ),
}
ITEM_FIELDS = ("title", "price", "rating", "image", "description", "features")


def results(page: Column, site: str, most: int = 10) -> Column:
    """array<struct<asin, title, price, low, high>> of the first ``most`` records of a results page; missing texts are 'N/A', prices null."""
    mark, fields = RESULTS[site]

    def record(node: Column) -> Column:
        values = {f.name: f.value(page, node) for f in fields}
        texts = F.struct(*(F.coalesce(values[n], F.lit(MISSING)).alias(n) for n in ("asin", "title", "price")))
        price = lambda r, i: F.get(numbers(r["price"]), F.lit(i))
        return _bound(texts, lambda r: F.struct(r["asin"], r["title"], r["price"], price(r, 0).alias("low"), price(r, 1).alias("high")))

    made = F.transform(F.slice(find_all(page, mark), 1, most), record)
    return F.filter(made, lambda r: ~F.contains(F.lower(r["title"]), F.lit("shop on ebay"))) if site == "auction" else made


def _headed(page: Column, word: str) -> Column:
    """What stands after the colon in the first h4 that has the word."""
    texts = F.transform(find_all(page, Select("h4")), lambda h: text(page, h))
    return _after_colon(F.get(F.filter(texts, lambda t: F.contains(t, F.lit(word))), F.lit(0)))


def item(page: Column, site: str) -> Column:
    """struct<title, price, rating, image, description, features, low, options> of an item page.

    ``options`` is array<struct<name, values>>. A field that the page or the site has not is 'N/A', a price without a number null.
    """
    values = {f.name: f.value(page, None) for f in ITEMS[site]}
    if site == "shop":
        lines = F.transform(find_all(page, Select("li"), find(page, (Select("ul"),))), lambda li: tidy(text(page, li)))
        values |= {"price": _headed(page, "Price"), "rating": _headed(page, "Rating"), "features": F.when(find(page, (Select("ul"),)).isNotNull(), F.array_join(lines, "\n"))}
    if site == "market":
        paragraphs = F.transform(find_all(page, Select("p"), find(page, (Select("div", id="productDescription_feature_div"), Select("div", id="productDescription")))), lambda p: text(page, p))
        values["description"] = F.when(values["description"].isNotNull(), tidy(F.array_join(paragraphs, " ")))
    texts = F.struct(*(F.coalesce(values.get(n, F.lit(None).cast("string")), F.lit(MISSING)).alias(n) for n in ITEM_FIELDS))
    low = lambda r: F.get(numbers(r["price"]), F.lit(0)).alias("low")
    return _bound(texts, lambda r: F.struct(*(r[n] for n in ITEM_FIELDS), low(r), item_options(page, site).alias("options")))


def item_options(page: Column, site: str) -> Column:
    """array<struct<name, values>> of what can be chosen on an item page."""
    pair = lambda name, values: F.struct(name.alias("name"), values.alias("values"))
    if site == "shop":
        return F.transform(find_all(page, Select("div", classes=("radio-toolbar",))), lambda b: pair(attribute(find(page, (Select("input"),), b), "name"), F.transform(find_all(page, Select("label"), b), lambda x: text(page, x))))
    if site == "auction":
        told = lambda b: F.filter(F.transform(find_all(page, Select("option"), b), lambda o: text(page, o)), lambda t: ~F.contains(F.lower(t), F.lit("select")))
        return F.transform(find_all(page, Select("select", classes=("msku-sel",))), lambda b: pair(F.btrim(tidy(attribute(b, "name")), F.lit(":")), told(b)))
    body = F.coalesce(find(page, (Select("div", id="softlinesTwister_feature_div"),)), find(page, (Select("div", id="twister_feature_div"),)))
    choice = lambda li: F.coalesce(tidy(attribute(find(page, (Select("img"),), li), "alt")), tidy(text(page, li)))
    named = lambda b: F.replace(F.replace(F.get_json_object(attribute(b, "data-a-button-group"), "$.name"), F.lit("_name"), F.lit("")), F.lit("twister_"), F.lit(""))
    return F.transform(find_all(page, Select("ul"), body), lambda b: pair(named(b), F.filter(F.transform(find_all(page, Select("li"), b), choice), lambda t: t != "")))


def _by_site(pages: DataFrame, site: str, html: str, read: Callable[[Column, str], Column], sites: tuple[str, ...], name: str) -> DataFrame:
    """``pages`` parsed once, with a column ``name`` read by the rules of each row's site; null for an unknown site."""
    parsed = pages.withColumn("nodes_", nodes(F.col(html)))
    out = None
    for s in sites:
        value = read(F.col("nodes_"), s)
        out = F.when(F.col(site) == s, value) if out is None else out.when(F.col(site) == s, value)
    return parsed.withColumn(name, out).drop("nodes_")


def read_results(pages: DataFrame, site: str = "site", html: str = "html", name: str = "records") -> DataFrame:
    return _by_site(pages, site, html, results, tuple(RESULTS), name)


def read_items(pages: DataFrame, site: str = "site", html: str = "html", name: str = "item") -> DataFrame:
    return _by_site(pages, site, html, item, tuple(ITEMS), name)
