"""Queries over text search, attribute mining, pages and vectors (W)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dom
from ..operators import pages as pg
from ..operators import search as sr
from ..operators import text_index as ti
from ..sources import views as v
from ..sources import workspace
from .reference import REGISTRY

query = REGISTRY.query

_WORDS = r"regexp_extract_all(lower(text), '([\p{L}\p{N}_][\p{L}\p{N}_]+)')"
_TEXT_WORDS = r"([\p{L}\p{N}_][\p{L}\p{N}_]+)"


def _words(column: str):
    """Words in any script, alike in both engines."""
    return F.regexp_extract_all(F.lower(column), F.lit(_TEXT_WORDS), F.lit(1))


v.SQL["doc_words"] = f"SELECT doc_id, lang, source, {_WORDS} AS words FROM documents"


@query("w12_full_text_top_k", v.with_views("doc_words", """
WITH q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}_][\\p{L}\\p{N}_]+)')) AS term FROM benchmark),
s AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM doc_words),
e AS (SELECT doc_id, len(words) AS dl, unnest(words) AS term FROM doc_words),
t AS (SELECT doc_id, dl, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
w AS (SELECT q.query_id, t.doc_id, sum(ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * t.tf / (t.tf + 0.9 * (1 - 0.4 + 0.4 * t.dl / s.avgdl))) AS score FROM t JOIN f USING (term) JOIN q USING (term) CROSS JOIN s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM w)
SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 50"""))  # fmt: skip
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = v.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(_words("text")).alias("term"))
    n_words = F.regexp_count(F.lower("text"), F.lit(_TEXT_WORDS))
    found = sr.bm25(sr.term_table(docs, "doc_id", _words("text"), asked), sr.corpus_statistics(docs, n_words), asked, "doc_id")
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _index_search(spark: SparkSession, sf_dir: str, **analysis) -> ti.Search:
    """An index of all documents, written, and the search for every benchmark text in it."""
    path = workspace.new_path(spark, "index")
    ti.write_index(v.table(spark, sf_dir, "documents"), path, "doc_id", "text", order=[F.col("lang"), F.col("doc_id")], **analysis)
    return ti.Search(spark, path, ti.query_terms(v.table(spark, sf_dir, "benchmark"), "item_id", "text", **analysis))


def _best_documents(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


_INDEX_WORDS = r"list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+(?:[''’][\p{L}\p{N}_]+)*'), lambda w: regexp_replace(w, '[''’]s$', ''))"


@query("w12_index_search", f"""
WITH d AS (SELECT doc_id, {_INDEX_WORDS} AS words FROM documents),
l AS (SELECT doc_id, words, len(words) AS dl, greatest(length(bin(greatest(len(words) - 24, 0))) - 4, 0)::INT AS s FROM d),
c AS (SELECT doc_id, words, dl, CASE WHEN dl < 24 THEN dl ELSE 24 + (((dl - 24) >> s) << s) END AS coded FROM l),
st AS (SELECT count(*) AS n, avg(dl) AS mean FROM c),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_INDEX_WORDS}) AS term FROM benchmark) GROUP BY 1, 2),
e AS (SELECT doc_id, coded, unnest(words) AS term FROM c),
t AS (SELECT doc_id, coded, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
w AS (SELECT q.query_id, t.doc_id, sum(q.times * ln(1 + (st.n - f.df + 0.5) / (f.df + 0.5)) * t.tf / (t.tf + 0.9 * (1 - 0.4 + 0.4 * t.coded / st.mean))) AS score FROM t JOIN f USING (term) JOIN q USING (term) CROSS JOIN st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM w)
SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 50""")  # fmt: skip
def w12_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in the stored index, with words as they are; SQL has no stemmer."""
    return _best_documents(_index_search(spark, sf_dir, stems=False, stop=()).top())


@query("w12_index_search_english")
def w12_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As w12_index_search with stems and stop words; tested against a plain version."""
    return _best_documents(_index_search(spark, sf_dir).top())


@query("w12_index_read_share")
def w12_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What w12_index_search_english reads of the asked terms' postings; the tests hold its results against exhaustive runs."""
    return _index_search(spark, sf_dir).read_share()


@query("w26_corpus_by_category", "SELECT category, p_brand AS key, text FROM (SELECT p_type AS category, p_brand, lower(p_name || ' ' || p_type) AS text, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1")
def w26(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sr.corpus_by_category(v.table(spark, sf_dir, "part"), "p_type", "p_brand", "p_partkey", ["p_name", "p_type"])
    return rows.withColumnRenamed("p_brand", "key")


_STOP = ", ".join(f"'{w}'" for w in sr.STOP_WORDS)


def _tfidf_sql(gram: str) -> str:
    return f"""
WITH k AS (SELECT doc_id, lang, list_filter(words, lambda w: NOT list_contains([{_STOP}], w) AND NOT regexp_full_match(w, '[0-9]|[1-9][0-9]{{1,2}}')) AS words FROM doc_words),
g AS (SELECT doc_id, lang, {gram} AS terms FROM k),
e AS (SELECT doc_id, lang, unnest(terms) AS term FROM g),
t AS (SELECT lang, doc_id, term, count(*) AS tf FROM e GROUP BY 1, 2, 3),
f AS (SELECT lang, term, count(*) AS df, sum(tf) AS total FROM t GROUP BY 1, 2),
h AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY total DESC, term) AS rn FROM f),
n AS (SELECT lang, count(*) AS n FROM doc_words GROUP BY 1),
i AS (SELECT lang, term, ln((1.0::DOUBLE + n) / (1 + df)) + 1 AS idf FROM h JOIN n USING (lang) WHERE rn <= 1000),
w AS (SELECT t.lang, t.doc_id, t.term, t.tf * i.idf AS w FROM t JOIN i USING (lang, term)),
x AS (SELECT lang, doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY lang, doc_id)) AS score FROM w)
"""


_ONE, _TWO = "words", "CASE WHEN len(words) >= 2 THEN list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) ELSE [] END"


def _tfidf(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    docs = v.table(spark, sf_dir, "documents").select("doc_id", "lang", "text").repartition("lang", "doc_id")  # texts move, not their postings
    docs = docs.withColumn("words", sr.without_stop_words(_words("text")))
    return sr.tfidf(docs, "lang", "doc_id", sr.ngrams(F.col("words"), n))


for _n, _gram in ((1, _ONE), (2, _TWO)):

    def _scores(spark: SparkSession, sf_dir: str, n: int = _n) -> DataFrame:
        return _tfidf(spark, sf_dir, n).withColumn("score", F.round("score", 6))

    def _top(spark: SparkSession, sf_dir: str, n: int = _n) -> DataFrame:
        totals = v.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
        return sr.top_attributes(_tfidf(spark, sf_dir, n), totals, "lang", "doc_id").select("lang", "term", F.round("share", 6).alias("share"))

    query(f"w27_tfidf_{_n}gram", v.with_views("doc_words", _tfidf_sql(_gram) + "SELECT lang, doc_id, term, round(score, 6) AS score FROM x"))(_scores)
    query(f"w28_top_attributes_{_n}gram", v.with_views("doc_words", _tfidf_sql(_gram) + ", b AS (SELECT lang, term, row_number() OVER (PARTITION BY lang, doc_id ORDER BY round(score, 9) DESC, term) AS rn FROM x) SELECT lang, term, round(count(*) / any_value(n.n), 6) AS share FROM b JOIN n USING (lang) WHERE rn <= 5 GROUP BY 1, 2"))(_top)


@query("w30_page_text", r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<!doctype[^>]*>|<head\b.*?</head>|<script\b.*?</script>|<style\b.*?</style>|<title\b.*?</title>', '<>', 'g') AS t FROM pages),
b AS (SELECT page_id, list_filter(list_transform(string_split(regexp_replace(t, '(?s)<[^>]*>', chr(1), 'g'), chr(1)), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> '') AS parts FROM a)
SELECT page_id, array_to_string(parts, ' [SEP] ') AS text FROM b""")  # fmt: skip
def w30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "pages").select("page_id", pg.visible_text(F.col("html")).alias("text"))


@query("w31_page_text_rich")
def w31(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needs the element of each text node; tested on written pages."""
    rows = v.table(spark, sf_dir, "pages")
    return rows.select("page_id", pg.rich_text(F.col("html"), F.col("url"), F.array().cast("array<string>")).alias("observation"))


@query("w32_links", r"SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '(?is)<a\b[^>]*>(.*?)</a>', 1), lambda t: lower(trim(t))), '|') AS links FROM pages")
def w32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "pages").select("page_id", F.array_join(pg.links(F.col("html")), "|").alias("links"))


@query("w32_clickables")
def w32_clickables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buttons, item links and options by a parser; tested on written pages."""
    rows = v.table(spark, sf_dir, "pages").select("page_id", pg.clickables(F.col("html")).alias("c"))
    return rows.select("page_id", "c.has_search_bar", F.array_join("c.clickables", "|").alias("clickables"))


@query("w38_results_scrape", r"""
WITH p AS (SELECT page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)[1:10] AS items FROM pages),
e AS (SELECT page_id, unnest(items) AS t, generate_subscripts(items, 1) - 1 AS pos FROM p)
SELECT page_id, pos::INT AS pos, CASE WHEN regexp_matches(t, 'href="/([^"]*)"') THEN trim(regexp_extract(t, 'href="/([^"]*)"', 1)) ELSE 'N/A' END AS asin,
  CASE WHEN regexp_matches(t, '>([^<]*)</a>') THEN trim(regexp_extract(t, '>([^<]*)</a>', 1)) ELSE 'N/A' END AS title, 'N/A' AS price FROM e""")  # fmt: skip
def w38(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = pg.listing(F.col("html"), r"(?s)<li>(.*?)</li>", {"asin": r'href="/([^"]*)"', "title": r">([^<]*)</a>", "price": r"class=.price.>([^<]*)<"})
    return v.table(spark, sf_dir, "pages").select("page_id", F.posexplode(records).alias("pos", "r")).select("page_id", "pos", "r.*")


@query("w39_item_scrape", r"""
SELECT page_id, CASE WHEN regexp_matches(html, '(?s)<h1>(.*?)</h1>') THEN trim(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '(?s)<[^>]*>', '', 'g')) ELSE 'N/A' END AS title, 'N/A' AS price,
  CASE WHEN regexp_matches(html, '(?s)<p>(.*?)</p>') THEN trim(regexp_replace(regexp_extract(html, '(?s)<p>(.*?)</p>', 1), '(?s)<[^>]*>', '', 'g')) ELSE 'N/A' END AS description FROM pages""")  # fmt: skip
def w39(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = pg.item(F.col("html"), {"title": r"(?s)<h1>(.*?)</h1>", "price": r"class=.price.>([^<]*)<", "description": r"(?s)<p>(.*?)</p>"})
    return v.table(spark, sf_dir, "pages").withColumn("r", record).select("page_id", "r.*")


def _marked(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _site() -> Column:
    return F.element_at(F.array(F.lit("shop"), F.lit("market"), F.lit("auction")), (F.col("page") % 3 + 1).cast("int"))


@query("w38_site_results", v.with_views("products", """
WITH n AS (SELECT *, ord // 12 AS page, ord % 12 AS place, (['shop', 'market', 'auction'])[(ord // 12) % 3 + 1] AS site FROM products)
SELECT page, site, (row_number() OVER (PARTITION BY page ORDER BY place) - 1)::INT AS pos, asin, name AS title, coalesce(retail, 0) AS low, CASE WHEN site <> 'market' AND ord % 2 = 0 THEN retail + 10 END AS high
FROM n WHERE place < 10 AND NOT (site = 'auction' AND place = 0)"""))  # fmt: skip
def w38_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results pages of three sites, twelve products a page in that site's markup, read by its selectors."""
    rows = v.products(spark, sf_dir).withColumns({"page": F.floor(F.col("ord") / 12), "place": F.col("ord") % 12})
    asin, name, low, high = F.col("asin"), F.col("name"), F.col("retail"), F.col("retail") + 10
    price = F.when(F.col("ord") % 2 == 0, _marked("$", low, " to $", high)).otherwise(_marked("$", low))
    shop = F.when(F.col("ord") % 3 == 0, _marked('<div class="list-group-item x"><div><h5 class="product-price">', price, "</h5></div><h4 class=product-title>\n", name, '\n</h4><a class="product-link">', asin, "</a></div>")).otherwise(
        _marked("<div class='list-group-item'><section><a class='a product-link'>", asin, '</a><div><h4 class="product-title"><b>', name, '</b></h4><h5 class="product-price"> ', price, " </h5></div></section></div>")
    )
    market = _marked('<div data-asin="', asin, '" data-component-type="s-search-result"><h2 class="a-size-mini"><a><span>', name, '</span></a></h2><div class="s-price-instructions-style"><span class="a-offscreen">$', low, "</span></div></div>")
    title = F.when(F.col("place") == 0, "Shop on eBay").otherwise(name)
    auction = _marked('<li class="clearfix s-item__wrapper"><span class="s-item__price">', price, '</span><a class="s-item__link" href="https://site/itm/', asin, '?x=1"><h3 class="s-item__title">', title, "</h3></a></li>")
    marked = rows.withColumn("site", _site()).withColumn("part", F.when(F.col("site") == "shop", shop).when(F.col("site") == "market", market).otherwise(auction))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x["part"])
    pages = marked.groupBy("page", "site").agg(F.concat(F.lit("<html><body><nav>menu</nav><ul>"), F.array_join(parts, "\n"), F.lit("</ul></body></html>")).alias("html"))
    read = dom.read_results(pages).select("page", "site", F.posexplode("records").alias("pos", "r"))
    return read.select("page", "site", "pos", "r.asin", "r.title", "r.low", "r.high")


@query("w39_site_items", v.with_views("products", """
SELECT asin, (['shop', 'market', 'auction'])[ord % 3 + 1] AS site, name AS title, retail AS low, CASE WHEN ord % 3 = 1 THEN 'N/A' ELSE '4.' || (size % 10) END AS rating, CASE WHEN ord % 3 = 2 THEN 'N/A' ELSE category END AS description,
  'color=' || attributes[1] || ',' || attributes[2] || ';size=' || size AS options FROM products"""))  # fmt: skip
def w39_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item pages of three sites: title, price, rating, description and options by selectors."""
    rows = v.products(spark, sf_dir).withColumn("page", F.col("ord"))
    name, low, size, first, second, told, rating = F.col("name"), F.col("retail"), F.col("size"), F.col("attributes")[0], F.col("attributes")[1], F.col("category"), _marked("4.", F.col("size") % 10)
    shop = _marked("<h2>", name, "</h2><img src=/a.png><h4>Price: $", low, "</h4><h4>Rating: ", rating, '</h4><div class="radio-toolbar"><input name="color"><label>', first, "</label><input name=color><label>", second, '</label></div><div class="y radio-toolbar"><label>', size, '</label><input name="size"></div><p class="product-info">\n', told, "</p>")
    group = lambda n, *values: _marked(f"<ul data-a-button-group='{{\"name\":\"{n}\"}}'>", *(_marked("<li><span> ", x, " </span>") for x in values), "</ul>")
    market = _marked('<div><div id="twister_feature_div">', group("color_name", first, second), group("twister_size", size), "</div></div><span id=productTitle> ", name, ' </span><span class="apexPriceToPay"><span class="a-offscreen">$', low, '</span></span><div id="productDescription_feature_div"><div id="productDescription"><p>', told, "</p></div></div>")
    choose = lambda n, *values: _marked(f'<select name="{n}:" class="msku-sel"><option>- Select -</option>', *(_marked("<option>", x) for x in values), "</select>")
    auction = _marked('<h1 class="x-item-title__mainTitle"><span>', name, "</span></h1>", choose("color", first, second), choose("size", size), '<div class="mainPrice">US $', low, '</div><span class="reviews-star-rating" title="', rating, ' out of 5"></span>')
    pages = rows.select("asin", _site().alias("site"), F.when(F.col("page") % 3 == 0, shop).when(F.col("page") % 3 == 1, market).otherwise(auction).alias("html"))
    options = F.array_join(F.transform("item.options", lambda o: F.concat(o["name"], F.lit("="), F.array_join(o["values"], ","))), ";")
    return dom.read_items(pages).select("asin", "site", "item.title", "item.low", "item.rating", "item.description", options.alias("options"))


@query("w44_semantic_top_k", """
WITH q AS (SELECT vec_id AS query_id, label, embedding FROM embeddings WHERE vec_id % 25 = 0),
s AS (SELECT q.query_id, e.vec_id AS item_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM q JOIN embeddings e USING (label) WHERE e.vec_id <> q.query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM s)
SELECT query_id, item_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 3""")  # fmt: skip
def w44(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"))
    items = rows.select(F.col("vec_id").alias("item_id"), "label", F.col("embedding").alias("e"))
    found = sr.semantic_top_k(asked, items, "label", 3)
    return found.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")
