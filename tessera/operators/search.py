"""Ranked text search: an inverted index as tables, BM25, TF-IDF by category, nearest vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import workspace
from . import score_groups as sg

K1, B = 0.9, 0.4
#: Vectors of a tile.
VECTORS = 16_384

#: A short list of English words that say nothing about a text; callers may give their own.
STOP_WORDS = tuple("a an and are as at be but by for from has have he her his i if in is it its my not of on or our she so that the their them they this to was we were will with you your".split())


def tokens(text: Column) -> Column:
    """Runs of two or more letters, digits or underscores, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\w\w+)"), F.lit(1))


def term_table(docs: DataFrame, key: str, words: Column, only: DataFrame | None = None) -> DataFrame:
    """The inverted index: (term, key, tf, dl). Counted map-side; ``dl`` is the document's length in words.

    With ``only``, a table of terms, other words go before anything is counted or moved.
    """
    rows = docs.select(key, words.alias("words")).select(key, F.size("words").alias("dl"), F.explode("words").alias("term"))
    if only is not None:
        rows = rows.join(only.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf"))


def corpus_statistics(docs: DataFrame, n_words: Column) -> DataFrame:
    """One row: the number of documents and their mean length, given each one's number of words."""
    return docs.select(n_words.alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def bm25(index: DataFrame, statistics: DataFrame, queries: DataFrame, key: str, k: int = 50, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, key, score, rank) of the k best documents of each query; ``queries`` has (query_id, term), distinct.

    Only postings of asked terms move, once each, to their document's group; a group scores all queries as matrix
    products and passes on each query's k best.
    """
    asked = queries.select("query_id", "term").distinct()
    terms = asked.select("term").distinct()
    index = workspace.save(index.join(terms, "term", "left_semi"), "asked-postings")
    n, mean = statistics.first()
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.select("term", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("w"))
    weights = sg.tiled(workspace.save(asked.join(idf, "term").select("query_id", "term", "w"), "weights"))
    groups = max(1, -(-n // sg.GROUP_DOCS))
    # a document's length is its words' number, so rows of one key that differ in it keep their own
    rows = index.select(F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("group"), "term", F.col(key).alias("key"), "tf", "dl")

    def found(table: pa.Table, tile: sg.Weights) -> pa.Table:
        keys = table["key"].combine_chunks().dictionary_encode(null_encoding="encode")
        order = pc.sort_indices(keys.dictionary, null_placement="at_start").to_numpy()
        doc = np.argsort(order)[keys.indices.to_numpy()]
        tf, dl = table["tf"].to_numpy(), table["dl"].to_numpy()
        query, at, score = [], [], []
        for start, scores in tile.scores(tile.column_of(table["term"]), doc, tf / (tf + k1 * (1 - b + b * dl / mean)), len(order)):
            for q, row in enumerate(scores):
                some = sg.best(row, k, 9)
                query.append(np.full(len(some), q))
                at.append(start + some)
                score.append(row[some])
        query, at, score = (np.concatenate(x) for x in (query, at, score))
        return pa.table([tile.queries.take(pa.array(query)), keys.dictionary.take(pa.array(order[at])), pa.array(score)], names=["query_id", key, "score"])

    schema = f"query_id {weights.schema['query_id'].dataType.simpleString()}, {key} {index.schema[key].dataType.simpleString()}, score double"
    scored = sg.in_groups(rows, index.sparkSession.range(groups).select(F.col("id").cast("int").alias("group")), weights, found, schema)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ngrams(words: Column, n: int) -> Column:
    """Consecutive n words, joined by a space: the array zipped with itself, shifted."""
    out = words
    for shift in range(1, n):
        count = F.greatest(F.size(words) - shift, F.lit(0))
        out = F.zip_with(F.slice(out, F.lit(1), count), F.slice(words, F.lit(shift + 1), count), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def without_stop_words(words: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words that are not in the list and not a number below 1000 written without leading zeros."""
    return F.filter(words, lambda w: ~w.isin(*stop) & ~w.rlike("^([0-9]|[1-9][0-9]{1,2})$"))


def corpus_by_category(products: DataFrame, category: str, key: str, order: str, fields: list[str]) -> DataFrame:
    """(category, key, text): the first row of each key in a category, its fields joined in lower case."""
    w = Window.partitionBy(category, key).orderBy(order)
    first = products.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return first.select(F.col(category).alias("category"), key, F.lower(F.concat_ws(" ", *fields)).alias("text"))


def tfidf(docs: DataFrame, category: str, key: str, terms: Column, max_features: int = 1000) -> DataFrame:
    """(category, key, term, score): tf times ln((1+N)/(1+df)) + 1, each document scaled to length 1.

    Per category only the ``max_features`` terms with most occurrences count, ties in term order. They are saved first, so that
    postings of other terms are left out before anything moves; ``docs`` dealt out by (category, key) are not dealt again.
    """
    rows = docs.select(category, key, F.explode(terms).alias("term"))
    tf = rows.groupBy(category, key, "term").agg(F.count(F.lit(1)).alias("tf"))
    stats = tf.groupBy(category, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    top = Window.partitionBy(category).orderBy(F.col("total").desc(), "term")
    stats = stats.withColumn("rn", F.row_number().over(top)).where(F.col("rn") <= max_features)
    n = docs.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    idf = workspace.save(stats.join(n, category).select(category, "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
    tf = rows.join(idf, [category, "term"]).groupBy(category, key, "term", "idf").agg(F.count(F.lit(1)).alias("tf"))
    weighted = tf.withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(category, key)))
    return weighted.select(category, key, "term", (F.col("w") / norm).alias("score"))


def top_attributes(scores: DataFrame, totals: DataFrame, category: str, key: str, k: int = 5) -> DataFrame:
    """(category, term, share, text): how many of a category's items have the term among their k best."""
    order = Window.partitionBy(category, key).orderBy(F.round("score", 9).desc(), "term")
    best = scores.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
    share = F.col("items") / F.col("total")
    counted = best.groupBy(category, "term").agg(F.count(F.lit(1)).alias("items")).join(totals.withColumnRenamed("n", "total"), category)
    return counted.select(category, "term", share.alias("share"), F.format_string("%s | %.4f", "term", share).alias("text"))


def parse_ranked_attribute(text: Column) -> Column:
    """struct(attribute, score, tags) of 'attribute | 0.1234 | tags'."""
    parts = F.transform(F.split(text, r"\|", -1), lambda p: F.trim(p))
    return F.struct(F.get(parts, F.lit(0)).alias("attribute"), F.get(parts, F.lit(1)).try_cast("double").alias("score"), F.get(parts, F.lit(2)).alias("tags"))


def semantic_top_k(queries: DataFrame, items: DataFrame, on: str, k: int) -> DataFrame:
    """(query_id, item_id, score, rank): each query's k best other items by cosine among those with the same ``on``.

    ``queries`` has query_id and q, ``items`` item_id and e; equal scores (to nine places) go in item order. Tiles of at most
    ``VECTORS`` queries meet tiles of as many items in one matrix product, and only each query's k best of a tile move on. Vectors that
    are null, hold a null or differ in length have no score and come last.
    """
    tiles = [max(1, -(-t.count() // VECTORS)) for t in (queries, items)]
    number = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    whole = lambda c: F.when(~F.exists(c, lambda x: x.isNull()), F.transform(c, lambda x: x.cast("double")))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(on, "query_id", whole("q").alias("vector"), number("query_id", tiles[0]).alias("a"), spread(tiles[1]).alias("b"))
    told = items.where("item_id is not null").select(on, "item_id", whole("e").alias("vector"), spread(tiles[0]).alias("a"), number("item_id", tiles[1]).alias("b"))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, score double"
    groups = [t.where(F.col(on).isNotNull()).groupBy(on, "a", "b") for t in (asked, told)]
    pairs = groups[0].cogroup(groups[1]).applyInArrow(lambda left, right: _best_of_tile(left, right, k), schema)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "item_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best_of_tile(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    right = right.sort_by("item_id")
    sides = [(np.array([-1 if n is None else n for n in pc.list_value_length(t["vector"]).to_pylist()], np.int64), t["vector"].combine_chunks()) for t in (left, right)]
    units = {}
    for width in set(sides[0][0]) & set(sides[1][0]) - {-1}:
        units[width] = []
        for sizes, vectors in sides:
            at = np.flatnonzero(sizes == width)
            m = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), width)
            with np.errstate(all="ignore"):
                units[width].append((at, m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]))
    own, other = left["query_id"].to_numpy(), right["item_id"].to_numpy()
    query, item, score = [], [], []
    for start in range(0, len(own) if len(other) else 0, 256):
        end = min(start + 256, len(own))
        found, known = np.zeros((end - start, len(other))), np.zeros((end - start, len(other)), bool)
        for (at, a), (to, b) in units.values():
            some = (at >= start) & (at < end)
            here = np.ix_(at[some] - start, to)
            with np.errstate(all="ignore"):
                found[here], known[here] = a[some] @ b.T, True
        # what has no number comes first, what has no score last
        place = np.where(known, np.where(np.isnan(found), 10.0, np.round(found, 9)), -10.0)
        place[own[start:end, None] == other[None, :]] = -np.inf
        least = np.partition(place, max(0, len(other) - k), axis=1)[:, max(0, len(other) - k)]
        for row in range(end - start):
            best = np.flatnonzero((place[row] >= least[row]) & (place[row] > -np.inf))
            best = best[np.argsort(-place[row, best], kind="stable")[:k]]
            query += [start + row] * len(best)
            item += best.tolist()
            score += np.where(known[row, best], found[row, best], None).tolist()
    return pa.table([left["query_id"].take(pa.array(query, pa.int64())), right["item_id"].take(pa.array(item, pa.int64())), pa.array(score, pa.float64(), from_pandas=False)], names=["query_id", "item_id", "score"])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
