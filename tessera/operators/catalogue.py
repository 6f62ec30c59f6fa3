"""Product catalogues: cleaning, prices, options, attributes, documents for indexing, goals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The columns of a raw product that are not kept.
DROPPED_COLUMNS = (
    "product_information", "brand", "brand_url", "list_price", "availability_quantity", "availability_status", "total_reviews",
    "total_answered_questions", "seller_id", "seller_name", "fulfilled_by_amazon", "fast_track_message", "aplus_present", "small_description_old",
)

# Colour names, in the order in which they are looked for.
COLORS = (
    "alabaster", "apricot", "aqua", "ash", "asphalt", "azure", "banana", "beige", "black", "blue", "blush", "bordeaux", "bronze", "brown", "burgundy",
    "camel", "camo", "caramel", "champagne", "charcoal", "cheetah", "chestnut", "chocolate", "christmas", "coffee", "cognac", "copper", "coral",
    "cranberry", "cream", "crystal", "dark", "denim", "eggplant", "elephant", "espresso", "fuchsia", "gold", "granite", "grape", "graphite", "grass",
    "gray", "green", "grey", "heather", "indigo", "ivory", "ivy", "khaki", "lavender", "lemon", "leopard", "light", "lilac", "lime", "magenta",
    "maroon", "mauve", "merlot", "midnight", "mint", "mocha", "multicolor", "mushroom", "mustard", "natural", "navy", "nude", "olive", "orange",
    "peach", "pewter", "pink", "plum", "purple", "rainbow", "red", "rose", "royal", "rust", "sand", "sapphire", "seashell", "silver", "skull",
    "slate", "steel", "stone", "stonewash", "sunflower", "tan", "taupe", "teal", "tiger", "turquoise", "violet", "walnut", "wheat", "white", "wine",
    "yellow",
)

# Size patterns, in the order in which they are tried.
SIZE_PATTERNS = (
    "xx-large", "3x-large", "4x-large", "5x-large", "x-large", "x-small", "medium", "large", "small", "queen", "twin", "full", "king", "one size", "pack",
    r"(.*)neck(.*)sleeve", r"(.*) women \| (.*) men", r"(.*)w x(.*)l", r"(.*)w by (.*)l", r"(.*)w x(.*)h", r"(.*)wide", r"(.*)x-wide", r"(.*)narrow",
    r"(.*)petite", r"(.*)inch", r"(.*)plus", r"(.*)mm", r"women(.*)", r"(.*)x(.*)", r"(.*)ft", r"(.*)feet", r"(.*)meter", r"(.*)yards", r"(.*)\*(.*)",
    r"(.*)\-(.*)", r'(\d+)"$', r"(\d+)f$", r"(\d+)m$", r"(\d+)cm$", r"(\d+)g$",
)


def scan(products: DataFrame, first: int | None = None) -> DataFrame:
    """Products in catalogue order; optionally only those at the first places, before any cleaning."""
    return products if first is None else products.where(F.col("ord") <= first)


def drop_columns(products: DataFrame) -> DataFrame:
    return products.drop(*DROPPED_COLUMNS)


def clean_ids(products: DataFrame) -> DataFrame:
    """Without ids that are 'nan' or longer than ten characters; of one id the first in catalogue order."""
    ok = products.where((F.col("asin") != "nan") & (F.length("asin") <= 10))
    return ok.withColumn("rn", F.row_number().over(Window.partitionBy("asin").orderBy("ord"))).where("rn = 1").drop("rn")


def prices(text: Column) -> Column:
    """struct(pricing, price): the one or two prices of a text like '$1.50 to $2'; 100 where there is none."""
    found = F.transform(F.slice(F.split(text, "[$]", -1), F.lit(2), F.greatest(F.size(F.split(text, "[$]", -1)) - 1, F.lit(0))), lambda p: F.regexp_replace(p, r"[^\d.]", "").cast("double"))
    pricing = F.when(text.isNull() | (text == ""), F.array(F.lit(100.0))).otherwise(F.slice(found, 1, 2))
    tag = F.concat(F.lit("$"), F.array_join(F.transform(pricing, lambda p: p.cast("string")), " to $"))
    return F.struct(pricing.alias("pricing"), tag.alias("price"))


def normalise_options(options: Column) -> Column:
    """Option names in lower case, values trimmed, '/' as ' | ', in lower case; null lists left out.

    ``options`` is map<string, array<struct<value, image>>>.
    """
    kept = F.map_filter(options, lambda k, x: x.isNotNull())
    entries = F.transform(F.map_entries(kept), lambda e: F.struct(F.lower(e["key"]).alias("key"), F.transform(e["value"], lambda o: F.lower(F.replace(F.trim(o["value"]), F.lit("/"), F.lit(" | ")))).alias("value")))
    return F.map_from_entries(entries)


def default_fields(products: DataFrame) -> DataFrame:
    """Attributes, rating, query and main image with their defaults; bullet points always a list."""
    return products.withColumns(
        {
            "bullet_points": F.when(F.col("bullet_points").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.col("bullet_points")),
            "attributes": F.coalesce("attributes", F.array(F.lit("DUMMY_ATTR"))),
            "rating": F.coalesce(F.col("rating").cast("string"), F.lit("N.A.")),
            "query": F.trim(F.lower("query")),
            "main_image": F.try_element_at("images", F.lit(1)),
        }
    )


def join_attributes(products: DataFrame, attributes: DataFrame, instructions: DataFrame) -> DataFrame:
    """Products with their mined attributes and human instructions, where they have any."""
    return products.join(attributes, "asin", "left").join(instructions, "asin", "left")


def reshape_reviews(reviews: Column) -> Column:
    """Review structs (stars, review) as (score, body), empty texts for missing ones."""
    return F.transform(reviews, lambda r: F.struct(F.coalesce(r["stars"].cast("string"), F.lit("")).alias("score"), F.coalesce(r["review"], F.lit("")).alias("body")))


def inverted_index(products: DataFrame, of: str = "attributes") -> DataFrame:
    """(attribute, asin), one row each; ordered lists are the caller's choice, as one attribute may be everywhere."""
    return products.select(F.explode(of).alias("attribute"), "asin").distinct()


def draw_price(pricing: Column, u: Column) -> Column:
    """No price: 100; one: itself; two: between them by the draw ``u``."""
    low, high = F.try_element_at(pricing, F.lit(1)), F.try_element_at(pricing, F.lit(2))
    return F.when(low.isNull(), 100.0).when(high.isNull(), low).otherwise(low + (high - low) * u)


def index_document(title: Column, description: Column, bullet: Column, options: Column) -> Column:
    """The text that is indexed for a product; ``options`` is map<string, array<string>>, names in order."""
    texts = F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], ", ")))
    return F.lower(F.concat(title, F.lit(" "), description, F.lit(" "), bullet, F.lit(" "), F.array_join(texts, ", and ")))


def route_keywords(products: DataFrame, queries: DataFrame, most_random: int = 50) -> DataFrame:
    """(query_id, asin, ord) for queries of the forms <r>, <a> x, <c> x and <q> x.

    ``queries`` has query_id and keywords, an array of words. <c> looks at its second word only. Attribute,
    category and query searches are unlimited; <r> takes ``most_random`` products in hash order.
    """
    kind = F.col("keywords")[0]
    rest = F.trim(F.array_join(F.slice("keywords", F.lit(2), F.size("keywords")), " "))
    asked = queries.select("query_id", kind.alias("kind"), F.when(kind == "<c>", F.trim(F.col("keywords")[1])).otherwise(rest).alias("wanted"))
    flat = products.select("asin", "ord", "category", "query", "attributes")
    attribute = asked.where("kind = '<a>'").join(flat.select("asin", "ord", F.explode(F.array_distinct("attributes")).alias("wanted")), "wanted")
    category = asked.where("kind = '<c>'").join(flat.withColumnRenamed("category", "wanted"), "wanted")
    query = asked.where("kind = '<q>'").join(flat.withColumnRenamed("query", "wanted"), "wanted")
    order = [F.md5(F.concat_ws("#", "asin", F.lit("r"))), F.col("asin")]
    drawn = flat.orderBy(*order).limit(most_random).select("asin", "ord", F.lit("<r>").alias("kind"))
    some = asked.where("kind = '<r>'").join(drawn, "kind")
    columns = ["query_id", "asin", "ord"]
    return attribute.select(*columns).unionByName(category.select(*columns)).unionByName(query.select(*columns)).unionByName(some.select(*columns))


def page(ranked: DataFrame, number: Column | int, rank: str = "rank", window: int = 10) -> DataFrame:
    """The rows of one page, from 1."""
    number = F.lit(number) if isinstance(number, int) else number
    return ranked.where((F.col(rank) > (number - 1) * window) & (F.col(rank) <= number * window))


def page_of(rows: DataFrame, order: list[Column], number: int, window: int = 10) -> DataFrame:
    """One page of rows in ``order``, with their rank from 1: every task keeps the best ``number * window``, no more are merged."""
    some = rows.orderBy(*order).offset((number - 1) * window).limit(window)
    return some.withColumn("rank", F.row_number().over(Window.orderBy(*order)) + (number - 1) * window)


def price_limit(price: Column, first: Column, second: Column) -> Column:
    """struct(upper, text): of the four multiples of ten from 10 to 990 next above the price, the larger of two drawn.

    ``first`` and ``second`` are draws in [0, 1). Fewer than two multiples: no limit.
    """
    least = F.greatest(F.floor(price / 10) + 1, F.lit(1))  # tens: the first multiple above the price
    n = F.coalesce(F.when(price < 990, F.least(F.lit(4), 100 - least)), F.lit(0))
    a = F.floor(first * n).cast("int")
    b = F.floor(second * (n - 1)).cast("int")
    b = F.when(b >= a, b + 1).otherwise(b)  # two different places
    upper = F.when(n >= 2, (least + F.greatest(a, b)) * F.lit(10.0)).otherwise(1_000_000.0)
    return F.struct(upper.alias("upper"), F.when(n >= 2, F.concat(F.lit(", and price lower than "), F.format_string("%.2f", upper), F.lit(" dollars"))).otherwise("").alias("text"))


def human_goals(products: DataFrame, limit: Column) -> DataFrame:
    """One goal per instruction with attributes; ``limit`` is the product's price_limit struct.

    ``products`` has instructions: array<struct<instruction, attributes, options>>.
    """
    rows = products.withColumn("limit", limit).select("asin", "category", "query", "name", "product_category", "limit", F.posexplode("instructions").alias("at", "i"))
    rows = rows.where(F.size("i.attributes") > 0)
    text = F.concat(F.regexp_replace("i.instruction", r"^\.+|\.+$", ""), F.col("limit.text"))
    return rows.select("asin", "category", "query", "name", "product_category", "at", text.alias("instruction_text"), F.col("i.attributes").alias("attributes"), F.col("limit.upper").alias("price_upper"), F.col("i.options").alias("goal_options"), F.lit(1.0).alias("weight"))


def option_combinations(options: Column) -> Column:
    """Every choice of one value per option, names in order, as arrays of 'name: value'; none gives one empty choice."""
    start = F.array(F.array().cast("array<string>"))
    return F.aggregate(
        F.array_sort(F.map_entries(options)),
        start,
        lambda made, e: F.flatten(F.transform(made, lambda c: F.transform(e["value"], lambda x: F.concat(c, F.array(F.concat(e["key"], F.lit(": "), x)))))),
    )


def synthetic_goals(products: DataFrame, limit: Column) -> DataFrame:
    """One goal per combination of option values; a goal's weight is the mean of 1 / (uses of the attribute in all goals).

    A product has as many goals as its options have combinations, so uses are counted without making the goals, and
    joined back: attributes are many, goals per attribute unbounded.
    """
    choices = option_combinations(F.col("options"))
    many = F.aggregate(F.map_values("options"), F.lit(1).cast("bigint"), lambda n, values: n * F.size(values))
    used = products.select(many.alias("many"), F.explode("attributes").alias("attribute")).groupBy("attribute").agg(F.sum("many").alias("uses"))
    each = products.select("asin", F.explode("attributes").alias("attribute")).join(used, "attribute")
    weights = each.groupBy("asin").agg(F.avg(1 / F.col("uses")).alias("weight"))
    rows = products.withColumn("limit", limit).withColumn("choice", F.explode(choices)).join(weights, "asin")
    text = F.concat("instruction_text", F.when(F.size("choice") > 0, F.concat(F.lit(" with "), F.array_join("choice", ", and "))).otherwise(""), F.col("limit.text"))
    return rows.select("asin", "choice", "attributes", text.alias("instruction_text"), F.col("limit.upper").alias("price_upper"), "weight")


def normalise_color(text: Column) -> Column:
    """The first colour name, in the list's order, that the text holds; the text itself if none."""
    return F.coalesce(F.get(F.filter(F.array(*map(F.lit, COLORS)), lambda c: F.contains(text, c)), F.lit(0)), text)


def color_group(text: Column) -> Column:
    """As normalise_color on lower case, 'not_matched' if none."""
    low = F.lower(text)
    return F.coalesce(F.get(F.filter(F.array(*map(F.lit, COLORS)), lambda c: F.contains(low, c)), F.lit(0)), F.lit("not_matched"))


def size_group(text: Column) -> Column:
    """The first size pattern that the text matches, else 'numeric_size' or 'not_matched'."""
    low = F.lower(text)
    out = None
    for pattern in SIZE_PATTERNS:
        out = F.when(low.rlike(pattern), pattern) if out is None else out.when(low.rlike(pattern), pattern)
    return out.when(low.rlike(r"^[0-9]*\.?[0-9]*$") & low.rlike("[0-9]"), "numeric_size").otherwise("not_matched")


def valid_actions(page_type: Column, n_products: Column, page_number: Column, titles: Column, option_values: Column) -> Column:
    """The clicks that a page allows, in order: results, item or sub page; null for any other."""
    click = lambda *names: F.array(*(F.lit(f"click[{n}]") for n in names))
    empty = F.array().cast("array<string>")
    results = F.concat(
        click("back to search"), F.when(n_products > 10, click("next >")).otherwise(empty), F.when(page_number > 1, click("< prev")).otherwise(empty),
        F.transform(titles, lambda t: F.concat(F.lit("click[item - "), t, F.lit("]"))),
    )
    item = F.concat(click("back to search", "< prev", "description", "features", "buy now"), F.transform(option_values, lambda o: F.concat(F.lit("click["), o, F.lit("]"))))
    return F.when(page_type == "results", results).when(page_type == "item_page", item).when(page_type == "sub_page", click("back to search", "< prev"))


def clean_instruction(text: Column) -> Column:
    """Lower case, without quotation marks, cut before the price limit."""
    return F.substring_index(F.trim(F.regexp_replace(F.lower(text), "[\"']", "")), ", and price lower than", 1)
