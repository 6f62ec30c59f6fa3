"""Queries over the product catalogue and its goals (W)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue as ct
from ..operators import fuzzy as fz
from ..operators import goals as gl
from ..operators.numbering import numbered
from ..sources import products as pr
from ..sources import records, workspace
from ..sources import views as v
from .reference import REGISTRY

query = REGISTRY.query


def _sql(body: str, more: str = "") -> str:
    return v.with_views(f"products {more}".strip(), body)


@query("w01_product_scan", _sql("SELECT ord, asin FROM products WHERE ord <= 100"))
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.scan(v.products(spark, sf_dir), 100).select("ord", "asin")


@query("w02_column_drop", _sql("SELECT asin, name, retail FROM products"))
def w02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.products(spark, sf_dir).select("asin", "name", "retail", F.col("query").alias("brand"), F.col("size").alias("list_price"), F.lit("x").alias("seller_id"))
    return ct.drop_columns(rows)


_RAW = "r AS (SELECT ord, CASE WHEN ord % 50 = 0 THEN 'nan' WHEN ord % 51 = 0 THEN '12345678901' ELSE CAST(ord // 2 AS VARCHAR) END AS asin, name FROM products)"


@query("w03_filter_dedup", _sql(f"WITH {_RAW} SELECT asin, ord, name FROM (SELECT *, row_number() OVER (PARTITION BY asin ORDER BY ord) AS rn FROM r WHERE asin <> 'nan' AND length(asin) <= 10) WHERE rn = 1"))
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    asin = F.when(F.col("ord") % 50 == 0, "nan").when(F.col("ord") % 51 == 0, "12345678901").otherwise(F.floor(F.col("ord") / 2).cast("string"))
    return ct.clean_ids(v.products(spark, sf_dir).withColumn("asin", asin)).select("asin", "ord", "name")


_PRICES = "CASE WHEN pricing IS NULL THEN [100.0::DOUBLE] ELSE list_transform(string_split(pricing, '$')[2:], lambda p: regexp_replace(p, '[^0-9.]', '', 'g')::DOUBLE)[1:2] END"
v.SQL["priced"] = f"SELECT *, {_PRICES} AS prices FROM products"


@query("w04_price_parse", _sql("SELECT asin, prices[1] AS low, prices[2] AS high, len(prices)::INT AS n FROM priced", "priced"))
def w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ct.prices(F.col("pricing"))["pricing"]
    return v.products(spark, sf_dir).select("asin", F.get(p, F.lit(0)).alias("low"), F.get(p, F.lit(1)).alias("high"), F.size(p).alias("n"))


def _options() -> Column:
    """Raw options: a size, a list of words with a slash, and a null list."""
    value = lambda c: F.struct(c.alias("value"), F.lit(None).cast("string").alias("image"))
    return F.create_map(F.lit("Size"), F.array(value(F.col("size").cast("string"))), F.lit("COLOR"), F.array(value(F.concat(F.lit(" "), F.col("attributes")[0], F.lit("/"), F.upper(F.col("attributes")[1])))), F.lit("empty"), F.lit(None).cast("array<struct<value:string,image:string>>"))


@query("w05_option_normalise", _sql("SELECT asin, CAST(size AS VARCHAR) AS size, attributes[1] || ' | ' || attributes[2] AS color, 2 AS n FROM products"))
def w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ct.normalise_options(_options())
    return v.products(spark, sf_dir).select("asin", F.element_at(o, "size")[0].alias("size"), F.element_at(o, "color")[0].alias("color"), F.size(o).alias("n"))


def _product_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue written as files of JSON arrays whose fields change their types, and read again."""
    js = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    name, category, size = js(F.col("name")), js(F.col("category")), F.col("size").cast("string")
    color = F.concat(F.lit('[{"value":'), js(F.upper(F.col("attributes")[0])), F.lit(',"image":"c.jpg"}]'))
    form = lambda n, *texts: F.get(F.array(*texts), (F.col("ord") % n).cast("int"))
    described = form(5, name, F.concat(F.lit("["), name, F.lit(","), category, F.lit("]")), F.lit("null"), F.lit(None).cast("string"), size)
    chosen = form(
        6,
        F.concat(F.lit('{"Size":[{"value":" '), size, F.lit('/x ","image":null}],"COLOR":'), color, F.lit("}")),
        F.concat(F.lit('{"Size":"odd","color":'), color, F.lit("}")),
        F.concat(F.lit('{"Size":null,"color":'), color, F.lit("}")),
        F.lit(None).cast("string"),
        F.concat(F.lit('{"size":[{"image":"only"},{"value":'), size, F.lit('}],"Color":'), color, F.lit(',"SIZE":[{"value":"late"}]}')),
        F.lit("[]"),
    )
    field = lambda key, text: F.coalesce(F.concat(F.lit(f',"{key}":'), text), F.lit(""))
    element = F.concat(F.lit('{"asin":'), js(F.col("asin")), F.lit(',"name":'), name, field("small_description", described), field("customization_options", chosen), field("pricing", js(F.col("pricing"))), F.lit("}"))
    path = workspace.new_path(spark, "products")
    records.write_element_arrays(v.products(spark, sf_dir).select("ord", element.alias("json")), path, ["ord"], "json")
    return pr.read_products(spark, f"{path}/*")


_FILE_COLOR = "upper(attributes[1])"


@query("w01_product_file", _sql("SELECT asin, name, coalesce(pricing, 'none') AS pricing FROM products WHERE ord <= 100"))
def w01_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(_product_files(spark, sf_dir), [F.length("asin"), F.col("asin")], "ord")
    return ct.scan(rows, 100).select("asin", "name", F.coalesce("pricing", F.lit("none")).alias("pricing"))


@query("w05_option_forms", _sql(f"""
SELECT asin, CASE ord % 6 WHEN 0 THEN 'size=' || size || ' | x;color=' || lower({_FILE_COLOR}) WHEN 1 THEN 'color=' || lower({_FILE_COLOR}) WHEN 2 THEN 'color=' || lower({_FILE_COLOR})
  WHEN 4 THEN 'size=late;color=' || lower({_FILE_COLOR}) ELSE '' END AS options,
  CASE WHEN ord % 6 IN (0, 1, 2, 4) THEN 'c.jpg' END AS color_image FROM products"""))  # fmt: skip
def w05_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _product_files(spark, sf_dir)
    text = F.array_join(F.transform(F.map_entries("options"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    image = F.try_element_at("option_to_image", F.try_element_at(F.try_element_at("options", F.lit("color")), F.lit(1)))
    return rows.select("asin", text.alias("options"), image.alias("color_image"))


@query("w06_bullet_forms", _sql("SELECT asin, CASE ord % 5 WHEN 0 THEN name WHEN 1 THEN name || '|' || category WHEN 4 THEN CAST(size AS VARCHAR) ELSE 'none' END AS bullets, CASE WHEN ord % 5 = 1 THEN 2 ELSE 1 END AS n FROM products"))
def w06_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _product_files(spark, sf_dir).select("asin", F.array_join("bullet_points", "|", "none").alias("bullets"), F.size("bullet_points").alias("n"))


@query("w06_field_defaults", _sql("SELECT asin, lower(trim(query)) AS query, CASE WHEN ord % 4 = 0 THEN 'DUMMY_ATTR' ELSE array_to_string(attributes, ',') END AS attributes, CASE WHEN ord % 5 = 0 THEN 'N.A.' ELSE CAST(size AS VARCHAR) END AS rating, CASE WHEN ord % 6 <> 0 THEN 'a.jpg' END AS main_image FROM products"))
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.products(spark, sf_dir).withColumns(
        {
            "attributes": F.when(F.col("ord") % 4 != 0, F.col("attributes")),
            "rating": F.when(F.col("ord") % 5 != 0, F.col("size")),
            "bullet_points": F.when(F.col("ord") % 2 == 0, F.array("name")),
            "images": F.when(F.col("ord") % 6 != 0, F.array(F.lit("a.jpg"), F.lit("b.jpg"))).otherwise(F.array().cast("array<string>")),
            "query": F.concat(F.lit(" "), "query"),
        }
    )
    return ct.default_fields(rows).select("asin", "query", F.array_join("attributes", ",").alias("attributes"), "rating", "main_image")


@query("w07_attribute_join", _sql("SELECT asin, CASE WHEN ord % 2 = 0 THEN array_to_string(attributes, ',') END AS mined, CASE WHEN ord % 3 = 0 THEN 'buy ' || name END AS instruction FROM products"))
def w07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.products(spark, sf_dir)
    mined = rows.where("ord % 2 = 0").select("asin", F.array_join("attributes", ",").alias("mined"))
    told = rows.where("ord % 3 = 0").select("asin", F.concat(F.lit("buy "), "name").alias("instruction"))
    return ct.join_attributes(rows.select("asin"), mined, told)


@query("w08_review_reshape", _sql("SELECT asin, CASE WHEN ord % 2 = 0 THEN CAST(size AS VARCHAR) ELSE '' END AS score, CASE WHEN ord % 3 = 0 THEN name ELSE '' END AS body FROM products"))
def w08(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(F.struct(F.when(F.col("ord") % 2 == 0, F.col("size")).alias("stars"), F.when(F.col("ord") % 3 == 0, F.col("name")).alias("review")))
    return v.products(spark, sf_dir).withColumn("r", ct.reshape_reviews(raw)[0]).select("asin", "r.score", "r.body")


@query("w09_inverted_index", _sql("SELECT DISTINCT unnest(attributes) AS attribute, asin FROM products"))
def w09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.inverted_index(v.products(spark, sf_dir))


@query("w10_price_draw", _sql(f"SELECT asin, round(CASE WHEN len(prices) = 1 THEN prices[1] ELSE prices[1] + (prices[2] - prices[1]) * {v.draw_sql('asin', 10)} END, 6) AS price FROM priced", "priced"))
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.products(spark, sf_dir).select("asin", F.round(ct.draw_price(ct.prices(F.col("pricing"))["pricing"], v.draw(F.col("asin"), 10)), 6).alias("price"))


@query("w11_index_documents", _sql("SELECT asin AS id, lower(name || ' ' || category || ' ' || query || ' color: ' || attributes[1] || ', ' || attributes[2] || ', and size: ' || CAST(size AS VARCHAR)) AS contents FROM products"))
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.create_map(F.lit("size"), F.array(F.col("size").cast("string")), F.lit("color"), F.col("attributes"))
    return v.products(spark, sf_dir).select(F.col("asin").alias("id"), ct.index_document(F.col("name"), F.col("category"), F.col("query"), options).alias("contents"))


@query("w13_keyword_router", _sql("""
SELECT 1 AS query_id, asin, ord FROM products WHERE list_contains(attributes, 'blue')
UNION ALL SELECT 2, asin, ord FROM products WHERE category = (SELECT min(category) FROM products WHERE category NOT LIKE '% %')
UNION ALL SELECT 3, asin, ord FROM products WHERE query = 'Brand#11'
UNION ALL SELECT 4, asin, ord FROM (SELECT asin, ord FROM products ORDER BY md5(asin || '#r'), asin LIMIT 50)"""))  # fmt: skip
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.products(spark, sf_dir)
    words = lambda i, *w: F.struct(F.lit(i).alias("query_id"), F.array(*w).alias("keywords"))
    category = rows.where("category not like '% %'").agg(F.min("category").alias("c"))
    asked = category.select(F.explode(F.array(words(1, F.lit("<a>"), F.lit("blue")), words(2, F.lit("<c>"), F.coalesce("c", F.lit(""))), words(3, F.lit("<q>"), F.lit("Brand#11")), words(4, F.lit("<r>"), F.lit("")))).alias("q")).select("q.*")
    return ct.route_keywords(rows, asked)


@query("w14_pagination", _sql("SELECT asin, rank FROM (SELECT asin, row_number() OVER (ORDER BY retail DESC, ord)::INT AS rank FROM products) WHERE rank BETWEEN 11 AND 20"))
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.page_of(v.products(spark, sf_dir), [F.col("retail").desc(), F.col("ord")], 2).select("asin", "rank")


_LIMIT = f"""
a AS (SELECT *, list_filter(list_transform(range(1, 100), lambda i: i * 10.0::DOUBLE), lambda p: p > prices[1])[1:4] AS above, {v.draw_sql('asin', 17)} AS u1, {v.draw_sql('asin', 18)} AS u2 FROM priced),
b AS (SELECT *, floor(u1 * len(above))::INT AS i1, floor(u2 * (len(above) - 1))::INT AS i0 FROM a),
c AS (SELECT *, CASE WHEN len(above) >= 2 THEN above[greatest(i1, CASE WHEN i0 >= i1 THEN i0 + 1 ELSE i0 END) + 1] ELSE 1000000.0 END AS upper FROM b),
l AS (SELECT *, CASE WHEN len(above) >= 2 THEN printf(', and price lower than %.2f dollars', upper) ELSE '' END AS limit_text FROM c)"""


def _limit() -> Column:
    # catalogue prices run from 900 up; a tenth is what the limits are drawn for in W17 and W18
    return ct.price_limit(ct.prices(F.col("pricing"))["pricing"][0], v.draw(F.col("asin"), 17), v.draw(F.col("asin"), 18))


@query("w17_human_goals", _sql(f"WITH {_LIMIT.strip()} SELECT asin, 'find a ' || name || limit_text AS instruction_text, upper AS price_upper, 1.0::DOUBLE AS weight FROM l WHERE ord % 3 <> 0", "priced"))
def w17(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.array(F.struct(F.concat(F.lit("find a "), "name", F.lit(".")).alias("instruction"), F.when(F.col("ord") % 3 != 0, F.col("attributes")).otherwise(F.array().cast("array<string>")).alias("attributes"), F.array(F.col("size").cast("string")).alias("options")))
    rows = v.products(spark, sf_dir).withColumn("instructions", told)
    return ct.human_goals(rows, _limit()).select("asin", "instruction_text", "price_upper", "weight")


@query("w18_synthetic_goals", _sql(f"""
WITH {_LIMIT.strip()},
g AS (SELECT asin, attributes, 'get a ' || name || ' with color: ' || col || ', and size: ' || CAST(size AS VARCHAR) || limit_text AS instruction_text, upper AS price_upper FROM (SELECT *, unnest(attributes) AS col FROM l)),
u AS (SELECT attribute, count(*) AS uses FROM (SELECT unnest(attributes) AS attribute FROM g) GROUP BY 1),
w AS (SELECT asin, avg(1.0 / uses) AS weight FROM (SELECT asin, unnest(attributes) AS attribute FROM products) JOIN u USING (attribute) GROUP BY 1)
SELECT g.asin, g.instruction_text, g.price_upper, round(w.weight, 9) AS weight FROM g JOIN w USING (asin)""", "priced"))  # fmt: skip
def w18(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.create_map(F.lit("size"), F.array(F.col("size").cast("string")), F.lit("color"), F.col("attributes"))
    rows = v.products(spark, sf_dir).withColumns({"options": options, "instruction_text": F.concat(F.lit("get a "), "name")})
    return ct.synthetic_goals(rows, _limit()).select("asin", "instruction_text", "price_upper", F.round("weight", 9).alias("weight"))


_TYPE = """
t AS (SELECT *, goal_query = bought_query AS query_match, len(list_intersect(list_transform(string_split(goal_product_category, '›'), lambda x: trim(x)), list_transform(string_split(bought_product_category, '›'), lambda x: trim(x)))) >= 2 AS category_match,
  len(list_intersect(goal_attributes, bought_attributes)) / len(goal_attributes) AS title_score FROM goal_purchases),
y AS (SELECT *, CASE WHEN title_score = 0 THEN 0.0 WHEN title_score < 0.1 THEN 0.1 WHEN NOT (query_match OR category_match OR title_score > 0.2) THEN 0.5 ELSE 1.0 END AS r_type,
  len(list_filter(goal_attributes, lambda g: contains(lower(bought_name), g))) AS att_hits, (goal_size = bought_size)::INT AS opt_hits FROM t)"""


def _type(rows: DataFrame) -> DataFrame:
    c = lambda n: (F.col(f"bought_{n}"), F.col(f"goal_{n}"))
    # the words of a part's name stand for its nouns
    return rows.withColumn("type", gl.type_reward(*c("query"), *c("product_category"), *c("attributes")))


@query("w19_type_reward", _sql(f"WITH {_TYPE.strip()} SELECT l_orderkey, r_type::DOUBLE AS r_type, query_match, category_match, title_score::DOUBLE AS title_score FROM y", "goal_purchases"))
def w19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _type(v.goal_purchases(spark, sf_dir)).select("l_orderkey", "type.*")


@query("w20_attribute_reward_substring", _sql(f"WITH {_TYPE.strip()} SELECT l_orderkey, att_hits::INT AS n_hits FROM y", "goal_purchases"))
def w20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.goal_purchases(spark, sf_dir).select("l_orderkey", gl.substring_attribute_hits(F.col("goal_attributes"), F.col("bought_name")).alias("n_hits"))


def _scored_pairs(pairs: str) -> str:
    """Tables that score the distinct pairs (a, b) of the table ``pairs`` as sets of words; the last is ``scored`` (a, b, score)."""
    tokens = lambda t: f"list_sort(list_distinct(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+')))"
    lcs = """list_max(list_reduce(string_split(wx, ''), lambda acc, c: list_transform(range(1, len(wy) + 2), lambda j:
      list_max(list_transform(range(1, j + 1), lambda i: CASE WHEN i = 1 THEN 0 ELSE greatest(acc[i], acc[i - 1] + (wy[i - 1] = c)::INT) END))), list_transform(range(0, len(wy) + 1), lambda i: 0)))"""
    return f"""
z1 AS (SELECT a, b, {tokens('a')} AS x, {tokens('b')} AS y FROM (SELECT DISTINCT a, b FROM {pairs} WHERE a IS NOT NULL AND b IS NOT NULL)),
z2 AS (SELECT *, list_filter(x, lambda t: list_contains(y, t)) AS s FROM z1),
z3 AS (SELECT *, array_to_string(s, ' ') AS head, array_to_string(s || list_filter(x, lambda t: NOT list_contains(y, t)), ' ') AS wx, array_to_string(s || list_filter(y, lambda t: NOT list_contains(x, t)), ' ') AS wy FROM z2),
z4 AS (SELECT a, b, head, wx, wy, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 WHEN len(s) > 0 AND (len(s) = len(x) OR len(s) = len(y)) THEN 100.0 END::DOUBLE AS plain FROM z3),
z5 AS (SELECT a, b, greatest(200.0::DOUBLE * {lcs} / (len(wx) + len(wy)), 200.0::DOUBLE * len(head) / (len(head) + len(wx)), 200.0::DOUBLE * len(head) / (len(head) + len(wy))) AS score FROM z4 WHERE plain IS NULL),
scored AS (SELECT a, b, plain AS score FROM z4 WHERE plain IS NOT NULL UNION ALL SELECT a, b, round_even(score, 0) FROM z5)"""


_FUZZY_ATTRIBUTES = f"""
pa AS (SELECT l_orderkey, goal_attributes, bought_name, unnest(bought_attributes) AS a FROM goal_purchases),
pb AS (SELECT l_orderkey, bought_name, a, unnest(goal_attributes) AS b, generate_subscripts(goal_attributes, 1) AS nth FROM pa),
{_scored_pairs('pb').strip()},
ph AS (SELECT l_orderkey, nth, bool_or(score > 85 OR contains(lower(bought_name), b)) AS hit FROM pb JOIN scored USING (a, b) GROUP BY 1, 2),
attribute_hits AS (SELECT l_orderkey, count_if(hit)::BIGINT AS n_hits, count(*)::INT AS n_goal FROM ph GROUP BY 1)"""


@query("w20_attribute_reward_fuzzy", _sql(f"WITH {_FUZZY_ATTRIBUTES.strip()} SELECT * FROM attribute_hits", "goal_purchases"))
def w20_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.goal_purchases(spark, sf_dir)
    return gl.attribute_reward(rows, ["l_orderkey"], "goal_attributes", "bought_attributes", ["bought_name"])


@query("w20_fuzzy_join", _sql(f"""
WITH pairs AS (SELECT a, b FROM (SELECT DISTINCT name AS a FROM products), (SELECT DISTINCT name || ' ' || lower(category) AS b FROM products)), {_scored_pairs('pairs').strip()}
SELECT a AS name, b AS described, score FROM scored WHERE score > 85"""))  # fmt: skip
def w20_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.products(spark, sf_dir)
    return fz.fuzzy_join(rows, rows.select(F.concat("name", F.lit(" "), F.lower("category")).alias("described")), "name", "described")


_COLORS = "[" + ", ".join(f"'{c}'" for c in ct.COLORS) + "]"
_OPTIONS = lambda who: f"[coalesce(list_filter({_COLORS}, lambda c: contains({who}_name, c))[1], {who}_name), CAST({who}_size AS VARCHAR)]"
_FUZZY_OPTIONS = f"""
oa AS (SELECT l_orderkey, {_OPTIONS('goal')} AS wanted, unnest({_OPTIONS('bought')}) AS a FROM goal_purchases),
ob AS (SELECT l_orderkey, a, unnest(wanted) AS b, generate_subscripts(wanted, 1) AS nth FROM oa),
{_scored_pairs('ob').strip().replace('z', 'y').replace('scored', 'scored_options')},
oh AS (SELECT l_orderkey, nth, bool_or(score > 85) AS hit FROM ob JOIN scored_options USING (a, b) GROUP BY 1, 2),
option_hits AS (SELECT l_orderkey, count_if(hit)::BIGINT AS n_hits, count_if(hit) / count(*) AS r_option FROM oh GROUP BY 1)"""


def _option_lists(rows: DataFrame) -> DataFrame:
    of = lambda who: F.array(ct.normalise_color(F.col(f"{who}_name")), F.col(f"{who}_size").cast("string"))
    return rows.withColumns({"goal_options": of("goal"), "bought_options": of("bought")})


@query("w21_option_reward", _sql(f"WITH {_FUZZY_OPTIONS.strip()} SELECT * FROM option_hits", "goal_purchases"))
def w21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy hits of normalised colours and sizes."""
    rows = _option_lists(v.goal_purchases(spark, sf_dir)).select("l_orderkey", "goal_options", "bought_options")
    return gl.fuzzy_hits(rows, ["l_orderkey"], "goal_options", "bought_options").groupBy("l_orderkey").agg(F.count_if("hit").alias("n_hits"), (F.count_if("hit") / F.count(F.lit(1))).alias("r_option"))


@query("w22_total_reward", _sql(f"WITH {_TYPE.strip()} SELECT l_orderkey, round((att_hits + opt_hits + CASE WHEN price_upper > 0 AND bought_retail <= price_upper THEN 1 ELSE 0 END) / (len(goal_attributes) + 2) * r_type, 6) AS reward, round(len(goal_attributes) / (len(goal_attributes) + 2), 6) AS w_att FROM y", "goal_purchases"))
def w22(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _type(v.goal_purchases(spark, sf_dir))
    size = lambda who: F.array(F.col(f"{who}_size").cast("string"))
    total = gl.total_reward(
        gl.substring_attribute_hits(F.col("goal_attributes"), F.col("bought_name")), gl.exact_option_hits(size("goal"), size("bought")),
        F.col("bought_retail"), F.col("price_upper"), F.size("goal_attributes"), F.lit(1), F.col("type.r_type"),
    )
    return rows.withColumn("t", total).select("l_orderkey", F.round("t.reward", 6).alias("reward"), F.round("t.w_att", 6).alias("w_att"))


@query("w22_total_reward_fuzzy", _sql(f"""
WITH {_TYPE.strip()}, {_FUZZY_ATTRIBUTES.strip()}, {_FUZZY_OPTIONS.strip()}
SELECT y.l_orderkey, round((a.n_hits + o.n_hits + CASE WHEN price_upper > 0 AND bought_retail <= price_upper THEN 1 ELSE 0 END) / (len(goal_attributes) + 3) * r_type, 6) AS reward
FROM y JOIN attribute_hits a USING (l_orderkey) JOIN option_hits o USING (l_orderkey)""", "goal_purchases"))  # fmt: skip
def w22_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As in an evaluation: fuzzy attribute and option hits, the price limit and the type."""
    rows = _option_lists(_type(v.goal_purchases(spark, sf_dir)))
    return gl.purchase_reward(
        rows, ["l_orderkey"], attributes=("goal_attributes", "bought_attributes"), options=("goal_options", "bought_options"), texts=["bought_name"],
        price=F.col("bought_retail"), upper=F.col("price_upper"), r_type=F.col("type.r_type"),
    ).select("l_orderkey", F.round("reward", 6).alias("reward"))


@query("w23_goal_shuffle", _sql("SELECT asin, idx::INT AS idx FROM (SELECT asin, size, row_number() OVER (ORDER BY md5(asin || '#233'), asin) - 1 AS idx FROM products) WHERE idx % 2 = 0 AND size > 10"))
def w23(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.md5(F.concat("asin", F.lit("#233"))), F.col("asin")]
    return gl.shuffle_goals(v.products(spark, sf_dir), order, (F.col("idx") % 2 == 0) & (F.col("size") > 10)).select("asin", F.col("idx").cast("int").alias("idx"))


@query("w23_weighted_limit", _sql(f"SELECT asin FROM products ORDER BY -ln(greatest({v.draw_sql('asin', 23)}, 1e-12)) / size LIMIT 25"))
def w23_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gl.weighted_limit(v.products(spark, sf_dir), "size", v.draw(F.col("asin"), 23), 25).select("asin")


@query("w24_color_normalise", _sql(f"SELECT asin, coalesce(list_filter({_COLORS}, lambda c: contains(name, c))[1], name) AS color FROM products"))
def w24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.products(spark, sf_dir).select("asin", ct.normalise_color(F.col("name")).alias("color"))


_SIZES = ["XX-Large", "15.5 neck 34 sleeve", "8 women | 6 men", "30W x 32L", "9.5 wide", "12 inch", "40mm", '12"', "7", "7.5", "3 yards", "odd", "queen bed", "2*3", "a-b"]
_SIZE_CASE = " ".join("WHEN regexp_matches(s, '{0}') THEN '{0}'".format(p.replace("'", "''")) for p in ct.SIZE_PATTERNS)


@query("w25_size_color_mapping", _sql(f"""
WITH d AS (SELECT DISTINCT lower(([{', '.join("'" + s + "'" for s in _SIZES)}])[(ord % {len(_SIZES)} + 1)::INT]) AS s, name FROM products)
SELECT s AS size, name, CASE {_SIZE_CASE} WHEN regexp_full_match(s, '[0-9]*\\.?[0-9]*') AND regexp_matches(s, '[0-9]') THEN 'numeric_size' ELSE 'not_matched' END AS size_group,
  coalesce(list_filter({_COLORS}, lambda c: contains(lower(name), c))[1], 'not_matched') AS color_group FROM d"""))  # fmt: skip
def w25(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.lower(F.element_at(F.array(*map(F.lit, _SIZES)), (F.col("ord") % len(_SIZES) + 1).cast("int")))
    rows = v.products(spark, sf_dir).select(size.alias("size"), "name").distinct()
    return rows.select("size", "name", ct.size_group(F.col("size")).alias("size_group"), ct.color_group(F.col("name")).alias("color_group"))


@query("w29_ranked_attribute_parse", _sql("SELECT asin, name AS attribute, round(size / 100.0, 4) AS score, category AS tags FROM products"))
def w29(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.search import parse_ranked_attribute

    line = F.concat("name", F.lit(" | "), F.format_string("%.4f", F.col("size") / 100), F.lit(" | "), "category")
    return v.products(spark, sf_dir).withColumn("p", parse_ranked_attribute(line)).select("asin", "p.attribute", "p.score", "p.tags")


@query("w37_weighted_goal_choice", _sql(f"""
WITH g AS (SELECT asin, sum(size) OVER (ORDER BY ord) / sum(size) OVER () AS high, (sum(size) OVER (ORDER BY ord) - size) / sum(size) OVER () AS low FROM products),
d AS (SELECT ord AS draw_id, {v.draw_sql('asin', 37)} AS u FROM products WHERE ord <= 100)
SELECT draw_id, asin FROM d JOIN g ON u >= low AND u < high"""))  # fmt: skip
def w37(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.products(spark, sf_dir)
    draws = rows.where("ord <= 100").select(F.col("ord").alias("draw_id"), v.draw(F.col("asin"), 37).alias("u"))
    return gl.weighted_choice(rows.select("asin", "ord", "size"), draws, "size", ["ord"]).select("draw_id", "asin")


@query("w40_valid_actions", _sql("""
SELECT asin, CASE ord % 3 WHEN 0 THEN 'click[back to search]' || CASE WHEN size > 10 THEN '|click[next >]' ELSE '' END || CASE WHEN size % 4 > 1 THEN '|click[< prev]' ELSE '' END || '|click[item - ' || name || ']'
  WHEN 1 THEN 'click[back to search]|click[< prev]|click[description]|click[features]|click[buy now]|click[' || attributes[1] || ']|click[' || attributes[2] || ']'
  ELSE 'click[back to search]|click[< prev]' END AS actions FROM products"""))  # fmt: skip
def w40(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("results"), F.lit("item_page"), F.lit("sub_page")), (F.col("ord") % 3 + 1).cast("int"))
    actions = ct.valid_actions(kind, F.col("size"), F.col("size") % 4, F.array("name"), F.col("attributes"))
    return v.products(spark, sf_dir).select("asin", F.array_join(actions, "|").alias("actions"))


@query("w41_instruction_clean", _sql("SELECT asin, 'find a ' || lower(name) AS instruction FROM products"))
def w41(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.concat(F.lit(' Find a "'), "name", F.lit("'\", and price lower than 20.00 dollars"))
    return v.products(spark, sf_dir).select("asin", ct.clean_instruction(told).alias("instruction"))
