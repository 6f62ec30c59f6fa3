"""The raw product catalogue: fields whose types change from product to product.

An element of a product file is read as a variant and typed late, field by field: a description may be a text, a
list or missing, an option's contents a list, null or something else, and none of these costs the product another field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .json_arrays import read_variants

#: Fields that are one text; a number or a truth value in their place is taken as its text.
TEXTS = ("asin", "name", "category", "query", "product_category", "full_description", "pricing")
_BLANK = " \t\n\x0b\x0c\r"


def text_field(product: Column, name: str) -> Column:
    return F.try_variant_get(product, f"$.{name}", "string")


def list_field(product: Column, name: str) -> Column:
    """A list's items as texts; a single value as a list of one; null or missing as a list of one null."""
    items = F.try_variant_get(product, f"$.{name}", "array<variant>")
    one = F.array(F.try_variant_get(product, f"$.{name}", "string"))
    return F.when(items.isNotNull(), F.transform(items, lambda x: F.try_variant_get(x, "$", "string"))).otherwise(one)


def image_list(product: Column) -> Column:
    """The images; none where the field holds no list."""
    return F.coalesce(F.try_variant_get(product, "$.images", "array<string>"), F.array().cast("array<string>"))


def option_name(name: Column) -> Column:
    return F.lower(name)


def option_value(value: Column) -> Column:
    """Trimmed, '/' as ' | ', in lower case."""
    return F.lower(F.replace(F.btrim(value, F.lit(_BLANK)), F.lit("/"), F.lit(" | ")))


def option_items(product: Column, raw: Column) -> Column:
    """array<struct<name, values array<struct<value, image>>>> of a product's options, in the file's order.

    Names and values are normalised. An option whose contents are null or no list is left out, and so is an item
    without a value; the product's other options stay.
    """
    names = F.json_object_keys(F.get_json_object(raw, "$.customization_options"))
    contents = F.try_variant_get(product, "$.customization_options", "map<string,variant>")
    entry = lambda n: F.struct(
        option_name(n).alias("name"), F.try_variant_get(F.try_element_at(contents, n), "$", "array<variant>").alias("items")
    )
    listed = F.filter(F.transform(names, entry), lambda e: e["items"].isNotNull())
    item = lambda o: F.struct(option_value(F.try_variant_get(o, "$.value", "string")).alias("value"), F.try_variant_get(o, "$.image", "string").alias("image"))
    typed_items = F.transform(listed, lambda e: F.struct(e["name"], F.filter(F.transform(e["items"], item), lambda o: o["value"].isNotNull()).alias("values")))
    return F.coalesce(typed_items, F.array().cast("array<struct<name:string,values:array<struct<value:string,image:string>>>>"))


def option_values(items: Column) -> Column:
    """map<name, array<value>> of option_items; of names that became one, the last contents count, at the first one's place."""
    order = F.array_distinct(F.transform(items, lambda e: e["name"]))
    last = lambda n: F.transform(F.element_at(F.filter(items, lambda e: e["name"] == n), -1)["values"], lambda o: o["value"])
    return F.map_from_entries(F.transform(order, lambda n: F.struct(n.alias("name"), last(n).alias("values"))))


def option_images(items: Column) -> Column:
    """map<value, image> over all items; of equal values the last one's image."""
    pairs = F.flatten(F.transform(items, lambda e: e["values"]))
    values = F.array_distinct(F.transform(pairs, lambda o: o["value"]))
    return F.map_from_entries(F.transform(values, lambda v: F.struct(v.alias("value"), F.element_at(F.filter(pairs, lambda o: o["value"] == v), -1)["image"].alias("image"))))


def typed(rows: DataFrame) -> DataFrame:
    """(source_file, block, at, the texts, bullet_points, images, options, option_to_image) of read_variants' rows in ``product`` and ``raw``."""
    p = F.col("product")
    first = rows.select("source_file", "block", "at", *(text_field(p, n).alias(n) for n in TEXTS), list_field(p, "small_description").alias("bullet_points"), image_list(p).alias("images"), option_items(p, F.col("raw")).alias("option_items_"))
    return first.select("*", option_values(F.col("option_items_")).alias("options"), option_images(F.col("option_items_")).alias("option_to_image")).drop("option_items_")


def read_products(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Products of files that each hold one JSON array; an element that is no JSON object has null texts."""
    return typed(read_variants(spark, paths, "product"))
