"""Scores of a purchase against a goal, and the choice of goals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fuzzy
from .fuzzy import MATCH
from .numbering import meet_ranges, numbered, running


def type_reward(bought_query: Column, goal_query: Column, bought_path: Column, goal_path: Column, bought_nouns: Column, goal_nouns: Column) -> Column:
    """struct(r_type, query_match, category_match, title_score). Nouns are arrays of words, tagged beforehand."""
    parts = lambda p: F.array_distinct(F.transform(F.split(p, "›", -1), lambda x: F.trim(x)))
    query_match = bought_query == goal_query
    category_match = F.size(F.array_intersect(parts(bought_path), parts(goal_path))) >= 2
    shared = F.size(F.array_intersect(F.array_distinct(bought_nouns), F.array_distinct(goal_nouns)))
    title = F.when(F.size(goal_nouns) == 0, 0.2).otherwise(shared / F.size(goal_nouns))
    r_type = F.when(title == 0, 0.0).when(title < 0.1, 0.1).when(~(query_match | category_match | (title > 0.2)), 0.5).otherwise(1.0)
    return F.struct(r_type.alias("r_type"), query_match.alias("query_match"), category_match.alias("category_match"), title.alias("title_score"))


def fuzzy_hits(rows: DataFrame, key: list[str], wanted: str, offered: str) -> DataFrame:
    """(key, wanted_at, hit): whether any offered text scores above 85 against each wanted one.

    Both are arrays; the pairs of one row are exploded, scored in Arrow batches and reduced before they move. Pairs
    that are equal, or that length and shared words rule out, are decided without a score.
    """
    pairs = rows.select(*key, F.posexplode_outer(wanted).alias("wanted_at", "w"), offered).select(*key, "wanted_at", "w", F.explode_outer(offered).alias("o"))
    exact = F.coalesce(F.lower("w") == F.lower("o"), F.lit(False))
    scored = pairs.where("wanted_at is not null").withColumn("hit", F.when(exact, True).otherwise(F.coalesce(fuzzy.score(F.when(~exact, F.col("o")), F.col("w"), MATCH) > MATCH, F.lit(False))))
    return scored.groupBy(*key, "wanted_at").agg(F.max("hit").alias("hit"))


def attribute_reward(rows: DataFrame, key: list[str], goal: str, bought: str, texts: list[str]) -> DataFrame:
    """(key, n_hits, n_goal): a goal attribute counts if a bought one matches it or one of the texts holds it."""
    fuzzy = fuzzy_hits(rows, key, goal, bought)
    held = None
    for t in texts:
        c = F.contains(F.lower(F.coalesce(t, F.lit(""))), F.col("w"))
        held = c if held is None else held | c
    wanted = rows.select(*key, *texts, F.posexplode(goal).alias("wanted_at", "w")).withColumn("held", held)
    both = wanted.join(fuzzy, [*key, "wanted_at"], "left")
    hits = both.groupBy(*key).agg(F.count_if(F.coalesce("hit", F.lit(False)) | F.col("held")).alias("n_hits"))
    return hits.join(rows.select(*key, F.size(goal).alias("n_goal")), key)


def substring_attribute_hits(goal: Column, text: Column) -> Column:
    """How many goal attributes a lower-case text holds."""
    return F.size(F.filter(goal, lambda g: F.contains(F.lower(text), g)))


def exact_option_hits(goal: Column, bought: Column) -> Column:
    """How many goal options are among the bought ones; both normalised beforehand."""
    return F.size(F.filter(goal, lambda g: F.array_contains(bought, g)))


def total_reward(attribute_hits: Column, option_hits: Column, price: Column, upper: Column, n_attributes: Column, n_options: Column, r_type: Column) -> Column:
    """struct(reward, w_att, w_option, w_price): hits and the kept price limit over all wants, times the type reward.

    A limit of 0 or less counts as kept by no price.
    """
    wants = n_attributes + n_options + 1
    kept = F.when((upper > 0) & (price <= upper), 1).otherwise(0)
    return F.struct(((attribute_hits + option_hits + kept) / wants * r_type).alias("reward"), (n_attributes / wants).alias("w_att"), (n_options / wants).alias("w_option"), (1 / wants).alias("w_price"))


def purchase_reward(rows: DataFrame, key: list[str], attributes: tuple[str, str], options: tuple[str, str], texts: list[str], price: Column, upper: Column, r_type: Column) -> DataFrame:
    """(key, n_attributes, n_options, reward, ...) of purchases: fuzzy attribute and option hits and the kept price limit over all wants, times the type.

    ``attributes`` and ``options`` name the wanted and the bought lists; options are normalised beforehand. An
    attribute also counts where one of ``texts`` holds it.
    """
    wanted, bought = attributes
    told = attribute_reward(rows, key, wanted, bought, texts).select(*key, F.col("n_hits").alias("n_attributes"))
    chosen = fuzzy_hits(rows, key, *options).groupBy(*key).agg(F.count_if("hit").alias("n_options"))
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    # rows with an empty list have no hits of that kind
    each = rows.select(*key, count(wanted).alias("n_a"), count(options[0]).alias("n_o"), price.alias("price_"), upper.alias("upper_"), r_type.alias("r_type_"))
    hit = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = each.join(told, key, "left").join(chosen, key, "left").select(*each.columns, hit("n_attributes").alias("n_attributes"), hit("n_options").alias("n_options"))
    total = total_reward(F.col("n_attributes"), F.col("n_options"), F.col("price_"), F.col("upper_"), F.col("n_a"), F.col("n_o"), F.col("r_type_"))
    return joined.select(*key, "n_attributes", "n_options", total.alias("t")).select(*key, "n_attributes", "n_options", "t.*")


def shuffle_goals(goals: DataFrame, order: list[Column], where: Column | None = None) -> DataFrame:
    """Goals with their place in a reproducible shuffle; ``where`` may test the place, ``idx``, and any column."""
    placed = numbered(goals, order, "idx")
    return placed if where is None else placed.where(where)


def weighted_limit(goals: DataFrame, weight: str, u: Column, k: int) -> DataFrame:
    """k distinct goals, drawn in proportion to their weights: the least of -ln(u) / weight (Efraimidis and Spirakis)."""
    return goals.withColumn("draw_key", -F.log(F.greatest(u, F.lit(1e-12))) / F.col(weight)).orderBy("draw_key").limit(k)


def weighted_choice(goals: DataFrame, draws: DataFrame, weight: str, order: list[str]) -> DataFrame:
    """Each draw (draw_id, u) with the goal in whose share of the running weights u falls.

    Draws and shares meet in as many buckets as there are goals, so a bucket holds few of either. Goals without
    weight are never drawn.
    """
    upto = running(goals.where(F.col(weight) > 0), order, weight, "upto_", "total_")
    shares = upto.select(*goals.columns, ((F.col("upto_") - F.col(weight)) / F.col("total_")).alias("low"), (F.col("upto_") / F.col("total_")).alias("high"))
    return meet_ranges(draws, shares, "u", "low", "high", max(1, shares.count()))
