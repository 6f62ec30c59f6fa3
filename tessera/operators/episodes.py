"""Evaluation episodes: best-of-N summaries, success counts, candidate choice, slices and resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered


def best_of_n(episodes: DataFrame, task: list[str], attempt: str = "attempt", reward: str = "reward") -> DataFrame:
    """Per task: the first, best and mean reward of its attempts."""
    return episodes.groupBy(*task).agg(F.min_by(reward, attempt).alias("first"), F.max(reward).alias("best"), F.avg(reward).alias("mean"), F.count(F.lit(1)).alias("attempts"))


def best_of_n_summary(per_task: DataFrame) -> DataFrame:
    """One row: the means over tasks, each task weighing the same."""
    return per_task.agg(F.count(F.lit(1)).alias("tasks"), F.avg("first").alias("mean_first"), F.avg("best").alias("mean_best"), F.avg("mean").alias("mean_mean"))


def summary(episodes: DataFrame) -> DataFrame:
    """Average reward, nulls adding nothing but counting, and the share of successes."""
    return episodes.agg((F.sum("reward") / F.count(F.lit(1))).alias("average_reward"), F.avg(F.coalesce(F.col("success"), F.lit(False)).cast("int")).alias("success_rate"))


def solved_average(episodes: DataFrame) -> DataFrame:
    """The sum of rewards over the number of solved episodes; null if none is solved."""
    solved = F.count_if(F.coalesce(F.col("success"), F.lit(False)))
    return episodes.agg(F.count(F.lit(1)).alias("n"), solved.alias("solved"), F.try_divide(F.sum("reward"), solved).alias("average"))


def success_counts(episodes: DataFrame, task: list[str]) -> DataFrame:
    """Successful attempts, tasks with more than one success, tasks whose first attempt succeeded."""
    won = (F.coalesce(F.col("reward"), F.lit(0.0)) == 1.0).cast("int")
    each = episodes.groupBy(*task).agg(F.sum(won).alias("wins"), F.min_by(won, "attempt").alias("first_won"))
    return each.agg(F.sum("wins").alias("successes"), F.count_if(F.col("wins") > 1).alias("tasks_with_several"), F.sum("first_won").cast("bigint").alias("tasks_first_won"))


def reward_levels(episodes: DataFrame, task: list[str]) -> DataFrame:
    """The number of different rewards per task, exactly; null is no level."""
    return episodes.groupBy(*task).agg(F.countDistinct("reward").alias("levels"))


def candidate_score() -> Column:
    """A finished candidate scores the environment's reward, an open one its predicted value."""
    return F.when(F.col("finished"), F.col("env_reward")).otherwise(F.col("q_value"))


def choose_best(candidates: DataFrame, state: list[str]) -> DataFrame:
    """Per state the candidate with the greatest score, the first of equals."""
    w = Window.partitionBy(*state).orderBy(F.col("score").desc_nulls_last(), "cand_idx")
    return candidates.withColumn("score", candidate_score()).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def choose_epsilon_greedy(candidates: DataFrame, state: list[str], state_draw: Column, pick_order: Column, epsilon: float = 0.1) -> DataFrame:
    """As choose_best, but in a share ``epsilon`` of states the first in ``pick_order``."""
    scored = candidates.withColumn("score", candidate_score())
    explore = state_draw < epsilon
    w = Window.partitionBy(*state).orderBy(F.when(explore, pick_order), F.when(~explore, F.col("score")).desc_nulls_last(), "cand_idx")
    return scored.withColumn("explored", explore).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def slice_of(tasks: DataFrame, order: list[str], slices: int, rule: str) -> DataFrame:
    """Each task's slice, n div ``slices`` tasks in each: the remainder is dropped (``drop``) or goes to the ``last``."""
    if rule not in ("drop", "last"):
        raise ValueError(rule)
    size = F.floor(F.col("n_") / slices)
    slice_ = F.when(size > 0, F.floor(F.col("at_task_") / F.greatest(size, F.lit(1)))).otherwise(slices if rule == "drop" else slices - 1).cast("int")
    cut = numbered(tasks, order, "at_task_", "n_").withColumn("slice", slice_).drop("at_task_", "n_")
    if rule == "last":
        return cut.withColumn("slice", F.least("slice", F.lit(slices - 1)))
    return cut.where(F.col("slice") < slices)


def task_key(path: Column, start: str = "/json_2.1.1/train/", end: str = "/game.tw-pddl") -> Column:
    """The part of a task's path after ``start`` and before ``end``."""
    return F.substring_index(F.substring_index(path, start, -1), end, 1)


def match_experts(tasks: DataFrame, experts: DataFrame, order: str) -> DataFrame:
    """Each task with its first expert trajectory in ``order``; tasks without one are dropped."""
    first = experts.groupBy("task_key").agg(F.min_by("expert_id", order).alias("expert_id"))
    return tasks.join(first, "task_key")


def unfinished(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without a result."""
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


#: The verb of each household task type, by the beginning of its name.
TASK_VERBS = (
    ("pick_and_place", "put"),
    ("pick_clean_then_place", "clean"),
    ("pick_heat_then_place", "heat"),
    ("pick_cool_then_place", "cool"),
    ("look_at_obj", "examine"),
    ("pick_two_obj", "puttwo"),
)


def task_verb(name: Column) -> Column:
    """The verb of a task, null for an unknown type."""
    out = None
    for start, verb in TASK_VERBS:
        out = F.when(name.startswith(start), verb) if out is None else out.when(name.startswith(start), verb)
    return out
