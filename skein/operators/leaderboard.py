"""Non-personalized lists by user-given expressions (AG11, WN4, WN5, RC1, RC2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.expressions import Compiler, checked
from skein.lineage import Scratch
from skein.operators.hot_keys import salted_join


def scored_items(items: DataFrame, feedback: DataFrame, as_of: str, score: str, filter: str | None = None) -> DataFrame:
    """Visible items with ``score`` over their feedback; items without feedback have an empty list (AG11).

    ``score`` and ``filter`` become plain aggregates of feedback joined with items. Feedback of a heavy item is salted
    for the join and combined there before it is shuffled by item. Null and NaN scores leave.
    """
    compiler = Compiler(as_of, grouped=True)
    fb = Scratch(feedback.sparkSession, "feedback").cut(feedback).select("item_id", *[F.col(c).alias(f"fb_{c}") for c in feedback.columns])
    shown = items.where(~F.col("is_hidden"))
    met = salted_join(fb, shown, "item_id")
    # an item that no feedback meets has one row without any
    bare = shown.join(fb.select("item_id").distinct(), "item_id", "left_anti")
    joined = met.unionByName(bare, allowMissingColumns=True)
    others = [c for c in items.columns if c != "item_id"]
    first = [F.any_value(c).alias(c) for c in others]
    value = compiler.compile(score)
    test = compiler.compile(filter) if filter else F.lit(True)
    made = joined.groupBy("item_id").agg(*first, value.alias("score"), test.alias("_keep"))
    checked(made, F.col("_keep"), "boolean")
    scored = made.withColumn("score", checked(made, F.col("score"), "number").cast("double"))
    return scored.where("_keep and score is not null and not isnan(score)").drop("_keep")


def top_by_category(scored: DataFrame, n: int) -> DataFrame:
    """``category, item_id, score, rank``: the ``n`` best of each category and of all, which is the category "" (WN4)."""
    lists = F.explode(F.array_union(F.array(F.lit("")), F.col("categories"))).alias("category")
    best = Window.partitionBy("category").orderBy(F.desc("score"), "item_id")
    return scored.select(lists, "item_id", "score").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def regrouped(tops: DataFrame) -> DataFrame:
    """``item_id, score, categories``: one row per item with the lists that kept it (WN5)."""
    return tops.groupBy("item_id").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("category")).alias("categories"))


def popular(items: DataFrame, feedback: DataFrame, as_of: str, n: int, score: str = "len(feedback)", filter: str | None = None) -> DataFrame:
    """The leaderboard ``item_id, score, categories`` (RC2)."""
    return regrouped(top_by_category(scored_items(items, feedback, as_of, score, filter), n))


def latest(items: DataFrame, n: int | None = None) -> DataFrame:
    """``item_id, score``: the newest visible items, scored by epoch seconds, all of them without ``n`` (RC1)."""
    rows = items.where(~F.col("is_hidden") & F.col("timestamp").isNotNull())
    rows = rows if n is None else rows.orderBy(F.desc("timestamp"), "item_id").limit(n)
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.date_trunc("second", "timestamp").cast("timestamp_ntz"))
    return rows.select("item_id", seconds.cast("double").alias("score"))
