"""From merged feedback to classified interactions, samples and statistics (JN1 to JN4, AG3, AG8 to AG10, AG13)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ids import clean_id
from skein.functions.predicates import fresh, known_by, matches

ARRAY = "array<string>"


@dataclass(frozen=True)
class Types:
    """Which feedback is positive, read or negative. Every list is explicit; an empty one matches nothing."""

    positive: tuple[str, ...] = ("purchase", "like", "share", "star>=3")
    read: tuple[str, ...] = ("view", "click")
    negative: tuple[str, ...] = ("skip",)


def clean_users(users: DataFrame) -> DataFrame:
    """One row per trimmed user id: the one with the greatest comment, then labels; blank ids leave."""
    named = users.select(clean_id("user_id").alias("user_id"), "labels", F.nullif("comment", F.lit("")).alias("comment")).where("user_id is not null")
    return named.groupBy("user_id").agg(F.max(F.struct("comment", "labels")).alias("r")).select("user_id", "r.labels", "r.comment")


def clean_terms(column: Column) -> Column:
    """Distinct terms of an array, trimmed and in lower case, without nulls and blanks, sorted."""
    terms = F.transform(F.coalesce(column, F.array().cast(ARRAY)), lambda t: F.trim(F.lower(t)))
    return F.array_sort(F.array_distinct(F.filter(terms, lambda t: t.isNotNull() & (t != ""))))


def clean_items(items: DataFrame) -> DataFrame:
    """One row per trimmed item id: the one of the latest time, then the hidden one; ``categories`` and ``tags`` as clean terms."""
    rows = items.select(
        clean_id("item_id").alias("item_id"), F.coalesce("is_hidden", F.lit(False)).alias("is_hidden"), clean_terms(F.col("categories")).alias("categories"), "timestamp",
        clean_terms(F.col("labels.tags")).alias("tags"), F.col("labels.brand").alias("brand"), F.col("labels.type").alias("type"), F.col("labels.price").alias("price"), F.nullif("comment", F.lit("")).alias("comment"),
    ).where("item_id is not null")
    others = [c for c in rows.columns if c != "item_id"]
    order = F.struct(F.col("timestamp"), F.col("is_hidden"), F.col("price"), F.col("brand"), F.col("type"))
    return rows.groupBy("item_id").agg(F.max_by(F.struct(*others), order).alias("r")).select("item_id", *[f"r.{c}" for c in others])


def classify(merged: DataFrame, users: DataFrame, items: DataFrame, as_of: str, types: Types = Types(), ttl_days: float = 0) -> DataFrame:
    """``user_id, item_id, kind, timestamp, n_positive`` of known users and items: negative beats positive beats read (JN1 to JN3).

    ``timestamp`` is the latest of the pair's feedback of any of the kinds up to ``as_of``. The three classes are one
    conditional aggregate over one shuffle instead of two anti-joins.
    """
    rows = merged.where(known_by(F.col("timestamp"), as_of) & fresh(F.col("timestamp"), as_of, ttl_days))
    flags = {"negative": matches(list(types.negative)), "positive": matches(list(types.positive)), "read": matches(list(types.read))}
    rows = rows.select("user_id", "item_id", "timestamp", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()]).where("negative or positive or read")
    pairs = rows.groupBy("user_id", "item_id").agg(*[F.bool_or(k).alias(k) for k in flags], F.max("timestamp").alias("timestamp"), F.count_if("positive").alias("n_positive"))
    kind = F.when(F.col("negative"), "negative").when(F.col("positive"), "positive").otherwise("read")
    pairs = pairs.select("user_id", "item_id", kind.alias("kind"), "timestamp", "n_positive")
    return pairs.join(users.select("user_id"), "user_id", "left_semi").join(items.select("item_id"), "item_id", "left_semi").select("user_id", "item_id", "kind", "timestamp", "n_positive")


def samples(classified: DataFrame) -> DataFrame:
    """``user_id, item_id, target, timestamp``: +1 for positives, -1 for the rest (AG13)."""
    return classified.select("user_id", "item_id", F.when(F.col("kind") == "positive", 1).otherwise(-1).alias("target"), "timestamp")


def positives(classified: DataFrame) -> DataFrame:
    return classified.where("kind = 'positive'")


def not_positive(classified: DataFrame) -> DataFrame:
    """Pairs of known users and items with feedback but none that is positive (SE2)."""
    return classified.where("kind <> 'positive'").select("user_id", "item_id")


def frequency(classified: DataFrame, key: str) -> DataFrame:
    """Positive feedback rows per user or item; several types on one pair count each (AG3)."""
    return positives(classified).groupBy(key).agg(F.sum("n_positive").alias("freq"))


def category_counts(items: DataFrame) -> DataFrame:
    """Items per category, hidden ones included (AG8)."""
    return items.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n_items"))


def statistics(users: DataFrame, items: DataFrame, classified: DataFrame, **labels: DataFrame) -> DataFrame:
    """``name, n``: users, items, pairs by kind, and distinct labels of each table of ``labels`` (``label``) under its name (AG9)."""
    parts = [users.agg(F.count(F.lit(1)).alias("n")).select(F.lit("users").alias("name"), "n"), items.agg(F.count(F.lit(1)).alias("n")).select(F.lit("items").alias("name"), "n")]
    parts.append(classified.groupBy(F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n")))
    parts += [df.agg(F.count_distinct("label").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in labels.items()]
    return reduce(DataFrame.unionByName, parts)


def activity(owners: DataFrame, classified: DataFrame, key: str) -> DataFrame:
    """``active, n``: owners with and without positive feedback (AG10)."""
    active = positives(classified).select(key).distinct().withColumn("active", F.lit(True))
    return owners.select(key).join(active, key, "left").groupBy(F.coalesce("active", F.lit(False)).alias("active")).agg(F.count(F.lit(1)).alias("n"))


def exclude(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates (``user_id, item_id``) without pairs seen (JN4)."""
    return candidates.join(seen.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti").select(*candidates.columns)


def exclude_all(candidates: DataFrame, *sets: DataFrame) -> DataFrame:
    """Candidates without the pairs of any of the sets, by one anti-join with their union (SE4)."""
    return exclude(candidates, reduce(DataFrame.unionByName, [s.select("user_id", "item_id") for s in sets]))


def last_modified(merged: DataFrame, key: str) -> DataFrame:
    """The latest update per user or item (ST7)."""
    return merged.groupBy(key).agg(F.max("updated").alias("last_modified"))


def active_users(merged: DataFrame, as_of: str, days: float) -> DataFrame:
    """Users whose last feedback is at most ``days`` before ``as_of`` (RC25)."""
    last = merged.groupBy("user_id").agg(F.max("timestamp").alias("last"))
    return last.where(fresh(F.col("last"), as_of, days)).select("user_id")


def by_item_ranges(feedback: DataFrame, n: int) -> DataFrame:
    """Feedback in ``n`` contiguous ranges of item ids (JN10)."""
    return feedback.repartitionByRange(n, "item_id")


def item_histories(classified: DataFrame, n: int) -> DataFrame:
    """The ``n`` latest positive users of each item, newest first (JN11); never the whole of a hot item."""
    w = Window.partitionBy("item_id").orderBy(F.desc("timestamp"), "user_id")
    rows = positives(classified).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    return rows.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "user_id"))), lambda x: x["user_id"]).alias("users"))


def prompt_contexts(merged: DataFrame, items: DataFrame, as_of: str, n: int, types: Types = Types()) -> DataFrame:
    """``user_id, place, feedback_type`` and the item's row: a user's ``n`` latest positive feedback with its items (JN12).

    Newest first, then by item and type; feedback on unknown items counts among the ``n`` but has no row.
    """
    rows = merged.where(known_by(F.col("timestamp"), as_of) & matches(list(types.positive))).select("user_id", "item_id", "feedback_type", F.col("timestamp").alias("_at"))
    w = Window.partitionBy("user_id").orderBy(F.desc("_at"), "item_id", "feedback_type")
    rows = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("_at")
    return rows.join(items, "item_id").select("user_id", "place", "feedback_type", *items.columns)


def busy_users(merged: DataFrame, as_of: str, rows: int, value: float) -> DataFrame:
    """``user_id, feedback_type, total`` of at least so many rows and so great a sum of values up to ``as_of`` (AG2)."""
    known = merged.where(known_by(F.col("timestamp"), as_of))
    sums = known.groupBy("user_id", "feedback_type").agg(F.sum(F.round("value", 2)).alias("total"), F.count(F.lit(1)).alias("n"))
    return sums.where((F.col("n") >= rows) & (F.col("total") >= value)).select("user_id", "feedback_type", "total")
