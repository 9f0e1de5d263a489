"""Upserts, feedback merges, patches and deletes (SK1 to SK7, SK11), each a function of the old table and a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ids import clean_id
from skein.schema import FEEDBACK_KEY


def first_of_batch(batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key (SK1). ``order`` must tell the rows of a key apart."""
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return batch.withColumn("_row", row).where("_row = 1").drop("_row")


def upsert(old: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The batch's rows, first of a key wins, in place of old rows with their keys (SK1, SK2)."""
    new = first_of_batch(batch, keys, order)
    kept = old.join(new.select(*keys), keys, "left_anti").select(*old.columns)
    return kept.unionByName(new.select(*old.columns))


def merge_feedback(rows: DataFrame) -> DataFrame:
    """One row per (type, user, item): sum of values, first time, last update, the comment of the latest update (AG1, ST5).

    Types and ids are trimmed, types in lower case; rows with a blank one are left out. Null and NaN values add
    nothing, all of them 0. The aggregate combines map-side, so a hot key is no burden. Merging merged rows with new ones is the same merge.
    """
    value = F.col("value").cast("double")
    clean = rows.select(
        F.lower(F.trim("feedback_type")).alias("feedback_type"), clean_id("user_id").alias("user_id"), clean_id("item_id").alias("item_id"),
        F.when(~F.isnan(value), value).alias("value"), "timestamp", "updated", "comment",
    ).where("feedback_type <> '' and user_id is not null and item_id is not null")
    last = F.max(F.when(F.col("comment").isNotNull() & F.col("updated").isNotNull(), F.struct("updated", "comment")))
    return clean.groupBy(*FEEDBACK_KEY).agg(
        F.coalesce(F.round(F.sum("value"), 6), F.lit(0.0)).alias("value"), F.min("timestamp").alias("timestamp"), F.max("updated").alias("updated"), last.getField("comment").alias("comment")
    )


def insert_feedback(
    old: DataFrame, batch: DataFrame, users: DataFrame, items: DataFrame, order: list[Column],
    insert_user: bool = True, insert_item: bool = True, overwrite: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(feedback, users, items) after a batch (SK3).

    Unknown users and items are added if told so; otherwise feedback naming them is dropped. Of a key's rows in the
    batch the first counts. It replaces the old row, or accumulates on it.
    """
    new = first_of_batch(batch, FEEDBACK_KEY, order)
    grown = []
    for table, key, insert in ((users, "user_id", insert_user), (items, "item_id", insert_item)):
        if insert:
            unknown = new.select(key).distinct().join(table.select(key), key, "left_anti")
            grown.append(table.unionByName(unknown, allowMissingColumns=True))
        else:
            new = new.join(table.select(key).distinct(), key, "left_semi").select(*batch.columns)
            grown.append(table)
    if overwrite:
        kept = old.join(new.select(*FEEDBACK_KEY), FEEDBACK_KEY, "left_anti").select(*old.columns)
        return kept.unionByName(new.select(*old.columns)), *grown
    return merge_feedback(old.unionByName(new.select(*old.columns))), *grown


def patch(df: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Rows with the non-null columns of their patch (SK4); a patch of nulls changes nothing, one of an unknown key neither."""
    columns = [c for c in patches.columns if c != key]
    named = patches.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return df.join(named, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def delete(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't among ``gone`` (SK5, SK6)."""
    return df.join(gone.select(*keys).distinct(), keys, "left_anti").select(*df.columns)


def delete_owner(df: DataFrame, feedback: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Users or items without the ``gone`` ones, and feedback without theirs (SK5)."""
    return delete(df, gone, [key]), delete(feedback, gone, [key])


def delete_pair(feedback: DataFrame, user_id: str, item_id: str, types: list[str] | None = None) -> tuple[DataFrame, int]:
    """Feedback without one user's on one item, and how many rows went (SK6)."""
    hit = (F.col("user_id") == user_id) & (F.col("item_id") == item_id)
    if types:
        hit = hit & F.col("feedback_type").isin(types)
    hit = F.coalesce(hit, F.lit(False))
    return feedback.where(~hit), feedback.where(hit).count()


def purge(df: DataFrame) -> DataFrame:
    """The empty table (SK7)."""
    return df.limit(0)


def add_category(items: DataFrame, item_id: str, category: str) -> DataFrame:
    """An item with one more category, once (SK11)."""
    own = F.coalesce("categories", F.array().cast("array<string>"))
    return items.withColumn("categories", F.when(F.col("item_id") == item_id, F.array_union(own, F.array(F.lit(category)))).otherwise(F.col("categories")))


def remove_category(items: DataFrame, item_id: str, category: str) -> DataFrame:
    """An item without a category (SK11)."""
    return items.withColumn("categories", F.when(F.col("item_id") == item_id, F.array_remove("categories", category)).otherwise(F.col("categories")))
