"""Scans of users, items and feedback (SC1 to SC13). Every predicate is a plain filter, so it reaches the Parquet scan."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.predicates import has_all, known_by, matches_or_all, visible


def stamp(text: str):
    return F.lit(text).cast("timestamp_ntz")


def items_since(items: DataFrame, limit: str | None = None) -> DataFrame:
    """All items, or those not older than ``limit`` (SC2)."""
    return items if limit is None else items.where(F.col("timestamp") >= stamp(limit))


def feedback_between(
    feedback: DataFrame, types: list[str] | None = None, begin: str | None = None, end: str | None = None,
    users: tuple[str | None, str | None] = (None, None), items: tuple[str | None, str | None] = (None, None),
) -> DataFrame:
    """Feedback by type expressions, time and id ranges, all ends included (SC3)."""
    keep = matches_or_all(types)
    for column, low, high in (("timestamp", stamp(begin) if begin else None, stamp(end) if end else None), ("user_id", *users), ("item_id", *items)):
        if low is not None:
            keep = keep & (F.col(column) >= low)
        if high is not None:
            keep = keep & (F.col(column) <= high)
    return feedback.where(keep)


def page(df: DataFrame, key: str, cursor: str = "", n: int = 10) -> tuple[DataFrame, str]:
    """A page of ``n`` rows by ascending ``key`` from ``cursor`` on, and the next cursor, empty at the end (SC4, SC5)."""
    start = base64.b64decode(cursor).decode() if cursor else ""
    rows = df.where(F.col(key) >= start).orderBy(key).limit(n + 1).collect()
    after = base64.b64encode(rows[n][key].encode()).decode() if len(rows) > n else ""
    return df.sparkSession.createDataFrame(rows[:n], df.schema), after


def feedback_page(feedback: DataFrame, cursor: str = "", n: int = 10, begin: str | None = None, end: str | None = None, types: list[str] | None = None) -> tuple[DataFrame, str]:
    """A page of feedback by (type, user, item) (SC6). Spark orders structs by their fields from the left."""
    rows = feedback_between(feedback, types, begin, end)
    key = F.struct("feedback_type", "user_id", "item_id")
    if cursor:
        rows = rows.where(key >= F.struct(*map(F.lit, json.loads(base64.b64decode(cursor)))))
    found = rows.orderBy("feedback_type", "user_id", "item_id").limit(n + 1).collect()
    after = base64.b64encode(json.dumps([found[n][c] for c in ("feedback_type", "user_id", "item_id")]).encode()).decode() if len(found) > n else ""
    return feedback.sparkSession.createDataFrame(found[:n], rows.schema), after


def one(df: DataFrame, key: str, value: str) -> DataFrame:
    """The row of an id (SC7); no row if there is none."""
    return df.where(F.col(key) == value)


def items_among(items: DataFrame, ids: DataFrame, categories: list[str] | None = None, skip_hidden: bool = False, after: str | None = None) -> DataFrame:
    """Items whose id is in ``ids`` (``item_id``), with all ``categories``, after a time, strictly (SC8)."""
    rows = items.join(ids.select("item_id"), "item_id", "left_semi").select(*items.columns)
    if categories:
        rows = rows.where(has_all(F.col("categories"), categories))
    if skip_hidden:
        rows = rows.where(visible())
    return rows if after is None else rows.where(F.col("timestamp") > stamp(after))


def latest_items(items: DataFrame, n: int, categories: list[str] | None = None, after: str | None = None) -> DataFrame:
    """The ``n`` newest visible items with all ``categories``, after a time, strictly; of one time by id (SC9)."""
    rows = items.where(visible() & F.col("timestamp").isNotNull())
    if categories:
        rows = rows.where(has_all(F.col("categories"), categories))
    if after is not None:
        rows = rows.where(F.col("timestamp") > stamp(after))
    return rows.orderBy(F.desc("timestamp"), "item_id").limit(n)


def user_feedback(merged: DataFrame, user_id: str, end: str, types: list[str] | None = None) -> DataFrame:
    """A user's merged feedback up to ``end`` by type expressions on the merged value (SC10)."""
    return merged.where((F.col("user_id") == user_id) & known_by(F.col("timestamp"), end) & matches_or_all(types))


def item_feedback(merged: DataFrame, item_id: str, as_of: str, types: list[str] | None = None) -> DataFrame:
    """An item's merged feedback up to ``as_of``, of some types (SC11)."""
    rows = merged.where((F.col("item_id") == item_id) & known_by(F.col("timestamp"), as_of))
    return rows.where(F.col("feedback_type").isin(types)) if types else rows


def user_item_feedback(merged: DataFrame, user_id: str, item_id: str, types: list[str] | None = None) -> DataFrame:
    """The merged feedback of one user on one item, whatever its time (SC12)."""
    rows = merged.where((F.col("user_id") == user_id) & (F.col("item_id") == item_id))
    return rows.where(F.col("feedback_type").isin(types)) if types else rows


def counts(**tables: DataFrame) -> DataFrame:
    """``name, n``: exact row counts (SC13)."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
