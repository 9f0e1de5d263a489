"""One object over a folder of tables with the operations a client of the service knows (§2.14).

Tables are versions of Parquet folders (``sources/versions.py``), replaced as a whole by each write, and another object
on the same folder reads what was written; batch jobs should call the operators directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schema
from skein.operators import cache, ingest, interactions, leaderboard, recommend
from skein.sources import files, scans
from skein.sources.versions import Versions

_SCHEMAS = {"users": schema.USERS, "items": schema.ITEMS, "feedback": schema.FEEDBACK, "scores": schema.SCORES, "points": schema.POINTS, "meta": schema.META, "messages": schema.MESSAGES}


def _first(rows: DataFrame) -> list[Column]:
    """The order of a batch: by its column ``position`` if it has one, then by the rows' content."""
    return [*([F.asc("position")] if "position" in rows.columns else []), F.to_json(F.struct(*rows.columns))]


class Engine:
    def __init__(self, spark: SparkSession, root: str, as_of: str, types: interactions.Types = interactions.Types()):
        self.spark, self.root, self.as_of, self.types = spark, root.rstrip("/"), as_of, types

    def _versions(self, name: str) -> Versions:
        return Versions(self.spark, f"{self.root}/{name}")

    def table(self, name: str) -> DataFrame:
        return self._versions(name).load(_SCHEMAS[name])

    def _put(self, name: str, df: DataFrame) -> None:
        fields = _SCHEMAS[name].fieldNames()
        self._versions(name).replace(df.select(*[F.col(c).cast(_SCHEMAS[name][c].dataType).alias(c) for c in fields]))

    def insert_users(self, rows: DataFrame) -> None:
        self._put("users", ingest.upsert(self.table("users"), rows, ["user_id"], _first(rows)))

    def insert_items(self, rows: DataFrame) -> None:
        self._put("items", ingest.upsert(self.table("items"), rows, ["item_id"], _first(rows)))

    def insert_feedback(self, rows: DataFrame, insert_user: bool = True, insert_item: bool = True, overwrite: bool = False) -> None:
        feedback, users, items = ingest.insert_feedback(self.table("feedback"), rows, self.table("users"), self.table("items"), _first(rows), insert_user, insert_item, overwrite)
        self._put("feedback", feedback)
        self._put("users", users)
        self._put("items", items)

    def patch_user(self, user_id: str, **columns: object) -> None:
        self._put("users", ingest.patch(self.table("users"), self._patch("users", "user_id", user_id, columns), "user_id"))

    def patch_item(self, item_id: str, **columns: object) -> None:
        self._put("items", ingest.patch(self.table("items"), self._patch("items", "item_id", item_id, columns), "item_id"))

    def _patch(self, name: str, key: str, value: str, columns: dict) -> DataFrame:
        kinds = [_SCHEMAS[name][key], *[_SCHEMAS[name][c] for c in columns]]
        return self.spark.createDataFrame([(value, *columns.values())], type(_SCHEMAS[name])(kinds))

    def delete_user(self, user_id: str) -> None:
        self._delete("users", "user_id", user_id)

    def delete_item(self, item_id: str) -> None:
        self._delete("items", "item_id", item_id)

    def _delete(self, name: str, key: str, value: str) -> None:
        gone = self.spark.createDataFrame([(value,)], f"{key} string")
        owners, feedback = ingest.delete_owner(self.table(name), self.table("feedback"), gone, key)
        self._put(name, owners)
        self._put("feedback", feedback)

    def users_page(self, cursor: str = "", n: int = 10) -> tuple[DataFrame, str]:
        return scans.page(self.table("users"), "user_id", cursor, n)

    def items_page(self, cursor: str = "", n: int = 10) -> tuple[DataFrame, str]:
        return scans.page(self.table("items"), "item_id", cursor, n)

    def feedback_page(self, cursor: str = "", n: int = 10) -> tuple[DataFrame, str]:
        return scans.feedback_page(self.table("feedback"), cursor, n)

    def add_category(self, item_id: str, category: str) -> None:
        self._put("items", ingest.add_category(self.table("items"), item_id, category))

    def delete_category(self, item_id: str, category: str) -> None:
        self._put("items", ingest.remove_category(self.table("items"), item_id, category))

    def classified(self) -> DataFrame:
        return interactions.classify(self.table("feedback"), self.table("users"), self.table("items"), self.as_of, self.types)

    def latest(self, n: int = 10) -> DataFrame:
        items = self.table("items").withColumn("is_hidden", F.coalesce("is_hidden", F.lit(False)))
        return leaderboard.latest(items, n)

    def popular(self, n: int = 10, score: str = "len(feedback)", filter: str | None = None) -> DataFrame:
        items = self.table("items").withColumns({"is_hidden": F.coalesce("is_hidden", F.lit(False)), "categories": F.coalesce("categories", F.array().cast("array<string>"))})
        return leaderboard.popular(items, interactions.positives(self.classified()), self.as_of, n, score, filter)

    def recommend(self, lists: list[DataFrame], n: int = 10, replacement: bool = False) -> DataFrame:
        """Lists in order, then the latest items, without what each user has seen (RC17)."""
        seen = recommend.seen_pairs(self.classified(), replacement)
        # what the lists offer may come again below, so the fallback is as much longer as any list of a user
        offered = [df.select("user_id", "item_id") for df in lists]
        passed = seen.select("user_id", "item_id")
        for df in offered:
            passed = passed.unionByName(df)
        fallback = recommend.filled_list(self.table("users"), self.board(), n, passed)
        return recommend.sequential([*lists, fallback], n, seen)

    def board(self) -> DataFrame:
        """All visible dated items by time, the newest with the greatest score."""
        items = self.table("items").where(~F.coalesce("is_hidden", F.lit(False)) & F.col("timestamp").isNotNull())
        return items.select("item_id", F.unix_micros(F.col("timestamp").cast("timestamp")).cast("double").alias("score"))

    def session(self, recent: DataFrame, neighbours: DataFrame, n: int = 10, context: int = 100, category: str | None = None) -> DataFrame:
        """Recommendations for feedback sent along (RC22)."""
        items = self.table("items") if category else None
        return recommend.session(recent, neighbours, n, context, category, items)

    def neighbours(self, collection: str, name: str, owner: str, categories: list[str] | None = None, begin: int = 0, end: int = -1) -> DataFrame:
        """An item's or a user's list of neighbours, with the rows of the items or users."""
        from skein.operators.rank import enriched

        kind, key = ("items", "item_id") if collection == "item-to-item" else ("users", "user_id")
        found = self.search(collection, f"{name}/{owner}", categories, begin, end)
        return enriched(found.select(F.col("id").alias(key), "score"), self.table(kind), key)

    def statistics(self) -> DataFrame:
        return interactions.statistics(self.table("users"), self.table("items"), self.classified())

    def add_points(self, rows: DataFrame) -> None:
        self._put("points", cache.add_points(self.table("points"), rows))

    def series(self, name: str, begin: str, end: str, seconds: int = 86_400) -> DataFrame:
        """A dashboard's time series: the last point of each bucket (QP5)."""
        return cache.bucket_points(self.table("points").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")), name, begin, end, seconds)

    def set_value(self, name: str, value: str) -> None:
        batch = self.spark.createDataFrame([(name, value)], schema.META)
        self._put("meta", cache.set_values(self.table("meta"), batch, [F.asc("value")]))

    def get_value(self, name: str) -> str | None:
        return cache.get_value(self.table("meta"), name)

    def delete_value(self, name: str) -> None:
        self._put("meta", cache.delete_value(self.table("meta"), name))

    def export_lines(self, name: str, path: str) -> None:
        files.export_lines(self.table(name), path, self.as_of if name == "feedback" else None)

    def import_lines(self, kind: str, path: str) -> int:
        """Insert a JSON-lines file; feedback overwrites. Gives the number of rejected lines."""
        rows, rejected = files.import_lines(self.spark, kind, path)
        if kind == "feedback":
            self.insert_feedback(rows, overwrite=True)
        else:
            (self.insert_users if kind == "users" else self.insert_items)(rows)
        return rejected.count()

    def add_scores(self, rows: DataFrame) -> None:
        self._put("scores", cache.add_scores(self.table("scores"), rows))

    def search(self, collection: str, subset: str = "", categories: list[str] | None = None, begin: int = 0, end: int = -1) -> DataFrame:
        return cache.search_scores(self.table("scores"), collection, subset, categories, begin, end)

    def purge(self) -> None:
        for name in _SCHEMAS:
            self._versions(name).drop()
