"""Scored documents, values, queues and time series as tables (CA1 to CA16)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.predicates import has_all, visible

SCORE_KEY = ["collection", "subset", "id"]


def latest_scores(rows: DataFrame) -> DataFrame:
    """Of each (collection, subset, id) the row of the latest time; of one time the greatest score, then the hidden one, then the greatest categories as text."""
    others = [c for c in rows.columns if c not in SCORE_KEY]
    named = F.struct("timestamp", "score", F.coalesce("is_hidden", F.lit(False)).alias("hidden"), F.concat_ws(",", "categories").alias("text"))
    return rows.groupBy(*SCORE_KEY).agg(F.max_by(F.struct(*others), named).alias("row")).select(*SCORE_KEY, *[F.col(f"row.{c}") for c in others])


def add_scores(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new documents; on a known key the new score, categories and time stand, but the old hidden flag (CA1)."""
    known = old.select(*SCORE_KEY, F.col("is_hidden").alias("_hidden"), F.lit(True).alias("_known"))
    fresh = new.join(known, SCORE_KEY, "left").withColumn("is_hidden", F.when(F.col("_known"), F.col("_hidden")).otherwise(F.col("is_hidden")))
    return old.join(new.select(*SCORE_KEY), SCORE_KEY, "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))


def search_scores(scores: DataFrame, collection: str, subset: str, categories: list[str] | None = None, begin: int = 0, end: int = -1) -> DataFrame:
    """Visible documents of a list with all ``categories``, by score then id, from ``begin`` to ``end``; -1 is no end (CA2)."""
    rows = scores.where((F.col("collection") == collection) & (F.col("subset") == subset) & visible())
    if categories:
        rows = rows.where(has_all(F.col("categories"), categories))
    rows = rows.orderBy(F.desc("score"), "id").offset(begin)
    return rows if end < 0 else rows.limit(max(0, end - begin))


def update_scores(scores: DataFrame, collections: list[str], id: str, subset: str | None = None, **patch: object) -> DataFrame:
    """Documents with the columns of ``patch`` changed where the id, and the subset if given, match (CA3)."""
    hit = F.col("collection").isin(collections) & (F.col("id") == id)
    if subset is not None:
        hit = hit & (F.col("subset") == subset)
    for name, value in patch.items():
        new = F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)
        scores = scores.withColumn(name, F.when(hit, new.cast(scores.schema[name].dataType)).otherwise(F.col(name)))
    return scores


def delete_scores(scores: DataFrame, collections: list[str], subset: str | None = None, id: str | None = None, before: str | None = None) -> DataFrame:
    """Documents without those of the collections that meet all given conditions; at least one is needed (CA4)."""
    if subset is None and id is None and before is None:
        raise ValueError("a condition is needed")
    hit = F.col("collection").isin(collections)
    if subset is not None:
        hit = hit & (F.col("subset") == subset)
    if id is not None:
        hit = hit & (F.col("id") == id)
    if before is not None:
        hit = hit & (F.col("timestamp") < F.lit(before).cast("timestamp_ntz"))
    return scores.where(~F.coalesce(hit, F.lit(False)))


def set_values(meta: DataFrame, batch: DataFrame, order: list[Column]) -> DataFrame:
    """``name, value`` after a batch, of which the first of a name counts (CA6)."""
    row = F.row_number().over(Window.partitionBy("name").orderBy(*order))
    new = batch.withColumn("_row", row).where("_row = 1")
    return meta.join(new.select("name"), "name", "left_anti").unionByName(new.select("name", "value"))


def scan_scores(scores: DataFrame) -> DataFrame:
    """Every document's key and time, whichever its list (CA5)."""
    return scores.select(*SCORE_KEY, "timestamp")


def get_value(meta: DataFrame, name: str) -> str | None:
    """A name's value, or None (CA6)."""
    row = meta.where(F.col("name") == name).first()
    return None if row is None else row["value"]


def delete_value(meta: DataFrame, name: str) -> DataFrame:
    """The values without a name's; an unknown name changes nothing (CA6)."""
    return meta.where(~F.col("name").eqNullSafe(F.lit(name)))


def announce(nodes: DataFrame, batch: DataFrame) -> DataFrame:
    """``uuid, kind, host, updated`` of the service's nodes after some have told that they run; the latest word of a node counts (SK16)."""
    others = [c for c in nodes.columns if c != "uuid"]
    last = F.max_by(F.struct(*others), F.struct("updated", "kind", "host"))
    return nodes.unionByName(batch).groupBy("uuid").agg(last.alias("r")).select("uuid", *[F.col(f"r.{c}") for c in others])


def running(nodes: DataFrame, as_of: str, ttl_s: int) -> DataFrame:
    """Nodes heard of less than ``ttl_s`` before ``as_of`` (SK16)."""
    return nodes.where(F.col("updated") > F.lit(as_of).cast("timestamp_ntz") - F.expr(f"make_dt_interval(0, 0, 0, {ttl_s})"))


def tag(category: Column) -> Column:
    """A category as the token of a store that splits tags at most signs: Base64 of ``_`` and the category, without padding (CA11)."""
    return F.rtrim(F.base64(F.encode(F.concat(F.lit("_"), category), "UTF-8")), F.lit("="))


def untag(token: Column) -> Column:
    """The category of a ``tag`` (CA11)."""
    whole = F.rpad(token, F.length(token) + F.pmod(-F.length(token), F.lit(4)), F.lit("="))
    return F.substr(F.decode(F.unbase64(whole), "UTF-8"), F.lit(2))


def push(queue: DataFrame, batch: DataFrame) -> DataFrame:
    """``name, value, timestamp`` of distinct values; pushing again refreshes the time (CA7)."""
    return queue.unionByName(batch).groupBy("name", "value").agg(F.max("timestamp").alias("timestamp"))


def pop(queue: DataFrame, name: str) -> tuple[str | None, DataFrame]:
    """The oldest value of a queue and the queue without it (CA7)."""
    row = queue.where(F.col("name") == name).orderBy("timestamp", "value").first()
    if row is None:
        return None, queue
    return row["value"], queue.where(~((F.col("name") == name) & (F.col("value") == row["value"])))


def remain(queue: DataFrame, name: str) -> int:
    return queue.where(F.col("name") == name).count()


def add_points(old: DataFrame, new: DataFrame) -> DataFrame:
    """``name, timestamp, value``; new points replace those of their name and time (CA8)."""
    return old.join(new.select("name", "timestamp"), ["name", "timestamp"], "left_anti").unionByName(new)


def bucket_points(points: DataFrame, name: str | None, begin: str, end: str, seconds: int) -> DataFrame:
    """The last point of each bucket of ``seconds`` from the epoch on, at the bucket's start (CA9); of one time the greater value.

    ``begin`` and ``end`` are included. All names if ``name`` is None.
    """
    rows = points.where(F.col("timestamp").between(F.lit(begin).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    if name is not None:
        rows = rows.where(F.col("name") == name)
    since = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.date_trunc("second", "timestamp").cast("timestamp_ntz"))
    bucket = since - F.pmod(since, F.lit(seconds))
    start = F.timestamp_add("SECOND", bucket, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return rows.groupBy("name", start.alias("bucket")).agg(F.max(F.struct("timestamp", "value")).getField("value").alias("value")).select("name", F.col("bucket").alias("timestamp"), "value")


def recent_points(points: DataFrame, name: str | None, as_of: str, days: int = 7, seconds: int = 86_400) -> DataFrame:
    """A dashboard's time series of the last ``days`` (QP5)."""
    begin = points.sparkSession.range(1).select((F.lit(as_of).cast("timestamp_ntz") - F.expr(f"make_dt_interval({days})")).cast("string")).first()[0]
    return bucket_points(points, name, begin, as_of, seconds)


def key(*parts: str | Column) -> Column:
    """Parts joined by a slash, empty ones left out (CA10)."""
    return F.concat_ws("/", *[F.nullif(p if isinstance(p, Column) else F.lit(p), F.lit("")) for p in parts])


def collect_garbage(scores: DataFrame, configured: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Documents whose list is configured (``collection, name``; a null name allows any) and whose owner exists (CA13).

    Subsets of user collections are a user id; of ``item-to-item`` and ``user-to-user`` ``name/owner``; else a list's name.
    """
    owned = F.col("collection").isin("item-to-item", "user-to-user")
    by_user = F.col("collection").isin("recommend", "collaborative-filtering")
    parts = F.split("subset", "/", 2)
    rows = scores.withColumn("_name", F.when(owned, parts[0]).when(by_user, F.lit(None)).otherwise(F.col("subset")))
    rows = rows.withColumn("_owner", F.when(owned, F.get(parts, F.lit(1))).when(by_user, F.col("subset")))
    allowed = configured.select(F.col("collection").alias("_c"), F.col("name").alias("_n")).distinct()
    rows = rows.join(allowed, (F.col("collection") == F.col("_c")) & (F.col("_n").isNull() | F.col("_n").eqNullSafe(F.col("_name"))), "left_semi")
    owners = users.select(F.lit("user").alias("_kind"), F.col("user_id").alias("_owner")).unionByName(items.select(F.lit("item").alias("_kind"), F.col("item_id").alias("_owner"))).distinct()
    rows = rows.withColumn("_kind", F.when(F.col("collection") == "item-to-item", "item").when(owned | by_user, "user"))
    free, held = rows.where("_kind is null"), rows.where("_kind is not null")
    return free.select(*scores.columns).unionByName(held.join(owners, ["_kind", "_owner"], "left_semi").select(*scores.columns))


def stale_list(digest: Column, wanted: str, updated: Column, as_of: str, expire_s: int, size: Column) -> Column:
    """Whether a similarity list must be made anew: it is empty, of another configuration, or too old (CA14)."""
    age = F.timestamp_diff("SECOND", updated, F.lit(as_of).cast("timestamp_ntz"))
    return F.coalesce(size, F.lit(0)).eqNullSafe(0) | ~digest.eqNullSafe(F.lit(wanted)) | updated.isNull() | (age > expire_s)


def stale_recommendation(size: Column, digest: Column, wanted: str, updated: Column, active: Column, as_of: str, expire_s: int, idle_s: int) -> Column:
    """The ordered rules for a user's list (CA15): empty; other configuration; never made; made before the last activity; older than ``expire_s`` unless the user has been idle for ``idle_s``."""
    now = F.lit(as_of).cast("timestamp_ntz")
    age, idle = F.timestamp_diff("SECOND", updated, now), F.timestamp_diff("SECOND", active, now)
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, True).when(~digest.eqNullSafe(F.lit(wanted)), True).when(updated.isNull(), True)
        .when(active > updated, True).when(active.isNotNull() & (idle > idle_s), False).otherwise(age > expire_s)
    )


def digests(parts: Column) -> Column:
    """``digest`` of an array column (CA16)."""
    return F.md5(F.concat_ws("", F.array_sort(parts)))


def digest(*parts: str) -> str:
    """MD5 of the sorted parts (CA16)."""
    return hashlib.md5("".join(sorted(parts)).encode()).hexdigest()
