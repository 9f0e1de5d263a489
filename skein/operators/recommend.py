"""Candidate lists, their union by priority, exclusion, fallback and paging, for all users at once (RC12 to RC17, RC21 to RC25, SE1 to SE5, QP1 to QP5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.predicates import fresh, has_all, visible
from skein.lineage import Scratch
from skein.operators.interactions import exclude


def _top(rows: DataFrame, n: int, owner: str = "user_id", item: str = "item_id") -> DataFrame:
    best = Window.partitionBy(owner).orderBy(F.desc("score"), item)
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def latest_positives(positives: DataFrame, n: int) -> DataFrame:
    """The ``n`` latest positives of each user, of one time the smaller item first (WN6, WN7)."""
    w = Window.partitionBy("user_id").orderBy(F.desc("timestamp"), "item_id")
    return positives.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def item_to_item_candidates(positives: DataFrame, neighbours: DataFrame, n: int, context: int | None = None, seen: DataFrame | None = None) -> DataFrame:
    """``user_id, item_id, score, rank``: neighbours of a user's positives, scores summed (JN5, RC15). ``context`` keeps the latest positives only (WN7)."""
    if context is not None:
        positives = latest_positives(positives, context)
    near = neighbours.select(F.col("id").alias("item_id"), "neighbour", "score")
    rows = positives.select("user_id", "item_id").join(near, "item_id").groupBy("user_id", F.col("neighbour").alias("item_id")).agg(F.round(F.sum("score"), 6).alias("score"))
    return _top(exclude(rows, seen) if seen is not None else rows, n)


def user_to_user_candidates(neighbours: DataFrame, positives: DataFrame, n: int, items: DataFrame | None = None, as_of: str | None = None, ttl_days: float = 0, category: str | None = None, seen: DataFrame | None = None) -> DataFrame:
    """``user_id, item_id, score, rank``: positives of similar users, their scores summed; the best ``n``, then without hidden, expired and other categories' (JN6, RC14)."""
    near = neighbours.select(F.col("id").alias("user_id"), F.col("neighbour").alias("other"), "score")
    liked = positives.select(F.col("user_id").alias("other"), "item_id").distinct()
    rows = near.join(liked, "other").groupBy("user_id", "item_id").agg(F.round(F.sum("score"), 6).alias("score"))
    top = _top(exclude(rows, seen) if seen is not None else rows, n)
    return top if items is None else servable(top, items, as_of, ttl_days, category)


def servable(rows: DataFrame, items: DataFrame, as_of: str | None = None, ttl_days: float = 0, category: str | None = None) -> DataFrame:
    """Rows whose item exists, isn't hidden, isn't older than the limit, strictly, and is in the category (JN7)."""
    good = items.where(visible())
    if ttl_days and as_of:
        good = good.where(fresh(F.col("timestamp"), as_of, ttl_days, strict=True))
    if category:
        good = good.where(has_all(F.col("categories"), [category]))
    return rows.join(good.select("item_id"), "item_id", "left_semi").select(*rows.columns)


def list_candidates(users: DataFrame, board: DataFrame, n: int, seen: DataFrame | None = None) -> DataFrame:
    """A list of at most ``n`` items, the same for every user, minus what each has seen (RC1, RC2). The list is cut before it meets the users, so ``n`` bounds what is sent to all."""
    head = board.orderBy(F.desc("score"), "item_id").limit(n).select("item_id", "score")
    rows = users.select("user_id").withColumn("_list", F.lit(1)).join(F.broadcast(head.withColumn("_list", F.lit(1))), "_list").drop("_list")
    return _top(exclude(rows, seen) if seen is not None else rows, n)


def seen_pairs(classified: DataFrame, replacement: bool = False) -> DataFrame:
    """What isn't offered again: negatives always, the rest unless items may be replaced (RC16)."""
    return classified.where("kind = 'negative'") if replacement else classified


def cold_users(users: DataFrame, classified: DataFrame) -> DataFrame:
    """Users without positive feedback (RC16)."""
    return users.select("user_id").join(classified.where("kind = 'positive'").select("user_id").distinct(), "user_id", "left_anti")


def sequential(lists: list[DataFrame], limit: int, seen: DataFrame | None = None) -> DataFrame:
    """``user_id, item_id, score, source, rank``: lists one after another, each without what came before, cut at ``limit`` (SE1, RC17).

    ``lists`` have ``user_id, item_id, score, rank``. One window per user over the tagged union stands for the repeated set differences.
    """
    tagged = [df.select("user_id", "item_id", "score", F.lit(i).alias("source"), F.col("rank").alias("_r")) for i, df in enumerate(lists)]
    rows = reduce(DataFrame.unionByName, tagged)
    if seen is not None:
        rows = exclude(rows, seen)
    first = rows.groupBy("user_id", "item_id").agg(F.min(F.struct("source", "_r", "score")).alias("m")).select("user_id", "item_id", "m.*")
    order = Window.partitionBy("user_id").orderBy("source", "_r", "item_id")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("user_id", "item_id", "score", "source", "rank")


def with_replacement(candidates: DataFrame, classified: DataFrame) -> DataFrame:
    """Candidates and, with score 0, the positives and reads of the user that aren't among them (SE5)."""
    old = classified.where("kind <> 'negative'").select("user_id", "item_id").join(candidates.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return candidates.select("user_id", "item_id", "score").unionByName(old.withColumn("score", F.lit(0.0)))


def decayed(scored: DataFrame, classified: DataFrame, positive: float = 0.8, read: float = 0.6) -> DataFrame:
    """``user_id, item_id, score, rank`` with scores of known positives and reads lowered, ranked anew (RC21)."""
    kinds = classified.select("user_id", "item_id", "kind")
    factor = F.when(F.col("kind") == "positive", positive).when(F.col("kind") == "read", read).otherwise(1.0)
    rows = scored.join(kinds, ["user_id", "item_id"], "left").select("user_id", "item_id", F.round(F.col("score") * factor, 6).alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id")))


def session(recent: DataFrame, neighbours: DataFrame, n: int, context: int, category: str | None = None, items: DataFrame | None = None) -> DataFrame:
    """``session_id, item_id, score, rank`` for feedback sent with the request (RC22): ``session_id, item_id, timestamp``.

    The newest positives first; only those with neighbours count, and of them the first ``context``. What was sent
    isn't offered; no category is no filter.
    """
    near = neighbours.select(F.col("id").alias("item_id"), "neighbour", "score")
    known = recent.groupBy("session_id", "item_id").agg(F.max("timestamp").alias("timestamp")).join(near.select("item_id").distinct(), "item_id", "left_semi")
    w = Window.partitionBy("session_id").orderBy(F.desc("timestamp"), "item_id")
    used = known.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= context)
    rows = used.join(near, "item_id").groupBy("session_id", F.col("neighbour").alias("item_id")).agg(F.round(F.sum("score"), 6).alias("score"))
    rows = rows.join(recent.select("session_id", "item_id").distinct(), ["session_id", "item_id"], "left_anti")
    if items is not None:
        rows = servable(rows, items, category=category)
    return _top(rows, n, "session_id")


def inner_product_candidates(user_factors: DataFrame, item_factors: DataFrame, n: int, seen: DataFrame, items: DataFrame, blocks: int | None = None) -> DataFrame:
    """``user_id, item_id, score, rank`` by dot product of factors (``id, vector``), in blocks (RC12, JN9).

    Each user searches for ``n`` items more than they have seen themselves; then seen, missing and hidden ones go.
    """
    from skein.operators.similarity import vector_neighbours

    counts = seen.select("user_id", "item_id").distinct().groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("more"))
    asking = user_factors.join(counts, "id", "left").na.fill(0, ["more"])
    good = item_factors.join(items.where(visible()).select(F.col("item_id").alias("id")), "id", "left_semi")
    near = vector_neighbours(good, n, "dot", queries=asking, blocks=blocks)
    rows = near.select(F.col("id").alias("user_id"), F.col("neighbour").alias("item_id"), (-F.col("distance")).alias("score"))
    return _top(exclude(rows, seen), n)


def search(scores: DataFrame, collection: str, users: DataFrame, read: DataFrame, begin: int, n: int, categories: list[str] | None = None) -> DataFrame:
    """``user_id, item_id, score, rank``: a page of each user's list without what they have read (QP1). ``rank`` counts what remains."""
    rows = scores.where((F.col("collection") == collection) & visible())
    if categories:
        rows = rows.where(has_all(F.col("categories"), categories))
    rows = rows.select(F.col("subset").alias("user_id"), F.col("id").alias("item_id"), "score").join(users.select("user_id"), "user_id", "left_semi")
    best = Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id")
    kept = exclude(rows.select("user_id", "item_id", "score"), read).withColumn("rank", F.row_number().over(best))
    return kept.where((F.col("rank") > begin) & (F.col("rank") <= begin + n))


def filled_list(users: DataFrame, board: DataFrame, n: int, seen: DataFrame) -> DataFrame:
    """``user_id, item_id, score, rank``: the ``n`` first items of ``board`` (``item_id, score``) that each user hasn't seen.

    Users meet the head of the list; those who are still short meet a head four times as long, until the list ends. A
    user meets more than about four times ``n`` items only for having seen most of them, so rows grow with ``seen``.
    """
    scratch = Scratch(users.sparkSession, "filled")
    size, depth = board.count(), 2 * n
    todo, done = users.select("user_id").distinct(), []
    while True:
        rows = scratch.cut(list_candidates(todo, board, depth, seen).where(F.col("rank") <= n))
        if depth >= size:
            done.append(rows)
            break
        full = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= n).select("user_id")
        done.append(rows.join(full, "user_id", "left_semi"))
        todo = scratch.cut(todo.join(full, "user_id", "left_anti"))
        if todo.isEmpty():
            break
        depth *= 4
    return reduce(DataFrame.unionByName, done)


def latest_page(board: DataFrame, users: DataFrame, read: DataFrame, begin: int, n: int) -> DataFrame:
    """The newest items without what each user has read, then the offset (QP2)."""
    return filled_list(users, board, begin + n, read).where(F.col("rank") > begin)


def write_back(feedback: DataFrame, served: DataFrame, kind: str, as_of: str, delay_s: int = 0) -> DataFrame:
    """Feedback and what was served, dated ``delay_s`` after ``as_of``, so it counts from then on (RC23)."""
    at = F.lit(as_of).cast("timestamp_ntz") + F.expr(f"make_dt_interval(0, 0, 0, {delay_s})")
    rows = served.select(F.lit(kind).alias("feedback_type"), "user_id", "item_id", F.lit(0.0).alias("value"), at.alias("timestamp"), F.lit(as_of).cast("timestamp_ntz").alias("updated"), F.lit("").alias("comment"))
    return feedback.unionByName(rows)


def refresh(users: DataFrame, active: DataFrame, stale: DataFrame, lists: list[DataFrame], fallback: list[DataFrame], limit: int, seen: DataFrame) -> DataFrame:
    """Lists of all users that are active and whose list is stale (RC24): the recommenders in order, then the fallbacks."""
    who = users.select("user_id").join(active.select("user_id"), "user_id", "left_semi").join(stale.select("user_id"), "user_id", "left_semi")
    mine = [df.join(who, "user_id", "left_semi") for df in [*lists, *fallback]]
    return sequential(mine, limit, seen)
