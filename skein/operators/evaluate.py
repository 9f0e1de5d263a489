"""Ranking, click-through and online metrics, splits and negative sampling (AG14, AG19 to AG23, WN9 to WN14)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.predicates import matches


def ranking_metrics(lists: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """One row of means over users with a target: ``users, ndcg, precision, recall, hr, map, mrr`` (AG19).

    ``lists`` has ``user_id, item_id, rank`` from 1, ``targets`` distinct ``user_id, item_id``. Lists are cut at ``k``;
    precision divides by the list's length; NDCG's ideal has as many hits as targets, ``k`` at most.
    """
    wanted = targets.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_target"))
    hits = lists.where(F.col("rank") <= k).join(targets.withColumn("hit", F.lit(1)), ["user_id", "item_id"], "left")
    hit = F.coalesce("hit", F.lit(0))
    seen = F.sum(hit).over(Window.partitionBy("user_id").orderBy("rank"))
    rows = hits.withColumn("upto", seen)
    per = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"), F.sum(hit / F.log2(F.col("rank") + 1.0)).alias("dcg"),
        F.sum(hit * F.col("upto") / F.col("rank")).alias("ap"), F.min(F.when(hit == 1, F.col("rank"))).alias("first"),
    )
    per = wanted.join(per, "user_id", "left").na.fill(0, ["n", "hits", "dcg", "ap"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_target", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return per.agg(
        F.count(F.lit(1)).alias("users"), F.avg(F.col("dcg") / ideal).alias("ndcg"), F.avg(F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0)).alias("precision"),
        F.avg(F.col("hits") / F.col("n_target")).alias("recall"), F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0)).alias("hr"),
        F.avg(F.col("ap") / F.col("n_target")).alias("map"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
    )


def click_metrics(predictions: DataFrame) -> DataFrame:
    """``precision, recall, accuracy`` of logits ``score`` against ``target`` +1 / -1 at threshold 0; a negative is right only below 0 (AG20)."""
    tp, fp = F.count_if((F.col("target") > 0) & (F.col("score") > 0)), F.count_if((F.col("target") < 0) & (F.col("score") > 0))
    pos, right = F.count_if(F.col("target") > 0), F.count_if(((F.col("target") > 0) & (F.col("score") > 0)) | ((F.col("target") < 0) & (F.col("score") < 0)))
    none = F.lit(0.0)
    return predictions.agg(
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(none).alias("precision"), F.when(pos > 0, tp / pos).otherwise(none).alias("recall"),
        F.when(F.count(F.lit(1)) > 0, right / F.count(F.lit(1))).otherwise(none).alias("accuracy"),
    )


def _auc(predictions: DataFrame, group: list[str]) -> DataFrame:
    """``group.., auc, n``. Scores are tallied before ranking, so one task gets distinct scores at most; over all rows ranks go by score ranges."""
    tally = predictions.groupBy(*group, "score").agg(F.count_if(F.col("target") > 0).alias("p"), F.count_if(F.col("target") < 0).alias("n"))
    if group:
        below = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = tally.withColumn("below", below)
    else:
        ranged = tally.repartitionByRange(F.col("score")).withColumn("part", F.spark_partition_id())
        sums = ranged.groupBy("part").agg(F.sum("n").alias("size"))
        ahead = sums.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("ahead"))  # a row a partition
        inner = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = ranged.withColumn("inner", inner).join(F.broadcast(ahead), "part").withColumn("below", F.col("inner") + F.col("ahead"))
    cells = F.sum("p") * F.sum("n")
    return rows.groupBy(*group).agg(F.when(cells > 0, F.sum(F.col("p") * F.col("below")) / cells).otherwise(0.0).alias("auc"), (F.sum("p") + F.sum("n")).alias("n"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def auc(predictions: DataFrame) -> DataFrame:
    """``auc``: share of (negative, positive) pairs with the negative strictly lower; ties count nothing (AG21)."""
    return _auc(predictions, []).select("auc")


def gauc(predictions: DataFrame, train_positives: DataFrame, context: int) -> DataFrame:
    """``gauc, users``: AUC by user weighted by candidates, over users with both classes and 1 to ``context`` training positives (AG23)."""
    known = train_positives.groupBy("user_id").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= context)
    rows = _auc(predictions, ["user_id"]).where("positives > 0 and negatives > 0").join(known, "user_id", "left_semi")
    return rows.agg((F.sum(F.col("auc") * F.col("n")) / F.sum("n")).alias("gauc"), F.count(F.lit(1)).alias("users"))


def rmse(predictions: DataFrame) -> DataFrame:
    """``rmse`` (AG22)."""
    return predictions.agg(F.sqrt(F.avg((F.col("score") - F.col("target")) * (F.col("score") - F.col("target")))).alias("rmse"))


def online_ratio(feedback: DataFrame, read: list[str], positive: list[str], as_of: str, days: int = 30) -> DataFrame:
    """``day, feedback_type, ratio``: mean over users of the share of a day's read items that became positive (AG14).

    The type "" is any of them. Users without a positive of the type are passed over; feedback isn't filtered otherwise.
    """
    day = F.to_date("timestamp")
    rows = feedback.withColumn("day", day).where((F.col("timestamp") <= F.lit(as_of).cast("timestamp_ntz")) & (F.col("day") > F.date_sub(F.lit(as_of).cast("date"), days)))
    reads = rows.where(matches(read)).select("user_id", "item_id", "day").distinct()
    parts = [rows.where(matches([p])).select("user_id", "item_id", F.lit(p).alias("feedback_type")) for p in positive] + [rows.where(matches(positive)).select("user_id", "item_id", F.lit("").alias("feedback_type"))]
    good = parts[0]
    for p in parts[1:]:
        good = good.unionByName(p)
    good = good.distinct()
    both = reads.join(good, ["user_id", "item_id"]).groupBy("day", "feedback_type", "user_id").agg(F.count(F.lit(1)).alias("hits"))
    have = good.select("user_id", "feedback_type").distinct()
    totals = reads.groupBy("day", "user_id").agg(F.count(F.lit(1)).alias("reads"))
    ratio = totals.join(have, "user_id").join(both, ["day", "feedback_type", "user_id"], "left")
    return ratio.groupBy("day", "feedback_type").agg(F.round(F.avg(F.coalesce("hits", F.lit(0)) / F.col("reads")), 6).alias("ratio"))


def drawn(seed: int, *keys: str) -> Column:
    """A draw for each row: the MD5 of the seed and the keys, in which any SQL can order rows alike."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *keys))


def leave_one_out(positives: DataFrame, seed: int = 0, test_users: int = 0) -> DataFrame:
    """``positives`` with ``is_test``: one positive of each user, drawn by seed, user and item (WN9).

    With ``test_users`` above 0 only so many users, drawn alike, have a test row; the others only train.
    """
    least = positives.groupBy("user_id").agg(F.min(F.struct(drawn(seed, "user_id", "item_id").alias("d"), "item_id")).getField("item_id").alias("_test"))
    if test_users > 0:
        least = least.orderBy(drawn(seed, "user_id"), "user_id").limit(test_users)
    return positives.join(least, "user_id", "left").withColumn("is_test", F.coalesce(F.col("item_id") == F.col("_test"), F.lit(False))).select(*positives.columns, "is_test")


def latest_split(positives: DataFrame, shots: int) -> DataFrame:
    """``positives`` with ``part``: the newest of each user is test, the next ``shots`` train, the rest neither (WN10)."""
    w = Window.partitionBy("user_id").orderBy(F.desc("timestamp"), "item_id")
    rn = F.row_number().over(w)
    return positives.withColumn("rn", rn).where(F.col("rn") <= shots + 1).withColumn("part", F.when(F.col("rn") == 1, "test").otherwise("train")).drop("rn")


def random_split(samples: DataFrame, ratio: float = 0.2, seed: int = 0, keys: tuple[str, ...] = ("user_id", "item_id")) -> DataFrame:
    """``samples`` with ``is_test``: the ``int(n * ratio)`` rows of the least draws (WN11). Rows of equal keys stay together.

    Counts by a draw's first four digits tell in which slice of the draws the bound lies; only that slice is sorted.
    """
    hashed = samples.withColumn("_h", drawn(seed, *keys))
    piece = F.substring("_h", 1, 4)
    counts = hashed.groupBy(piece.alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect()  # at most 65,536
    left = int(sum(r["n"] for r in counts) * ratio)
    if left <= 0:
        return samples.withColumn("is_test", F.lit(False))
    for r in counts:
        if left <= r["n"]:
            break
        left -= r["n"]
    edge = hashed.where(piece == r["b"]).select("_h").orderBy("_h").limit(left).agg(F.max("_h").alias("e")).first()["e"]
    return hashed.withColumn("is_test", F.col("_h") <= edge).drop("_h")


def split_by_user_time(samples: DataFrame, ratio: float = 0.2) -> DataFrame:
    """``samples`` with ``is_test``: of each user the last ``int(n * ratio)`` by time, at least 1 of more than one, never all (WN12).

    Counts by user and day tell how many rows of each day are test rows, so rows are ranked within a day only.
    """
    dated = samples.withColumn("_day", F.coalesce(F.unix_date(F.to_date("timestamp")), F.lit(-(1 << 31))))
    days = dated.groupBy("user_id", "_day").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("user_id")
    n = F.sum("_c").over(w)
    take = F.when(n > 1, F.least(F.greatest(F.floor(n * F.lit(ratio)), F.lit(1)), n - 1)).otherwise(0)
    days = days.select("user_id", "_day", (take - (F.sum("_c").over(w.orderBy(F.desc("_day"))) - F.col("_c"))).alias("_left"))
    back = F.row_number().over(Window.partitionBy("user_id", "_day").orderBy(F.desc("timestamp"), F.desc("item_id")))
    return dated.join(days, ["user_id", "_day"]).withColumn("is_test", back <= F.col("_left")).select(*samples.columns, "is_test")


def sample_negatives(users: DataFrame, items: DataFrame, known: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``user_id, item_id``: ``n`` items of each user that aren't among their ``known`` ones, all of them if there are at most ``n`` (WN14).

    Items get dense numbers; each user walks through a permutation of the numbers of their own, made by hashes, so no
    number comes twice. As many steps as ``n`` and the user's known items together can't miss: known items leave, and
    the first ``n`` stay. No user meets all items unless nearly all are known.
    """
    from skein.operators.features import dictionary

    numbered = dictionary(items, "item_id").select("item_id", "index")
    size = numbered.count()
    if not size:
        return known.select("user_id", "item_id").limit(0)
    # numbers are cells of a grid of a x b, of near-square ones that with the fewest cells beyond the last number
    a = min(range(max(1, math.isqrt(size) // 2), math.isqrt(size) + 1), key=lambda a: (-size % a, -a))
    b = -(-size // a)
    pairs = known.select("user_id", "item_id").distinct()
    counts = pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("known"))
    steps = F.least(F.lit(a * b), F.coalesce("known", F.lit(0)) + F.lit(n + a * b - size))

    def number(draw: Column) -> Column:
        """A Feistel network on the grid: half rounds move one coordinate by a hash of the other, in turn."""

        def half(at: Column, r: Column) -> Column:
            x, y = at["x"], at["y"]
            move = lambda z, by, size: F.pmod(z + F.pmod(F.xxhash64(F.lit(seed), r, "user_id", by), F.lit(size)), F.lit(size)).cast("bigint")
            return F.struct(F.when(r % 2 == 0, move(x, y, a)).otherwise(x).alias("x"), F.when(r % 2 == 1, move(y, x, b)).otherwise(y).alias("y"))

        start = F.struct(F.floor(draw / b).cast("bigint").alias("x"), (draw % b).cast("bigint").alias("y"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(7)), start, half, lambda at: at["x"] * b + at["y"])

    # the numbers of a user's draws are made in the array that is exploded, so each is made once
    draws = F.transform(F.sequence(F.lit(0).cast("bigint"), steps - 1), lambda d: F.struct(d.alias("draw"), number(d).alias("index")))
    drawn = users.select("user_id").distinct().join(counts, "user_id", "left").select("user_id", F.explode(draws).alias("d")).select("user_id", "d.draw", "d.index").where(F.col("index") < size)
    # known items leave by their numbers, so only what is drawn for good meets the items
    held = pairs.join(numbered, "item_id").select("user_id", "index")
    rows = drawn.join(held, ["user_id", "index"], "left_anti").withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("draw"))).where(F.col("rn") <= n)
    return rows.select("user_id", "index").join(numbered, "index").select("user_id", "item_id")
