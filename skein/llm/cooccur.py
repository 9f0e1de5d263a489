"""Items that appear together: a blocked Gram matrix of binary baskets (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.ids import clean_id
from skein.lineage import Scratch
from skein.operators.hot_keys import salted_join

WHOLE = 2000  # baskets up to so many items are one item block
PAIRS_AT_ONCE = 4_000_000
HOT_LISTED = 1000


def _product(left: np.ndarray, lo: np.ndarray, right: np.ndarray, ro: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Entries of the transpose-product of one record block: the upper triangle where a record has no right block."""
    ls, rs = np.diff(lo), np.diff(ro)
    for size in np.unique(ls[(rs == 0) & (ls > 1)]):
        records = np.flatnonzero((ls == size) & (rs == 0))
        i, j = np.triu_indices(size, 1)
        step = max(1, PAIRS_AT_ONCE // len(i))
        for k in range(0, len(records), step):
            block = np.sort(left[lo[records[k : k + step], None] + np.arange(size)], axis=1)
            yield block[:, i].ravel(), block[:, j].ravel()
    for r in np.flatnonzero((rs > 0) & (ls > 0)):
        a, b = left[lo[r] : lo[r + 1]], right[ro[r] : ro[r + 1]]
        step = max(1, PAIRS_AT_ONCE // len(b))
        for k in range(0, len(a), step):
            x, y = np.repeat(a[k : k + step], len(b)), np.tile(b, len(a[k : k + step]))
            yield np.minimum(x, y), np.maximum(x, y)


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*held))
        items, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
        cells, counts = np.unique(codes[: len(a)].astype(np.int64) * len(items) + codes[len(a) :], return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(items[cells // len(items)]), pa.array(items[cells % len(items)]), pa.array(counts.astype(np.int64))], ["a", "b", "n"])

    for batch in batches:
        cols = [batch.column(i) for i in (0, 1)]
        arrays = [(c.flatten().to_numpy(zero_copy_only=False).astype(np.int64), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in cols]
        for a, b in _product(*arrays[0], *arrays[1]):
            held.append((a, b))
            size += len(a)
            if size >= PAIRS_AT_ONCE:
                yield flush()
                size = 0
    if held:
        yield flush()


def together(baskets: DataFrame, min_count: int = 5, min_lift: float = 5.0, whole: int = WHOLE) -> DataFrame:
    """``item_a, item_b, n_ab, n_a, n_b, n_baskets, lift`` of the pairs of items taken together often and beyond chance.

    ``baskets`` has ``k1, k2, item``: the two-part key of a basket and an item in it; rows with a null are left out and
    repeated rows count once. A pair comes out if ``n_ab >= min_count`` and ``n_ab * N >= min_lift * n_a * n_b`` over
    the N baskets. Since ``n_ab`` is at most either marginal, items in fewer than ``min_count`` baskets or in more than
    ``N / min_lift`` can be in no such pair; they leave first, which loses nothing. Baskets become sparse rows of item
    codes; each block of records is multiplied with its transpose and summed on the spot, then the blocks' partial
    counts are summed. A basket of more than ``whole`` items is cut into item blocks, and each pair of blocks is a
    record of its own, so no task holds a large basket. An empty table gives no rows.
    """
    spark = baskets.sparkSession
    scratch = Scratch(spark, "together")
    rows = scratch.cut(baskets.select("k1", "k2", "item").where("k1 is not null and k2 is not null and item is not null").distinct())
    sizes = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("size"), F.lit(0)).alias("most")).first()
    n = total["n"]
    counted = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    limit = int(n / min_lift + 1e-9)
    items = scratch.cut(counted.where(F.col("n") >= min_count).withColumn("code", F.monotonically_increasing_id()))
    hot = [r["item"] for r in items.where(F.col("n") > limit).orderBy(F.desc("n"), "item").limit(HOT_LISTED).collect()]  # spares the join the largest keys; what isn't listed goes in it
    kept = salted_join(rows.where(~F.col("item").isin(hot)) if hot else rows, items.where(F.col("n") <= limit).select("item", "code"), "item").select("k1", "k2", "code")
    none = F.array().cast("array<bigint>")
    if total["most"] <= whole:
        records = kept.groupBy("k1", "k2").agg(F.collect_list("code").alias("left")).where("size(left) > 1").select("left", none.alias("right"))
    else:
        large = scratch.cut(sizes.where(F.col("size") > whole))
        small = kept.join(large, ["k1", "k2"], "left_anti").groupBy("k1", "k2").agg(F.collect_list("code").alias("left")).where("size(left) > 1").select("left", none.alias("right"))
        parts = kept.join(large, ["k1", "k2"]).withColumn("parts", F.ceil(F.col("size") * 2 / F.lit(whole)).cast("int")).withColumn("part", F.pmod(F.xxhash64("code"), F.col("parts")).cast("int"))
        parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
        cross = parts.groupBy("k1", "k2", "i", "j").agg(F.collect_list(F.when(F.col("part") == F.col("i"), F.col("code"))).alias("left"), F.collect_list(F.when(F.col("part") != F.col("i"), F.col("code"))).alias("right"))
        # a pair of different blocks of which one is empty has no cell
        records = small.unionByName(cross.where("i = j or (size(left) > 0 and size(right) > 0)").select("left", "right"))
    cells = records.mapInArrow(_gram, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= min_count)
    side = lambda s: items.select(F.col("code").alias(s), F.col("item").alias(f"i_{s}"), F.col("n").alias(f"n_{s}"))
    named = cells.join(side("a"), "a").join(side("b"), "b").withColumn("n_baskets", F.lit(n).cast("long"))
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    named = named.where(wide("n_ab") * wide("n_baskets") >= F.lit(min_lift).cast("decimal(10,4)") * (wide("n_a") * wide("n_b")).cast("decimal(27,0)"))
    ordered = F.col("i_a") < F.col("i_b")
    pick = lambda x, y: F.when(ordered, F.col(x)).otherwise(F.col(y))
    return named.select(
        F.least("i_a", "i_b").alias("item_a"), F.greatest("i_a", "i_b").alias("item_b"), "n_ab", pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"), "n_baskets",
        (F.col("n_ab") / (F.col("n_a") / F.col("n_baskets")) / F.col("n_b")).alias("lift"),
    )


def daily_baskets(feedback: DataFrame) -> DataFrame:
    """``k1, k2, item``: what one trimmed user touches on one day; blank ids and null times make nulls."""
    return feedback.select(clean_id("user_id").alias("k1"), F.to_date("timestamp").alias("k2"), clean_id("item_id").alias("item"))
