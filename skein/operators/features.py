"""IDF weights, scalers and feature indexes (AG4 to AG7, AG15 to AG18, JN1's dictionaries)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.lineage import Scratch

LEAST_IDF = 1e-3
RANGES = 64  # into which a feature's distinct values are cut


def idf(tokens: DataFrame, total: int) -> DataFrame:
    """``token, freq, idf`` with ``idf = max(ln(total / freq), 0.001)`` from ``token`` rows, repeats counted (AG4 to AG7)."""
    freq = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    return freq.select("token", "freq", F.greatest(F.log(F.lit(float(total)) / F.col("freq")), F.lit(LEAST_IDF)).alias("idf"))


def dictionary(values: DataFrame, column: str) -> DataFrame:
    """``column, index, freq``: dense ids from 0 by the value's order, with its count (FreqDict).

    Ids are given by ranges: values are counted, sorted into range partitions, and each partition starts where those before it end.
    """
    counted = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("freq"))
    ranged = counted.sort(column).withColumn("_m", F.monotonically_increasing_id())
    part, row = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    placed = ranged.select(column, "freq", part.alias("_p"), row.alias("_r"))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    starts = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_s"))
    return placed.join(F.broadcast(starts), "_p").select(column, (F.col("_s") + F.col("_r")).alias("index"), "freq")


def robust_fit(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, median, q1, q3, iqr`` of each feature: quartiles are the values at index n/4 and 3n/4, median the middle one or the mean of the two, an iqr of 0 is 1 (AG15).

    Equal values are counted first; each feature's distinct values are then cut into ranges of about equal size, so
    neither its rows nor all its values are ever one task's.
    """
    scratch = Scratch(df.sparkSession, "robust")
    tallied = scratch.cut(df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("key"), F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("c")))
    edges = scratch.cut(tallied.groupBy("key").agg(F.percentile_approx("x", [i / RANGES for i in range(1, RANGES)], 1000).alias("edges")))
    ranged = tallied.join(edges, "key").select("key", "x", "c", F.size(F.filter("edges", lambda e: e < F.col("x"))).alias("range"))
    sums = ranged.groupBy("key", "range").agg(F.sum("c").alias("size"))
    w = Window.partitionBy("key")
    sums = sums.select("key", "range", (F.sum("size").over(w.orderBy("range")) - F.col("size")).alias("ahead"), F.sum("size").over(w).alias("n"))
    ranked = ranged.join(sums, ["key", "range"]).withColumn("upto", F.col("ahead") + F.sum("c").over(Window.partitionBy("key", "range").orderBy("x")))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("x")))
    fitted = ranked.groupBy("key").agg(
        at(F.floor(F.col("n") / 4)).alias("q1"), at(F.floor(3 * F.col("n") / 4)).alias("q3"), at(F.floor(F.col("n") / 2)).alias("m1"), at(F.floor((F.col("n") - 1) / 2)).alias("m0")
    )
    spread = F.col("q3") - F.col("q1")
    return fitted.select("key", ((F.col("m0") + F.col("m1")) / 2).alias("median"), "q1", "q3", F.when(spread == 0, 1.0).otherwise(spread).alias("iqr"))


def minmax_fit(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, low, high`` (AG16)."""
    return df.groupBy(F.col(key).alias("key")).agg(F.min(F.col(value).cast("double")).alias("low"), F.max(F.col(value).cast("double")).alias("high"))


def minmax(x: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, 0.0).otherwise((x - low) / (high - low))


def auto_scaled(df: DataFrame, key: str, value: str) -> DataFrame:
    """``df`` with ``scaled``: features with a negative value by median and iqr, others by ln(1 + x), then all from least to greatest into 0..1 (AG17)."""
    fit = robust_fit(df, key, value).join(df.groupBy(F.col(key).alias("key")).agg((F.min(value) < 0).alias("negative")), "key")
    x = F.col(value).cast("double")
    joined = df.join(fit.withColumnRenamed("key", "_key"), F.col(key) == F.col("_key"))
    first = joined.withColumn("_x", F.when(F.col("negative"), (x - F.col("median")) / F.col("iqr")).otherwise(F.log1p(F.greatest(x, F.lit(0.0)))))
    ends = first.groupBy(F.col(key).alias("_k2")).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    return first.join(ends, F.col(key) == F.col("_k2")).select(*df.columns, minmax(F.col("_x"), F.col("_lo"), F.col("_hi")).alias("scaled"))


def numeric_features(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, numeric``: whether a feature has any value other than 1 (AG18)."""
    return df.groupBy(F.col(key).alias("key")).agg((F.count_if(F.col(value) != 1) > 0).alias("numeric"))
