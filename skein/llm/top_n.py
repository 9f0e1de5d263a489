"""Top N items within every group, by descending score bands (problem 7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from skein.functions.ids import clean_id, micros
from skein.lineage import Scratch

BAND_QUANTILES = (0.95, 0.75)


def standing_scores(scores: DataFrame) -> DataFrame:
    """``collection, subset, id, score``: of each (collection, subset, id) the row of the latest time, if it counts.

    Ids are trimmed; blank ids are none. A null time is before all others. Of rows of one time the greatest score
    stands, NaN being greatest and null least, then a hidden one. After that hidden rows and null or NaN scores go; a
    null flag means not hidden. Infinite scores are scores. Null collections and subsets are groups of their own.
    """
    rows = scores.select("collection", "subset", clean_id("id").alias("id"), F.col("score").cast("double").alias("score"), F.coalesce("is_hidden", F.lit(False)).alias("hidden"), micros(scores, "timestamp").alias("t")).where("id is not null")
    last = rows.groupBy("collection", "subset", "id").agg(F.max(F.struct("t", "score", "hidden")).alias("last"))
    return last.select("collection", "subset", "id", F.col("last.score").alias("score"), "last.hidden").where("not hidden and score is not null and not isnan(score)").drop("hidden")


def top_n(rows: DataFrame, n: int = 10, quantiles: tuple[float, ...] = BAND_QUANTILES) -> DataFrame:
    """``collection, subset, id, score, rank`` of the first ``n`` ids of each group by score descending, id ascending.

    ``rows`` has ``collection, subset, id, score``, an id once a group, scores neither null nor NaN. Scores are cut
    into bands at quantiles of their collection, and the bands are written apart. From the top band down, groups that
    are full are anti-joined away, the rest is ranked exactly within the band, and ranks go on from the bands above.
    Equal scores share a band, so ties are ranked by id alone. The rank limit works before the shuffle, so a group of
    millions sends ``n`` rows a task. Groups smaller than ``n`` come out whole; an empty table gives no rows.
    """
    group = ["collection", "subset"]
    scratch = Scratch(rows.sparkSession, "topn")
    cuts = rows.groupBy(F.col("collection").alias("c")).agg(F.percentile_approx("score", list(quantiles), 1000).alias("cuts"))
    placed = rows.join(cuts, F.col("collection").eqNullSafe(F.col("c")), "left")
    band = F.coalesce(*[F.when(F.col("score") >= F.col("cuts")[i], i) for i in range(len(quantiles))], F.lit(len(quantiles)))
    path = f"{scratch.root}/bands"
    placed.select(*group, "id", "score", band.cast("int").alias("band")).write.partitionBy("band").parquet(path)
    banded = rows.sparkSession.read.schema(placed.select(*group, "id", "score").schema.add("band", IntegerType())).parquet(path)
    best = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc("id"))
    done: list[DataFrame] = []
    for i in range(len(quantiles) + 1):
        live = banded.where(F.col("band") == i).drop("band")
        if done:
            have = reduce(DataFrame.unionByName, done).groupBy(F.col("collection").alias("hc"), F.col("subset").alias("hs")).agg(F.count(F.lit(1)).alias("have"))
            same = F.col("collection").eqNullSafe(F.col("hc")) & F.col("subset").eqNullSafe(F.col("hs"))
            live = live.join(have.where(F.col("have") >= n), same, "left_anti")
        ranked = live.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= n)
        if done:
            ranked = ranked.join(have, same, "left").withColumn("rn", F.col("rn") + F.coalesce("have", F.lit(0))).where(F.col("rn") <= n)
        done.append(scratch.cut(ranked.select(*group, "id", "score", F.col("rn").cast("int").alias("rank"))))
    return reduce(DataFrame.unionByName, done)
