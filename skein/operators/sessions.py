"""Sessions by inactivity gap, found by pointer doubling (problem 1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.ids import clean_id, micros
from skein.lineage import Scratch

HALF_HOUR_US = 30 * 60 * 1_000_000


def sessionize(df: DataFrame, key: str = "user_id", time: str = "timestamp", gap_us: int = HALF_HOUR_US) -> DataFrame:
    """One row per session: ``key_id, start_us, end_us, n_events`` (microseconds since 1970-01-01).

    A gap of more than ``gap_us`` between neighbouring events of one trimmed key begins a session; exactly ``gap_us``
    does not. Rows with a null or blank key or a null time are left out; repeated rows all count; an empty table gives
    no rows; other columns, whatever their names, aren't looked at.

    Events of one key in one ``gap_us``-wide slot of time always share a session, so a map-side combining aggregate
    first shrinks them to one node per (key, slot): a key that holds a third of all rows becomes as many nodes as it
    has busy slots. A node's predecessor can only be the slot before. Nodes point at their predecessor within the gap,
    and pointers are doubled by self-joins on (key, slot), which no hot key can skew, until all point at roots. Only
    nodes not yet at a root take part in a round; each round is a table in the shared folder.
    """
    if gap_us <= 0:
        raise ValueError("gap_us must be positive")
    scratch = Scratch(df.sparkSession, "sessions")
    events = df.select(clean_id(f"`{key}`").alias("key_id"), micros(df, time).alias("t")).where("key_id is not null and t is not null")
    nodes, path = scratch.write(
        events.groupBy("key_id", F.expr(f"(t - pmod(t, {gap_us}L)) div {gap_us}L").alias("slot"))
        .agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n"))
    )
    before = nodes.select("key_id", (F.col("slot") + 1).alias("slot"), F.col("hi").alias("before"))
    linked = nodes.join(before, ["key_id", "slot"], "left").withColumn("root", F.coalesce(F.col("lo") - F.col("before") > gap_us, F.lit(True)))
    fields = ["key_id", "slot", "ptr", "done", "lo", "hi", "n"]
    latest = scratch.cut(linked.withColumn("ptr", F.when(F.col("root"), F.col("slot")).otherwise(F.col("slot") - 1)).withColumn("done", F.col("root")).select(fields))
    scratch.drop(path)
    settled = [latest.where("done")]
    while True:
        pending = latest.where("not done")
        if pending.isEmpty():
            break
        known = reduce(DataFrame.unionByName, [pending, *settled])
        target = known.select("key_id", F.col("slot").alias("ptr"), F.col("ptr").alias("far"), F.col("done").alias("end"))
        moved = pending.drop("done").join(target, ["key_id", "ptr"]).drop("ptr")
        latest = scratch.cut(moved.withColumnsRenamed({"far": "ptr", "end": "done"}).select(fields))
        settled.append(latest.where("done"))
    return (
        reduce(DataFrame.unionByName, settled)
        .groupBy("key_id", "ptr")
        .agg(F.min("lo").alias("start_us"), F.max("hi").alias("end_us"), F.sum("n").alias("n_events"))
        .select("key_id", "start_us", "end_us", "n_events")
    )
