"""References to records that do not exist, by null mask and declared match rule (problem 3)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.ids import clean_id, micros


@dataclass(frozen=True)
class Reference:
    """A (composite) reference: ``columns`` of the referring rows name ``keys`` of ``target``.

    ``match`` tells what nulls mean, as in the SQL standard: ``simple``: a row with any null refers to nothing;
    ``partial``: the columns that aren't null must all agree with one row; ``full``: all or none may be null, a mix is
    an orphan by itself. With ``born``, a time of the target, and ``made``, one of the referring rows, a reference
    whose rows exist but are all younger than it is an orphan too; rows without a time neither help nor harm.
    """

    name: str
    columns: tuple[str, ...]
    target: DataFrame
    keys: tuple[str, ...]
    match: str = "simple"
    made: str | None = None
    born: str | None = None


def _cleaned(df: DataFrame, name: str) -> Column:
    return clean_id(f"`{name}`") if df.schema[name].dataType.typeName() == "string" else F.col(f"`{name}`")


def orphan_references(refs: DataFrame, reference: Reference, period: Column | None = None) -> DataFrame:
    """Distinct orphans: ``ref_table, mask, key_1.., period, n_rows, late``. ``mask`` has 1 for a given column and 0 for a null.

    Strings are trimmed and blanks are nulls. References are counted per (keys, period), with their first time, with
    map-side combining before anything is joined, so a hot key is one row a period. Rows are then grouped by null mask,
    and each mask meets the target on its own non-null columns only: without a partner it is an orphan, and with
    partners that are all younger than the first reference of the period it is one that came too early, ``late``. An
    empty target makes every checked reference an orphan; an empty ``refs`` gives no rows; repeated target rows don't
    repeat orphans; a row of nulls only refers to nothing.
    """
    if reference.match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match rule {reference.match}")
    width = len(reference.columns)
    names = [f"key_{i + 1}" for i in range(width)]
    mask = F.concat(*[F.when(F.col(n).isNull(), "0").otherwise("1") for n in names])
    timed = reference.made is not None and reference.born is not None
    first = F.min(micros(refs, reference.made)) if timed else F.lit(None).cast("bigint")
    keys = [_cleaned(refs, c).alias(n) for c, n in zip(reference.columns, names)]
    tallied = refs.groupBy(*keys, (F.lit("all") if period is None else period).alias("period")).agg(F.count(F.lit(1)).alias("n_rows"), first.alias("_made")).withColumn("mask", mask)
    born = micros(reference.target, reference.born) if timed else F.lit(None).cast("bigint")
    target = reference.target.select(*[_cleaned(reference.target, k).alias(n) for k, n in zip(reference.keys, names)], born.alias("_born"))
    parts = []
    for bits in product("01", repeat=width):
        given = [n for n, b in zip(names, bits) if b == "1"]
        if not given or (len(given) < width and reference.match == "simple"):
            continue
        rows = tallied.where(F.col("mask") == "".join(bits))
        if len(given) < width and reference.match == "full":
            parts.append(rows.withColumn("late", F.lit(False)))
        elif timed:
            known = target.groupBy(*given).agg(F.min("_born").alias("_born")).withColumn("_known", F.lit(True))
            late = F.col("_born") > F.col("_made")
            parts.append(rows.join(known, given, "left").where(F.col("_known").isNull() | late).withColumn("late", F.col("_known").isNotNull()).select(*rows.columns, "late"))
        else:
            parts.append(rows.join(target.select(*given).distinct(), given, "left_anti").select(*rows.columns, F.lit(False).alias("late")))
    return reduce(DataFrame.unionByName, parts).select(F.lit(reference.name).alias("ref_table"), "mask", *names, "period", "n_rows", "late")


def dangling_feedback(feedback: DataFrame, items: DataFrame, users: DataFrame, removals: DataFrame) -> DataFrame:
    """``ref_table, ref_id, period, kind``: references of feedback that name no row, no longer or not yet.

    ``period`` is the day of the feedback, or ``unknown``. ``deleted``: no row, but the removal log names it;
    ``missing``: neither; ``late`` (items): the row exists, but its earliest time is after the feedback's.
    Null and blank ids refer to nothing. An item without any time is never late. Each case comes once.
    """
    day = F.coalesce(F.date_format(F.col("timestamp"), "yyyy-MM-dd"), F.lit("unknown"))
    removed = removals.select(F.concat(F.trim("entity"), F.lit("s")).alias("ref_table"), clean_id("entity_id").alias("key_1")).where("key_1 is not null").distinct()
    of_items = Reference("items", ("item_id",), items, ("item_id",), made="timestamp", born="timestamp")
    orphans = orphan_references(feedback, of_items, day).unionByName(orphan_references(feedback, Reference("users", ("user_id",), users, ("user_id",)), day))
    told = orphans.join(removed.withColumn("gone", F.lit(True)), ["ref_table", "key_1"], "left")
    return told.select("ref_table", F.col("key_1").alias("ref_id"), "period", F.when(F.col("late"), "late").when(F.col("gone"), "deleted").otherwise("missing").alias("kind"))
