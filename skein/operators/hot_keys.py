"""Per-key results when a few keys hold most rows: two-stage salted aggregation (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.ids import clean_id, micros
from skein.lineage import Scratch

SAMPLE_OF = 64  # one row in so many is looked at to guess the heavy keys


def heavy_keys(keys: DataFrame, share: float, seed: int = 7) -> list[str]:
    """Keys that likely hold ``share`` of the rows or more, guessed from a sample; at most ``2 / share`` of them.

    The guess only chooses which keys are salted. Results never depend on it.
    """
    sample = keys.where(F.rand(seed) < 1.0 / SAMPLE_OF)
    counts = sample.groupBy("key_id").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.orderBy(F.desc("n"), "key_id").limit(int(2 / share)).collect()
    total = max(1, sum(r["n"] for r in rows))
    return [r["key_id"] for r in rows if r["n"] >= max(2, share * total / 2)]


def salted_totals(df: DataFrame, key: str, value: str = "value", time: str = "timestamp", share: float = 0.01, salts: int = 32) -> DataFrame:
    """``key_id, n_rows, sum_value, last_us`` per trimmed key, without a slow task for a heavy key.

    Heavy keys get a salt drawn from the row's own content, so a retried task salts alike; partial results per
    (key, salt) are merged by key. Rows with a null or blank key are left out; every other row counts. Null and NaN
    values add nothing; a key without any has a null sum. Null times are passed over; a key without times has a null
    ``last_us``. Repeated rows count each time. An empty table gives no rows.
    """
    rows = df.select(clean_id(f"`{key}`").alias("key_id"), F.col(f"`{value}`").cast("double").alias("v"), micros(df, time).alias("t")).where("key_id is not null")
    heavy = heavy_keys(rows.select("key_id"), share)
    salt = F.when(F.col("key_id").isin(heavy), F.pmod(F.xxhash64("v", "t"), F.lit(salts))).otherwise(0) if heavy else F.lit(0)
    partial = (
        rows.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
        .withColumn("salt", salt.cast("int"))
        .groupBy("key_id", "salt")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.max("t").alias("last"))
    )
    return partial.groupBy("key_id").agg(F.sum("n").alias("n_rows"), F.sum("s").alias("sum_value"), F.max("last").alias("last_us"))


def dominant_keys(df: DataFrame, fields: list[str], share: float, salts: int = 32) -> DataFrame:
    """``field, key_id`` of the trimmed non-blank keys holding at least ``share`` of all rows, blank ids and repeats counted.

    All fields are counted in one scan by the two salted stages of ``salted_totals``; a row's salt is drawn from its keys.
    """
    keys = F.array(*[F.struct(F.lit(f).alias("field"), clean_id(f"`{f}`").alias("key_id"), F.xxhash64(*[f"`{x}`" for x in fields]).alias("h")) for f in fields])
    rows = df.select(F.explode(keys).alias("x")).select("x.*")
    heavy = heavy_keys(rows.where("key_id is not null").select(F.concat_ws("\n", "field", "key_id").alias("key_id")), 0.01)
    salt = F.when(F.concat_ws("\n", "field", "key_id").isin(heavy), F.pmod("h", F.lit(salts))).otherwise(0) if heavy else F.lit(0)
    partial = rows.groupBy("field", "key_id", salt.cast("int").alias("salt")).agg(F.count(F.lit(1)).alias("n"))
    counts = Scratch(df.sparkSession, "counts").cut(partial.groupBy("field", "key_id").agg(F.sum("n").alias("n")))
    total = counts.where(F.col("field") == fields[0]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # a product that rounding raised above a whole number must not lose the key at the edge
    return counts.where(F.col("key_id").isNotNull() & (F.col("n") >= share * total * (1 - 1e-12))).select("field", "key_id")


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", share: float = 0.01, salts: int = 32) -> DataFrame:
    """``big`` joined on ``key`` with ``small``, which has few rows for each key, without a task for all rows of a heavy key.

    Rows of heavy keys get a salt from their own content, and those of ``small`` are repeated for each salt. ``how`` is
    inner or left; repeated rows count each time, null keys match nothing.
    """
    heavy = heavy_keys(big.select(F.col(key).alias("key_id")).where("key_id is not null"), share)
    if not heavy:
        return big.join(small, key, how)
    hot = F.col(key).isin(heavy)
    salt = F.when(hot, F.pmod(F.xxhash64(*[c for c in big.columns if c != key]), F.lit(salts))).otherwise(0).cast("int")
    every = F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("_salt")
    return big.withColumn("_salt", salt).join(small.select("*", every), [key, "_salt"], how).drop("_salt")
