from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skein.operators.hot_keys import dominant_keys, salted_totals

SCHEMA = "item_id string, user_id string, value double, timestamp timestamp_ntz, salt string, key_id int"


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA)


def test_totals_with_nulls_nan_and_repeats(spark, rows):
    t = dt.datetime(2014, 1, 1)
    data = [(" a", None, 1.5, t), ("a ", None, 1.5, t), ("a", None, float("nan"), None), ("a", None, None, t + dt.timedelta(seconds=1)), ("b", "", float("nan"), None), ("", None, 9.0, t), (None, None, 9.0, t)]
    got = rows(salted_totals(frame(spark, data), "item_id"))
    assert got == [("a", 4, 3.0, int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6) + 1_000_000), ("b", 1, None, None)]
    assert rows(salted_totals(frame(spark, []), "item_id")) == []


def test_heavy_keys_are_salted_and_totals_stay(spark):
    """One key with a third of all rows, many of them alike."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("item_id"), F.lit("u").alias("user_id"),
        (F.col("id") % 7).cast("double").alias("value"), F.lit("2014-01-01").cast("timestamp_ntz").alias("timestamp"),
    )
    got = {r["key_id"]: (r["n_rows"], r["sum_value"]) for r in salted_totals(df, "item_id").collect()}
    want = {r["item_id"]: (r["n"], r["s"]) for r in df.groupBy("item_id").agg(F.count("*").alias("n"), F.sum("value").alias("s")).collect()}
    assert got == want and got["hot"][0] == 10_000


def test_share_is_inclusive_and_counts_every_row(spark, rows):
    data = [("a", "u1", 1.0, None)] * 2 + [(None, "u2", 1.0, None)] * 98
    assert rows(dominant_keys(frame(spark, data), ["item_id", "user_id"], 1 / 50)) == [("item_id", "a"), ("user_id", "u1"), ("user_id", "u2")]
    assert rows(dominant_keys(frame(spark, data + [("", "", 0.0, None)]), ["item_id"], 1 / 50)) == []
    assert rows(dominant_keys(frame(spark, []), ["item_id"], 1 / 50)) == []


def test_unknown_column_is_an_error(spark):
    with pytest.raises(Exception):
        salted_totals(frame(spark, []), "nothing").collect()
