from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from skein.functions import labels as L
from skein.functions.expressions import Compiler, checked
from skein.functions.ids import valid_id
from skein.functions.predicates import TypeExpression, has_all, has_any, matches, matches_or_all
from skein.functions.vectors import METRICS, bfloat16


def test_type_expressions(spark, rows):
    df = spark.createDataFrame([("star", 3.0), ("star", 2.9), ("like", 0.0), ("star", None)], "feedback_type string, value double")
    assert rows(df.where(matches(["star>=3", "like"]))) == [("like", 0.0), ("star", 3.0)]
    assert rows(df.where(matches(["star<3"]))) == [("star", 2.9)]
    assert df.where(matches([])).count() == 0 and df.where(matches_or_all([])).count() == 4
    assert TypeExpression.parse("star=3", allow_equals=True) == TypeExpression("star")
    for bad in ("star=3", "", ">=3", "star>=x"):
        with pytest.raises(ValueError):
            TypeExpression.parse(bad)


def test_categories(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a", None],), ([],), (None,)], "c array<string>")
    assert df.where(has_all(F.col("c"), ["a", "b"])).count() == 1
    assert df.where(has_all(F.col("c"), [])).count() == 4
    assert df.where(has_any(F.col("c"), ["a", "z"])).count() == 2 and df.where(has_any(F.col("c"), [])).count() == 4


def test_expressions(spark):
    items = spark.createDataFrame([("i1", dt.datetime(2014, 1, 1), ["a"]), ("i2", dt.datetime(2014, 1, 2), [])], "item_id string, timestamp timestamp_ntz, categories array<string>")
    fb = spark.createDataFrame([("i1", "like", 1.0), ("i1", "star", 4.0), ("i1", "like", 2.0)], "fb_item_id string, fb_feedback_type string, fb_value double")
    joined = items.join(fb, F.col("item_id") == F.col("fb_item_id"), "left").groupBy("item_id")
    c = Compiler("2014-01-03 00:00:00")
    got = {r[0]: r[1:] for r in joined.agg(c.compile("count(feedback, .FeedbackType == 'like' && .Value > 1)").alias("a"), c.compile("len(feedback) * 2 - 1").alias("b")).collect()}
    assert got == {"i1": (1.0, 5.0), "i2": (0.0, -1.0)}
    plain = items.select("item_id", c.compile("(now() - item.Timestamp).Hours()").alias("h"), c.compile("len(item.Categories) >= 1 and !(item.ItemId == 'i9')").alias("k"), c.compile("item.Timestamp.Unix()").alias("u"))
    assert [tuple(r) for r in plain.orderBy("item_id").collect()] == [("i1", 48.0, True, 1388534400), ("i2", 24.0, False, 1388620800)]
    for bad in ("len(", "1 +", "count(item, true)", "foo$", "item", "1 2"):
        with pytest.raises(ValueError):
            c.compile(bad)
    with pytest.raises(TypeError):
        checked(items, F.col("item_id"), "number")


def test_labels(spark, rows):
    df = spark.createDataFrame([("a", ("x", 2.5, ["p", "p", None])), ("b", None), ("c", (None, None, []))], "id string, labels struct<city: string, n: double, tags: array<string>>")
    assert rows(L.flatten(df, "id", "labels")) == [("a", "city:x"), ("a", "tags:p"), ("a", "tags:p")]
    assert rows(L.weighted(df, "id", "labels")) == [("a", "city.x", 1.0), ("a", "n.", 2.5), ("a", "tags.p", 1.0), ("a", "tags.p", 1.0)]
    assert rows(L.pruned(spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y")], "id string, label string")), "id", "label") == [("a", "x"), ("b", "x")]
    nested = spark.createDataFrame([("a", (([1.0, 2.0],),))], "id string, labels struct<deep: struct<vec: array<double>>>")
    assert rows(L.embeddings(nested, "id", "labels")) == [("a", "deep.vec", [1.0, 2.0])]
    assert L.modal_length(spark.createDataFrame([([1.0],), ([1.0],), ([1.0, 2.0],), (None,)], "v array<double>"), "v") == 1
    assert L.valid_labels({"a": {"b": ["x"]}, "c": 1.5}) and not L.valid_labels({"a": True}) and not L.valid_labels(["x", 1]) and not L.valid_labels([["x"]])


def test_ids(spark):
    df = spark.createDataFrame([("a",), (" ",), ("a/b",), (None,), ("",)], "x string")
    assert [r[0] for r in df.select(valid_id(F.col("x"))).collect()] == [True, False, False, False, False]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = df.select(*[f(F.col("a"), F.col("b")).alias(n) for n, f in METRICS.items()]).collect()
    assert got[0]["euclidean"] == 1.0 and math.isclose(got[0]["cosine"], 1 - 1 / math.sqrt(2)) and got[0]["dot"] == -1.0 and got[1]["cosine"] == 1.0
    import struct

    values = [0.1, -3.14159, 1e-3, 65504.1, 0.0]
    cut = spark.createDataFrame([(values,)], "a array<float>").select(bfloat16(F.col("a"))).first()[0]
    want = [struct.unpack("<f", struct.pack("<I", struct.unpack("<I", struct.pack("<f", v))[0] & 0xFFFF0000))[0] for v in values]
    assert cut == want
