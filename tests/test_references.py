from __future__ import annotations

import datetime as dt

import pytest

from skein.operators.references import Reference, dangling_feedback, orphan_references

T = dt.datetime(2014, 1, 2, 12)


def test_match_rules_by_null_mask(spark, rows):
    refs = spark.createDataFrame([("a", "x", 1), ("a", None, 1), (None, "x", 2), (None, "z", 2), ("b", "x", 3), (None, None, 4), ("a", " x ", 5), ("", "x", 6)], "p string, q string, mask int")
    target = spark.createDataFrame([("a", "x"), ("c", "y"), ("a", "x")], "k string, l string")
    found = lambda match: rows(orphan_references(refs, Reference("t", ("p", "q"), target, ("k", "l"), match)), "mask", "key_1", "key_2", "n_rows")
    assert found("simple") == [("11", "b", "x", 1)]
    assert found("partial") == [("01", None, "z", 1), ("11", "b", "x", 1)]
    assert found("full") == [("01", None, "x", 2), ("01", None, "z", 1), ("10", "a", None, 1), ("11", "b", "x", 1)]
    with pytest.raises(ValueError):
        found("some")


def test_empty_sides(spark, rows):
    refs = spark.createDataFrame([("a",)], "p string")
    none = spark.createDataFrame([], "k string")
    assert rows(orphan_references(refs, Reference("t", ("p",), none, ("k",))), "key_1") == [("a",)]
    assert rows(orphan_references(refs.limit(0), Reference("t", ("p",), none, ("k",)))) == []


def test_kinds(spark, rows):
    fb = spark.createDataFrame(
        [("i1", "u1", T), ("i1", "u1", T), (" i2", "u1 ", T), ("i3", "u3", None), ("i4", None, T), ("i5", "", T), ("i6", "u1", T), (None, "u4", T)], "item_id string, user_id string, timestamp timestamp_ntz"
    )
    items = spark.createDataFrame([("i1", T - dt.timedelta(1)), ("i4", T + dt.timedelta(1)), ("i5", T + dt.timedelta(1)), ("i5", T), ("i6", None)], "item_id string, timestamp timestamp_ntz")
    users = spark.createDataFrame([("u1",), ("u1",)], "user_id string")
    removals = spark.createDataFrame([("item", "i2 ", T), ("user", "u3", T), ("user", "u3", T), ("item", "i1", T)], "entity string, entity_id string, removed_at timestamp_ntz")
    assert rows(dangling_feedback(fb, items, users, removals)) == [
        ("items", "i2", "2014-01-02", "deleted"), ("items", "i3", "unknown", "missing"), ("items", "i4", "2014-01-02", "late"), ("users", "u3", "unknown", "deleted"), ("users", "u4", "2014-01-02", "missing"),
    ]
    assert rows(dangling_feedback(fb.limit(0), items, users, removals)) == []


def test_references_that_come_before_their_rows(spark, rows):
    """A composite reference with times: the masks are checked on their own columns, the youngest partner decides nothing."""
    refs = spark.createDataFrame([("a", "x", T), ("a", None, T), ("b", "x", T), ("b", "x", T + dt.timedelta(2)), (None, "y", None), (None, "z", T)], "p string, q string, at timestamp_ntz")
    target = spark.createDataFrame([("a", "x", T + dt.timedelta(1)), ("a", "w", T - dt.timedelta(1)), ("b", "x", None), ("c", "z", T), ("c", "y", T)], "k string, l string, at timestamp_ntz")
    ref = Reference("t", ("p", "q"), target, ("k", "l"), "partial", "at", "at")
    assert rows(orphan_references(refs, ref), "mask", "key_1", "key_2", "n_rows", "late") == [("11", "a", "x", 1, True)]
    late = Reference("t", ("p", "q"), target.where("k <> 'b'"), ("k", "l"), "partial", "at", "at")
    assert rows(orphan_references(refs, late), "mask", "key_1", "key_2", "n_rows", "late") == [("11", "a", "x", 1, True), ("11", "b", "x", 2, False)]
