from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from skein import schema
from skein.engine import Engine
from skein.operators import cache, ingest
from skein.schema import FEEDBACK, ITEMS, SCORES
from skein.sources import files, scans

T = dt.datetime(2014, 1, 1)
FB = "feedback_type string, user_id string, item_id string, value double, timestamp timestamp, updated timestamp, comment string"


def fb(spark, *data):
    return spark.createDataFrame([(k, u, i, v, t, t, c) for k, u, i, v, t, c in data], FB)


def test_merge_and_insert(spark, rows):
    later = T + dt.timedelta(1)
    raw = fb(spark, ("Like ", "u", "i", 1.0, T, "a"), ("like", " u", "i", 2.0, later, "b"), ("like", "u", "i", float("nan"), None, None), ("", "u", "i", 1.0, T, ""), ("like", None, "i", 1.0, T, ""))
    merged = ingest.merge_feedback(raw)
    assert rows(merged) == [("like", "u", "i", 3.0, T, later, "b")]
    assert rows(ingest.merge_feedback(merged.unionByName(fb(spark, ("like", "u", "i", 5.0, T, None)))), "value") == [(8.0,)]
    users, items = spark.createDataFrame([("u",)], "user_id string"), spark.createDataFrame([("i",)], "item_id string")
    new = fb(spark, ("like", "u", "i", 7.0, later, "x"), ("like", "u", "i", 9.0, later, "y"), ("like", "w", "i", 1.0, T, ""))
    order = [F.asc("value")]
    got, us, _ = ingest.insert_feedback(merged, new, users, items, order)
    assert rows(got, "user_id", "value") == [("u", 10.0), ("w", 1.0)] and rows(us) == [("u",), ("w",)]
    got, us, _ = ingest.insert_feedback(merged, new, users, items, order, insert_user=False, overwrite=True)
    assert rows(got, "user_id", "value") == [("u", 7.0)] and rows(us) == [("u",)]


def test_upsert_patch_delete(spark, rows):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "user_id string, comment string")
    batch = spark.createDataFrame([("b", "y", 2), ("b", "x", 1), ("c", "z", 1)], "user_id string, comment string, n int")
    assert rows(ingest.upsert(old, batch, ["user_id"], [F.asc("n")])) == [("a", "1"), ("b", "x"), ("c", "z")]
    assert rows(ingest.patch(old, spark.createDataFrame([("a", None), ("b", "q"), ("zz", "q")], "user_id string, comment string"), "user_id")) == [("a", "1"), ("b", "q")]
    left, n = ingest.delete_pair(fb(spark, ("l", "u", "i", 1.0, T, ""), ("s", "u", "i", 1.0, T, ""), ("l", "w", None, 1.0, T, "")), "u", "i", ["l"])
    assert n == 1 and left.count() == 2
    items = spark.createDataFrame([("i", ["a"]), ("j", None)], "item_id string, categories array<string>")
    assert rows(ingest.remove_category(ingest.add_category(ingest.add_category(items, "i", "b"), "j", "c"), "i", "a")) == [("i", ["b"]), ("j", ["c"])]
    assert ingest.purge(items).count() == 0


def test_pages(spark, rows):
    df = spark.createDataFrame([(f"{i:02d}",) for i in range(7)], "user_id string")
    seen, cursor = [], ""
    while True:
        page, cursor = scans.page(df, "user_id", cursor, 3)
        seen += [r[0] for r in page.collect()]
        if not cursor:
            break
    assert seen == [f"{i:02d}" for i in range(7)]
    f = fb(spark, *[(k, "u", str(i), 1.0, T, "") for k in "ab" for i in range(3)])
    one, cursor = scans.feedback_page(f, "", 4)
    two, end = scans.feedback_page(f, cursor, 4)
    assert one.count() == 4 and rows(two, "feedback_type", "item_id") == [("b", "1"), ("b", "2")] and end == ""


def test_scores(spark, rows):
    s = lambda *d: spark.createDataFrame([(c, "x", i, v, h, cats, T) for c, i, v, h, cats in d], schema.SCORES)
    old = s(("a", "1", 1.0, True, ["p"]), ("a", "2", 2.0, False, ["p", "q"]), ("b", "3", 3.0, False, []))
    grown = cache.add_scores(old, s(("a", "1", 9.0, False, ["z"]), ("a", "4", 4.0, False, ["q"])))
    assert rows(grown, "id", "score", "is_hidden") == [("1", 9.0, True), ("2", 2.0, False), ("3", 3.0, False), ("4", 4.0, False)]
    assert [r["id"] for r in cache.search_scores(grown, "a", "x").collect()] == ["4", "2"]
    assert [r["id"] for r in cache.search_scores(grown, "a", "x", ["q", "p"]).collect()] == ["2"]
    assert [r["id"] for r in cache.search_scores(grown, "a", "x", None, 1, 2).collect()] == ["2"]
    assert rows(cache.update_scores(grown, ["a"], "1", is_hidden=False, score=0.5).where("id = '1'"), "is_hidden", "score") == [(False, 0.5)]
    assert cache.delete_scores(grown, ["a"], id="1").count() == 3
    with pytest.raises(ValueError):
        cache.delete_scores(grown, ["a"])


def test_queue_values_points(spark, rows):
    q = spark.createDataFrame([("q", "b", T), ("q", "a", T + dt.timedelta(1))], schema.MESSAGES)
    q = cache.push(q, spark.createDataFrame([("q", "b", T + dt.timedelta(2))], schema.MESSAGES))
    assert cache.remain(q, "q") == 2
    first, q = cache.pop(q, "q")
    second, q = cache.pop(q, "q")
    assert (first, second, cache.pop(q, "q")[0]) == ("a", "b", None)
    meta = cache.set_values(spark.createDataFrame([("x", "1")], schema.META), spark.createDataFrame([("x", "2", 1), ("x", "3", 2)], "name string, value string, n int"), [F.asc("n")])
    assert rows(meta) == [("x", "2")]
    p = spark.createDataFrame([("p", T.replace(second=i), float(i)) for i in range(5)], schema.POINTS)
    got = cache.bucket_points(cache.add_points(p, spark.createDataFrame([("p", T, 9.0)], schema.POINTS)), "p", "2014-01-01 00:00:00", "2014-01-02 00:00:00", 2)
    assert [(r[1].second, r[2]) for r in got.orderBy("timestamp").collect()] == [(0, 1.0), (2, 3.0), (4, 4.0)]
    assert cache.digest("b", "a") == cache.digest("a", "b") != cache.digest("a")


def test_files(spark, rows, tmp_path):
    (tmp_path / "users.jsonl").write_text('{"UserId": "u1", "Labels": {"a": 1}}\n{"UserId": "a/b"}\n\nnot json\n')
    good, bad = files.import_lines(spark, "users", str(tmp_path / "users.jsonl"))
    assert rows(good, "user_id") == [("u1",)] and bad.count() == 2
    lines = [{"FeedbackType": "like", "UserId": "u", "ItemId": "i", "Timestamp": t} for t in ("2014-01-01T00:00:00Z", "2014/01/01", "someday", "1388534400")]
    (tmp_path / "f.jsonl").write_text("\n".join(map(json.dumps, lines)))
    good, bad = files.import_lines(spark, "feedback", str(tmp_path / "f.jsonl"))
    assert rows(good, "timestamp") == [(T,)] * 3 and bad.count() == 1
    files.export_lines(good, str(tmp_path / "out"), "2014-06-01")
    again, bad = files.import_lines(spark, "feedback", str(tmp_path / "out"))
    assert rows(again) == rows(good) and bad.count() == 0
    (tmp_path / "train.txt").write_text("u1\ti1\nu2\ti2\t5\n")
    (tmp_path / "test.txt").write_text("(u1,i3)\ti4\ti5\n")
    (tmp_path / "x.libfm").write_text("1 0:0.5 7:1\n0 3:2\n\n")
    assert rows(files.read_train(spark, str(tmp_path / "train.txt"))) == [("u1", "i1"), ("u2", "i2")]
    pos, neg = files.read_test(spark, str(tmp_path / "test.txt"))
    assert rows(pos) == [("u1", "i3")] and rows(neg) == [("u1", "i4"), ("u1", "i5")]
    assert rows(files.read_indexed(spark, str(tmp_path / "x.libfm"))) == [(0.0, [3], [2.0]), (1.0, [0, 7], [0.5, 1.0])]
    files.dump(str(tmp_path / "bundle"), users=good)
    assert rows(files.restore(spark, str(tmp_path / "bundle"), "users")["users"]) == rows(good)


def test_engine(spark, rows, tmp_path):
    e = Engine(spark, str(tmp_path), "2014-01-10 00:00:00")
    e.insert_items(spark.createDataFrame([(f"i{k}", k == 3, ["c"], T, None, "") for k in range(5)], schema.ITEMS))
    e.insert_feedback(fb(spark, ("like", "u1", "i0", 1.0, T, ""), ("like", "u2", "i0", 1.0, T, ""), ("like", "u2", "i1", 1.0, T, ""), ("like", "u2", "i3", 1.0, T, "")))
    assert rows(e.table("users"), "user_id") == [("u1",), ("u2",)]
    assert rows(e.popular(2), "item_id", "score", "categories") == [("i0", 2.0, ["", "c"]), ("i1", 1.0, ["", "c"])]
    got = {(r["user_id"], r["item_id"]) for r in e.recommend([], 10).collect()}
    assert ("u1", "i0") not in got and ("u1", "i3") not in got and ("u1", "i1") in got and ("u2", "i4") in got
    e.delete_item("i0")
    assert e.table("feedback").count() == 2
    e.patch_user("u1", comment="x")
    assert rows(e.table("users"), "user_id", "comment") == [("u1", "x"), ("u2", None)]
    e.add_category("i1", "d")
    assert rows(e.table("items").where("item_id = 'i1'"), "categories") == [(["c", "d"],)]
    e.purge()
    assert e.table("items").count() == 0


def test_another_engine_finds_what_was_written(spark, rows, tmp_path):
    e = Engine(spark, str(tmp_path / "e"), "2014-01-10 00:00:00")
    e.insert_users(spark.createDataFrame([("u1", None, "b", 2), ("u1", None, "c", 1), ("u2", None, "", 1)], "user_id string, labels string, comment string, position int"))
    e.insert_items(spark.createDataFrame([(f"i{k:02d}", False, ["x"], dt.datetime(2014, 1, 1) + dt.timedelta(hours=k), None, "") for k in range(40)], ITEMS))
    e.insert_feedback(spark.createDataFrame([("like", "u1", f"i{k:02d}", 1.0, dt.datetime(2014, 1, 2), dt.datetime(2014, 1, 2), "") for k in range(12, 40)], FEEDBACK))
    other = Engine(spark, str(tmp_path / "e"), "2014-01-10 00:00:00")
    assert rows(other.table("users"), "user_id", "comment") == [("u1", "c"), ("u2", "")]
    top = {u: [r["item_id"] for r in other.recommend([], 3).where(F.col("user_id") == u).orderBy("rank").collect()] for u in ("u1", "u2")}
    assert top == {"u1": ["i11", "i10", "i09"], "u2": ["i39", "i38", "i37"]}
    other.set_value("a", "1")
    other.set_value("a", "2")
    assert e.get_value("a") == "2" and e.get_value("b") is None
    e.delete_value("a")
    assert other.get_value("a") is None
    e.add_scores(spark.createDataFrame([("item-to-item", "near/i00", "i05", 1.0, False, ["x"], dt.datetime(2014, 1, 1)), ("item-to-item", "near/i00", "gone", 2.0, False, ["x"], dt.datetime(2014, 1, 1))], SCORES))
    assert rows(other.neighbours("item-to-item", "near", "i00"), "item_id", "score") == [("i05", 1.0)]
    other.export_lines("items", str(tmp_path / "items"))
    third = Engine(spark, str(tmp_path / "third"), "2014-01-10 00:00:00")
    assert third.import_lines("items", str(tmp_path / "items")) == 0 and third.table("items").count() == 40
    third.purge()
    assert third.table("items").count() == 0 and not (tmp_path / "third" / "items").exists()


def test_versions_keep_two(spark, tmp_path):
    from skein.sources.versions import Versions

    v = Versions(spark, str(tmp_path / "t"))
    assert v.load() is None and v.parts() == {}
    for k in range(4):
        v.replace(spark.range(k))
    v.append(spark.range(2))
    assert v.versions() == [4, 5] and v.load().count() == 5 and v._listed("data") and len(v._listed("data")) == 2


def test_sql_store(spark, rows, tmp_path):
    """Written, read and merged by JDBC in the store that comes with Spark."""
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    files.write_jdbc(spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int"), url, "t", "overwrite", createTableColumnTypes="id VARCHAR(20), n INT", **driver)
    files.upsert_jdbc(spark.createDataFrame([("b", 5, 2), ("b", 3, 1), ("c", 4, 1)], "id string, n int, o int"), url, "t", ["id"], [F.asc("o")], **driver)
    assert rows(files.read_jdbc(spark, url, "t", **driver)) == [("a", 1), ("b", 3), ("c", 4)]


def test_blobs_and_the_store_that_is_not_there(spark, tmp_path):
    from skein.sources.blobs import Blobs, NoStore

    store = Blobs(spark, str(tmp_path / "blobs"))
    assert store.names() == []
    store.write("a/model.bin", bytes(range(256)))
    store.write("b", b"")
    store.write("b", b"new")
    assert store.names() == ["a/model.bin", "b"] and store.read("a/model.bin") == bytes(range(256)) and store.read("b") == b"new"
    store.remove("b")
    store.remove("b")
    assert store.names() == ["a/model.bin"]
    with pytest.raises(FileNotFoundError):
        store.read("b")
    with pytest.raises(LookupError):
        NoStore().insert_users([])


def test_nodes_and_tags(spark, rows):
    at = lambda h: dt.datetime(2014, 1, 1, h)
    kind = "uuid string, kind string, host string, updated timestamp_ntz"
    nodes = cache.announce(spark.createDataFrame([("a", "server", "h", at(1)), ("b", "worker", "h", at(2))], kind), spark.createDataFrame([("a", "server", "g", at(5)), ("a", "server", "h", at(4))], kind))
    assert rows(nodes, "uuid", "host") == [("a", "g"), ("b", "h")] and rows(cache.running(nodes, "2014-01-01 06:00:00", 3601), "uuid") == [("a",)]
    words = spark.createDataFrame([("",), ("a",), ("ab",), ("abc",), ("?>?>~~",), ("日本",), (None,)], "w string")
    back = words.select("w", cache.tag(F.col("w")).alias("t")).withColumn("b", cache.untag(F.col("t")))
    assert back.where("not (w <=> b)").count() == 0 and back.where("t rlike '[^A-Za-z0-9+/]'").count() == 0

