from __future__ import annotations

import datetime as dt

from skein.operators.ingest import merge_feedback
from skein.streaming import feedback as st

FB = "feedback_type string, user_id string, item_id string, value double, timestamp timestamp, updated timestamp, comment string"
T = dt.datetime(2014, 1, 1)


def write(spark, path, data):
    spark.createDataFrame([(k, u, i, v, t, t, "") for k, u, i, v, t in data], FB).coalesce(1).write.mode("append").parquet(str(path))


def test_incremental_merge_is_the_batch_merge(spark, rows, tmp_path):
    target = st.MergedTable(spark, str(tmp_path / "merged"))
    src = tmp_path / "src"
    for day in range(3):
        write(spark, src, [("like", "u", f"i{day % 2}", 1.0, T + dt.timedelta(day)), ("like", " u", "i0", 2.0, T)])
        st.maintain(st.read(spark, str(src), FB, 1), target, str(tmp_path / "cp")).awaitTermination()
    want = merge_feedback(spark.read.schema(FB).parquet(str(src)))
    assert rows(target.load()) == rows(want) and len(target.versions()) <= 2
    target.merge(spark.read.schema(FB).parquet(str(src)), target.versions()[-1])  # a batch that comes again
    assert rows(target.load()) == rows(want)


def run(query_df, spark, name, mode):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_windows_sessions_and_marks(spark, rows, tmp_path):
    src = tmp_path / "s"
    write(spark, src, [("like", "u", "a", 1.0, T), ("like", "u", "b", 1.0, T + dt.timedelta(minutes=30)), ("view", "u", "b", 1.0, T + dt.timedelta(hours=5)), ("like", "w", "a", 1.0, T + dt.timedelta(days=90)), ("like", "", "a", 1.0, T)])
    write(spark, src, [("like", "z", "a", 1.0, T + dt.timedelta(days=200))])
    stream = lambda: st.read(spark, str(src), FB)
    daily = run(st.daily_counts(stream(), ["like"]), spark, "daily", "complete")
    assert (dt.date(2014, 1, 1), "like", 3) in rows(daily)
    marks = run(st.last_modified(stream(), "user_id"), spark, "marks", "update")
    assert ("u", T + dt.timedelta(hours=5)) in rows(marks)
    assert st.visible_now(stream()).isStreaming
    closed = run(st.sessions(stream()), spark, "closed", "append")
    assert closed.columns == ["user_id", "start", "end", "n"]


def test_a_batch_rewrites_its_buckets_only(spark, rows, tmp_path):
    target = st.MergedTable(spark, str(tmp_path / "merged"), buckets=8)
    write(spark, tmp_path / "one", [("like", f"u{k}", "i", 1.0, T) for k in range(60)])
    write(spark, tmp_path / "two", [("like", "u7", "i", 2.0, T)])
    for n, name in enumerate(("one", "two")):
        target.merge(spark.read.schema(FB).parquet(str(tmp_path / name)), n)
    first, second = target.parts(0), target.parts(1)
    assert len(first) == 8 and sum(first[b] != second[b] for b in first) == 1
    assert ("u7", 3.0) in rows(target.load(), "user_id", "value") and target.load().count() == 60
