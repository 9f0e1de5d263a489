"""Streams of feedback: incremental merges, daily ratios, sessions and last-modified marks (ST1 to ST7)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.functions.predicates import matches
from skein.operators.ingest import merge_feedback
from skein.schema import FEEDBACK_KEY
from skein.sources.versions import Versions


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Feedback files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder, one Parquet file or a folder of them, as a stream."""
    path = f"{folder}/{name}.parquet"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 100)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else reader.parquet(path)


class MergedTable(Versions):
    """Merged feedback in buckets of its key's hash below ``root`` (ST5).

    A batch rewrites the buckets that its keys fall into; the new version names the other buckets' folders as before.
    The batch's number is the version's, and a batch that comes again after a failure finds it there. The number of
    buckets must stay the same for a table.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 2, buckets: int = 64):
        super().__init__(spark, root, keep)
        self.buckets = buckets

    def merge(self, batch: DataFrame, number: int) -> None:
        if (self.versions() or [-1])[-1] >= number:
            return
        bucket = F.pmod(F.xxhash64(*FEEDBACK_KEY), F.lit(self.buckets)).cast("int")
        rows = merge_feedback(batch.select(*FEEDBACK_KEY, "value", "timestamp", "updated", "comment"))
        incoming = f"{self.root}/incoming"
        rows.write.mode("overwrite").parquet(incoming)
        rows = self.spark.read.schema(rows.schema).parquet(incoming)
        touched = [str(r["b"]) for r in rows.select(bucket.alias("b")).distinct().collect()]  # at most the buckets
        parts = self.parts()
        held = [f"{self.root}/data/{parts[b]}" for b in touched if b in parts]
        if held:
            rows = merge_feedback(self.spark.read.schema(rows.schema).parquet(*held).unionByName(rows))
        rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/v{number}")
        self.commit(number, parts | {b: f"v{number}/bucket={b}" for b in touched})
        self._fs().delete(self._path("incoming"), True)


def maintain(stream: DataFrame, target: MergedTable, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Merge a stream into a table, at an interval or once over what is there (ST1)."""
    writer = stream.writeStream.foreachBatch(target.merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def daily_counts(stream: DataFrame, types: list[str], late: str = "30 days") -> DataFrame:
    """``day, feedback_type, n``: matching events of each day; events later than ``late`` are dropped (ST2)."""
    rows = stream.withColumn("timestamp", F.col("timestamp").cast("timestamp")).where(F.col("timestamp").isNotNull() & matches(types))
    counted = rows.withWatermark("timestamp", late).groupBy(F.window("timestamp", "1 day"), "feedback_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.to_date("window.start").alias("day"), "feedback_type", "n")


def visible_now(stream: DataFrame, tolerance_s: int = 5) -> DataFrame:
    """Events not dated after the clock plus a tolerance (ST3, ST4)."""
    return stream.where(F.col("timestamp").cast("timestamp") <= F.current_timestamp() + F.expr(f"make_dt_interval(0, 0, 0, {tolerance_s})"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """``user_id, start, end, n`` of sessions as they close. Spark ends a session ``gap`` after its last event; ``end`` is the last event's time."""
    rows = stream.withColumn("timestamp", F.col("timestamp").cast("timestamp")).where("timestamp is not null and trim(user_id) <> ''").withColumn("user_id", F.trim("user_id"))
    closed = rows.withWatermark("timestamp", late).groupBy("user_id", F.session_window("timestamp", gap)).agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("end"))
    return closed.select("user_id", F.col("session_window.start").alias("start"), "end", "n")


def last_modified(stream: DataFrame, key: str, keep_days: float = 30, late: str = "1 day") -> DataFrame:
    """``id, last_modified`` per user or item as updates come; an id's state goes ``keep_days`` after its last event (ST6, ST7)."""

    def update(ids: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest = max(b["timestamp"].max() for b in batches)
        old = pd.Timestamp(state.get[0]) if state.exists else None
        newest = newest if old is None or newest > old else old
        state.update((newest.isoformat(),))
        due = int((newest + pd.Timedelta(days=keep_days)).timestamp() * 1000)
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": [ids[0]], "last_modified": [newest]})

    rows = stream.select(F.trim(key).alias("id"), F.col("timestamp").cast("timestamp").alias("timestamp")).where("id <> '' and timestamp is not null").withWatermark("timestamp", late)
    return rows.groupBy("id").applyInPandasWithState(update, "id string, last_modified timestamp", "last string", "update", GroupStateTimeout.EventTimeTimeout)


def progress(query: StreamingQuery) -> dict:
    """The last batch's figures, as a dictionary."""
    last = query.lastProgress
    return json.loads(last.json) if last is not None and hasattr(last, "json") else (last or {})
