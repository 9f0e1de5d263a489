"""Cutting lineage with written tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one is set only in local mode with the setting unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="skein-")
    spark.sparkContext.setCheckpointDir(made)
    return made


class Scratch:
    """Tables written below the shared folder. ``drop`` removes one early; the rest go when the session ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.clear)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone already
            pass

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        """Write ``df`` and return it as read back, with its path. Executors may be lost afterwards without rework."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def cut(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def drop(self, path: str) -> None:
        self._delete(path)

    def clear(self) -> None:
        self._delete(self.root)
