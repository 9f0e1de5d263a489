"""Session helper for tests, the bench and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str | None = None, app: str = "skein", **conf: str) -> SparkSession:
    """A local session with the settings the library is tuned for.

    On a cluster build the session yourself; the operators read every setting they need from it.
    """
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.files.maxPartitionBytes": "16m",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
