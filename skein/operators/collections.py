"""Collections of vectors with categories (VE1 to VE3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.predicates import has_any, visible
from skein.functions.vectors import METRICS
from skein.schema import META, VECTORS
from skein.sources.versions import Versions


class VectorStore:
    """Collections as versions of Parquet folders below ``root``, each named with its metric by a table of its own (VE1 to VE3)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._names = Versions(spark, f"{self.root}/_collections")

    @property
    def metrics(self) -> dict[str, str]:
        return {r["name"]: r["value"] for r in self._names.load(META).collect()}  # a row for each collection

    def _keep(self, metrics: dict[str, str]) -> None:
        self._names.replace(self.spark.createDataFrame(sorted(metrics.items()), META).coalesce(1))

    def add_collection(self, name: str, metric: str = "cosine") -> None:
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric}")
        self._keep(self.metrics | {name: metric})

    def collections(self) -> list[str]:
        return sorted(self.metrics)

    def delete_collection(self, name: str) -> None:
        held = self._table(name)
        self._keep({k: v for k, v in self.metrics.items() if k != name})
        held.drop()

    def _table(self, name: str) -> Versions:
        if name not in self.metrics:
            raise KeyError(name)
        return Versions(self.spark, f"{self.root}/{name}")

    def add(self, name: str, vectors: DataFrame) -> None:
        """Vectors beside those that are there, which aren't rewritten."""
        self._table(name).append(vectors.select(*VECTORS.fieldNames()))

    def delete_before(self, name: str, time: str) -> None:
        self._table(name).replace(delete_before(self.load(name), time))

    def load(self, name: str) -> DataFrame:
        return self._table(name).load(VECTORS)

    def query(self, name: str, vector: list[float], n: int, categories: list[str] | None = None) -> DataFrame:
        return query_vectors(self.load(name), vector, n, self.metrics[name], categories)


def query_vectors(vectors: DataFrame, vector: list[float], n: int, metric: str = "cosine", categories: list[str] | None = None) -> DataFrame:
    """``id, distance`` of the ``n`` nearest visible vectors with any of the categories, ties by id (VE3)."""
    rows = vectors.where(visible() & has_any(F.col("categories"), categories or []))
    far = F.round(METRICS[metric](F.col("vector"), F.array(*map(F.lit, vector))), 6)
    return rows.select("id", far.alias("distance")).orderBy("distance", "id").limit(n)


def delete_before(vectors: DataFrame, time: str) -> DataFrame:
    """Vectors without those older than ``time`` (VE2)."""
    return vectors.where(~F.coalesce(F.col("timestamp") < F.lit(time).cast("timestamp_ntz"), F.lit(False)))
