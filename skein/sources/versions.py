"""Tables as numbered versions of Parquet parts below a folder, named by a manifest that is put in place at once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Versions:
    """The manifests of a table. A version names the folders that hold its parts; folders may serve several versions.

    Readers see a version only once its manifest is there. Versions older than the ``keep`` newest go, and with them
    the folders that no kept version names, so a reader has as many writes' time to finish.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._listed("manifests") if n.startswith("v") and n.endswith(".json"))

    def parts(self, number: int | None = None) -> dict[str, str]:
        """The folders of a version, of the newest one if none is named, by the parts' names; none before the first."""
        done = self.versions()
        if not done:
            return {}
        stream = self._fs().open(self._path("manifests", f"v{done[-1] if number is None else number}.json"))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def commit(self, number: int, parts: dict[str, str]) -> None:
        fs = self._fs()
        hidden, shown = self._path("manifests", f".v{number}"), self._path("manifests", f"v{number}.json")
        out = fs.create(hidden, True)
        out.write(json.dumps(parts).encode())
        out.close()
        if not fs.rename(hidden, shown):
            raise OSError(f"{shown.toString()} can't be put in place")
        for old in self.versions()[: -self.keep]:
            fs.delete(self._path("manifests", f"v{old}.json"), False)
        named = {p.split("/", 1)[0] for v in self.versions() for p in self.parts(v).values()}
        for name in self._listed("data"):
            if name not in named:
                fs.delete(self._path("data", name), True)

    def load(self, schema: StructType | None = None) -> DataFrame | None:
        """The newest version; None before the first, or with ``schema`` an empty table."""
        paths = [f"{self.root}/data/{p}" for p in self.parts().values()]
        if not paths:
            return None if schema is None else self.spark.createDataFrame([], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*paths)

    def replace(self, df: DataFrame) -> None:
        """A new version of one part."""
        number = (self.versions() or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.root}/data/v{number}")
        self.commit(number, {"": f"v{number}"})

    def append(self, df: DataFrame) -> None:
        """A new version with one part more."""
        number = (self.versions() or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.root}/data/v{number}")
        self.commit(number, self.parts() | {str(number): f"v{number}"})

    def drop(self) -> None:
        self._fs().delete(self._path(), True)
