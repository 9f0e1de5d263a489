"""Files of models below a folder of any file system that Hadoop knows, and the store that isn't there (SK15, SK17)."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Blobs:
    """Named bytes (SK15). A file is written aside and put in place at once; names may have folders.

    Whether they lie on a disk or in an object store is told by the root's scheme alone.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, name: str, content: bytes) -> None:
        path, fs = self._at(name)
        aside = path.suffix("._part")
        out = fs.create(aside, True)
        out.write(content)
        out.close()
        fs.delete(path, False)
        if not fs.rename(aside, path):
            raise OSError(f"{name} can't be put in place")

    def read(self, name: str) -> bytes:
        """The bytes of a name; FileNotFoundError if there are none."""
        path, fs = self._at(name)
        if not fs.exists(path):
            raise FileNotFoundError(name)
        stream = fs.open(path)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def names(self) -> list[str]:
        root, fs = self._at()
        if not fs.exists(root):
            return []
        found, start = [], len(fs.makeQualified(root).toString()) + 1
        files = fs.listFiles(root, True)
        while files.hasNext():
            found.append(files.next().getPath().toString()[start:])
        return sorted(n for n in found if not n.endswith("._part"))

    def remove(self, name: str) -> None:
        path, fs = self._at(name)
        fs.delete(path, False)


class NoStore:
    """Stands where no store is named: whatever is asked of it fails alike (SK17)."""

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)

        def fail(*args: object, **kw: object) -> None:
            raise LookupError("no database is named")

        return fail
