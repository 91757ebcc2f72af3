"""Small files through Hadoop's file systems, so that a warehouse may be anywhere Spark can write."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def changed(self, folder: str) -> list[tuple[str, float]]:
        """Names in a folder with the time of their last change, in seconds."""
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self.fs.listStatus(self._path(folder))]

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commit(self, name: str, text: str) -> None:
        """Write beside the target and rename: readers see all of it or nothing."""
        stream = self.fs.create(self._path(f"{name}.tmp"), True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        if not self.fs.rename(self._path(f"{name}.tmp"), self._path(name)):
            raise OSError(f"{name} could not be committed")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
