"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only for a local master without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "root" not in _LOCAL:
        _LOCAL["root"] = tempfile.mkdtemp(prefix="larkspur-")
        atexit.register(shutil.rmtree, _LOCAL["root"], ignore_errors=True)
    return _LOCAL["root"]


class Scratch:
    """Written tables cut lineage, survive lost executors and are dropped when used up.

    Tables named in ``drop`` go at once; what a returned DataFrame still reads
    stays until :meth:`close` or the end of the application.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/larkspur-{label}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str, few: bool = False) -> DataFrame:
        """few: many tasks give few rows each.  Those are gathered into few files first: on a local disk Hadoop starts
        several processes for each file (chmod), and while it does, the executor's memory counts twice."""
        path = f"{self.root}/{name}"
        if few:
            df = df.hint("rebalance")
        # one row may hold megabytes: the writer must look at its memory after each of them
        df.write.mode("overwrite").option("compression", "zstd").option("parquet.page.size.row.check.min", "1").option("parquet.page.size.row.check.max", "100").option("parquet.block.size", str(16 << 20)).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables, and let Spark's cleaner remove shuffles that nothing refers to any more."""
        for name in names:
            self._delete(f"{self.root}/{name}")
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the application may have ended before
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
