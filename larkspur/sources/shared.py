"""A folder that driver and executors share, for warehouses that a query makes for itself."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only for a local master without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="larkspur-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        root = f"file://{_LOCAL[0]}"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
