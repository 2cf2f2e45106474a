"""Folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, label: str) -> str:
    """A new name under ``spark.checkpoint.dir``; without that setting, a local folder, and only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loresmith-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """One small file, by the file system of its path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
