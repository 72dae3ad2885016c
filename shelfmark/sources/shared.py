"""The folder that the driver and all executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession, label: str) -> str:
    """A new path under ``spark.checkpoint.dir``; a local session without that setting gets a temporary folder."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (context.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _LOCAL.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="shelfmark-tables-"))
    top = context._jvm.org.apache.hadoop.fs.Path(f"{named.rstrip('/')}/catalogue/{context.applicationId}")
    files = top.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(top)
    files.deleteOnExit(top)
    return f"{top.toString()}/{label}-{uuid.uuid4().hex}"
