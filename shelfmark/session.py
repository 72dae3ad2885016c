"""Session construction with the settings the library is tested under."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "shelfmark", **extra: str) -> SparkSession:
    """Return a session: UTC, adaptive execution, Arrow transfer.

    On a cluster the master, memory and shuffle-partition count come from
    spark-submit; only settings that results depend on are forced here.
    """
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.ui.enabled": "false",
    }
    conf.update(extra)
    return builder.config(map=conf).getOrCreate()
