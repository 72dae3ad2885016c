"""What happened in a run, as rows: made, written and read by Spark.

An event is (at, run, level, event, facts): ``facts`` is a VARIANT, so that every kind of
event keeps its own fields.  Written, each is a line of JSON, which other tools read, too;
a line that can't be read comes back as an event named ``unreadable`` with its text.
The driver's own messages go to standard logging under the name ``shelfmark``.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import records

COLUMNS = "at timestamp, run string, level string, event string, facts variant"
UNREADABLE = "unreadable"
driver = logging.getLogger("shelfmark")


def of(rows: DataFrame, run: str, event: Column | str, at: Column, level: Column | str = "INFO", **facts: Column) -> DataFrame:
    """One event for each row; ``facts`` are its own fields."""
    plain = lambda x: F.lit(x) if isinstance(x, str) else x
    own = F.to_variant_object(F.struct(*[v.alias(k) for k, v in facts.items()])) if facts else F.parse_json(F.lit("{}"))
    return rows.select(at.cast("timestamp").alias("at"), F.lit(run).alias("run"), plain(level).alias("level"), plain(event).alias("event"), own.alias("facts"))


def one(spark: SparkSession, run: str, event: str, level: str = "INFO", **facts: object) -> DataFrame:
    """A single event of the driver, which is told to standard logging as well."""
    driver.log(getattr(logging, level), "%s %s", event, facts)
    return of(spark.range(1), run, event, F.current_timestamp(), level, **{k: F.lit(v) for k, v in facts.items()})


def line(events: DataFrame) -> Column:
    """An event as a line of JSON, its time in UTC."""
    return F.to_json(F.struct(records.utc_text(F.col("at")).alias("at"), *[F.col(c) for c in events.columns if c != "at"]))


def append(events: DataFrame, path: str) -> None:
    """Add events to a folder of JSON lines."""
    events.select(line(events).alias("value")).write.mode("append").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The events of a folder."""
    text = F.col("value")
    parsed = F.try_parse_json(text)
    part = lambda name: F.try_variant_get(parsed, f"$.{name}", "string")
    fine = part("event").isNotNull()
    rows = spark.read.text(path).filter(F.trim("value") != "")
    return rows.select(
        F.when(fine, F.try_to_timestamp(part("at"))).alias("at"), F.when(fine, part("run")).alias("run"), F.when(fine, part("level")).otherwise("ERROR").alias("level"),
        F.when(fine, part("event")).otherwise(UNREADABLE).alias("event"), F.when(fine, F.try_variant_get(parsed, "$.facts", "variant")).otherwise(F.to_variant_object(F.struct(text.alias("line")))).alias("facts"),
    )
