"""First-seen dedup, interleaving and other operators that depend on order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key.  Spark keeps one row per key on each map task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def latest(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    return first_seen(df, keys, [F.desc(time), F.desc(tie)])


def round_robin(df: DataFrame, category: str, position: str, category_order: str, limit: int | None = None) -> DataFrame:
    """First of every category, then the second of every one, and so on.

    With a limit no category's turn is beyond it, so that each keeps only its first
    ``limit`` rows on every map task.
    """
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(category).orderBy(position)))
    ordered = (ranked if limit is None else ranked.filter(F.col("turn") <= limit)).orderBy("turn", category_order)
    return ordered.limit(limit) if limit is not None else ordered


def mark_duplicates(df: DataFrame, keys: list[str], order: list[Column], content: Column) -> DataFrame:
    """Adds ``verdict``: kept, duplicate or conflicting (other content than the kept row)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_content", content).withColumn("_rank", F.row_number().over(w)).withColumn("_first", F.first("_content").over(w))
    verdict = F.when(F.col("_rank") == 1, "kept").when(F.col("_content") == F.col("_first"), "duplicate").otherwise("conflicting")
    return marked.withColumn("verdict", verdict).drop("_content", "_rank", "_first")


def best(df: DataFrame, keys: list[str], score: list[Column], position: str, value: Column) -> DataFrame:
    """Per key the value with the largest score, the first on ties."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*score, (-F.col(position)).alias("_p"))).alias("best"))
