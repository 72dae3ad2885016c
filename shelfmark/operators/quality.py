"""Completeness, provenance, counts and coverage of a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Provenance sources in the order reports show them.
SOURCES = ("json_ld", "embedded_state", "api", "dom", "derived", "llm_shadow", "llm_fallback", "not_available")


def populated(df: DataFrame, name: str, unknown_counts: bool) -> Column:
    """Whether a value is neither null nor empty; ``unknown`` counts only where asked."""
    kind, col = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(col) > 0, F.lit(False))
    text = F.trim(col.cast("string"))
    empty = ["", "[]", "{}", "null"] if unknown_counts else ["", "unknown"]
    return F.coalesce(~text.isin(empty), F.lit(False))


def completeness(df: DataFrame, fields: list[str], unknown_counts: bool = False, decimals: int | None = 4) -> DataFrame:
    """(field, completeness, populated): one pass over the table for all fields."""
    shares = [F.coalesce(F.avg(F.when(populated(df, f, unknown_counts), 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"s_{f}") for f in fields]
    counts = [F.count(F.when(populated(df, f, unknown_counts), 1)).alias(f"n_{f}") for f in fields]
    row = df.agg(*shares, *counts)
    value = lambda f: F.round(F.col(f"s_{f}"), decimals) if decimals is not None else F.col(f"s_{f}")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), value(f).alias("completeness"), F.col(f"n_{f}").alias("populated")) for f in fields])
    return row.select(F.inline(cells))


def provenance_counts(*tables: DataFrame, column: str = "field_provenance") -> DataFrame:
    """(source, n) over the provenance maps of all tables."""
    rows = tables[0].select(column)
    for more in tables[1:]:
        rows = rows.unionByName(more.select(column))
    return rows.select(F.explode(F.map_values(column)).alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def with_report_order(counts: DataFrame) -> DataFrame:
    """Adds ``position``: the fixed order first, other sources after it."""
    at = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    return counts.withColumn("position", F.when(at > 0, at).otherwise(99).cast("int"))


def with_share(counts: DataFrame) -> DataFrame:
    """Adds each source's share of all.  The input has one row per source."""
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def with_bar(counts: DataFrame) -> DataFrame:
    """Adds each count divided by the largest.  The input has one row per group."""
    top = counts.agg(F.max("n").alias("_top"))
    return counts.crossJoin(F.broadcast(top)).withColumn("bar", F.col("n") / F.col("_top")).drop("_top")


def group_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def top(df: DataFrame, key: Column, k: int, name: str) -> DataFrame:
    """The k most frequent values, ties by name; null is left out."""
    return df.select(key.alias(name)).filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name).limit(k)


def category_label(path: Column) -> Column:
    """Levels two and three of a category path; null for paths with one level."""
    return F.when(F.size(path) >= 2, F.array_join(F.slice(path, 2, 2), " > "))


def full_path(path: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(path, " > "), F.lit("")), F.lit("unknown"))


def coverage(products: DataFrame, discovered: DataFrame) -> DataFrame:
    """(products, discovered, coverage); coverage is null where nothing was discovered."""
    a = products.agg(F.count(F.lit(1)).alias("products"))
    b = discovered.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("discovered"))
    return a.crossJoin(b).withColumn("coverage", F.try_divide(F.col("products").cast("double"), F.col("discovered").cast("double")))
