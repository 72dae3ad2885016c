"""The page cache as a table: look-up with a time to live, integrity, storing.

Rows: cache_key, url, status_code, body, content_hash, fetched_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records
from ..operators import ordering


def with_key(requests: DataFrame) -> DataFrame:
    """Adds cache_key to requests (method, url, headers map, body)."""
    none = F.create_map().cast("map<string,string>")
    return requests.withColumn("cache_key", records.cache_key(F.col("method"), F.col("url"), F.coalesce("headers", none), F.coalesce("body", F.lit(""))))


def intact(body: Column, content_hash: Column) -> Column:
    """The body, or it with its newlines repaired, whose hash is the stored one; else null."""
    unix = F.replace(body, F.lit("\r\n"), F.lit("\n"))
    candidates = F.array(body, unix, F.replace(unix, F.lit("\n"), F.lit("\r\n")))
    return F.get(F.filter(candidates, lambda b: F.sha2(b, 256) == content_hash), 0)


def look_up(requests: DataFrame, cache: DataFrame, ttl_seconds: int, now: Column | None = None, offline: bool = False, refresh: bool = False) -> DataFrame:
    """requests with body, fetched_at and cache_state: hit, stale or miss.

    The newest intact row of each key counts.  Offline, a stale row is a hit;
    with refresh nothing is.
    """
    good = cache.withColumn("body", intact(F.col("body"), F.col("content_hash"))).filter("body IS NOT NULL")
    newest = ordering.latest(good, ["cache_key"], "fetched_at", "content_hash").select("cache_key", "body", "fetched_at", "status_code")
    asked = requests.drop("body").join(newest, "cache_key", "left")
    age = F.unix_timestamp(now if now is not None else F.current_timestamp()) - F.unix_timestamp("fetched_at")
    fresh = F.lit(offline) | (age <= ttl_seconds)
    state = F.when(F.lit(refresh) | F.col("fetched_at").isNull(), "miss").when(fresh, "hit").otherwise("stale")
    return asked.withColumn("cache_state", state).withColumn("body", F.when(F.col("cache_state") == "hit", F.col("body")))


def storable(results: DataFrame) -> DataFrame:
    """Fetched rows that may be cached: 2xx and 3xx, with their hash."""
    return results.filter("status_code BETWEEN 200 AND 399").withColumn("content_hash", F.sha2("body", 256))


def append(results: DataFrame, path: str) -> None:
    storable(results).write.mode("append").parquet(path)


class OfflineMiss(LookupError):
    """A page is asked for offline that the cache does not have."""


def require_offline(found: DataFrame) -> DataFrame:
    """The rows of an offline look-up; a miss among them is an error that names it."""
    missing = found.filter("cache_state <> 'hit'").select("cache_key").limit(1).collect()
    if missing:
        raise OfflineMiss(f"not in the cache: {missing[0].cache_key}")
    return found


def compact(spark: SparkSession, path: str) -> None:
    """Replace the cache by the newest intact row of each key: written aside, then put in place by renaming."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, aside, old = (jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}{end}") for end in ("", ".next", ".old"))
    files = at.getFileSystem(conf)
    if not files.exists(at) and files.exists(old):  # an earlier run was stopped between the two renames
        files.rename(old, at)
    rows = spark.read.parquet(path)
    good = rows.withColumn("body", intact(F.col("body"), F.col("content_hash"))).filter("body IS NOT NULL")
    ordering.latest(good, ["cache_key"], "fetched_at", "content_hash").select(*rows.columns).write.mode("overwrite").parquet(aside.toString())
    files.delete(old, True)
    files.rename(at, old)
    files.rename(aside, at)
    files.delete(old, True)


def usable(pages: DataFrame, origin: Column, final_origin: Column, allowed: Column) -> DataFrame:
    """Adds ``refused``: why a fetched page may not be used, null if it may."""
    ok = F.col("status_code").between(200, 299)
    return pages.withColumn("refused", F.when(~ok, "status").when(origin != final_origin, "cross_origin").when(~allowed, "robots"))
