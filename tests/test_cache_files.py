"""The folder of cached pages, read at once and as a stream."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from shelfmark.sources import cache_files


@pytest.fixture
def folder(spark, tmp_path):
    cache_files.register(spark)
    path = str(tmp_path / "cache")
    rows = spark.range(40).selectExpr("sha2(CAST(id AS STRING), 256) AS cache_key", "concat('https://s.test/', id) AS url", "CASE WHEN id = 39 THEN 404 ELSE 200 END AS status_code", "'text/html' AS content_type", "timestamp_seconds(id) AS fetched_at", "concat('<p>é ', id, '</p>\\r\\n') AS body")
    cache_files.store(rows, path)
    return tmp_path / "cache", rows


def _read(spark, path):
    return spark.read.format("page_cache").load(f"file://{path}")


def test_entries_come_back(spark, folder):
    path, rows = folder
    found = _read(spark, path)
    want = rows.filter("status_code = 200").withColumns({"content_hash": F.sha2("body", 256), "error": F.lit(None).cast("string")}).select(*found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and not list(path.rglob(".*"))


def test_broken_entries_are_error_rows(spark, folder):
    path, _ = folder
    metas = sorted(path.rglob("*.json"))
    metas[0].write_text("{cut")
    metas[1].write_text("[1]")
    metas[2].write_text(json.dumps(json.loads(metas[2].read_text()) | {"fetched_at": "never"}))
    metas[3].with_suffix(".body").unlink()
    metas[4].with_suffix(".body").write_text("changed")
    errors = {r.cache_key: r.error for r in _read(spark, path).filter("error IS NOT NULL").collect()}
    assert len(errors) == 5 and all(errors[m.stem].startswith("metadata: ") for m in metas[:3])
    assert errors[metas[3].stem] == "body: not there" and errors[metas[4].stem] == "body: another hash"
    assert _read(spark, path).filter("body IS NULL").count() == 5 and _read(spark, path).count() == 39


def test_a_filter_on_the_key_reads_those_entries(spark, folder):
    path, _ = folder
    keys = [m.stem for m in sorted(path.rglob("*.json"))[:3]]
    one = _read(spark, path).filter(F.col("cache_key") == keys[0])
    assert [r.cache_key for r in one.collect()] == keys[:1] and one.rdd.getNumPartitions() == 1
    some = _read(spark, path).filter(F.col("cache_key").isin(*keys, "none"))
    assert sorted(r.cache_key for r in some.collect()) == keys
    reader = cache_files._Reader(f"file://{path}")
    assert list(reader.pushFilters([cache_files.EqualTo(("url",), "x")])) and len(reader.partitions()) > 3


def test_stream_gives_the_same_rows_and_replacements(spark, folder, tmp_path):
    path, rows = folder
    out = str(tmp_path / "out")

    def run():
        stream = spark.readStream.format("page_cache").load(f"file://{path}")
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).start(out)
        q.processAllAvailable()
        q.stop()

    run()
    key = lambda r: (r.cache_key, r.body, r.error)
    assert sorted(map(key, spark.read.parquet(out).collect())) == sorted(map(key, _read(spark, path).collect()))
    cache_files.store(rows.limit(1).withColumn("body", F.lit("new")), str(path))
    run()
    assert spark.read.parquet(out).count() == 40 and spark.read.parquet(out).filter("body = 'new'").count() == 1


def test_no_folder(spark, tmp_path):
    cache_files.register(spark)
    assert _read(spark, tmp_path / "none").collect() == []
