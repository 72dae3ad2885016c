"""Parts around the queries: settings, events, cache files, reports, decisions without rules."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from shelfmark import config, events
from shelfmark.functions import batches, commerce
from shelfmark.operators import evidence, locators, robots, state, validation
from shelfmark.sources import discovery, exports, pages


def test_settings(tmp_path):
    (tmp_path / "a.toml").write_text('site = "a.test"\nmax_products = 5\noffline = true\n')
    (tmp_path / "b.json").write_text('{"requests_per_second": 2}')
    a = config.load(tmp_path / "a.toml")
    assert (a.site, a.max_products, a.offline, a.max_retries) == ("a.test", 5, True, 2)
    assert config.load(tmp_path / "b.json").requests_per_second == 2
    assert a.with_changes(max_products=9, site=None) == config.Settings(site="a.test", max_products=9, offline=True)
    for wrong in ({"max_retries": -1}, {"max_retries": 1.5}, {"offline": 1}, {"site": ""}, {"agreement_threshold": 2}, {"repair_samples": 0}, {"nothing": 1}):
        (tmp_path / "c.json").write_text(json.dumps(wrong))
        with pytest.raises(ValueError):
            config.load(tmp_path / "c.json")


def test_events_are_written_and_read_as_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("u1", 3, "2024-03-01 10:00:00.25"), ("ü \"q\"", None, "2024-03-01 10:00:01")], "url string, n int, t string")
    events.append(events.of(rows, "r", "page_read", F.to_timestamp("t"), url=F.col("url"), n=F.col("n"), more=F.struct("n")), path)
    events.append(events.one(spark, "r", "done", "WARNING", pages=2), path)
    (tmp_path / "log" / "cut.txt").write_text('{"at":"2024-03-01T10:00:00+00:00","run":"r"\n\n[1]\n', encoding="utf-8")
    lines = sorted(x for f in (tmp_path / "log").glob("*.txt") for x in f.read_text(encoding="utf-8").splitlines() if '"page_read"' in x)
    assert json.loads(lines[0]) == {"at": "2024-03-01T10:00:00.250000+00:00", "run": "r", "level": "INFO", "event": "page_read", "facts": {"url": "u1", "n": 3, "more": {"n": 3}}}
    found = events.read(spark, path)
    assert [f.dataType.simpleString() for f in found.schema] == ["timestamp", "string", "string", "string", "variant"]
    got = {(r.event, r.level, r.u, r.n) for r in found.select("event", "level", F.try_variant_get("facts", "$.url", "string").alias("u"), F.try_variant_get("facts", "$.more.n", "int").alias("n")).collect()}
    assert got == {("page_read", "INFO", "u1", 3), ("page_read", "INFO", 'ü "q"', None), ("done", "WARNING", None, None), ("unreadable", "ERROR", None, None)}
    assert found.filter("event = 'unreadable'").count() == 2


def test_context_is_read_by_path(spark, tmp_path):
    rows = spark.createDataFrame([(1, '{"k": "a", "deep": {"x": [1, 2]}}'), (2, "{bad"), (3, None)], "id int, raw string")
    path = str(tmp_path / "errors")
    state.stored_errors(rows, path, F.try_parse_json("raw"))
    kept = state.stored_errors(rows.limit(1), path, F.try_parse_json("raw"))
    assert kept.schema["context"].dataType.simpleString() == "variant" and kept.count() == 4
    asked = kept.select("id", F.try_variant_get("context", "$.deep.x[1]", "int").alias("x"))
    assert sorted((r.id, r.x) for r in asked.collect()) == [(1, 2), (1, 2), (2, None), (3, None)]
    scanned = asked._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert "raw" not in scanned and "context:variant" not in scanned  # the one path of it, not the whole


def test_cache_is_replaced_in_one_step(spark, tmp_path):
    path = str(tmp_path / "cache")
    kind = "cache_key string, url string, status_code int, body string, fetched_at timestamp"
    rows = spark.sql("SELECT 'k' AS cache_key, 'u' AS url, s AS status_code, concat('b', s) AS body, timestamp_seconds(s) AS fetched_at FROM VALUES (200), (204), (404) t(s)")
    pages.append(rows, path)
    pages.append(spark.createDataFrame([("q", "v", 200, "x", None)], kind), path)
    pages.compact(spark, path)
    assert {(r.cache_key, r.body) for r in spark.read.parquet(path).collect()} == {("k", "b204"), ("q", "x")}
    (tmp_path / "cache").rename(tmp_path / "cache.old")  # stopped between the renames
    pages.compact(spark, path)
    assert spark.read.parquet(path).count() == 2 and not (tmp_path / "cache.old").exists()
    asked = spark.createDataFrame([("k", ""), ("none", "")], "cache_key string, body string")
    found = pages.look_up(asked, spark.read.parquet(path), 1, offline=True)
    assert pages.require_offline(found.filter("cache_key = 'k'")).count() == 1
    with pytest.raises(pages.OfflineMiss, match="none"):
        pages.require_offline(found)


def test_discovery_with_nothing_is_an_error(spark):
    none = spark.createDataFrame([], discovery.FOUND)
    assert discovery.discover(none, none).count() == 0
    with pytest.raises(discovery.NothingFound, match="timed out"):
        discovery.discover(none, none, primary_error="index timed out")


def test_unread_robots(spark):
    rows = robots.decide(spark.createDataFrame([(1, "https://s.test/")], "id int, url string"), None, "id")
    assert [r.decision for r in rows.collect()] == ["UNKNOWN"]
    assert [tuple(r) for r in rows.select(robots.admitted(F.col("decision")), robots.admitted(F.col("decision"), "allow")).collect()] == [(False, True)]


def test_evidence_choices(spark):
    rows = spark.createDataFrame([(i, f"u{i}") for i in range(9)], "seq int, url string")
    assert [r.url for r in evidence.choose(rows, 2).collect()] == ["u0", "u1"]
    assert {r.url for r in evidence.choose(rows, 2, ["u5", "u7", "u8"]).collect()} == {"u5", "u7", "u8"}
    off = evidence.results(rows, rows.withColumn("error", F.lit(None).cast("string")), configured=False)
    assert {(r.status, r.source) for r in off.collect()} == {("skipped", None)}


def test_only_the_first_candidates_are_tried(spark):
    samples = spark.createDataFrame([("name", "u", "<h1>a</h1>", "a")], "field string, url string, html string, expected string")
    tried = spark.createDataFrame([("name", f"c{i}", "css_text", "h2" if i < 4 else "h1", None, None, i) for i in range(6)], "field string, " + locators.CANDIDATES + ", rank int")
    fields = spark.createDataFrame([("name",)], "field string")
    assert locators.diagnose(fields, tried, samples).first().status == "rejected"
    assert locators.diagnose(fields, tried, samples, most=5).first().status == "validated"


def test_report_sections(spark):
    shares = spark.createDataFrame([("json_ld", 3, 0.75), ("not_available", 1, 0.25)], "source string, n long, share double")
    stack = exports.provenance_stack(shares)
    assert "flex:0.750000" in stack and "75%" in stack and "#eee" in stack
    fields = spark.createDataFrame([("name", "core", 1.0, 1), ("sku", "core", 0.5, 2), ("category_path", "advisory", 0.25, 1)], "field string, tier string, agreement double, position int")
    panel = exports.agreement_panel({"sample_size": 2, "overall_agreement": 0.75, "advisory_agreement": 0.25}, fields)
    assert panel.index("name") < panel.index("sku") < panel.index("category_path") and "core 75%" in panel
    assert "no sample: skipped" in exports.agreement_panel({"sample_size": 0, "status": "skipped"}, fields)
    page = exports.dashboard("T", {}, (stack, panel))
    assert stack in page and panel in page
    audits = spark.createDataFrame([("b", True, None), ("a", False, "x")], "check string, passed boolean, detail string")
    empty = spark.createDataFrame([], "field string, completeness double")
    report = exports.run_report({"status": "completed", "failures": 0}, spark.createDataFrame([], "category string, discovered long, status string"), empty, empty, shares, audits)
    assert report["audits"] == [{"check": "a", "passed": False, "detail": "x"}, {"check": "b", "passed": True, "detail": None}]


def test_page_batches_are_bounded():
    import pandas as pd

    frame = pd.DataFrame({"url": list("abcd"), "html": ["x" * 60, None, "y" * 60, "z" * 500]})
    parts = list(batches.by_size(iter([frame]), limit=100))
    assert [u for p in parts for u in p["url"]] == list("abcd")
    assert all(len(p) == 1 or p["html"].map(len, na_action="ignore").fillna(0).sum() <= 200 for p in parts) and len(parts) >= 3


def test_jitter_adds_to_the_wait(spark):
    rows = spark.range(200).select(commerce.retry_delay(F.lit(2), F.lit(None).cast("string"), extra=commerce.jitter(F.col("id"), 0.3)).alias("d")).collect()
    assert all(2.0 <= r.d < 2.3 for r in rows) and len({r.d for r in rows}) > 150


def test_children_of_other_parents_are_not_stored(spark):
    stored = spark.createDataFrame([("p", "a"), ("q", "a")], "p string, k string")
    new = spark.createDataFrame([("p", "b"), ("r", "z")], "p string, k string")
    out = state.replace_children(stored, new, spark.createDataFrame([("p",)], "p string"), "p")
    assert {tuple(r) for r in out.collect()} == {("p", "b"), ("q", "a")}


def test_records_that_break_the_contract(spark):
    kind = "product_url string, name string, price_visibility string, variants array<struct<product_url:string,price:string,currency:string,price_visibility:string>>"
    rows = spark.createDataFrame(
        [
            ("https://s.test/a", "A", "public", [("https://s.test/a", "1.50", "USD", "public")]),
            ("https://s.test/b", "B", "public", [("https://s.test/x", "1", "USD", "public")]),
            ("https://s.test/c", " ", "public", []),
            ("ftp://s.test/d", "D", "public", []),
            ("https://s.test/e", "E", "open", [("https://s.test/e", "-1", "US", "public")]),
        ],
        kind,
    )
    found = {r.product_url[-1]: r.broken for r in rows.select("product_url", validation.contract(rows).alias("broken")).collect()}
    assert found == {
        "a": [], "b": ["variant[0] product_url does not match product"], "c": ["name is required"], "d": ["product_url is no http(s) url"],
        "e": ["price_visibility is unknown: open", "variant[0] price is negative", "variant[0] currency is no code of three letters"],
    }
