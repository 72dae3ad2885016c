"""Queries over crawl events, states, errors, cached pages and robots rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import events
from ..functions import url as urls
from ..operators import ordering, quality, robots, runs, state
from ..sources import shared
from . import derive
from .registry import query

RETRIES = 2


@query(derive.sql("SELECT url, status, attempt_count, last_error, last_event FROM crawl_state", "crawl_state"))
def state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.fold(derive.crawl_events(spark, sf_dir)).select("url", "status", "attempt_count", "last_error", F.col("updated_seq.event_id").alias("last_event"))


@query(derive.sql("SELECT status AS value, count(*) AS n FROM crawl_state GROUP BY 1", "crawl_state"))
def crawl_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.group_counts(state.fold(derive.crawl_events(spark, sf_dir)), "status")


@query("SELECT json_extract_string(props, '$.k') AS value, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def error_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.group_counts(derive.crawl_events(spark, sf_dir).filter("status = 'failed'").select(F.get_json_object("props", "$.k").alias("k")), "k")


@query("SELECT event_id, user_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'error' ORDER BY event_id")
def json_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of every error's context, read from the stored table, where it is a VARIANT."""
    rows = derive.read(spark, sf_dir, "events").filter("event_type = 'error'")
    kept = state.stored_errors(rows.select("event_id", "user_id", "props"), shared.folder(spark, "errors"), F.try_parse_json("props"))
    return kept.select("event_id", "user_id", F.try_variant_get("context", "$.k", "string").alias("k")).orderBy("event_id")


_LEVEL = "CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END"


@query(
    f"""SELECT event_id, '{{"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 > 0 THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00","run":"r1","level":"' || {_LEVEL}
               || '","event":"' || event_type || '","facts":{{"event_id":' || event_id || ',"k":"' || json_extract_string(props, '$.k') || '","user":"u' || user_id || '"}}}}' AS line FROM events"""
)
def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a line of JSON, with its own facts."""
    found = _run_events(spark, sf_dir)
    return found.select(F.variant_get("facts", "$.event_id", "long").alias("event_id"), events.line(found).alias("line"))


@query(f"SELECT level, event_type AS event, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT *, {_LEVEL} AS level FROM events) GROUP BY 1, 2")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a run by kind, from the lines that were written."""
    path = shared.folder(spark, "log")
    events.append(_run_events(spark, sf_dir), path)
    return events.read(spark, path).groupBy("level", "event").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.variant_get("facts", "$.user", "string")).alias("users"))


def _run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.read(spark, sf_dir, "events")
    return events.of(rows, "r1", F.col("event_type"), F.col("ts"), F.expr(_LEVEL), event_id=F.col("event_id"), k=F.try_variant_get(F.try_parse_json("props"), "$.k", "string"), user=F.expr("'u' || user_id"))


@query(derive.sql(f"SELECT p.product_url, s.status, CASE WHEN s.status IS NULL THEN true WHEN s.status IN ('completed', 'skipped') THEN false WHEN s.status = 'failed' THEN s.attempt_count <= {RETRIES} ELSE true END AS eligible FROM products p LEFT JOIN crawl_state s ON s.url = p.product_url", "products", "crawl_state"))
def eligible_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = state.fold(derive.crawl_events(spark, sf_dir)).select(F.col("url").alias("product_url"), "status", "attempt_count")
    joined = derive.products(spark, sf_dir).select("product_url").join(known, "product_url", "left")
    return joined.select("product_url", "status", state.eligible(F.col("status"), F.col("attempt_count"), RETRIES).alias("eligible"))


@query(derive.sql(f"SELECT url, status, attempt_count FROM crawl_state WHERE status IN ('pending', 'in_progress') OR (status = 'failed' AND attempt_count <= {RETRIES})", "crawl_state"))
def resumable_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.resumable(state.fold(derive.crawl_events(spark, sf_dir)), RETRIES).select("url", "status", "attempt_count")


@query(derive.sql("SELECT url, status FROM crawl_state UNION ALL SELECT product_url, 'pending' FROM products WHERE product_url NOT IN (SELECT url FROM crawl_state)", "products", "crawl_state"))
def enqueue_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = state.fold(derive.crawl_events(spark, sf_dir)).select("url", "status", "attempt_count", "last_error", F.lit(None).cast("long").alias("updated_seq"))
    return state.enqueue(known, derive.products(spark, sf_dir).select(F.col("product_url").alias("url"))).select("url", "status")


@query("SELECT user_id AS cache_key, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.read(spark, sf_dir, "events").selectExpr("user_id AS cache_key", "event_id", "value", "ts")
    return ordering.latest(rows, ["cache_key"], "ts", "event_id").drop("ts")


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_PATH = r"coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')"
_QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"


@query(f"SELECT page_id, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS query FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return derive.read(spark, sf_dir, "pages").select("page_id", urls.host(u).alias("host"), urls.path(u).alias("path"), urls.query(u).alias("query"))


ROBOTS = "User-agent: *\nDisallow: /fr/\nDisallow: /*ref=\nAllow: /en/\nDisallow: /en/*.html$\n"


@query(
    f"""SELECT page_id, CASE WHEN coalesce(arg_max(allow, specificity * 2 + allow::INT), true) THEN 'ALLOWED' ELSE 'DISALLOWED' END AS decision
        FROM (SELECT page_id, {_PATH} || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END AS target FROM pages) p
        LEFT JOIN (VALUES (false, '^/fr/', 4), (false, '^/.*ref=', 5), (true, '^/en/', 4), (false, '^/en/.*\\.html$', 9)) r(allow, regex, specificity) ON regexp_matches(p.target, r.regex)
        GROUP BY page_id"""
)
def robots_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = robots.rules_table(spark, robots.parse(ROBOTS))
    return robots.decide(derive.read(spark, sf_dir, "pages"), rules, "page_id")


#: Robots texts by the number of their site; the fifth kind could not be read.
_ROBOTS = {
    1: "User-agent: *\\nDisallow: /F/\\nAllow: /F/1\\nDisallow: /*?ref=\\n",
    2: "User-agent: other\\nDisallow: /\\n\\nUser-agent: shelfmark\\nDisallow: /O/*.html$\\nAllow: /O/1*5.html$\\nDisallow: /F/\\n",
    3: "# none\\n",
    4: "User-agent: *\\nDisallow: /\\nAllow: /site-",
}
_RULES = """(VALUES (1, false, '^/F/', 3), (1, true, '^/F/1', 4), (1, false, '^/.*\\?ref=', 6), (2, false, '^/O/.*\\.html$', 8), (2, true, '^/O/1.*5\\.html$', 9), (2, false, '^/F/', 3), (4, false, '^/', 1)) r(kind, allow, regex, specificity)"""
_TARGET = "CASE WHEN o_custkey % 5 = 4 AND o_orderkey % 2 = 0 THEN '/site-' || o_custkey || '/' ELSE '/' || o_orderstatus || '/' END || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '.html' WHEN o_orderkey % 3 = 1 THEN '/x?ref=a' ELSE '/' END"


@query(
    f"""WITH targets AS (SELECT o_orderkey, o_custkey % 5 AS kind, o_custkey, {_TARGET} AS target FROM orders),
             met AS (SELECT o_orderkey, allow, specificity FROM targets JOIN {_RULES} ON r.kind = targets.kind AND regexp_matches(target, regex)
                     UNION ALL SELECT o_orderkey, true, length('/site-' || o_custkey || '/') FROM targets WHERE kind = 4 AND starts_with(target, '/site-' || o_custkey || '/')),
             best AS (SELECT o_orderkey, arg_max(allow, specificity * 2 + allow::INT) AS allow FROM met GROUP BY 1)
        SELECT o_orderkey, CASE WHEN kind = 0 THEN 'UNKNOWN' WHEN coalesce(allow, true) THEN 'ALLOWED' ELSE 'DISALLOWED' END AS decision FROM targets LEFT JOIN best USING (o_orderkey)"""
)
def robots_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a page of its customer's site, by the robots rules of all sites."""
    text = "CASE c_custkey % 5 " + " ".join(f"WHEN {k} THEN '{v}'" + (" || c_custkey || '/'" if k == 4 else "") for k, v in _ROBOTS.items()) + " END"
    sites = derive.read(spark, sf_dir, "customer").selectExpr("'shop' || c_custkey || '.test' AS host", f"{text} AS text")
    pages = derive.read(spark, sf_dir, "orders").selectExpr("o_orderkey", f"'https://SHOP' || o_custkey || '.test' || {_TARGET} AS url")
    return robots.decide_sites(pages, sites, "o_orderkey", agent="shelfmark/1.0")


@query(f"SELECT page_id, CASE WHEN {_PATH} LIKE '/en/%' THEN 'product' WHEN {_PATH} LIKE '/fr/%' THEN 'category' ELSE 'unknown' END AS page_type, CASE WHEN {_PATH} LIKE '/en/%' THEN 0.85 WHEN {_PATH} LIKE '/fr/%' THEN 0.75 ELSE 0.0 END::DOUBLE AS confidence FROM pages")
def classify_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The url part of the cascade, with this data's prefixes: no page has structured data."""
    from ..operators import extraction

    return extraction.classify_by_url(derive.read(spark, sf_dir, "pages"), product_prefixes=("/en/",), category_prefixes=("/fr/",)).select("page_id", "page_type", "confidence")


@query(derive.sql("SELECT category, count(*) AS discovered, count(*) FILTER (WHERE seq % 3 = 0) AS degraded, CASE WHEN count(*) = 0 THEN 'failed' WHEN count(*) FILTER (WHERE seq % 3 = 0) > 0 THEN 'degraded' ELSE 'completed' END AS status FROM products GROUP BY 1", "products"))
def discovery_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.products(spark, sf_dir).select("category", F.when(F.col("seq") % 3 == 0, "json_ld_item_list").otherwise("search_index").alias("method"))
    return runs.discovery(rows)


@query(derive.sql("SELECT count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) AS planned, CASE WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN CASE WHEN count(*) FILTER (WHERE status = 'completed') > 0 THEN 'partial' ELSE 'failed' END WHEN count(*) = 0 THEN 'failed' ELSE 'completed' END AS status FROM crawl_state", "crawl_state"))
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.summary(state.fold(derive.crawl_events(spark, sf_dir)).select("status"))


@query("SELECT event_id, user_id, coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS latched FROM events")
def quota_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.read(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("gave_up"))
    return runs.latch(rows, "user_id", ["ts", "event_id"], "gave_up").select("event_id", "user_id", "latched")
