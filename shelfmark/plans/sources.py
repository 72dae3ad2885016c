"""Queries over the page cache, discovery, urls and texts as they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import commerce, records, text, url as urls
from ..operators import ordering, state
from ..sources import cache_files, discovery, pages, shared
from . import derive
from .registry import query

TTL, NOW = 2 * 86_400, "2024-01-30 12:00:00"
HOST = "shop.test"


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached bodies per user: every seventh has lost its newlines' form, every eleventh is broken."""
    return derive.read(spark, sf_dir, "events").selectExpr(
        "concat('k', user_id) AS cache_key", "concat('{\"event\":', event_id, CASE WHEN event_id % 7 = 0 THEN '}\\r\\n' ELSE '}\\n' END) AS body",
        "CASE WHEN event_id % 11 = 0 THEN 'broken' ELSE sha2(concat('{\"event\":', event_id, '}\\n'), 256) END AS content_hash", "ts AS fetched_at", "200 AS status_code",
    )


@query(
    f"""WITH good AS (SELECT 'k' || user_id AS cache_key, '{{"event":' || event_id || '}}' || chr(10) AS body, sha256('{{"event":' || event_id || '}}' || chr(10)) AS h, ts FROM events WHERE event_id % 11 <> 0),
             newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY ts DESC, h DESC) AS r FROM good) WHERE r = 1)
        SELECT 'k' || c_custkey AS cache_key, CASE WHEN ts IS NULL THEN 'miss' WHEN epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)) <= {TTL} THEN 'hit' ELSE 'stale' END AS cache_state,
               CASE WHEN epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)) <= {TTL} THEN body END AS body
        FROM customer LEFT JOIN newest ON cache_key = 'k' || c_custkey"""
)
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's page: found, too old or not there, with bodies put right."""
    asked = derive.read(spark, sf_dir, "customer").selectExpr("concat('k', c_custkey) AS cache_key", "'' AS body")
    found = pages.look_up(asked, _cache(spark, sf_dir), TTL, F.to_timestamp(F.lit(NOW)))
    return found.select("cache_key", "cache_state", "body")


@query("SELECT url, 200 + page_id % 2 AS status_code, sha256(html) AS content_hash, length(html) AS characters FROM pages WHERE page_id % 7 <> 3")
def cached_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of a good status, stored as files and read back through the page cache format."""
    path = shared.folder(spark, "pages")
    rows = derive.read(spark, sf_dir, "pages").selectExpr("sha2(CAST(page_id AS STRING), 256) AS cache_key", "url", "CAST(CASE WHEN page_id % 7 = 3 THEN 500 ELSE 200 + page_id % 2 END AS INT) AS status_code", "'text/html' AS content_type", f"timestamp'{NOW}' AS fetched_at", "html AS body")
    cache_files.register(spark)
    cache_files.store(rows, path)
    found = spark.read.format("page_cache").load(path).filter("error IS NULL")
    return found.select("url", "status_code", "content_hash", F.length("body").alias("characters"))


@query("SELECT page_id, sha256('{\"method\":\"' || CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END || '\",\"url\":\"' || url || '\",\"headers\":[{\"name\":\"accept\",\"value\":\"html\"},{\"name\":\"x-page\",\"value\":\"' || page_id || '\"}],\"body\":\"' || CASE WHEN page_id % 2 = 0 THEN '' ELSE '{\\\"a\\\":1,\\\"b\\\":2}' END || '\"}') AS cache_key FROM pages")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of requests: header names in any case and order, JSON bodies in any order."""
    asked = derive.read(spark, sf_dir, "pages").selectExpr("page_id", "CASE WHEN page_id % 2 = 0 THEN 'get' ELSE 'Post' END AS method", "url", "map('X-Page', CAST(page_id AS STRING), 'ACCEPT', 'html') AS headers", "CASE WHEN page_id % 2 = 0 THEN NULL ELSE '{\"b\": 2, \"a\": 1}' END AS body")
    return pages.with_key(asked).select("page_id", "cache_key")


@query("SELECT page_id, CASE WHEN page_id % 6 >= 2 THEN 'status' WHEN page_id % 5 = 0 THEN 'cross_origin' WHEN page_id % 7 = 0 THEN 'robots' END AS refused FROM pages")
def usable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a fetched page may not be used."""
    found = derive.read(spark, sf_dir, "pages").selectExpr("page_id", "url", "element_at(array(200, 204, 301, 404, 500, 199), CAST(page_id % 6 + 1 AS INT)) AS status_code", "page_id % 7 <> 0 AS allowed")
    origin = urls.host(F.col("url"))
    final = F.when(F.col("page_id") % 5 == 0, "else.test").otherwise(origin)
    return pages.usable(found, origin, final, F.col("allowed")).select("page_id", "refused")


@query("SELECT p_partkey, p_partkey % 5 <> 0 AND p_partkey % 4 = 0 AS admissible FROM part")
def admissible_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product pages of the site that are no internal route and that robots allow."""
    made = f"CASE p_partkey % 4 WHEN 0 THEN concat('https://{HOST}/product/', p_partkey) WHEN 1 THEN concat('https://else.test/product/', p_partkey) WHEN 2 THEN concat('https://{HOST}/catalog/product/view/id/', p_partkey) ELSE 'https://{HOST}/' END"
    rows = derive.read(spark, sf_dir, "part").selectExpr("p_partkey", f"{made} AS url")
    return rows.select("p_partkey", urls.admissible_product(F.col("url"), HOST, F.col("p_partkey") % 5 != 0).alias("admissible"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index pages of up to ten hits per category, each page given twice; the index lacks categories from N on."""
    hit = F.expr(f"struct(place, struct(CAST(seq AS STRING) AS objectID, CASE WHEN seq % 3 = 0 THEN concat('https://else.test/', seq) WHEN seq % 3 = 1 THEN concat(product_url, '/?utm_source=index') END AS family_url, concat('HTTPS://{HOST}//product/', seq, '#x') AS url, CAST(size % 4 <> 0 AS INT) AS visibility_catalog, CASE WHEN size > 5 THEN array('all', 'size:large enough') ELSE array('all') END AS facets) AS hit)")
    rows = derive.products(spark, sf_dir).filter("category < 'N'").withColumn("place", F.expr("row_number() OVER (PARTITION BY category ORDER BY seq) - 1"))
    grouped = rows.withColumn("page", F.expr("CAST(place DIV 10 AS INT)")).groupBy("category", "page").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    once = grouped.select("category", "page", F.transform("hits", lambda h: h["hit"]).alias("hits"))
    return once.unionByName(once.withColumn("page", F.col("page") + 100_000))


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing page per category with all its products, and links that lead elsewhere."""
    link = F.expr("concat('{\"@type\":\"ListItem\",\"url\":\"/product/', seq, '\"}')")
    rows = derive.products(spark, sf_dir).groupBy("category").agg(F.array_sort(F.collect_list(F.struct("seq", link.alias("link")))).alias("l"))
    items = F.array_join(F.transform("l", lambda x: x["link"]), ",")
    html = F.concat(F.lit('<html><script type="application/ld+json">{"@type":"ItemList","itemListElement":['), items, F.lit(',{"url":"/about"}]}</script></html>'))
    return rows.select("category", F.concat(F.lit(f"https://{HOST}/catalog/"), F.lower("category")).alias("url"), html.alias("html"))


_INDEX_SQL = "SELECT category, product_url AS url, 'search_index' AS method, CAST((r // 10) * 1000000 + r % 10 AS BIGINT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY seq) - 1 AS r FROM products) WHERE category < 'N'"
_LISTED_SQL = "SELECT category, product_url AS url, 'json_ld_item_list' AS method, CAST(row_number() OVER (PARTITION BY category ORDER BY seq) - 1 AS BIGINT) AS position FROM products"


@query(derive.sql(_INDEX_SQL, "products"))
def discovery_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.from_index(_hits(spark, sf_dir), HOST)


@query(derive.sql("SELECT category, product_url AS url, 'search_index' AS method, CAST((r // 10) * 1000000 + r % 10 AS BIGINT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY r) AS n FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY seq) - 1 AS r FROM products) WHERE category < 'N' AND r < 40 AND size % 4 <> 0 AND size > 5) WHERE n <= 25", "products"))
def discovery_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that stops at the index's last page (the fourth) and at 25 urls a category, of visible hits of one facet."""
    hits = _hits(spark, sf_dir).withColumn("nb_pages", F.lit(4))
    sized = lambda hit: (hit["visibility_catalog"] == 1) & F.array_contains(hit["facets"], "size:large enough")
    return discovery.from_index(hits, HOST, limit=25, max_pages=50, wanted=sized)


@query(derive.sql(_LISTED_SQL, "products"))
def discovery_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.from_listings(_listings(spark, sf_dir), HOST)


@query(derive.sql(f"{_INDEX_SQL} UNION ALL SELECT * FROM ({_LISTED_SQL}) WHERE category >= 'N'", "products"))
def discovery_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's urls, and the listings' for categories that it lacks; the index side is worked out once and written."""
    path = shared.folder(spark, "index")
    discovery.from_index(_hits(spark, sf_dir), HOST).write.parquet(path)
    return discovery.discover(spark.read.parquet(path), discovery.from_listings(_listings(spark, sf_dir), HOST))


@query(
    derive.sql(
        """SELECT category, url, turn FROM (SELECT category, product_url AS url, row_number() OVER (PARTITION BY category ORDER BY seq) AS turn
           FROM products p LEFT JOIN crawl_state s ON s.url = p.product_url WHERE s.status IS NULL OR NOT (s.status IN ('completed', 'skipped') OR (s.status = 'failed' AND s.attempt_count > 2)))""",
        "products",
        "crawl_state",
    )
)
def crawl_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eligible urls, category by category in turn."""
    return crawl_queue(spark, sf_dir, 2, True, None)


def crawl_queue(spark: SparkSession, sf_dir: str, retries: int, resume: bool, limit: int | None) -> DataFrame:
    """The urls of a run, in turn."""
    found = derive.products(spark, sf_dir).select("category", F.col("product_url").alias("url"), F.lit("search_index").alias("method"), F.col("seq").alias("position"))
    known = state.fold(derive.crawl_events(spark, sf_dir))
    return discovery.plan(found, known, retries, resume, limit).select("category", "url", "turn")


@query("SELECT p_partkey, p_name || ' < 5' AS clean, 'a <' || p_size || '> b' AS plain, p_size % 2 = 0 AS marked FROM part")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup and entities out of texts; angle brackets that make no tag stay."""
    rows = derive.read(spark, sf_dir, "part").selectExpr("p_partkey", "concat('&lt;b&gt;', p_name, '</b>&nbsp; &lt;  5') AS a", "concat('a <', p_size, '> b') AS b", "CASE WHEN p_size % 2 = 0 THEN 'x<br>y' ELSE 'x < 5 > z' END AS c")
    return rows.select("p_partkey", text.clean_text(F.col("a")).alias("clean"), text.plain_text(F.col("b")).alias("plain"), text.has_markup(F.col("c")).alias("marked"))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE 'https://{HOST}/img/' || p_partkey || '.jpg?a=1&b=' || p_size END AS image FROM part")
def resolved_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image urls against their page: relative, absolute, or of a scheme that is not fetched."""
    raw = f"CASE p_partkey % 3 WHEN 0 THEN concat('../img/', p_partkey, '.jpg?b=', p_size, '&amp;a=1#f') WHEN 1 THEN concat('//{HOST.upper()}:443/img//', p_partkey, '.jpg?b=', p_size, '&utm_medium=x&a=1') ELSE 'data:image/png;base64,AA' END"
    rows = derive.read(spark, sf_dir, "part").selectExpr("p_partkey", f"{raw} AS raw", f"concat('https://{HOST}/product/', p_partkey) AS base")
    return rows.select("p_partkey", urls.resolve_url("raw", "base").alias("image"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' END AS code FROM part")
def currency_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.read(spark, sf_dir, "part").selectExpr("p_partkey", "CASE p_partkey % 4 WHEN 0 THEN ' usd ' WHEN 1 THEN 'EUR' WHEN 2 THEN 'dollars' END AS raw")
    return rows.select("p_partkey", commerce.currency(F.col("raw")).alias("code"))


@query("SELECT p_partkey, sha256('{\"brand\":' || CASE WHEN p_partkey % 11 <> 0 THEN '\"' || p_brand || '\"' ELSE 'null' END || ',\"facts\":{\"a\":{\"x\":1,\"y\":' || p_size || '},\"b\":{}},\"name\":\"' || p_name || '\"}') AS hash FROM part")
def stable_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of canonical JSON: keys in order at every depth, nulls kept."""
    rows = derive.read(spark, sf_dir, "part").selectExpr("p_partkey", "p_name AS name", "CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS brand", "map('b', CAST(map() AS MAP<STRING, INT>), 'a', map('y', p_size, 'x', 1)) AS facts")
    return rows.select("p_partkey", records.stable_hash(rows, "name", "facts", "brand").alias("hash"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 > 0 THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00' AS at FROM events")
def utc_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.read(spark, sf_dir, "events").select("event_id", records.utc_text(F.col("ts")).alias("at"))


@query("SELECT p_partkey, '&lt;' || replace(p_name, ' ', '&amp;') || ' &quot;' || p_size || '&quot;&gt;' AS shown, CASE WHEN p_size = 50 THEN '50%' WHEN p_size % 2 = 0 THEN p_size || '%' ELSE p_size || '.5%' END AS label FROM part")
def report_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.read(spark, sf_dir, "part").selectExpr("p_partkey", "concat('<', replace(p_name, ' ', '&'), ' \"', p_size, '\">') AS raw", "(p_size + CASE WHEN p_size % 2 = 0 THEN 0.0D ELSE 0.5D END) / 100 AS share")
    return rows.select("p_partkey", text.escape_html(F.col("raw")).alias("shown"), text.percentage(F.col("share")).alias("label"))


_KINDS = "CASE WHEN event_id % 3 = 0 THEN 'product' WHEN event_id % 3 = 1 THEN 'unknown' END"


@query(
    derive.sql(
        f"""SELECT url, coalesce(arg_max(kind, seq) FILTER (WHERE kind IS NOT NULL), arg_min(struct_pack(x := page_type), seq).x, 'unknown') AS page_type,
                   strftime(arg_max(CASE WHEN status = 'completed' THEN ts END, seq) FILTER (WHERE status = 'completed'), '%Y-%m-%d') AS fetched_on,
                   arg_max(hash, seq) FILTER (WHERE hash IS NOT NULL) AS content_hash
            FROM (SELECT *, CASE WHEN status <> 'pending' AND NOT (status = 'in_progress' AND coalesce(page_type, 'unknown') = 'unknown') THEN page_type END AS kind,
                         CASE WHEN status = 'completed' AND event_id % 2 = 0 THEN 'h' || event_id END AS hash FROM (SELECT *, {_KINDS} AS page_type FROM crawl_events)) GROUP BY url""",
        "crawl_events",
    )
)
def crawl_state_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What crawl states keep: page type, time of the last fetch, hash of the last content."""
    marked = derive.crawl_events(spark, sf_dir).selectExpr("*", f"{_KINDS} AS page_type", "CASE WHEN status = 'completed' THEN ts END AS fetched_at", "CASE WHEN status = 'completed' AND event_id % 2 = 0 THEN concat('h', event_id) END AS content_hash")
    return state.fold(marked).select("url", "page_type", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"), "content_hash")


@query(derive.sql("SELECT product_url AS url FROM products WHERE product_url NOT IN (SELECT url FROM crawl_state)", "products", "crawl_state"))
def enqueued_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The urls that enqueueing adds to the states."""
    known = state.fold(derive.crawl_events(spark, sf_dir))
    return state.inserted(known, derive.products(spark, sf_dir).select(F.col("product_url").alias("url")))


@query("SELECT 'k' || user_id AS cache_key, max(ts) AS fetched_at FROM events WHERE event_id % 11 <> 0 GROUP BY 1")
def intact_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each key whose body is whole, or can be put right."""
    good = _cache(spark, sf_dir).withColumn("body", pages.intact(F.col("body"), F.col("content_hash"))).filter("body IS NOT NULL")
    return ordering.latest(good, ["cache_key"], "fetched_at", "content_hash").select("cache_key", "fetched_at")
