"""Queries over runs, evidence of a second extractor, repairs and report sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agreement, evidence, extraction, locators, replies, runs, state
from ..sources import exports, shared
from . import comparison, derive, texts
from .registry import query


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over all products, with the states of those that have one."""
    known = state.fold(derive.crawl_events(spark, sf_dir)).select(F.col("url").alias("product_url"), "status", "attempt_count", F.col("updated_seq.ts").alias("ended"))
    variants = derive.variants(spark, sf_dir).groupBy("product_url").agg(F.count(F.lit(1)).alias("variants"))
    stored = derive.stored_products(spark, sf_dir).select("product_url", F.lit(True).alias("known"))
    rows = derive.products(spark, sf_dir).join(known, "product_url", "left").join(variants, "product_url", "left").join(stored, "product_url", "left")
    return rows.selectExpr(
        "category", "coalesce(status, 'completed') AS status", "CASE seq % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'cache' ELSE 'browser' END AS source", "coalesce(variants, 0) AS variants", "coalesce(attempt_count, 1) AS attempts",
        "size <= 5 AS shadow", "false AS fallback", "brand IS NULL AND size <= 5 AS repair", "coalesce(known, false) AS known", "timestamp'2024-01-01 00:00:00' AS started", "ended",
    )


_COUNTERS = derive.sql(
    """SELECT count(DISTINCT category) AS categories_processed, count(*) AS urls_discovered, count(*) FILTER (WHERE st = 'completed') AS products_extracted, CAST(coalesce(sum(n) FILTER (WHERE st = 'completed'), 0) AS BIGINT) AS variants_extracted,
              count(*) FILTER (WHERE seq % 3 = 0) AS http_fetches, count(*) FILTER (WHERE seq % 3 = 2) AS browser_fetches, count(*) FILTER (WHERE seq % 3 = 1) AS cache_hits,
              CAST(sum(greatest(coalesce(attempt_count, 1) - 1, 0)) AS BIGINT) AS retries, count(*) FILTER (WHERE st = 'failed') AS failures, count(*) FILTER (WHERE size <= 5) AS llm_shadow_runs, 0::BIGINT AS llm_fallback_runs,
              count(*) FILTER (WHERE size <= 5 AND brand IS NULL) AS repair_suggestions, count(*) FILTER (WHERE st = 'completed' AND size <= 35) AS duplicates_prevented,
              round((SELECT epoch_us(max(e.ts)) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') FROM crawl_events e WHERE e.url IN (SELECT product_url FROM products)) / 1000000.0, 3)::DOUBLE AS duration_seconds
       FROM (SELECT p.*, coalesce(s.status, 'completed') AS st, s.attempt_count, coalesce(v.n, 0) AS n FROM products p LEFT JOIN crawl_state s ON s.url = p.product_url LEFT JOIN (SELECT product_url, count(*) AS n FROM variants GROUP BY 1) v USING (product_url))""",
    "products",
    "variants",
    "crawl_state",
)


@query(_COUNTERS)
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.counters(_outcomes(spark, sf_dir))


@query(_COUNTERS)
def written_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's counters, counted while its outcomes are written."""
    return runs.counted_while_written(_outcomes(spark, sf_dir), shared.folder(spark, "outcomes"))


@query(derive.sql(f"SELECT g.product_url AS url, name, brand, CASE WHEN has_state THEN f.sku END AS sku, CASE WHEN has_state THEN f.item END AS item_number FROM {texts._PAGES} g LEFT JOIN (SELECT product_url, min(sku) AS sku, arg_min(i, sku) FILTER (WHERE i IS NOT NULL) AS item FROM (SELECT product_url, sku, arg_min(struct_pack(x := item_number), place).x AS i FROM variants WHERE sku IS NOT NULL GROUP BY 1, 2) GROUP BY 1) f ON f.product_url = g.product_url", "products", "variants"))
def known_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known-good values of repairable fields: the product's, or the first variant's that has one."""
    rows = extraction.extract(texts._product_pages(spark, sf_dir).select("url", "html"))
    return rows.select("url", *[evidence.known_value(f).alias(f) for f in ("name", "brand", "sku", "item_number")])


@query(derive.sql(f"SELECT product_url AS url, has_state::INT + (k = 0)::INT + 4 AS lines, has_state AS assigned, '<h1 class=\"title\" data-seq=\"' || seq || '\"> ' || name AS title FROM {texts._PAGES}", "products", "variants"))
def repair_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a repair is shown of every page: window assignments, cut to their limit, and the elements a selector could name."""
    shown = evidence.with_context(texts._product_pages(spark, sf_dir).select("url", "html"), "repair")
    lines = F.split("context", "\n")
    assigned = F.exists(lines, lambda x: F.startswith(x, F.lit("window.masterData = ")) & (F.length(x) <= evidence.ASSIGNMENT_CHARS))
    return shown.select("url", F.size(lines).alias("lines"), assigned.alias("assigned"), F.get(F.filter(lines, lambda x: F.startswith(x, F.lit("<h1"))), 0).alias("title"))


@query(derive.sql("SELECT c.category, CAST(coalesce(n, 0) AS BIGINT) AS discovered, CAST(coalesce(d, 0) AS BIGINT) AS degraded, CASE WHEN c.category = 'PROMO' THEN 'skipped' WHEN coalesce(n, 0) = 0 THEN 'failed' WHEN d > 0 THEN 'degraded' ELSE 'completed' END AS status FROM (SELECT DISTINCT category FROM products) c LEFT JOIN (SELECT category, count(*) AS n, count(*) FILTER (WHERE seq % 2 = 0 AND category > 'M') AS d FROM products WHERE category NOT IN ('LARGE', 'PROMO') GROUP BY 1) x USING (category)", "products"))
def discovery_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories with nothing found, skipped, found by the fallback, and found."""
    asked = derive.products(spark, sf_dir).select("category", (F.col("category") != "PROMO").alias("enabled"))
    fell_back = (F.col("seq") % 2 == 0) & (F.col("category") > "M")
    found = derive.products(spark, sf_dir).filter("category NOT IN ('LARGE', 'PROMO')").select("category", F.when(fell_back, "json_ld_item_list").otherwise("search_index").alias("method"))
    return runs.discovery(found, asked)


@query(derive.sql("SELECT product_url AS url, CASE WHEN s.product_url IS NULL THEN 'skipped' WHEN s.brand IS NULL THEN 'failed' ELSE 'completed' END AS status, CASE WHEN s.product_url IS NULL THEN 'no answer' WHEN s.brand IS NULL THEN 'no brand' END AS reason, CASE WHEN s.brand IS NOT NULL THEN 'llm_shadow' END AS source FROM products p LEFT JOIN shadow s USING (product_url)", "shadow"))
def evidence_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the second extraction of every product."""
    sampled = derive.products(spark, sf_dir).select(F.col("product_url").alias("url"))
    answers = derive.shadow_products(spark, sf_dir).select(F.col("product_url").alias("url"), F.when(F.col("brand").isNull(), "no brand").alias("error"))
    return evidence.results(sampled, answers)


_REPLY = """CASE seq % 7
    WHEN 0 THEN '```json' || chr(10) || body || chr(10) || '```'
    WHEN 1 THEN substr(body, 1, length(body) - 20)
    WHEN 2 THEN replace(body, '"name":"', '"name":7,"note":"')
    WHEN 3 THEN replace(body, '"price":12.5', '"price":[12.5],"weight":1')
    WHEN 4 THEN 'I can not read this page.'
    ELSE body END"""
_BODY = """'{"product":{"name":"' || name || '","product_url":"' || product_url || '","brand":' || coalesce('"' || brand || '"', 'null') || ',"category_path":["a","b"],"image_urls":[],"price_visibility":"public"},"variants":[{"sku":"S' || seq || '","price":12.5,"option_values":{"Size":"L"}},{"sku":"","price":"3.10","currency":"EUR"}],"variants_complete":true}'"""


@query(
    derive.sql(
        """SELECT product_url AS url, CASE WHEN seq % 7 IN (0, 5, 6) THEN 'completed' ELSE 'failed' END AS status,
                  CASE seq % 7 WHEN 1 THEN 'no JSON' WHEN 2 THEN 'product.name is no text; product.note is not a field' WHEN 3 THEN 'variants[0].price is no amount; variants[0].weight is not a field' WHEN 4 THEN 'no JSON' END AS reason,
                  CASE WHEN seq % 7 IN (0, 5, 6) THEN name END AS name, CASE WHEN seq % 7 IN (0, 5, 6) THEN CASE WHEN brand IS NULL THEN 'category_path,name,price_visibility,product_url' ELSE 'brand,category_path,name,price_visibility,product_url' END END AS stamped,
                  CASE WHEN seq % 7 IN (0, 5, 6) THEN 'option_values,price,sku|currency,price' END AS variants_stamped, CASE WHEN seq % 7 IN (0, 5, 6) THEN '12.5,3.10' END AS prices
           FROM shadow""",
        "shadow",
    )
)
def shadow_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a second extractor as records: fenced, cut, of wrong types, with fields that are none, and no JSON at all."""
    rows = derive.shadow_products(spark, sf_dir).selectExpr("product_url AS url", "seq", f"{_BODY} AS body").selectExpr("url", f"{_REPLY} AS reply")
    found = replies.records(rows)
    names = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ",")
    stamped = F.array_join(F.transform("variants", lambda v: names(v["field_provenance"])), "|")
    return found.select("url", "status", "reason", "product.name", names("product.field_provenance").alias("stamped"), stamped.alias("variants_stamped"), F.array_join(F.transform("variants", lambda v: v["price"]), ",").alias("prices"))


@query(derive.sql(f"SELECT product_url AS url, true AS has_data, has_state AND k > 0 AND items > 0 AS has_state, false AS truncated FROM (SELECT g.*, items FROM {texts._PAGES} g LEFT JOIN (SELECT product_url, count(x) AS items FROM (SELECT product_url, sku, arg_min(struct_pack(x := item_number), place).x AS x FROM variants WHERE sku IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (product_url))", "products", "variants"))
def evidence_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second extractor is shown of every page."""
    return evidence.flags(texts._product_pages(spark, sf_dir).select("url", "html"))


@query(derive.sql("SELECT product_url, url, position FROM (SELECT product_url, product_url AS url, CAST(row_number() OVER (ORDER BY seq) AS INTEGER) AS position FROM products) WHERE position <= 12", "products"))
def shadow_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve pages that a run shows a second extractor: the limit is the feature."""
    chosen = evidence.choose(derive.products(spark, sf_dir).select("seq", "product_url", F.col("product_url").alias("url")), 12)
    return chosen.withColumn("position", F.expr("row_number() OVER (ORDER BY seq)")).drop("seq")


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_url, seq, m): this run's values over which stored ones win."""
    values = lambda df, name: df.select("product_url", F.expr("map('brand', brand, 'description', description)").alias(name))
    rows = derive.products(spark, sf_dir).select("product_url", "seq").join(values(derive.products(spark, sf_dir), "now"), "product_url").join(values(derive.stored_products(spark, sf_dir), "old"), "product_url", "left")
    return rows.select("product_url", "seq", evidence.known_values(F.col("now"), F.col("old")).alias("m"))


@query(derive.sql("SELECT p.product_url, coalesce(s.brand, p.brand) AS brand, coalesce(s.description, p.description) AS description FROM products p LEFT JOIN stored s USING (product_url)", "stored"))
def known_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known-good values of every page."""
    return _known(spark, sf_dir).select("product_url", F.try_element_at("m", F.lit("brand")).alias("brand"), F.try_element_at("m", F.lit("description")).alias("description"))


@query(derive.sql("SELECT url, expected FROM (SELECT p.product_url AS url, coalesce(s.brand, p.brand) AS expected, row_number() OVER (ORDER BY p.seq) AS r FROM products p LEFT JOIN stored s USING (product_url) WHERE coalesce(s.brand, p.brand) IS NOT NULL) WHERE r <= 8", "stored"))
def repair_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight known-good pages that a brand's repair is held against: the limit is the feature."""
    pages = _known(spark, sf_dir).select("seq", F.col("product_url").alias("url"), F.lit("").alias("html"), F.col("m").alias("values"))
    return evidence.repair_samples(pages, "brand").select("url", "expected")


@query("SELECT * FROM (VALUES ('name', 'validated', NULL), ('brand', 'rejected', 'no candidate finds every known value'), ('sku', 'failed', 'no candidate proposed'), ('price', 'skipped', 'no known-good samples')) t(field, status, reason)")
def repair_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of four fields, held against every generated page."""
    pages = texts._product_pages(spark, sf_dir)
    samples = pages.select("url", "html", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col("name").alias("expected")) for f in ("name", "brand", "sku")])).alias("s")).select("url", "html", "s.*")
    tried = spark.createDataFrame([("name", "a", "css_text", "h2", None, None), ("name", "b", "css_text", "h1.title", None, None), ("brand", "a", "css_attribute", "h1", "data-seq", None), ("brand", "b", "css_text", "h1:hover", None, None)], "field string, " + locators.CANDIDATES)
    return locators.diagnose(spark.createDataFrame([(f,) for f in ("name", "brand", "sku", "price")], "field string"), tried, samples)


@query(derive.sql("SELECT field AS named, CASE bare WHEN 'brand' THEN 'brand' WHEN 'sku' THEN 'sku' END AS field, n FROM (SELECT unnest(['brand', 'variant: sku', 'variants_complete']) AS field, unnest(['brand', 'sku', 'x']) AS bare, unnest([(SELECT count(*) FROM products WHERE brand IS NULL), (SELECT count(*) FROM variants WHERE sku IS NULL), (SELECT count(*) FROM products)]) AS n)", "products", "variants"))
def repair_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that pages lack, with the field a repair may be proposed for."""
    p, v = derive.products(spark, sf_dir), derive.variants(spark, sf_dir)
    lacks = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("named"), "n")
    rows = lacks(p.filter("brand IS NULL"), "brand").unionByName(lacks(v.filter("sku IS NULL"), "variant: sku")).unionByName(lacks(p, "variants_complete"))
    return rows.select("named", evidence.field_name(F.col("named")).alias("field"), "n")


@query(derive.sql(f"SELECT 'completed' AS status, count(*) AS sample_size, round(avg(o), 9) AS overall_agreement, round(avg(a), 9) AS advisory_agreement FROM {comparison._PER_PRODUCT}", "shadow", "shadow_last"))
def agreement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run without a sample reports: the populated report of the run before."""
    row = agreement.batch(agreement.tier_means(*comparison._product_scores(spark, sf_dir))).first()
    full = exports.agreement_report("completed", row.sample_size, row.overall_agreement, row.advisory_agreement, {})
    kept = exports.agreement_report("skipped", 0, None, None, {}, full)
    status = full["status"] if kept["status"] == "preserved" else kept["status"]
    return spark.createDataFrame([(status, kept["sample_size"], round(kept["overall_agreement"], 9), round(kept["advisory_agreement"], 9))], "status string, sample_size long, overall_agreement double, advisory_agreement double")
