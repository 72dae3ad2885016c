"""Ordered scans, look-ups and the error log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import commerce
from ..operators import runs, state
from . import derive
from .registry import query


@query(derive.sql("SELECT seq, product_url, name, brand FROM products ORDER BY seq", "products"))
def list_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.products(spark, sf_dir).select("seq", "product_url", "name", "brand").orderBy("seq")


@query(derive.sql(f"SELECT product_url, name, brand FROM products WHERE product_url = '{derive.SITE}77'", "products"))
def product_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.products(spark, sf_dir).filter(F.col("product_url") == f"{derive.SITE}77").select("product_url", "name", "brand")


@query(derive.sql("SELECT url, status, attempt_count FROM crawl_state WHERE status = 'failed' ORDER BY last_event, url", "crawl_state"))
def list_crawl_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.fold(derive.crawl_events(spark, sf_dir)).filter("status = 'failed'").orderBy("updated_seq", "url").select("url", "status", "attempt_count")


@query(
    derive.sql(
        """SELECT event_id, url, error AS error_message, greatest(1, attempts) AS attempt_number FROM (
               SELECT *, CAST(sum(CASE WHEN status = 'in_progress' THEN 1 ELSE 0 END) OVER (PARTITION BY url, round ORDER BY seq) AS BIGINT) AS attempts
               FROM (SELECT *, sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) OVER (PARTITION BY url ORDER BY seq) AS round FROM crawl_events)) WHERE status = 'failed'""",
        "crawl_events",
    )
)
def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.error_log(derive.crawl_events(spark, sf_dir)).select("event_id", "url", "error_message", "attempt_number")


@query(derive.sql("SELECT * FROM (SELECT 'brand' AS field, arg_min(product_url, seq) AS product_url FROM products WHERE brand IS NULL UNION ALL SELECT 'description', arg_min(product_url, seq) FROM products WHERE description IS NULL)", "products"))
def first_failing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aggregation for all fields."""
    missing = F.array_compact(F.array(F.when(F.col("brand").isNull(), F.lit("brand")), F.when(F.col("description").isNull(), F.lit("description"))))
    return derive.products(spark, sf_dir).select("seq", "product_url", F.explode(missing).alias("field")).groupBy("field").agg(F.min_by("product_url", "seq").alias("product_url"))


@query(derive.sql("SELECT category, sampled, paired, CASE WHEN sampled = 0 THEN 'skipped' WHEN paired = sampled THEN 'completed' WHEN paired > 0 THEN 'partial' ELSE 'failed' END AS status FROM (SELECT category, count(*) AS sampled, count(s.product_url) AS paired FROM products p LEFT JOIN shadow s USING (product_url) GROUP BY 1)", "shadow"))
def evidence_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    shadow = derive.shadow_products(spark, sf_dir).select("product_url", F.lit(1).alias("paired"))
    rows = derive.products(spark, sf_dir).join(shadow, "product_url", "left").groupBy("category").agg(F.count(F.lit(1)).alias("sampled"), F.count("paired").alias("paired"))
    return rows.withColumn("status", runs.evidence_status(F.col("paired"), F.col("sampled") - F.col("paired"), F.col("sampled")))


@query("SELECT p_partkey, greatest(pow(2.0, p_size % 4), coalesce(CASE p_partkey % 3 WHEN 0 THEN least(60.0, p_size * 2.0) END, 0.0)) AS delay FROM part")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.read(spark, sf_dir, "part").selectExpr("p_partkey", "p_size % 4 + 1 AS attempt", "CASE p_partkey % 3 WHEN 0 THEN cast(p_size * 2 AS string) WHEN 1 THEN 'soon' END AS header")
    return rows.select("p_partkey", commerce.retry_delay(F.col("attempt"), F.col("header")).alias("delay"))
