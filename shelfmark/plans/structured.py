"""Queries over the structured data of pages: the walk, page classes, best products, breadcrumbs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extraction, structured
from . import derive
from .registry import query

#: JSON of a page's nodes; the same expressions in both engines.
_CRUMBS = """'{"@type":"BreadcrumbList","itemListElement":[{"position":3,"name":"' || category || '"},{"position":1,"name":"Home"},{"position":2,"item":{"@type":"WebPage","name":"Catalog &amp; more","url":"https://shop.test/catalog"}},{"position":"x","name":"Size ' || size || '"},{"position":9,"name":"Itself","item":"' || product_url || '/?utm_source=x"},{"position":2.5,"name":"' || category || '"}]}'"""
_SHORT = """'{"itemListElement":[{"position":1,"name":"Wrong"}],"@type":["BreadcrumbList"]}'"""
_PRODUCT = """'{"note":"{}","@type":["Product","Thing"],"name":"' || name || '","url":"' || product_url || '","brand":{"name":"' || coalesce(brand, '') || '","@type":"Brand"},"offers":[{"@type":"Offer","price":12.5,"seller":{"@type":"Organization","name":"Shop"}},{"@type":"AggregateOffer","lowPrice":' || seq || ',"name":7}]}'"""
_OTHER = """'{"@type":"Product","name":"Another","offers":[1],"brand":"b","sku":"s"}'"""
#: The blocks that a page's structured data has when read; a third of the pages has a broken one besides.
_BLOCKS = {
    0: [f"""'{{"@context":"https://schema.org","@graph":[' || {_SHORT} || ',' || {_CRUMBS} || ',' || {_PRODUCT} || ']}}'"""],
    1: [f"'[' || {_OTHER} || ',[' || {_PRODUCT} || '],' || {_CRUMBS} || ']'"],
    2: [_PRODUCT, _CRUMBS],
}


#: A page is several KB where its parts are few bytes: all of them can be in one file of parts.
PAGES_A_TASK = 25_000


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each product: a graph, a list of nodes, or several blocks of which one is broken."""
    script = lambda body: f"""'<script type="application/ld+json">' || {body} || '</script>'"""
    broken = script("""'{"@type":"Product",'""")
    comment = script(f"'<!-- ' || {_CRUMBS} || ' -->'")
    html = f"CASE seq % 3 WHEN 0 THEN {script(_BLOCKS[0][0])} WHEN 1 THEN {script(_BLOCKS[1][0])} ELSE {script(_PRODUCT)} || {broken} || {comment} END"
    count = derive.tasks(spark, derive.read(spark, sf_dir, "part"), PAGES_A_TASK)
    return derive.products_by_url(spark, sf_dir, count).selectExpr("product_url AS url", "seq", f"'<html><head>' || {html} || '</head></html>' AS html")


_NODES = f"""(SELECT url, b, x.id AS id, x.value AS value, json_extract(x.value, '$."@type"') AS t
    FROM (SELECT product_url AS url, unnest(j) AS j, generate_subscripts(j, 1) AS b FROM (SELECT product_url, CASE seq % 3 WHEN 0 THEN [{_BLOCKS[0][0]}] WHEN 1 THEN [{_BLOCKS[1][0]}] ELSE [{_BLOCKS[2][0]}, {_BLOCKS[2][1]}] END AS j FROM products)) k, json_tree(k.j) x
    WHERE x.type = 'OBJECT')"""


@query(
    derive.sql(
        f"""SELECT url, CAST(position AS INTEGER) AS position, unnest(CASE json_type(t) WHEN 'ARRAY' THEN from_json(t, '["VARCHAR"]') ELSE [json_extract_string(t, '$')] END) AS type,
                   CASE WHEN json_type(value, '$.name') = 'VARCHAR' THEN json_extract_string(value, '$.name') END AS name
            FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY b, id) - 1 AS position FROM {_NODES} WHERE t IS NOT NULL)""",
        "products",
    )
)
def jsonld_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed nodes of each page in document order, however deep."""
    return structured.typed_nodes(_pages(spark, sf_dir))


@query(derive.sql("SELECT product_url AS url, CASE seq % 3 WHEN 2 THEN 3 ELSE 1 END AS blocks, CASE seq % 3 WHEN 2 THEN 1 ELSE 0 END AS malformed FROM products", "products"))
def jsonld_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each page, and those that are no JSON."""
    return structured.malformed(_pages(spark, sf_dir))


@query(
    derive.sql(
        f"""SELECT url, json_extract_string(value, '$.name') AS name, json_extract_string(value, '$.brand.name') AS brand
            FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY (json_extract_string(value, '$.url') = url) DESC NULLS LAST, b, id) AS r FROM {_NODES} WHERE json_contains(t, '"Product"')) WHERE r = 1""",
        "products",
    )
)
def best_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's own product among those in its structured data."""
    found = structured.products(_pages(spark, sf_dir))
    return found.select("url", structured.member(F.col("json"), "$.name").alias("name"), structured.member(F.col("json"), "$.brand.name").alias("brand"))


@query(derive.sql("SELECT product_url AS url, concat_ws(' > ', 'Catalog & more', category, 'Size ' || size) AS path FROM products", "products"))
def breadcrumb_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category paths from breadcrumbs: the longest list, by position, without home, the page itself and repeats."""
    return structured.breadcrumbs(_pages(spark, sf_dir)).select("url", F.array_join("path", " > ").alias("path"))


@query(derive.sql("SELECT url, CASE k WHEN 0 THEN 'product' WHEN 1 THEN 'category' WHEN 2 THEN 'category' WHEN 3 THEN 'product' WHEN 4 THEN 'category' ELSE 'unknown' END AS page_type, CASE k WHEN 0 THEN 0.99 WHEN 1 THEN 0.98 WHEN 2 THEN 0.98 WHEN 3 THEN 0.85 WHEN 4 THEN 0.75 ELSE 0.0 END::DOUBLE AS confidence FROM (SELECT CASE seq % 6 WHEN 3 THEN 'https://shop.test/product/' WHEN 4 THEN 'https://shop.test/catalog/' ELSE 'https://shop.test/' END || seq AS url, seq % 6 AS k FROM products)", "products"))
def page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cascade: root types of structured data first (a nested Product makes no product page), then the url."""
    nested = """'{"@type":"WebPage","about":{"@type":"Product","name":"nested"}}'"""
    data = f"""CASE seq % 6 WHEN 0 THEN {_BLOCKS[0][0]} WHEN 1 THEN '{{"@type":["CollectionPage","ItemList"],"itemListElement":[{{"@type":"Product"}}]}}' WHEN 2 THEN '[{{"@type":"ItemList"}},{{"x":{{"@type":"Product"}}}}]' WHEN 3 THEN {nested} WHEN 4 THEN '{{"@type":"Product",' ELSE {nested} END"""
    rows = derive.products(spark, sf_dir).selectExpr(
        "CASE seq % 6 WHEN 3 THEN 'https://shop.test/product/' WHEN 4 THEN 'https://shop.test/catalog/' ELSE 'https://shop.test/' END || seq AS url",
        f"""'<html><script type="application/ld+json">' || {data} || '</script></html>' AS html""",
    )
    return extraction.classify(rows).select("url", "page_type", "confidence")
