"""Structured data (JSON-LD) of pages, walked inside the JVM.

A recursive query goes one level of nesting a step: of each object and list it takes the
members that are objects or lists.  Members are read twice: as plain JSON texts, which
keep the order of the document, and as variants, which tell an object from a text that
looks like one.  ``at`` names a node's place: eight hexadecimal digits a level, so that
sorting by it gives document order, each node before those inside it.

A block that is no JSON has no nodes and counts as malformed; a page without blocks has
none.  Nesting beyond DEPTH levels is an error, never a cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, url as urls

DEPTH = 1000
_BLOCK = r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script\s*>"

_KIND = "CASE WHEN startswith(schema_of_variant({0}), 'OBJECT') THEN 'object' WHEN startswith(schema_of_variant({0}), 'ARRAY') THEN 'list' END"
_PAIR = f"(j, v) -> named_struct('json', j, 'kind', {_KIND.format('v')})"
_MEMBERS = f"""
    CASE kind WHEN 'object' THEN zip_with(map_values(from_json(json, 'map<string,string>')), map_values(from_json(json, 'map<string,variant>')), {_PAIR})
              ELSE zip_with(from_json(json, 'array<string>'), from_json(json, 'array<variant>'), {_PAIR}) END"""
_WALK = f"""
    WITH RECURSIVE walk MAX RECURSION LEVEL {DEPTH} AS (
        SELECT url, at, json, kind FROM {{roots}}
        UNION ALL
        SELECT url, concat(at, lpad(hex(pos), 8, '0')) AS at, member.json AS json, member.kind AS kind
        FROM (SELECT url, at, posexplode({_MEMBERS}) AS (pos, member) FROM walk) WHERE member.kind IS NOT NULL)
    SELECT url, at, json FROM walk WHERE kind = 'object' LIMIT ALL"""


def blocks(pages: DataFrame) -> DataFrame:
    """(url, position, json, value): the structured-data blocks of (url, html); value is null where a block is malformed."""
    found = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(_BLOCK), 1)).alias("position", "body"))
    bare = F.regexp_replace(F.trim("body"), r"(?s)^\s*<!--|-->\s*$", "")
    return found.select("url", "position", bare.alias("json")).withColumn("value", F.try_parse_json("json"))


def malformed(pages: DataFrame) -> DataFrame:
    """(url, blocks, malformed) of every page."""
    counted = blocks(pages).groupBy("url").agg(F.count(F.lit(1)).alias("blocks"), F.count(F.when(F.col("value").isNull(), 1)).alias("malformed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return pages.select("url").distinct().join(counted, "url", "left").select("url", zero("blocks"), zero("malformed"))


def nodes(pages: DataFrame) -> DataFrame:
    """(url, at, json, types): every object in the structured data of (url, html), however deep."""
    kind = F.expr(_KIND.format("value"))
    roots = blocks(pages).withColumn("kind", kind).filter("kind IS NOT NULL").select("url", F.lpad(F.hex("position"), 8, "0").alias("at"), "json", "kind")
    return pages.sparkSession.sql(_WALK, roots=roots).withColumn("types", types_of(F.try_parse_json("json")))


def types_of(value: Column) -> Column:
    """The texts of an object's ``@type``, which may be one or a list."""
    def texts(given: Column) -> Column:
        each = F.when(F.startswith(F.schema_of_variant(given), F.lit("ARRAY")), F.try_variant_get(given, "$", "array<variant>")).otherwise(F.array(given))
        return F.filter(F.transform(each, string_of), lambda x: x.isNotNull())

    return F.coalesce(text.let(F.try_variant_get(value, "$['@type']", "variant"), texts), F.array().cast("array<string>"))


def string_of(value: Column) -> Column:
    """A variant's text; null for numbers and other values."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def member(json: Column, path: str) -> Column:
    """The text at a path of a JSON text; null for other values."""
    return string_of(F.try_variant_get(F.try_parse_json(json), path, "variant"))


def typed_nodes(pages: DataFrame) -> DataFrame:
    """(url, position, type, name) of every typed node in document order; a node of several types gives a row for each."""
    typed = nodes(pages).filter(F.size("types") > 0)
    numbered = typed.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("at", "types", member(F.col("json"), "$.name").alias("name")))).alias("all"))
    flat = numbered.select("url", F.posexplode("all").alias("position", "node"))
    return flat.select("url", "position", F.explode("node.types").alias("type"), F.col("node.name").alias("name"))


def _truthy(value: Column) -> Column:
    """Whether a JSON value is there and not empty, zero or false."""
    shown = F.to_json(value)
    return (value.isNotNull() & ~shown.isin("null", '""', "[]", "{}", "0", "0.0", "false")).cast("int")


def _best(pages: DataFrame) -> DataFrame:
    """(url, product, items): each page's best Product, and the entries of its longest breadcrumb list; one walk for both."""
    value = F.try_parse_json("json")
    is_product, is_list = F.array_contains("types", "Product"), F.array_contains("types", "BreadcrumbList")
    # A type's name is in its node's text, unless letters are escaped; most nodes need no look at their types.
    named = [F.contains("json", F.lit(x)) for x in ("Product", "BreadcrumbList", "\\u")]
    typed = nodes(pages).filter(named[0] | named[1] | named[2]).filter(F.arrays_overlap("types", F.array(F.lit("Product"), F.lit("BreadcrumbList"))))
    found = typed.withColumns({"_url": member(F.col("json"), "$.url"), "_id": member(F.col("json"), "$['@id']"), "_items": F.when(is_list, F.coalesce(F.try_variant_get(value, "$.itemListElement", "array<variant>"), F.array().cast("array<variant>")))})
    matches = sum(F.coalesce((urls.normalize_url(c) == urls.normalize_url("url")).cast("int"), F.lit(0)) for c in ("_url", "_id"))
    whole = sum(_truthy(F.try_variant_get(value, f"$.{k}", "variant")) for k in ("name", "sku", "offers", "brand"))
    ranked = found.withColumns({"_rank": F.when(is_product, F.struct((-matches).alias("m"), (-whole).alias("w"), F.col("at").alias("at"))), "_order": F.when(is_list, F.struct((-F.size("_items")).alias("n"), F.col("at").alias("at")))})
    return ranked.groupBy("url").agg(F.min_by(F.struct("at", "json"), "_rank").alias("product"), F.min_by("_items", "_order").alias("items"))


def products(pages: DataFrame) -> DataFrame:
    """(url, at, json) of each page's best Product: most links to the page itself, then most of name, sku, offers and brand, then the first."""
    return _best(pages).filter("product IS NOT NULL").select("url", "product.*")


def breadcrumbs(pages: DataFrame) -> DataFrame:
    """(url, path): the longest list's entries by position (others last), without home, the page itself and repeats.

    A page whose structured data has no Product or no list has no row.
    """
    best = _best(pages).filter("product IS NOT NULL AND items IS NOT NULL")
    product = F.col("product.json")
    named = best.select("url", "items", text.casefold(text.clean_text(member(product, "$.name"))).alias("_name"), urls.normalize_url(F.coalesce(member(product, "$.url"), F.col("url"))).alias("_own"))
    part = lambda path: F.try_variant_get("entry", path, "variant")
    number = F.rlike(F.schema_of_variant(part("$.position")), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))
    raw = named.select("url", "_name", "_own", F.posexplode_outer("items").alias("place", "entry")).select(
        "url", "_name", "_own", "place", F.when(number, F.try_variant_get(part("$.position"), "$", "double")).otherwise(1e9).alias("position"),
        F.coalesce(F.nullif(string_of(part("$.name")), F.lit("")), string_of(part("$.item.name"))).alias("label"),
        F.coalesce(string_of(part("$.item")), string_of(part("$.item.url"))).alias("link"),
    )
    # Step by step: what an expression uses several times is worked out once.
    entries = raw.withColumn("label", text.normalize_text(F.col("label"))).withColumns({"label": text.without_tags(F.col("label")), "link": urls.normalize_url("link")})
    low = text.casefold(F.col("label"))
    kept = F.col("label").isNotNull() & ~F.coalesce((low == "home") | (low == F.col("_name")) | (F.col("link") == F.col("_own")), F.lit(False))
    ordered = F.array_sort(F.collect_list(F.when(kept, F.struct("position", "place", "label"))))
    return entries.groupBy("url").agg(F.array_distinct(F.transform(ordered, lambda e: e["label"])).alias("path"))
