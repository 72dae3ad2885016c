"""Product urls from search-index pages, or from listing pages where those give none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as urls
from ..operators import ordering, structured

FOUND = "category string, url string, method string, position long"


def read_pages(hits: DataFrame, max_pages: int | None = None) -> DataFrame:
    """The index pages that are asked for: up to the first that says it is the last (``nb_pages``), and to ``max_pages``."""
    if "nb_pages" in hits.columns:
        at_end = F.col("page") + 1 >= F.greatest(F.lit(1), F.coalesce("nb_pages", F.lit(1)))
        last = hits.groupBy(F.col("category").alias("_category")).agg(F.min(F.when(at_end, F.col("page"))).alias("_last"))
        hits = hits.join(last, F.col("category") == F.col("_category")).filter(F.col("_last").isNull() | (F.col("page") <= F.col("_last"))).drop("_category", "_last")
    return hits if max_pages is None else hits.filter(F.col("page") < max_pages)


def from_index(hits: DataFrame, site: str, allowed: Column | None = None, limit: int | None = None, max_pages: int | None = None, wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """hits (category, page, hits array<struct<objectID, family_url, url, ...>>) to first-seen admissible urls.

    wanted: which hits the query is for (its facets, and that they are visible).  limit: urls a category at most.
    """
    ok = allowed if allowed is not None else F.lit(True)
    rows = read_pages(hits, max_pages).select("category", "page", F.posexplode("hits").alias("at", "hit"))
    if wanted is not None:
        rows = rows.filter(wanted(F.col("hit")))
    valid = lambda c: F.when(urls.admissible_product(c, site, ok), c)
    rows = rows.withColumn("family", urls.normalize_url(F.col("hit.family_url"))).withColumn("own", urls.normalize_url(F.col("hit.url")))
    rows = rows.withColumn("url", F.coalesce(valid(F.col("family")), valid(F.col("own")))).filter("url IS NOT NULL")
    rows = rows.withColumn("position", F.col("page").cast("long") * 1_000_000 + F.col("at"))
    first = rows.groupBy("category", "url").agg(F.min("position").alias("position"))
    if limit is not None:
        first = first.withColumn("_r", F.expr("row_number() OVER (PARTITION BY category ORDER BY position)")).filter(F.col("_r") <= limit).drop("_r")
    return first.select("category", "url", F.lit("search_index").alias("method"), "position")


def from_listings(pages: DataFrame, site: str) -> DataFrame:
    """pages (category, url, html): product urls of ItemList structured data, each at its first place on the page."""
    lists = structured.nodes(pages.select("url", "html")).filter(F.array_contains("types", "ItemList"))
    entries = lists.select("url", "at", F.posexplode(F.try_variant_get(F.try_parse_json("json"), "$.itemListElement", "array<variant>")).alias("place", "entry"))
    part = lambda path: structured.string_of(F.try_variant_get("entry", path, "variant"))
    raw = F.coalesce(F.nullif(part("$.url"), F.lit("")), part("$.item"), part("$.item.url"), structured.string_of(F.col("entry")))
    links = entries.select("url", "at", "place", urls.resolve_url(raw, F.col("url")).alias("link")).filter("link IS NOT NULL")
    first = links.groupBy("url", "link").agg(F.min(F.struct("at", "place")).alias("first"))
    numbered = first.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("first", "link"))).alias("all")).select("url", F.posexplode("all").alias("position", "found"))
    found = pages.select("category", "url").distinct().join(numbered, "url").select("category", F.col("found.link").alias("url"), F.lit("json_ld_item_list").alias("method"), F.col("position").cast("long").alias("position"))
    return found.filter(urls.admissible_product(F.col("url"), site, F.lit(True)))


class NothingFound(LookupError):
    """Neither source has any url, and the primary one could not be read."""


def discover(primary: DataFrame, fallback: DataFrame, primary_error: str | None = None) -> DataFrame:
    """The primary source's urls, and the fallback's for categories it has none of.

    primary_error: why the primary source could not be read; then the fallback must have
    something.
    """
    found = primary.unionByName(fallback.join(primary.select("category").distinct(), "category", "left_anti"))
    if primary_error is not None and not found.limit(1).count():
        raise NothingFound(primary_error)
    return found


def plan(found: DataFrame, state: DataFrame, retries: int, resume: bool, limit: int | None) -> DataFrame:
    """Eligible urls, the first category of each, interleaved across categories."""
    from ..operators import state as machine

    once = ordering.first_seen(found, ["url"], [F.col("category"), F.col("position")])
    known = once.join(state.select("url", "status", "attempt_count"), "url", "left")
    wanted = known.filter(machine.eligible(F.col("status"), F.col("attempt_count"), retries, resume)).drop("status", "attempt_count")
    return ordering.round_robin(wanted, "category", "position", "category", limit)
