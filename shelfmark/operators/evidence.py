"""What a second extractor or a repair proposal is shown of a page, and repair samples."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batches, text
from ..functions import html as markup

TEXT_LIMIT, CONTEXT_LIMIT, MARKER = 25_000, 50_000, "\n[truncated]"
REPAIR_LIMIT, ASSIGNMENTS, ASSIGNMENT_CHARS, ELEMENTS = 24_000, 20, 320, 400

# The fields a repair may be proposed for.
REPAIRABLE = ("name", "brand", "description", "sku", "item_number", "product_code", "price")


def shadow_context(page: str) -> str:
    """Structured data and embedded state; the page's text where there is neither."""
    found = re.findall(r"<script\b[^>]*application/ld\+json[^>]*>(.*?)</script", page, re.I | re.S)
    state = re.search(r"\bwindow\.masterData\s*=\s*(\"(?:[^\"\\]|\\.)*\")", page)
    out = "\n".join([x.strip() for x in found] + ([state[1]] if state else []))
    out = out or text.strip_markup(page)[:TEXT_LIMIT]
    return out if len(out) <= CONTEXT_LIMIT else out[:CONTEXT_LIMIT] + MARKER


def repair_context(page: str) -> str:
    """Window assignments and the elements that a selector could name."""
    assigned = [m[0][:ASSIGNMENT_CHARS] for m in re.finditer(r"window\.[A-Za-z_$][\w$]*\s*=[^\n]*", page)][:ASSIGNMENTS]
    named = []
    for e in markup.parse(page).walk():
        marks = {k: v for k, v in e.attributes.items() if k in ("id", "class", "itemprop") or k.startswith("data-")}
        if marks and len(named) < ELEMENTS:
            named.append(f"<{e.tag} " + " ".join(f'{k}="{v}"' for k, v in marks.items()) + f"> {e.text()[:80]}")
    return "\n".join(assigned + named)[:REPAIR_LIMIT]


def with_context(pages: DataFrame, kind: str = "shadow") -> DataFrame:
    """(url, context) of pages (url, html)."""
    make = shadow_context if kind == "shadow" else repair_context

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches.by_size(frames):
            yield pd.DataFrame({"url": frame["url"], "context": frame["html"].map(lambda h: make(h or ""))})

    return pages.select("url", "html").mapInPandas(run, "url string, context string")


def field_name(field: Column) -> Column:
    """The field without a ``prefix:``; null if it can't be repaired."""
    bare = F.trim(F.element_at(F.split(field, ":", 2), -1))
    return F.when(bare.isin(*REPAIRABLE), bare)


def known_value(field: str) -> Column:
    """The value an extraction has for a field: the product's, or the first variant's that has one."""
    if field in ("name", "brand", "description"):
        return F.nullif(F.trim(F.col(field)), F.lit(""))
    return F.get(F.filter(F.transform("variants", lambda v: F.trim(v[field].cast("string"))), lambda x: F.coalesce(x, F.lit("")) != ""), 0)


def known_values(current: Column, earlier: Column) -> Column:
    """Known-good values of a page (maps): stored ones win over this run's."""
    filled = lambda m: F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda _, v: F.coalesce(v, F.lit("")) != "")
    e = filled(earlier)
    return F.map_concat(F.map_filter(filled(current), lambda k, _: ~F.map_contains_key(e, k)), e)


def choose(pages: DataFrame, size: int, asked: list[str] | None = None) -> DataFrame:
    """The pages (seq, url, ...) that a second extractor is shown: those asked for by url, else the first ``size``."""
    if asked:
        return pages.filter(F.col("url").isin(*asked))
    return pages.orderBy("seq").limit(size)


def results(sampled: DataFrame, answers: DataFrame, configured: bool = True) -> DataFrame:
    """(url, status, reason, source) of every sampled page from a second extractor's answers (url, error).

    An answer without an error is completed evidence, stamped as the second extractor's.
    """
    if not configured:
        return sampled.select("url", F.lit("skipped").alias("status"), F.lit("missing configuration").alias("reason"), F.lit(None).cast("string").alias("source"))
    known = answers.select("url", F.col("error").alias("_error"), F.lit(True).alias("_there"))
    done = F.col("_there") & F.col("_error").isNull()
    rows = sampled.select("url").join(known, "url", "left")
    return rows.select(
        "url", F.when(F.col("_there").isNull(), "skipped").when(done, "completed").otherwise("failed").alias("status"),
        F.when(F.col("_there").isNull(), "no answer").otherwise(F.col("_error")).alias("reason"), F.when(F.coalesce(done, F.lit(False)), "llm_shadow").alias("source"),
    )


def flags(pages: DataFrame) -> DataFrame:
    """(url, has_data, has_state, truncated) of what a second extractor is shown of each page."""
    shown = with_context(pages)
    return shown.select("url", F.contains("context", F.lit('"@type"')).alias("has_data"), F.contains("context", F.lit("manufacturer_part_number")).alias("has_state"), F.endswith("context", F.lit(MARKER)).alias("truncated"))


def repair_samples(pages: DataFrame, field: str, limit: int = 8) -> DataFrame:
    """The first pages (seq, url, html, values) whose value of the field is known."""
    return pages.filter(F.map_contains_key("values", field)).orderBy("seq").limit(limit).select("url", "html", F.col("values")[field].alias("expected"))
