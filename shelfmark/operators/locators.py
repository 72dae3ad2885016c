"""Candidate locators held against pages whose right value is known.

All candidates meet a page in one lateral join: the page is parsed once and every
candidate is tried on it.  Candidates are a handful of proposals; they travel as one array.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.finder import Page
from ..functions.selectors import SelectorError

CANDIDATES = "candidate string, kind string, expression string, attribute string, path string"
_PARTS = ("candidate", "kind", "expression", "attribute", "path")
#: Failures that are kept as examples of each candidate.
SHOWN = 5


@udtf(returnType="candidate string, matched boolean, found string, error string")
class Tried:
    """(candidate, matched, found, error) of every candidate on one page."""

    def eval(self, html: str, expected: str, candidates: list[Row]) -> Iterator[tuple]:
        page, want = Page(html or ""), (expected or "").strip()
        for name, *locator in candidates or ():
            try:
                found = page.find(*locator)
                yield name, want in found, ", ".join(found[:3]) or "nothing", None
            except SelectorError as error:
                yield name, False, None, str(error)


def _try_all(samples: DataFrame, candidates: Column) -> DataFrame:
    """Samples (url, html, expected, ...) with a row for each candidate of the array."""
    return samples.withColumn("_candidates", candidates).lateralJoin(Tried(F.col("html").outer(), F.col("expected").outer(), F.col("_candidates").outer()))


def evaluate(candidates: DataFrame, samples: DataFrame) -> DataFrame:
    """(candidate, url, matched, found, error) of every candidate on every sample."""
    one = candidates.agg(F.collect_list(F.struct(*_PARTS)).alias("_all"))
    rows = samples.select("url", "html", "expected").crossJoin(F.broadcast(one))
    return _try_all(rows, F.col("_all")).select("candidate", "url", "matched", "found", "error")


def validate(candidates: DataFrame, samples: DataFrame) -> DataFrame:
    """(candidate, tested, matched, pass_rate, validated, failures, error).

    A candidate is validated only if it finds every known value; one that can't be
    evaluated has tested nothing.  ``failures`` shows the first few by url.
    """
    tried = evaluate(candidates, samples)
    rows = tried.groupBy("candidate").agg(F.max("error").alias("error"), F.count(F.lit(1)).alias("tested"), F.count(F.when(F.col("matched"), 1)).alias("matched"))
    failed = tried.filter(~F.col("matched")).withColumn("_n", F.row_number().over(Window.partitionBy("candidate").orderBy("url")))
    shown = failed.filter(F.col("_n") <= SHOWN).groupBy("candidate").agg(F.array_sort(F.collect_list(F.concat("url", F.lit(": found "), "found"))).alias("failures"))
    fine = F.col("error").isNull()
    rows = rows.withColumn("tested", F.when(fine, F.col("tested")).otherwise(0)).withColumn("matched", F.when(fine, F.col("matched")).otherwise(0))
    rate = F.coalesce(F.try_divide(F.col("matched").cast("double"), F.col("tested").cast("double")), F.lit(0.0))
    failures = F.coalesce("failures", F.array().cast("array<string>")).alias("failures")
    return rows.join(shown, "candidate", "left").select("candidate", "tested", "matched", rate.alias("pass_rate"), (fine & (F.col("tested") > 0) & (F.col("matched") == F.col("tested"))).alias("validated"), failures, "error")


def diagnose(fields: DataFrame, candidates: DataFrame, samples: DataFrame, most: int = 4) -> DataFrame:
    """(field, status, reason) of a repair: validated, rejected, failed without a candidate, or skipped without samples.

    candidates carry ``field`` and, for their order, ``rank``; the first ``most`` of a
    field are tried.  samples carry ``field``, url, html and expected.
    """
    order = F.row_number().over(Window.partitionBy("field").orderBy("rank" if "rank" in candidates.columns else "candidate"))
    few = candidates.withColumn("_n", order).filter(F.col("_n") <= most)
    asked = few.groupBy("field").agg(F.collect_list(F.struct(*_PARTS)).alias("_all"))
    tried = _try_all(samples.select("field", "html", "expected").join(F.broadcast(asked), "field"), F.col("_all"))
    each = tried.groupBy("field", "candidate").agg((F.bool_and("matched") & (F.count("error") == 0)).alias("validated"))
    outcome = each.groupBy("field").agg(F.bool_or("validated").alias("any"))
    have = samples.select("field").distinct().withColumn("_have", F.lit(True))
    joined = fields.select("field").distinct().join(have, "field", "left").join(asked.select("field", F.lit(True).alias("_asked")), "field", "left").join(outcome, "field", "left")
    status = F.when(F.col("_have").isNull(), "skipped").when(F.col("_asked").isNull(), "failed").when(F.col("any"), "validated").otherwise("rejected")
    reason = F.when(status == "skipped", "no known-good samples").when(status == "failed", "no candidate proposed").when(status == "rejected", "no candidate finds every known value")
    return joined.select("field", status.alias("status"), reason.alias("reason"))
