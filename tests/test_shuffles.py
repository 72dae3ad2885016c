"""How often rows are moved: lines of a product are brought together once."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from shelfmark.operators import agreement, extraction
from shelfmark.plans import derive, registry

from .compare import DATA


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


@pytest.mark.parametrize("name", ["variant_full_outer", "variant_agreement"])
def test_variants_of_both_extractions_are_moved_once(spark, name):
    df = registry.QUERIES[name](spark, str(DATA))
    assert len(exchanges(df)) == 1
    assert "last-variants" not in df._jdf.queryExecution().toString()


@pytest.mark.parametrize(("name", "n"), [("variant_full_outer", 2), ("variant_agreement", 2), ("agreement_summary", 5), ("recovery_records", 7), ("field_means", 4), ("field_agreement", 4)])
def test_lines_are_moved_once_where_products_are_not_broadcast(spark, name, n, monkeypatch):
    monkeypatch.setattr(derive, "LINES_A_TASK", 500)  # more tasks than shuffle partitions: else the second repartition is left out
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = [x for x in exchanges(registry.QUERIES[name](spark, str(DATA))) if "product_url#" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Lines, the products that they are kept for, the products of each side, and for means a product one narrow row of each
    # (recovery_records: moved again to its products, which are moved once more).
    assert len(found) == n


def test_products_given_twice_keep_one_line_a_variant(spark):
    products = derive.shadow_products(spark, str(DATA))
    once, twice = (derive.last_lines_of_both(spark, str(DATA), x) for x in (products, products.union(products)))
    assert once.count() > 0 and once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()


@pytest.mark.parametrize("name", ["variant_agreement", "agreement_summary", "recovery_records", "field_means", "field_agreement"])
def test_tasks_that_sort_variants_are_bounded_in_lines(spark, name, monkeypatch):
    monkeypatch.setattr(derive, "LINES_A_TASK", 500)
    n = -(-derive.read(spark, str(DATA), "lineitem").count() // 500)
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = exchanges(registry.QUERIES[name](spark, str(DATA)))
    lines = [x for x in found if f", {n}), REPARTITION_BY_NUM" in x]
    # Lines, and the products of each side: joined where they are, though there are fewer shuffle partitions.
    assert len(lines) == (1 if name == "variant_agreement" else 4 if name == "recovery_records" else 3)
    assert not any("product_url#" in x and "field#" in x for x in found)  # one row a product, not one a comparison


def test_means_from_columns_are_those_of_long_scores(spark):
    rows = spark.createDataFrame([("p", 1.0, 0.5, None, 0.25), ("q", 0.0, None, 1.0, 1.0), ("r", None, None, None, None)], "k string, n double, b double, s double, x double")
    scores = [("name", "exact", F.col("n")), ("brand", "exact", F.lit(0.0)), ("brand", "exact", F.col("b")), ("specifications", "s", F.col("s")), ("sku", "set", F.col("x"))]
    long = agreement.long_scores(rows, "k", scores)
    assert sorted(agreement.tier_means(rows, "k", scores).collect()) == sorted(agreement.per_product(long, "k").collect())
    assert sorted(agreement.field_means(rows, "k", scores).collect()) == sorted(agreement.per_field(long, "k").collect())
    assert agreement.tier_means(rows.limit(0), "k", scores).count() == 0


def test_paired_rows_are_a_full_outer_join(spark):
    given = [("p", "1", "a", 1), ("p", "1", "b", 2), ("p", "2", "a", 3), ("p", "3", "b", 4), ("p", None, "a", 5), ("p", None, "b", 6), ("q", "1", "b", 7)]
    rows = spark.createDataFrame(given, "u string, k string, side string, n int")
    sides = [rows.filter(f"side = '{s}'").select("u", "k", "n") for s in "ab"]
    joined = agreement.variant_pairs(*sides, ["u", "k"]).selectExpr("u", "k", "a.n AS a", "b.n AS b")
    paired = agreement.paired(rows, ["u", "k"], "side", "n").select("u", "k", "a", "b")
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, paired.collect()))


def test_children_of_pages_are_moved_once_and_narrow(spark):
    found = exchanges(registry.QUERIES["embedded_state"](spark, str(DATA)))
    assert len(found) == 1 and "REPARTITION_BY_COL" in found[0]


def test_prices_packs_and_labels_of_a_variant_are_read_once(spark):
    pages = spark.createDataFrame([("https://a.b/c", "")], "url string, html string")
    plan = extraction.extract(pages)._jdf.queryExecution().analyzed().toString()
    assert plan.count(".prices, lambda") <= 1 and plan.count(".packs, lambda") <= 1
