"""Every registered catalogue query against its DuckDB statement, or for its rows."""

from __future__ import annotations

import difflib
import html

import pytest

import __spark_entry__ as contract
from shelfmark.plans import registry

from .compare import DATA, same, views


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_statement(spark, name):
    same(registry.QUERIES[name](spark, str(DATA)), registry.ORACLES[name], views())


def test_queries_without_a_statement():
    """Each of these is held to a plain computation below."""
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"text_similarity", "text_agreement", "content_hash"}


def test_entry_and_keys(spark):
    assert contract.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_scans_are_pruned_and_filtered(spark):
    plan = registry.QUERIES["product_variants"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_type,STANDARD)" in plan
    assert "l_shipdate" not in plan and "p_retailprice" not in plan


def test_similar_texts_equal_difflib(spark):
    texts = {r.doc_id: " ".join(html.unescape(r.text).split()).casefold() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = registry.QUERIES["text_similarity"](spark, str(DATA)).collect()
    assert len(found) == sum(i + 1 in texts for i in texts)
    for r in found[:40]:
        assert r.similarity == pytest.approx(difflib.SequenceMatcher(None, texts[r.doc_id], texts[r.doc_id + 1]).ratio())


def test_agreement_equals_difflib_and_is_mostly_decided_by_bounds(spark):
    texts = {r.doc_id: " ".join(html.unescape(r.text).split()).casefold() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = registry.QUERIES["text_agreement"](spark, str(DATA)).collect()
    for r in found[:60]:
        assert r.agreed == (difflib.SequenceMatcher(None, texts[r.doc_id], texts[r.doc_id + 1]).ratio() >= 0.90)
    assert sum(r.decided_by != "matching" for r in found) >= 0.8 * len(found)


def test_content_hashes_differ_and_repeat(spark):
    found = {r.product_url: r.content_hash for r in registry.QUERIES["content_hash"](spark, str(DATA)).collect()}
    again = {r.product_url: r.content_hash for r in registry.QUERIES["content_hash"](spark, str(DATA)).collect()}
    assert found == again and len(set(found.values())) == len(found) == spark.read.parquet(f"{DATA}/part.parquet").count()
