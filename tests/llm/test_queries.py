"""The registered queries over the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from shelfmark.llm import queries
from tests.compare import DATA, same, views

COLUMNS = {
    "op2_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op3_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op4_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op7_url_filter": ["page_id", "host", "path", "rule", "verdict", "allow_probability"],
    "op8_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op9_langid": ["doc_id", "held_out", "lang_pred", "score"],
    "op10_class_lm": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_statement(spark, name):
    same(queries.QUERIES[name](spark, str(DATA)), queries.ORACLES[name], views())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    found = queries.QUERIES[name](spark, str(DATA))
    assert found.columns == COLUMNS[name]
    table = "pages" if name == "op7_url_filter" else "documents"
    assert found.count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


@pytest.mark.parametrize("name", ["op3_fingerprints", "op4_sharding", "op6_exact_dedup", "op7_url_filter"])
def test_native_plans_have_no_python(spark, name):
    plan = queries.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(contract.queries())


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = queries.QUERIES["op9_langid"](spark, "/root/testdata/sf0.01").filter("held_out").join(docs, "doc_id")
    row = found.selectExpr("avg(CASE WHEN lang = lang_pred THEN 1.0 ELSE 0.0 END) AS right").first()
    assert row.right > 0.98
