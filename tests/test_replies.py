"""Replies of a second extractor, counters in one pass, and the command line's limits."""

from __future__ import annotations

import json

import pytest

from shelfmark import __main__ as command
from shelfmark import config
from shelfmark.operators import replies, runs

from .compare import DATA

GOOD = {"product": {"name": "N", "product_url": "https://s.test/p", "category_path": ["a"], "specifications": {"k": "v"}, "brand": None}, "variants": [{"sku": "1", "price": 2, "option_values": {}}], "warnings": ["w"]}


def reasons(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "url int, reply string")
    return {r.url: r for r in replies.records(rows).collect()}


def test_good_replies(spark):
    text = json.dumps(GOOD)
    found = reasons(spark, text, f"```json\n{text}\n```", f"  ```\n{text}```  ")
    for r in found.values():
        assert (r.status, r.reason, r.variants_complete, r.warnings) == ("completed", None, False, ["w"])
        assert r.product.field_provenance == {k: "llm_shadow" for k in ("name", "product_url", "category_path", "specifications")}
        assert (r.variants[0].price, r.variants[0].field_provenance) == ("2", {"sku": "llm_shadow", "price": "llm_shadow"})
    bare = reasons(spark, json.dumps({"product": GOOD["product"]}))[0]
    assert bare.status == "completed" and bare.variants == []


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({"product": {"name": "N"}}, "product.product_url is missing"),
        ({"product": [1]}, "product is no object"),
        ({"product": None}, "product is missing"),
        ({"variants": {"sku": "1"}}, "variants is no objects"),
        ({"variants": [1]}, "variants is no objects"),
        ({"variants": [{"image_urls": ["a", 1]}, {"price": True}]}, "variants[0].image_urls is no texts; variants[1].price is no amount"),
        ({"variants": [{"option_values": {"a": 1}}]}, "variants[0].option_values is no map"),
        ({"variants_complete": "yes"}, "variants_complete is no flag"),
        ({"more": 1, "also": 2}, "also is not a field; more is not a field"),
        ({"product": GOOD["product"] | {"price_visibility": "hidden", "brand": 3}}, "product.brand is no text; product.price_visibility is no visibility"),
    ],
)
def test_replies_that_break_the_record(spark, change, reason):
    r = reasons(spark, json.dumps(GOOD | change))[0]
    assert (r.status, r.reason, r.product, r.variants) == ("failed", reason, None, None)


def test_replies_without_json(spark):
    found = reasons(spark, None, "", "sorry", json.dumps(GOOD)[:-5], "[]", '"text"', "null")
    assert {r.reason for r in found.values()} == {"no JSON", "no JSON object"} and all(r.status == "failed" for r in found.values())


def test_counters_need_one_pass(spark, tmp_path):
    rows = spark.range(100).selectExpr("concat('c', id % 7) AS category", "CASE WHEN id % 3 = 0 THEN 'failed' ELSE 'completed' END AS status", "'http' AS source", "id AS variants", "id % 4 AS attempts", "true AS shadow", "false AS fallback", "id % 2 = 0 AS repair", "id % 5 = 0 AS known", "timestamp_seconds(id) AS started", "timestamp_seconds(id + 9) AS ended")
    scanned = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            scanned.add(b.num_rows)
            yield b

    counted = runs.counted_while_written(rows.mapInArrow(count, rows.schema), str(tmp_path / "out"))
    assert counted.collect() == runs.counters(rows).collect() and scanned.value == 100
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_command_line_limits_go_over_settings(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"max_products": 7, "max_retries": 1}')
    settings = config.load(tmp_path / "s.json")
    assert command.planned(spark, str(DATA), settings).count() == 7
    assert command.planned(spark, str(DATA), settings.with_changes(max_products=3)).count() == 3
    every = settings.with_changes(max_products=10**6)
    assert command.planned(spark, str(DATA), every, resume=False).count() == spark.read.parquet(f"{DATA}/part.parquet").count() > command.planned(spark, str(DATA), every).count()
    for wrong in ("0", "-1"):
        with pytest.raises(SystemExit):
            command.main(["plan", "--data", str(DATA), "--max-products", wrong])
