from __future__ import annotations

import csv
import json

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import agreement, evidence, extraction, locators, quality, runs, state, validation
from shelfmark.sources import discovery, exports, pages

GLOVE = {
    "A-1": {"sku": "A-1", "manufacturer_part_number": "M1", "description": "Small 100/box", "product_price": "18.990000", "price": {"price": "<b>$99.00</b>"}, "stock_availability": "in_stock", "image": "/i/1.jpg", "main_image": "/i/1.jpg"},
    "A-2": {"sku": "A-2", "description": "Large", "pack": "Box of 50", "price": "<span data-price-amount='7.5'>", "stock_availability_label": "On order"},
}


def page(state=None, product=None, body="", extra=""):
    node = {"@type": "Product", "@id": "https://shop.test/product/glove#p", "name": "  Nitrile &amp; Latex ", "brand": {"name": "Acme"}, "image": ["/a.jpg", "/a.jpg"], "offers": {"price": "5", "priceCurrency": "usd", "availability": "https://schema.org/InStock"}} | (product or {})
    crumbs = {"@type": "BreadcrumbList", "itemListElement": [{"position": 3, "name": "Gloves"}, {"position": 1, "name": "Home"}, {"position": 2, "item": {"name": "Supplies", "url": "https://shop.test/supplies"}}, {"position": "x", "name": "nitrile & latex"}]}
    script = "" if state is None else f"<script>window.masterData = {json.dumps(state if isinstance(state, str) else json.dumps(state))};</script>"
    ld = "".join(f'<script type="application/ld+json">{json.dumps(x)}</script>' for x in (node, crumbs))
    return f"<html><body {body}>{ld}{extra}{script}</body></html>"


URL = "https://shop.test/product/glove"


def read(spark, html):
    return extraction.extract(spark.createDataFrame([(URL, html)], "url string, html string")).first()


def test_children_from_state(spark):
    r = read(spark, page(GLOVE))
    assert (r.name, r.brand, r.category_path, r.image_urls) == ("Nitrile & Latex", "Acme", ["Supplies", "Gloves"], ["https://shop.test/a.jpg"])
    a, b = r.variants
    assert (a.price, a.unit_pack_size, a.currency, a.availability, a.image_urls) == ("18.990000", "100/box", "USD", "in stock", ["https://shop.test/i/1.jpg"])
    assert (b.price, b.unit_pack_size, b.availability) == ("7.5", "50/box", "On order")
    assert a.provenance["unit_pack_size"] == "derived" and b.provenance["unit_pack_size"] == "embedded_state" and "currency" not in a.provenance
    assert r.variants_complete and r.price_visibility == "public" and r.missing == ["description"]


@pytest.mark.parametrize(
    ("html", "method", "complete", "n"),
    [
        (page(), "json_ld_fallback", False, 1),
        (page([]), "json_ld_single_item", True, 1),
        (page([], body='class="page-product-grouped"'), "embedded_state_empty_grouped", True, 0),
        (page("{bad"), "json_ld_fallback", False, 1),
    ],
)
def test_variants_without_children(spark, html, method, complete, n):
    r = read(spark, html)
    assert (r.variants_method, r.variants_complete, len(r.variants)) == (method, complete, n)


def test_unreadable_pages(spark):
    rows = extraction.extract(spark.createDataFrame([(URL, None), (URL, "<html>"), (URL, '<script type="application/ld+json">{bad</script>')], "url string, html string")).collect()
    assert all(r.error for r in rows)


def test_embedded_state_kinds(spark):
    cases = [page(GLOVE), page([]), page({}), page(), page("{bad")]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(cases)], "i int, html string").select("i", extraction.embedded_state(F.col("html")).alias("s")).orderBy("i").collect()
    assert [r.s.kind for r in rows] == ["children", "empty", "empty", "absent", "invalid"]
    assert set(rows[0].s.children) == {"A-1", "A-2"}


def test_embedded_state_of_any_length(spark):
    long = page({"k": {"sku": "x" * 300_000}})
    assert spark.createDataFrame([(long,)], "html string").select(extraction.embedded_state(F.col("html")).alias("s")).first().s.kind == "children"


def test_page_classes(spark):
    listing = '<script type="application/ld+json">{"@graph":[{"@type":["ItemList"]}]}</script>'
    rows = spark.createDataFrame([(1, "https://s.test/x", page()), (2, "https://s.test/x", listing), (3, "https://s.test/product/y", ""), (4, "https://s.test/catalog", ""), (5, "https://s.test/z", None)], "i int, url string, html string")
    found = {r.i: (r.page_type, r.confidence) for r in extraction.classify(rows).collect()}
    assert found == {1: ("product", 0.99), 2: ("category", 0.98), 3: ("product", 0.85), 4: ("category", 0.75), 5: ("unknown", 0.0)}


def test_validation(spark):
    twice = {"k1": GLOVE["A-1"], "k2": GLOVE["A-1"], "k3": GLOVE["A-1"] | {"product_price": "1"}, "k4": {"sku": "bad sku!"}}
    r = validation.validate(extraction.extract(spark.createDataFrame([(URL, page(twice))], "url string, html string"))).first()
    assert r.errors == ["variant[3] sku has an unreasonable format"] and not r.valid
    assert r.duplicate_variants_removed == 2 and len(r.variants) == 2
    assert r.warnings == ["duplicate variant removed: sku:a-1", "conflicting duplicate variant removed: sku:a-1"]
    one = lambda state: validation.validate(extraction.extract(spark.createDataFrame([(URL, page(state, extra="<i>x</i>" * len(state)))], "url string, html string"))).first().content_hash
    assert one(GLOVE) == one(dict(reversed(GLOVE.items())))


def _loop(current, status, error, seq):
    known, attempts, last, _ = current
    if status == "pending":
        return (known, attempts, last, seq)
    if status == "in_progress":
        return (status, attempts + 1, None, seq)
    return (status, 0, None, seq) if status == "completed" else (status, attempts, error, seq)


def _random_events():
    import random

    random.seed(3)
    kinds = ["pending", "in_progress", "completed", "failed", "skipped"]
    return [(f"u{random.randrange(6)}", i, random.choice(kinds), f"e{i}") for i in range(120)]


def test_state_machine_matches_a_loop(spark):
    import random

    events, expected = _random_events(), {}
    for u, i, s, e in events:
        expected[u] = _loop(expected.get(u, ("pending", 0, None, -1)), s, e, i)
    found = state.fold(spark.createDataFrame(events, "url string, seq long, status string, error string"))
    assert {r.url: (r.status, r.attempt_count, r.last_error, r.updated_seq) for r in found.collect()} == expected


def test_states_keep_what_is_known(spark):
    rows = [
        ("a", 1, "pending", None, "product", None, None), ("a", 2, "in_progress", None, "unknown", None, None), ("a", 3, "completed", None, None, "t1", "h1"), ("a", 4, "failed", "x", None, None, None),
        ("b", 1, "in_progress", None, "category", None, None), ("b", 2, "pending", None, "product", None, None), ("b", 3, "completed", None, "unknown", "t2", None), ("c", 1, "in_progress", None, None, "t9", None),
    ]
    found = state.fold(spark.createDataFrame(rows, "url string, seq long, status string, error string, page_type string, fetched_at string, content_hash string"))
    got = {r.url: (r.status, r.page_type, r.fetched_at, r.content_hash) for r in found.collect()}
    assert got == {"a": ("failed", "product", "t1", "h1"), "b": ("completed", "unknown", "t2", None), "c": ("in_progress", "unknown", None, None)}


def test_enqueue_keeps_known(spark):
    known = spark.createDataFrame([("a", "failed", 2, "e", 1)], "url string, status string, attempt_count long, last_error string, updated_seq long")
    out = state.enqueue(known, spark.createDataFrame([("a",), ("b",), ("b",)], "url string")).collect()
    assert {(r.url, r.status, r.attempt_count) for r in out} == {("a", "failed", 2), ("b", "pending", 0)}


def test_completeness_rules_differ_on_unknown(spark):
    rows = spark.createDataFrame([("unknown", []), ("", ["x"]), (None, None), ("v", ["x"])], "a string, b array<string>")
    run = {r.field: r.populated for r in quality.completeness(rows, ["a", "b"]).collect()}
    board = {r.field: r.populated for r in quality.completeness(rows, ["a", "b"], unknown_counts=True).collect()}
    assert run == {"a": 1, "b": 2} and board == {"a": 2, "b": 2}
    assert [r.completeness for r in quality.completeness(rows.limit(0), ["a"]).collect()] == [0.0]


def test_run_status(spark):
    cases = [(5, 0, False, 5, "completed"), (5, 1, False, 6, "partial"), (0, 2, False, 2, "failed"), (5, 0, True, 5, "partial"), (0, 0, False, 0, "failed")]
    rows = spark.createDataFrame(cases, "e int, f int, d boolean, p int, want string")
    assert all(r.got == r.want for r in rows.select("want", runs.status(F.col("e"), F.col("f"), F.col("d"), F.col("p")).alias("got")).collect())


def test_agreement_tiers_and_recovery(spark):
    scores = spark.createDataFrame([("u", 1, "name", 0.0), ("u", 2, "price_visibility", 0.0), ("u", 3, "sku", 1.0), ("u", 4, "category_path", 0.0), ("u", 5, "price_visibility", 0.5)], "k string, position int, field string, score double")
    order = agreement.report_order(agreement.per_field(scores, "k")).orderBy("tier", "position").collect()
    assert [(r.field, r.position) for r in order] == [("category_path", 1), ("sku", 1), ("price_visibility", 2), ("name", 3)]
    r = agreement.per_product(scores, "k").first()
    assert (r.overall_agreement, r.advisory_agreement) == (0.5, 0.0)
    assert agreement.batch(agreement.per_product(scores.limit(0), "k")).first().overall_agreement == 1.0
    rec = agreement.recovery(spark.createDataFrame([("u", ["brand"], None, 0.5), ("v", [], [], 0.9)], "k string, m array<string>, e array<string>, a double"), "k", F.col("m"), F.col("e"), F.col("a")).orderBy("k").collect()
    assert [len(x.triggers) for x in rec] == [2, 0] and rec[0].triggers[1].detail == "cross-extractor agreement 0.500 below 0.800"
    assert [x.disposition for x in rec] == ["recorded_for_review", "no_action"] and not rec[0].selectors_modified


def test_locator_needs_every_sample(spark):
    samples = spark.createDataFrame([("u1", "<h1>a</h1>", "a"), ("u2", "<h1>b</h1>", "c")], "url string, html string, expected string")
    candidates = spark.createDataFrame([("x", "css_text", "h1", None, None), ("y", "css_text", "h1:hover", None, None)], locators.CANDIDATES)
    found = {r.candidate: r for r in locators.validate(candidates, samples).collect()}
    assert (found["x"].tested, found["x"].matched, found["x"].validated, found["x"].pass_rate) == (2, 1, False, 0.5)
    assert (found["y"].tested, found["y"].validated) == (0, False) and found["y"].error
    named = samples.withColumn("field", F.lit("name"))
    status = locators.diagnose(spark.createDataFrame([("name",), ("sku",)], "field string"), candidates.withColumn("field", F.lit("name")), named)
    assert {r.field: r.status for r in status.collect()} == {"name": "rejected", "sku": "skipped"}


def test_page_cache(spark):
    hashed = F.sha2("raw", 256)
    rows = spark.createDataFrame([("k1", "a\nb", "2024-01-01 00:00:00"), ("k2", "x", "2024-01-01 09:59:00"), ("k2", "old", "2024-01-01 01:00:00")], "cache_key string, raw string, t string")
    cache = rows.select("cache_key", F.replace("raw", F.lit("\n"), F.lit("\r\n")).alias("body"), hashed.alias("content_hash"), F.to_timestamp("t").alias("fetched_at"), F.lit(200).alias("status_code"))
    ask = spark.createDataFrame([("k1", ""), ("k2", ""), ("k3", "")], "cache_key string, body string")
    now = F.to_timestamp(F.lit("2024-01-01 10:00:00"))
    get = lambda **o: {r.cache_key: (r.cache_state, r.body) for r in pages.look_up(ask, cache, 3600, now, **o).collect()}
    assert get() == {"k1": ("stale", None), "k2": ("hit", "x"), "k3": ("miss", None)}
    assert get(offline=True)["k1"] == ("hit", "a\nb")
    assert {v[0] for v in get(refresh=True).values()} == {"miss"}
    keyed = pages.with_key(spark.createDataFrame([("get", "u", {"B": "1", "a": "2"}, None), ("GET", "u", {"A": "2", "b": "1"}, "")], "method string, url string, headers map<string,string>, body string")).collect()
    assert keyed[0].cache_key == keyed[1].cache_key


def test_discovery(spark):
    hits = spark.createDataFrame([("c", 0, [("1", None, "https://shop.test/product/a/?utm_x=1"), ("2", "https://else.test/product/b", "https://shop.test/product/b"), ("3", None, "https://shop.test/catalog/product/view/id/3")]), ("c", 1, [("4", "https://shop.test/product/a", None)])], "category string, page int, hits array<struct<objectID:string,family_url:string,url:string>>")
    found = discovery.from_index(hits, "shop.test").orderBy("position").collect()
    assert [r.url for r in found] == ["https://shop.test/product/a", "https://shop.test/product/b"]
    ld = '<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"url":"/product/z"},{"item":{"url":"/product/y"}},{"url":"/about"}]}</script>'
    listed = discovery.from_listings(spark.createDataFrame([("d", "https://shop.test/d", ld), ("c", "https://shop.test/c", ld)], "category string, url string, html string"), "shop.test")
    every = discovery.discover(discovery.from_index(hits, "shop.test"), listed)
    assert {(r.category, r.method) for r in every.collect()} == {("c", "search_index"), ("d", "json_ld_item_list")}
    known = spark.createDataFrame([("https://shop.test/product/a", "completed", 0)], "url string, status string, attempt_count long")
    assert [r.url for r in discovery.plan(every, known, 2, True, None).collect()] == ["https://shop.test/product/b", "https://shop.test/product/z", "https://shop.test/product/y"]


def test_exports(spark, tmp_path):
    products = spark.createDataFrame([("u1", "N1", "B", ["a", "b"], "d", [], "public"), ("u2", "N2", None, [], None, [], "unknown")], "product_url string, name string, brand string, category_path array<string>, description string, image_urls array<string>, price_visibility string")
    variants = spark.createDataFrame([("u1", "k2", "s2", "1.50", None), ("u1", "k1", "s1", "18.990000", {"a": "b"})], "product_url string, variant_key string, sku string, price_text string, option_values map<string,string>").withColumn("price_visibility", F.lit("public"))
    exports.write_csv(products, variants, str(tmp_path / "csv"))
    rows = [r for p in (tmp_path / "csv").glob("*.csv") for r in csv.DictReader(p.open())]
    assert len(rows) == 3 and tuple(rows[0]) == exports.CSV_COLUMNS
    assert {r["price"] for r in rows} == {"1.50", "18.990000", ""}
    childless = next(r for r in rows if r["product_url"] == "u2")
    assert (childless["sku"], childless["variant_options_json"], childless["price_visibility"]) == ("", "{}", "unknown")
    exports.write_json(products, variants, str(tmp_path / "json"))
    back = {r.product_url: [v.sku for v in r.variants] for r in spark.read.schema("product_url string, variants array<struct<sku:string>>").json(str(tmp_path / "json")).collect()}
    assert back == {"u1": ["s1", "s2"], "u2": []}


def test_artifacts_and_reports(spark, tmp_path):
    (tmp_path / "bad.json").write_text("[1")
    (tmp_path / "list.json").write_text("[1]")
    (tmp_path / "good.json").write_text('{\n"sample_size": 3}')
    read = lambda n: exports.read_artifact(spark, str(tmp_path / n))
    assert read("none.json") is None and read("bad.json") is None and read("list.json") is None and read("good.json") == {"sample_size": 3}
    assert exports.agreement_report("skipped", 0, None, None, {}, {"sample_size": 3, "status": "completed"})["status"] == "preserved"
    assert exports.agreement_report("skipped", 0, 1.0, 1.0, {})["overall_agreement"] is None
    page_ = exports.dashboard("T<x>", {"a&b": spark.createDataFrame([("<i>", 1.0)], "n string, s double"), "none": spark.createDataFrame([], "n string")})
    assert "&lt;i&gt;" in page_ and "100%" in page_ and "no data" in page_ and "http" not in page_


def test_evidence(spark):
    assert "window.masterData" not in evidence.shadow_context(page(GLOVE)) and "manufacturer_part_number" in evidence.shadow_context(page(GLOVE))
    assert evidence.shadow_context("<p>only text</p>") == "only text"
    assert len(evidence.shadow_context(f'<script type="application/ld+json">{"x" * 60_000}</script>')) == evidence.CONTEXT_LIMIT + len(evidence.MARKER)
    assert 'class="t"' in evidence.repair_context('<h1 class="t">a</h1><script>window.a = 1;</script>')
    rows = spark.createDataFrame([("variant: sku", {"a": "1", "b": ""}, {"a": "2", "c": "3"}), ("variants_complete", None, None)], "f string, x map<string,string>, y map<string,string>")
    got = rows.select(evidence.field_name(F.col("f")).alias("f"), evidence.known_values(F.col("x"), F.col("y")).alias("m")).collect()
    assert got[0].f == "sku" and got[0].m == {"a": "2", "c": "3"} and got[1].f is None and got[1].m == {}


def test_drift_and_stale(spark):
    cases = [(1, 4, True, True), (2, 4, True, False), (1, 3, True, False), (0, 9, False, False), (3, None, True, False)]
    rows = spark.createDataFrame(cases, "n int, o int, c boolean, want boolean")
    assert all(r.want == r.got for r in rows.select("want", state.count_drift(F.col("n"), F.col("o"), F.col("c")).alias("got")).collect())
    stored = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a")], "p string, k string")
    assert [tuple(r) for r in state.stale(stored, spark.createDataFrame([("p", "b")], "p string, k string"), "p", "k").collect()] == [("p", "a")]
