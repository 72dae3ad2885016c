"""The walk of structured data against a plain walk of the same JSON."""

from __future__ import annotations

import json
import random

from shelfmark.functions import url as urls
from shelfmark.operators import extraction, structured
from shelfmark.plans import structured as plans

from .compare import DATA
from .test_operators import GLOVE, URL, page


def plain(value, out):
    if isinstance(value, dict):
        kinds = value.get("@type")
        kinds = [k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)]
        if kinds:
            out.append((kinds, value["name"] if isinstance(value.get("name"), str) else None))
        value = value.values()
    for x in value if not isinstance(value, (str, int, float, bool, type(None))) else ():
        plain(x, out)
    return out


def made(rng, depth=0):
    kind = rng.random()
    if depth > 6 or kind < 0.3:
        return rng.choice([None, True, 1, 2.5, "", "x", '{"@type":"Trap"}', "[1]", "é\n\"q\"", 10**30])
    if kind < 0.6:
        return [made(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    keys = rng.sample(["zeta", "@type", "name", "a b", "brand", "offers", "@graph", "x.y", "é"], rng.randint(0, 5))
    return {k: rng.choice(["Product", ["A", 3, "B"], [], 7, None]) if k == "@type" else made(rng, depth + 1) for k in keys}


def frame(spark, pages):
    return spark.createDataFrame(pages, "url string, html string")


def script(*values):
    return "".join(f'<script type="application/ld+json">{v if isinstance(v, str) else json.dumps(v)}</script>' for v in values)


def test_walk_equals_a_plain_one(spark):
    rng = random.Random(4)
    values = [[made(rng) for _ in range(rng.randint(0, 3))] for _ in range(60)]
    pages = [(f"u{i}", "<html>" + script(*map(json.dumps, v)) + "</html>") for i, v in enumerate(values)] + [("none", None), ("text", "no data")]
    want = {(f"u{i}", p, t, name) for i, v in enumerate(values) for p, (kinds, name) in enumerate(plain(v, [])) for t in kinds}
    found = structured.typed_nodes(frame(spark, pages))
    assert {tuple(r) for r in found.collect()} == want
    shown = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in shown and "Arrow" not in shown and "Pandas" not in shown


def test_deep_and_malformed(spark):
    deep: object = {"@type": "Last"}
    for i in range(120):
        deep = {"a": [deep]} if i % 2 else [deep]
    pages = [("deep", script(deep)), ("bad", script('{"@type": "Product",', '<!-- {"@type": "Thing"} -->', ""))]
    found = structured.typed_nodes(frame(spark, pages)).collect()
    assert {(r.url, r.type) for r in found} == {("deep", "Last"), ("bad", "Thing")}
    assert {tuple(r) for r in structured.malformed(frame(spark, [*pages, ("none", None)])).collect()} == {("deep", 1, 0), ("bad", 3, 2), ("none", 0, 0)}


def test_products_and_breadcrumbs_equal_the_page_pass(spark):
    crumb = lambda *items: {"@type": "BreadcrumbList", "itemListElement": list(items)}
    cases = [
        page(GLOVE), page(GLOVE, {"url": URL + "/?utm_source=a", "name": "A <b>bold</b> name"}),
        script({"@graph": [{"@type": "Product", "name": "First", "sku": "s"}, {"@type": "Product", "name": "Own", "url": URL}]}, crumb({"position": 2, "name": "B"}, {"position": 1, "name": "A"}), crumb({"name": "C"}, {"name": "Home"})),
        script({"@type": "Product", "name": "X"}, crumb({"name": "x"}, {"position": "1", "name": "late"}, {"position": 5.5, "name": "early"}, {"position": 7, "item": URL, "name": "me"}, 3, None, {"position": 8, "name": "early"})),
        script({"@type": "Product", "name": "Y"}, crumb()),
    ]
    pages = frame(spark, [(f"{URL}?p={i}", c) for i, c in enumerate(cases)])
    paths = {r.url: r.path for r in structured.breadcrumbs(pages).collect()}
    names = {r.url: json.loads(r.json)["name"] for r in structured.products(pages).collect()}
    for r in extraction.extract(pages).collect():
        assert paths.get(r.url, []) == r.category_path, r.url
        assert extraction._text(names[r.url]) == r.name


def test_pages_are_dealt_out_however_few_files_their_parts_are_in(spark, monkeypatch):
    data = str(DATA)
    assert spark.read.parquet(f"{data}/part.parquet").rdd.getNumPartitions() == 1
    monkeypatch.setattr(plans, "PAGES_A_TASK", 20)
    n = -(-spark.read.parquet(f"{data}/part.parquet").count() // 20)
    assert n > 4 and plans._pages(spark, data).rdd.getNumPartitions() == n


def test_escaped_and_listed_types_are_found(spark):
    body = r'[{"@type":"\u0050roduct","name":"p &amp; q"},{"@type":["x","Breadcrumb\u004cist"],"itemListElement":[{"position":1,"name":"a &lt;b&gt;c&lt;/b&gt;"},{"position":2,"name":"P & Q"},{"position":3,"name":"u < v"}]},{"@type":"Thing","note":"Product"}]'
    pages = spark.createDataFrame([("https://a.b/c", f'<script type="application/ld+json">{body}</script>')], "url string, html string")
    assert [list(r.path) for r in structured.breadcrumbs(pages).collect()] == [["a c", "u < v"]]


def test_urls_are_taken_apart_in_one_match(spark):
    given = ["HTTP://A.b:80//x//?b=2&a=1&utm_z=3#f", "https://a.b", "https://a.b:8443?q=", "https://a.b/c\n", "https://xn--a.b/", "https://a.b/c d", "", None, "https://a.b/?", "https://a.b/x?&"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(given)], "i int, u string").repartition(1).select("i", urls.normalize_url("u").alias("n"))
    assert [r.n for r in rows.orderBy("i").collect()] == [urls.canonical_url(u) for u in given]
    assert rows._jdf.queryExecution().analyzed().toString().count("regexp_extract") == 0
