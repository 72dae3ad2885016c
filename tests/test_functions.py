from __future__ import annotations

import difflib
import html
import random
import tracemalloc
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import commerce, finder, records, selectors, similarity, text, url
from shelfmark.operators import robots


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("raw", "price"),
    [("$1,234.50", "1234.5"), ("(12.00)", "-12"), ("-$5", "-5"), ("− 3.5", "-3.5"), ("USD19.99", "99"), ("€ 9,99", "9"), ("$1,234,56", "1234"), ("call us", None), ("", None), (None, None), ("10 each", "10"), ("&#36;12.50", "12.5"), ("1234567890123.50", "1234567890123.5"), ("&pound;&nbsp;3", "3"), ("+4", "4"), ("-0", "0"), ("(0.00)", "0")],
)
def test_price(spark, raw, price):
    assert one(spark, raw, commerce.parse_price) == (None if price is None else Decimal(price))


@pytest.mark.parametrize(("raw", "size"), [("Box of 100", "100/box"), ("100 / BX", "100/box"), ("1,000 per case", "1000/case"), ("12 pcs", "12/piece"), ("2 crates", "2 crates"), ("10&nbsp;/ BX", "10/box"), ("  ", None), (None, None)])
def test_pack_size(spark, raw, size):
    assert one(spark, raw, commerce.pack_size) == size


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("HTTP://Shop.TEST:80/a//b/?utm_source=x&b=2&a=1#top", "http://shop.test/a/b?a=1&b=2"),
        ("https://shop.test", "https://shop.test/"),
        ("https://shop.test/a b/", "https://shop.test/a%20b"),
        ("https://shop.test/x?gclid=1&q=", "https://shop.test/x?q="),
        ("https://shop.test:8443/x", "https://shop.test:8443/x"),
        ("http://[::1]/x", "http://[::1]/x"),
        ("https://Shop.test//a///?B=2&a=1&fbclid=z&a=0#x", "https://shop.test/a?B=2&a=0&a=1"),
        ("http://shop.test:443/", "http://shop.test:443/"),
        ("https://bücher.test/ü?q=a b&amp;r=%41", "https://xn--bcher-kva.test/%C3%BC?q=a+b&r=A"),
        ("https://user:pw@shop.test/x", "https://shop.test/x"),
        ("shop.test/x", None),
        ("ftp://shop.test/x", None),
        ("https://shop.test:99999/x", None),
        ("", None),
    ],
)
def test_url(spark, raw, expected):
    assert one(spark, raw, url.normalize_url) == expected


@pytest.mark.parametrize(("raw", "expected"), [(" a&amp;b  c ", "a&b c"), ("a b", "a b"), ("  ", None), (None, None)])
def test_text(spark, raw, expected):
    assert one(spark, raw, text.normalize_text) == expected


def test_markup_and_labels(spark):
    assert one(spark, "<b>5</b> mm &lt; 6", text.clean_text).startswith("5 mm")
    assert one(spark, "a < b > c", text.plain_text) == "a < b > c"
    assert one(spark, "https://schema.org/InStock", text.availability_label) == "In Stock"
    assert one(spark, 1.0, text.percentage, "double") == "100%"
    assert one(spark, 0.125, text.percentage, "double") == "12.5%"
    assert one(spark, "<a href='x'>", text.escape_html) == "&lt;a href=&#x27;x&#x27;&gt;"


@pytest.mark.parametrize("raw", ["Straße", "ΣΊΣΥΦΟΣ", "ﬁn", "İx", "Iıiİ", "ŉ", "abc", "ſ", "", "ᏸᎠꭰ", "µẞǰΐ", "ὀΔΟΣ ς", "".join(c for c in map(chr, range(1, 0x2000)) if c.isalpha() and c not in "\u1c89\u1c8a")])
def test_casefold_is_python_s(spark, raw):
    assert one(spark, raw, text.casefold) == raw.casefold()


def test_ordinary_urls_stay_in_the_jvm(spark):
    """Both ways give the same."""
    plain = ["http://a.test/x?b=1&a=2&utm_x=3#top", "HTTPS://A.test:443//x//", "http://a.test:80", "http://a-b.test/p;q=1/?x=", "https://a.test/?z=1&z=0"]
    rows = spark.createDataFrame([(x,) for x in plain], "x string")
    assert all(r.p for r in rows.select(F.rlike("x", F.lit(url._PLAIN)).alias("p")).collect())
    assert [r.y for r in rows.select(url.normalize_url("x").alias("y")).collect()] == [url.canonical_url(x) for x in plain]


def test_strict_forms_raise(spark):
    with pytest.raises(Exception, match="not an http"):
        one(spark, "ftp://x.test/", url.require_url)
    with pytest.raises(Exception, match="not a currency"):
        one(spark, "dollars", lambda c: commerce.currency(c, strict=True))
    assert one(spark, " usd ", lambda c: commerce.currency(c, strict=True)) == "USD"


def test_canonical_json_is_sorted_at_every_depth(spark):
    kind = "m map<string,map<string,int>>, a string"
    x, y = ({"b": {"z": 1, "y": 2}, "a": {}}, None), ({"a": {}, "b": {"y": 2, "z": 1}}, None)
    rows = spark.createDataFrame([x, y], kind)
    found = [r.j for r in rows.select(records.canonical_json(rows, "m", "a").alias("j")).collect()]
    assert found == ['{"a":null,"m":{"a":{},"b":{"y":2,"z":1}}}'] * 2


def test_content_hash_covers_the_whole_record(spark):
    def hashed(**change):
        row = {"name": "n", "specifications": {"a": "1", "b": "2"}, "scraped_at": "t", "variants": [("s1", 1.0, {"k": "v"}), ("s2", 2.0, {})]} | change
        df = spark.createDataFrame([tuple(row.values())], "name string, specifications map<string,string>, scraped_at string, variants array<struct<sku:string,price:double,options:map<string,string>>>")
        return df.select(records.content_hash(df).alias("h")).first().h

    same = hashed()
    assert hashed(scraped_at="later") == same
    assert hashed(variants=[("s2", 2.0, {}), ("s1", 1.0, {"k": "v"})]) == same
    assert hashed(specifications={"b": "2", "a": "1"}) == same
    others = [hashed(name="m"), hashed(specifications={"a": "1"}), hashed(variants=[("s1", 1.5, {"k": "v"}), ("s2", 2.0, {})]), hashed(variants=[("s1", 1.0, {"k": "w"}), ("s2", 2.0, {})])]
    assert len({same, *others}) == 5


def test_utc_text(spark):
    rows = spark.sql("SELECT timestamp'2024-03-01 10:00:00+02:00' AS a, timestamp'2024-03-01 10:00:00.25' AS b")
    assert tuple(rows.select(records.utc_text(F.col("a")), records.utc_text(F.col("b"))).first()) == ("2024-03-01T08:00:00+00:00", "2024-03-01T10:00:00.250000+00:00")


def test_similarity_follows_sequence_matcher(spark):
    rows = spark.createDataFrame([("ab" * 150, "ba" * 150), (None, ""), ("Glove", "glove")], "a string, b string")
    assert [r.s for r in rows.select(similarity.text_similarity("a", "b").alias("s")).collect()] == [0.0, 1.0, 1.0]


def test_identity(spark):
    rows = spark.createDataFrame([("AB-1", "x", {"k": "v"}), (None, "X", {"K": "V"}), (None, "x", {"k": "v"}), (None, None, {})], "sku string, item string, o map<string,string>")
    a, b, c, d = (r.i for r in rows.select(records.variant_identity(F.col("sku"), F.col("item"), F.lit(None).cast("string"), F.col("o")).alias("i")).collect())
    assert a == "sku:ab-1" and b == c and b.startswith("fallback:") and d == "default"


def test_option_agreement(spark):
    rows = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": "1"}), ({}, {})], "x map<string,string>, y map<string,string>")
    assert [r.s for r in rows.select(records.option_agreement(F.col("x"), F.col("y")).alias("s")).collect()] == [0.5, 1.0]


def test_retry_delay(spark):
    rows = spark.createDataFrame([(1, None), (3, None), (1, "7"), (1, "999"), (1, "soon")], "n int, h string")
    assert [r.d for r in rows.select(commerce.retry_delay(F.col("n"), F.col("h")).alias("d")).collect()] == [1.0, 4.0, 7.0, 60.0, 1.0]


PAGE = '<body class="a b"><div id="x"><p data-k="1">one</p><p>two <b>three</b></p></div><script>window.cfg = "{\\"v\\": [{\\"n\\": 1}, {\\"n\\": 2}]}";</script></body>'


@pytest.mark.parametrize(
    ("locator", "found"),
    [
        (("css_text", "#x p"), ["one", "two three"]),
        (("css_text", "div > p > b"), ["three"]),
        (("css_attribute", "p[data-k]", "data-k"), ["1"]),
        (("css_text", ".b .none, b"), ["three"]),
        (("js_variable", "cfg", None, "v.*.n"), ["1", "2"]),
        (("js_variable", "cfg", None, "v.1.n"), ["2"]),
        (("js_variable", "nothing"), []),
    ],
)
def test_locators(locator, found):
    assert finder.Page(PAGE).find(*locator) == found


LIST = '<ul class="a list" lang="en-GB"><li id="i1">1</li>text<li class="x y" data-u="https://s.test/a.pdf">2</li><li>3</li><li><p></p><p>4</p></li></ul><p>5</p><div></div><p title="a (b), c > d">6</p><ul lang="en"><li>7</li></ul>'


@pytest.mark.parametrize(
    ("selector", "found"),
    [
        ("li:nth-child(2)", "2"), ("li:nth-child(odd)", "1 3 7"), ("li:nth-child(even)", "2 4"), ("li:nth-child(2n+3)", "3"), ("li:nth-child(-n+2)", "1 2 7"), ("li:nth-child(n)", "1 2 3 4 7"), ("li:nth-child( 3 )", "3"),
        ("li:first-child", "1 7"), ("li:last-child", "4 7"), ("li:only-child", "7"), ("p:empty", ""), ("li:not(.x):not(:first-child)", "3 4"), ("li:not(.x, :nth-child(3))", "1 4 7"),
        ("ul + p", "5"), ("ul ~ p", "5 6"), ("div + p", "6"), ("#i1 + li", "2"), ("#i1 ~ li", "2 3 4"), ("ul>li > p", "4"), ("ul li + li p", "4"),
        ("[lang|=en] > :last-child", "4 7"), ("ul[class~=list] li.x.y", "2"), ("li[data-u^='https:']", "2"), ("li[data-u$=\".pdf\"]", "2"), ("li[data-u*='.test/']", "2"), ("[title='a (b), c > d']", "6"), ("[title=\"a (b), c > d\"], #i1", "1 6"),
        ("li[data-u^='']", ""), ("* > li", "1 2 3 4 7"), ("LI#i1", "1"), ("ul  >  li:nth-child(1)", "1 7"), ("p:not(ul ~ p)", "4"),
        ("li:nth-child(x)", None), ("li:not(", None), ("li..x", None), ("> li", None), ("li >", None), ("li,,p", None), ("li:hover", None), ("p#", None), (".x*", None), ("", None), ("li:not()", None),
    ],
)
def test_selectors(selector, found):
    page = finder.Page(LIST)
    if found is None:
        with pytest.raises(selectors.SelectorError):
            page.find("css_text", selector)
    else:
        assert page.find("css_text", selector) == found.split()


def test_variables_are_read_once_and_unwrapped_once():
    page = finder.Page('window.a = [1, {"b": "x"}]; window.a = 2; window.c="[\\"y\\"]"; window.d = "plain"; window.e = {bad; window.f = "\\"\\\\\\"z\\\\\\"\\""; window.g = f(); mywindow.h = 1; window.i = null')
    find = lambda name, path=None: page.find("js_variable", name, None, path)
    assert (find("a", "1.b"), find("a", "0"), find("a", "7"), find("a", "*"), find("c", "*"), find("d")) == (["x"], ["1"], [], ["1"], ["y"], ["plain"])
    assert (find("e"), find("f"), find("g"), find("h"), find("i"), find("a", "-1")) == ([], ['"z"'], [], [], [], [])


@pytest.mark.parametrize("locator", [("css_text", "p:hover"), ("css_attribute", "p"), ("js_variable", "a b"), ("other", "p"), ("css_text", "> p")])
def test_bad_locators(locator):
    with pytest.raises(selectors.SelectorError):
        finder.Page(PAGE).find(*locator)


def test_robots_groups():
    rules = "User-agent: *\nDisallow: /all\n\nUser-agent: shop\nUser-agent: bot\nAllow: /a # note\nDisallow: /b\n\nUser-agent: shopbot\nDisallow: /c\n"
    assert robots.parse(rules) == [(False, "/all")]
    assert robots.parse(rules, "ShopBot/1.0") == [(False, "/c")]
    assert robots.parse(rules, "my-bot") == [(True, "/a"), (False, "/b")]
    assert robots.parse("", "x") == []


def test_robots_decisions(spark):
    table = robots.rules_table(spark, [(False, "/a"), (True, "/a/b"), (False, "/a/b"), (False, "/*.pdf$")])
    pages = spark.createDataFrame([(1, "https://s.test/a/x"), (2, "https://s.test/a/b"), (3, "https://s.test/z.pdf"), (4, "https://s.test/z.pdf?x"), (5, "https://s.test")], "id int, url string")
    found = {r.id: r.decision for r in robots.decide(pages, table, "id").collect()}
    assert found == {1: "DISALLOWED", 2: "ALLOWED", 3: "DISALLOWED", 4: "ALLOWED", 5: "ALLOWED"}


def _like(rng, n):
    base = "".join(rng.choice("aab bcd efé") for _ in range(n))
    other = list(base)
    for _ in range(rng.randint(0, n // 3 + 1)):
        at = rng.randint(0, len(other))
        other[at : at + rng.randint(0, 3)] = rng.choices("abcxyzq é", k=rng.randint(0, 3))
    return base, "".join(other)


def test_ratio_is_the_standard_library_s():
    rng = random.Random(5)
    cases = [_like(rng, rng.choice([0, 1, 3, 20, 150, 199, 200, 201, 400, 1500])) for _ in range(400)]
    cases += [("ab" * 150, "ba" * 150), ("ab" * 150, "ab" * 150), ("x" * 500, "x" * 400), ("", "a"), ("q" + "ab" * 200, "ab" * 200 + "q")]
    words = ["the", "quick", "brown", "fox", "jumps", "zebra", "over", "lazy", "dog"]
    cases += [(" ".join(rng.choices(words, k=n)), " ".join(rng.choices(words, k=n))) for n in (10, 50, 300, 300)]
    for a, b in cases:
        assert similarity.ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio(), (a, b)


def test_decisions_are_those_of_the_ratio(spark):
    rng = random.Random(6)
    pairs = [_like(rng, rng.choice([0, 2, 30, 199, 300])) for _ in range(150)] + [("abc " * 90, "cab " * 90), ("x" * 100, "y" * 100), (None, ""), (None, "a"), ("A &amp; b", "a & B")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    plain = lambda t: " ".join(html.unescape(t or "").split()).casefold()
    found = {r.i: r for r in similarity.decisions(rows, "a", "b").collect()}
    for i, (a, b) in enumerate(pairs):
        a, b = plain(a), plain(b)
        assert found[i].agreed == ((difflib.SequenceMatcher(None, a, b).ratio() if a or b else 1.0) >= 0.90), (a, b)
    assert {r.decided_by for r in found.values()} == {"equal", "length", "letters", "matching"}


def test_ratio_by_arrays_is_that_of_places():
    rng = random.Random(9)
    for _ in range(300):
        letters = "abcdefghijé😀"[: rng.randint(1, 12)]
        a, b = ("".join(rng.choices(letters, k=rng.randint(0, 260))) for _ in "ab")
        b = a[: rng.randint(0, len(a))] + b if rng.random() < 0.3 else b
        assert similarity._total(a, b, similarity._runs(*similarity._pairs(a, b)[:3])) == similarity._Matcher(a, b).total()
    a, b = ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=3000)) + "0123456789" * 30 for _ in "ab")
    assert similarity._pairs(a, b)[3] >= similarity.ARRAYS[0]
    assert similarity.ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_ranges_that_wait_hold_their_own_runs_only():
    """Runs grow shorter along both texts, so that each step leaves nearly all of them to the next."""
    rng = random.Random(11)
    words = ["".join(rng.choices([*map(chr, range(0x4E00, 0x4F90))], k=n)) for n in range(160, 20, -1)]
    a, b = ("".join(w + rng.choice(mark) for w in words) for mark in ("!?", ";:"))
    pairs = similarity._pairs(a, b)
    assert similarity.ARRAYS[0] <= pairs[3] <= similarity.ARRAYS[1]
    runs = similarity._runs(*pairs[:3])
    held = sum(x.nbytes for x in runs)
    tracemalloc.start()
    found = similarity._total(a, b, runs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == sum(map(len, words)) and peak < 6 * held


def test_similarity_of_batches_keeps_nulls_and_order(spark):
    texts = [None, "", "abc", "a &amp; b", "é" * 300, "x" * 250]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)], "i int, a string, b string").coalesce(1)
    plain = lambda t: html.unescape(t or "")
    for r in rows.withColumn("s", similarity.text_similarity("a", "b")).collect():
        a, b = plain(r.a), plain(r.b)
        assert r.s == (difflib.SequenceMatcher(None, a, b).ratio() if a or b else 1.0), r
