"""Robots decisions of many sites against a plain search over all rules."""

from __future__ import annotations

import random
import re

from shelfmark.operators import robots
from shelfmark.plans import registry

from .compare import DATA


def plain(target, rules):
    best = None
    for allow, pattern in rules:
        body = pattern.removesuffix("$")
        regex = ".*".join(map(re.escape, body.split("*"))) + ("$" if body != pattern else "")
        if re.match(regex, target):
            best = max(best or (-1, False), (len(body.replace("*", "")), allow))
    return "ALLOWED" if best is None or best[1] else "DISALLOWED"


def test_many_sites_equal_a_plain_search(spark):
    rng = random.Random(6)
    part = lambda: "".join(rng.choice("ab/*?=.é") for _ in range(rng.randint(0, 5)))
    sites = {}
    for i in range(60):
        lines = ["User-agent: " + rng.choice(["*", "mark", "other"])] + [f"{rng.choice(['Allow', 'Disallow'])}: /{part()}{rng.choice(['', '', '$'])}" for _ in range(rng.randint(0, 8))]
        sites[f"s{i}.test"] = None if i % 9 == 0 else "\n".join(lines)
    sites["s1.test"] = "User-agent: *\nDisallow: *\nAllow: $\nAllow: /a*b$\nDisallow: /aab$"
    pages = [(i, f"https://S{rng.randrange(62)}.test/" + "".join(rng.choice("ab/.é") for _ in range(rng.randint(0, 6))) + rng.choice(["", "?a=b", "?"])) for i in range(1500)]
    pages += [(2000, "https://s1.test/aab"), (2001, "https://s1.test/acb"), (2002, "https://s1.test"), (2003, None), (2004, "no url")]
    found = robots.decide_sites(spark.createDataFrame(pages, "id int, url string"), spark.createDataFrame(list(sites.items()), "host string, text string"), "id", agent="mark/2")
    want = {}
    for i, url in pages:
        m = re.match(r"https://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url or "")
        host, path, query = (m[1].lower(), m[2] or "/", m[3]) if m else ("", "/", "")
        text = sites.get(host)
        want[i] = "UNKNOWN" if text is None else plain(path + (f"?{query}" if query else ""), robots.parse(text, "mark/2"))
    assert {r.id: r.decision for r in found.collect()} == want
    assert set(want.values()) == {"UNKNOWN", "ALLOWED", "DISALLOWED"}


def test_no_rule_meets_every_page(spark):
    plan = registry.QUERIES["robots_sites"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    plan = registry.QUERIES["robots_decisions"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("NestedLoop") <= 1 and "RLIKE" not in plan.split("NestedLoop")[-1].split("\n")[0]  # with the one row of lengths


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id int, url string")
    site = spark.createDataFrame([("a.test", "")], "host string, text string")
    assert robots.decide_sites(none, site, "id").collect() == []
    one = spark.createDataFrame([(1, "https://a.test/x"), (2, "https://b.test/x")], "id int, url string")
    assert {r.id: r.decision for r in robots.decide_sites(one, site, "id").collect()} == {1: "ALLOWED", 2: "UNKNOWN"}
    assert {r.decision for r in robots.decide_sites(one, site.limit(0), "id").collect()} == {"UNKNOWN"}
