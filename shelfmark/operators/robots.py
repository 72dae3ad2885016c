"""Robots rules of many sites, decided by joins on equal keys.

A rule's *head* is its pattern up to the first wildcard.  A page can only meet rules of
its host whose head begins its target, so the target is cut at the lengths that heads of
its host have, and joined with the rules on (host, head).  Only rules with a wildcard or
an end mark then test their pattern, on the few pages that met their head.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url as urls

RULES = "host string, allow boolean, pattern string, head string, regex string, specificity int"
#: The host of rules that hold for all pages of a table.
ANY = ""


def parse(text: str, agent: str = "*") -> list[tuple[bool, str]]:
    """(allow, pattern) of the groups that name the agent most closely."""
    groups: list[tuple[set[str], list[tuple[bool, str]]]] = [(set(), [])]
    for line in text.splitlines():
        body = line.partition("#")[0].strip()
        name, colon, value = (x.strip() for x in body.partition(":"))
        names_agent = colon and name.lower() == "user-agent"
        if groups[-1][1] and (not body or names_agent):
            groups.append((set(), []))
        if names_agent:
            groups[-1][0].add(value.lower())
        elif colon and value and groups[-1][0] and name.lower() in ("allow", "disallow"):
            groups[-1][1].append((name.lower() == "allow", value))
    weighed = [(max((0 if t == "*" else len(t) for t in tokens if t == "*" or t in agent.lower()), default=-1), rules) for tokens, rules in groups]
    closest = max(w for w, _ in weighed)
    return [] if closest < 0 else [r for w, rules in weighed if w == closest for r in rules]


def _rule(host: str, allow: bool, pattern: str) -> tuple:
    """A rule's row; regex is null where the head says all."""
    body = pattern.removesuffix("$")
    head, *more = body.split("*")
    regex = "^" + ".*".join(map(re.escape, [head, *more])) + ("$" if body != pattern else "") if more or body != pattern else None
    return host, allow, pattern, head, regex, len(body.replace("*", ""))


def rules_table(spark: SparkSession, rules: list[tuple[bool, str]]) -> DataFrame:
    """The rules of one site, for pages that are all of it."""
    return spark.createDataFrame([_rule(ANY, *r) for r in rules], RULES)


def site_rules(sites: DataFrame, agent: str = "*") -> DataFrame:
    """The rules of many sites from (host, text); a text that could not be read is null and gives none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [_rule(host, *r) for host, text in zip(frame["host"], frame["text"], strict=True) for r in parse(text, agent)]
            yield pd.DataFrame(rows, columns=["host", "allow", "pattern", "head", "regex", "specificity"])

    return sites.filter("text IS NOT NULL").select(F.lower("host").alias("host"), "text").mapInPandas(run, RULES)


def matches(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """``targets`` (host, target, ...) with each rule that fits, as a column ``rule``; rows without one are left out."""
    heads = rules.groupBy(F.col("host").alias("_host")).agg(F.collect_set(F.length("head")).alias("_lengths"))
    cut = targets.join(heads, F.col("host") == F.col("_host")).drop("_host").withColumn("_length", F.explode(F.filter("_lengths", lambda n: n <= F.length("target")))).drop("_lengths")
    keyed = cut.withColumn("_head", F.substring(F.col("target"), F.lit(1), F.col("_length")))
    rule = rules.select(F.col("host").alias("_host"), F.col("head").alias("_rule_head"), F.struct("allow", "pattern", "regex", "specificity").alias("rule"))
    met = keyed.join(rule, (F.col("host") == F.col("_host")) & (F.col("_head") == F.col("_rule_head")))
    return met.filter("rule.regex IS NULL OR target RLIKE rule.regex").drop("_length", "_head", "_host", "_rule_head")


def _decided(targets: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, allow) of the targets that a rule fits: the most specific one's, allow on ties."""
    return matches(targets, rules).groupBy(key).agg(F.max_by("rule.allow", F.struct("rule.specificity", "rule.allow")).alias("_allow"))


def _word(allow: Column) -> Column:
    return F.when(F.coalesce(allow, F.lit(True)), "ALLOWED").otherwise("DISALLOWED")


def decide(pages: DataFrame, rules: DataFrame | None, key: str, url: str = "url") -> DataFrame:
    """(key, decision) of pages of one site: the most specific matching rule, allow on ties, allowed without a match.

    rules is None where the robots file could not be read: every page is UNKNOWN.
    """
    if rules is None:
        return pages.select(key, F.lit("UNKNOWN").alias("decision"))
    held = pages.select(key, F.lit(ANY).alias("host"), urls.target(F.col(url)).alias("target"))
    return pages.select(key).join(_decided(held, rules, key), key, "left").select(key, _word(F.col("_allow")).alias("decision"))


def decide_sites(pages: DataFrame, sites: DataFrame, key: str, url: str = "url", agent: str = "*") -> DataFrame:
    """(key, decision) of pages of many sites; UNKNOWN where a host is not among ``sites`` or its text is null."""
    held = pages.select(key, urls.host(F.col(url)).alias("host"), urls.target(F.col(url)).alias("target"))
    read = sites.filter("text IS NOT NULL").select(F.lower("host").alias("host"), F.lit(True).alias("_read")).distinct()
    found = held.select(key, "host").join(read, "host", "left").join(_decided(held, site_rules(sites, agent), key), key, "left")
    return found.select(key, F.when(F.col("_read"), _word(F.col("_allow"))).otherwise("UNKNOWN").alias("decision"))


def admitted(decision: Column, unknown: str = "deny") -> Column:
    """Whether a decision lets a page be fetched; ``unknown`` says what UNKNOWN means."""
    return (decision == "ALLOWED") | ((decision == "UNKNOWN") & F.lit(unknown == "allow"))
