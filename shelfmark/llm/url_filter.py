"""URL filter: rules first, else logistic regression on hashed character n-grams.

Host and path are cut into trigrams with start and end marks, hashed into BUCKETS
features.  The model is trained from a small labelled table of urls (at most
TRAIN_ROWS rows, which are refused beyond that) by gradient descent on the driver;
scoring is one DataFrame projection.  The table that comes with it, ``labelled()``, has
ordinary sites (known words or made-up names) and unwanted ones; four fifths of its
hosts teach, and the rest tell how well that went (``accuracy``).

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule and gets the model's verdict for them; a probability of 0.5 or more is
``allow``; repeated urls are judged one by one; urls of any length are read whole; an
empty table gives no rows; columns other than page_id and url are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, GRAM, TRAIN_ROWS = 4096, 3, 10_000
#: Rows of ``labelled()``, and one in so many of its hosts that are held out.
LABELLED, HELD_ONE_IN = 6_000, 5

#: (verdict, host, path) of the standing rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# Words and paths of wanted and unwanted sites, from which the labelled urls are made.
WANTED = "news library university museum docs wiki science history garden weather research journal atlas school archive forum recipes review travel music code data health sports city book art law energy ocean".split()
UNWANTED = "casino pills spam viagra poker loans xxx adult warez torrent lottery replica bets escort cheap payday crack jackpot clickbait malware porn slots dating nude cialis forex bingo ripoff hacked keygen".split()
SYLLABLES = "ba be da el en er fi ga he in ka la le lo ma mi na ne no on or pa ra re ri ro sa se so ta te th ti to un ur va ve wa an".split()
PLACES, DOMAINS = ("", "www.", "blog.", "m.", "shop.", "my-"), ("com", "org", "net", "info", "test", "co.uk")
WANTED_PATHS = ("/articles/2024/summary", "/en/guide.html", "/about", "/topics/12", "/", "/fr/825", "/index.php", "/blog/post-7", "/category/items", "/wiki/Main_Page")
UNWANTED_PATHS = ("/win-money-now", "/free-offer", "/buy/cheap-deal", "/bonus/click", "/go.php?aff=77", "/download/crack.exe", "/xxx/video1", "/signup-bonus", "/best-pills-online", "/")


def labelled(spark: SparkSession) -> DataFrame:
    """The labelled urls: url, label (1 allow, 0 block)."""

    def pick(values, draw: str) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64(F.lit(draw), "id"), F.lit(len(values))) + 1).cast("int"))

    chance = lambda draw, n: F.pmod(F.xxhash64(F.lit(draw), "id"), F.lit(n)) == 0
    name = F.concat(*[pick(SYLLABLES, f"s{i}") for i in range(3)], F.when(chance("s4", 2), pick(SYLLABLES, "s3")).otherwise(F.lit("")))
    link = pick(("", "-"), "link")
    wanted = F.when(chance("made", 2), name).when(chance("two", 2), F.concat(pick(WANTED, "w1"), link, name)).otherwise(F.concat(pick(WANTED, "w1"), link, pick(WANTED, "w2")))
    other = F.when(chance("named", 3), name).when(chance("digits", 3), F.concat(F.lit("4u"), F.pmod(F.col("id"), F.lit(97)).cast("string"))).otherwise(pick(UNWANTED, "u2"))
    unwanted = F.concat(pick(UNWANTED, "u1"), link, other)
    good = F.col("id") % 2 == 0
    site = F.concat(pick(PLACES, "place"), F.when(good, wanted).otherwise(unwanted), F.lit("."), pick(DOMAINS, "domain"))
    page = F.when(good, pick(WANTED_PATHS, "path")).otherwise(pick(UNWANTED_PATHS, "path"))
    return spark.range(LABELLED).select(F.concat(pick(("http://", "https://"), "scheme"), site, page).alias("url"), F.when(good, 1).otherwise(0).alias("label"))


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _grams(text: Column, mark: str) -> Column:
    marked = F.concat(F.lit(f"{mark}^"), text, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.char_length(marked) - (GRAM - 1)), lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(marked, i, F.lit(GRAM))), F.lit(BUCKETS)).cast("int"))


def features(host_: Column, path_: Column) -> Column:
    """Distinct feature numbers of a url."""
    return F.array_distinct(F.concat(_grams(host_, "h"), _grams(path_, "p")))


def _rows(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all rows in one line, the row of each, labels, and which hosts are held out."""
    named = rows.select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "label")
    held = F.pmod(F.xxhash64("host"), F.lit(HELD_ONE_IN)) == 0
    listed = named.select(features(F.col("host"), F.col("path")).alias("f"), "label", held.alias("held")).limit(TRAIN_ROWS + 1).collect()
    if len(listed) > TRAIN_ROWS:
        raise ValueError(f"more than {TRAIN_ROWS} labelled urls")
    listed = sorted((sorted(r.f), r.label, r.held) for r in listed)
    found = np.array([i for f, _, _ in listed for i in f], np.int64)
    return found, np.repeat(np.arange(len(listed)), [len(f) for f, _, _ in listed]), np.array([x[1] for x in listed], float), np.array([x[2] for x in listed], bool)


def _scores(found: np.ndarray, owner: np.ndarray, n: int, weights: np.ndarray, bias: float) -> np.ndarray:
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))
    return bias + scale * np.bincount(owner, weights=weights[found], minlength=n)


def _fit(found: np.ndarray, owner: np.ndarray, labels: np.ndarray, rounds: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Gradient descent with momentum on the mean log loss and a small weight decay."""
    weights, bias, n = np.zeros(BUCKETS), 0.0, len(labels)
    if not n:
        return weights, bias
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))
    pace, pace_bias = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        miss = labels - 1 / (1 + np.exp(-np.clip(_scores(found, owner, n, weights, bias), -30, 30)))
        step = np.bincount(found, weights=(scale * miss)[owner], minlength=BUCKETS) / n
        pace = 0.9 * pace + rate * (step - decay * weights)
        pace_bias = 0.9 * pace_bias + rate * miss.mean()
        weights, bias = weights + pace, bias + pace_bias
    return weights, bias


def train(rows: DataFrame, rounds: int = 400, rate: float = 4.0, decay: float = 1e-5) -> tuple[list[float], float]:
    """Weights and bias from rows (url, label); at most TRAIN_ROWS rows are accepted."""
    found, owner, labels, _ = _rows(rows)
    weights, bias = _fit(found, owner, labels, rounds, rate, decay)
    return weights.tolist(), float(bias)


def accuracy(rows: DataFrame, rounds: int = 400, rate: float = 4.0, decay: float = 1e-5) -> float:
    """Share of right verdicts on held-out hosts by a model of the others."""
    found, owner, labels, held = _rows(rows)
    taught = np.flatnonzero(~held)
    place = np.full(len(labels), -1)
    place[taught] = np.arange(len(taught))
    own = place[owner] >= 0
    model = _fit(found[own], place[owner[own]], labels[taught], rounds, rate, decay)
    right = (_scores(found, owner, len(labels), *model) >= 0) == (labels > 0)
    return float(right[held].mean())


def probability(host_: Column, path_: Column, model: tuple[list[float], float]) -> Column:
    """The model's probability that a url is wanted."""
    weights, bias = model
    table = F.from_json(F.lit("[" + ",".join(repr(w) for w in weights) + "]"), "array<double>")
    found = features(host_, path_)
    total = F.aggregate(F.transform(found, lambda i: F.get(table, i)), F.lit(0.0), lambda a, x: a + x)
    return 1 / (1 + F.exp(-(F.lit(bias) + total / F.sqrt(F.size(found)))))


def fitting_rule(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    by_length = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:]))
    fits = [(F.endswith(F.concat(F.lit("."), host_), F.lit(f".{h}")) & F.startswith(path_, F.lit(p)), h + p, v) for v, h, p in by_length]
    pick = lambda at: reduce(lambda acc, x: acc.when(x[0], F.lit(x[at])), fits[1:], F.when(fits[0][0], F.lit(fits[0][at])))
    return pick(1), pick(2)


def judge(pages: DataFrame, training: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's probability for every url."""
    model = train(training if training is not None else labelled(pages.sparkSession))
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("allow_probability", probability(F.col("host"), F.col("path"), model))
    by_model = F.when(F.col("allow_probability") >= 0.5, F.lit("allow")).otherwise(F.lit("block"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "allow_probability")
