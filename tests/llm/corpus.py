"""A small corpus with the awkward cases, and brute-force versions of the operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _prose(rng: random.Random, n: int, lang: str) -> list[str]:
    stems = {"en": ["the", "th", "ing", "and", "of", "er", "wh"], "fr": ["le", "é", "aux", "qu", "ou", "è"], "de": ["der", "sch", "ung", "ü", "ein", "ß"]}[lang]
    return ["".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def documents(n: int = 120, seed: int = 5) -> list[tuple]:
    """Prose, exact and near copies, shared passages, nulls, empty, short and very long texts."""
    rng, rows = random.Random(seed), []
    passage = _prose(rng, 30, "en")
    for i in range(n):
        lang = rng.choice(["en", "en", "fr", "de"])
        w = _prose(rng, rng.choice([1, 2, 4, 12, 13, 40, 150, 400]), lang)
        if rng.random() < 0.3:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 8) : rng.randint(18, 30)]
        rows.append((i, " ".join(w), lang if i % 11 else None, rng.choice(["a", "b", "b", "c", None]), None))
    base = _prose(rng, 200, "en")
    for i in range(n, n + 40):  # one large group of near copies
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
        rows.append((i, " ".join(w), "en", "a", None))
    same = " ".join(_prose(rng, 60, "fr"))
    rows += [(i, same, "fr", "a", None) for i in range(n + 40, n + 60)]
    rows += [
        (n + 60, None, "en", "a", None), (n + 61, "", None, "b", 0), (n + 62, " \n\t ", "en", None, 3), (n + 63, "12 34 !!", "en", "c", None),
        (n + 64, "Word", "en", "c", 4), (n + 65, "WORD\x0bword\x1fx", "en", "c", None), (n + 66, "straße 你好 😀 naïve" * 3, "de", "c", None),
        (n + 67, "x" * 70_000 + " tail", "en", "c", None), (n + 68, " ".join(_prose(rng, 6000, "de")), "de", "b", None),
        (n + 69, "repeated row", "en", "a", None), (n + 69, "repeated row", "en", "a", None), (None, "no id here at all", "en", "a", None), (None, None, None, None, None),
    ]
    return rows


def frame(spark, rows=None, partitions: int = 5):
    """The corpus with extra columns whose names the operators might use themselves."""
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(partitions)
    return df


def words(text, lower: bool = False) -> list[bytes]:
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def shingle_sets(rows, k: int) -> dict:
    out = {}
    for doc_id, text, *_ in rows:
        w = words(text, lower=True)
        out[doc_id] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def near_components(rows, k: int, percent: int) -> dict:
    sets = shingle_sets([r for r in rows if r[0] is not None], k)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def without_repeats(rows, window: int) -> dict:
    rows = [(i, words(t)) for i, t, *_ in rows if i is not None]
    first: dict = {}
    for i, w in rows:
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in rows:
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone |= set(range(j, j + window))
        out[i] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone))
    return out
