"""Likeness of two texts: the standard library's SequenceMatcher ratio, and bounds that need no matching.

The ratio is twice the matched characters over all characters, where matching takes the
longest common run of what is left, again and again.  In a second text of 200 characters
or more, a character that makes up more than a hundredth of it starts no run (it only
lengthens one); so in prose few places start runs, and only those are visited here.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text

# From what length a frequent character starts no run, and the threshold of agreement.
LONG, AGREED = 200, 0.90


def _starters(b: str) -> dict[str, list[int]]:
    """Places of the characters that may start a run."""
    places: dict[str, list[int]] = defaultdict(list)
    most = len(b) // 100 + 1 if len(b) >= LONG else len(b)
    frequent = {c for c, n in Counter(b).items() if n > most}
    for j, c in enumerate(b):
        if c not in frequent:
            places[c].append(j)
    return dict(places)


class _Matcher:
    def __init__(self, a: str, b: str):
        self.a, self.b, self.starters = a, b, _starters(b)
        self.rare = [*compress(range(len(a)), map(self.starters.__contains__, a))]

    def longest(self, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
        """The first longest run that starters make within both ranges, lengthened by what is equal around it."""
        a, b, starters = self.a, self.b, self.starters
        i0, j0, size = a0, b0, 0
        ending: dict[int, int] = {}  # for places of b: how long the run is that ends there and at the last place of a
        last = -2
        for i in self.rare[bisect_left(self.rare, a0) : bisect_left(self.rare, a1)]:
            now: dict[int, int] = {}
            places = starters[a[i]]
            before = ending if i == last + 1 else {}
            for j in places if b0 <= places[0] and places[-1] < b1 else places[bisect_left(places, b0) : bisect_left(places, b1)]:
                k = now[j] = before.get(j - 1, 0) + 1
                if k > size:
                    i0, j0, size = i - k + 1, j - k + 1, k
            ending, last = now, i
        while i0 > a0 and j0 > b0 and a[i0 - 1] == b[j0 - 1]:
            i0, j0, size = i0 - 1, j0 - 1, size + 1
        while i0 + size < a1 and j0 + size < b1 and a[i0 + size] == b[j0 + size]:
            size += 1
        return i0, j0, size

    def total(self) -> int:
        """Characters matched."""
        found, todo = 0, [(0, len(self.a), 0, len(self.b))]
        while todo:
            a0, a1, b0, b1 = todo.pop()
            i, j, size = self.longest(a0, a1, b0, b1)
            if size:
                found += size
                if a0 < i and b0 < j:
                    todo.append((a0, i, b0, j))
                if i + size < a1 and j + size < b1:
                    todo.append((i + size, a1, j + size, b1))
        return found


#: From how many pairs of equal starters two texts are matched by arrays, and up to how many (8 bytes each, some arrays of them).
ARRAYS = 500, 2_000_000


def _pairs(a: str, b: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of the places of a: where equal starters begin in ``places`` of b, and how many; all of them."""
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in (a, b))
    places = np.argsort(y, kind="stable")
    letters = y[places]
    if len(b) >= LONG:
        first = np.searchsorted(letters, letters, "left")
        many = np.searchsorted(letters, letters, "right") - first
        rare = many <= len(b) // 100 + 1
        places, letters = places[rare], letters[rare]
    begin = np.searchsorted(letters, x, "left")
    count = np.searchsorted(letters, x, "right") - begin
    return places, begin, count, int(count.sum())


def _runs(places: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest runs of equal starters along both texts, ordered by place: begin in a, in b, length."""
    at = np.arange(count.sum())
    at -= np.repeat(np.cumsum(count) - count - begin, count)
    key, i = places[at], np.repeat(np.arange(len(begin)), count)
    del at
    width = len(begin) + 1
    key -= i
    key += width
    key *= width
    key += i
    del i
    key.sort()
    heads = np.flatnonzero(np.diff(key, prepend=-2) != 1)
    size = np.diff(heads, append=len(key)).astype(np.int32)
    diagonal, i = (x.astype(np.int32) for x in np.divmod(key[heads], width))
    order = np.argsort(i, kind="stable")  # by i, then by diagonal, which is by j
    i, size = i[order], size[order]
    return i, i + (diagonal[order] - width), size


def _within(a0: int, a1: int, b0: int, b1: int, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> tuple:
    """A range with the runs that reach into it, cut to it."""
    skip = np.maximum(np.maximum(a0 - i, b0 - j), 0)
    left = np.minimum(np.minimum(size, a1 - i), b1 - j) - skip
    inside = np.flatnonzero(left > 0)
    skip = skip[inside]
    return a0, a1, b0, b1, i[inside] + skip, j[inside] + skip, left[inside]


def _total(a: str, b: str, runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> int:
    """As _Matcher.total: each range has the runs that reach into it, cut to it.

    No run is longer than the one taken, so none reaches into the ranges on both sides of
    it: ranges that wait have their own runs only, however many wait.
    """
    found, todo = 0, [(0, len(a), 0, len(b), *runs)]
    del runs
    while todo:
        a0, a1, b0, b1, i, j, size = todo.pop()
        i0, j0, n = a0, b0, 0
        if len(size):
            n = int(size.max())
            best = np.flatnonzero(size == n)  # often very many
            at = i[best]
            best = best[at == at.min()]
            k = best[j[best].argmin()]
            i0, j0 = int(i[k]), int(j[k])
        while i0 > a0 and j0 > b0 and a[i0 - 1] == b[j0 - 1]:
            i0, j0, n = i0 - 1, j0 - 1, n + 1
        while i0 + n < a1 and j0 + n < b1 and a[i0 + n] == b[j0 + n]:
            n += 1
        if n:
            found += n
            if a0 < i0 and b0 < j0:
                todo.append(_within(a0, i0, b0, j0, i, j, size))
            if i0 + n < a1 and j0 + n < b1:
                todo.append(_within(i0 + n, a1, j0 + n, b1, i, j, size))
    return found


def matched(a: str, b: str) -> int:
    """Characters matched: by arrays where there is much to compare and it fits, else place by place."""
    if len(a) + len(b) < LONG:
        return _Matcher(a, b).total()
    places, begin, count, pairs = _pairs(a, b)
    return _total(a, b, _runs(places, begin, count)) if ARRAYS[0] <= pairs <= ARRAYS[1] else _Matcher(a, b).total()


def ratio(a: str, b: str) -> float:
    """SequenceMatcher(None, a, b).ratio(); two empty texts are alike."""
    return 2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.arrow_udf(T.DoubleType())
def _ratio(left: pa.Array, right: pa.Array) -> pa.Array:
    """Texts are read a pair at a time, so that a batch is held once."""
    pairs = ((a.as_py(), b.as_py()) for a, b in zip(left, right, strict=True))
    return pa.array([None if a is None or b is None else ratio(a, b) for a, b in pairs], pa.float64())


def _plain(col: Column) -> Column:
    return F.coalesce(text.comparison_text(col), F.lit(""))


def text_similarity(a: Column | str, b: Column | str) -> Column:
    """The ratio of two columns' comparison texts, in that order; two empty ones are alike."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return _ratio(_plain(a), _plain(b))


_CLASSES = "etaoinshrdlucmfwygpbvkxqjz 0123456789"


def letter_bound(a: Column, b: Column) -> Column:
    """No ratio of two texts is above this: the characters that both have, by class, could all match."""
    size = F.char_length(a) + F.char_length(b)
    count = lambda x, c: F.char_length(x) - F.char_length(F.replace(x, F.lit(c), F.lit("")))
    both = [F.least(count(a, c), count(b, c)) for c in _CLASSES]
    other = lambda x: F.char_length(F.translate(x, _CLASSES, ""))
    return F.when(size == 0, 1.0).otherwise(2.0 * (sum(both) + F.least(other(a), other(b))) / size)


def length_bound(a: Column, b: Column) -> Column:
    """As letter_bound, from the lengths alone."""
    size = F.char_length(a) + F.char_length(b)
    return F.when(size == 0, 1.0).otherwise(2.0 * F.least(F.char_length(a), F.char_length(b)) / size)


def decisions(df, left: str, right: str, threshold: float = AGREED):
    """Adds ``agreed`` (whether the ratio reaches the threshold) and ``decided_by``: equal, length, letters or matching.

    Bounds are columns; only pairs that they leave open are matched, in Python.
    """
    a, b = F.col("_a"), F.col("_b")
    rows = df.withColumns({"_a": _plain(F.col(left)), "_b": _plain(F.col(right))})
    by = F.when((a == b) & (F.char_length(b) < LONG), "equal").when(length_bound(a, b) < threshold, "length").when(letter_bound(a, b) < threshold, "letters").otherwise("matching")
    rows = rows.withColumn("decided_by", by)
    asked = F.col("decided_by") == "matching"
    matched = _ratio(F.when(asked, a), F.when(asked, b)) >= threshold
    return rows.withColumn("agreed", F.when(asked, matched).otherwise(F.col("decided_by") == "equal")).drop("_a", "_b")
