"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point.  A
trigram's vector is the product of its letters' vectors, the first permuted twice
and the second once (binding); a text's profile is the sum over its trigrams
(bundling), and a language's prototype the sum of its training texts' unit
profiles.  A text gets the language whose prototype has the largest cosine with
its profile.

Trigrams are bound for a piece of a batch at a time, BOUND of them at once, and
then forgotten: memory does not grow with the vocabulary.

Defined results: ``und`` with score 0 where the text is null or has no letter,
or nothing could be learned; ties go to the language that sorts first; whole
texts are read; other columns never enter a prediction; rows without a language
teach nothing; repeated rows are learned from and judged one by one; an empty
table gives no rows and no prototypes; columns of any name are carried, but
``predict`` refuses a table that has a column of a name it is to add.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, textkit

#: Length of the vectors; texts worked on together; trigrams bound at once.
DIMENSIONS, GROUP, BOUND = 512, 64, 8192
UNKNOWN = "und"

_SPACE = 32


def _folded() -> np.ndarray:
    """The lower-case letter of every code point that is a letter, else 0."""
    table = np.zeros(0x110000, np.int32)
    for code in range(0x110000):
        if (letter := chr(code)).isalpha():
            table[code] = ord(letter.lower()[0])
    return table


_TABLE: list[np.ndarray] = []


def _letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters of all texts, each text between zeros, and the text of each place."""
    if not _TABLE:
        _TABLE.append(_folded())
    joined = "\0".join(["", *[x or "" for x in texts], ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(x or "") + 1 for x in texts])
    owner = np.concatenate([[0], np.repeat(np.arange(len(texts)), lengths)])
    return _TABLE[0][points], owner


def vectors(letters: np.ndarray) -> np.ndarray:
    """The +1 and -1 of each code point."""
    words = DIMENSIONS // 64
    place = letters.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)
    bits = textkit.mix((place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(bits.astype("<u8").view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def bind(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Vectors of trigrams from those of their letters."""
    return np.roll(a, 2, axis=1) * np.roll(b, 1, axis=1) * c


def profiles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Unit profiles of the texts, and which have a letter."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    letter, owner = _letters(texts)
    is_letter = letter > 0
    lettered = np.bincount(owner[is_letter], minlength=len(texts)) > 0
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one space after each run of letters
    keep[0] = True
    kept, own = np.where(is_letter, letter, _SPACE)[keep], owner[keep]
    if len(kept) < 3:
        return out, lettered
    alphabet = np.flatnonzero(np.bincount(kept))
    n = len(alphabet)
    number = np.zeros(alphabet[-1] + 1, np.int64)
    number[alphabet] = np.arange(n)
    symbol = number[kept]
    middle = kept[1:-1] != _SPACE
    codes = ((symbol[:-2] * n + symbol[1:-1]) * n + symbol[2:])[middle]
    own = own[1:-1][middle]
    if n**3 <= 1 << 22:
        there = np.flatnonzero(np.bincount(codes, minlength=n**3))
        column = np.zeros(n**3, np.int32)
        column[there] = np.arange(len(there), dtype=np.int32)
        at = column[codes]
    else:
        there, at = np.unique(codes, return_inverse=True)
    each = vectors(alphabet)
    edges = np.searchsorted(own, np.arange(0, len(texts) + GROUP, GROUP))
    for low in range(0, len(there), BOUND):
        some = there[low : low + BOUND]
        bound = bind(each[some // (n * n)], each[some // n % n], each[some % n]).astype(np.float32)
        width = len(some)
        for g in range(len(edges) - 1):
            mine, cell = own[edges[g] : edges[g + 1]] - g * GROUP, at[edges[g] : edges[g + 1]] - low
            if len(there) > BOUND:
                inside = (cell >= 0) & (cell < width)
                mine, cell = mine[inside], cell[inside]
            rows = min(GROUP, len(texts) - g * GROUP)
            counts = np.bincount(mine * width + cell, minlength=rows * width).reshape(rows, width)
            out[g * GROUP : g * GROUP + rows] += counts.astype(np.float32) @ bound
    norm = np.sqrt((out.astype(np.float64) ** 2).sum(axis=1))
    return out / np.where(norm > 0, norm, 1)[:, None].astype(np.float32), lettered


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes by language.  Each task sends one vector per language, so what is
    gathered is bounded by the number of languages."""
    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in textkit.pieces(batches, limit=1 << 20):
            unit, lettered = profiles(part.column(1).to_pylist())
            names = part.column(0).to_pylist()
            for name in set(names):
                rows = [i for i, x in enumerate(names) if x == name and lettered[i]]
                sums[name] = sums.get(name, 0) + unit[rows].astype(np.float64).sum(axis=0)
        for name, vector in sums.items():
            # Whole numbers add up to the same sum in any order.
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS), pa.array(np.arange(DIMENSIONS), pa.int32()), pa.array(np.round(vector * 1e6).astype(np.int64))], names=["lang", "k", "v"])

    total = rows.mapInArrow(textkit.tidy(run), "lang string, k int, v long").groupBy("lang", "k").agg(F.sum("v").alias("v")).collect()
    out: dict[str, np.ndarray] = {}
    for r in total:
        out.setdefault(r.lang, np.zeros(DIMENSIONS))[r.k] = r.v / 1e6
    return {k: v / n for k, v in sorted(out.items()) if (n := float(np.sqrt((v**2).sum()))) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its cosine, cut to 0..1."""
    if taken := set(names) & set(docs.columns):
        raise ValueError(f"the table has columns {sorted(taken)}; name others for the prediction")
    schema = docs.select("*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1])).schema
    known = sorted(prototypes)
    matrix = np.array([prototypes[k] for k in known], dtype=np.float32) if known else np.zeros((0, DIMENSIONS), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textkit.pieces(batches, text, limit=1 << 20):
            unit, lettered = profiles(part.column(part.schema.get_field_index(text)).to_pylist())
            if known:
                cosine = (unit @ matrix.T).astype(np.float64)
                best = cosine.argmax(axis=1)
                found = [known[i] if ok else UNKNOWN for i, ok in zip(best, lettered, strict=True)]
                score = np.where(lettered, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
            else:
                found, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found), pa.array(score, pa.float64())], names=[*part.schema.names, *names])

    return docs.mapInArrow(textkit.tidy(run), schema)


def held_out(doc_id: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32(doc_id as text) leaves ``fold``; a null doc_id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held_out().alias("held_out"))
    prototypes = train(rows.filter(~F.col("held_out")))
    return predict(rows.select("doc_id", "held_out", "text"), prototypes).select("doc_id", "held_out", "lang_pred", "score")


#: A cosine that two random profiles reach about once in 30,000 draws; a text of so many
#: characters that stays below it is in none of the languages.
CHANCE, LONG = 4 / DIMENSIONS**0.5, 200


def keep_known(docs: DataFrame, learn_from: Callable[[DataFrame], DataFrame] = lambda d: d, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents in one of the languages, with that language as their ``lang``.

    Rejected are texts without a letter, and long texts whose profile is no nearer to
    any language than chance.  A text too short to tell keeps the language it came
    with, or gets the nearest one.  Where no row has a language nothing can be learned:
    then only texts without a letter are rejected.
    """
    prototypes = train(learn_from(docs), text, lang)
    if not prototypes:
        return docs.filter(F.coalesce(F.rlike(F.col(text), F.lit(r"\p{L}")), F.lit(False)))
    found, score = store.free(docs, "found_lang", "found_score")
    told = F.col(score) >= CHANCE
    scored = predict(docs, prototypes, text, names=(found, score)).filter((F.col(found) != UNKNOWN) & (told | (F.char_length(text) < LONG)))
    label = F.when(told, F.col(found)).otherwise(F.coalesce(F.col(lang).cast("string"), F.col(found))).cast(docs.schema[lang].dataType)
    return scored.withColumn(lang, label).select(*docs.columns)
