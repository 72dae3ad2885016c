"""Text columns: white space, markup, labels, similarity."""

from __future__ import annotations

import html
from collections.abc import Callable
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG = r"<\s*/?\s*[a-zA-Z][^>]*>"


@F.pandas_udf(T.StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def let(col: Column, make: Callable[[Column], Column]) -> Column:
    """make(col), where col is worked out once however often ``make`` uses it."""
    return F.get(F.transform(F.array(col), make), 0)


def squeeze(col: Column) -> Column:
    """One space for each run of Unicode white space, none at the ends, blank to null."""
    return let(F.trim(F.regexp_replace(col, r"(?U)\s+", " ")), lambda x: F.nullif(x, F.lit("")))


def normalize_text(col: Column, entities: bool = True) -> Column:
    """Decode entities, then squeeze.  Only texts with an ampersand are sent to Python."""
    return squeeze(F.coalesce(_unescape(F.when(F.contains(col, F.lit("&")), col)), col) if entities else col)


class _TextOnly(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.parts.append(data.strip())


def strip_markup(value: str) -> str:
    parser = _TextOnly()
    parser.feed(value)
    parser.close()
    return " ".join(parser.parts)


@F.pandas_udf(T.StringType())
def _strip(values: pd.Series) -> pd.Series:
    return values.map(strip_markup, na_action="ignore")


def clean_text(col: Column) -> Column:
    """Normalized text without tags where it has both angle brackets."""
    return without_tags(normalize_text(col))


def without_tags(text: Column) -> Column:
    """clean_text of a normalized text.  Only texts with both angle brackets are sent to Python."""
    tagged = F.contains(text, F.lit("<")) & F.contains(text, F.lit(">"))
    return normalize_text(F.when(tagged, _strip(F.when(tagged, text))).otherwise(text))


def plain_text(col: Column) -> Column:
    """As clean_text, but only real tags count."""
    return F.when(F.rlike(col, F.lit(_TAG)), squeeze(_strip(col))).otherwise(col)


def has_markup(col: Column) -> Column:
    return F.coalesce(F.rlike(col, F.lit(_TAG)), F.lit(False))


#: Stands for the dotless i while a text is in capitals: no character.
_NO_CHARACTER = "\ufffe"


@lru_cache(1)
def _folds() -> tuple[str, str]:
    """Where folding isn't the small letters of the capitals of the small letters: what those give, and what folding gives."""
    small = {c.lower().upper().lower(): c.casefold() for c in map(chr, range(0x110000)) if c != "ı" and c.lower().upper().lower() != c.casefold()}
    return "ς" + "".join(small), "σ" + "".join(small.values())


def casefold(col: Column) -> Column:
    """Full case folding in the JVM: small letters, of capitals, of small letters; a few letters besides.

    A text of as many bytes as characters is ASCII and has nothing more to fold than its
    capitals.  Letters that only the JVM's Unicode version knows fold as it says.
    """
    capitals = lambda low: F.translate(F.upper(F.translate(low, "ı", _NO_CHARACTER)), _NO_CHARACTER, "ı")
    full = lambda low: F.translate(F.lower(capitals(low)), *_folds())
    return let(F.lower(col), lambda low: F.when(F.octet_length(low) == F.char_length(low), low).otherwise(full(low)))


def comparison_text(col: Column, entities: bool = True) -> Column:
    """Normalized and case-folded; without ``entities`` all of it stays in the JVM."""
    return casefold(normalize_text(col, entities))


def comparison_label(col: Column, entities: bool = True) -> Column:
    return label_of(comparison_text(col, entities))


def label_of(folded: Column) -> Column:
    """Letters and digits of a comparison text."""
    return let(F.regexp_replace(folded, r"[^\p{L}\p{N}]", ""), lambda x: F.nullif(x, F.lit("")))


def availability_label(col: Column) -> Column:
    """The last path segment of an availability value, in words."""
    return availability_words(normalize_text(col))


def availability_words(text: Column) -> Column:
    """As availability_label, of a text without entities."""
    last = F.regexp_replace(F.regexp_extract(squeeze(text), r"([^/]*)$", 1), "[_-]", " ")
    return squeeze(F.regexp_replace(last, "(?<=[a-z])(?=[A-Z])", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 1 where both arrays are empty."""
    sizes = F.struct(F.size(F.array_union(a, b)).alias("all"), F.size(F.array_intersect(a, b)).alias("both"))
    return let(sizes, lambda n: F.when(n["all"] == 0, 1.0).otherwise(n["both"] / n["all"]))


def percentage(col: Column) -> Column:
    """A share as a label: 100% rather than 100.0%."""
    return F.regexp_replace(F.format_string("%.1f%%", col * 100), r"\.0%$", "%")


def escape_html(col: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        col = F.replace(col, F.lit(raw), F.lit(safe))
    return col
