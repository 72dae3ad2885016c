"""Prices, currencies and pack sizes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, normalize_text, squeeze

# Fixed value: the form of an amount.
PRICE = r"(?<!\w)[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"

# Spellings of pack units.
PACK_UNITS = {
    "bx": "box", "box": "box", "boxes": "box", "cs": "case", "case": "case", "cases": "case",
    "ct": "count", "count": "count", "ea": "each", "each": "each",
    "pc": "piece", "pcs": "piece", "piece": "piece", "pieces": "piece",
    "pk": "pack", "pkg": "pack", "pack": "pack", "packs": "pack",
    "bag": "bag", "bags": "bag", "bottle": "bottle", "bottles": "bottle", "pair": "pair", "pairs": "pair",
    "kit": "kit", "kits": "kit", "set": "set", "sets": "set", "roll": "roll", "rolls": "roll",
    "pouch": "pouch", "pouches": "pouch", "tube": "tube", "tubes": "tube",
    "tray": "tray", "trays": "tray", "vial": "vial", "vials": "vial",
}


# The forms of a pack text, with the groups of its quantity and unit.
PACK_FORMS = ((r"(?i)^([a-z]+)\s+of\s+([\d,]+)$", 2, 1), (r"(?i)^([\d,]+)\s*(?:/|per)\s*([a-z]+)$", 1, 2), (r"(?i)^([\d,]+)\s+([a-z]+)$", 1, 2))

# The units that a pack inside a longer text may have; each may end in s.
PACK_INSIDE_UNITS = ("box", "bx", "case", "cs", "pack", "pk", "each", "ea", "count", "ct", "bag", "bottle", "pair", "kit", "set", "roll", "pouch", "tube", "tray", "vial")


def amount_text(text: Column) -> Column:
    """The first amount of a text without entities, as text with its scale; negative if marked so."""

    def made(text: Column, token: Column) -> Column:
        digits = F.replace(F.ltrim(token, F.lit("+-")), F.lit(","), F.lit(""))
        before = F.regexp_extract(text, rf"^(.*?){PRICE}", 1)
        marked = (F.startswith(text, F.lit("(")) & F.endswith(text, F.lit(")"))) | F.rlike(before, F.lit(r"-\s*[$€£¥]?\s*$"))
        minus = F.startswith(token, F.lit("-")) | (marked & F.rlike(digits, F.lit("[1-9]")))
        return F.when(token != "", F.concat(F.when(minus, F.lit("-")).otherwise(F.lit("")), digits))

    return let(squeeze(F.translate(text, "−", "-")), lambda x: let(F.regexp_extract(x, f"({PRICE})", 1), lambda token: made(x, token)))


def parse_price(col: Column) -> Column:
    """The first amount of a price text as DECIMAL(38,6), after its entities are decoded."""
    return amount_text(normalize_text(col)).try_cast("decimal(38,6)")


def pack_form(text: Column) -> Column:
    """quantity/unit of the usual pack texts without entities; other texts stay as they are."""
    units = F.create_map(*[F.lit(x) for x in chain.from_iterable(PACK_UNITS.items())])

    def form(text: Column, pattern: str, quantity: int, unit: int) -> Column:
        known = F.try_element_at(units, F.lower(F.regexp_extract(text, pattern, unit)))
        return F.concat(F.replace(F.regexp_extract(text, pattern, quantity), F.lit(","), F.lit("")), F.lit("/"), known)

    return let(squeeze(text), lambda x: F.coalesce(*[form(x, *f) for f in PACK_FORMS], x))


def pack_size(col: Column) -> Column:
    """quantity/unit of the usual pack texts, after their entities are decoded."""
    return pack_form(normalize_text(col))


def pack_inside(text: Column) -> Column:
    """The first pack text inside a longer one, null where there is none."""
    inside = rf"(?i)\b((?:[a-z]+\s+of\s+\d[\d,]*|\d[\d,]*\s*(?:/|per\s+)(?:{'|'.join(PACK_INSIDE_UNITS)})s?)\b)"
    return F.nullif(F.regexp_extract(text, inside, 1), F.lit(""))


def currency(col: Column, strict: bool = False) -> Column:
    """Three upper-case letters; other texts are null, or with ``strict`` an error."""
    code = F.upper(squeeze(col))
    wrong = F.raise_error(F.concat(F.lit("not a currency code: "), code)) if strict else F.lit(None)
    return F.when(code.isNull() | F.rlike(code, F.lit("^[A-Z]{3}$")), code).otherwise(wrong.cast("string"))


def price_agreement(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """1 where both prices are missing or within the tolerance, else 0."""
    near = F.abs(a - b) <= F.lit(tolerance).cast("decimal(38,6)")
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).when(near, 1.0).otherwise(0.0)


def visibility(price: Column, page: Column) -> Column:
    """public with a price; login_required where the page says so; else not_present."""
    low = F.lower(page)
    asks = F.contains(low, F.lit("login to see price")) | F.contains(low, F.lit("sign in to see price"))
    return F.when(price.isNotNull(), "public").when(asks, "login_required").otherwise("not_present")


def jitter(key: Column, most: float) -> Column:
    """A share of ``most`` seconds that the key decides, so that many callers don't wait alike."""
    return F.lit(most) * (F.pmod(F.xxhash64(key), F.lit(1_000_000)) / 1_000_000)


def retry_delay(attempt: Column, retry_after: Column, base: float = 1.0, most: float = 60.0, extra: Column | None = None) -> Column:
    """Seconds to wait: exponential with ``extra`` (jitter) added, or what the server asks for (seconds or an HTTP date) up to ``most``."""
    until = F.try_to_timestamp(F.regexp_replace(retry_after, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.coalesce(retry_after.try_cast("double"), (F.unix_timestamp(until) - F.unix_timestamp(F.current_timestamp())).cast("double"))
    asked = F.least(F.lit(most), F.greatest(F.lit(0.0), seconds))
    own = F.lit(base) * F.pow(F.lit(2.0), attempt - 1) + (extra if extra is not None else F.lit(0.0))
    return F.greatest(own, F.coalesce(asked, F.lit(0.0)))
