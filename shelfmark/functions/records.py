"""JSON texts, identities and hashes of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import casefold, comparison_text, let


def _ordered(col: Column, kind: T.DataType) -> Column:
    """A value whose maps and struct fields, at any depth, are in order of key."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(col.isNotNull(), F.struct(*[_ordered(col[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.transform(F.array_sort(F.map_keys(col)), lambda k: F.struct(k.alias("key"), _ordered(F.element_at(col, k), kind.valueType).alias("value"))))
    return col


def sorted_map(col: Column) -> Column:
    """A map with its entries in order of key: equal maps give equal JSON."""
    return F.map_from_entries(F.array_sort(F.map_entries(col)))


def canonical_json(df: DataFrame, *fields: str) -> Column:
    """JSON of the named columns of df: keys in alphabetical order at every depth, nulls kept."""
    return F.to_json(F.struct(*[_ordered(F.col(f), df.schema[f].dataType).alias(f) for f in sorted(fields)]), {"ignoreNullFields": "false"})


def stable_hash(df: DataFrame, *fields: str) -> Column:
    return F.sha2(canonical_json(df, *fields), 256)


def variant_identity(sku: Column, item: Column, code: Column, options: Column) -> Column:
    """sku:<sku>, else a hash of item number, code and options, else default; all case-folded."""
    low = F.map_from_entries(F.array_sort(F.transform(F.map_entries(F.coalesce(options, F.create_map().cast("map<string,string>"))), lambda e: F.struct(casefold(e["key"]), casefold(e["value"])))))
    body = F.to_json(F.struct(casefold(item).alias("item_number"), low.alias("option_values"), casefold(code).alias("product_code")), {"ignoreNullFields": "false"})
    empty = item.isNull() & code.isNull() & (F.coalesce(F.size(options), F.lit(0)) <= 0)
    return F.when(F.coalesce(sku, F.lit("")) != "", F.concat(F.lit("sku:"), casefold(sku))).when(empty, "default").otherwise(F.concat(F.lit("fallback:"), F.sha2(body, 256)))


#: Fields that a content hash leaves out: what a run stamps on a record.
UNHASHED = ("content_hash", "scraped_at")


def content_hash(df: DataFrame, variants: str = "variants") -> Column:
    """A hash of the whole record that the order of variants and map entries doesn't change.

    All columns count but UNHASHED; variants are sorted by their identifying fields, then
    by everything else that they hold.
    """
    kind = df.schema[variants].dataType.elementType
    first = [n for n in ("sku", "item_number", "product_code") if n in kind.names]

    def keyed(v: Column) -> Column:
        body = F.to_json(_ordered(v, kind), {"ignoreNullFields": "false"})
        return F.struct(*[F.coalesce(v[n].cast("string"), F.lit("")).alias(n) for n in first], body.alias("body"))

    bodies = F.transform(F.array_sort(F.transform(F.col(variants), keyed)), lambda x: x["body"])
    product = canonical_json(df, *[c for c in df.columns if c not in (*UNHASHED, variants)])
    return F.sha2(F.concat(F.lit('{"product":'), product, F.lit(',"variants":['), F.array_join(bodies, ","), F.lit("]}")), 256)


def cache_key(method: Column, url: Column, headers: Column, body: Column) -> Column:
    """sha256 over method, url, headers in order of case-folded name, and body; JSON bodies in canonical form."""
    named = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(casefold(e["key"]).alias("name"), e["value"].alias("value"))))
    parsed = F.try_parse_json(body)
    plain = F.when(parsed.isNotNull() & F.rlike(body, F.lit(r"^\s*[{\[]")), F.to_json(parsed)).otherwise(body)  # a variant's keys are in order
    return F.sha2(F.to_json(F.struct(F.upper(method).alias("method"), url.alias("url"), named.alias("headers"), plain.alias("body")), {"ignoreNullFields": "false"}), 256)


def map_agreement(a: Column, b: Column) -> Column:
    """Share of the keys of two maps with equal values; 1 where there is no key."""
    none = F.create_map().cast("map<string,string>")
    zipped = F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda _, x, y: x.eqNullSafe(y))
    return let(F.map_values(zipped), lambda same: F.when(F.size(same) == 0, 1.0).otherwise(F.size(F.filter(same, lambda x: x)) / F.size(same)))


def option_agreement(a: Column, b: Column) -> Column:
    """As map_agreement, of values as comparison texts."""
    fold = lambda m: F.transform_values(m, lambda _, v: comparison_text(v, entities=False))
    return map_agreement(fold(a), fold(b))


def utc_text(col: Column) -> Column:
    """A timestamp as ISO 8601 text in UTC, with microseconds where it has some; one without a zone is in the session's."""
    col = col.cast("timestamp")
    micros = F.unix_micros(col)
    whole = F.date_format(F.to_utc_timestamp(col, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.pmod(micros, F.lit(1_000_000))
    return F.concat(whole, F.when(part > 0, F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))).otherwise(F.lit("")), F.lit("+00:00"))
