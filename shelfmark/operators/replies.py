"""A second extractor's replies to records.

A reply is a text that should hold one JSON object, bare or in a code fence.  It is read
twice in the JVM: as a VARIANT, whose types and members are held against the declared
record, and by a permissive reader with that record as schema, which gives the values.  A
reply that breaks the record is failed evidence with all its reasons; of one that keeps
it, every field that has a value is stamped as the second extractor's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCE = "llm_shadow"
# The fields of a record and what each may be.
PRODUCT = {"name": "text", "brand": "text", "category_path": "texts", "product_url": "text", "description": "text", "specifications": "map", "image_urls": "texts", "alternative_product_urls": "texts", "price_visibility": "visibility"}
VARIANT = {"product_url": "text", "sku": "text", "item_number": "text", "product_code": "text", "option_values": "map", "image_urls": "texts", "price": "amount", "currency": "text", "price_visibility": "visibility", "unit_pack_size": "text", "availability": "text"}
RESULT = {"product": "object", "variants": "objects", "variants_complete": "flag", "warnings": "texts"}
VISIBILITIES = ("public", "login_required", "not_present", "unknown")
_TYPES = {"text": "string", "visibility": "string", "amount": "string", "texts": "array<string>", "map": "map<string,string>", "flag": "boolean"}

_struct = lambda fields: ", ".join(f"{k}: {_TYPES[v]}" for k, v in fields.items())
SCHEMA = f"product struct<{_struct(PRODUCT)}>, variants array<struct<{_struct(VARIANT)}>>, variants_complete boolean, warnings array<string>, _corrupt string"


def body(reply: Column) -> Column:
    """What a reply holds: itself, or what stands in its code fence."""
    return F.regexp_replace(F.trim(reply), r"(?s)^```[A-Za-z]*\s*(.*?)\s*```$", "$1")


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _each(value: Column, kind: str) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", kind), F.array().cast("array<variant>") if kind.startswith("array") else F.create_map().cast("map<string,variant>"))


_FITS: dict[str, Callable[[Column], Column]] = {
    "text": lambda v: _kind(v) == "STRING",
    "visibility": lambda v: F.coalesce(F.try_variant_get(v, "$", "string").isin(*VISIBILITIES), F.lit(False)),
    "amount": lambda v: F.rlike(_kind(v), F.lit("^(STRING|BIGINT|DOUBLE|DECIMAL)")),
    "texts": lambda v: F.startswith(_kind(v), F.lit("ARRAY")) & F.forall(_each(v, "array<variant>"), lambda x: _kind(x) == "STRING"),
    "map": lambda v: F.startswith(_kind(v), F.lit("OBJECT")) & F.forall(F.map_values(_each(v, "map<string,variant>")), lambda x: _kind(x) == "STRING"),
    "flag": lambda v: _kind(v) == "BOOLEAN",
    "object": lambda v: F.startswith(_kind(v), F.lit("OBJECT")),
    "objects": lambda v: F.startswith(_kind(v), F.lit("ARRAY")) & F.forall(_each(v, "array<variant>"), lambda x: F.startswith(_kind(x), F.lit("OBJECT"))),
}


def _faults(value: Column, fields: dict[str, str], at: Column, needed: tuple[str, ...] = ()) -> Column:
    """What is wrong with an object's members: their types, those it lacks, those it may not have."""
    member = lambda name: F.try_variant_get(value, f"$.{name}", "variant")
    absent = lambda name: _kind(member(name)) == "VOID"
    wrong = [F.when(~absent(k) & ~_FITS[kind](member(k)), F.concat(at, F.lit(f"{k} is no {kind}"))) for k, kind in fields.items()]
    lacking = [F.when(absent(k), F.concat(at, F.lit(f"{k} is missing"))) for k in needed]
    other = F.filter(F.map_keys(_each(value, "map<string,variant>")), lambda k: ~k.isin(*fields))
    return F.concat(F.array_compact(F.array(*wrong, *lacking)), F.transform(F.array_sort(other), lambda k: F.concat(at, k, F.lit(" is not a field"))))


def _stamped(record: Column, fields: dict[str, str]) -> Column:
    """A map of the fields that have a value to their source."""
    filled = [F.when((F.size(record[k]) > 0) if kind in ("texts", "map") else (record[k].isNotNull() & (record[k] != "")), F.lit(k)) for k, kind in fields.items()]
    return F.map_from_entries(F.transform(F.array_compact(F.array(*filled)), lambda k: F.struct(k, F.lit(SOURCE))))


def records(replies: DataFrame) -> DataFrame:
    """(url, status, reason, product, variants, variants_complete, warnings) of replies (url, reply).

    product and each of variants have ``field_provenance``; all three are null in failed evidence.
    """
    rows = replies.select("url", body(F.col("reply")).alias("_body")).withColumn("_value", F.try_parse_json("_body"))
    value = F.col("_value")
    product = F.try_variant_get(value, "$.product", "variant")
    listed = _each(F.try_variant_get(value, "$.variants", "variant"), "array<variant>")
    inner = F.flatten(F.transform(listed, lambda v, i: _faults(v, VARIANT, F.concat(F.lit("variants["), i.cast("string"), F.lit("].")))))
    top = _faults(value, RESULT, F.lit(""), ("product",))
    faults = F.when(value.isNull(), F.array(F.lit("no JSON"))).when(~_FITS["object"](value), F.array(F.lit("no JSON object"))).otherwise(
        F.concat(top, F.when(_FITS["object"](product), _faults(product, PRODUCT, F.lit("product."), ("name", "product_url"))).otherwise(F.array().cast("array<string>")), F.coalesce(inner, F.array().cast("array<string>")))
    )
    read = rows.withColumn("_faults", faults).withColumn("_read", F.from_json("_body", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    reasons = F.concat("_faults", F.array_compact(F.array(F.when((F.size("_faults") == 0) & F.col("_read._corrupt").isNotNull(), F.lit("the record can't be read")))))
    read = read.withColumn("_faults", reasons)
    fine = F.size("_faults") == 0
    own = F.col("_read.product")
    whole = F.struct(*[own[k].alias(k) for k in PRODUCT], _stamped(own, PRODUCT).alias("field_provenance"))
    each = F.transform("_read.variants", lambda v: F.struct(*[v[k].alias(k) for k in VARIANT], _stamped(v, VARIANT).alias("field_provenance")))
    return read.select(
        "url", F.when(fine, "completed").otherwise("failed").alias("status"), F.when(~fine, F.array_join("_faults", "; ")).alias("reason"), F.when(fine, whole).alias("product"),
        F.when(fine, F.coalesce(each, F.array().cast(read.select(each.alias("v")).schema["v"].dataType))).alias("variants"), F.when(fine, F.coalesce("_read.variants_complete", F.lit(False))).alias("variants_complete"),
        F.when(fine, F.coalesce("_read.warnings", F.array().cast("array<string>"))).alias("warnings"),
    )
