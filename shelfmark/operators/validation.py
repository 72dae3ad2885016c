"""Validation of extracted records: sanitized, checked, de-duplicated, hashed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records, text

SKU = r"^[A-Za-z0-9][A-Za-z0-9._/\-]{0,127}$"
#: Markup inside identifiers, in the JVM.
_TAG = r"<\s*/?\s*[a-zA-Z][^>]*>"


def failures(checks: list[tuple[Column, str]]) -> Column:
    """Messages of the checks that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in checks]))


# What the visibility of a price may be.
VISIBILITIES = ("public", "login_required", "not_present", "unknown")


def contract(df: DataFrame) -> Column:
    """What of a record breaks its contract: product url, name, price visibility, and of each
    variant its parent, price and currency, as far as the table has those columns."""
    kind = df.schema["variants"].dataType.elementType
    unknown = lambda c: ~F.coalesce(c, F.lit("unknown")).isin(*VISIBILITIES)
    there = set(df.columns)
    checks = []
    if "product_url" in there:
        checks.append((~F.coalesce(F.rlike("product_url", F.lit("(?i)^https?://[^/?#]")), F.lit(False)), F.lit("product_url is no http(s) url")))
    if "name" in there:
        checks.append((F.trim(F.coalesce("name", F.lit(""))) == "", F.lit("name is required")))
    if "price_visibility" in there:
        checks.append((unknown(F.col("price_visibility")), F.concat(F.lit("price_visibility is unknown: "), F.col("price_visibility"))))
    of_record = F.array_compact(F.array(*[F.when(c, m) for c, m in checks], F.lit(None).cast("string")))

    def of_variant(v: Column, i: Column) -> Column:
        found = []
        if "product_url" in kind.names:
            found.append((~v["product_url"].eqNullSafe(F.col("product_url")), "product_url does not match product"))
        if "price" in kind.names:
            found.append((v["price"].cast("string").try_cast("decimal(38,6)") < 0, "price is negative"))
        if "currency" in kind.names:
            found.append((~F.rlike(F.upper(F.trim(v["currency"])), F.lit("^[A-Z]{3}$")), "currency is no code of three letters"))
        if "price_visibility" in kind.names:
            found.append((unknown(v["price_visibility"]), "price_visibility is unknown"))
        return F.array_compact(F.array(*[F.when(c, F.concat(F.lit("variant["), i, F.lit(f"] {m}"))) for c, m in found], F.lit(None).cast("string")))

    return F.concat(of_record, F.coalesce(F.flatten(F.transform("variants", of_variant)), F.array().cast("array<string>")))


def _identity(v: Column) -> Column:
    return records.variant_identity(v["sku"], v["item_number"], v["product_code"], v["options"])


def validate(extracted: DataFrame) -> DataFrame:
    """Adds valid, errors, warnings, duplicate_variants_removed and content_hash; variants are unique.

    Works inside each row's array: no shuffle.
    """
    rows = extracted.withColumn("description", text.plain_text(F.col("description")))
    rows = rows.withColumn("_ids", F.transform(F.coalesce("variants", F.array().cast(extracted.schema["variants"].dataType)), _identity))
    # The row's own ids are a column, so that each is worked out once.
    first = F.filter(F.sequence(F.lit(0), F.size("_ids") - 1), lambda i: F.array_position("_ids", F.get("_ids", i)) == i + 1)
    rows = rows.withColumn("_first", F.when(F.size("_ids") > 0, first).otherwise(F.array().cast("array<int>")))
    again = F.filter(F.sequence(F.lit(0), F.size("_ids") - 1), lambda i: F.array_position("_ids", F.get("_ids", i)) <= i)

    def note(i: Column) -> Column:
        kept = F.get("variants", (F.array_position("_ids", F.get("_ids", i)) - 1).cast("int"))
        same = F.to_json(kept) == F.to_json(F.get("variants", i))
        return F.concat(F.when(same, "duplicate").otherwise("conflicting duplicate"), F.lit(" variant removed: "), F.get("_ids", i))

    notes = F.when(F.size("_ids") > 0, F.transform(again, note)).otherwise(F.array().cast("array<string>"))
    checks = failures(
        [
            (F.col("error").isNotNull(), "page could not be read"),
            (F.rlike("name", F.lit(_TAG)), "product name contains markup"),
            (F.col("error").isNull() & (F.size("variants") == 0) & ~(F.col("variants_complete") & (F.col("variants_method") == "embedded_state_empty_grouped")), "at least one product variant is required"),
        ]
    )

    def variant_errors(v: Column, i: Column) -> Column:
        name = lambda what: F.concat(F.lit("variant["), i, F.lit(f"] {what}"))
        marked = [F.when(F.rlike(v[f], F.lit(_TAG)), name(f"{f} contains markup")) for f in ("sku", "item_number", "product_code")]
        return F.array_compact(F.array(*marked, F.when(v["sku"].isNotNull() & ~F.rlike(v["sku"], F.lit(SKU)), name("sku has an unreasonable format"))))

    inner = F.coalesce(F.flatten(F.transform("variants", variant_errors)), F.array().cast("array<string>"))
    broken = F.when(F.col("error").isNull(), contract(extracted)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("errors", F.concat(broken, checks, inner))
    rows = rows.withColumn("warnings", F.array_distinct(F.concat(F.coalesce("warnings", F.array().cast("array<string>")), notes)))
    rows = rows.withColumn("duplicate_variants_removed", F.size("_ids") - F.size("_first"))
    rows = rows.withColumn("variants", F.transform("_first", lambda i: F.get("variants", i)))
    stamped = rows.select("product_url", "name", "brand", "category_path", "description", "image_urls", "price_visibility", "provenance", "variants")
    rows = rows.withColumn("content_hash", F.when(F.col("error").isNull(), records.content_hash(stamped)))
    return rows.withColumn("valid", F.size("errors") == 0).drop("_ids", "_first")
