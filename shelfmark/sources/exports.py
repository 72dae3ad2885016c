"""Exports and reports: nested JSON, flat CSV, run and agreement reports, a dashboard page.

Only small aggregates reach the driver.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the flat export.
CSV_COLUMNS = (
    "product_name", "brand", "category_path", "product_url", "sku", "item_number", "product_code", "variant_options_json", "price", "currency", "price_visibility", "unit_pack_size",
    "availability", "description", "specifications_json", "image_urls_json", "variant_image_urls_json", "alternative_products_json", "field_provenance_json", "scraped_at",
)


def _before(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as a comes before b; null comes first."""
    return F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).when(a > b, 1).otherwise(0)


def nested(products: DataFrame, variants: DataFrame, key: str = "product_url", order: str = "variant_key") -> DataFrame:
    """Products with their variants as an ordered array, empty for childless ones."""
    fields = [c for c in variants.columns if c != key]
    lists = variants.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("v"))), lambda a, b: _before(a["_o"], b["_o"])).alias("_v"))
    kind = lists.select(F.transform("_v", lambda x: x["v"]).alias("v")).schema["v"].dataType
    joined = products.join(lists, key, "left")
    return joined.withColumn("variants", F.coalesce(F.transform("_v", lambda x: x["v"]), F.array().cast(kind))).drop("_v")


def flat(products: DataFrame, variants: DataFrame) -> DataFrame:
    """One row per variant, one with blank identifiers for a childless product; all text.

    products: name, brand, category_path, product_url, description, image_urls,
    price_visibility, and optional specifications, alternative_product_urls,
    field_provenance, scraped_at.  variants: product_url and the variant fields.
    """
    p, v = products.alias("p"), variants.alias("v")
    p_has, v_has = set(products.columns), set(variants.columns)
    blank = F.lit("")
    text = lambda side, c: F.coalesce(F.col(f"{side}.{c}").cast("string"), blank) if c in (p_has if side == "p" else v_has) else blank
    js = lambda side, c, empty: F.coalesce(F.to_json(F.col(f"{side}.{c}")), F.lit(empty)) if c in (p_has if side == "p" else v_has) else F.lit(empty)
    provenance = F.concat(F.lit('{"product":'), js("p", "field_provenance", "{}"), F.lit(',"variant":'), js("v", "field_provenance", "{}"), F.lit("}"))
    values = {
        "product_name": text("p", "name"), "brand": text("p", "brand"), "category_path": F.coalesce(F.array_join("p.category_path", " > "), blank), "product_url": text("p", "product_url"),
        "sku": text("v", "sku"), "item_number": text("v", "item_number"), "product_code": text("v", "product_code"), "variant_options_json": js("v", "option_values", "{}"),
        "price": text("v", "price_text") if "price_text" in v_has else text("v", "price"), "currency": text("v", "currency"), "price_visibility": F.coalesce(F.col("v.price_visibility"), F.col("p.price_visibility"), blank),
        "unit_pack_size": text("v", "unit_pack_size"), "availability": text("v", "availability"), "description": text("p", "description"), "specifications_json": js("p", "specifications", "{}"),
        "image_urls_json": js("p", "image_urls", "[]"), "variant_image_urls_json": js("v", "image_urls", "[]"), "alternative_products_json": js("p", "alternative_product_urls", "[]"),
        "field_provenance_json": provenance, "scraped_at": text("p", "scraped_at"),
    }
    return p.join(v, F.col("p.product_url") == F.col("v.product_url"), "left").select(*[values[c].alias(c) for c in CSV_COLUMNS])


def write_json(products: DataFrame, variants: DataFrame, path: str, order: str = "variant_key") -> None:
    nested(products, variants, order=order).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(products: DataFrame, variants: DataFrame, path: str) -> None:
    flat(products, variants).write.mode("overwrite").option("header", "true").option("emptyValue", "").option("escape", "\"").csv(path)


def read_artifact(spark: SparkSession, path: str) -> dict | None:
    """A JSON object written before; None where it is absent, broken or no object."""
    try:
        rows = spark.read.text(path, wholetext=True).limit(1).collect()
        value = json.loads(rows[0].value) if rows else None
    except Exception as error:  # Spark's path and read errors share no class
        if "PATH_NOT_FOUND" not in str(error) and not isinstance(error, ValueError):
            raise
        return None
    return value if isinstance(value, dict) else None


def agreement_report(status: str, sample_size: int, overall: float | None, advisory: float | None, fields: dict[str, float], earlier: dict | None = None) -> dict:
    """This run's report; with no sample, an earlier populated one is preserved."""
    if not sample_size and earlier and earlier.get("sample_size"):
        return earlier | {"status": "preserved"}
    return {"status": status, "sample_size": sample_size, "overall_agreement": overall if sample_size else None, "advisory_agreement": advisory if sample_size else None, "field_agreement": fields}


def run_report(counters: dict, discovery: DataFrame, product_quality: DataFrame, variant_quality: DataFrame, provenance: DataFrame, audits: DataFrame | None = None) -> dict:
    """Status, counters, discovery, quality and audits (check, passed, detail) of a run; each table has a few rows."""
    shares = lambda df: {r["field"]: r["completeness"] for r in df.collect()}
    return {
        "status": counters.get("status"),
        "metrics": {k: v for k, v in counters.items() if k != "status"},
        "discovery": {r["category"]: {"count": r["discovered"], "status": r["status"]} for r in discovery.collect()},
        "audits": [{"check": r["check"], "passed": r["passed"], "detail": r["detail"]} for r in (audits.orderBy("check").collect() if audits is not None else [])],
        "quality": {"products": shares(product_quality), "variants": shares(variant_quality), "provenance": {r["source"]: r["n"] for r in provenance.orderBy("source").collect()}},
    }


def percentage(value: float | None) -> str:
    return "n/a" if value is None else f"{value * 100:.1f}%".replace(".0%", "%")


def provenance_stack(shares: DataFrame) -> str:
    """Sources (source, n, share) as one stacked bar with a legend; what is not available is a gap."""
    rows = shares.orderBy("source").collect()
    tones = iter(("#2b6cb0", "#38a169", "#b7791f", "#805ad5", "#c53030", "#2c7a7b", "#718096"))
    tone = {r["source"]: "#eee" if r["source"] == "not_available" else next(tones) for r in rows}
    bar = "".join(f"<div style='flex:{r['share']:.6f};background:{tone[r['source']]}' title='{html.escape(r['source'])}: {r['n']:,} fields ({percentage(r['share'])})'></div>" for r in rows)
    keys = "".join(f"<span><i style='background:{tone[r['source']]}'></i>{html.escape(r['source'])} <b>{percentage(r['share'])}</b></span> " for r in rows)
    return f"<section><h2>Field provenance</h2><div class='stack' style='display:flex;height:14px'>{bar}</div><p class='legend'>{keys}</p></section>"


def agreement_panel(report: dict, fields: DataFrame) -> str:
    """What two extractions agree on: both means, and the fields (field, tier, agreement, position) of each tier, best first."""
    if not report.get("sample_size"):
        return f"<section><h2>Agreement</h2><p>no sample: {html.escape(str(report.get('status') or 'not run'))}</p></section>"
    rows = fields.orderBy("tier", "position").collect()
    listed = lambda tier: "".join(f"<tr><td>{html.escape(r['field'])}</td><td>{percentage(r['agreement'])}<div class='bar' style='width:{r['agreement'] * 120:.0f}px'></div></td></tr>" for r in rows if r["tier"] == tier)
    head = f"<p>{report['sample_size']:,} products: core {percentage(report['overall_agreement'])}, advisory {percentage(report['advisory_agreement'])}</p>"
    return f"<section><h2>Agreement</h2>{head}<h3>Core</h3><table>{listed('core')}</table><h3>Advisory</h3><table>{listed('advisory')}</table></section>"


def dashboard(title: str, tables: dict[str, DataFrame], sections: tuple[str, ...] = ()) -> str:
    """A self-contained page: the sections, then one table per aggregate, bars for shares."""
    parts = [f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>body{{font-family:sans-serif}}td,th{{padding:2px 8px;text-align:left}}.bar{{background:#69c;height:8px}}</style></head><body><h1>{html.escape(title)}</h1>", *sections]
    for name, df in tables.items():
        rows = df.collect()
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in df.columns)}</tr>")
        for r in rows:
            cells = []
            for c in df.columns:
                v = r[c]
                if isinstance(v, float) and 0 <= v <= 1:
                    cells.append(f"<td>{percentage(v)}<div class='bar' style='width:{v * 120:.0f}px'></div></td>")
                else:
                    cells.append(f"<td>{html.escape('' if v is None else str(v))}</td>")
            parts.append(f"<tr>{''.join(cells)}</tr>")
        parts.append("</table>" if rows else "</table><p>no data</p>")
    return "".join(parts) + "</body></html>"
