"""Queries over products and variants: quality, exports, joins, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordering, quality, state
from ..sources import exports, shared
from ..streaming import snapshots
from . import derive
from .registry import query

# The fields of both reports' completeness.
PRODUCT_FIELDS = ["name", "brand", "category_path", "description", "specifications", "image_urls", "alternative_product_urls", "price_visibility"]
VARIANT_FIELDS = ["sku", "item_number", "price", "unit_pack_size", "availability", "price_visibility"]
DASHBOARD_FIELDS = ["sku", "item_number", "product_code", "price", "currency", "unit_pack_size", "availability", "image_urls"]


def _populated_sql(field: str, unknown_counts: bool) -> str:
    if field in ("category_path", "image_urls", "alternative_product_urls"):
        return f"coalesce(len({field}) > 0, false)"
    if field == "specifications":
        return "spec_size IS NOT NULL"
    empty = "('', '[]', '{}', 'null')" if unknown_counts else "('', 'unknown')"
    return f"coalesce(trim(CAST({field} AS VARCHAR)) NOT IN {empty}, false)"


def _completeness_sql(table: str, fields: list[str], unknown_counts: bool = False, rounded: bool = True) -> str:
    one = lambda f: (
        f"SELECT '{f}' AS field, coalesce({'round(' if rounded else ''}avg(CASE WHEN {_populated_sql(f, unknown_counts)} THEN 1.0 ELSE 0.0 END){', 4)' if rounded else ''}, 0.0) AS completeness, "
        f"count(*) FILTER (WHERE {_populated_sql(f, unknown_counts)}) AS populated FROM {table}"
    )
    return " UNION ALL ".join(one(f) for f in fields)


@query(derive.sql("SELECT 'products' AS entity, count(*) AS n FROM products UNION ALL SELECT 'variants', count(*) FROM variants", "products", "variants"))
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n")
    return count(derive.products(spark, sf_dir), "products").unionByName(count(derive.variants(spark, sf_dir), "variants"))


@query(derive.sql("SELECT price_visibility AS value, count(*) AS n FROM products GROUP BY 1", "products"))
def price_visibility_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.group_counts(derive.products(spark, sf_dir), "price_visibility").orderBy(F.desc("n"), "value")


@query(derive.sql("SELECT brand, count(*) AS n FROM products WHERE brand IS NOT NULL GROUP BY 1 ORDER BY n DESC, brand LIMIT 12", "products"))
def top_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.top(derive.products(spark, sf_dir), F.col("brand"), 12, "brand")


@query(derive.sql("SELECT p.product_url, p.name, count(*) AS n FROM products p JOIN variants v USING (product_url) GROUP BY 1, 2 ORDER BY n DESC, product_url LIMIT 10", "products", "variants"))
def variants_per_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = derive.variants(spark, sf_dir).groupBy("product_url").agg(F.count(F.lit(1)).alias("n"))
    named = counted.join(derive.products(spark, sf_dir).select("product_url", "name"), "product_url")
    return named.select("product_url", "name", "n").orderBy(F.desc("n"), "product_url").limit(10)


_LABEL = "array_to_string(category_path[2:3], ' > ')"


@query(derive.sql(f"SELECT {_LABEL} AS category, count(*) AS n FROM products WHERE len(category_path) >= 2 GROUP BY 1 ORDER BY n DESC, category LIMIT 12", "products"))
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.top(derive.products(spark, sf_dir), quality.category_label(F.col("category_path")), 12, "category")


@query(derive.sql("SELECT coalesce(nullif(array_to_string(category_path, ' > '), ''), 'unknown') AS category_path, count(*) AS n FROM products GROUP BY 1", "products"))
def category_path_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.products(spark, sf_dir).groupBy(quality.full_path(F.col("category_path")).alias("category_path")).agg(F.count(F.lit(1)).alias("n"))


@query(derive.sql(_completeness_sql("products", PRODUCT_FIELDS), "products"))
def product_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.completeness(derive.products(spark, sf_dir), PRODUCT_FIELDS)


@query(derive.sql(_completeness_sql("variants", VARIANT_FIELDS), "variants"))
def variant_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.completeness(derive.variants(spark, sf_dir), VARIANT_FIELDS)


@query(derive.sql(f"SELECT 'products' AS entity, * FROM ({_completeness_sql('products', PRODUCT_FIELDS, True, False)}) UNION ALL SELECT 'variants', * FROM ({_completeness_sql('variants', DASHBOARD_FIELDS, True, False)})", "products", "variants"))
def dashboard_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the dashboard shows of both tables: ``unknown`` counts as a value, shares are not rounded."""
    part = lambda df, fields, entity: quality.completeness(df, fields, unknown_counts=True, decimals=None).select(F.lit(entity).alias("entity"), "*")
    return part(derive.products(spark, sf_dir), PRODUCT_FIELDS, "products").unionByName(part(derive.variants(spark, sf_dir), DASHBOARD_FIELDS, "variants"))


def _provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.provenance_counts(derive.with_provenance(derive.products(spark, sf_dir), derive.PRODUCT_PROVENANCE), derive.with_provenance(derive.variants(spark, sf_dir), derive.VARIANT_PROVENANCE))


_ORDER = "CASE source " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(quality.SOURCES, 1)) + " ELSE 99 END"


@query(derive.sql(f"SELECT source, count(*) AS n, CAST({_ORDER} AS INTEGER) AS position FROM provenance GROUP BY 1", "provenance"))
def provenance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.with_report_order(_provenance(spark, sf_dir)).orderBy("position", "source")


@query(derive.sql("SELECT source, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM provenance GROUP BY 1", "provenance"))
def provenance_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.with_share(_provenance(spark, sf_dir))


@query(derive.sql("SELECT category AS value, count(*) AS n, count(*) / max(count(*)) OVER () AS bar FROM products GROUP BY 1", "products"))
def category_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.with_bar(quality.group_counts(derive.products(spark, sf_dir), "category"))


@query(derive.sql("SELECT (SELECT count(*) FROM stored) AS products, CAST(sum(n) AS BIGINT) AS discovered, (SELECT count(*) FROM stored)::DOUBLE / CAST(sum(n) AS DOUBLE) AS coverage FROM (SELECT category, count(*) AS n FROM products GROUP BY 1)", "stored"))
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of the stored snapshot against the urls that discovery found."""
    discovered = derive.products(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return quality.coverage(derive.stored_products(spark, sf_dir), discovered)


@query(derive.sql("SELECT v.product_url, p.name, v.pos, v.sku, v.price FROM variants v JOIN products p USING (product_url) WHERE p.category = 'STANDARD'", "products", "variants"))
def product_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = derive.products(spark, sf_dir).filter("category = 'STANDARD'").select("product_url", "name")
    return derive.variants(spark, sf_dir).join(chosen, "product_url").select("product_url", "name", "pos", "sku", "price")


@query(
    derive.sql(
        """SELECT p.name AS product_name, coalesce(p.brand, '') AS brand, array_to_string(p.category_path, ' > ') AS category_path, p.product_url,
                  coalesce(v.sku, '') AS sku, coalesce(v.item_number, '') AS item_number, coalesce(v.product_code, '') AS product_code,
                  v.price AS price, coalesce(v.currency, '') AS currency, coalesce(v.price_visibility, p.price_visibility) AS price_visibility,
                  coalesce(v.unit_pack_size, '') AS unit_pack_size, coalesce(v.availability, '') AS availability, coalesce(p.description, '') AS description
           FROM products p LEFT JOIN variants v USING (product_url)""",
        "products",
        "variants",
    )
)
def catalog_flat_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, v = derive.products(spark, sf_dir).drop("seq").alias("p"), derive.variants(spark, sf_dir).alias("v")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c.split(".")[-1])
    return p.join(v, F.col("p.product_url") == F.col("v.product_url"), "left").select(
        F.col("p.name").alias("product_name"), text("p.brand"), F.array_join("p.category_path", " > ").alias("category_path"), "p.product_url",
        text("v.sku"), text("v.item_number"), text("v.product_code"), F.col("v.price").alias("price"), text("v.currency"),
        F.coalesce("v.price_visibility", "p.price_visibility").alias("price_visibility"), text("v.unit_pack_size"), text("v.availability"), text("p.description"),
    )


@query(
    derive.sql(
        """SELECT p.product_url, p.name, p.brand, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(v.variants, '[]') AS variants
           FROM products p LEFT JOIN (SELECT product_url, count(*) AS n, CAST(to_json(list({'pos': pos, 'sku': sku, 'item_number': item_number, 'currency': currency, 'availability': availability} ORDER BY place)) AS VARCHAR) AS variants FROM variants GROUP BY 1) v USING (product_url)""",
        "products",
        "variants",
    )
)
def nested_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per product with its variants as a JSON array in order, empty for childless ones."""
    fields = ["product_url", "pos", "sku", "item_number", "currency", "availability"]
    rows = exports.nested(derive.products(spark, sf_dir).select("product_url", "name", "brand"), derive.variants(spark, sf_dir).select(*fields, "place"), order="place")
    shown = F.transform("variants", lambda v: v.dropFields("place"))
    return rows.select("product_url", "name", "brand", F.size("variants").cast("long").alias("n"), F.to_json(shown, {"ignoreNullFields": "false"}).alias("variants"))


@query(derive.sql("SELECT p.product_url, count(v.pos) AS variants FROM products p LEFT JOIN variants v USING (product_url) GROUP BY 1 HAVING count(v.pos) = 0", "products", "variants"))
def childless_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.products(spark, sf_dir).select("product_url").join(derive.variants(spark, sf_dir).select("product_url"), "product_url", "left_anti").withColumn("variants", F.lit(0).cast("long"))


@query(derive.sql("SELECT product_url, pos, sku, CASE WHEN r = 1 THEN 'kept' WHEN item_number IS NOT DISTINCT FROM i AND price IS NOT DISTINCT FROM p THEN 'duplicate' ELSE 'conflicting' END AS verdict FROM (SELECT *, row_number() OVER w AS r, first_value(item_number) OVER w AS i, first_value(price) OVER w AS p FROM (SELECT *, " + derive.IDENTITY_SQL + " AS variant_key FROM variants) WINDOW w AS (PARTITION BY product_url, variant_key ORDER BY place))", "variants"))
def variant_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.variants(spark, sf_dir).withColumn("variant_key", derive.identity())
    content = F.struct("item_number", "price")
    return ordering.mark_duplicates(rows, ["product_url", "variant_key"], [F.col("place")], F.to_json(content)).select("product_url", "pos", "sku", "verdict")


@query(derive.sql("SELECT product_url, coalesce(p.name, s.name) AS name, CASE WHEN p.product_url IS NULL THEN s.brand ELSE p.brand END AS brand, p.product_url IS NOT NULL AS updated FROM (SELECT * FROM shadow WHERE brand IS NOT NULL) p FULL JOIN stored s USING (product_url)", "shadow", "stored"))
def upsert_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second extraction's products with a brand are new or changed; the rest of the stored snapshot stays."""
    new = derive.shadow_products(spark, sf_dir).filter("brand IS NOT NULL").select("product_url", "name", "brand", F.lit(True).alias("updated"))
    stored = derive.stored_products(spark, sf_dir).select("product_url", "name", "brand", F.lit(False).alias("updated"))
    return state.upsert(stored, new, ["product_url"])


@query(derive.sql("SELECT product_url, seq % 4 <> 1 AS variants_complete FROM products p WHERE seq % 4 <> 1 OR NOT EXISTS (SELECT 1 FROM stored s WHERE s.product_url = p.product_url)", "stored"))
def upsert_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = derive.products(spark, sf_dir).select("product_url", (F.col("seq") % 4 != 1).alias("variants_complete"))
    return state.accepted(new, derive.stored_products(spark, sf_dir), "product_url")


@query(derive.sql("SELECT product_url, coalesce(n.name, s.name) AS name, coalesce(n.price_visibility, s.price_visibility) AS price_visibility FROM stored s FULL JOIN (SELECT * FROM products p WHERE seq % 4 <> 1 OR NOT EXISTS (SELECT 1 FROM stored s WHERE s.product_url = p.product_url)) n USING (product_url)", "stored"))
def stored_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store holds after the earlier snapshot and then a new one, some of whose products are incomplete."""
    store = snapshots.SnapshotStore(spark, shared.folder(spark, "store"), "product_url string, name string, price_visibility string", "product_url", buckets=16)
    store.apply(derive.stored_products(spark, sf_dir).select("product_url", "name", "price_visibility", F.lit(True).alias("variants_complete")))
    store.apply(derive.products(spark, sf_dir).select("product_url", "name", "price_visibility", (F.col("seq") % 4 != 1).alias("variants_complete")))
    return store.read()


@query(derive.sql("SELECT product_url, variant_key FROM keyed k WHERE EXISTS (SELECT 1 FROM shadow_variants s WHERE s.product_url = k.product_url) AND NOT EXISTS (SELECT 1 FROM shadow_variants s WHERE s.product_url = k.product_url AND s.variant_key = k.variant_key)", "shadow_variants"))
def stale_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = derive.keyed_variants(spark, sf_dir)
    return state.stale(keyed, derive.shadow_of(keyed), "product_url", "variant_key").select("product_url", "variant_key")


@query(derive.sql("SELECT product_url, variant_key, 'old' AS origin FROM keyed k WHERE NOT EXISTS (SELECT 1 FROM shadow_variants s WHERE s.product_url = k.product_url) UNION ALL SELECT product_url, variant_key, 'new' FROM shadow_variants", "shadow_variants"))
def replaced_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = derive.keyed_variants(spark, sf_dir)
    stored = keyed.select("product_url", "variant_key", F.lit("old").alias("origin"))
    new = derive.shadow_of(keyed).select("product_url", "variant_key", F.lit("new").alias("origin"))
    return state.replace_children(stored, new, new, "product_url")


_LOST = ["brand", "category_path", "description", "image_urls"]


@query(derive.sql("SELECT p.product_url, concat_ws(',', " + ", ".join(f"CASE WHEN {o} AND NOT {n} THEN '{f}' END" for f, o, n in ((f, f"coalesce({'len' if f in ('category_path', 'image_urls') else 'length'}(s.{f}) > 0, false)", f"coalesce({'len' if f in ('category_path', 'image_urls') else 'length'}(p.{f}) > 0, false)") for f in _LOST)) + ") AS regressed FROM products p LEFT JOIN stored s USING (product_url)", "stored"))
def metadata_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = state.metadata_regression(derive.products(spark, sf_dir), derive.stored_products(spark, sf_dir), "product_url", _LOST)
    return found.select("product_url", F.array_join("regressed", ",").alias("regressed"))


@query(derive.sql("SELECT n.product_url, n.c AS new_count, coalesce(o.c, 0) AS old_count, coalesce(o.c, 0) >= 4 AND n.c < 0.5 * o.c AS drifted FROM (SELECT product_url, count(*) FILTER (WHERE quantity <= 18) AS c FROM variants GROUP BY 1) n LEFT JOIN (SELECT product_url, count(*) AS c FROM variants GROUP BY 1) o USING (product_url)", "variants"))
def variant_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = derive.variants(spark, sf_dir).groupBy("product_url").agg(F.count(F.when(F.col("quantity") <= 18, 1)).alias("new_count"), F.count(F.lit(1)).alias("old_count"))
    return counts.withColumn("drifted", state.count_drift(F.col("new_count"), F.col("old_count"), F.lit(True)))


@query(derive.sql("SELECT count(*) AS duplicates_prevented FROM products p JOIN stored s USING (product_url)", "stored"))
def duplicates_prevented(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = derive.stored_products(spark, sf_dir).select("product_url")
    return derive.products(spark, sf_dir).join(stored, "product_url", "left_semi").agg(F.count(F.lit(1)).alias("duplicates_prevented"))


@query(derive.sql("SELECT category, seq, product_url, turn FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY seq) AS turn FROM products) ORDER BY turn, category LIMIT 40", "products"))
def round_robin_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.products(spark, sf_dir).select("category", "seq", "product_url")
    return ordering.round_robin(rows, "category", "seq", "category", 40)


@query(derive.sql("SELECT name, seq, product_url FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq) AS r FROM products) WHERE r = 1", "products"))
def dedup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.first_seen(derive.products(spark, sf_dir).select("name", "seq", "product_url"), ["name"], [F.col("seq")])


@query(derive.sql("SELECT name, category, seq FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY category, seq) AS r FROM products) WHERE r = 1", "products"))
def cross_category_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.first_seen(derive.products(spark, sf_dir).select("name", "category", "seq"), ["name"], [F.col("category"), F.col("seq")])


@query(derive.sql("SELECT product_url, name FROM products ORDER BY seq LIMIT 5", "products"))
def head_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.products(spark, sf_dir).orderBy("seq").select("product_url", "name").limit(5)


@query(derive.sql("SELECT category, arg_max(name, struct_pack(a := len(category_path), b := (brand IS NOT NULL)::INT, c := -seq)) AS best FROM products GROUP BY 1", "products"))
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.products(spark, sf_dir)
    return ordering.best(rows, ["category"], [F.size("category_path").alias("a"), F.col("brand").isNotNull().cast("int").alias("b")], "seq", F.col("name"))


@query(derive.sql("SELECT product_url, concat_ws(',', CASE WHEN brand IS NULL THEN 'brand' END, CASE WHEN description IS NULL THEN 'description' END, CASE WHEN len(category_path) = 0 THEN 'category_path' END, CASE WHEN len(image_urls) = 0 THEN 'image_urls' END) AS missing FROM products", "products"))
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = [("brand", F.col("brand").isNull()), ("description", F.col("description").isNull()), ("category_path", F.size("category_path") == 0), ("image_urls", F.size("image_urls") == 0)]
    return derive.products(spark, sf_dir).select("product_url", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in empty])), ",").alias("missing"))


@query(
    derive.sql(
        f"""SELECT 'products' AS entity, field, completeness, populated FROM ({_completeness_sql('products', PRODUCT_FIELDS)})
            UNION ALL SELECT 'variants', field, completeness, populated FROM ({_completeness_sql('variants', VARIANT_FIELDS)})
            UNION ALL SELECT 'provenance', source, round(count(*) / sum(count(*)) OVER (), 4), count(*) FROM provenance GROUP BY source""",
        "provenance",
    )
)
def catalog_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness of both tables and the share of each provenance source."""
    part = lambda df, entity: df.select(F.lit(entity).alias("entity"), "field", "completeness", "populated")
    shares = quality.with_share(_provenance(spark, sf_dir)).select(F.col("source").alias("field"), F.round("share", 4).alias("completeness"), F.col("n").alias("populated"))
    return part(product_completeness(spark, sf_dir), "products").unionByName(part(variant_completeness(spark, sf_dir), "variants")).unionByName(part(shares, "provenance"))
