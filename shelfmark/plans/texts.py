"""Queries over text functions, identities, extraction and locators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import commerce, records, similarity, text, url
from ..operators import extraction, locators, ordering
from ..sources import exports
from . import derive
from .registry import query

_FORMS = "CASE l_linenumber % 7 WHEN 0 THEN '$' || CAST(l_extendedprice AS DECIMAL(12,2)) WHEN 1 THEN '(' || CAST(l_extendedprice AS DECIMAL(12,2)) || ')' WHEN 2 THEN 'from 1,234.50 USD' WHEN 3 THEN '-$ ' || l_partkey WHEN 4 THEN 'call us' WHEN 5 THEN '&#36;' || CAST(l_tax AS DECIMAL(12,2)) || '&nbsp;each' END"


@query(
    f"""SELECT l_orderkey, l_linenumber, t AS price_text,
               CASE WHEN m <> '' THEN CAST(CASE WHEN (starts_with(d, '(') AND ends_with(d, ')')) OR starts_with(d, '-$') THEN -CAST(replace(m, ',', '') AS DECIMAL(18,6)) ELSE CAST(replace(m, ',', '') AS DECIMAL(18,6)) END AS DOUBLE) END AS price
        FROM (SELECT *, regexp_extract(d, '((?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(?:\\.[0-9]+)?)', 1) AS m FROM (SELECT l_orderkey, l_linenumber, t, replace(replace(t, '&#36;', '$'), '&nbsp;', ' ') AS d FROM (SELECT *, {_FORMS} AS t FROM lineitem)))"""
)
def parse_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_FORMS} AS price_text")
    return rows.withColumn("price", commerce.parse_price(F.col("price_text")).cast("double"))


@query(
    """SELECT p_partkey, t AS pack_text, CASE p_partkey % 5 WHEN 0 THEN p_size || '/box' WHEN 1 THEN p_size || '/case' WHEN 2 THEN '1' || p_size || '/each' WHEN 3 THEN p_size || ' crates' ELSE p_name END AS pack_size
       FROM (SELECT *, CASE p_partkey % 5 WHEN 0 THEN 'Box of ' || p_size WHEN 1 THEN p_size || ' / CS' WHEN 2 THEN '1,' || p_size || ' ea' WHEN 3 THEN p_size || ' crates' ELSE p_name END AS t FROM part)"""
)
def pack_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = "CASE p_partkey % 5 WHEN 0 THEN concat('Box of ', p_size) WHEN 1 THEN concat(p_size, ' / CS') WHEN 2 THEN concat('1,', p_size, ' ea') WHEN 3 THEN concat(p_size, ' crates') ELSE p_name END AS pack_text"
    rows = derive.read(spark, sf_dir, "part").selectExpr("p_partkey", form)
    return rows.withColumn("pack_size", commerce.pack_size(F.col("pack_text")))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'In Stock' WHEN 1 THEN 'Out Of Stock' WHEN 2 THEN 'back order' END AS label FROM part")
def availability_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = "CASE p_partkey % 4 WHEN 0 THEN 'https://schema.org/InStock' WHEN 1 THEN 'OutOfStock' WHEN 2 THEN 'back-order' END AS raw"
    return derive.read(spark, sf_dir, "part").selectExpr("p_partkey", raw).select("p_partkey", text.availability_label(F.col("raw")).alias("label"))


@query("SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text_sha256 FROM documents WHERE text IS NOT NULL")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return rows.select("doc_id", F.sha2(F.coalesce(text.normalize_text(F.col("text")), F.lit("")), 256).alias("text_sha256"))


_ASKED = "list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND split_part(lower(x), '=', 1) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'msclkid')))"


@query(
    f"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) || coalesce(nullif(rtrim(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/'), ''), '/')
               || CASE WHEN len({_ASKED}) > 0 THEN '?' || array_to_string({_ASKED}, '&') ELSE '' END AS url FROM pages"""
)
def normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.read(spark, sf_dir, "pages").select("page_id", url.normalize_url("url").alias("url"))


@query()
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of neighbouring documents, with their SequenceMatcher ratio."""
    a = derive.read(spark, sf_dir, "documents").select("doc_id", "text")
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next_text"))
    return a.join(b, "doc_id").select("doc_id", similarity.text_similarity("text", "next_text").alias("similarity"))


_OPEN = "CASE WHEN a = b THEN 'equal' WHEN 2.0 * least(length(a), length(b)) / (length(a) + length(b)) < 0.9 THEN 'length' ELSE 'matching' END"


@query(
    derive.sql(
        f"""SELECT product_url, {_OPEN} AS decided_by, CASE WHEN a = b THEN true WHEN {_OPEN} = 'length' THEN false ELSE 2.0 * length(a) / (length(a) + length(b)) >= 0.9 END AS agreed
            FROM (SELECT product_url, coalesce(lower(p.description), '') AS a, coalesce(lower(s.description), '') AS b FROM products p JOIN shadow s USING (product_url))""",
        "shadow",
    )
)
def text_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether both extractions' descriptions agree; most are decided without matching."""
    second = derive.shadow_products(spark, sf_dir).select("product_url", F.col("description").alias("seen"))
    pairs = derive.products(spark, sf_dir).select("product_url", "description").join(second, "product_url")
    return similarity.decisions(pairs, "description", "seen").select("product_url", "decided_by", "agreed")


@query()
def text_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether neighbouring documents are alike, over whole texts, and what decided it."""
    a = derive.read(spark, sf_dir, "documents").select("doc_id", "text")
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next_text"))
    return similarity.decisions(a.join(b, "doc_id"), "text", "next_text").select("doc_id", "decided_by", "agreed")


_TOKENS = "list_distinct(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' '))"


@query(f"SELECT a.item_id, b.item_id AS other_id, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 9) AS jaccard FROM (SELECT item_id, {_TOKENS} AS t FROM benchmark) a JOIN (SELECT item_id, {_TOKENS} AS t FROM benchmark) b ON b.item_id = a.item_id + 1")
def set_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.array_distinct(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " "))
    a = derive.read(spark, sf_dir, "benchmark").select("item_id", tokens.alias("t"))
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other_id"), F.col("t").alias("u"))
    return a.join(b, "item_id").select("item_id", "other_id", F.round(text.jaccard(F.col("t"), F.col("u")), 9).alias("jaccard"))


@query(derive.sql(f"SELECT product_url, pos, {derive.IDENTITY_SQL} AS variant_key FROM variants", "variants"))
def variant_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.variants(spark, sf_dir).select("product_url", "pos", derive.identity().alias("variant_key"))


@query()
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash per product over its whole record and sorted variants."""
    v = derive.variants(spark, sf_dir).drop("seq", "pos", "place")
    rows = exports.nested(derive.products(spark, sf_dir).drop("seq"), v, order="sku")
    return rows.select("product_url", records.content_hash(rows).alias("content_hash"))


@query(derive.sql("SELECT product_url, pos, concat_ws('; ', CASE WHEN sku IS NULL THEN 'sku is missing' END, CASE WHEN sku LIKE '%7' THEN 'sku ends with 7' END, CASE WHEN price < 20000 THEN 'price is low' END) AS errors FROM variants", "variants"))
def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import validation

    checks = [(F.col("sku").isNull(), "sku is missing"), (F.endswith("sku", F.lit("7")), "sku ends with 7"), (F.col("price") < 20000, "price is low")]
    return derive.variants(spark, sf_dir).select("product_url", "pos", F.array_join(validation.failures(checks), "; ").alias("errors"))


def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_url, v): each product's children by sku, the first of each, as entries of a map.

    Prices stand as a number or, for what is out of stock, in an attribute of rendered
    markup; a pack has a field of its own or stands in the description.
    """
    shown = F.col("availability") == "OutOfStock"
    rendered = F.struct(F.concat(F.lit("<span data-price-amount='"), F.col("price").cast("string"), F.lit("'>from $1</span>")).alias("price"))
    child = F.struct(
        "sku", F.col("item_number").alias("manufacturer_part_number"), F.when(~F.coalesce(shown, F.lit(False)), F.col("price").cast("string")).alias("product_price"), F.when(shown & F.col("price").isNotNull(), rendered).alias("price"),
        F.col("unit_pack_size").alias("pack"), F.when(F.col("unit_pack_size").isNull(), F.lit("Sold with 12 per box &amp; more")).alias("description"), F.col("availability").alias("stock_availability"),
    )
    named = derive.variants_of(derive.lines_by_product(spark, sf_dir), "product_url", *derive.LINE).filter("sku IS NOT NULL")
    first = ordering.first_seen(named.select("product_url", "sku", "place", *derive.LINE), ["product_url", "sku"], [F.asc_nulls_last("place")])
    made = derive.variants_of(first, "product_url", "sku", "place").select("product_url", "sku", F.when(F.col("place").isNotNull(), child).alias("child"))
    return made.groupBy("product_url").agg(F.sort_array(F.collect_list(F.struct("sku", "child"))).alias("v"))


#: A third of the pages has an offer, a third a list of one; every second page has breadcrumbs, out of order.
_OFFERS = """CASE seq % 3 WHEN 0 THEN '{"@type":"Offer","price":"12.50","priceCurrency":"eur","availability":"https://schema.org/InStock"}' WHEN 1 THEN '[{"@type":"AggregateOffer","lowPrice":' || seq || '}]' END"""
_CRUMBS = """CASE seq % 2 WHEN 0 THEN '<script type="application/ld+json">{"@type":"BreadcrumbList","itemListElement":[{"position":3,"name":"' || category || '"},{"position":1,"name":"Home"},{"position":2,"item":{"name":"All &amp; sundry","url":"https://shop.test/all"}},{"position":"x","name":"' || upper(name) || '"}]}</script><script type="application/ld+json">{"@type":"BreadcrumbList","itemListElement":[{"position":1,"name":"Short"}]}</script>' ELSE '' END"""


def _facts() -> Column:
    """A list of a product's facts, and a paragraph after it."""
    return F.expr("""'<ul class="facts list" data-kind="size-' || size || '"><li>' || category || '</li><li class="even">Size ' || size || '</li><li>End</li></ul><p id="after">After</p>'""")


def _product_pages(spark: SparkSession, sf_dir: str, flawed: bool = False) -> DataFrame:
    """A page per product with structured data and, for most, an embedded state.

    flawed: some states have a child with a bad sku at their end, some names have markup.
    """
    p = derive.products(spark, sf_dir).join(_children(spark, sf_dir), "product_url", "left")
    if flawed:
        kind = p.schema["v"].dataType.elementType
        bad = F.from_json(F.lit('{"sku":"~","child":{"sku":"bad sku!"}}'), kind)
        p = p.withColumn("v", F.when((F.col("seq") % 5 == 0) & F.col("v").isNotNull(), F.concat("v", F.array(bad))).otherwise(F.col("v"))).withColumn("name", F.when(F.col("seq") % 6 == 0, F.concat("name", F.lit(" &lt;b"))).otherwise(F.col("name")))
    node = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("product_url").alias("url"), "name", F.struct(F.col("brand").alias("name")).alias("brand"), "description", F.col("image_urls").alias("image"), F.try_parse_json(F.expr(_OFFERS)).alias("offers")))
    outer = F.to_json(F.struct(F.to_json(F.map_from_entries("v")).alias("s")))
    literal = text.let(outer, lambda x: F.substring(x, F.lit(len('{"s":') + 1), F.char_length(x) - len('{"s":}')))
    state_ = F.when(F.col("v").isNull(), F.lit('"[]"')).otherwise(literal)
    grouped = F.when(F.col("v").isNull(), F.lit(' class="page-product-grouped"')).otherwise(F.lit(""))
    script = F.when(F.col("seq") % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("<script>window.masterData = "), state_, F.lit(";</script>")))
    html = F.concat(F.lit("<html><body"), grouped, F.lit("><h1 class=\"title\" data-seq=\""), F.col("seq"), F.lit('">'), F.col("name"), F.lit('</h1><script type="application/ld+json">'), node, F.lit("</script>"), F.expr(_CRUMBS), script, _facts(), F.when(F.col("seq") % 10 == 0, F.lit("<div>Please LOGIN to see price</div>")).otherwise(F.lit("")), F.lit("</body></html>"))
    return p.select(F.col("product_url").alias("url"), "seq", "name", html.alias("html"))


#: What is on the generated pages: their children, and whether they have a state.
_PAGES = """(SELECT p.*, coalesce(k, 0) AS k, coalesce(priced, 0) AS priced, total, coalesce(boxes, 0) AS boxes, coalesce(stocked, 0) AS stocked, seq % 9 <> 0 AS has_state FROM products p LEFT JOIN (
    SELECT product_url, count(*) AS k, count(price) AS priced, sum(price) AS total, count(*) FILTER (WHERE pack IS NULL) AS boxes, count(*) FILTER (WHERE stock = 'InStock') AS stocked
    FROM (SELECT product_url, sku, unnest(arg_min(struct_pack(price := price, pack := unit_pack_size, stock := availability), place)) FROM variants WHERE sku IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (product_url))"""
_METHOD = "CASE WHEN NOT has_state THEN 'json_ld_fallback' WHEN k = 0 THEN 'embedded_state_empty_grouped' ELSE 'embedded_state' END"


@query(
    derive.sql(
        f"""SELECT product_url AS url, name, brand, description, CAST(len(image_urls) AS BIGINT) AS images, CASE WHEN (has_state AND priced > 0) OR seq % 3 < 2 THEN 'public' WHEN seq % 10 = 0 THEN 'login_required' ELSE 'not_present' END AS price_visibility, {_METHOD} AS method, has_state AS complete,
                   CAST(CASE WHEN has_state THEN k ELSE 1 END AS BIGINT) AS variants, CAST(CASE WHEN has_state THEN priced ELSE 1 END AS BIGINT) AS priced, round(CASE WHEN has_state THEN coalesce(total, 0) ELSE 12.5 END, 2) AS total,
                   concat_ws(',', CASE WHEN brand IS NULL THEN 'brand' END, CASE WHEN description IS NULL THEN 'description' END, CASE WHEN seq % 2 <> 0 THEN 'category_path' END, CASE WHEN len(image_urls) = 0 THEN 'image_urls' END, CASE WHEN NOT has_state THEN 'variants_complete' END) AS missing,
                   CASE WHEN seq % 2 = 0 THEN 'All & sundry > ' || category ELSE '' END AS path, CASE WHEN has_state AND k = 0 THEN '' WHEN seq % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currencies,
                   CAST(CASE WHEN has_state THEN boxes ELSE 0 END AS BIGINT) AS boxes, CAST(CASE WHEN has_state THEN boxes ELSE 0 END AS BIGINT) AS derived_packs, CAST(CASE WHEN has_state THEN stocked ELSE 1 END AS BIGINT) AS in_stock,
                   CAST(CASE WHEN has_state AND seq % 10 = 0 THEN k - priced ELSE 0 END AS BIGINT) AS behind_login
            FROM {_PAGES}""",
        "products",
        "variants",
    )
)
def product_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products and variants read back from generated pages: breadcrumbs, offers, prices, packs, labels, currencies."""
    rows = extraction.extract(_product_pages(spark, sf_dir).select("url", "html"))
    prices = F.filter(F.transform("variants", lambda v: v["price"].cast("double")), lambda x: x.isNotNull())
    count = lambda test: F.size(F.filter("variants", test)).cast("long")
    return rows.select(
        "url", "name", "brand", "description", F.size("image_urls").cast("long").alias("images"), "price_visibility", F.col("variants_method").alias("method"), F.col("variants_complete").alias("complete"),
        F.size("variants").cast("long").alias("variants"), F.size(prices).cast("long").alias("priced"), F.round(F.aggregate(prices, F.lit(0.0), lambda a, x: a + x), 2).alias("total"), F.array_join("missing", ",").alias("missing"),
        F.array_join("category_path", " > ").alias("path"), F.array_join(F.array_sort(F.array_distinct(F.transform("variants", lambda v: v["currency"]))), ",").alias("currencies"),
        count(lambda v: v["unit_pack_size"] == "12/box").alias("boxes"), count(lambda v: v["provenance"]["unit_pack_size"] == "derived").alias("derived_packs"), count(lambda v: v["availability"] == "In Stock").alias("in_stock"),
        count(lambda v: v["price_visibility"] == "login_required").alias("behind_login"),
    )


@query(
    derive.sql(
        f"""SELECT product_url AS url, bad = '' AND NOT marked AS valid, concat_ws('; ', CASE WHEN marked THEN 'product name contains markup' END, nullif(bad, '')) AS errors, 0 AS duplicate_variants_removed
            FROM (SELECT *, seq % 6 = 0 AND false AS marked, CASE WHEN has_state AND k > 0 AND seq % 5 = 0 THEN 'variant[' || k || '] sku has an unreasonable format' ELSE '' END AS bad FROM {_PAGES})""",
        "products",
        "variants",
    )
)
def extraction_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with flaws: a bad sku is an error; an entity for a bracket is no markup."""
    from ..operators import validation

    found = validation.validate(extraction.extract(_product_pages(spark, sf_dir, flawed=True).select("url", "html")))
    return found.select("url", "valid", F.array_join("errors", "; ").alias("errors"), "duplicate_variants_removed")


@query(derive.sql(f"SELECT product_url AS url, CASE WHEN NOT has_state THEN 'absent' WHEN k = 0 THEN 'empty' ELSE 'children' END AS kind, CAST(CASE WHEN has_state THEN k ELSE 0 END AS INTEGER) AS children FROM {_PAGES}", "products", "variants"))
def embedded_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _product_pages(spark, sf_dir)
    return pages.select("url", extraction.embedded_state(F.col("html")).alias("s")).select("url", "s.kind", F.coalesce(F.size(F.map_keys("s.children")), F.lit(0)).alias("children"))


_CANDIDATES = (("title", "css_text", "h1.title", None, None), ("number", "css_attribute", "h1[data-seq]", "data-seq", None), ("second", "css_text", "h2", None, None), ("state", "js_variable", "masterData", None, "*.sku"))

#: Selectors of every form, and what each finds on a generated page.
_SELECTORS = (
    ("title", "css_text", "h1.title", None, "name"), ("number", "css_attribute", "h1[data-seq]", "data-seq", "CAST(seq AS VARCHAR)"), ("nothing", "css_text", "h2", None, "'nothing'"),
    ("third", "css_text", "ul.facts > li:nth-child(3)", None, "'End'"), ("odd", "css_text", "ul[class~=list] li:nth-child(odd)", None, "category || ', End'"), ("middle", "css_text", "li:not(:first-child):not(:last-child)", None, "'Size ' || size"),
    ("next", "css_text", "ul + p", None, "'After'"), ("later", "css_text", "h1 ~ p, h1 ~ h2", None, "'After'"), ("starts", "css_attribute", "[data-kind^=size]", "data-kind", "'size-' || size"),
    ("ends", "css_attribute", "ul[data-kind$='-7']", "data-kind", "CASE WHEN size = 7 THEN 'size-7' ELSE 'nothing' END"), ("holds", "css_text", "[data-kind*='e-1'] .even", None, "CASE WHEN CAST(size AS VARCHAR) LIKE '1%' THEN 'Size ' || size ELSE 'nothing' END"),
)


@query(
    derive.sql(
        f"""SELECT c AS candidate, count(*) AS tested, count(*) FILTER (WHERE ok) AS matched, count(*) FILTER (WHERE ok) / count(*) AS pass_rate, bool_and(ok) AS validated
            FROM (SELECT c, CASE c WHEN 'title' THEN true WHEN 'number' THEN CAST(seq AS VARCHAR) = name ELSE false END AS ok FROM {_PAGES}, (VALUES ('title'), ('number'), ('second'), ('state')) t(c)) GROUP BY 1""",
        "products",
        "variants",
    )
)
def locator_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for a product's name, held against every page."""
    samples = _product_pages(spark, sf_dir).select("url", "html", F.col("name").alias("expected"))
    return locators.validate(spark.createDataFrame(list(_CANDIDATES), locators.CANDIDATES), samples).select("candidate", "tested", "matched", "pass_rate", "validated")


@query(derive.sql(" UNION ALL ".join(f"SELECT '{name}' AS candidate, product_url AS url, {found} AS found FROM products" for name, _, _, _, found in _SELECTORS), "products"))
def locator_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What selectors of every form find on every page."""
    samples = _product_pages(spark, sf_dir).select("url", "html", F.lit("").alias("expected"))
    candidates = spark.createDataFrame([(*x[:4], None) for x in _SELECTORS], locators.CANDIDATES)
    return locators.evaluate(candidates, samples).select("candidate", "url", "found")


@query(derive.sql("SELECT c.category, s.product_url FROM (SELECT DISTINCT category FROM products) c CROSS JOIN (SELECT product_url FROM products ORDER BY seq LIMIT 8) s", "products"))
def candidate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate meets every sample; samples are capped at eight by the feature."""
    rows = derive.products(spark, sf_dir)
    samples = rows.orderBy("seq").limit(8).select("product_url")
    return rows.select("category").distinct().crossJoin(F.broadcast(samples))
