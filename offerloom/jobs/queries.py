"""Every operator as a query over the given tables, beside equivalent SQL where there is any."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.functions import gtin as G
from offerloom.functions import money as M
from offerloom.functions import text as T
from offerloom.operators import compare as C
from offerloom.operators import history as H
from offerloom.operators import matching as MA
from offerloom.operators import offers as O
from offerloom.operators import pages as PG
from offerloom.operators import publish as P
from offerloom.operators import quality as Q
from offerloom.operators import round as R
from offerloom.operators import verify as V
from offerloom.sources import config as CF
from offerloom.sources import domain as D
from offerloom.sources import feeds as FE
from offerloom.streaming import streams as ST

from .sqlbase import CATALOG, FEED, HISTORY, MATCHED, OFFERS, ONE, ROWS, VERIFIED, ean13, half_up, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the one that the session shares with its executors."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="offerloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def also(name: str, f: Callable[[SparkSession, str], DataFrame]) -> None:
    """Another name of a query."""
    QUERIES[name] = f
    if f.__name__ in ORACLES:
        ORACLES[name] = ORACLES[f.__name__]


def one_offers(spark: SparkSession, sf: str) -> DataFrame:
    return D.described(O.one_per_shop(D.offer_rows(spark, sf), [F.col("ord"), F.col("price"), F.col("amount")]))


def verified_offers(spark: SparkSession, sf: str) -> DataFrame:
    return V.verified(one_offers(spark, sf), D.catalog(spark, sf))


def kept_offers(spark: SparkSession, sf: str) -> DataFrame:
    return V.without_mismatches(verified_offers(spark, sf))


def history(spark: SparkSession, sf: str) -> DataFrame:
    return H.daily_points(D.offers(spark, sf), F.struct("ord", "price", "amount"))


def usable_feed(spark: SparkSession, sf: str) -> DataFrame:
    return FE.usable(FE.normalize_rows(D.feed_text(spark, sf), keep=["shop", "row_no"]))


def saved(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Written once for the several steps that read it."""
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def feed_to_match(spark: SparkSession, sf: str) -> DataFrame:
    return saved(spark, usable_feed(spark, sf).select("shop", "row_no", "gtin", "title", "price"), "feed")


# --- offers, ranks, summaries ---


@query(sql(OFFERS, then="SELECT product, shop, ord, price, amount, unit, unit_price, unit_label FROM offers"))
def c7_unit_prices(spark, sf):
    return D.offers(spark, sf).select("product", "shop", "ord", "price", "amount", "unit", "unit_price", "unit_label")


@query(sql(OFFERS, ONE, then="SELECT product, shop, price, unit_price, source, ord FROM one"))
def k2_one_offer_per_shop(spark, sf):
    return one_offers(spark, sf).select("product", "shop", "price", "unit_price", "source", "ord")


@query(sql(OFFERS, ONE, then="SELECT product, shop, price, unit_price, row_number() OVER (PARTITION BY product ORDER BY coalesce(NOT in_stock, false), unit_price, price, shop) AS rank FROM one"))
def w1_offer_rank(spark, sf):
    return P.rank_offers(one_offers(spark, sf)).select("product", "shop", "price", "unit_price", "rank")


@query(sql(CATALOG, OFFERS, ONE, VERIFIED, then="SELECT product, shop, gtin, verification, reference, reference_source FROM kept"))
def a2_verification(spark, sf):
    return kept_offers(spark, sf).select("product", "shop", "gtin", "verification", "reference", "reference_source")


@query(sql(CATALOG, OFFERS, ONE, VERIFIED, then="SELECT product, lpad(voted, 14, '0') AS votes_gtin, distinct_gtins FROM con"))
def a1_gtin_consensus(spark, sf):
    return V.consensus(one_offers(spark, sf).withColumn("gtin", G.normalize_gtin("gtin_text")))


PREVIOUS = f"""prev AS (SELECT DISTINCT product, shop, CASE product % 4 WHEN 0 THEN {ean13("201", "product")} ELSE {ean13("200", "product")} END AS before_gtin FROM one)"""


def previous(spark, sf):
    """Yesterday's identities: a fourth of the products had another number."""
    seen = D.offers(spark, sf).select("product", "shop").distinct()
    return seen.withColumn("gtin", F.when(F.col("product") % 4 == 0, D.ean13("201", F.col("product"))).otherwise(D.ean13("200", F.col("product"))))


@query(sql(CATALOG, OFFERS, ONE, VERIFIED, PREVIOUS, then="SELECT product, shop, gtin, lpad(before_gtin, 14, '0') AS before_gtin, coalesce(before_gtin <> gtin_text, false) AS gtin_changed FROM ver JOIN prev USING (product, shop)"))
def j6_previous_identity(spark, sf):
    return V.with_changes(verified_offers(spark, sf), previous(spark, sf)).select("product", "shop", "gtin", "before_gtin", "gtin_changed")


@query(
    sql(CATALOG, OFFERS, ONE, VERIFIED, PREVIOUS, then="""
SELECT product, shop, 'gtin-niet-in-catalogus' AS type, 'EAN ' || gtin_text || ' is not in the list of ' || product AS message FROM ver WHERE verification = 'afwijkend'
UNION ALL SELECT product, shop, 'gtin-gewijzigd', 'the shop shows EAN ' || gtin_text || ' now instead of ' || before_gtin FROM ver JOIN prev USING (product, shop) WHERE before_gtin <> gtin_text
UNION ALL SELECT product, shop, 'verpakking-wijkt-af', 'EAN ' || gtin_text || ' has ' || CAST(amount AS INTEGER) || ' ' || unit || ' here but elsewhere ' || CAST(f AS INTEGER) || ' ' || unit
  FROM (SELECT *, first_value(amount) OVER (PARTITION BY product, gtin ORDER BY shop) AS f FROM ver WHERE gtin IS NOT NULL) WHERE f <> amount""")
)
def a3_issues(spark, sf):
    return V.issues(V.with_changes(verified_offers(spark, sf), previous(spark, sf)))


LOW = """low AS (SELECT product, min(p) AS lowest30 FROM hist WHERE d >= DATE '2001-06-30' - 30 GROUP BY product)"""
def today():
    return F.lit("2001-06-30").cast("date")


SUMMARY = """
best AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY product ORDER BY coalesce(NOT in_stock, false), unit_price, price, shop) = 1),
summ AS (SELECT product, any_value(b.price) AS best_price, any_value(b.unit_price) AS best_unit_price, any_value(b.unit_label) AS unit_label, any_value(b.shop) AS best_shop, count(*) AS offers,
  count(*) FILTER (kept.verification = 'exact') AS verified_offers, substr(max(kept.reference), 2) AS gtin, max(kept.reference_source) AS gtin_source FROM kept JOIN best b USING (product) GROUP BY product)"""


@query(sql(CATALOG, OFFERS, ONE, VERIFIED, HISTORY, LOW, SUMMARY, then="SELECT summ.*, lowest30 FROM summ LEFT JOIN low USING (product)"))
def a5_product_summary(spark, sf):
    return P.product_summary(kept_offers(spark, sf), H.lowest_in_period(history(spark, sf), today()).withColumnRenamed("lowest", "lowest"))


@query(sql(CATALOG, OFFERS, ONE, VERIFIED, then="SELECT (SELECT count(*) FROM catalog) AS products, count(DISTINCT product) AS products_with_offers, count(*) AS offers, count(DISTINCT shop) AS shops, count(*) FILTER (verification = 'exact') AS verified_offers FROM kept"))
def a4_round_stats(spark, sf):
    return P.round_stats(D.catalog(spark, sf), kept_offers(spark, sf))


@query(
    sql(CATALOG, OFFERS, ONE, VERIFIED, SUMMARY, then="""
SELECT product, c.name, c.brand, c.category, c.size, best_price, best_unit_price, summ.unit_label, offers, verified_offers, gtin, gtin_source, pos, o.shop, o.price, o.unit_price, o.amount, o.in_stock, o.source, o.shown, o.sku, o.verification FROM summ JOIN catalog c USING (product)
JOIN (SELECT product, shop, price, unit_price, amount, in_stock, source, gtin_text AS shown, sku, verification, row_number() OVER (PARTITION BY product ORDER BY coalesce(NOT in_stock, false), unit_price, price, shop) - 1 AS pos FROM kept) o USING (product)""")
)
def s7_published_payload(spark, sf):
    """All that the payload says of products and offers: written as JSON, read back from the published folder, and flattened."""
    path = scratch(spark, "payload")
    offers = kept_offers(spark, sf)
    out = P.payload(D.catalog(spark, sf), offers, P.product_summary(offers))
    P.publish(out, path)
    back = P.read_published(spark, path, out.schema)
    top = ["product", "name", "brand", "category", "size", "best_price", "best_unit_price", "unit_label", "offers", "verified_offers", "gtin", "gtin_source"]
    flat = back.select(*top, F.posexplode("offer_list").alias("pos", "o"))
    return flat.select(*top, F.col("pos").cast("long").alias("pos"), *[f"o.{c}" for c in ("shop", "price", "unit_price", "amount", "in_stock", "source")], F.col("o.gtin").alias("shown"), "o.sku", "o.verification")


# --- history and identity ---


@query(sql(OFFERS, HISTORY, then="SELECT * FROM hist"))
def d2_daily_points(spark, sf):
    return history(spark, sf)


UPSERT = """upd AS (SELECT product, shop, d, p / 2 AS p, u FROM hist WHERE d >= DATE '2001-01-01' UNION ALL SELECT product, shop, d, p, u FROM hist WHERE d < DATE '2001-01-01')"""


@query(sql(OFFERS, HISTORY, UPSERT, then="SELECT * FROM upd"))
def d2_history_upsert(spark, sf):
    """Days from 2001 on are written again at half the price, twice: the second time changes nothing."""
    h = history(spark, sf)
    again = h.where("d >= DATE '2001-01-01'").withColumn("p", F.col("p") / 2)
    return H.upsert(H.upsert(h, again), again)


@query(sql(OFFERS, HISTORY, then="SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY product, shop ORDER BY d DESC) <= 2"))
def w3_retention(spark, sf):
    return H.retain(history(spark, sf), keep=2)


@query(sql(OFFERS, HISTORY, then="SELECT product, d, min(min(p)) OVER (PARTITION BY product ORDER BY d RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW) AS low FROM hist GROUP BY product, d"))
def w4_rolling_low(spark, sf):
    return H.rolling_low(history(spark, sf))


@query(sql(OFFERS, HISTORY, then="""
SELECT t.d, count(DISTINCT h.product) AS products, count(DISTINCT h.shop) AS shops FROM (SELECT DISTINCT d FROM hist) t JOIN hist h ON h.d BETWEEN t.d - INTERVAL 30 DAYS AND t.d GROUP BY t.d"""))  # fmt: skip
def a4_present_in_period(spark, sf):
    """A day's points have the products and shops of its offers, so they needn't be found for it."""
    return H.distinct_in_period(D.offers(spark, sf).select(F.col("day").alias("d"), "product", "shop"))


@query(sql(OFFERS, HISTORY, LOW, then="SELECT product, lowest30 AS lowest FROM low"))
def a6_lowest_in_period(spark, sf):
    return H.lowest_in_period(history(spark, sf), today())


@query(sql(OFFERS, HISTORY, then="SELECT * FROM hist WHERE d >= DATE '2001-06-01'"))
def s8_history_by_day(spark, sf):
    """The whole history written by day, the last days again, and read with partition pruning."""
    path = scratch(spark, "history")
    h = history(spark, sf)
    H.write_days(h, path)
    H.write_days(h.where("d >= DATE '2001-07-01'"), path)
    return H.read_days(spark, path, "2001-06-01").select("product", "shop", F.col("d").cast("date").alias("d"), "p", "u")


SEEN = """seen AS (SELECT product, shop, lpad(gtin_text, 14, '0') AS gtin, sku, amount, day AS at_day, ord, price FROM offers)"""
SEEN_ORDER = ["at", "ord", "price", "amount"]


def seen(spark, sf):
    return D.offers(spark, sf).select("product", "shop", G.normalize_gtin("gtin_text").alias("gtin"), "sku", "amount", F.col("day").alias("at"), "ord", "price")


@query(
    sql(OFFERS, SEEN, then="""
SELECT product, shop, rn, from_gtin, gtin AS to_gtin, at_day AS "at" FROM (SELECT *, row_number() OVER (PARTITION BY product, shop ORDER BY pos DESC) AS rn FROM (
  SELECT *, lag(gtin) OVER w AS from_gtin, row_number() OVER w AS pos FROM seen WHERE gtin IS NOT NULL WINDOW w AS (PARTITION BY product, shop ORDER BY at_day, ord, price, amount)) WHERE from_gtin <> gtin) WHERE rn <= 5""")
)
def w5_gtin_change_log(spark, sf):
    return V.change_log(seen(spark, sf), SEEN_ORDER)


@query(
    sql(OFFERS, SEEN, then="""
SELECT product, shop, min(at_day) AS first_seen, max(at_day) AS last_seen, arg_max(gtin, struct_pack(a := at_day, b := ord, c := price, d := amount)) FILTER (gtin IS NOT NULL) AS gtin,
  arg_max(sku, struct_pack(a := at_day, b := ord, c := price, d := amount)) AS sku, arg_max(amount, struct_pack(a := at_day, b := ord, c := price, d := amount)) AS amount FROM seen GROUP BY product, shop""")
)
def w6_identity_snapshot(spark, sf):
    return V.snapshot(seen(spark, sf), F.struct(*SEEN_ORDER))


@query(
    sql(CATALOG, OFFERS, ONE, then=f"""
SELECT product, CASE WHEN listed THEN '["' || own || '","' || voted || '"]' ELSE '["' || voted || '"]' END AS gtins FROM catalog JOIN (
  SELECT product, '0' || arg_min(g, struct_pack(a := -n, b := g)) AS voted FROM (SELECT product, gtin_text AS g, count(*) AS n FROM one WHERE gtin_text IS NOT NULL GROUP BY ALL) WHERE n >= 2 GROUP BY product) USING (product)
WHERE NOT (listed AND voted = '0' || own)""")
)
def a10_pin_votes(spark, sf):
    found = V.pin_votes(one_offers(spark, sf).select("product", "shop", F.col("gtin_text").alias("gtin")), D.catalog(spark, sf))
    return found.select("product", F.to_json("gtins").alias("gtins"))


# --- comparison ---


def comparison(spark, sf):
    return C.comparison_rows(D.catalog(spark, sf), kept_offers(spark, sf))


RANK = "row_number() OVER (PARTITION BY category, size ORDER BY unit_price, price, product, shop)"


@query(sql(CATALOG, OFFERS, ONE, VERIFIED, ROWS, then=f"SELECT product, shop, category, size, brand, unit_price, monthly, {RANK} AS rank FROM cmp"))
def w2_comparison_rank(spark, sf):
    return C.comparison_rank(saved(spark, comparison(spark, sf), "comparison")).select("product", "shop", "category", "size", "brand", "unit_price", "monthly", "rank")


@query(sql(CATALOG, OFFERS, ONE, VERIFIED, ROWS, then="SELECT category, size, brand, product, shop, price, unit_price FROM cmp QUALIFY row_number() OVER (PARTITION BY category, size, brand ORDER BY unit_price, price, product, shop) = 1"))
def k4_cheapest_per_brand(spark, sf):
    return C.cheapest_per_brand(comparison(spark, sf))


@query(
    sql(CATALOG, OFFERS, ONE, VERIFIED, ROWS, then=f"""
SELECT category, size, min(unit_price) AS cheapest, max(unit_price) AS dearest, {half_up("arg_max(monthly, struct_pack(a := unit_price, b := price, c := product, d := shop)) - arg_min(monthly, struct_pack(a := unit_price, b := price, c := product, d := shop))", 2, epsilon=False)} AS monthly_difference,
  count(DISTINCT brand) AS brands, count(DISTINCT shop) AS shops FROM cmp GROUP BY category, size""")
)
def a7_comparison_summary(spark, sf):
    return C.comparison_summary(comparison(spark, sf))


@query(
    sql(CATALOG, OFFERS, ONE, VERIFIED, then="""
SELECT category, kind, value, row_number() OVER (PARTITION BY category, kind ORDER BY n NULLS LAST, value) AS position FROM (
  SELECT DISTINCT category, 'size' AS kind, size AS value, CAST(size AS BIGINT) AS n FROM catalog
  UNION ALL SELECT DISTINCT category, 'brand', brand, NULL FROM catalog WHERE product IN (SELECT product FROM kept))""")
)
def a8_facets(spark, sf):
    return C.facets(D.catalog(spark, sf), kept_offers(spark, sf))


@query(
    sql(CATALOG, OFFERS, ONE, VERIFIED, then="""
SELECT category, size, n AS brands FROM (SELECT category, size, count(DISTINCT brand) AS n FROM catalog WHERE product IN (SELECT product FROM kept) GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, CAST(size AS INTEGER)) = 1""")
)
def a9_default_size(spark, sf):
    return C.default_size(D.catalog(spark, sf), kept_offers(spark, sf))


VISIBLE = """vis AS (SELECT * FROM kept WHERE in_stock IS DISTINCT FROM false AND verification = 'exact')"""


@query(sql(CATALOG, OFFERS, ONE, VERIFIED, VISIBLE, then="SELECT product, shop, price, verification FROM vis"))
def p3_visible_offers(spark, sf):
    return C.visible(kept_offers(spark, sf)).select("product", "shop", "price", "verification")


@query(sql(CATALOG, OFFERS, ONE, VERIFIED, VISIBLE, then="SELECT product, greatest(arg_max(price, struct_pack(a := unit_price, b := price, c := shop)) - arg_min(price, struct_pack(a := unit_price, b := price, c := shop)), 0.0::DOUBLE) AS saving, count(*) FILTER (verification = 'exact') AS exact, count(*) AS shops FROM vis GROUP BY product"))
def a13_savings(spark, sf):
    return C.savings(C.visible(kept_offers(spark, sf)))


@query(sql(CATALOG, OFFERS, ONE, VERIFIED, VISIBLE, then="SELECT product, shop, price, row_number() OVER (PARTITION BY product ORDER BY unit_price NULLS LAST, price, shop) AS position FROM vis"))
def k6_display_order(spark, sf):
    return C.display_order(C.visible(kept_offers(spark, sf))).select("product", "shop", "price", "position")


@query(sql(CATALOG, OFFERS, ONE, VERIFIED, SUMMARY, then="SELECT product, best_unit_price, best_price FROM summ"))
def k5_product_listing(spark, sf):
    """All products in list order."""
    return C.product_listing(P.product_summary(kept_offers(spark, sf))).select("product", "best_unit_price", "best_price")


@query(sql(CATALOG, then="SELECT product, name, brand FROM catalog WHERE category IN ('PROMO') AND size IN ('4', '7', '11') AND contains(lower(name || ' ' || brand || ' ' || category || ' maat ' || size), 'red') AND contains(lower(brand), 'brand')"))
def p2_facet_search(spark, sf):
    found = C.facet_filter(D.catalog(spark, sf).withColumn("gtin", F.lit("")), "PROMO", ["4", "7", "11"], search="Red brand")
    return found.select("product", "name", "brand")


# --- feeds and matching ---


@query(sql(FEED, then="SELECT shop, row_no, gtin, 'S' || product AS sku, title, brand, price, currency, url, in_stock, CAST(l_quantity AS DOUBLE) AS amount, 'stuk' AS unit FROM feed"))
def n2_normalised_feed(spark, sf):
    return FE.normalize_rows(D.feed_text(spark, sf), keep=["shop", "row_no"])


@query(sql(FEED, then="SELECT shop, row_no, price, url FROM usable"))
def n4_usable_rows(spark, sf):
    return usable_feed(spark, sf).select("shop", "row_no", "price", "url")


@query(sql(FEED, then="SELECT CAST(row_no AS VARCHAR) AS row_no, gtin, title, price, in_stock, CAST(l_quantity AS DOUBLE) AS amount FROM feed"))
def s1_delimited_feed(spark, sf):
    """The feed rows written as semicolon files, sniffed, read back and normalised: with line breaks, delimiters and quotes in quotes, a dotted header, and a price column twice."""
    path = scratch(spark, "csv")
    rows = D.feed_text(spark, sf).drop("shop")
    note = F.concat(F.lit('first; "line"\n\nof row\n'), F.col("row_no").cast("string"))
    rows = rows.select("*", F.col("search_price").alias("price")).withColumns({"search_price": F.lit("1,00"), "note.1": note}).withColumnRenamed("price", " Search_Price ")
    rows.write.options(header=True, sep=";", quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    back = FE.read_feed(spark, path).where(F.col("`note.1`") == F.concat(F.lit('first; "line"\n\nof row\n'), F.col("row_no")))
    return FE.normalize_rows(back, keep=["row_no"]).select("row_no", "gtin", "title", "price", "in_stock", "amount")


@query(sql(FEED, then="SELECT CAST(row_no AS VARCHAR) AS row_no, gtin, title, price, url FROM feed"))
def s3_xml_feed(spark, sf):
    """The feed rows written as XML items with prefixes, CDATA, entities, nested elements and white space of all kinds around every text, tags in three spellings, and read back."""
    path = scratch(spark, "xml")
    r = D.feed_text(spark, sf)
    field = lambda name, value: F.concat(F.lit(f"<{name}>\n\t"), value, F.lit(f"\u00a0 \r\n</{name.split(' ')[0]}>\n"))
    cdata = F.concat(F.lit("<![CDATA["), F.regexp_replace("name", "</?b>", ""), F.lit("]]>"))
    tag = F.when(F.col("row_no") % 3 == 0, "Product").when(F.col("row_no") % 3 == 1, "PRODUCT").otherwise("product")
    item = F.concat(
        F.lit("<"), tag, F.lit(">"), field("row_no", F.col("row_no").cast("string")), field("title", cdata), field("g:brand", F.col("brand")), field("g:price", F.replace("search_price", F.lit("€"), F.lit("&euro;"))),
        field("gtin", F.col("ean")), field("shipping", F.lit("<cost>9</cost>")), field("link", F.lit(" \t\n")), field("link", F.col("aw_deep_link")), field("link", F.lit("https://other.example")), F.lit("</"), tag, F.lit(">"),
    )
    r.select(item.alias("value")).write.text(path)
    rows = FE.read_xml(spark, path)
    flat = FE.xml_to_columns(rows, ["row_no", "title", "brand", "price", "gtin", "link", "cost"])
    n = FE.normalize_rows(flat, keep=["row_no", "cost"]).where("cost = ''")
    return n.select("row_no", "gtin", "title", "price", F.when(F.col("url") != "https://other.example", F.col("url")).alias("url"))


def cut_copy(spark, rows):
    """The path of a gzip file with these rows of which the second half is missing."""
    hadoop, folder = spark._jvm.org.apache.hadoop, scratch(spark, "gz")
    rows.coalesce(1).write.options(header=True, compression="gzip").csv(folder)
    (file,) = FE.files_of(spark, folder)
    fs = hadoop.fs.Path(file.path).getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.open(hadoop.fs.Path(file.path))
    body = bytes(stream.readAllBytes())
    stream.close()
    out = fs.create(hadoop.fs.Path(f"{folder}-cut.csv.gz"))
    out.write(bytearray(body[: len(body) // 2]))
    out.close()
    return f"{folder}-cut.csv.gz"


@query(sql(FEED, then="SELECT shop, CAST(row_no AS VARCHAR) AS row_no, price FROM feed UNION ALL SELECT -1, unnest(['c', 'cut']), NULL"))
def s5_many_feeds(spark, sf):
    """Every row: odd shops' as text with tabs, even ones' as XML, each with its shop as a column; an unknown publisher and a file that breaks off are problem rows."""
    rows = D.feed_text(spark, sf).withColumn("sku", F.col("row_no").cast("string")).withColumn("seller", F.col("shop").cast("string")).drop("row_no", "merchant_product_id")
    a, b = scratch(spark, "tsv"), scratch(spark, "xml")
    rows.where("shop % 2 = 1").drop("shop").write.options(header=True, sep="\t", quote='"', escape='"', emptyValue="").csv(a)
    field = lambda name, c: F.concat(F.lit(f"<{name}>"), F.replace(F.regexp_replace(c, "</?b>", ""), F.lit("€"), F.lit("&euro;")), F.lit(f"</{name}>"))
    item = F.concat(F.lit("<item>"), *[field(c, F.col(c)) for c in ("sku", "seller", "name", "search_price", "aw_deep_link")], F.lit("</item>"))
    rows.where("shop % 2 = 0").select(item.alias("value")).write.text(b)
    listed = [
        {"id": "a", "shop": "odd", "path": a, "format": "csv", "delimiter": "\t", "keep": ["seller"]}, {"id": "b", "shop": "even", "path": b, "format": "xml", "keep": ["seller"]},
        {"id": "c", "shop": "nobody", "path": a}, {"id": "d", "shop": "odd", "path": a, "enabled": False}, {"id": "cut", "shop": "odd", "path": cut_copy(spark, D.shops(spark, sf))},
    ]
    source, problems = FE.read_feeds(spark, listed, ["odd", "even"])
    bad = spark.createDataFrame([(-1, p["feed"], None) for p in problems], "shop long, row_no string, price double")
    return source.select(F.col("seller").cast("long").alias("shop"), F.col("sku").alias("row_no"), "price").unionByName(bad)


also("s5_many_feeds_all", s5_many_feeds)


@query(sql(CATALOG, FEED, MATCHED, then="SELECT shop, row_no, price, matched AS product, score FROM by_gtin"))
def j1_match_by_gtin(spark, sf):
    return MA.match_by_gtin(usable_feed(spark, sf), D.catalog(spark, sf)).select("shop", "row_no", "price", "product", "score")


@query(sql(CATALOG, FEED, MATCHED, then="SELECT shop, row_no, price, product, score FROM matched"))
def j2_match_feed(spark, sf):
    return MA.match_rows(feed_to_match(spark, sf), D.catalog(spark, sf)).select("shop", "row_no", "price", "product", "score")


@query(sql(CATALOG, FEED, MATCHED, then="SELECT shop, product, row_no, price, score FROM matched QUALIFY row_number() OVER (PARTITION BY shop, product ORDER BY score DESC, price, row_no) = 1"))
def k1_best_feed_row(spark, sf):
    return MA.best_matches(feed_to_match(spark, sf), D.catalog(spark, sf), F.col("row_no")).select("shop", "product", "row_no", "price", "score")


@query(
    sql(CATALOG, FEED, then="""
, pl AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS plain FROM usable),
cat2 AS (SELECT product AS m, trim(regexp_replace(lower(brand), '[^a-z0-9]+', ' ', 'g')) AS pb, size, string_split(lower(name), ' ') AS words FROM catalog WHERE NOT listed),
grp AS (SELECT DISTINCT pb, words FROM cat2),
jw AS (SELECT plain, pb, words, list_filter(words, lambda w: NOT contains(plain, w)) AS missing FROM pl JOIN grp ON contains(plain, pb)),
bad AS (SELECT pb, words, 'misses ' || missing[1] AS reason, count(*) AS n FROM jw WHERE len(missing) > 0 GROUP BY ALL)
SELECT m AS product, reason, n FROM cat2 JOIN bad USING (pb, words)
UNION ALL SELECT m, CASE WHEN contains(plain, ' maat ' || size || ' ') THEN 'ok' ELSE 'size' END AS reason, count(*) FROM cat2 JOIN (SELECT * FROM jw WHERE len(missing) = 0) g USING (pb, words) GROUP BY ALL""".strip()).replace("\n, pl", ", pl")
)
def d6_match_diagnosis(spark, sf):
    """Of every shop's feed: a diagnosis looks at every brand-mate of a title. The SQL, too, judges the words of a group of products once."""
    return MA.diagnose(usable_feed(spark, sf), D.catalog(spark, sf))


also("d6_match_diagnosis_all", d6_match_diagnosis)


# --- a whole round ---


SOLD = FEED.replace("p_size || ' - ' || CAST(l_quantity AS INTEGER) || ' stuks & meer' AS title", "p_size || CASE WHEN (l_orderkey * 8 + l_linenumber) % 6 = 0 THEN '' ELSE ' - ' || CAST(l_quantity AS INTEGER) || ' stuks' END || ' & meer' AS title")
ROUND = f"""
won AS (SELECT m.product, m.shop, m.row_no, m.price, m.title FROM matched m QUALIFY row_number() OVER (PARTITION BY shop, product ORDER BY score DESC, price, row_no) = 1),
one AS (SELECT DISTINCT won.product, won.shop, f.url, won.price, won.title, f.in_stock, 'S' || f.product AS sku, substr(f.gtin, 2) AS gtin_text,
  CASE WHEN f.row_no % 6 <> 0 THEN CAST(f.l_quantity AS DOUBLE) WHEN won.product % 4 = 0 THEN 10.0::DOUBLE END AS amount FROM won JOIN feed f USING (shop, row_no, price, title)),
prev AS (SELECT product, shop, CASE product % 4 WHEN 0 THEN {ean13("201", "product")} ELSE {ean13("200", "product")} END AS before_gtin FROM one)"""
PER_PIECE = half_up("price / amount", 4)


@query(
    sql(CATALOG, SOLD, MATCHED, ROUND, VERIFIED, then=f"""
SELECT product, name, shop, s_name AS shop_name, url, price, {half_up(PER_PIECE, 4)} AS unit_price, CASE WHEN amount IS NOT NULL THEN 'per stuk' END AS unit_label, amount, in_stock, title, gtin_text AS gtin, sku, verification,
  coalesce(before_gtin <> gtin_text, false) AS gtin_changed, row_number() OVER (PARTITION BY product ORDER BY coalesce(NOT in_stock, false), {half_up(PER_PIECE, 4)}, price, shop) - 1 AS pos
FROM kept JOIN prev USING (product, shop) JOIN catalog USING (product) JOIN supplier ON s_suppkey = shop""")
)
def e1_round(spark, sf):
    """From feed files to the published payload: read, normalise, match, offers with the catalog's pack where the feed has none, verify against the last round's
    numbers, rank, publish, and write the state; read back from the published folder, and flattened."""
    path, payload = played_round(spark, sf)
    flat = P.read_published(spark, path, payload.schema).select("product", "name", F.posexplode("offer_list").alias("pos", "o"))
    return flat.select("product", "name", "o.shop", "o.shop_name", "o.url", "o.price", "o.unit_price", "o.unit_label", "o.amount", "o.in_stock", "o.title", "o.gtin", "o.sku", "o.verification", "o.gtin_changed", F.col("pos").cast("long").alias("pos"))


def played_round(spark, sf):
    """(folder, payload) of a round over the feed's rows, with identities of a round before it."""
    a, path = scratch(spark, "tsv"), scratch(spark, "round")
    short = F.when(F.col("row_no") % 6 == 0, F.regexp_replace("name", " - [0-9]+ stuks", "")).otherwise(F.col("name"))
    rows = D.feed_text(spark, sf).select("*", short.alias("title"), F.col("shop").cast("string").alias("seller")).drop("name", "shop")
    rows.write.options(header=True, sep="\t", quote='"', escape='"', emptyValue="", compression="gzip").csv(a)
    source, _ = FE.read_feeds(spark, [{"id": "a", "shop": "all", "path": a, "format": "csv", "delimiter": "\t", "keep": ["seller", "row_no"]}], ["all"])
    fed = FE.usable(source).drop("shop", "feed").withColumns({"shop": F.col("seller").cast("long"), "row_no": F.col("row_no").cast("long")}).drop("seller")
    fed = saved(spark, fed, "feed")
    catalog = D.catalog(spark, sf)
    offers = R.feed_offers(fed, catalog, D.shops(spark, sf), "row_no")
    offers = saved(spark, offers, "offers")
    before = offers.select("product", "shop", F.when(F.col("product") % 4 == 0, D.ean13("201", F.col("product"))).otherwise(D.ean13("200", F.col("product"))).alias("gtin"))
    at = F.lit("2001-06-29 08:00:00").cast("timestamp")
    identity = before.select("product", "shop", at.alias("first_seen"), at.alias("last_seen"), G.normalize_gtin("gtin").alias("gtin"), F.lit(None).cast("string").alias("sku"), F.lit(None).cast("double").alias("amount"))
    identity.write.parquet(f"{R.state_path(path, 'identity')}/round=20010629080000000")
    payload, _, _ = R.run_round(offers, catalog, path, F.lit("2001-06-30 08:00:00").cast("timestamp"), order=[F.col("row_no")], shops=D.shops(spark, sf))
    return path, payload


@query(
    sql(CATALOG, SOLD, MATCHED, ROUND, VERIFIED, then="""
SELECT 'history' AS kind, product, shop, printf('%.2f', price) AS value FROM one
UNION ALL SELECT 'resolved', product, shop, url FROM one
UNION ALL SELECT 'identity', product, shop, concat_ws('|', coalesce('0' || kept.gtin_text, '0' || before_gtin), coalesce(kept.sku, '-'), CASE WHEN kept.gtin_text <> before_gtin THEN '0' || before_gtin ELSE '' END,
  CASE WHEN kept.product IS NULL THEN 29 ELSE 30 END) FROM prev LEFT JOIN kept USING (product, shop)
UNION ALL SELECT 'head', NULL, NULL, concat_ws('|', (SELECT count(*) FROM part), count(DISTINCT product), count(*), count(DISTINCT shop), count(*) FILTER (verification = 'exact')) FROM kept
UNION ALL SELECT 'site', NULL, shop, 'https://shop' || shop || '.example' FROM (SELECT DISTINCT shop FROM kept)
UNION ALL SELECT 'report', NULL, NULL, concat_ws('|', 'true', (SELECT count(*) FROM part), count(*), (SELECT count(*) FROM supplier)) FROM kept""")
)
def e2_round_state(spark, sf):
    """What the same round leaves: every price seen, resolved pages, identities with their changes, and the heads of payload and report."""
    path, _ = played_round(spark, sf)
    none, text = F.lit(None).cast("long"), lambda *c: F.concat_ws("|", *c)
    row = lambda df, kind, product, shop, value: df.select(F.lit(kind).alias("kind"), product.alias("product"), shop.alias("shop"), value.alias("value"))
    key = (F.col("product"), F.col("shop"))
    R.compact(spark, path, "identity")
    identity = text(F.col("gtin"), F.coalesce("sku", F.lit("-")), F.array_join(F.transform(F.coalesce("changes", F.array()), lambda c: c["from_gtin"]), ","), F.dayofmonth("last_seen"))
    top, (report, _) = P.read_head(spark, path), R.read_report(spark, path)
    parts = [
        row(R.read_state(spark, path, "history"), "history", *key, F.format_string("%.2f", "p")),
        row(R.read_state(spark, path, "resolved").where("source = 'feed' AND failures = 0"), "resolved", *key, F.col("url")),
        row(R.read_state(spark, path, "identity"), "identity", *key, identity),
        row(top, "head", none, none, text(*[F.col(f"stats.{c}") for c in ("products", "products_with_offers", "offers", "shops", "verified_offers")])),
        row(top.select(F.explode("shops").alias("s")), "site", none, F.col("s.shop").cast("long"), F.col("s.site")),
        row(report, "report", none, none, text(F.col("published"), F.col("product_count"), F.col("offer_count"), F.size("shops"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- configuration, gates ---


@query(sql(CATALOG, then="SELECT CAST(product AS VARCHAR) AS product, name, brand, category, size, CASE WHEN listed THEN own END AS first_gtin, CAST(len(string_split(name, ' ')) AS INTEGER) AS n_must FROM catalog"))
def s6_catalog_document(spark, sf):
    """The catalog written as JSON documents of nested products, one for each category, and read with the fixed schema."""
    path = scratch(spark, "catalog")
    c = D.catalog(spark, sf)
    p = F.struct(F.col("product").cast("string").alias("id"), "name", "brand", "category", "size", "query", F.struct("must", "none").alias("match"), F.when(F.size("gtins") > 0, F.col("gtins")).alias("gtins"))
    c.groupBy((F.col("product") % 50).alias("g")).agg(F.collect_list(p).alias("products")).select("products").write.option("maxRecordsPerFile", 1).json(path)
    return CF.read_catalog(spark, path).select("product", "name", "brand", "category", "size", F.try_element_at("gtins", F.lit(1)).alias("first_gtin"), F.size("must").alias("n_must"))


@query("SELECT 'product' AS kind, p_partkey AS id FROM part UNION ALL SELECT 'shop', s_suppkey FROM supplier WHERE s_suppkey % 10 <> 9")
def p1_scope(spark, sf):
    """All products and the enabled shops, as two kinds of rows."""
    p, s = CF.scope(D.catalog(spark, sf), D.shops(spark, sf))
    return p.select(F.lit("product").alias("kind"), F.col("product").alias("id")).unionByName(s.select(F.lit("shop").alias("kind"), F.col("shop").alias("id")))


also("p1_scope_all", p1_scope)


@query(sql(CATALOG, OFFERS, then="SELECT product, shop, ord, price, coalesce(NOT listed OR gtin_text IS NULL OR gtin_text = own, true) AS allowed FROM offers JOIN catalog USING (product)"))
def p4_gtin_gate(spark, sf):
    j = D.offers(spark, sf).join(D.catalog(spark, sf).select("product", "gtins", "strict"), "product")
    return j.select("product", "shop", "ord", "price", O.gtin_allowed(F.col("strict"), F.col("gtins"), F.col("gtin_text")).alias("allowed"))


@query(sql(CATALOG, OFFERS, ONE, VERIFIED, ROWS, then="SELECT product, shop, brand, size, unit_price, monthly, verification FROM cmp"))
def j8_comparison_rows(spark, sf):
    return comparison(spark, sf).select("product", "shop", "brand", "size", "unit_price", "monthly", "verification")


# --- work list, pages of shops, cache ---


def whole_products(spark, sf):
    """Products with a list of shops (every third), others for all; a pinned link for every hundredth."""
    some = F.when(F.col("product") % 3 == 0, F.array(F.col("product") % 10, F.lit(9).cast("long")))
    return D.catalog(spark, sf).select("product", some.alias("shops"), F.when(F.col("product") % 100 == 0, F.create_map(F.lit("9"), F.lit("https://pinned.example"))).alias("links"))


WORK = """
prod AS (SELECT p_partkey AS product, p_partkey % 3 = 0 AS listed_shops FROM part),
listed_shop AS (SELECT product, unnest([product % 10, 9]) AS shop FROM prod WHERE listed_shops),
work AS (SELECT product, shop, CASE WHEN product % 100 = 0 AND shop = 9 THEN 'https://pinned.example' END AS link
  FROM (SELECT product, s_suppkey AS shop FROM prod, supplier WHERE NOT listed_shops UNION ALL SELECT product, shop FROM listed_shop JOIN supplier ON s_suppkey = shop)
  WHERE shop % 10 <> 9 OR (product % 100 = 0 AND shop = 9))"""


@query(sql(WORK, then="SELECT * FROM work"))
def j3_work_list(spark, sf):
    return O.work_list(whole_products(spark, sf), D.shops(spark, sf).select("shop", "enabled"))


also("j3_work_list_all", j3_work_list)


@query(sql(OFFERS, WORK, then="SELECT * FROM work w WHERE NOT EXISTS (SELECT 1 FROM offers o WHERE o.source = 'feed' AND o.product = w.product AND o.shop = w.shop)"))
def j4_not_in_feeds(spark, sf):
    return O.work_not_covered(whole_products(spark, sf), D.shops(spark, sf).select("shop", "enabled"), D.offers(spark, sf).where("source = 'feed'"))


also("j4_not_in_feeds_all", j4_not_in_feeds)


@query(
    sql(CATALOG, OFFERS, ONE, VERIFIED, WORK, then="""
SELECT shop, count(*) AS wanted, count(*) FILTER (v.product IS NOT NULL) AS found, count(*) FILTER (v.gtin IS NOT NULL) AS with_gtin, round(count(*) FILTER (v.product IS NOT NULL) / count(*), 4) AS ratio
FROM work w LEFT JOIN kept v USING (product, shop) GROUP BY shop""")
)
def a12_coverage(spark, sf):
    return P.catalog_coverage(whole_products(spark, sf), D.shops(spark, sf).select("shop", "enabled"), kept_offers(spark, sf))


also("a12_coverage_all", a12_coverage)


@query(
    sql(CATALOG, OFFERS, ONE, VERIFIED, PREVIOUS, then="""
SELECT shop, count(*) FILTER (type LIKE 'gtin-%' OR type LIKE 'verpakking-%') AS identity, count(*) FILTER (type = 'missing') AS missing FROM (
SELECT shop, 'gtin-niet-in-catalogus' AS type FROM ver WHERE verification = 'afwijkend'
UNION ALL SELECT shop, 'gtin-gewijzigd' FROM ver JOIN prev USING (product, shop) WHERE before_gtin <> gtin_text
UNION ALL SELECT shop, 'verpakking-wijkt-af' FROM (SELECT *, first_value(amount) OVER (PARTITION BY product, gtin ORDER BY shop) AS f FROM ver WHERE gtin IS NOT NULL) WHERE f <> amount
UNION ALL SELECT shop, 'missing' FROM one WHERE gtin_text IS NULL) GROUP BY shop""")
)
def a12_problem_report(spark, sf):
    v = V.with_changes(verified_offers(spark, sf), previous(spark, sf))
    missing = v.where("gtin IS NULL").select("product", "shop", F.lit("missing").alias("type"))
    return P.problem_report(V.issues(v).drop("message").unionByName(missing))


OUTCOMES = """
old AS (SELECT DISTINCT product, shop, 'https://old.example/' || product AS url, 'old ' || product AS title, TIMESTAMP '2001-06-01 08:00:00' AS resolved_at, 'zoek' AS source, CAST(product % 3 AS INTEGER) AS failures FROM offers WHERE source = 'page'),
res AS (SELECT DISTINCT product, shop, CASE WHEN product % 4 = 0 THEN 'https://new.example/' || product END AS url, 'new ' || product AS title, TIMESTAMP '2001-06-30 08:00:00' AS resolved_at, 'feed' AS source,
  CASE product % 4 WHEN 1 THEN 'pagina past niet meer' WHEN 2 THEN 'HTTP 500' END AS error FROM offers WHERE source = 'feed')"""


def cache_tables(spark, sf):
    o, p = D.offers(spark, sf), F.col("product")
    at = lambda t: F.lit(t).cast("timestamp")
    old = o.where("source = 'page'").select("product", "shop").distinct().select("product", "shop", F.concat(F.lit("https://old.example/"), p).alias("url"), F.concat(F.lit("old "), p).alias("title"), at("2001-06-01 08:00:00").alias("resolved_at"), F.lit("zoek").alias("source"), (p % 3).cast("int").alias("failures"))
    error = F.when(p % 4 == 1, "pagina past niet meer").when(p % 4 == 2, "HTTP 500")
    out = o.where("source = 'feed'").select("product", "shop").distinct().select("product", "shop", F.when(p % 4 == 0, F.concat(F.lit("https://new.example/"), p)).alias("url"), F.concat(F.lit("new "), p).alias("title"), at("2001-06-30 08:00:00").alias("at"), F.lit("feed").alias("source"), error.alias("error"))
    return old, out


@query(
    sql(OFFERS, OUTCOMES, then="""
SELECT product, shop, coalesce(res.url, old.url) AS url, CASE WHEN res.url IS NOT NULL THEN res.title ELSE old.title END AS title, CASE WHEN res.url IS NOT NULL THEN res.resolved_at ELSE old.resolved_at END AS resolved_at,
  CASE WHEN res.url IS NOT NULL THEN res.source ELSE old.source END AS source, CASE WHEN res.url IS NOT NULL THEN 0 WHEN res.product IS NOT NULL THEN coalesce(failures, 0) + 1 ELSE failures END AS failures
FROM old FULL JOIN res USING (product, shop) WHERE coalesce(res.url, old.url) IS NOT NULL AND NOT (res.product IS NOT NULL AND res.url IS NULL AND (coalesce(error LIKE '%past niet meer%', false) OR coalesce(failures, 0) + 1 >= 3))""")
)
def d3_resolved_cache(spark, sf):
    return O.merge_resolved(*cache_tables(spark, sf))


def product_pages(spark, sf):
    """Product pages built from part: JSON-LD with prices as numbers, meta elements or an attribute in turn."""
    p = D.spread(D.table(spark, sf, "part"))
    k, price = F.col("p_partkey"), F.format_string("%.2f", F.col("p_retailprice"))
    ean = D.ean13("200", k)
    title = F.concat_ws(" ", "p_brand", "p_name", F.lit("maat"), F.col("p_size").cast("string"), F.lit("- 44 stuks"))
    data = F.concat(
        F.lit('<script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":"Product","name":"'), title, F.lit('","sku":"S'), k, F.lit('","gtin13":"'), ean,
        F.lit('","offers":[{"price":'), F.format_string("%.2f", F.col("p_retailprice") + 5), F.lit('},{"price":'), price, F.lit(',"priceCurrency":"eur","availability":"https://schema.org/InStock"}]}]}</script>'),
    )
    meta = F.concat(F.lit('<meta property="og:title" content="'), title, F.lit('"><meta content="'), F.replace(price, F.lit("."), F.lit(",")), F.lit('" property="product:price:amount"><meta property="product:availability" content="out of stock"><td>EAN: '), ean, F.lit("</td>"))
    plainest = F.concat(F.lit("<title>"), title, F.lit('</title><div data-price="'), price, F.lit('"></div>'))
    body = F.when(k % 3 == 0, data).when(k % 3 == 1, F.regexp_replace(meta, "out of stock", "outofstock")).otherwise(plainest)
    return p.select(k.alias("product"), F.concat(F.lit("https://shop"), k % 10, F.lit(".example/p/"), k).alias("url"), F.concat(F.lit("<html>"), body, F.lit("</html>")).alias("html"))


@query(
    f"""SELECT p_partkey AS product, p_brand || ' ' || p_name || ' maat ' || p_size || ' - 44 stuks' || CASE WHEN p_partkey % 15 = 6 THEN ' ?' ELSE '' END AS title,
  {half_up("p_retailprice + CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 7 * 1000 ELSE 0 END", 2)} AS page_price, 'EUR' AS currency,
  CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS in_stock, 44.0::DOUBLE AS amount, CASE WHEN p_partkey % 3 < 2 THEN '0' || {ean13("200", "p_partkey")} END AS page_gtin,
  CASE WHEN p_partkey % 3 = 0 THEN 'S' || p_partkey END AS sku, CASE WHEN p_partkey % 15 = 9 THEN 'https://shop.example/' || p_partkey || '.png' END AS image,
  CASE p_partkey % 3 WHEN 0 THEN 'json-ld' WHEN 1 THEN 'meta' ELSE 'attribute' END AS page_source FROM part"""
)
def u1_product_pages(spark, sf):
    """Prices up to 8,000 as JSON numbers. Of every 15 pages one each has a block nested 3,000 lists deep, a name with half a surrogate pair, an image list inside an object, and a block that breaks off."""
    k, h = F.col("product"), F.col("html")
    pages = product_pages(spark, sf)
    more = F.when(k % 3 == 0, k % 7 * 1000).otherwise(0)
    dearer = F.regexp_replace(h, r'"price":([0-9.]+)\},\{"price":([0-9.]+)', F.concat(F.lit('"price":$1},{"price":"none"},{"price":'), F.format_string("%.2f", F.regexp_extract(h, r'\},\{"price":([0-9.]+)', 1).try_cast("double") + more)))
    dearer = F.when((k % 3 == 0) & (more > 0), F.replace(dearer, F.concat(F.lit('"price":'), F.regexp_extract(h, r'"price":([0-9.]+)', 1), F.lit("}")), F.lit('"price":9999}'))).otherwise(h)
    deep = F.concat(F.lit('<script type="application/ld+json">'), F.repeat(F.lit("["), 3000), F.lit("</script>"), h)
    broken = F.concat(F.lit('<script type="application/ld+json">{"@type":"Product","name":"cut</script>'), h)
    html = (
        F.when(k % 15 == 3, deep).when(k % 15 == 12, broken).when(k % 15 == 6, F.regexp_replace(h, "- 44 stuks", "- 44 stuks \\\\ud83d"))
        .when(k % 15 == 9, F.replace(h, F.lit('"sku"'), F.concat(F.lit('"image":{"url":["https://shop.example/'), k, F.lit('.png"]},"sku"')))).otherwise(h)
    )
    facts = PG.product_facts(pages.withColumn("html", dearer).withColumn("html", html))
    return facts.select("product", "title", "page_price", "currency", "in_stock", "amount", "page_gtin", "sku", "image", "page_source")


def page_checks(spark, sf):
    """What each product page confirms: its own product, unless its number ends in a way that the product forbids."""
    f = PG.product_facts(product_pages(spark, sf)).withColumnRenamed("page_price", "price")
    c = D.catalog(spark, sf).select("product", "gtins", "strict", "must", "none", "brand", "size", "match_pack")
    j = f.join(c, "product")
    rules = {"plain_title": T.plain("title"), "must": F.transform("must", T.plain), "none": F.transform("none", T.plain), "brand": T.plain("brand"), "size": F.col("size"), "pack": F.col("match_pack")}
    fits = MA.verdict(F.col("title"), rules) == "ok"
    facts = ["title", "currency", "in_stock", "amount", "unit", "sku", "mpn"]
    return j.select("product", "url", "price", fits.alias("fits"), O.gtin_allowed(F.col("strict"), F.col("gtins"), F.col("page_gtin")).alias("allowed"), F.col("page_gtin").alias("gtin"), *facts)


@query(
    f"""WITH cand AS (SELECT p_partkey AS product, p_partkey % 10 AS shop, p_partkey + d AS target, 10 - d AS score FROM part, (VALUES (0), (10), (20), (30)) t(d)),
top3 AS (SELECT *, row_number() OVER (PARTITION BY product, shop ORDER BY score DESC) AS rn FROM cand)
SELECT product, shop, 'https://shop' || (target % 10) || '.example/p/' || target AS url, CAST(rn AS INTEGER) AS rn, {half_up("p_retailprice", 2)} AS price FROM top3 JOIN part ON p_partkey = target
WHERE rn <= 3 AND p_partkey % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY product, shop ORDER BY rn) = 1"""
)
def k3_confirmed_candidates(spark, sf):
    """The best three of four candidates each; pages of every fourth product don't confirm."""
    p = D.table(spark, sf, "part").select(F.col("p_partkey").alias("product"), (F.col("p_partkey") % 10).alias("shop"), F.explode(F.array(*[F.lit(d) for d in (0, 10, 20, 30)])).alias("d"))
    target = F.col("product") + F.col("d")
    cand = p.select("product", "shop", F.concat(F.lit("https://shop"), target % 10, F.lit(".example/p/"), target).alias("url"), (10 - F.col("d")).alias("score"))
    checks = page_checks(spark, sf)
    pages = checks.select("url", "price", (F.col("fits") & F.col("allowed") & F.col("price").isNotNull() & (F.col("product") % 4 != 0)).alias("confirmed"))
    return MA.confirmed_candidates(cand, pages).select("product", "shop", "url", F.col("rn").cast("int").alias("rn"), "price")


@query(
    f"""WITH w AS (SELECT p_partkey AS product, p_partkey % 10 AS shop, * FROM part)
SELECT product, shop, CASE WHEN product % 2 = 0 THEN 'https://shop' || shop || '.example/p/' || product WHEN product % 5 = 0 THEN 'https://again.example' END AS url,
  CASE WHEN product % 2 = 0 THEN {half_up("p_retailprice", 2)} WHEN product % 5 = 0 THEN 1.0::DOUBLE END AS price,
  CASE WHEN product % 2 = 0 THEN p_brand || ' ' || p_name || ' maat ' || p_size || ' - 44 stuks' WHEN product % 5 = 0 THEN 'again' END AS title,
  CASE WHEN product % 2 = 0 AND product % 3 < 2 THEN '0' || {ean13("200", "product")} END AS gtin, CASE WHEN product % 6 = 0 THEN 'S' || product END AS sku, CAST(NULL AS VARCHAR) AS mpn,
  CASE WHEN product % 2 = 0 THEN 'EUR' END AS currency, CASE WHEN product % 2 = 0 THEN CASE product % 3 WHEN 0 THEN true WHEN 1 THEN false END END AS in_stock,
  CASE WHEN product % 2 = 0 THEN 44.0::DOUBLE END AS amount, CASE WHEN product % 2 = 0 THEN 'stuk' END AS unit,
  CASE WHEN product % 2 <> 0 AND product % 5 <> 0 THEN 'pagina niet gevonden; geen passend resultaat' END AS error, product % 2 = 0 AS from_known FROM w"""
)
def j5_known_pages(spark, sf):
    """Even products have a page that still fits, others one that is gone; every fifth is found again elsewhere."""
    c = D.catalog(spark, sf).select("product", (F.col("product") % 10).alias("shop"))
    url = F.concat(F.lit("https://shop"), F.col("product") % 10, F.lit(".example/"), F.when(F.col("product") % 2 == 0, "p/").otherwise("gone/"), F.col("product"))
    work = c.withColumn("link", F.when(F.col("product") % 4 == 0, url))
    resolved = c.select("product", "shop", url.alias("url"))
    again = c.where("product % 5 = 0").select("product", "shop", F.lit("https://again.example").alias("url"), F.lit(1.0).alias("price"), F.lit("again").alias("title"))
    return O.known_page_offers(work, resolved, page_checks(spark, sf).drop("product"), again)


@query(sql(OFFERS, then="SELECT product, shop, ord, price, source, CASE WHEN source = 'page' THEN in_stock END AS in_stock FROM offers"))
def d1_union_of_sources(spark, sf):
    """Every offer of both sources; the feeds' side has no stock column here."""
    o = D.offers(spark, sf)
    both = O.union_sources(o.where("source = 'feed'").drop("source", "in_stock"), o.where("source = 'page'").drop("source"))
    return both.select("product", "shop", "ord", "price", "source", "in_stock")


# --- crawled pages ---


ENT = "replace(replace(replace(replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&euro;', '€'), '&nbsp;', ' '), '&lt;', '<'), '&amp;', '&')"
HREF = r"""regexp_extract_all(html, '(?i)<a\b[^>]*href\s*=\s*["'']([^"'']+)["'']', 1)"""
TARGET = r"""CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN split_part(url, ':', 1) || ':' || href
  WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href ELSE regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([a-z]+://[^/]*(?:/.*/|/)?)', 1) || href END"""
LINKS = f"""
l0 AS (SELECT page_id, url, unnest(list_transform({HREF}, lambda x: trim({ENT.format("x")}))) AS href, unnest(range(len({HREF}))) AS i FROM pages),
l1 AS (SELECT page_id, url, href, min(i) AS i FROM l0 WHERE href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(href, 'javascript:') GROUP BY ALL),
links AS (SELECT page_id, url, href, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos FROM l1),
full_links AS (SELECT *, {TARGET} AS target FROM links)"""


@query(sql(LINKS, then="SELECT page_id, CAST(pos AS INTEGER) AS pos, href FROM links"))
def u3_links(spark, sf):
    """With line breaks, tabs and no-break spaces put around every href: they change nothing."""
    spaced = F.regexp_replace("html", "href=\"([^\"]*)\"", "href=\"\n\t$1\u00a0\r\n\"")
    return PG.links(D.table(spark, sf, "pages").withColumn("html", spaced)).select("page_id", "pos", "href")


@query(f"SELECT page_id, trim(regexp_replace({ENT.format(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '\\s+', ' ', 'g')) AS title FROM pages".replace("\\\\", "\\"))
def u5_page_titles(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", T.page_title("html").alias("title"))


TAGS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript>', ' ', 'g'), '<[^>]+>', ' ', 'g')"


@query(f"SELECT page_id, trim(regexp_replace({ENT.format(TAGS)}, '[\\s\u00a0]+', ' ', 'g')) AS text FROM pages".replace("\\\\", "\\"))
def c8_visible_text(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", T.strip_tags("html").alias("text"))


@query(r"""WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 1 THEN regexp_replace(url, '://', '://my_') WHEN 2 THEN url || '/a|b' WHEN 3 THEN url || '/p/[x]' WHEN 4 THEN regexp_replace(url, '(://[^/]*)', '\1/50%korting') WHEN 5 THEN 'shop ' || url ELSE url END AS url FROM pages)
SELECT page_id, CASE WHEN page_id % 6 <> 5 THEN regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\.', '') END AS host, CASE WHEN page_id % 6 <> 5 THEN coalesce(nullif(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), ''), '/') END AS path FROM u""")
def c10_url_parts(spark, sf):
    """Five of six URLs with an underscore in the host, a bar, brackets or a percent sign in the path, or a blank before them, which makes them no URL."""
    k, u = F.col("page_id") % 6, F.col("url")
    odd = F.when(k == 1, F.regexp_replace(u, "://", "://my_")).when(k == 2, F.concat(u, F.lit("/a|b"))).when(k == 3, F.concat(u, F.lit("/p/[x]"))).when(k == 4, F.regexp_replace(u, "(://[^/]*)", "$1/50%korting")).when(k == 5, F.concat(F.lit("shop "), u)).otherwise(u)
    return D.table(spark, sf, "pages").select("page_id", T.url_host(odd).alias("host"), T.url_path(odd).alias("path"))


def sites(spark, sf):
    p = D.table(spark, sf, "pages")
    return p.select(T.url_host("url").alias("host")).distinct().select(F.col("host").alias("shop"), "host", F.lit("^/[A-Za-z]").alias("path_pattern"))


ANCHOR = """'(?is)<a\\b([^>]*)href\\s*=\\s*["'']([^"'']+)["'']([^>]*)>(.{0,600}?)</a>'"""
HOST = "regexp_replace(lower(regexp_extract({}, '://([^/?#:]*)', 1)), '^www\\.', '')"
SLUG = r"coalesce(trim(regexp_replace(regexp_replace(list_filter(string_split(regexp_replace(regexp_replace(target, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '/'), lambda x: x <> '' AND NOT regexp_full_match(x, '\\d+') AND x <> 'p')[-1], '(?i)\\.html?$', ''), '[-_]+', ' ', 'g')), '')"


@query(
    sql(LINKS, then=f"""
, a0 AS (SELECT page_id, url, unnest(regexp_extract_all(html, {ANCHOR}, 1)) AS a1, unnest(regexp_extract_all(html, {ANCHOR}, 2)) AS h0, unnest(regexp_extract_all(html, {ANCHOR}, 3)) AS a3,
  unnest(regexp_extract_all(html, {ANCHOR}, 4)) AS html, unnest(range(len(regexp_extract_all(html, {ANCHOR}, 1)))) AS pos FROM pages),
a1 AS (SELECT page_id, url, pos, trim({ENT.format("h0")}) AS href, trim(regexp_replace({ENT.format(TAGS)}, '[\\s ]+', ' ', 'g')) AS t1,
  trim({ENT.format("regexp_extract(a1 || a3, '(?i)title" + chr(92) + "s*=" + chr(92) + "s*[" + chr(34) + chr(39) * 2 + "]([^" + chr(34) + chr(39) * 2 + "]+)[" + chr(34) + chr(39) * 2 + "]', 1)")}) AS t2 FROM a0),
a2 AS (SELECT *, {TARGET} AS target FROM a1),
both_ AS (SELECT page_id, false AS bare, pos, target, t1, t2 FROM a2 UNION ALL SELECT page_id, true, pos, target, '', '' FROM full_links),
f AS (SELECT *, {HOST.format("target")} AS host, {SLUG} AS slug FROM both_ WHERE regexp_matches(target, '^https?:') AND regexp_matches(regexp_extract(target, '://[^/?#]*([^?#]*)', 1), '^/[A-Za-z]')),
g AS (SELECT * FROM f WHERE host IN (SELECT {HOST.format("url")} FROM pages) QUALIFY bare = min(bare) OVER (PARTITION BY page_id, host)),
t AS (SELECT *, CASE WHEN len(t1) >= greatest(len(t2), len(slug), 4) THEN t1 WHEN len(t2) >= greatest(len(slug), 4) THEN t2 ELSE slug END AS title FROM g)
SELECT host AS shop, regexp_replace(target, '[?#].*$', '') AS url, arg_max(title, struct_pack(a := len(title), b := -page_id, c := -pos)) AS title FROM t GROUP BY ALL""".strip()).replace("\n, a0", ", a0")
)
def u4_candidates(spark, sf):
    """Every URL that a shop's pattern lets through, with its longest title."""
    return PG.candidates(D.table(spark, sf, "pages"), sites(spark, sf)).select("shop", "url", "title")


also("u4_candidate_titles", u4_candidates)


@query(
    r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\.', '') AS own, page_id % 40 AS k FROM pages),
t AS (SELECT page_id, own, 'partner' || k || '.example' AS host, 1 AS pos, 'https://www.partner' || k || '.example/from/' || page_id AS target FROM h)
SELECT host, count(*) AS links, arg_min(target, struct_pack(a := page_id, b := pos)) AS sample FROM t WHERE host <> own GROUP BY host ORDER BY links DESC, host LIMIT 25"""
)
def a11_outbound_hosts(spark, sf):
    """Each page with a link to a partner appended; its own links stay on its host."""
    partner = F.concat(F.lit('<a class=x href="https://www.partner'), F.col("page_id") % 40, F.lit(".example/from/"), F.col("page_id"), F.lit('">p</a>'))
    return PG.outbound_hosts(D.table(spark, sf, "pages").withColumn("html", F.concat("html", partner)))


ROBOTS = "User-agent:\t*\nDisallow:\t/en/\n\u00a0Allow\t:\u00a0/en/1\t\r\nDisallow: /*.html$\t# pages\nCrawl-delay: 2,5\n\nUser-agent: OtherBot\nDisallow: /\n# end"


@query(
    r"""WITH p AS (SELECT page_id AS url_id, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\.', '') AS host, coalesce(nullif(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM pages)
SELECT url_id, host, path, CASE WHEN regexp_matches(path, '^/.*\.html$') THEN NOT (starts_with(path, '/en/') OR true) WHEN starts_with(path, '/en/1') THEN true WHEN starts_with(path, '/en/') THEN false ELSE true END AS allowed
FROM (SELECT * FROM p)"""
)
def j7_robots(spark, sf):
    """The same robots file on every host of pages; it is parsed once for each host."""
    urls = D.table(spark, sf, "pages").select(F.col("page_id").alias("url_id"), T.url_host("url").alias("host"), T.url_path("url").alias("path"))
    files = urls.select("host").distinct().withColumn("body", F.lit(ROBOTS))
    return PG.allowed(urls, PG.robots_rules(files), "PriceBot/1.0")


@query(r"SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS plain FROM documents")
def c5_plain_text(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", T.plain("text").alias("plain"))


def wrong_digit(e: Column) -> Column:
    """A 13-digit number with another last digit, which makes it invalid."""
    return F.concat(F.substring(e, 1, 12), ((F.substring(e, 13, 1).cast("int") + 1) % 10).cast("string"))


@query(f"SELECT p_partkey AS product, '0' || {ean13('200', 'p_partkey')} AS gtin, {ean13('200', 'p_partkey')} AS shown, false AS bad FROM part")
def c3_gtins(spark, sf):
    """Valid numbers survive; with the last digit changed they don't."""
    p = D.table(spark, sf, "part").select(F.col("p_partkey").alias("product"), D.ean13("200", F.col("p_partkey")).alias("e"))
    return p.select("product", G.normalize_gtin("e").alias("gtin"), G.display_gtin(G.normalize_gtin("e")).alias("shown"), G.is_valid_gtin(wrong_digit(F.col("e"))).alias("bad"))


# --- quality ---


def faulty_catalog(spark, sf):
    """The catalog with faults in some rows, so that every rule has something to find."""
    c, k = D.catalog(spark, sf), F.col("product")
    return c.select(
        F.when(k == 1, F.lit(2)).otherwise(k).cast("long").alias("product"),
        F.when(k % 50 == 1, "").otherwise(F.col("name")).alias("name"),
        "brand",
        F.when(k % 50 == 2, F.when(k % 100 == 2, "")).when(k % 50 == 3, "NOPE").otherwise(F.col("category")).alias("category"),
        "size", "none", "match_pack",
        F.when(k % 50 == 4, F.lit("")).otherwise(F.col("query")).alias("query"),
        F.when(k % 50 == 5, F.array().cast("array<string>")).when(k % 50 == 6, F.array(F.lit("absent"))).otherwise(F.col("must")).alias("must"),
        F.when(k % 50 == 7, F.array(wrong_digit(D.ean13("200", k)))).when(k % 50 == 10, F.array().cast("array<string>")).otherwise(F.col("gtins")).alias("gtins"),
        (k % 5 == 0).alias("gtins_given"),
        F.when(k % 50 == 11, F.create_map(F.lit(-7).cast("long"), F.lit("https://nowhere.example"))).alias("links"),
        F.when(k % 50 == 8, F.lit(True)).alias("strict"),
        F.when(k % 50 == 9, F.array(F.lit(-1).cast("long"))).alias("shops"),
    )


def with_own_size(c):
    return c.withColumn("name", F.when(F.col("name") != "", F.concat_ws(" ", "brand", "name", F.lit("maat"), "size")).otherwise(F.col("name")))


@query(
    r"""WITH c AS (SELECT CASE WHEN p_partkey = 1 THEN 2 ELSE p_partkey END AS subject, p_partkey % 50 AS m, p_partkey AS k FROM part)
SELECT CAST(subject AS VARCHAR) AS subject, rule, level FROM (
SELECT subject, 'duplicate id' AS rule, 'error' AS level FROM c GROUP BY subject HAVING count(*) > 1
UNION ALL SELECT subject, 'empty list of article numbers', 'warning' FROM c WHERE m = 10 UNION ALL SELECT subject, 'link to an unknown shop', 'error' FROM c WHERE m = 11
UNION ALL SELECT subject, 'no name', 'error' FROM c WHERE m = 1 UNION ALL SELECT subject, 'no category', 'error' FROM c WHERE m = 2 UNION ALL SELECT subject, 'unknown category', 'error' FROM c WHERE m = 3
UNION ALL SELECT subject, 'no query', 'warning' FROM c WHERE m = 4 UNION ALL SELECT subject, 'no required words', 'warning' FROM c WHERE m = 5 UNION ALL SELECT subject, 'own name fails its rules', 'error' FROM c WHERE m = 6
UNION ALL SELECT subject, 'invalid article number', 'error' FROM c WHERE m = 7 UNION ALL SELECT subject, 'strict without a list', 'error' FROM c WHERE m = 8 UNION ALL SELECT subject, 'unknown shop', 'error' FROM c WHERE m = 9)"""
)
def d4_catalog_violations(spark, sf):
    c = with_own_size(faulty_catalog(spark, sf))
    categories = D.catalog(spark, sf).select("category").distinct()
    return Q.catalog_violations(c, categories, D.shops(spark, sf).select("shop"))


@query(
    r"""SELECT CAST(subject AS VARCHAR) AS subject, rule, level FROM (
SELECT CAST(s_suppkey AS VARCHAR) AS subject, 'no name' AS rule, 'error' AS level FROM supplier WHERE s_suppkey % 20 = 1 UNION ALL SELECT s_suppkey, 'no site', 'error' FROM supplier WHERE s_suppkey % 20 = 2
UNION ALL SELECT s_suppkey, 'search url without {q}', 'error' FROM supplier WHERE s_suppkey % 20 = 3 UNION ALL SELECT s_suppkey, 'products can''t be found', 'error' FROM supplier WHERE s_suppkey % 20 = 4
UNION ALL SELECT s_suppkey, 'browses without urls', 'warning' FROM supplier WHERE s_suppkey % 20 = 5
UNION ALL SELECT 'feed' || s_suppkey, 'no shop', 'error' FROM supplier WHERE s_suppkey % 20 = 6 UNION ALL SELECT 'feed' || s_suppkey, 'unknown shop', 'error' FROM supplier WHERE s_suppkey % 20 = 7
UNION ALL SELECT 'feed' || s_suppkey, 'no location', 'error' FROM supplier WHERE s_suppkey % 20 = 8 UNION ALL SELECT 'feed' || s_suppkey, 'location is a raw url', 'error' FROM supplier WHERE s_suppkey % 20 = 9
UNION ALL SELECT 'feed' || s_suppkey, 'unknown format', 'error' FROM supplier WHERE s_suppkey % 20 = 10
UNION ALL SELECT s_suppkey, 'invalid path pattern', 'error' FROM supplier WHERE s_suppkey % 20 = 11)"""
)
def d5_config_violations(spark, sf):
    s = D.shops(spark, sf)
    k = F.col("shop") % 20
    shops = s.select(
        "shop",
        F.when(k == 1, "").otherwise(F.col("shop_name")).alias("name"),
        F.when(k == 2, None).otherwise(F.col("site")).alias("site"),
        "enabled",
        F.when(k == 3, "https://x.example/?s=").when(k.isin(4, 5), "").otherwise("https://x.example/?s={q}").alias("search_url"),
        F.when(k == 4, F.array().cast("array<string>")).when(k == 5, F.array(F.lit("u"))).otherwise(F.array().cast("array<string>")).alias("browse_urls"),
        F.lit("search").alias("discovery"),
        F.when(k == 11, "^/p/(").when(k == 12, "").when(k == 13, r"^/(?<slug>[a-z-]+)/\d+").otherwise(r"^/p/\d+").alias("path_pattern"),
    )
    browsing = s.where("shop % 20 = 5").select("shop", F.lit("n").alias("name"), F.lit("s").alias("site"), "enabled", F.lit("{q}").alias("search_url"), F.array().cast("array<string>").alias("browse_urls"), F.lit("browse").alias("discovery"), F.lit(None).cast("string").alias("path_pattern"))
    feeds = s.select(
        F.concat(F.lit("feed"), "shop").alias("feed"),
        F.when(k == 6, "").when(k == 7, "-5").otherwise(F.col("shop").cast("string")).alias("shop"),
        F.when(k == 8, "").when(k == 9, "https://feeds.example/x").otherwise("FEED_URL").alias("location"),
        F.when(k == 10, "yaml").otherwise("csv").alias("format"),
    )
    found = Q.shop_violations(shops).unionByName(Q.shop_violations(browsing)).unionByName(Q.feed_violations(feeds, s.select(F.col("shop").cast("string").alias("shop"))))
    return found


# --- streams ---


def run_stream(started) -> None:
    started.awaitTermination()


EVENTS = "ev AS (SELECT ts, user_id AS shop, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product, value AS price, event_id AS tie FROM events)"


@query(sql(EVENTS, then="SELECT product, shop, CAST(ts AS DATE) AS d, arg_max(price, struct_pack(a := ts, b := tie)) AS p FROM ev GROUP BY ALL"))
def x2_stream_daily_points(spark, sf):
    """All events as a stream, written day by day once the watermark has passed, and one late day flushed by a last marker event."""
    path, out = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    events = ST.event_prices(D.table(spark, sf, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{path}/a")
    end = spark.range(1).select(F.lit("2100-01-01").cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("shop"), F.lit(-1).cast("long").alias("product"), F.lit(0.0).alias("price"), F.lit(-1).cast("long").alias("tie"))
    for part in (None, end):
        if part is not None:
            part.select(*events.columns).write.parquet(f"{path}/b")
        days = ST.daily_points(spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(path))
        run_stream(days.writeStream.format("parquet").option("path", f"{out}/t").option("checkpointLocation", f"{out}/c").outputMode("append").trigger(availableNow=True).start())
    return spark.read.parquet(f"{out}/t").where("shop >= 0")


@query(
    sql(EVENTS, then=f"""
, g AS (SELECT *, '0' || CASE WHEN tie % 7 = 0 THEN {ean13("201", "product")} ELSE {ean13("200", "product")} END AS gtin, lag(tie) OVER (PARTITION BY product, shop ORDER BY ts, tie) AS before, tie % 7 = 0 AS odd FROM ev),
ch AS (SELECT product, shop, '0' || CASE WHEN before % 7 = 0 THEN {ean13("201", "product")} ELSE {ean13("200", "product")} END AS a, gtin AS b, ts AS "at" FROM g WHERE before IS NOT NULL AND (before % 7 = 0) <> odd)
SELECT 'change' AS kind, product, shop, a, b, "at", CAST(NULL AS TIMESTAMP) AS since, CAST(NULL AS BIGINT) AS n FROM ch
UNION ALL SELECT 'identity', product, shop, arg_max(gtin, struct_pack(a := ts, b := tie)), 'S' || arg_max(tie, struct_pack(a := ts, b := tie)), max(ts), min(ts), (SELECT least(count(*), 5) FROM ch WHERE ch.product = g.product AND ch.shop = g.shop) FROM g GROUP BY product, shop""".strip()).replace("\n, g", ", g")
)
def x3_stream_gtin_changes(spark, sf):
    """Events in two runs of the stream, each with events from all times, so that the second run's are late by up to the watermark's delay; every seventh event shows another number.
    A marker far in the future lets the watermark pass. The changes, and the newest state of every key."""
    path, out = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    e = ST.event_prices(D.table(spark, sf, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    number = F.concat(F.lit("0"), F.when(F.col("tie") % 7 == 0, D.ean13("201", F.col("product"))).otherwise(D.ean13("200", F.col("product"))))
    e = e.select("product", "shop", number.alias("gtin"), F.concat(F.lit("S"), "tie").alias("sku"), F.lit(None).cast("double").alias("amount"), "ts", "tie")
    end = spark.range(1).selectExpr("-1L AS product", "-1L AS shop", "'x' AS gtin", "'x' AS sku", "CAST(NULL AS DOUBLE) AS amount", "TIMESTAMP '2100-01-01 00:00:00' AS ts", "-1L AS tie")
    state_store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(state_store)
    spark.conf.set(state_store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part, rows in (("a", e.where("tie % 3 = 0")), ("b", e.where("tie % 3 > 0")), ("c", end)):
            rows.write.parquet(f"{path}/{part}")
            tracked = ST.track_identities(spark.readStream.schema(e.schema).option("recursiveFileLookup", True).parquet(path), "4000 days")
            run_stream(tracked.writeStream.format("parquet").option("path", f"{out}/t").option("checkpointLocation", f"{out}/c").outputMode("append").trigger(availableNow=True).start())
    finally:
        spark.conf.set(state_store, before)
    t = spark.read.schema(ST.TRACKED).parquet(f"{out}/t").where("shop >= 0")
    none = F.lit(None)
    changes = t.where("kind = 'change'").select("kind", "product", "shop", F.col("from_gtin").alias("a"), F.col("to_gtin").alias("b"), "at", none.cast("timestamp").alias("since"), none.cast("long").alias("n"))
    last = t.where("kind = 'identity'").groupBy("kind", "product", "shop").agg(F.max_by(F.struct("gtin", "sku", "last_seen", "first_seen", F.size("changes").cast("long").alias("n")), "last_seen").alias("i"))
    return changes.unionByName(last.select("kind", "product", "shop", F.col("i.gtin").alias("a"), F.col("i.sku").alias("b"), F.col("i.last_seen").alias("at"), F.col("i.first_seen").alias("since"), "i.n"))


@query(sql(CATALOG, FEED, MATCHED, then="SELECT shop, product, price, score FROM matched QUALIFY row_number() OVER (PARTITION BY shop, product ORDER BY score DESC, price, row_no) = 1"))
def x1_stream_feed_ingest(spark, sf):
    """Feed rows as a stream of several batches: each is matched with the catalog, and the sink holds the best rows of all batches. The second batch breaks off after its write and is run again."""
    path, out = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    D.feed_text(spark, sf).repartition(6).write.parquet(path)
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 2).parquet(path)
    sink, broken = ST.best_sink(spark, f"{out}/best"), []

    def write(df: DataFrame, number: int) -> None:
        sink(df, number)
        if number == 1 and not broken:
            broken.append(number)
            raise RuntimeError("lost after the write")

    for _ in range(2):
        started = ST.ingest_feed(rows, D.catalog(spark, sf), write, f"{out}/c")
        try:
            run_stream(started)
        except StreamingQueryException:
            if not broken:
                raise
    return ST.read_best(spark, f"{out}/best").select("shop", "product", "price", "score")
