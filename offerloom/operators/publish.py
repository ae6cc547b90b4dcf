"""Ranked offers, product summaries, statistics, coverage and the published payload."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.functions import gtin as G


def rank_key() -> list[Column]:
    """In stock first (unknown counts as in stock), then unit price, price, shop; missing prices last. A total order."""
    out = F.coalesce(~F.col("in_stock"), F.lit(False))
    return [out, F.col("unit_price").asc_nulls_last(), F.col("price").asc_nulls_last(), F.col("shop")]


def rank_offers(offers: DataFrame) -> DataFrame:
    return offers.withColumn("rank", F.row_number().over(W.partitionBy("product").orderBy(*rank_key())))


def _rank_struct() -> Column:
    """The rank as one comparable value: min_by merges map-side, where a window would sort whole products."""
    far = F.lit(float("inf"))
    return F.struct(F.coalesce(~F.col("in_stock"), F.lit(False)).alias("a"), F.coalesce("unit_price", far).alias("b"), F.coalesce("price", far).alias("c"), F.col("shop").alias("d"))


def product_summary(offers: DataFrame, lows: DataFrame | None = None) -> DataFrame:
    """Per product: best offer's price, unit price and label, number of offers and of exact ones, reference, and the period's low."""
    best = F.min_by(F.struct("price", "unit_price", "unit_label", "shop"), _rank_struct())
    s = offers.groupBy("product").agg(
        best.alias("b"),
        F.count(F.lit(1)).alias("offers"),
        F.count_if(F.col("verification") == "exact").alias("verified_offers"),
        F.max("reference").alias("reference"),
        F.max("reference_source").alias("gtin_source"),
    )
    s = s.select(
        "product",
        F.col("b.price").alias("best_price"),
        F.col("b.unit_price").alias("best_unit_price"),
        F.col("b.unit_label").alias("unit_label"),
        F.col("b.shop").alias("best_shop"),
        "offers",
        "verified_offers",
        G.display_gtin("reference").alias("gtin"),
        "gtin_source",
    )
    return s if lows is None else s.join(lows.withColumnRenamed("lowest", "lowest30"), "product", "left")


def round_stats(catalog: DataFrame, offers: DataFrame) -> DataFrame:
    """One row: products, products with offers, offers, shops, exact offers. Both sides are reduced before they meet."""
    n = catalog.agg(F.count(F.lit(1)).alias("products")).withColumn("k", F.lit(1))
    o = offers.agg(F.count_distinct("product").alias("products_with_offers"), F.count(F.lit(1)).alias("offers"), F.count_distinct("shop").alias("shops"), F.count_if(F.col("verification") == "exact").alias("verified_offers"))
    return n.join(o.withColumn("k", F.lit(1)), "k").drop("k")


#: What the payload says of an offer, as far as it is known.
SHOWN = (
    "shop", "shop_name", "url", "price", "unit_price", "unit_label", "amount", "unit", "source", "in_stock", "title", "gtin", "sku", "verification", "gtin_changed",
)


def payload(catalog: DataFrame, offers: DataFrame, summary: DataFrame) -> DataFrame:
    """One row per product with its offers in rank order, numbers as shops show them. A product has at most one offer of a shop, which bounds the list."""
    shown = {"gtin": G.display_gtin("gtin")}
    cols = [shown.get(c, F.col(c)).alias(c) for c in SHOWN if c in offers.columns]
    nested = F.transform(F.array_sort(F.collect_list(F.struct(_rank_struct().alias("k"), F.struct(*cols).alias("o")))), lambda x: x["o"])
    lists = offers.groupBy("product").agg(nested.alias("offer_list"))
    more = [(F.col(c) if c in catalog.columns else F.lit(None)).cast("string").alias(c) for c in ("weight", "unit")]
    return catalog.select("product", "name", "brand", "category", "size", *more).join(summary, "product").join(lists, "product")


def new_version(spark: SparkSession) -> str:
    """A name for a round: later rounds have greater ones."""
    return spark.sql("select date_format(current_timestamp(), 'yyyyMMddHHmmssSSS')").first()[0]


HEAD = "updated_at timestamp, categories array<struct<id:string,label:string>>, shops array<struct<shop:string,name:string,site:string>>, stats struct<products:long,products_with_offers:long,offers:long,shops:long,verified_offers:long>"


def head(spark: SparkSession, now: Column, stats: dict[str, int], shops: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """One row that stands before a payload: its time, the categories, the shops whose offers it has, and the round's numbers.

    shops: shop, shop_name, site of those shops; lists are as long as there are shops and categories.
    """
    site = F.col("site") if "site" in shops.columns else F.lit(None).cast("string")
    used = shops.agg(F.sort_array(F.collect_list(F.struct(F.col("shop").cast("string").alias("shop"), F.col("shop_name").alias("name"), site.alias("site")))).alias("shops"))
    empty = spark.createDataFrame([], "id string, label string") if categories is None else categories.select(F.col(categories.columns[0]).cast("string").alias("id"), F.col(categories.columns[-1]).cast("string").alias("label"))
    kinds = empty.agg(F.sort_array(F.collect_list(F.struct("id", "label"))).alias("categories"))
    numbers = F.struct(*[F.lit(stats[k]).cast("long").alias(k) for k in ("products", "products_with_offers", "offers")], F.size("shops").cast("long").alias("shops"), F.lit(stats["verified_offers"]).cast("long").alias("verified_offers"))
    return used.join(F.broadcast(kinds)).select(now.cast("timestamp").alias("updated_at"), "categories", "shops", numbers.alias("stats"))


def publish(products: DataFrame, path: str, dry_run: bool = False, version: str | None = None, head_of: Callable[[dict[str, int]], DataFrame] | None = None) -> bool:
    """Writes the payload as packed JSON to a new folder and then adds its name to ``path/current``; an empty result or a dry run leaves the last one.

    Returns True if something was published. Nothing is ever overwritten: until the new name is there, readers find the last whole payload. The
    payload is worked out once: its numbers are observed while it is written, and handed to ``head_of`` for the row that goes to ``path/head``.
    """
    if dry_run:
        return False
    spark = products.sparkSession
    version = version or new_version(spark)
    seen = Observation()
    counted = products.observe(seen, F.count(F.lit(1)).alias("products_with_offers"), F.sum(F.size("offer_list")).alias("offers"), F.sum("verified_offers").alias("verified_offers")) if "offer_list" in products.columns else products.observe(seen, F.count(F.lit(1)).alias("products_with_offers"))
    counted.write.mode("error").option("compression", "gzip").json(f"{path}/v={version}")
    numbers = seen.get
    if not numbers.get("products_with_offers"):
        return False
    if head_of:
        head_of(numbers).coalesce(1).write.json(f"{path}/head/v={version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").json(f"{path}/current")
    return True


def current_version(spark: SparkSession, path: str) -> str:
    return spark.read.schema("version string").json(f"{path}/current").agg(F.max("version")).first()[0]


def read_published(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/v={current_version(spark, path)}")


def read_head(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HEAD).json(f"{path}/head/v={current_version(spark, path)}")


def coverage(work: DataFrame, offers: DataFrame) -> DataFrame:
    """Per shop: products wanted, found, and found with an article number."""
    o = offers.select("product", "shop", F.col("gtin").isNotNull().alias("with_gtin"), F.lit(True).alias("found"))
    j = work.join(o, ["product", "shop"], "left")
    return j.groupBy("shop").agg(F.count(F.lit(1)).alias("wanted"), F.count_if("found").alias("found"), F.count_if("with_gtin").alias("with_gtin")).withColumn("ratio", F.round(F.col("found") / F.col("wanted"), 4))


def catalog_coverage(products: DataFrame, shops: DataFrame, offers: DataFrame) -> DataFrame:
    """``coverage`` of the work list of products and shops without its pairs: wanted ones are counted from products, lists and links.

    products: product, shops (null: all), links map. shops: shop, enabled. offers: one per product and shop.
    """
    on = F.coalesce("enabled", F.lit(True))
    names = shops.select("shop", on.alias("enabled"), F.col("shop").cast("string").alias("name"))
    all_ = products.where("shops IS NULL")
    n = all_.agg(F.count(F.lit(1)).alias("wanted"))
    every = names.where("enabled").crossJoin(F.broadcast(n)).select("shop", "wanted")
    pinned = all_.select(F.explode("links").alias("name", "link")).where("link IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("wanted"))
    pinned = names.where("NOT enabled").join(pinned, "name").select("shop", "wanted")
    link = F.try_element_at("links", F.col("shop").cast("string"))
    listed = products.where("shops IS NOT NULL").select(F.explode("shops").alias("shop"), "links").groupBy("shop").agg(F.count(F.lit(1)).alias("all"), F.count_if(link.isNotNull()).alias("linked"))
    listed = names.join(listed, "shop").select("shop", F.when(F.col("enabled"), F.col("all")).otherwise(F.col("linked")).alias("wanted"))
    wanted = every.unionByName(pinned).unionByName(listed).groupBy("shop").agg(F.sum("wanted").alias("wanted")).where("wanted > 0")

    o = offers.select("product", "shop", F.col("gtin").isNotNull().alias("with_gtin")).join(products.select("product", "shops", "links"), "product").join(names.drop("name"), "shop")
    times = F.when(F.col("shops").isNull(), 1).otherwise(F.size(F.filter("shops", lambda s: s == F.col("shop"))))
    o = o.withColumn("times", F.when(F.col("enabled") | link.isNotNull(), times).otherwise(0))
    found = o.groupBy("shop").agg(F.sum("times").alias("found"), F.sum(F.when(F.col("with_gtin"), F.col("times")).otherwise(0)).alias("with_gtin"))
    zero = F.lit(0).cast("long")
    out = wanted.join(found, "shop", "left").select("shop", "wanted", F.coalesce("found", zero).alias("found"), F.coalesce("with_gtin", zero).alias("with_gtin"))
    return out.withColumn("ratio", F.round(F.col("found") / F.col("wanted"), 4))


def problem_report(problems: DataFrame) -> DataFrame:
    """Per shop: identity problems (their type starts with gtin- or verpakking-) and missing products. problems: shop, type."""
    identity = F.col("type").rlike("^(gtin-|verpakking-)")
    return problems.groupBy("shop").agg(F.count_if(identity).alias("identity"), F.count_if(~identity).alias("missing"))
