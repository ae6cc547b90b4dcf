"""Configuration documents: catalog, shops and feeds as JSON, read with fixed schemas; a missing file is an empty table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACK = "struct<amount:double,unit:string>"
PRODUCT = (
    "struct<id:string,name:string,brand:string,category:string,size:string,weight:string,unit:string,query:string,queries:map<string,string>,"
    f"match:struct<must:array<string>,none:array<string>,packSize:double>,packSize:{PACK},gtins:array<string>,strictGtin:boolean,shops:array<string>,links:map<string,string>>"
)
CATALOG = f"categories array<struct<id:string,label:string>>, products array<{PRODUCT}>"
SHOP = "struct<name:string,site:string,enabled:boolean,delayMs:int,searchUrl:string,productPathPattern:string,discovery:string,browseUrls:array<string>>"
FEEDS = "feeds array<struct<id:string,shop:string,name:string,urlEnv:string,format:string,enabled:boolean,delimiter:string,mapping:map<string,array<string>>>>"


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON document of the path, or none if the path doesn't exist."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per product, in the columns of the matching and quality operators, with its position in its document; absent lists are empty."""
    p = read_document(spark, path, CATALOG).select(F.posexplode("products").alias("position", "p"))
    none = F.array().cast("array<string>")
    return p.select(
        F.col("p.id").alias("product"), "p.name", "p.brand", "p.category", "p.size", "p.weight", "p.query",
        F.coalesce("p.match.must", none).alias("must"), F.coalesce("p.match.none", none).alias("none"), F.col("p.match.packSize").alias("match_pack"),
        F.col("p.packSize.amount").alias("pack_amount"), F.col("p.packSize.unit").alias("pack_unit"),
        F.coalesce("p.gtins", none).alias("gtins"), F.col("p.gtins").isNotNull().alias("gtins_given"), "position", F.col("p.strictGtin").alias("strict"), "p.shops", "p.links",
    )


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    return read_document(spark, path, CATALOG).select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category"), "c.label")


def read_shops(spark: SparkSession, path: str) -> DataFrame:
    """One row per shop of a document that maps shop ids to settings."""
    text = spark.read.text(path, wholetext=True) if _exists(spark, path) else spark.createDataFrame([], "value string")
    s = text.select(F.explode(F.from_json("value", f"map<string,{SHOP}>")).alias("shop", "s"))
    return s.select("shop", "s.name", "s.site", F.coalesce("s.enabled", F.lit(True)).alias("enabled"), F.col("s.searchUrl").alias("search_url"), F.col("s.productPathPattern").alias("path_pattern"), "s.discovery", F.col("s.browseUrls").alias("browse_urls"))


def read_feed_config(spark: SparkSession, path: str) -> DataFrame:
    f = read_document(spark, path, FEEDS).select(F.explode("feeds").alias("f"))
    return f.select(F.col("f.id").alias("feed"), "f.shop", F.col("f.urlEnv").alias("location"), F.coalesce("f.format", F.lit("auto")).alias("format"), F.coalesce("f.enabled", F.lit(True)).alias("enabled"), "f.delimiter", "f.mapping")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scope(products: DataFrame, shops: DataFrame, only_products: list | None = None, first: int | None = None, only_shops: list | None = None) -> tuple[DataFrame, DataFrame]:
    """The listed products (the first n of them by id), and the listed shops or else the enabled ones."""
    p = products.where(F.col("product").isin(only_products)) if only_products else products
    p = p.orderBy("product").limit(first) if first else p
    return p, shops.where(F.col("shop").isin(only_shops)) if only_shops else shops.where(F.coalesce("enabled", F.lit(True)))
