"""Domain tables derived from the star schema: catalog from part, shops from supplier, offers and feed text from lineitem.

Everything is a projection (and one broadcast-sized join at most), so filters and column pruning reach the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.functions import gtin as G
from offerloom.functions import money as M


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer parts than there are cores, dealt out before work is done for each of its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ean13(prefix: str, number: Column) -> Column:
    """A valid 13-digit article number of this three-digit prefix and a number of up to nine digits."""
    body = number.cast("bigint") + int(prefix) * 10**9
    return F.concat(body.cast("string"), G.check_digit_of(body, 12).cast("string"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per product; every fifth one has a list of article numbers. The first word of the name has to be in a title."""
    p = table(spark, sf_dir, "part")
    pinned = F.col("p_partkey") % 5 == 0
    return p.select(
        F.col("p_partkey").alias("product"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.col("p_size").cast("string").alias("size"),
        F.col("p_name").alias("query"),
        F.split("p_name", " ").alias("must"),
        F.when(F.col("p_partkey") % 7 == 0, F.array(F.lit("refurbished"))).otherwise(F.array().cast("array<string>")).alias("none"),
        F.lit(None).cast("double").alias("match_pack"),
        F.when(F.col("p_partkey") % 4 == 0, F.lit(10.0)).alias("pack_amount"),
        F.when(F.col("p_partkey") % 4 == 0, "stuk").alias("pack_unit"),
        F.when(pinned, F.array(ean13("200", F.col("p_partkey")))).otherwise(F.array().cast("array<string>")).alias("gtins"),
        F.lit(None).cast("boolean").alias("strict"),
        F.col("p_retailprice").alias("list_price"),
    )


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("shop"), F.col("s_name").alias("shop_name"), (F.col("s_suppkey") % 10 != 9).alias("enabled"), F.concat(F.lit("https://shop"), F.col("s_suppkey"), F.lit(".example")).alias("site"))


def offer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an offer has of its own; ``described`` adds what follows from that. number: which kind of article number it shows."""
    li = spread(table(spark, sf_dir, "lineitem"))
    order = F.col("l_orderkey")
    return li.select(
        F.col("l_partkey").alias("product"),
        F.col("l_suppkey").alias("shop"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("amount"),
        F.when(F.col("l_linenumber") % 5 != 0, F.col("l_linestatus") == "O").alias("in_stock"),
        F.when(F.col("l_returnflag") == "A", "feed").otherwise("page").alias("source"),
        (order % 10).alias("number"),
        F.to_date("l_shipdate").alias("day"),
        (order * 8 + F.col("l_linenumber")).alias("ord"),
    )


def described(rows: DataFrame) -> DataFrame:
    """Offer rows with unit, article number, sku, unit price and label."""
    key, kind = F.col("product"), F.col("number")
    unit = F.when(key % 3 == 0, "stuk").when(key % 3 == 1, "ml").otherwise("g")
    number = F.when(kind == 0, F.lit(None)).when(kind == 1, ean13("201", key)).otherwise(ean13("200", key))
    o = rows.select("product", "shop", "price", "amount", unit.alias("unit"), "in_stock", "source", number.alias("gtin_text"), F.concat(F.lit("S"), key).alias("sku"), "day", "ord")
    return o.withColumn("unit_price", M.unit_price(F.col("price"), F.col("amount"), F.col("unit"))).withColumn("unit_label", M.unit_label(F.col("unit")))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All offers of all days, feed and page ones, with unit prices."""
    return described(offer_rows(spark, sf_dir))


def feed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed rows as a shop would publish them: all strings, price in Dutch notation, pack size in the title."""
    li = spread(table(spark, sf_dir, "lineitem")).where("l_returnflag = 'A'")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    euros = F.expr("cast(round(l_extendedprice * 100) as bigint) div 100")
    whole = F.when(euros >= 1000, F.concat(F.floor(euros / 1000), F.lit("."), F.lpad((euros % 1000).cast("string"), 3, "0"))).otherwise(euros.cast("string"))
    order = F.col("l_orderkey")
    return j.select(
        F.col("l_suppkey").alias("shop"),
        (order * 8 + F.col("l_linenumber")).alias("row_no"),
        F.concat(F.lit("S"), F.col("l_partkey")).alias("merchant_product_id"),
        F.concat(F.lit(" <b>"), F.col("p_brand"), F.lit("</b> "), F.col("p_name"), F.lit(" maat "), F.col("p_size"), F.lit(" - "), F.col("l_quantity").cast("int"), F.lit(" stuks &amp; meer")).alias("name"),
        F.col("p_brand").alias("brand"),
        F.concat(F.lit("€ "), whole, F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0")).alias("search_price"),
        F.when(order % 3 == 0, "usd").otherwise("").alias("currency"),
        F.when(order % 10 == 0, "").when(order % 10 == 1, "1234567890128").otherwise(ean13("200", F.col("l_partkey"))).alias("ean"),
        F.when(order % 11 == 0, "").otherwise(F.concat(F.lit("https://shop"), F.col("l_suppkey"), F.lit(".example/p/"), F.col("l_partkey"))).alias("aw_deep_link"),
        F.when(F.col("l_linenumber") % 5 == 0, "3").when(F.col("l_linestatus") == "O", "ja").otherwise("Uitverkocht").alias("in_stock"),
    )
