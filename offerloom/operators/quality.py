"""Violations of the rules that a catalog, its shops and its feeds have to keep: one table of (subject, rule, level)."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions import gtin as G
from offerloom.functions.text import plain

from .matching import verdict


def _found(df: DataFrame, subject: str, rule: str, when: Column, level: str = "error") -> DataFrame:
    return df.where(when).select(F.col(subject).cast("string").alias("subject"), F.lit(rule).alias("rule"), F.lit(level).alias("level"))


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) == ""


def _unknown(df: DataFrame, subject: str, value: str, known: DataFrame, rule: str) -> DataFrame:
    """Rows whose value isn't in the first column of known."""
    k = known.select(F.col(known.columns[0]).alias(value)).distinct()
    return _found(df.where(F.col(value).isNotNull()).join(k, value, "left_anti"), subject, rule, F.lit(True))


def _twice(df: DataFrame, subject: str, rule: str) -> DataFrame:
    return _found(df.groupBy(subject).count(), subject, rule, (F.col("count") > 1) & F.col(subject).isNotNull())


def catalog_violations(catalog: DataFrame, categories: DataFrame, shops: DataFrame) -> DataFrame:
    """catalog: product, name, brand, category, size, query, must, none, match_pack, gtins, strict, shops, links; gtins_given, if a list
    that is absent is empty there. Categories are checked only where there are any."""
    c = catalog
    given = F.col("gtins_given") if "gtins_given" in c.columns else F.col("gtins").isNotNull()
    linked = c.select("product", F.explode(F.map_keys("links")).alias("shop"))
    listed = c.select("product", F.explode("shops").alias("shop"))
    numbers = c.select("product", F.explode("gtins").alias("number"))
    own = F.when(F.col("match_pack").isNotNull(), F.concat_ws(" ", "name", F.regexp_replace(F.col("match_pack").cast("string"), r"\.0$", ""))).otherwise(F.col("name"))
    rules = {"plain_title": plain(own), "must": F.transform("must", plain), "none": F.transform("none", plain), "brand": plain(F.coalesce("brand", F.lit(""))), "size": F.coalesce("size", F.lit("")), "pack": F.col("match_pack")}
    parts = [
        _twice(c, "product", "duplicate id"),
        _found(c, "product", "no id", F.col("product").isNull()),
        _found(c, "product", "no name", _blank("name")),
        _found(c, "product", "no category", _blank("category")),
        _unknown(c.where(~_blank("category")), "product", "category", categories, "unknown category") if not categories.isEmpty() else _found(c, "product", "unknown category", F.lit(False)),
        _unknown(listed, "product", "shop", shops, "unknown shop"),
        _unknown(linked, "product", "shop", shops, "link to an unknown shop"),
        _found(c, "product", "empty list of article numbers", given & (F.size("gtins") == 0), "warning"),
        _found(numbers, "product", "invalid article number", ~G.is_valid_gtin("number")),
        _found(c, "product", "strict without a list", F.coalesce("strict", F.lit(False)) & (F.coalesce(F.size("gtins"), F.lit(0)) <= 0)),
        _found(c, "product", "own name fails its rules", ~_blank("name") & (verdict(own, rules) != "ok")),
        _found(c, "product", "no query", _blank("query"), "warning"),
        _found(c, "product", "no required words", F.coalesce(F.size("must"), F.lit(0)) <= 0, "warning"),
    ]
    return reduce(DataFrame.unionByName, parts)


#: Distinct patterns of a configuration that are tried on the driver at most; a shop has one, and most share a few.
PATTERNS = 100_000


def broken_patterns(patterns: DataFrame) -> DataFrame:
    """The distinct patterns (one column) that can't be compiled by the engine that matches paths with them."""
    (name,) = patterns.columns
    distinct = [r[0] for r in patterns.where(F.col(name).isNotNull()).distinct().limit(PATTERNS + 1).collect()]
    if len(distinct) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} distinct patterns")
    spark = patterns.sparkSession
    compiled = spark._jvm.java.util.regex.Pattern

    def broken(pattern: str) -> bool:
        try:
            compiled.compile(pattern)
        except IllegalArgumentException:  # what the engine makes of a syntax error
            return True
        return False

    return spark.createDataFrame([(p,) for p in distinct if broken(p)], f"{name} string")


def shop_violations(shops: DataFrame) -> DataFrame:
    """shops: shop, name, site, enabled, search_url, browse_urls, discovery, path_pattern."""
    on, browse = F.coalesce("enabled", F.lit(True)), F.coalesce(F.size("browse_urls"), F.lit(0)) > 0
    parts = [
        _found(shops, "shop", "no name", _blank("name")),
        _found(shops, "shop", "no site", _blank("site")),
        _found(shops, "shop", "search url without {q}", ~_blank("search_url") & ~F.contains("search_url", F.lit("{q}"))),
        _found(shops, "shop", "products can't be found", on & _blank("search_url") & ~browse),
        _found(shops.join(F.broadcast(broken_patterns(shops.select("path_pattern"))), "path_pattern"), "shop", "invalid path pattern", F.lit(True)),
        _found(shops, "shop", "browses without urls", on & (F.coalesce("discovery", F.lit("")) == "browse") & ~browse, "warning"),
    ]
    return reduce(DataFrame.unionByName, parts)


def feed_violations(feeds: DataFrame, shops: DataFrame) -> DataFrame:
    """feeds: feed, shop, location, format."""
    parts = [
        _twice(feeds, "feed", "duplicate id"),
        _found(feeds, "feed", "no id", _blank("feed")),
        _found(feeds, "feed", "no shop", _blank("shop")),
        _unknown(feeds.where(~_blank("shop")), "feed", "shop", shops, "unknown shop"),
        _found(feeds, "feed", "no location", _blank("location")),
        _found(feeds, "feed", "location is a raw url", F.coalesce(F.col("location").rlike("(?i)^https?:"), F.lit(False))),
        _found(feeds, "feed", "unknown format", ~_blank("format") & ~F.col("format").isin("auto", "csv", "xml")),
    ]
    return reduce(DataFrame.unionByName, parts)
