"""Comparison of offers over brands: filters, ranks, facets, summaries and savings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.functions import money as M


def visible(offers: DataFrame, in_stock_only: bool = True, only_exact: bool = True) -> DataFrame:
    """Unknown stock counts as in stock."""
    o = offers.where(~F.col("in_stock").eqNullSafe(F.lit(False))) if in_stock_only else offers
    return o.where("verification = 'exact'") if only_exact else o


def facet_filter(products: DataFrame, category: str | None = None, sizes: list[str] = (), brands: list[str] = (), search: str = "") -> DataFrame:
    p = products.where(F.col("category") == category) if category else products
    p = p.where(F.col("size").isin(list(sizes))) if sizes else p
    p = p.where(F.col("brand").isin(list(brands))) if brands else p
    sized = F.when(F.coalesce(F.col("size") != "", F.lit(False)), F.concat(F.lit("maat "), F.col("size"))).otherwise("")
    hay = F.lower(F.concat_ws(" ", "name", F.coalesce("brand", F.lit("")), "category", sized, F.coalesce("gtin", F.lit(""))))
    for term in search.lower().split():
        p = p.where(F.contains(hay, F.lit(term)))
    return p


def comparison_rows(products: DataFrame, offers: DataFrame, shops: list = ()) -> DataFrame:
    """Product x offer, with a unit price, and the cost of a month; of the listed shops only, if any are."""
    o = offers.where("unit_price IS NOT NULL")
    o = o.where(F.col("shop").isin(list(shops))) if shops else o
    return o.join(products.select("product", "name", "brand", "category", "size"), "product").withColumn("monthly", M.monthly_cost(F.col("unit_price")))


#: Rows of a group that one task ranks, ranges that a larger group is cut into at most, and rows sampled to find their ends.
RANGE_ROWS, RANGES, SAMPLE = 200_000, 256, 16_384
#: Groups of more than RANGE_ROWS rows whose ends may be broadcast.
LARGE_BROADCAST = 2_000


def _same(keys: list[str], other: DataFrame) -> Column:
    return reduce(Column.__and__, [F.col(k).eqNullSafe(other[f"_{k}"]) for k in keys])


def deal_ranges(rows: DataFrame, keys: list[str], order: list[str], range_rows: int) -> tuple[DataFrame, bool]:
    """(rows with ``_range``: the part of its group's order that a row is in; whether the groups of more than one range fit a broadcast)."""
    whole, named = F.struct(*order), [F.col(k).alias(f"_{k}") for k in keys]
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > range_rows).select(*named, "_n")
    few = large.limit(LARGE_BROADCAST + 1).count() <= LARGE_BROADCAST
    small = lambda df: F.broadcast(df) if few else df
    sampled = rows.join(small(large), _same(keys, large)).where(F.pmod(F.xxhash64(*order), F.greatest(F.lit(1).cast("long"), F.expr(f"_n div {SAMPLE}"))) == 0)
    ranges = F.least(F.lit(RANGES), F.ceil(F.first("_n") / range_rows).cast("int"))
    ends = sampled.groupBy(*[f"_{k}" for k in keys]).agg(F.sort_array(F.collect_set(whole)).alias("_s"), ranges.alias("_r"))
    cut = F.transform(F.sequence(F.lit(1), F.col("_r") - 1), lambda i: F.element_at("_s", F.floor(i * F.size("_s") / F.col("_r")).cast("int") + 1))
    ends = ends.where("_r > 1").select(*[f"_{k}" for k in keys], cut.alias("_ends"))
    behind = F.size(F.filter(F.coalesce("_ends", F.slice("_ends", 1, 0)), lambda e: e <= whole))
    return rows.join(small(ends), _same(keys, ends), "left").select(*rows.columns, F.greatest(behind, F.lit(0)).alias("_range")), few


def distributed_rank(rows: DataFrame, keys: list[str], order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with ``rank``, 1..n in each group by columns that make the order total, as a window over the group would give it.

    A group of more than range_rows rows is cut into ranges of the order whose ends come from a sample by hash; ranges are ranked by tasks of their own, and the rows
    of the ranges before are added. The ends only decide how evenly rows are dealt: ranks are exact. rows are read several times and should be a written table.
    """
    dealt, few = deal_ranges(rows, keys, order, range_rows)
    before = F.sum("_m").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    offsets = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_m")).withColumn("_before", before).where("_before > 0")
    offsets = offsets.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_at"), "_before")
    local = dealt.withColumn("_rank", F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order)))
    out = local.join(F.broadcast(offsets) if few else offsets, _same(keys, offsets) & (F.col("_range") == F.col("_at")), "left")
    return out.select(*rows.columns, (F.col("_rank") + F.coalesce("_before", F.lit(0))).cast("int").alias("rank"))


def comparison_rank(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """1..n by unit price and price in each category and size; a group of any size is ranked by many tasks."""
    return distributed_rank(rows, ["category", "size"], ["unit_price", "price", "product", "shop"], range_rows)


def _order() -> Column:
    return F.struct("unit_price", "price", "product", "shop")


def cheapest_per_brand(rows: DataFrame) -> DataFrame:
    best = F.min_by(F.struct("product", "shop", "price", "unit_price"), _order())
    return rows.groupBy("category", "size", "brand").agg(best.alias("b")).select("category", "size", "brand", "b.*")


def comparison_summary(rows: DataFrame) -> DataFrame:
    """Per category and size: cheapest and dearest unit price, the difference of a month, brands and shops."""
    a, b = F.min_by("monthly", _order()), F.max_by("monthly", _order())
    return rows.groupBy("category", "size").agg(
        F.min("unit_price").alias("cheapest"),
        F.max("unit_price").alias("dearest"),
        M.round_half_up(b - a, 2, epsilon=False).alias("monthly_difference"),
        F.count_distinct("brand").alias("brands"),
        F.count_distinct("shop").alias("shops"),
    )


def size_number(size: Column) -> Column:
    """The number that a size starts with, or null: sizes such as 4+ or newborn are sorted, not refused."""
    return F.regexp_extract(size, r"^(\d+)", 1).try_cast("long")


def facets(products: DataFrame, offers: DataFrame) -> DataFrame:
    """category, kind (size or brand), value, position. Sizes are in natural order; brands only of products with offers."""
    with_offers = products.join(offers.select("product").distinct(), "product", "left_semi")
    sizes = products.where("size IS NOT NULL AND size <> ''").select("category", F.lit("size").alias("kind"), F.col("size").alias("value")).distinct()
    brands = with_offers.where("brand IS NOT NULL").select("category", F.lit("brand").alias("kind"), F.col("brand").alias("value")).distinct()
    key = F.when(F.col("kind") == "size", size_number(F.col("value")))
    # as many rows as a category has sizes and brands
    return sizes.unionByName(brands).withColumn("position", F.row_number().over(W.partitionBy("category", "kind").orderBy(key.asc_nulls_last(), "value")))


def default_size(products: DataFrame, offers: DataFrame) -> DataFrame:
    """Per category the size with the most brands that have offers; of equal ones the lowest size, those without a number last."""
    with_offers = products.join(offers.select("product").distinct(), "product", "left_semi").where("size IS NOT NULL")
    n = with_offers.groupBy("category", "size").agg(F.count_distinct("brand").alias("brands"))
    return n.groupBy("category").agg(F.min_by("size", F.struct(-F.col("brands"), F.coalesce(size_number(F.col("size")), F.lit((1 << 63) - 1)), "size")).alias("size"), F.max("brands").alias("brands"))


def product_listing(summary: DataFrame, mode: str = "unit") -> DataFrame:
    """Products in list order with their position. Meant for one page of results: filter first."""
    order = {"name": [F.col("name")], "price": [F.col("best_price").asc_nulls_last()]}.get(mode, [F.col("best_unit_price").asc_nulls_last(), F.col("best_price").asc_nulls_last()])
    return summary.orderBy(*order, "product")


def display_order(offers: DataFrame, mode: str = "unit") -> DataFrame:
    first = [F.col("price")] if mode == "price" else [F.col("unit_price").asc_nulls_last(), F.col("price")]
    return offers.withColumn("position", F.row_number().over(W.partitionBy("product").orderBy(*first, "shop")))


def savings(offers: DataFrame) -> DataFrame:
    """Per product: price of the last visible offer minus that of the first, if positive, and how many are exact."""
    far = F.struct(F.coalesce("unit_price", F.lit(float("inf"))), F.col("price"), F.col("shop"))
    s = offers.groupBy("product").agg(F.min_by("price", far).alias("first"), F.max_by("price", far).alias("last"), F.count(F.lit(1)).alias("shops"), F.count_if(F.col("verification") == "exact").alias("exact"))
    return s.select("product", F.greatest(F.col("last") - F.col("first"), F.lit(0.0)).alias("saving"), "exact", "shops")
