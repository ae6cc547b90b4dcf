"""Which article is meant: votes of shops, levels of agreement, issues, and identities over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.functions import gtin as G

EXACT, VARIANT, MISMATCH, UNKNOWN = "exact", "variant", "afwijkend", "onbekend"


def consensus(offers: DataFrame) -> DataFrame:
    """product, votes_gtin (named by the most shops, at least two; of equal ones the smallest), distinct_gtins. offers: product, gtin."""
    votes = offers.where("gtin IS NOT NULL").groupBy("product", "gtin").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.when(F.col("n") >= 2, F.struct((-F.col("n")).alias("n"), "gtin")))
    return votes.groupBy("product").agg(best["gtin"].alias("votes_gtin"), F.count(F.lit(1)).alias("distinct_gtins"))


def verified(offers: DataFrame, catalog: DataFrame) -> DataFrame:
    """offers (product, shop, gtin_text, ...) with gtin, verification, reference, reference_source and strict.

    Votes are counted before the join, so a product with very many shops is merged map-side. Offers that deviate are still there:
    issues are raised first (see without_mismatches).
    """
    o = offers.withColumn("gtin", G.normalize_gtin("gtin_text"))
    listed = F.filter(F.transform("gtins", G.normalize_gtin), lambda g: g.isNotNull())
    c = catalog.select("product", listed.alias("listed"), F.coalesce("strict", F.size(listed) > 0).alias("strict"))
    v = o.join(consensus(o), "product", "left").join(c, "product", "left")
    has_list = F.coalesce(F.size("listed") > 0, F.lit(False))
    reference = F.when(has_list, F.element_at("listed", 1)).otherwise(F.col("votes_gtin"))
    source = F.when(has_list, "catalogus").when(F.col("votes_gtin").isNotNull(), "consensus").otherwise("geen")
    level = (
        F.when(F.col("gtin").isNull(), UNKNOWN)
        .when(has_list, F.when(F.array_contains("listed", F.col("gtin")), EXACT).otherwise(MISMATCH))
        .when(F.col("votes_gtin").isNotNull(), F.when(F.col("gtin") == F.col("votes_gtin"), EXACT).otherwise(VARIANT))
        .when(F.col("distinct_gtins") > 1, VARIANT)
        .otherwise(UNKNOWN)
    )
    return v.select(*offers.columns, "gtin", level.alias("verification"), reference.alias("reference"), source.alias("reference_source"), F.coalesce("strict", F.lit(False)).alias("strict"))


def without_mismatches(v: DataFrame) -> DataFrame:
    return v.where(~(F.col("strict") & (F.col("verification") == MISMATCH)))


def with_changes(v: DataFrame, previous: DataFrame, carry: str | None = None) -> DataFrame:
    """Adds before_gtin and gtin_changed. previous: product, shop, gtin. Only valid numbers on both sides count. carry: a name under which the whole previous row is kept."""
    whole = [F.struct(*previous.columns).alias(carry)] if carry else []
    p = previous.select("product", "shop", G.normalize_gtin("gtin").alias("before_gtin"), *whole)
    j = v.join(p, ["product", "shop"], "left")
    return j.withColumn("gtin_changed", F.coalesce(F.col("before_gtin") != F.col("gtin"), F.lit(False)))


def issues(v: DataFrame) -> DataFrame:
    """product, shop, type, message: not in the catalog's list, another number than before, and the same number with another pack than the first shop's.

    v: verified offers with amount, unit, before_gtin and gtin_changed. It is read once: each offer lists its own issues.
    """
    v = v if "unit" in v.columns else v.withColumn("unit", F.lit(None).cast("string"))
    known = F.col("gtin").isNotNull() & F.col("amount").isNotNull()
    # offers are in parts by product already, so the window needs no shuffle; a number of a product has an offer a shop at most
    first = F.min_by(F.struct("amount", "unit"), F.when(known, F.col("shop"))).over(W.partitionBy("product", "gtin"))
    shown = G.display_gtin("gtin")

    def issue(when: Column, kind: str, *text: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("type"), F.concat(*text).alias("message")))

    def pack(p: str) -> Column:
        return F.concat(F.regexp_replace(F.col(f"{p}amount").cast("string"), r"\.0$", ""), F.lit(" "), F.coalesce(F.col(f"{p}unit"), F.lit("")))

    found = F.array_compact(
        F.array(
            issue(F.col("verification") == MISMATCH, "gtin-niet-in-catalogus", F.lit("EAN "), shown, F.lit(" is not in the list of "), F.col("product").cast("string")),
            issue(F.col("gtin_changed"), "gtin-gewijzigd", F.lit("the shop shows EAN "), shown, F.lit(" now instead of "), G.display_gtin("before_gtin")),
            issue(known & (F.col("_first.amount") != F.col("amount")), "verpakking-wijkt-af", F.lit("EAN "), shown, F.lit(" has "), pack(""), F.lit(" here but elsewhere "), pack("_first.")),
        )
    )
    return v.withColumn("_first", first).select("product", "shop", F.explode(found).alias("i")).select("product", "shop", "i.type", "i.message")


def pin_votes(identity: DataFrame, catalog: DataFrame) -> DataFrame:
    """product, gtins with the number that most shops (two at least) have in the identity table, where it isn't in the list yet."""
    best = consensus(identity.select("product", G.normalize_gtin("gtin").alias("gtin"))).where("votes_gtin IS NOT NULL")
    c = catalog.join(best, "product")
    known = F.transform("gtins", G.normalize_gtin)
    return c.where(~F.coalesce(F.array_contains(known, F.col("votes_gtin")), F.lit(False))).select("product", F.array_union("gtins", F.array("votes_gtin")).alias("gtins"))


def change_log(seen: DataFrame, order: list[Column], keep: int = 5) -> DataFrame:
    """The newest changes of number per (product, shop), newest first: from_gtin, to_gtin, at. seen: product, shop, gtin, at."""
    w = W.partitionBy("product", "shop").orderBy(*order)
    s = seen.where("gtin IS NOT NULL").withColumn("from_gtin", F.lag("gtin").over(w)).withColumn("pos", F.row_number().over(w))
    changed = s.where("from_gtin <> gtin").withColumn("rn", F.row_number().over(W.partitionBy("product", "shop").orderBy(F.desc("pos"))))
    return changed.where(F.col("rn") <= keep).select("product", "shop", "rn", "from_gtin", F.col("gtin").alias("to_gtin"), "at")


def snapshot(seen: DataFrame, order: Column) -> DataFrame:
    """Per (product, shop): first and last seen, and the latest number, sku and pack that aren't null."""
    s = seen.where("gtin IS NOT NULL OR sku IS NOT NULL").withColumn("_o", order)
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_o"))).alias(c)
    return s.groupBy("product", "shop").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), latest("gtin"), latest("sku"), latest("amount"))
