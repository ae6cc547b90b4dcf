"""Offers of feeds and pages: work list, fallbacks, one offer per product and shop, and the cache of resolved pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions import gtin as G
from offerloom.functions import money as M
from offerloom.sources.domain import spread

#: A page that shows something else is forgotten at once, any other failure after so many rounds.
MAX_FAILURES = 3
#: Shops are broadcast up to this many rows; a longer list is joined without.
SHOPS_BROADCAST = 100_000
WRONG_PAGE = r"(?i)past niet meer|ander artikel|geen prijs op de pagina"


def gtin_allowed(strict: Column, gtins: Column, gtin: Column) -> Column:
    """False only if the product insists on its list of valid numbers and the page shows another valid one."""
    listed = F.filter(F.transform(gtins, G.normalize_gtin), lambda g: g.isNotNull())
    found = G.normalize_gtin(gtin)
    return F.when((strict == F.lit(False)) | (F.size(listed) <= 0) | found.isNull(), True).otherwise(F.array_contains(listed, found))


def _pairs(products: DataFrame, shops: DataFrame, extra: list[str]) -> DataFrame:
    """The work list, with further columns of products. A product without links has the enabled shops only, so its pairs need no look at links."""
    link = F.try_element_at("links", F.col("shop").cast("string"))
    on = F.coalesce("enabled", F.lit(True))
    few = shops.limit(SHOPS_BROADCAST + 1).count() <= SHOPS_BROADCAST
    small = lambda s: F.broadcast(s) if few else s
    listed = products.where("shops IS NOT NULL").select("product", "links", *extra, F.explode("shops").alias("shop")).join(shops, "shop")
    every = products.where("shops IS NULL AND cardinality(links) > 0").crossJoin(small(shops))
    both = listed.select("product", "shop", "links", "enabled", *extra).unionByName(every.select("product", "shop", "links", "enabled", *extra))
    linked = both.withColumn("link", link).where(on | F.col("link").isNotNull()).select("product", "shop", "link", *extra)
    plain = spread(products.where("shops IS NULL AND coalesce(cardinality(links), 0) <= 0").select("product", *extra)).crossJoin(small(shops.where(on).select("shop")))
    return linked.unionByName(plain.select("product", "shop", F.lit(None).cast("string").alias("link"), *extra))


def work_list(products: DataFrame, shops: DataFrame) -> DataFrame:
    """(product, shop, pinned link): every enabled shop that a product allows, and disabled ones only where a link is pinned.

    products: product, shops (null: all), links map. Every shop goes to every product without a list, by broadcast if the shops are few;
    products with a list of shops are joined by it. Nothing else multiplies.
    """
    return _pairs(products, shops, [])


def not_covered(work: DataFrame, feed_offers: DataFrame) -> DataFrame:
    return work.join(feed_offers.select("product", "shop").distinct(), ["product", "shop"], "left_anti")


def work_not_covered(products: DataFrame, shops: DataFrame, feed_offers: DataFrame) -> DataFrame:
    """``not_covered`` of ``work_list`` without a shuffle of its pairs: each product brings the shops that cover it, as many as it has offers of."""
    covered = feed_offers.where("shop IS NOT NULL").groupBy("product").agg(F.collect_set("shop").alias("_covered"))
    work = _pairs(products.join(covered, "product", "left"), shops, ["_covered"])
    return work.where(~F.coalesce(F.array_contains("_covered", F.col("shop")), F.lit(False))).drop("_covered")


#: What an offer says beside product, shop, url and price, with its type.
FACTS = {"title": "string", "gtin": "string", "sku": "string", "mpn": "string", "currency": "string", "in_stock": "boolean", "amount": "double", "unit": "string"}


def _facts(df: DataFrame) -> Column:
    return F.struct(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in FACTS.items()])


def known_page_offers(work: DataFrame, resolved: DataFrame, pages: DataFrame, rediscovered: DataFrame) -> DataFrame:
    """product, shop, url, price, the page's FACTS, error, from_known: the offer of the pinned or resolved page if it still fits, else of
    the rediscovered one; errors are kept.

    pages: url, fits, allowed, price, and of FACTS what there is. rediscovered: product, shop, url, price, and the same.
    """
    known = work.join(resolved.select("product", "shop", F.col("url").alias("cached")), ["product", "shop"], "left").withColumn("url", F.coalesce("link", "cached"))
    seen = known.join(pages.select("url", "fits", "allowed", "price", _facts(pages).alias("facts"), F.lit(True).alias("page_found")), "url", "left")
    error = (
        F.when(F.col("url").isNull(), None)
        .when(F.col("page_found").isNull(), "pagina niet gevonden")
        .when(~F.col("allowed"), "ander artikel op deze pagina")
        .when(F.col("price").isNull(), "geen prijs op de pagina")
        .when(~F.col("fits"), "pagina past niet meer")
    )
    good = F.col("page_found").isNotNull() & F.col("fits") & F.col("allowed") & F.col("price").isNotNull()
    seen = seen.select("product", "shop", F.when(good, F.struct("url", "price", "facts")).alias("known"), error.alias("known_error"))
    again = rediscovered.select("product", "shop", F.struct("url", "price", _facts(rediscovered).alias("facts")).alias("new"))
    out = seen.join(again, ["product", "shop"], "left").withColumn("o", F.coalesce("known", "new"))
    failed = F.concat_ws("; ", "known_error", F.lit("geen passend resultaat"))
    return out.select("product", "shop", "o.url", "o.price", "o.facts.*", F.when(F.col("o").isNull(), failed).alias("error"), F.col("known").isNotNull().alias("from_known"))


def full_offers(found: DataFrame, catalog: DataFrame, shops: DataFrame, source: str) -> DataFrame:
    """Matched feed rows or page results as offers: FACTS, url, price, unit price and label, the shop's name and the source.

    found: product, shop, url, price, and of FACTS what there is. A pack that the offer doesn't say is the catalog's (pack_amount, pack_unit).
    catalog and shops may be of any size: they are joined by their keys.
    """
    packs = catalog.select("product", "pack_amount", "pack_unit")
    o = found.withColumn("_facts", _facts(found)).select("product", "shop", "url", "price", *[c for c in found.columns if c not in ("product", "shop", "url", "price", *FACTS)], "_facts.*")
    o = o.join(packs, "product", "left").join(shops.select("shop", "shop_name"), "shop", "left")
    own = F.col("amount").isNotNull()
    o = o.withColumns({"amount": F.when(own, F.col("amount")).otherwise(F.col("pack_amount")), "unit": F.when(own, F.col("unit")).otherwise(F.col("pack_unit"))}).drop("pack_amount", "pack_unit")
    price = F.when(F.col("amount").isNotNull(), M.unit_price(F.col("price"), F.col("amount"), F.col("unit")))
    return o.withColumns({"currency": F.coalesce("currency", F.lit("EUR")), "unit_price": price, "unit_label": M.unit_label(F.col("unit")), "source": F.lit(source), "gtin_text": F.col("gtin")}).drop("gtin")


def one_per_shop(offers: DataFrame, order: list[Column]) -> DataFrame:
    """One offer per (product, shop): a feed's before a page's, then by the order given."""
    whole = F.struct(*[c for c in offers.columns if c not in ("product", "shop")])
    rank = F.struct((F.col("source") != "feed").alias("page"), *[o.alias(f"o{i}") for i, o in enumerate(order)])
    return offers.groupBy("product", "shop").agg(F.min_by(whole, rank).alias("r")).select("product", "shop", "r.*")


def union_sources(feed: DataFrame, page: DataFrame) -> DataFrame:
    return feed.withColumn("source", F.lit("feed")).unionByName(page.withColumn("source", F.lit("page")), allowMissingColumns=True)


def merge_resolved(old: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The cache after a round. old: product, shop, url, title, resolved_at, source, failures. outcomes: product, shop, url (null: failed), title, at, source, error."""
    entry = F.struct("url", "title", F.col("at").alias("resolved_at"), "source")
    o = outcomes.select("product", "shop", F.when(F.col("url").isNotNull(), entry).alias("new"), "error", F.lit(True).alias("tried"))
    m = old.select("product", "shop", F.struct("url", "title", "resolved_at", "source").alias("old"), "failures").join(o, ["product", "shop"], "full_outer")
    failed = F.col("tried").isNotNull() & F.col("new").isNull()
    failures = F.when(F.col("new").isNotNull(), 0).when(failed, F.coalesce("failures", F.lit(0)) + 1).otherwise(F.coalesce("failures", F.lit(0)))
    gone = failed & (F.coalesce(F.col("error").rlike(WRONG_PAGE), F.lit(False)) | (failures >= MAX_FAILURES))
    kept = m.withColumn("f", failures).where(~gone).select("product", "shop", F.coalesce("new", "old").alias("e"), F.col("f").cast("int").alias("failures"))
    return kept.where("e.url IS NOT NULL").select("product", "shop", "e.*", "failures")
