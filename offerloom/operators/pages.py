"""Crawled pages: product facts, links, candidates, outbound hosts and robots rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.functions import gtin as G
from offerloom.functions import money as M
from offerloom.functions import productpage as PP
from offerloom.functions import text as T

# fixed values: stock words of schema.org and meta elements
PAGE_IN_STOCK = r"(?i)instock|in_stock|limitedavailability|onlineonly|presale|preorder|backorder"
PAGE_OUT_OF_STOCK = r"(?i)outofstock|out_of_stock|soldout|discontinued"


# fixed values: where a page's product data stands beside its JSON-LD, in the order in which the places are tried
LD_BLOCK = "(?i)<script\\b[^>]*type\\s*=\\s*[\"']application/ld\\+json[\"'][^>]*>([\\s\\S]*?)</script>"
PRICE_ATTRIBUTE = "(?i)data-(?:product-)?price\\s*=\\s*[\"']([^\"']+)[\"']"
LOOSE_NUMBER = r"(?i)\b(?:ean|gtin|barcode|artikelnummer)\b[^0-9]{0,20}(\d{8,14})"
META_PRICES = ("product:price:amount", "og:price:amount", "price")
META_NUMBERS = ("product:ean", "og:upc", "product:retailer_part_no", "gtin13", "ean")
META_KEYS = (*META_PRICES, *META_NUMBERS, "product:availability", "og:availability", "og:title", "og:description", "og:image", "product:retailer_item_id", "sku")


def meta_pairs(html: Column) -> Column:
    """array<struct<key, content>> of the meta elements that product facts ask for, decoded: all elements are read once.

    Elements whose property, name or itemprop stands before the content come first, in their order, then those where it stands behind.
    """
    wanted = "|".join(re.escape(k) for k in META_KEYS)
    name = "(?:property|name|itemprop)\\s*=\\s*[\"']([^\"']*)[\"']"
    parts = "(?is)^(.*)content\\s*=\\s*[\"']([^\"']*)[\"'](.*)\\z"
    tags = F.filter(F.regexp_extract_all(html, F.lit("(?i)<meta[^>]+"), F.lit(0)), lambda t: t.rlike(f"(?i)[\"'](?:{wanted})[\"']"))

    def keyed(place: int) -> Column:
        def of(t: Column) -> Column:
            content = T.trim(T.decode_entities(F.regexp_extract(t, parts, 2)))
            return F.when(t.rlike(parts), F.transform(F.regexp_extract_all(F.regexp_extract(t, parts, place), F.lit("(?i)" + name), F.lit(1)), lambda k: F.struct(F.lower(k).alias("key"), content.alias("content"))))

        return F.flatten(F.filter(F.transform(tags, of), lambda x: x.isNotNull()))

    return F.concat(keyed(1), keyed(3))


def product_facts(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without the html, with title, page_price, currency, in_stock, amount, unit, page_gtin, sku, mpn, image, page_source.

    All by Column functions: JSON-LD as VARIANT, meta elements once for all keys. A null page, and one whose JSON can't be parsed, has what the rest of it says.
    """
    keep = [c for c in pages.columns if c != html]
    h = F.col(html)
    p = pages.select(
        *keep,
        F.regexp_extract_all(h, F.lit(LD_BLOCK), F.lit(1)).alias("_blocks"),
        meta_pairs(h).alias("_metas"),
        F.regexp_extract(h, PRICE_ATTRIBUTE, 1).alias("_attribute"),
        T.page_title(h).alias("_page_title"),
        F.regexp_extract(h, LOOSE_NUMBER, 1).alias("_loose"),
    )
    p = p.withColumn("_products", PP.product_nodes("_blocks")).withColumn("_chosen", PP.chosen("_products"))
    p = p.withColumns({"_f": PP.facts("_chosen"), "_own": F.col("_chosen.ids"), "_more": PP.other_ids("_products")})

    def meta(key: str) -> Column:
        return F.try_element_at(F.filter("_metas", lambda m: m["key"] == key), F.lit(1))["content"]

    filled = lambda c: F.nullif(c, F.lit(""))
    said = F.coalesce("_f.stock_text", F.lit(""))
    p = p.withColumns({"_meta": M.parse_price(F.coalesce(*[meta(k) for k in META_PRICES])), "_marked": M.parse_price("_attribute"), "_stock": filled(F.coalesce(meta("product:availability"), meta("og:availability")))})
    in_meta = ~F.col("_stock").rlike(PAGE_OUT_OF_STOCK) & F.regexp_replace("_stock", r"\s", "").rlike(PAGE_IN_STOCK)
    stock = F.when(said.rlike(PAGE_OUT_OF_STOCK), False).when(said.rlike(PAGE_IN_STOCK), True).when(F.col("_stock").isNotNull(), in_meta)
    other = F.array(*[meta(k) for k in META_NUMBERS], filled(F.col("_loose")))
    p = p.withColumn("_title", F.coalesce("_f.title", filled(T.strip_tags(meta("og:title"))), filled(F.col("_page_title"))))
    p = p.withColumns({"_pack": M.parse_pack_size("_title"), "_said_pack": M.parse_pack_size("_f.size_text"), "_meta_pack": M.parse_pack_size(meta("og:description"))})
    p = p.withColumn("_pack", F.coalesce("_said_pack", "_pack", "_meta_pack"))
    complete = F.col("_own.gtin").isNotNull() & F.col("_own.sku").isNotNull()
    # one struct, opened again by a generator: a later filter on a fact must not be put below it and work out the rules once more for each use
    facts = F.struct(
        F.col("_title").alias("title"),
        F.coalesce("_f.price", "_meta", "_marked").alias("page_price"),
        F.coalesce("_f.currency", F.lit("EUR")).alias("currency"),
        stock.alias("in_stock"),
        F.col("_pack.amount").alias("amount"),
        F.col("_pack.unit").alias("unit"),
        F.coalesce("_own.gtin", "_more.gtin", F.try_element_at(F.filter(F.transform(other, G.normalize_gtin), lambda g: g.isNotNull()), F.lit(1))).alias("page_gtin"),
        F.coalesce("_own.sku", "_more.sku", filled(meta("product:retailer_item_id")), filled(meta("sku"))).alias("sku"),
        F.coalesce("_own.mpn", F.when(~F.coalesce(complete, F.lit(False)), F.col("_more.mpn"))).alias("mpn"),
        F.coalesce(filled(F.col("_f.image")), meta("og:image")).alias("image"),
        F.when(F.col("_f.found"), "json-ld").when(F.col("_meta").isNotNull(), "meta").when(F.col("_marked").isNotNull(), "attribute").alias("page_source"),
    )
    return p.select(*keep, F.inline(F.array(facts)))


def hrefs(html: Column | str) -> Column:
    """Distinct hrefs of a page's anchors in order, decoded, without fragments and scripts."""
    raw = F.regexp_extract_all(T.col(html), F.lit("(?i)<a\\b[^>]*href\\s*=\\s*[\"']([^\"']+)[\"']"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(raw, lambda h: T.trim(T.decode_entities(h))), lambda h: (h != "") & ~h.startswith("#") & ~h.startswith("javascript:")))


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href. The html is left behind before anything is shuffled."""
    return pages.select("page_id", "url", F.posexplode(hrefs("html")).alias("pos", "href"))


def candidates(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """shop, url, title: one row for each product URL of a shop, with the longest title.

    sites: shop, host (without www.), path_pattern. A title is the longest, of at least four characters, of the anchor's text, its title
    attribute and the URL's last part. A page without a fitting anchor of a shop falls back to its bare hrefs there.
    """
    # fixed values: what an anchor and its title attribute look like
    anchor = "(?i)<a\\b([^>]*)href\\s*=\\s*[\"']([^\"']+)[\"']([^>]*)>([\\s\\S]{0,600}?)</a>"
    whole = F.regexp_extract_all("html", F.lit(anchor), F.lit(0))
    rows = pages.select("page_id", "url", F.posexplode(whole).alias("pos", "a"))
    href = T.trim(T.decode_entities(F.regexp_extract("a", anchor, 2)))
    target = T.resolve(href, F.col("url"))
    attrs = F.concat(F.regexp_extract("a", anchor, 1), F.regexp_extract("a", anchor, 3))
    texts = rows.select("page_id", "url", F.lit(False).alias("bare"), "pos", target.alias("target"), T.strip_tags(F.regexp_extract("a", anchor, 4)).alias("t1"), T.trim(T.decode_entities(F.regexp_extract(attrs, "(?i)title\\s*=\\s*[\"']([^\"']+)[\"']", 1))).alias("t2"))
    bare = links(pages).select("page_id", "url", F.lit(True).alias("bare"), "pos", T.resolve(F.col("href"), F.col("url")).alias("target"), F.lit("").alias("t1"), F.lit("").alias("t2"))
    both = texts.unionByName(bare).where(F.col("target").rlike("^https?:"))
    both = both.withColumn("link_host", T.url_host("target")).withColumn("path", T.url_path("target"))
    found = both.join(sites, F.col("link_host") == F.col("host")).where(F.col("path_pattern").isNull() | F.call_function("rlike", F.col("path"), F.col("path_pattern")))
    # bare hrefs count where a page has no fitting anchor of the shop; a page's links bound the window
    found = found.withColumn("only_bare", F.min("bare").over(W.partitionBy("page_id", "shop"))).where(F.col("bare") == F.col("only_bare"))
    slug = T.slug_title("target")
    options = F.filter(F.array("t1", "t2", slug), lambda t: F.length(t) >= 4)
    title = F.coalesce(F.try_element_at(F.array_sort(options, lambda a, b: F.length(b) - F.length(a)), F.lit(1)), slug)
    found = found.select("shop", T.without_query("target").alias("url"), title.alias("title"), "page_id", "pos")
    return found.groupBy("shop", "url").agg(F.max_by("title", F.struct(F.length("title").alias("n"), (-F.col("page_id")).alias("p"), (-F.col("pos")).alias("q"))).alias("title"))


def outbound_hosts(pages: DataFrame, top: int = 25) -> DataFrame:
    """The hosts most linked to from other hosts: host, links, and the first sample. A top-k report."""
    out = links(pages).withColumn("target", T.resolve(F.col("href"), F.col("url")))
    out = out.withColumn("host", T.url_host("target")).where(F.col("host").isNotNull() & (F.col("host") != T.url_host("url")))
    counts = out.groupBy("host").agg(F.count(F.lit(1)).alias("links"), F.min_by("target", F.struct("page_id", "pos")).alias("sample"))
    return counts.orderBy(F.desc("links"), "host").limit(top)


def robots_rules(files: DataFrame) -> DataFrame:
    """host, group_no, agent, allow, path, crawl_delay from robots files (host, body): one row for each agent and rule of a group.

    A group is the lines after a run of user-agent lines. A file is one row here, so its lines are windowed within the host.
    """
    lines = files.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("no", "raw")).withColumn("line", T.trim(F.regexp_replace("raw", "#.*$", ""))).where(F.contains("line", F.lit(":")))
    key = F.lower(T.trim(F.substring_index("line", ":", 1)))
    value = T.trim(F.regexp_replace("line", "^[^:]*:", ""))
    w = W.partitionBy("host").orderBy("no")
    x = lines.select("host", "no", key.alias("k"), value.alias("v")).withColumn("starts", (F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(w), F.lit("")) != "user-agent"))
    x = x.withColumn("group_no", F.sum(F.col("starts").cast("int")).over(w)).where("group_no > 0")
    agents = x.where("k = 'user-agent'").select("host", "group_no", F.lower("v").alias("agent"))
    rules = x.where("k = 'allow' OR (k = 'disallow' AND v <> '')").select("host", "group_no", (F.col("k") == "allow").alias("allow"), F.col("v").alias("path"))
    delay = F.regexp_extract(F.replace(F.col("v"), F.lit(","), F.lit(".")), r"^(\d+(?:\.\d+)?)", 1)
    delays = x.where("k = 'crawl-delay'").select("host", "group_no", F.when(delay != "", delay.cast("double")).alias("crawl_delay"), "no").where("crawl_delay IS NOT NULL")
    delays = delays.groupBy("host", "group_no").agg(F.max_by("crawl_delay", "no").alias("crawl_delay"))
    return agents.join(rules, ["host", "group_no"], "left").join(delays, ["host", "group_no"], "left")


def rule_length(path: Column) -> Column:
    return F.length(F.regexp_replace(path, r"\$\z", ""))


def rule_matches(rule: Column, path: Column) -> Column:
    """Prefix match; ``*`` stands for anything and a final ``$`` for the end. Rules without either never compile a pattern."""
    quoted = F.regexp_replace(F.regexp_replace(F.regexp_replace(rule, r"\$\z", ""), r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*", r"[\\s\\S]*")
    pattern = F.concat(F.lit("^"), quoted, F.when(rule.endswith("$"), F.lit(r"\z")).otherwise(""))
    return F.when(~rule.rlike(r"[*$]"), F.startswith(path, rule)).otherwise(F.call_function("rlike", path, pattern))


def own_rules(rules: DataFrame, agent: str) -> DataFrame:
    """The rules that hold for an agent: those of its own groups where a host has any, else those of ``*``."""
    own = (F.col("agent") != "*") & F.contains(F.lit(agent.lower()), F.col("agent"))
    r = rules.where(own | (F.col("agent") == "*")).withColumn("own", own)
    has = r.groupBy("host").agg(F.max("own").alias("has_own"), F.min_by("crawl_delay", F.struct(~F.col("own"), F.col("crawl_delay").isNull(), "group_no")).alias("delay"))
    return r.join(has, "host").where("own = has_own").select("host", "allow", "path", "delay")


#: Rules of the hosts may be broadcast up to so many rows (a host and a path each).
RULES_BROADCAST = 100_000
#: Beyond that, a host of over so many paths meets its rules in SALTS tasks; hot hosts may be broadcast up to so many.
HOT_PATHS, SALTS, HOSTS_BROADCAST = 200_000, 64, 100_000


def allowed(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """urls (url_id, host, path) with allowed: the longest matching rule wins, allow on ties; without a rule a URL is allowed.

    Rules without ``*`` and ``$`` are found by hash: a path's beginnings of the lengths that its host's rules have are looked up, so the
    work of a URL is the number of lengths, and rows meet on host and beginning. Only the others are tried as patterns. Equal paths of a host are judged once.
    Where the rules are too many to be broadcast, those of a hot host are repeated for each of its SALTS shares of the paths, so that no task gets all of them.
    """
    mine = own_rules(rules, agent).where("path IS NOT NULL").select(F.col("host").alias("h"), "allow", F.col("path").alias("rule"))
    literal = ~F.col("rule").rlike("[*$]")
    few = mine.limit(RULES_BROADCAST + 1).count() <= RULES_BROADCAST
    paths = urls.select("host", "path").distinct().withColumn("share", F.lit(0))
    if few:
        mine = mine.withColumn("salt", F.lit(0))
    else:
        hot = paths.groupBy(F.col("host").alias("hot")).count().where(F.col("count") > HOT_PATHS).select("hot")
        hot = F.broadcast(hot) if hot.limit(HOSTS_BROADCAST + 1).count() <= HOSTS_BROADCAST else hot
        share = F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")
        paths = paths.join(hot, F.col("host") == F.col("hot"), "left").select("host", "path", F.when(F.col("hot").isNotNull(), share).otherwise(0).alias("share"))
        shares = F.sequence(F.lit(0), F.when(F.col("hot").isNotNull(), SALTS - 1).otherwise(0))
        mine = mine.join(hot, F.col("h") == F.col("hot"), "left").select("h", "allow", "rule", F.explode(shares).alias("salt"))
    small = lambda df: F.broadcast(df) if few else df
    same_host = (F.col("host") == F.col("h")) & (F.col("share") == F.col("salt"))
    plain = mine.where(literal).groupBy("h", "salt", "rule").agg(F.max("allow").alias("allow"))
    lengths = plain.groupBy("h", "salt").agg(F.collect_set(F.length("rule")).alias("lengths"))
    probes = paths.join(small(lengths), same_host).select("host", "path", "share", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    found = probes.withColumn("begin", F.substring(F.col("path"), F.lit(1), F.col("n"))).join(small(plain), same_host & (F.col("begin") == F.col("rule")))
    tried = paths.join(small(mine.where(~literal)), same_host).where(rule_matches(F.col("rule"), F.col("path")))
    hits = found.select("host", "path", "n", "allow").unionByName(tried.select("host", "path", rule_length(F.col("rule")).alias("n"), "allow"))
    best = hits.groupBy("host", "path").agg(F.max(F.struct("n", "allow"))["allow"].alias("allowed"))
    best = best.select(F.col("host").alias("h"), F.col("path").alias("p"), "allowed")
    same = F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))
    return urls.join(best, same, "left").select(*urls.columns, F.coalesce("allowed", F.lit(True)).alias("allowed"))
