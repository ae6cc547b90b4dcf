"""Offers to catalog products: by article number, else by title rules.

A title rule asks for words that may stand anywhere in a title, inside other words too. So that titles and rules meet by equality only, distinct
titles look up the required strings by a piece of three letters, walk a prefix tree of the rules' strings, and meet products by rule and size.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.functions import gtin as G
from offerloom.functions import money as M
from offerloom.functions.text import plain, tokens

#: A catalog is broadcast up to this many products; a larger one is joined by shuffle.
CATALOG_BROADCAST = 100_000
#: Stands for sizes that need a pattern.
ODD_SIZE = "*"
#: Lists of products by group are broadcast up to this many products.
MEMBERS_BROADCAST = 2_000_000


def _broadcast(df: DataFrame, rows: int = CATALOG_BROADCAST) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _size_key(size: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(size), r"\s", ""), "^0+", "")


def has_size(plain_title: Column, size: Column) -> Column:
    """The title names the size: after maat, maten, size, mt or nr, or as s4 or t4. No size passes."""
    pattern = F.concat(F.lit(r"\b(?:(?:maat|maten|size|mt|nr)\s*0*|s|t)"), _size_key(size), F.lit(r"\b"))
    return F.coalesce(size == "", F.lit(True)) | F.coalesce(F.call_function("rlike", plain_title, pattern), F.lit(False))


def named_sizes(plain_title: Column) -> Column:
    """All sizes of letters and digits that ``has_size`` would find."""
    after_word = F.regexp_extract_all(plain_title, F.lit(r"(?<![a-z0-9])(?:maat|maten|size|mt|nr)(?=\s*0*([a-z0-9]+))"), F.lit(1))
    return F.array_union(after_word, F.regexp_extract_all(plain_title, F.lit(r"(?<![a-z0-9])[st]([a-z0-9]+)"), F.lit(1)))


def verdict(title: Column, c: dict[str, Column]) -> Column:
    """The first reason against a title, or ``ok``. c: plain_title, must, none (plain words), brand, size, pack."""
    t = c["plain_title"]
    missing = F.try_element_at(F.filter(c["must"], lambda w: ~F.contains(t, w)), F.lit(1))
    extra = F.try_element_at(F.filter(c["none"], lambda w: F.contains(t, w)), F.lit(1))
    wrong_pack = c["pack"].isNotNull() & F.coalesce(F.abs(M.parse_pack_size(title)["amount"] - c["pack"]) > 0.01, F.lit(True))
    return (
        F.when(F.coalesce(title, F.lit("")) == "", "no title")
        .when(missing.isNotNull(), F.concat(F.lit("misses "), missing))
        .when(extra.isNotNull(), F.concat(F.lit("has "), extra))
        .when(F.coalesce(c["brand"] != "", F.lit(False)) & ~F.contains(t, c["brand"]), "brand")
        .when(F.coalesce(c["size"] != "", F.lit(False)) & ~has_size(t, c["size"]), "size")
        .when(wrong_pack, "pack size")
        .otherwise("ok")
    )


def score(title_tokens: Column, query_tokens: Column) -> Column:
    """Ten times the share of the query's words, plus up to one for a short title; four decimals."""
    q, t = F.size(query_tokens), F.size(title_tokens)
    covered = F.when(q > 0, F.size(F.array_intersect(query_tokens, title_tokens)) / q).otherwise(0.0)
    return F.round(covered * 10 + 1 / (1 + F.greatest(t - q, F.lit(0)) / 10), 4)


def prepared(catalog: DataFrame) -> DataFrame:
    """The rules of the products without article numbers in plain form, once per product. size_mark: the size as titles name it, nothing, or ODD_SIZE."""
    brand = plain(F.coalesce("brand", F.lit("")))
    must, none = F.transform("must", plain), F.transform("none", plain)
    key = _size_key(F.col("size"))
    mark = F.when(F.coalesce(F.col("size"), F.lit("")) == "", "").when(key.rlike("^[a-z0-9]+$"), key).otherwise(ODD_SIZE)
    return catalog.where(F.coalesce(F.size("gtins"), F.lit(0)) <= 0).select(
        "product",
        F.md5(F.to_json(F.struct(brand, must, none))).alias("rule"),
        must.alias("must"),
        none.alias("none"),
        brand.alias("rule_brand"),
        F.col("size").alias("rule_size"),
        mark.alias("size_mark"),
        F.col("match_pack").alias("rule_pack"),
        tokens(plain(F.coalesce("query", "name"))).alias("query_tokens"),
    )


def match_by_gtin(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows whose article number is in a product's list, with that product and score 100. A number listed twice is the last product's: the last by
    ``position`` if the catalog has that column, else by id."""
    place = "position" if "position" in catalog.columns else "product"
    listed = catalog.select("product", F.col(place).alias("place"), F.explode("gtins").alias("g")).select("product", "place", G.normalize_gtin("g").alias("gtin")).where("gtin IS NOT NULL")
    listed = listed.groupBy("gtin").agg(F.max_by("product", "place").alias("product"))
    return rows.join(_broadcast(listed), "gtin").withColumn("score", F.lit(100.0))


# --- strings in titles ---


def _pieces(text: Column) -> Column:
    """The distinct runs of three letters; the whole text if it is shorter."""
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, 3)))
    return F.when(F.length(text) >= 3, runs).otherwise(F.array(text))


def keyed_strings(strings: DataFrame) -> DataFrame:
    """strings (s, distinct) with piece: of each string's pieces the one that the fewest strings have."""
    pieces = strings.where("s <> ''").select("s", F.explode(_pieces(F.col("s"))).alias("piece"))
    counts = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    return pieces.join(counts, "piece").groupBy("s").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))


def strings_in(titles: DataFrame, keyed: DataFrame, few: bool | None = None) -> DataFrame:
    """title, plain_title, s: every string that a title contains. titles: title, plain_title; keyed: of keyed_strings; few: they are known to fit a broadcast."""
    t, empty = F.col("plain_title"), F.array().cast("array<string>")

    def runs(n: int) -> Column:
        return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, n))).otherwise(empty)

    lengths = sorted(r["n"] for r in keyed.select(F.length("piece").alias("n")).distinct().collect())  # of 1, 2 and 3
    found = F.array_distinct(F.concat(empty, *[runs(n) for n in lengths]))
    return titles.select("title", "plain_title", F.explode(found).alias("piece")).join(F.broadcast(keyed) if few else _broadcast(keyed), "piece").where(F.contains(t, F.col("s"))).select("title", "plain_title", "s")


class Rules(NamedTuple):
    """The catalog's title rules as tables to be joined: required strings, a prefix tree of them, rules by the node at which they end, groups of products by rule and size.

    Products of a group have equal rules, sizes, packs and queries: they match the same rows with equal scores. members has each group's products.
    few: all but members fit a broadcast. unique: no product is listed twice. depth: the most strings that a rule requires.
    """

    strings: DataFrame
    edges: DataFrame
    ends: DataFrame
    groups: DataFrame
    members: DataFrame
    few: bool
    unique: bool
    depth: int

    def small(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if self.few else table


def _kept(df: DataFrame) -> DataFrame:
    """Worked out once for the joins that read it: a table on the storage that the session shares, or where it has none, kept with the executors."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        return df.persist()
    path = f"{folder}/rules-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ROOT = 0


def title_rules(catalog: DataFrame) -> Rules:
    """The tree of the catalog's rules: a rule is the path of its required strings, the rarest first, so a title leaves it as soon as one is missing. A node is
    the hash of the strings to it; what a hash may mix up is told apart by the rule itself in the end. A rule's end is a node of its own below its last string."""
    alike = F.md5(F.to_json(F.struct("rule", "rule_size", "rule_pack", "query_tokens")))
    products = _kept(prepared(catalog).withColumn("group", alike))
    kinds = ["group", "rule", "rule_size", "size_mark", "rule_pack", "query_tokens"]
    alike = _kept(products.groupBy("group").agg(*[F.first(c).alias(c) for c in kinds[1:]], F.collect_list("product").alias("products")))
    few = alike.count() <= CATALOG_BROADCAST  # there are no more rules than groups
    n = catalog.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("product").alias("products")).first()
    members = alike.select("group", "products")
    members = F.broadcast(members) if few and n["rows"] <= MEMBERS_BROADCAST else members
    groups = products.groupBy("rule").agg(F.first("rule_brand").alias("rule_brand"), F.first("must").alias("must"), F.first("none").alias("none"))
    required = F.filter(F.array_distinct(F.concat("must", F.array("rule_brand"))), lambda w: w != "")
    strings = groups.select("rule", F.explode(required).alias("s"))
    counts = strings.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    paths = strings.join(counts, "s").groupBy("rule").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]).alias("path"))
    groups = groups.join(paths, "rule", "left").withColumn("path", F.coalesce("path", F.array().cast("array<string>")))

    def node(n: Column) -> Column:
        return F.when(n > 0, F.xxhash64(F.slice("path", F.lit(1), n))).otherwise(F.lit(ROOT).cast("long"))

    size = F.size("path")
    end = F.xxhash64(node(size), F.lit("end")).alias("end")
    groups = _kept(groups.select("rule", "rule_brand", "must", "none", "path", node(size).alias("last"), end))
    steps = groups.where(size > 0).select("path", F.explode(F.sequence(F.lit(1), size)).alias("i"))
    edges = steps.select(node(F.col("i") - 1).alias("parent"), F.element_at("path", F.col("i")).alias("s"), node(F.col("i")).alias("node"))
    # from its last string a rule goes to its end without one, and stays there
    stops = groups.select(F.explode(F.array(F.struct(F.col("last").alias("parent"), "end"), F.struct(F.col("end").alias("parent"), "end"))).alias("e")).select("e.parent", F.lit("").alias("s"), F.col("e.end").alias("node"))
    depth = groups.agg(F.max(size)).first()[0] or 0
    ends = groups.select("end", "rule", "rule_brand", "must", "none")
    return Rules(_kept(keyed_strings(strings.select("s").distinct())), _kept(edges.unionByName(stops).distinct()), ends, alike.select(*kinds), members, few, n["rows"] == n["products"], depth)


def titles_rules(titles: DataFrame, rules: Rules) -> DataFrame:
    """title, plain_title, rule: of titles (title, plain_title) every rule whose required strings it has, and none that it must not have. One equi-join a level of the tree."""
    found = strings_in(titles, rules.strings, rules.few).unionByName(titles.withColumn("s", F.lit("")))
    at = found.groupBy("title", "plain_title").agg(F.collect_set("s").alias("found")).withColumn("node", F.lit(ROOT).cast("long"))
    for _ in range(rules.depth + 1):
        step = at.select("title", "plain_title", "found", "node", F.explode("found").alias("s"))
        edges = rules.small(rules.edges).select(F.col("parent"), F.col("s").alias("_s"), F.col("node").alias("_node"))
        at = step.join(edges, (F.col("node") == F.col("parent")) & (F.col("s") == F.col("_s"))).select("title", "plain_title", "found", F.col("_node").alias("node"))
    t = F.col("plain_title")
    fits = F.contains(t, F.col("rule_brand")) & F.forall("must", lambda w: F.contains(t, w)) & ~F.exists("none", lambda w: F.contains(t, w))
    return at.join(rules.small(rules.ends), F.col("node") == F.col("end")).where(fits).select("title", "plain_title", "rule")


def match_groups(rows: DataFrame, rules: Rules) -> DataFrame:
    """Rows with every group of products whose rules the title passes, and the score. Equal titles are judged once."""
    titles = rows.select("title").distinct().select("title", plain(F.coalesce("title", F.lit(""))).alias("plain_title")).where("plain_title <> ''")
    t = F.col("plain_title")
    marks = F.array_union(named_sizes(t), F.array(F.lit(""), F.lit(ODD_SIZE)))
    near = titles_rules(titles, rules).select("title", "plain_title", "rule", tokens("plain_title").alias("title_tokens"), F.explode(marks).alias("size_mark")).join(rules.small(rules.groups), ["rule", "size_mark"])
    sized = (F.col("size_mark") != ODD_SIZE) | has_size(t, F.col("rule_size"))
    packed = F.col("rule_pack").isNull() | F.coalesce(F.abs(M.parse_pack_size("title")["amount"] - F.col("rule_pack")) <= 0.01, F.lit(False))
    matched = near.where(sized & packed).select("title", "group", score(F.col("title_tokens"), F.col("query_tokens")).alias("score"))
    return rows.join(matched, "title").select(*rows.columns, "group", "score")


def with_products(grouped: DataFrame, rules: Rules) -> DataFrame:
    """A row for each product of a row's group instead of it."""
    rest = [c for c in grouped.columns if c != "group"]
    return grouped.join(rules.members, "group").select(*rest, F.explode("products").alias("product"))


def match_by_title(rows: DataFrame, catalog: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Rows with every product (of those without article numbers) whose rules the title passes, and the score."""
    rules = rules or title_rules(catalog)
    return with_products(match_groups(rows, rules), rules).select(*rows.columns, "product", "score")


def without_listed(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows whose article number no product lists."""
    listed = catalog.select(F.explode("gtins").alias("g")).select(G.normalize_gtin("g").alias("gtin")).where("gtin IS NOT NULL").distinct()
    return rows.join(_broadcast(listed), "gtin", "left_anti")


def match_rows(rows: DataFrame, catalog: DataFrame, rules: Rules | None = None) -> DataFrame:
    """By article number where a product lists it, by title otherwise."""
    by_title = match_by_title(without_listed(rows, catalog), catalog, rules)
    return match_by_gtin(rows, catalog).select(*rows.columns, "product", "score").unionByName(by_title)


def best_matches(rows: DataFrame, catalog: DataFrame, order: Column, rules: Rules | None = None) -> DataFrame:
    """``best_rows`` per shop and product of ``match_rows``. Products of a group have the same best row, so it is found once a group, and rows aren't shuffled for each product.
    A product has article numbers or title rules, so the two kinds of matches share none, unless the catalog lists products twice."""
    rules = rules or title_rules(catalog)
    numbered = best_rows(match_by_gtin(rows, catalog).select(*rows.columns, "product", "score"), ["shop", "product"], order)
    titled = with_products(best_rows(match_groups(without_listed(rows, catalog), rules), ["shop", "group"], order), rules)
    out = numbered.unionByName(titled)
    return out if rules.unique else best_rows(out, ["shop", "product"], order)


def best_rows(matched: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Per key the highest score, then the lowest price, then the first row. max_by is merged map-side, so hot products don't skew it."""
    whole = F.struct(*[c for c in matched.columns if c not in keys])
    best = matched.groupBy(*keys).agg(F.max_by(whole, F.struct(F.col("score"), -F.col("price"), -order)).alias("r"))
    return best.select(*keys, "r.*")


def diagnose(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per product and reason the number of brand-mates' titles: why candidates were or weren't accepted.

    Equal titles are counted first. A title is judged once per rule group, and where the words pass, once per size and pack of the
    group; products are joined to the counts, not to the titles.
    """
    rules = prepared(catalog)
    key = ["rule_brand", "must", "none"]
    counted = rows.groupBy("title").agg(F.count(F.lit(1)).alias("n")).withColumn("plain_title", plain(F.coalesce("title", F.lit(""))))
    brands = keyed_strings(rules.select(F.col("rule_brand").alias("s")).distinct())
    # products without a brand take every title
    mates = strings_in(counted.select("title", "plain_title"), brands).withColumnRenamed("s", "rule_brand")
    titles = counted.withColumn("rule_brand", F.lit("")).unionByName(mates.join(counted.select("title", "n"), "title"))
    groups = rules.groupBy(*key).agg(F.collect_set(F.struct("rule_size", "rule_pack")).alias("sizes"))
    rule = {"plain_title": F.col("plain_title"), "must": F.col("must"), "none": F.col("none"), "brand": F.col("rule_brand"), "size": F.lit(None).cast("string"), "pack": F.lit(None).cast("double")}
    judged = titles.join(_broadcast(groups), "rule_brand").withColumn("words", verdict(F.col("title"), rule))
    # a title whose words fail has the same reason for every size: one row with a null
    every = F.array(F.lit(None).cast("struct<rule_size:string,rule_pack:double>"))
    judged = judged.select(*key, "title", "plain_title", "n", "words", F.explode(F.when(F.col("words") == "ok", F.col("sizes")).otherwise(every)).alias("s"))
    passed = F.array().cast("array<string>")
    sized = verdict(F.col("title"), rule | {"must": passed, "none": passed, "size": F.col("s.rule_size"), "pack": F.col("s.rule_pack")})
    counts = judged.select(*key, "s", F.when(F.col("s").isNull(), F.col("words")).otherwise(sized).alias("reason"), "n").groupBy(*key, "s", "reason").agg(F.sum("n").alias("n"))
    # a product has the counts of its whole group and those of its size and pack
    ends = rules.select("product", *key, "rule_size", "rule_pack", F.explode(F.array(F.lit(True), F.lit(False))).alias("every"))
    ends = ends.select("product", *key, "every", F.when(~F.col("every"), F.struct("rule_size", "rule_pack")).alias("s"))
    counts = counts.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("s").isNull().alias("_every"), F.col("s.rule_size").alias("_size"), F.col("s.rule_pack").alias("_pack"), "reason", "n")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*key, "every"]] + [F.col("s.rule_size").eqNullSafe(F.col("_size")), F.col("s.rule_pack").eqNullSafe(F.col("_pack"))]
    return ends.join(counts, same).groupBy("product", "reason").agg(F.sum("n").alias("n"))


def confirmed_candidates(candidates: DataFrame, pages: DataFrame, max_checks: int = 3) -> DataFrame:
    """Per (product, shop) the best candidates by score, at most max_checks, and of these the first whose page is confirmed.

    candidates: product, shop, url, score. pages: url, confirmed, and what a page says.
    """
    top = F.row_number().over(W.partitionBy("product", "shop").orderBy(F.desc("score"), "url"))
    few = candidates.withColumn("rn", top).where(F.col("rn") <= max_checks)
    ok = few.join(pages.where("confirmed"), "url")
    whole = F.struct(*[c for c in ok.columns if c not in ("product", "shop")])
    return ok.groupBy("product", "shop").agg(F.min_by(whole, "rn").alias("r")).select("product", "shop", "r.*")
