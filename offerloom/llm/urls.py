"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A rule is a host and a path; it fits its host and all subdomains of it, for URLs whose path starts
with the rule's path. Each URL is therefore looked up under several keys: each end of its host that is
listed, with the beginnings of its path of the lengths that are listed there. Few of those
keys are listed, so they first pass a blocked Bloom filter: a key picks one block of eight 32-bit
words and one bit in each word, and all bits must be set. What passes goes to an exact hash join with
the list, which removes the false positives; the longest rule wins.

The filter is a table of (block, eight words), built with bit_or by Spark and joined on the block: it is
broadcast while its checked size allows, else the join is shuffled. Lookups are done once for
each distinct (host, path), and the verdicts are joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if, small, table

#: Odd multipliers, one for each word of a block; they only have to differ.
SALTS = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]
KEYS_PER_BLOCK = 16
#: Rows of the filter or the list that may be broadcast (40 and about 100 bytes each).
FILTER_BROADCAST, LIST_BROADCAST = 1_000_000, 200_000

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), *LETTERS)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _block_and_bits(host: Column, path: Column, blocks: int) -> tuple[Column, list[Column]]:
    h = F.xxhash64(host, path)
    block = F.pmod(h, F.lit(blocks))
    high = F.shiftrightunsigned(h, 33)  # 31 bits, so that the products below stay in range
    bits = [F.expr(f"shiftleft(1L, cast(shiftright(_high * {s}L, 27) & 31 as int))") for s in SALTS]
    return block, [high, *bits]


def bloom_table(rules: DataFrame, blocks: int) -> DataFrame:
    """block, w0..w7 of the listed keys."""
    block, (high, *bits) = _block_and_bits(F.col("rule_host"), F.col("rule_path"), blocks)
    keyed = rules.select(block.alias("_block"), high.alias("_high"))
    return keyed.groupBy("_block").agg(*[F.bit_or(b).alias(f"_w{i}") for i, b in enumerate(bits)])


def _listed_ends(hosts: DataFrame, lengths: DataFrame, most: int) -> DataFrame:
    """host, _ends: the ends of a host (itself, and what is left without its first labels) that the list has, each with the lengths of its paths there.

    Each distinct host is cut once, so neither the number of labels nor that of lengths in the list makes the plan larger. most: the labels of the list's longest host.
    """
    labels = F.least(F.size(F.split("host", r"\.")), F.lit(most))
    ends = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), labels), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))).alias("rule_host"))
    return ends.join(broadcast_if(lengths, LIST_BROADCAST), "rule_host").groupBy("host").agg(F.collect_list(F.struct("rule_host", "_lengths")).alias("_ends"))


def match_urls(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """All columns of pages as a struct ``row``, with host, path, rule and verdict.

    rules: rule_host, rule_path, verdict. Longest means the most characters of host and path
    together; equal ones (the same rule listed twice) are ordered by verdict, block last and so
    winning. A host in the list never starts with a dot. URLs without a listed key get rule null and
    the default. Null, empty and very long URLs are judged like any other.
    """
    host, path = host_path(pages[url_col])
    urls = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("row"), host.alias("host"), path.alias("path"))
    listed, most = rules.agg(F.count(F.lit(1)), F.max(F.size(F.split("rule_host", r"\.")))).first()
    if not listed:
        return urls.select("row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("_lengths"))
    distinct = urls.select("host", "path").distinct()
    ends = _listed_ends(distinct.select("host").distinct(), lengths, most)
    probes = distinct.join(broadcast_if(ends, LIST_BROADCAST), "host").select("host", "path", F.explode("_ends").alias("_e"))
    probes = probes.select("host", "path", F.col("_e.rule_host").alias("rule_host"), F.explode(F.filter("_e._lengths", lambda m: m <= F.length("path"))).alias("_m"))
    looked = probes.select("host", "path", "rule_host", F.substring(F.col("path"), F.lit(1), F.col("_m")).alias("rule_path"))
    blocks = max(1, -(-listed // KEYS_PER_BLOCK))
    bloom = bloom_table(rules, blocks)
    block, (high, *bits) = _block_and_bits(F.col("rule_host"), F.col("rule_path"), blocks)
    looked = looked.withColumn("_block", block).withColumn("_high", high)
    hit = reduce(lambda a, b: a & b, [F.col(f"_w{i}").bitwiseAND(b) != 0 for i, b in enumerate(bits)])
    possible = looked.join(broadcast_if(bloom, FILTER_BROADCAST), "_block").where(hit).select("host", "path", "rule_host", "rule_path")
    exact = possible.join(broadcast_if(rules, LIST_BROADCAST), ["rule_host", "rule_path"])
    rule = F.concat("rule_host", "rule_path")
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), F.col("verdict").alias("v"), rule.alias("rule"))).alias("best"))
    best = best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "best")
    out = urls.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return out.select("row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "rule_host string, rule_path string, verdict string")
    return match_urls(pages, rules).select("row.page_id", "host", "path", "rule", "verdict")


QUERIES = {"op2_url_filter": op2_url_filter}

ORACLES = {
    "op2_url_filter": r"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
m AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
      FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
""",
}
