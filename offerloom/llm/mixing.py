"""Mixing sources to target weights by Pareto order sampling (native: DataFrame functions only).

Sources get weights by code point order, share a budget of words by weight, and stop at a
multiple of what they hold; what a capped source can't use is shared among the others by weight
(water filling, solved in closed form with one window over the per-source table).

Within a source documents have unequal chances: the expected number of copies ``e`` is in proportion to a document's
weight, up to the most copies, and what documents at that limit can't use goes to the others (again in closed form, over the table of
weights, which has at most WEIGHTS rows a source). Every document first gets its certain whole copies, ``floor(e)``. The fraction left is drawn by Pareto order sampling: documents are ranked
by the odds of a per-document random number divided by the odds of their inclusion, and the
smallest ranks are taken. The sample's size is fixed in words: the ranking is cut where the words
taken come nearest to the target. The cut is found without gathering a source in one task: rank
histograms (65,536 bins for each source, summed map-side) give the bin that holds the cut, and
only the documents of that one bin are sorted. Every document is then judged on its own row
against its source's cut, so a source with a third of all rows is just more rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Scratch, broadcast_if, fresh, table

BINS = 256
#: Weights of documents are whole numbers from 1 to this.
WEIGHTS = 1000
#: The per-source table is broadcast up to this many sources, else joined by shuffle.
SOURCES_BROADCAST = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key alone, so that reruns and lost tasks agree."""
    hexed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(hexed, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(totals: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source, source_size -> + target: share of all words by weight, capped at cap * source_size."""
    everything = W.partitionBy(F.lit(0))
    by_code_point = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_limit = W.partitionBy(F.lit(0)).orderBy("_limit", F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    t = totals.withColumn("_i", (F.row_number().over(by_code_point) - 1) % len(weights))
    t = t.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") + 1).cast("int")))
    t = t.withColumn("_cap", F.lit(float(cap)) * F.col("source_size")).withColumn("_limit", F.col("_cap") / F.col("_w"))
    t = t.withColumn("_budget", F.lit(float(share)) * F.sum("source_size").over(everything))
    # level: words for each unit of weight if all before this source are capped and it and all after are not
    t = t.withColumn("_rest_w", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    t = t.withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.col("_rest_w"))
    t = t.withColumn("_water", F.min(F.when(F.col("_level") <= F.col("_limit"), F.struct("_limit", "_level"))).over(everything)["_level"])
    return t.select("source", "source_size", F.coalesce(F.least(F.col("_cap"), F.col("_water") * F.col("_w")), F.col("_cap")).alias("target"))


def rates(levels: DataFrame, per_source: DataFrame, cap: float) -> DataFrame:
    """_source, _rate: the expected copies of a document of weight w are least(cap, rate * w), and all of a source's make its target.
    levels: _source, _p, _words (the words of the source's documents of that weight)."""
    t = levels.join(broadcast_if(per_source.select(F.col("source").alias("_ts"), "target"), SOURCES_BROADCAST), F.col("_source").eqNullSafe(F.col("_ts"))).drop("_ts")
    above = W.partitionBy("_source").orderBy(F.desc("_p")).rowsBetween(W.unboundedPreceding, -1)
    below = W.partitionBy("_source").orderBy(F.desc("_p")).rowsBetween(0, W.unboundedFollowing)
    # the rate if all heavier documents are at the limit and neither this weight nor a lighter one is: right for the heaviest weight that it keeps below
    left = F.col("target") - F.lit(float(cap)) * F.coalesce(F.sum("_words").over(above), F.lit(0)).cast("double")
    t = t.withColumn("_left", left).withColumn("_mass", F.sum(F.col("_p") * F.col("_words")).over(below).cast("double"))
    t = t.withColumn("_r", F.when(F.col("_mass") > 0, F.col("_left") / F.col("_mass")))
    ok = F.col("_r") * F.col("_p") <= F.lit(float(cap))
    return t.groupBy("_source").agg(F.coalesce(F.max(F.when(ok, F.struct("_p", "_r")))["_r"], F.when(F.max("_mass") > 0, F.lit(float(cap))), F.lit(0.0)).alias("_rate"))


def _ranked(sized: DataFrame, per_source: DataFrame, max_copies: int) -> DataFrame:
    """Adds whole copies and the Pareto rank, mapped to (0, 1) by q / (1 + q)."""
    s = sized.join(broadcast_if(per_source, SOURCES_BROADCAST).withColumnRenamed("source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    s = s.withColumn("_e", F.least(F.lit(float(max_copies)), F.col("_rate") * F.col("_p"))).withColumn("_whole", F.floor("_e").cast("long"))
    pi = F.col("_e") - F.col("_whole")
    q = F.col("_u") / (1 - F.col("_u")) * (1 - pi) / pi
    return s.withColumn("_v", F.when((pi > 0) & (F.col("_whole") < max_copies) & (F.col("_size") > 0), q / (1 + q)))


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    max_copies: int = 2,
    propensity: Column | None = None,
    seed: int = 7,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per input row: the kept columns, then mix_size, mix_source_size, mix_target, mix_copies (with an underscore more where a kept column has that name).

    keep: columns of docs to carry (all by default). propensity: a document's weight within its source, a whole number from 1 to
    WEIGHTS (rounded up, and put into that range; null counts as 1); equal by default. The random number depends on seed and id: rows that
    repeat an id and their weight are taken or left together. Null texts have size 0; null sources are a source of
    their own, ordered last; a source without words has target 0 and its documents get no copies.
    An empty table gives an empty result. Columns of docs may carry any names.
    """
    mixed, kept = _mixed(docs, id_col, text_col, source_col, weights, share, max_copies, propensity, seed, docs.columns if keep is None else keep)
    marks = [F.col(c).alias(fresh(kept, f"mix{c}")) for c in ("_size", "_source_size", "_target", "_copies")]
    return mixed.select(*[F.col("_row").getField(c).alias(c) for c in kept], *marks)


def mixed_rows(docs: DataFrame, *, propensity: Column | None = None, seed: int = 7, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, max_copies: int = 2) -> DataFrame:
    """The mix itself: every row of docs (doc_id, text, source and any other columns) as often as it is taken."""
    mixed, kept = _mixed(docs, "doc_id", "text", "source", weights, share, max_copies, propensity, seed, docs.columns)
    times = F.when(F.col("_copies") > 0, F.sequence(F.lit(1), F.col("_copies").cast("int"))).otherwise(F.array().cast("array<int>"))
    return mixed.select("_row", F.explode(times).alias("_copy")).select(*[F.col("_row").getField(c).alias(c) for c in kept])


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, max_copies: int, propensity: Column | None, seed: int, kept: list[str]) -> tuple[DataFrame, list[str]]:
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    p = F.lit(1) if propensity is None else F.least(F.greatest(F.coalesce(F.ceil(propensity.cast("double")), F.lit(1)), F.lit(1)), F.lit(WEIGHTS)).cast("int")
    marks = [docs[source_col].alias("_source"), word_count(docs[text_col]).alias("_size"), uniform(docs[id_col], seed).alias("_u"), p.alias("_p")]
    carry = F.struct(*[docs[c] for c in kept]).alias("_row")
    narrow = set(kept) <= {id_col, source_col}
    sized = scratch.save(docs.select(carry, *marks) if narrow else docs.select(*marks), "sized")
    levels = scratch.save(sized.groupBy("_source", "_p").agg(F.sum("_size").alias("_words")), "levels")
    sums = levels.groupBy("_source").agg(F.sum("_words").alias("source_size")).withColumnRenamed("_source", "source")
    per_source = targets(sums, weights, share, float(max_copies))
    rate = rates(levels, per_source, float(max_copies))
    per_source = scratch.save(per_source.join(rate, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "targets")

    ranked = _ranked(sized, per_source, max_copies)
    whole = W.partitionBy("_source")
    needs = ranked.groupBy("_source").agg(
        (F.max("target") - F.sum(F.col("_size") * F.col("_whole"))).alias("_need"), F.sum(F.when(F.col("_v").isNotNull(), F.col("_size")).otherwise(0)).alias("_all")
    )
    needs = scratch.save(needs, "needs")
    # the bin in which the words taken pass what is needed, then the bin within that bin: no source has more than BINS rows in a window
    inside = ranked.where("_v IS NOT NULL").select("_source", "_size", "_v")
    at = needs.select(F.col("_source").alias("_cs"), F.col("_need").alias("_left"))
    for level in (1, 2):
        near = inside.join(broadcast_if(at, SOURCES_BROADCAST), F.col("_source").eqNullSafe(F.col("_cs"))).withColumn("_bin", F.floor(F.col("_v") * BINS**level).cast("int"))
        bins = near.groupBy("_source", "_bin").agg(F.sum("_size").alias("_open"), F.max("_left").alias("_need"))
        bins = bins.withColumn("_to", F.sum("_open").over(whole.orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)))
        cut = bins.where((F.col("_to") - F.col("_open") < F.col("_need")) & (F.col("_need") <= F.col("_to")))
        at = scratch.save(cut.select(F.col("_source").alias("_cs"), F.col("_bin").alias("_cut_bin"), (F.col("_need") - (F.col("_to") - F.col("_open"))).alias("_left")), f"bins{level}")
        in_bin = F.col("_source").eqNullSafe(F.col("_cs")) & (F.floor(F.col("_v") * BINS**level).cast("int") == F.col("_cut_bin"))
        inside = inside.join(broadcast_if(at, SOURCES_BROADCAST), in_bin, "left_semi")
    inside = inside.join(broadcast_if(at, SOURCES_BROADCAST), F.col("_source").eqNullSafe(F.col("_cs")))
    # rows of equal rank (repeated ids) count together: a range frame takes peers as one
    steps = inside.groupBy("_cs", "_v").agg(F.sum("_size").alias("_size"), F.max("_left").alias("_left"))
    steps = steps.withColumn("_taken", F.sum("_size").over(W.partitionBy("_cs").orderBy("_v")))
    nearest = steps.groupBy("_cs").agg(
        F.max("_left").alias("_left"),
        F.min(F.struct(F.abs(F.col("_taken") - F.col("_left")).alias("gap"), F.col("_v").alias("v"))).alias("_best"),
        F.min("_v").alias("_first"),
    )
    # taking none of the bin is nearer when even its first document overshoots by more
    cut = F.when(F.col("_best.gap") <= F.col("_left"), F.col("_best.v")).otherwise(F.col("_first") - F.lit(2.0**-40))
    cuts = nearest.select(F.col("_cs"), cut.alias("_cut"))
    # a source whose sample takes every open document has no cut bin: all of them are taken if words are needed
    cuts = needs.join(cuts, F.col("_source").eqNullSafe(F.col("_cs")), "left").select(
        F.col("_source").alias("_fs"), F.coalesce("_cut", F.when(F.col("_need") > F.col("_all"), F.lit(2.0)).otherwise(F.lit(-1.0))).alias("_cut")
    )
    cuts = scratch.save(cuts, "cuts")
    rows = sized if narrow else docs.select(carry, *marks)
    out = _ranked(rows, per_source, max_copies).join(broadcast_if(cuts, SOURCES_BROADCAST), F.col("_source").eqNullSafe(F.col("_fs")), "left")
    copies = F.col("_whole") + F.when(F.col("_v") <= F.col("_cut"), 1).otherwise(0)
    return out.select("_row", "_size", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.coalesce(copies, F.lit(0)).cast("long").alias("_copies")), kept


def by_length(docs: DataFrame, text_col: str = "text") -> Column:
    """Weights 1 to 10: a document counts more for every 50 words, up to 450."""
    return 1 + F.least(F.lit(9), F.floor(word_count(docs[text_col]) / 50))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix_sources(docs, keep=["doc_id", "source"], propensity=by_length(docs))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
        F.col("mix_copies").alias("copies"),
    )


QUERIES = {"op7_source_mix": op7_source_mix}

ORACLES = {
    "op7_source_mix": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, 1 + least(9, size // 50) AS p,
         (('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
             2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
l AS (SELECT *, cap / w AS lim,
             (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
water AS (SELECT arg_min(level, lim) AS water FROM l WHERE level <= lim),
t AS (SELECT source, source_size, least(cap, water * w) AS target FROM l, water),
lv AS (SELECT source, p, sum(size) AS words FROM sized GROUP BY ALL),
ra AS (SELECT lv.source, p, (target - 2.0::DOUBLE * CAST(coalesce(sum(words) OVER (PARTITION BY lv.source ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)) AS rest,
         CAST(sum(p * words) OVER (PARTITION BY lv.source ORDER BY p DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS mass FROM lv JOIN t ON lv.source IS NOT DISTINCT FROM t.source),
rate AS (SELECT source, coalesce(arg_max(rest / mass, p) FILTER (mass > 0 AND rest / mass * p <= 2.0::DOUBLE), CASE WHEN max(mass) > 0 THEN 2.0::DOUBLE END, 0.0::DOUBLE) AS rate FROM ra GROUP BY source),
e AS (SELECT sized.*, source_size, target, least(2.0::DOUBLE, rate * p) AS e FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source JOIN rate ON sized.source IS NOT DISTINCT FROM rate.source),
v AS (SELECT *, floor(e) AS whole, CASE WHEN e > floor(e) AND floor(e) < 2 AND size > 0 THEN (u / (1 - u)) * (1 - (e - floor(e))) / (e - floor(e)) END AS q FROM e),
need AS (SELECT source, max(target) - sum(size * whole) AS need FROM v GROUP BY source),
c AS (SELECT v.source, q, need, sum(size) OVER (PARTITION BY v.source ORDER BY q) AS taken FROM v JOIN need ON v.source IS NOT DISTINCT FROM need.source WHERE q IS NOT NULL
      UNION ALL SELECT source, -1, need, 0 FROM need),
cut AS (SELECT source, arg_min(q, abs(taken - need)) AS cut FROM c GROUP BY source)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN q <= cut THEN 1 ELSE 0 END) * size AS BIGINT) AS taken,
       CAST(whole + CASE WHEN q <= cut THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM v JOIN cut ON v.source IS NOT DISTINCT FROM cut.source
""",
}
