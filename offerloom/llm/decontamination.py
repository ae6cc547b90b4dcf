"""Benchmark decontamination by template canonicalisation (native: DataFrame functions only).

Numbers, names and units become typed placeholders, so that a question with other numbers or names keeps
its template. Windows of template words are joined by hash with those of the benchmark; along one
alignment of a document with an item (document position minus item position) the slots must be
consistent: an item's value always has the same value in the document. An item is found in a
document if consistent windows cover enough of the item's windows.

Items that are short, or of hardly more than numbers and names, have no window of eight words that is specific. Their windows
(of all their words, if there are fewer than eight) have to be found all of them, along one alignment; and where even these hold too few literal words,
with the very values, so that such an item is found verbatim only.

A document's windows first pass a bit filter of the benchmark's window hashes inside the row, so only
likely windows leave it; documents themselves are never shuffled. The filter has a fixed largest size: a benchmark that
fills it costs time, not results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if, table

WINDOW = 8
#: Words of a window that are not placeholders, at least; share of an item's windows that has to be found.
LITERALS, SHARE = 5, 0.5
#: The same for items without such a window: fewer literal words are enough for a template if all windows are found.
WEAK_LITERALS = 3
FILTER_LONGS = 1 << 16
WINDOWS_BROADCAST, FOUND_BROADCAST = 200_000, 500_000
UNITS = (
    "mm cm dm m km in ft yd mi mg g kg t oz lb lbs ml cl dl l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months "
    "year years c f k pa kpa bar v w kw kwh mw j kj cal kcal hz khz mhz ghz b kb mb gb tb percent dollar dollars cent cents euro euros pound pounds usd eur gbp meter meters "
    "metre metres kilometer kilometers mile miles gram grams kilogram kilograms liter liters litre litres stunde stunden tag tage heure heures jour jours hora horas"
).split()


def template_words(docs: DataFrame, text: Column) -> DataFrame:
    """Adds ``words``: lower-cased words without outer punctuation; a number, name or unit keeps its value behind its
    type (``<num>12``, ``<name>Paris``, ``<unit>kg``). A name is a capitalised word that doesn't start a sentence."""
    raw = F.split(text, r"[\x20\x09-\x0D]+")
    bare = F.transform("_raw", lambda t: F.when(t.rlike(r"^[a-z]+$"), t).otherwise(F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    d = docs.withColumn("_raw", raw).withColumn("_bare", bare)

    def typed(word: Column, i: Column) -> Column:
        before = F.get(F.col("_raw"), i - 1)
        first = F.substring(word, 1, 1)
        low = F.lower(word)
        number = first.between("0", "9")
        unit = before.isNotNull() & before.rlike(r"^\W*[0-9]") & low.isin(UNITS)
        name = (first != F.lower(first)) & before.isNotNull() & (before != "") & ~before.rlike(r"[.!?:|]\W*$")
        return F.when(number, F.concat(F.lit("<num>"), low)).when(name & ~unit, F.concat(F.lit("<name>"), word)).when(unit, F.concat(F.lit("<unit>"), low)).otherwise(low)

    return d.withColumn("words", F.filter(F.transform("_bare", typed), lambda w: w != "")).drop("_raw", "_bare")


def _template(word: Column) -> Column:
    return F.when(word.startswith("<"), F.substring_index(word, ">", 1)).otherwise(word)


def _with_hashes(d: DataFrame, exact: bool) -> DataFrame:
    """Adds the template words' hashes, and if asked for those of the words with their values."""
    d = d.withColumn("_hashes", F.transform("words", lambda w: F.xxhash64(_template(w))))
    return d.withColumn("_values", F.transform("words", lambda w: F.xxhash64(w))) if exact else d


def _gram(at: Column, k: int, exact: bool, window: int) -> Column:
    """Hash of k words from a place on; windows of other kinds than the usual one have their kind in it."""
    words = [F.get(F.col("_values" if exact else "_hashes"), at + j) for j in range(k)]
    return F.xxhash64(*words) if k == window and not exact else F.xxhash64(F.lit(k), F.lit(exact), *words)


def _gram_at(k: int, exact: bool, window: int):
    return lambda at: _gram(at, k, exact, window)


def _places(n: Column, k: Column | int) -> Column:
    k = F.lit(k) if isinstance(k, int) else k
    return F.when((n >= k) & (k > 0), F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))


def item_windows(items: DataFrame, window: int, literals: int, share: float, weak_literals: int) -> DataFrame:
    """item_id, item_at, k, exact, gram, item_words, share, whole (share is that of one alignment). items: item_id, _text."""
    d = _with_hashes(template_words(items, F.col("_text")).drop("_text"), True)
    n = F.size("words")
    k = F.least(F.lit(window), n)
    cut = lambda i: F.slice(F.col("words"), i + 1, k)
    plain = lambda i: F.size(F.filter(cut(i), lambda w: ~w.startswith("<")))
    d = d.select("item_id", "words", "_hashes", "_values", k.alias("k"), F.transform(_places(n, k), lambda i: F.struct(i.alias("at"), cut(i).alias("item_words"), plain(i).alias("plain"))).alias("w"), _row())
    d = d.where("_row >= 0")
    most = F.array_max(F.transform("w", lambda w: w["plain"]))
    level = F.when((F.col("k") == window) & (most >= literals), 0).when(most >= weak_literals, 1).otherwise(2)
    least = F.when(F.col("level") == 0, literals).when(F.col("level") == 1, weak_literals).otherwise(0)
    d = d.withColumn("level", level).withColumn("w", F.filter("w", lambda w: w["plain"] >= least))
    d = d.select("item_id", "_hashes", "_values", "k", (F.col("level") == 2).alias("exact"), F.when(F.col("level") == 0, share).otherwise(1.0).alias("share"), (F.col("level") > 0).alias("whole"), F.explode("w").alias("w"))
    gram = F.lit(None).cast("long")
    for size in range(1, window + 1):
        for exact in (False, True):
            gram = F.when((F.col("k") == size) & (F.col("exact") == exact), _gram(F.col("w.at"), size, exact, window)).otherwise(gram)
    return d.select("item_id", F.col("w.at").alias("item_at"), "k", "exact", gram.alias("gram"), F.col("w.item_words").alias("item_words"), "share", "whole").distinct()


def _row() -> Column:
    """A row number. Filters aren't pushed below it, so the arrays above aren't computed twice."""
    return F.monotonically_increasing_id().alias("_row")


def _bit_filter(windows: DataFrame) -> tuple[Column, int]:
    """The windows' hashes as bits of a literal array of longs."""
    longs = min(FILTER_LONGS, 1 << max(4, math.ceil(math.log2(max(1, windows.count())) - 2)))
    at, bit = F.pmod(F.shiftright("gram", 6), F.lit(longs)), F.expr("shiftleft(1L, cast(gram & 63 as int))")
    filled = dict(windows.groupBy(at.alias("at")).agg(F.bit_or(bit).alias("bits")).collect())  # at most FILTER_LONGS rows
    return F.expr("array(" + ",".join(str(filled.get(i, 0)) + "L" if filled.get(i, 0) != -(1 << 63) else "shiftleft(1L, 63)" for i in range(longs)) + ")"), longs


def find_items(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, literals: int = LITERALS, share: float = SHARE, weak_literals: int = WEAK_LITERALS) -> DataFrame:
    """One row for each document and item found in it: doc_id, text_key, item_id, n_windows, item_windows, slots.

    text_key is xxhash64 of the text: with the id it tells the rows of a repeated id apart. Repeated
    rows are found together, and rows of items that repeat an id are one item. Null and empty texts have no windows, and an item without words is
    never found. An item whose windows are all short of ``literals`` words that aren't placeholders needs all its windows of
    ``weak_literals`` found, or if there are none either, all its words with their values.
    """
    scratch = Scratch(docs.sparkSession, "decontamination")
    own = item_windows(items.select(items[item_col].alias("item_id"), items[item_text_col].alias("_text")), window, literals, share, weak_literals)
    own = scratch.save(own, "windows")
    sizes = own.groupBy("item_id").agg(F.count_distinct("item_at").alias("item_windows"), F.min("share").alias("share"), F.min("whole").alias("whole"))
    bits, longs = _bit_filter(own.select("gram").distinct())
    usual = (window, False)
    kinds = [usual, *sorted(k for k in {(r["k"], r["exact"]) for r in own.select("k", "exact").distinct().collect()} if k != usual)]  # at most two for each length

    d = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_text"))
    d = _with_hashes(template_words(d, F.col("_text")), any(exact for _, exact in kinds))
    for i, (k, exact) in enumerate(kinds):
        d = d.withColumn(f"_grams{i}", F.transform(_places(F.size("_hashes"), k), _gram_at(k, exact, window)))

    def mark(k: int):
        def one(gram: Column, i: Column) -> Column:
            word = F.get(bits, F.pmod(F.shiftright(gram, 6), F.lit(longs)).cast("int"))
            bit = F.call_function("shiftright", word, gram.bitwiseAND(63).cast("int")).bitwiseAND(1)
            return F.when(bit == 1, F.struct(i.alias("at"), gram.alias("gram"), F.lit(k).alias("k")))

        return one

    hit = [F.array_compact(F.transform(f"_grams{i}", mark(k))) for i, (k, _) in enumerate(kinds)]
    likely = d.select("doc_id", F.xxhash64("_text").alias("text_key"), "words", (F.concat(*hit) if len(hit) > 1 else hit[0]).alias("hits"), _row())
    with_words = F.transform("hits", lambda h: F.struct(h["at"].alias("at"), h["gram"].alias("gram"), F.slice(F.col("words"), h["at"] + 1, h["k"]).alias("doc_words")))
    likely = likely.where(F.size("hits") > 0).select("_row", "doc_id", "text_key", F.explode(with_words).alias("h")).select("_row", "doc_id", "text_key", "h.*")
    pairs = likely.join(broadcast_if(own, WINDOWS_BROADCAST), "gram")
    same = F.when(F.col("exact"), F.col("doc_words") == F.col("item_words")).otherwise(F.transform("doc_words", _template) == F.transform("item_words", _template))
    slots = F.filter(F.zip_with("item_words", "doc_words", lambda a, b: F.struct(a.alias("item"), b.alias("doc"))), lambda s: s["item"].startswith("<"))
    aligned = pairs.where(same).groupBy("_row", "doc_id", "text_key", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
    # of one alignment there are at most as many windows as the item has
    aligned = aligned.agg(F.collect_set("item_at").alias("found"), F.array_distinct(F.flatten(F.collect_list(slots))).alias("slots"))
    consistent = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["item"])))
    items_in = aligned.where(consistent).groupBy("_row", "doc_id", "text_key", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("n_all"), F.max(F.size("found")).alias("n_one"), F.max(F.size("slots")).alias("slots")
    )
    items_in = items_in.join(broadcast_if(sizes, WINDOWS_BROADCAST), "item_id").withColumn("n_windows", F.when(F.col("whole"), F.col("n_one")).otherwise(F.col("n_all")))
    return items_in.where(F.col("n_windows") >= F.ceil(F.col("share") * F.col("item_windows"))).select("doc_id", "text_key", "item_id", "n_windows", "item_windows", "slots").distinct()


def remove_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs in which no item is found; their columns may carry any names."""
    found = find_items(docs, items, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key")).distinct()
    found = broadcast_if(Scratch(docs.sparkSession, "contaminated").save(found, "found"), FOUND_BROADCAST)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("row_id"), F.xxhash64(docs[text_col]).alias("row_key"))
    left = rows.join(found, F.col("row_key").eqNullSafe(F.col("found_key")) & F.col("row_id").eqNullSafe(F.col("found_id")), "left_anti")
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


QUERIES = {"op5_decontamination": op5_decontamination}

ORACLES = {
    "op5_decontamination": rf"""
WITH src AS (
  SELECT 'd' AS kind, row_number() OVER () AS r, doc_id AS id, text FROM documents
  UNION ALL SELECT 'i', row_number() OVER (), item_id, text FROM benchmark),
raw AS (SELECT kind, r, id, string_split_regex(text, '[\x20\x09-\x0D]+') AS t FROM src WHERE text IS NOT NULL),
tok AS (SELECT kind, r, id, i, t[i] AS token, CASE WHEN i > 1 THEN t[i - 1] END AS before,
               regexp_replace(t[i], '^[^\pL\pN]+|[^\pL\pN]+$', '', 'g') AS word
        FROM raw, LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i)),
typed AS (SELECT kind, r, id, i,
            CASE WHEN word[1] BETWEEN '0' AND '9' THEN '<num>' || lower(word)
                 WHEN before IS NOT NULL AND regexp_matches(before, '^[^A-Za-z0-9_]*[0-9]') AND lower(word) IN ({", ".join(f"'{u}'" for u in UNITS)}) THEN '<unit>' || lower(word)
                 WHEN word[1] <> lower(word[1]) AND before IS NOT NULL AND before <> '' AND NOT regexp_matches(before, '[.!?:|][^A-Za-z0-9_]*$') THEN '<name>' || word
                 ELSE lower(word) END AS w
          FROM tok WHERE word <> ''),
pos AS (SELECT kind, r, id, w, CASE WHEN starts_with(w, '<') THEN split_part(w, '>', 1) ELSE w END AS t, row_number() OVER (PARTITION BY kind, r ORDER BY i) - 1 AS p FROM typed),
win AS (SELECT kind, r, id, p, list(t) OVER f AS ts, list(w) OVER f AS ws, count(*) OVER (PARTITION BY kind, r) AS n FROM pos WINDOW f AS (PARTITION BY kind, r ORDER BY p ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
iw0 AS (SELECT r, id AS item_id, p, ts, ws, len(ts) AS k, len(list_filter(ws, lambda x: NOT starts_with(x, '<'))) AS plain FROM win WHERE kind = 'i' AND len(ts) = least(n, {WINDOW})),
lev AS (SELECT r, CASE WHEN max(k) = {WINDOW} AND max(plain) >= {LITERALS} THEN 0 WHEN max(plain) >= {WEAK_LITERALS} THEN 1 ELSE 2 END AS level FROM iw0 GROUP BY r),
iw AS (SELECT DISTINCT item_id, p, k, level = 2 AS exact, CASE level WHEN 0 THEN {SHARE} ELSE 1.0 END AS share, level > 0 AS whole, ts, ws FROM iw0 JOIN lev USING (r) WHERE plain >= CASE level WHEN 0 THEN {LITERALS} WHEN 1 THEN {WEAK_LITERALS} ELSE 0 END),
dw AS (SELECT id, r, p, k, exact, ts[1 : k] AS ts, ws[1 : k] AS ws FROM win, (SELECT DISTINCT k, exact FROM iw) kinds WHERE kind = 'd' AND len(ts) >= k),
pair AS (SELECT dw.id AS doc_id, dw.r, item_id, dw.p - iw.p AS shift, iw.p AS ip, list_filter(list_zip(iw.ws, dw.ws), lambda x: starts_with(x[1], '<')) AS slots FROM dw JOIN iw USING (k, exact, ts) WHERE NOT exact OR iw.ws = dw.ws),
al AS (SELECT doc_id, r, item_id, shift, list(DISTINCT ip) AS found, list_distinct(flatten(list(slots))) AS slots FROM pair GROUP BY ALL),
ok AS (SELECT *, len(slots) AS n FROM al WHERE len(slots) = len(list_distinct(list_transform(slots, lambda s: s[1])))),
fin AS (SELECT doc_id, r, item_id, len(list_distinct(flatten(list(found)))) AS n_all, max(len(found)) AS n_one, max(n) AS slots FROM ok GROUP BY ALL),
hit AS (SELECT *, CASE WHEN whole THEN n_one ELSE n_all END AS n_windows FROM fin JOIN (SELECT item_id, count(DISTINCT p) AS item_windows, min(share) AS share, bool_and(whole) AS whole FROM iw GROUP BY item_id) USING (item_id))
SELECT DISTINCT doc_id, item_id, CAST(n_windows AS INTEGER) AS n_windows, item_windows, CAST(slots AS INTEGER) AS slots
FROM hit
WHERE n_windows >= ceil(share * item_windows)
""",
}
