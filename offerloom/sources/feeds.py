"""Product feeds: delimited or XML files to rows of strings, and to normalised offers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.functions import gtin as G
from offerloom.functions import money as M
from offerloom.functions.text import WS, decode_entities, let, strip_tags, trim

# fixed values: field names of common feeds, in the order in which they are tried
ALIASES = {
    "gtin": ["ean", "gtin", "gtin13", "barcode", "g:gtin", "product_ean", "ean_code"],
    "sku": ["sku", "merchant_product_id", "product_id", "id", "g:id", "artikelnummer"],
    "title": ["name", "title", "product_name", "productname", "g:title", "merchant_product_name"],
    "brand": ["brand", "merk", "g:brand", "manufacturer"],
    "price": ["price", "search_price", "sale_price", "g:price", "prijs", "store_price", "display_price"],
    "currency": ["currency", "g:price_currency", "valuta"],
    "url": ["aw_deep_link", "deeplink", "deep_link", "product_url", "link", "url", "g:link", "merchant_deep_link"],
    "stock": ["in_stock", "stock_status", "availability", "g:availability", "voorraad", "stock_quantity"],
    "size": ["size", "g:size", "maat", "unit", "content_size"],
}
# fixed values: stock words
IN_STOCK = r"(?i)^(1|true|ja|yes|y|in ?stock|op ?voorraad|available|beschikbaar|leverbaar)\z"
OUT_OF_STOCK = r"(?i)^(0|false|nee|no|n|out ?of ?stock|niet ?op ?voorraad|uitverkocht|unavailable|sold ?out)\z"
ITEM_TAGS = ("item", "product", "entry", "offer")
DELIMITERS = (",", ";", "\t", "|")
#: The start of a feed by which its format is told, and its header's line at most.
SNIFFED, HEADER = 512, 1 << 16


def sniff_delimiter(header: str) -> str:
    """The delimiter that splits a header line most; the comma if none does."""
    best = max(DELIMITERS, key=header.count)  # the first of equal ones
    return best if header.count(best) else ","


class FeedFile(NamedTuple):
    path: str
    key: str  # as the file's rows name it
    compressed: bool


def files_of(spark: SparkSession, path: str) -> list[FeedFile]:
    """The files of a path, folder or pattern that hold something, by name, from any storage that Spark reads."""
    hadoop = spark._jvm.org.apache.hadoop
    conf, place = spark._jsc.hadoopConfiguration(), hadoop.fs.Path(path)
    fs, codecs = place.getFileSystem(conf), hadoop.io.compress.CompressionCodecFactory(conf)
    found = [f for s in fs.globStatus(place) or [] for f in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
    kept = sorted((f.getPath().toString(), f) for f in found if f.isFile() and f.getLen() and f.getPath().getName()[0] not in "._")
    return [FeedFile(name, re.sub("^file:/+", "file:/", f.getPath().toUri().toString()), codecs.getCodec(f.getPath()) is not None) for name, f in kept]


def head_of_file(spark: SparkSession, path: str, size: int) -> str:
    """The first bytes of a file as text. Only these are read."""
    hadoop = spark._jvm.org.apache.hadoop
    conf, place = spark._jsc.hadoopConfiguration(), hadoop.fs.Path(path)
    stream = place.getFileSystem(conf).open(place)
    codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
    try:
        stream = stream if codec is None else codec.createInputStream(stream)
        return bytes(stream.readNBytes(size)).decode("utf-8", "ignore").lstrip("\ufeff")
    finally:
        stream.close()


def head_of(spark: SparkSession, path: str, size: int = SNIFFED) -> str:
    """The same of the first file that isn't empty of a folder or pattern."""
    files = files_of(spark, path)
    return head_of_file(spark, files[0].path, size) if files else ""


def sniff_format(head: str) -> str:
    """By the first 512 characters, over line ends."""
    return "xml" if re.search(r"^\s*<\?xml|<rss|<products|<item\b", head[:SNIFFED].lstrip("\ufeff"), re.I) else "csv"


# --- delimited files ---


def field_pattern(delimiter: str) -> str:
    """A field and the delimiter behind it. Quotes may stand anywhere in a field, as pairs."""
    d = re.escape(delimiter)
    return f'((?:"[^"]*+(?:""[^"]*+)*+"|[^"{d}]++)*+){d}'


def fields_of(record: Column, delimiter: Column, pattern: Column) -> Column:
    """A record's fields, without the quotes around parts of them; two quotes inside quotes are one."""
    raw = F.regexp_extract_all(F.concat(record, delimiter), pattern, F.lit(1))
    inner = lambda f: F.replace(F.regexp_replace(f, '"([^"]*+(?:""[^"]*+)*+)"', "$1"), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda f: F.when(F.contains(f, F.lit('"')), inner(f)).otherwise(f))


def split_record(text: str, delimiter: str) -> list[str]:
    """The same for a header on the driver."""
    found = re.findall(f'((?:"[^"]*(?:""[^"]*)*"|[^"{re.escape(delimiter)}]+)*){re.escape(delimiter)}', text + delimiter)
    return [re.sub('"([^"]*(?:""[^"]*)*)"', r"\1", f).replace('""', '"') for f in found]


def first_record(head: str, delimiter: str | None) -> tuple[str, str]:
    """(a head's first record that isn't empty, its delimiter)."""
    pending = ""
    for line in re.split(r"\r\n|\n|\r", head):
        pending = f"{pending}\n{line}" if pending else line
        if pending.count('"') % 2 == 0:
            sep = delimiter or sniff_delimiter(pending)
            if any(split_record(pending, sep)):
                return pending, sep
            pending = ""
    return "", delimiter or ","


def header_of(spark: SparkSession, file: FeedFile, delimiter: str | None) -> tuple[list[str], str]:
    """(names of a file's columns: trimmed, lower-case; its delimiter)."""
    record, sep = first_record(head_of_file(spark, file.path, HEADER), delimiter)
    return [h.strip().lstrip("\ufeff").strip().lower() for h in split_record(record, sep)] if record else [], sep


RECORDS = "file_no int, start long, kind int, text string"
RECORDS_ARROW = pa.schema([("file_no", pa.int32()), ("start", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])
#: A whole record; the end of one that began in an earlier split; one that the split's end cuts; a split inside one record.
WHOLE, HEAD, TAIL, INSIDE = range(4)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (value, file_no, start, odd) in the order of the files to records: lines go together while quotes are open.

    A split starts inside quotes if ``odd``. A file's first record that isn't empty is its header and is left out.
    """
    split, inside, begun, pending, header = None, False, True, [], False

    def flush(out: list) -> None:
        if split is not None and pending:
            out.append((*split, TAIL if begun else INSIDE, "\n".join(pending)))

    for batch in batches:
        lines = batch.column(0)
        files, starts, odds = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
        quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((np.diff(files) != 0) | (np.diff(starts) != 0)) + 1).tolist(), len(lines)]
        out: list[tuple] = []
        for a, b in pairwise(cuts):
            if a == b:
                continue
            key = (int(files[a]), int(starts[a]))
            if key != split:
                flush(out)
                split, inside, pending, header = key, bool(odds[a]), [], key[1] == 0
                begun = not inside
            after = (int(inside) + np.cumsum(quotes[a:b])) % 2
            before = np.concatenate([[int(inside)], after[:-1]])
            alone = (before == 0) & (after == 0)
            if header or not alone.all():
                for i in range(a, b):  # lines one by one, in splits where quotes span lines and up to the header
                    pending.append(lines[i].as_py())
                    if after[i - a]:
                        continue
                    text = "\n".join(pending)
                    if header and text.strip(",;|\t\" "):
                        header = False
                    else:
                        out.append((*split, WHOLE if begun else HEAD, text))
                    pending, begun = [], True
            else:
                yield pa.RecordBatch.from_arrays([pa.array(files[a:b], pa.int32()), pa.array(starts[a:b], pa.int64()), pa.array(np.zeros(b - a, np.int32)), lines.slice(a, b - a)], schema=RECORDS_ARROW)
            inside = bool(after[-1])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), RECORDS_ARROW.types, strict=True)], schema=RECORDS_ARROW)
    last: list[tuple] = []
    flush(last)
    if last:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*last, strict=True), RECORDS_ARROW.types, strict=True)], schema=RECORDS_ARROW)


#: Splits of all files whose quote parity may be broadcast; at 128 MB a split this is far over 100 TB.
SPLITS_BROADCAST = 2_000_000


def _numbered(spark: SparkSession, files: list[FeedFile], separator: str, by_key: DataFrame) -> DataFrame:
    """value, file_no, start of all files' texts in one scan; files that break off give what they have."""
    key = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    lines = spark.read.option("lineSep", separator).option("ignoreCorruptFiles", True).text([f.path for f in files])
    # as many rows as there are files in the configuration
    return lines.select("value", key.alias("key"), F.col("_metadata.file_block_start").alias("start")).join(F.broadcast(by_key), "key").drop("key")


def broken_files(spark: SparkSession, files: list[FeedFile], read_bytes: dict[int, int]) -> dict[int, str]:
    """file_no -> error of compressed files that can't be read to their end.

    A gzip file ends with its length. Where that isn't what the scan has read, the file is read once more, alone, and an error then tells.
    """
    out = {}
    for n, f in enumerate(files):
        if not f.compressed or _gzip_length(spark, f.path) in {read_bytes.get(n, 0) % 2**32, (read_bytes.get(n, 0) - 1) % 2**32}:
            continue
        try:
            spark.read.option("ignoreCorruptFiles", False).text(f.path).select(F.length("value")).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001  whatever a broken file raises
            out[n] = reason(e)
    return out


def _gzip_length(spark: SparkSession, path: str) -> int:
    """The length modulo 2**32 that a gzip file's last four bytes name; -1 for other kinds."""
    if not path.endswith(".gz"):
        return -1
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getFileStatus(place).getLen()
    stream = fs.open(place)
    try:
        stream.seek(max(0, size - 4))
        return int.from_bytes(bytes(stream.readNBytes(4)), "little")
    finally:
        stream.close()


def reason(e: Exception) -> str:
    """The innermost cause's first line."""
    lines = [x.strip() for x in str(e).splitlines() if x.strip()]
    causes = [x for x in lines if x.startswith("Caused by:")] or [x for x in lines if "Exception" in x]
    return (causes[-1].removeprefix("Caused by: ") if causes else lines[0] if lines else type(e).__name__)[:300]


def records(spark: SparkSession, files: list[FeedFile]) -> tuple[DataFrame, dict[int, str]]:
    """(file_no, text: every record of the files but their headers; errors by file_no of files that break off or end inside quotes).

    One scan counts the quotes of each split; their sums up to a split tell whether it starts inside quotes, so that every
    split is cut into records by its own task. Records that lie over the ends of splits are put together from their parts.
    A file with an error gives no records. Where Spark cuts files depends on the bytes of all files of a scan, so every scan
    names them all, and a split that the first one didn't have is an error.
    """
    by_key = spark.createDataFrame([(f.key, n) for n, f in enumerate(files)], "key string, file_no int")
    lines = _numbered(spark, files, "\n", by_key)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = lines.groupBy("file_no", "start").agg(F.sum(quotes).alias("quotes"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    before = W.partitionBy("file_no").orderBy("start")
    counts = counts.withColumn("upto", F.sum("quotes").over(before)).select("file_no", "start", "bytes", "upto", ((F.col("upto") - F.col("quotes")) % 2 == 1).alias("odd")).persist()
    per_file = counts.groupBy("file_no").agg(F.sum("bytes").alias("bytes"), (F.max_by("upto", "start") % 2).alias("open"), F.max("odd").alias("spans"), F.count(F.lit(1)).alias("splits")).collect()
    if sum(r["splits"] for r in per_file) > SPLITS_BROADCAST:
        raise ValueError("too many splits: raise spark.sql.files.maxPartitionBytes")
    errors = broken_files(spark, files, {r["file_no"]: r["bytes"] for r in per_file})
    errors |= {r["file_no"]: "quotes are open at the end" for r in per_file if r["open"] and r["file_no"] not in errors}
    splits = spark.createDataFrame(counts.select("file_no", "start", "odd").collect(), "file_no int, start long, odd boolean")
    counts.unpersist()
    good = [n for n in range(len(files)) if n not in errors]
    if not good:
        return spark.createDataFrame([], "file_no int, text string"), errors
    unknown = F.raise_error(F.lit("a feed was cut into other splits than when its quotes were counted")).cast("boolean")

    def parts(of: list[int]) -> DataFrame:
        some = spark.createDataFrame([(files[n].key, n) for n in of], "key string, file_no int")
        marked = _numbered(spark, files, "\n", some).join(F.broadcast(splits), ["file_no", "start"], "left")
        # a carriage return ends a line too; the parts keep their order
        line = F.explode(F.split(F.regexp_replace("value", r"\r\z", ""), "\r"))
        return marked.select(line.alias("value"), "file_no", "start", F.coalesce("odd", unknown).alias("odd")).mapInArrow(_records, RECORDS)

    whole = parts(good).where(F.col("kind") == WHOLE).select("file_no", "text")
    spanning = [r["file_no"] for r in per_file if r["spans"] and r["file_no"] not in errors]
    if not spanning:
        return whole, errors
    cut = parts(spanning).where(F.col("kind") != WHOLE)
    # at most two parts a split
    number = F.sum((F.col("kind") == TAIL).cast("int")).over(W.partitionBy("file_no").orderBy("start", "kind"))
    joined = cut.withColumn("number", number).groupBy("file_no", "number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "kind", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return whole.unionByName(joined.select("file_no", "text")), errors


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """All columns as strings under trimmed lower-case names; missing values empty, empty records dropped.

    Of columns with equal names the last counts; columns without a name are left out. Files of a folder have a header each. Line breaks in quotes
    don't keep a file from being read by many tasks: see ``records``. A file that can't be read to its end is an error.
    """
    files = files_of(spark, path)
    if not files:
        raise ValueError(f"nothing to read in {path}")
    heads = [header_of(spark, f, delimiter) for f in files]
    rows, errors = records(spark, files)
    if errors:
        raise ValueError(next(iter(errors.values())))
    names = list(dict.fromkeys(n for h, _ in heads for n in h if n))
    places = spark.createDataFrame([(i, sep, field_pattern(sep), [len(h) - h[::-1].index(n) if n in h else 0 for n in names]) for i, (h, sep) in enumerate(heads)], "file_no int, sep string, pattern string, places array<int>")
    split = rows.join(F.broadcast(places), "file_no").select("places", fields_of(F.col("text"), F.col("sep"), F.col("pattern")).alias("fields"))
    split = split.where(F.exists("fields", lambda f: f != ""))
    same = len({tuple(h) for h, _ in heads}) == 1  # then the places are constants
    place = lambda i, n: F.lit(len(heads[0][0]) - heads[0][0][::-1].index(n)) if same else F.nullif(F.element_at("places", i + 1), F.lit(0))
    return split.select(*[F.coalesce(F.try_element_at("fields", place(i, n)), F.lit("")).alias(n) for i, n in enumerate(names)])


# --- XML files ---


def tag_in(text: str) -> str | None:
    """The first of the item tags that a text has, as it is spelled there."""
    found = (re.search(f"<({t})\\b", text, re.I) for t in ITEM_TAGS)
    return next((m[1] for m in found if m), None)


def item_tag(spark: SparkSession, file: FeedFile) -> str | None:
    """The item tag of a file: of its first part of 64 KB that has any. A file whose head has none is searched as a whole, cut behind tags, as it may be one line."""
    tag = tag_in(head_of_file(spark, file.path, HEADER))
    if tag:
        return tag
    lines = spark.read.option("lineSep", ">").text(file.path)
    found = lines.select(*[F.max(F.regexp_extract("value", f"(?i)<({t})\\b", 1)).alias(t) for t in ITEM_TAGS]).first()
    return next((found[t] for t in ITEM_TAGS if found[t]), None)


def items_of(chunks: DataFrame, tag: str, *keep: str) -> DataFrame:
    """The items' inner texts of texts that were cut at one spelling of the closing tag: items in other spellings lie inside."""
    whole = F.regexp_extract_all(F.concat("value", F.lit(f"</{tag}>")), F.lit(f"(?i)<{tag}\\b[^>]*>([\\s\\S]*?)</{tag}>"), F.lit(1))
    return chunks.select(*keep, F.explode(whole).alias("body"))


def item_fields(body: Column) -> Column:
    """A map of lower-case names without prefix to text. Fields that hold elements are left out; of repeated fields the first with a text counts."""
    element = r"(?i)<([a-z0-9_:.-]+)([^>]*)>([\s\S]*?)</\1>"
    # a name and a text may not hold a NUL, so one can stand between them
    pairs = F.transform(F.regexp_extract_all(body, F.lit(element), F.lit(0)), lambda e: F.regexp_replace(e, "^" + element + "\\z", "$1\u0000$3"))

    def clean(pair: Column) -> Column:
        name = F.regexp_replace(F.lower(F.substring_index(pair, "\u0000", 1)), "^[a-z0-9_-]+:", "")
        value = F.regexp_replace(F.regexp_replace(F.substring_index(pair, "\u0000", -1), rf"^{WS}*<!\[CDATA\[", ""), rf"\]\]>{WS}*\z", "")
        return F.struct(name.alias("k"), trim(decode_entities(value)).alias("v"))

    plain = F.filter(pairs, lambda p: ~F.substring_index(p, "\u0000", -1).rlike("(?i)<[a-z]"))

    def first_of_each(entries: Column) -> Column:
        names = F.array_distinct(F.transform(entries, lambda e: e["k"]))
        return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["k"] == n), 1)["v"]))

    return let(F.filter(F.transform(plain, clean), lambda e: e["v"] != ""), first_of_each)


def read_xml(spark: SparkSession, path: str, tag: str | None = None) -> DataFrame:
    """One row for each item: ``fields``, see ``item_fields``.

    The file is split at the items' closing tags, so one large file is read by many tasks, and an item that isn't well-formed costs
    only itself. Tags may be spelled in any case, mixed in one file. A file without an item is an error.
    """
    files = files_of(spark, path)
    tag = tag or (item_tag(spark, files[0]) if files else None)
    if not tag:
        raise ValueError(f"no item tag in {path}")
    chunks = spark.read.option("lineSep", f"</{tag}>").text(path)
    return items_of(chunks, tag).select(item_fields(F.col("body")).alias("fields"))


def xml_to_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*[F.coalesce(F.try_element_at("fields", F.lit(n)), F.lit("")).alias(n) for n in names])


# --- normalised rows ---


def names_tried(names: list[str]) -> list[str]:
    """A list of names as they may stand in a feed: as given, in lower case, without ``g:``."""
    return list(dict.fromkeys(k for n in names for k in (n, n.lower(), re.sub("^g:", "", n))))


def pick(columns: list[str], names: list[str]) -> Column:
    """The first value that isn't blank, trimmed, of the columns that a list of names stands for."""
    tries = [k for k in names_tried(names) if k in columns]
    options = [F.nullif(trim(F.col(f"`{c}`")), F.lit("")) for c in tries]
    return F.coalesce(*options, F.lit(None).cast("string"))


def stock_flag(text: Column) -> Column:
    return F.when(text.rlike(IN_STOCK), True).when(text.rlike(OUT_OF_STOCK), False)


def normalize_rows(rows: DataFrame, mapping: dict[str, list[str]] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Feed rows of any shape to the normalised columns; a mapping replaces a field's list of names whole."""
    names = ALIASES | (mapping or {})
    raw = {f: pick(rows.columns, n) for f, n in names.items()}
    return normalized(rows.select(*[F.col(f"`{c}`").alias(c) for c in keep or []], *[raw[f].alias(f"_{f}") for f in names]), keep or [])


def normalized(r: DataFrame, keep: list[str]) -> DataFrame:
    """The normalised columns from the picked texts ``_gtin``, ``_title``, ..."""
    r = r.withColumn("_title", decode_entities(strip_tags(F.coalesce("_title", F.lit("")))))
    r = r.withColumn("_pack", F.coalesce(M.parse_pack_size("_size"), M.parse_pack_size("_title")))
    return r.select(
        *[F.col(f"`{c}`").alias(c) for c in keep],
        G.normalize_gtin("_gtin").alias("gtin"),
        F.col("_sku").alias("sku"),
        F.when(F.col("_title") != "", F.col("_title")).alias("title"),
        F.col("_brand").alias("brand"),
        M.parse_price("_price").alias("price"),
        F.substring(F.upper(F.coalesce("_currency", F.lit("EUR"))), 1, 3).alias("currency"),
        F.col("_url").alias("url"),
        stock_flag(F.col("_stock")).alias("in_stock"),
        F.col("_pack.amount").alias("amount"),
        F.col("_pack.unit").alias("unit"),
    )


def usable(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("price").isNotNull() & F.col("url").isNotNull())


def read_feed(spark: SparkSession, path: str, fmt: str = "auto", delimiter: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """A feed file of either format as rows of strings; of XML the known fields and those to keep."""
    fmt = sniff_format(head_of(spark, path)) if fmt in (None, "auto") else fmt
    if fmt == "xml":
        return xml_to_columns(read_xml(spark, path), sorted({re.sub("^g:", "", n) for v in ALIASES.values() for n in v} | set(keep or [])))
    return read_delimited(spark, path, delimiter)


def _first_filled(values: Column) -> Column:
    return F.try_element_at(F.filter(F.transform(values, trim), lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(1))


def read_feeds(spark: SparkSession, feeds: list[dict], known_shops: list[str]) -> tuple[DataFrame | None, list[dict]]:
    """All enabled feeds that have a location as one table of normalised rows with shop and feed, and the problems.

    feeds: dicts of id, shop, path, enabled, format, delimiter, mapping, keep (columns to carry along). A feed that can't be opened, breaks off, ends inside quotes, has no item or
    names an unknown shop is a problem without rows; the others go on. The list of feeds is configuration, so it and the heads of their files are the driver's; all
    delimited files are one scan, and XML files one for each spelling of the item tag, whatever the number of feeds: where a feed's fields stand is a row of a table.
    """
    problems: list[dict] = []
    csv: list[tuple[dict, FeedFile, list[str], str]] = []
    xml: dict[str, list[tuple[dict, FeedFile]]] = {}
    active = [f for f in feeds if f.get("enabled", True) and f.get("path")]
    problem = lambda f, error: problems.append({"feed": f["id"], "shop": f["shop"], "error": error})

    def opened(f: dict) -> tuple[str, list]:
        """(format, what is known of each file)."""
        files = files_of(spark, f["path"])
        if not files:
            raise ValueError(f"nothing to read in {f['path']}")
        fmt = f.get("format") or "auto"
        fmt = sniff_format(head_of_file(spark, files[0].path, SNIFFED)) if fmt == "auto" else fmt
        if fmt == "xml":
            tag = item_tag(spark, files[0])
            if not tag:
                raise ValueError(f"no item tag in {f['path']}")
            return tag, files
        return "", [(x, *header_of(spark, x, f.get("delimiter"))) for x in files]

    for f in active:
        if f["shop"] not in known_shops:
            problem(f, "unknown shop")
            continue
        try:
            tag, found = opened(f)
        except Exception as e:  # noqa: BLE001  whatever a broken file raises must not stop the other feeds
            problem(f, reason(e))
            continue
        if tag:
            xml.setdefault(tag, []).extend((f, x) for x in found)
        else:
            csv.extend((f, *x) for x in found)

    keep = list(dict.fromkeys(k for f in active for k in f.get("keep") or []))
    names = lambda f: [names_tried(n) for n in (ALIASES | (f.get("mapping") or {})).values()] + [[k] if k in (f.get("keep") or []) else [] for k in keep]
    columns = [f"_{f}" for f in ALIASES] + keep
    parts = []

    def without_broken(of: list[dict], errors: dict[int, str]) -> list[str]:
        """Names the feeds with a broken file, and tells of each."""
        for n, error in errors.items():
            problem(of[n], error)
        return sorted({of[n]["id"] for n in errors})

    if csv:
        rows, errors = records(spark, [x[1] for x in csv])
        bad = without_broken([x[0] for x in csv], errors)
        places = lambda f, h: [[len(h) - h[::-1].index(n) for n in tried if n in h] for tried in names(f)]
        table = [(i, f["shop"], f["id"], sep, field_pattern(sep), places(f, h)) for i, (f, _, h, sep) in enumerate(csv) if f["id"] not in bad]
        table = spark.createDataFrame(table, "file_no int, shop string, feed string, sep string, pattern string, places array<array<int>>")
        r = rows.join(F.broadcast(table), "file_no").select("shop", "feed", "places", fields_of(F.col("text"), F.col("sep"), F.col("pattern")).alias("fields")).where(F.exists("fields", lambda x: x != ""))
        parts.append(r.select("shop", "feed", *[_first_filled(F.transform(F.element_at("places", i + 1), lambda p: F.try_element_at("fields", p))).alias(c) for i, c in enumerate(columns)]))
    for tag, found in xml.items():
        files = [x for _, x in found]
        by_key = spark.createDataFrame([(x.key, i) for i, x in enumerate(files)], "key string, file_no int")
        chunks = _numbered(spark, files, f"</{tag}>", by_key)
        packed = [i for i, x in enumerate(files) if x.compressed]
        read = chunks.where(F.col("file_no").isin(packed)).groupBy("file_no").agg(F.sum(F.octet_length("value") + len(tag) + 3).alias("n"), F.max(F.lit(len(tag) + 3)).alias("over")).collect() if packed else []
        bad = without_broken([f for f, _ in found], broken_files(spark, files, {r["file_no"]: r["n"] - r["over"] for r in read}))
        table = [(i, f["shop"], f["id"], names(f)) for i, (f, _) in enumerate(found) if f["id"] not in bad]
        table = spark.createDataFrame(table, "file_no int, shop string, feed string, tried array<array<string>>")
        r = items_of(chunks, tag, "file_no").join(F.broadcast(table), "file_no").select("shop", "feed", "tried", item_fields(F.col("body")).alias("fields"))
        parts.append(r.select("shop", "feed", *[_first_filled(F.transform(F.element_at("tried", i + 1), lambda n: F.try_element_at("fields", n))).alias(c) for i, c in enumerate(columns)]))
    out = None
    for p in parts:
        p = p.withColumns({k: F.coalesce(F.col(f"`{k}`"), F.lit("")) for k in keep}) if keep else p
        out = p if out is None else out.unionByName(p)
    return normalized(out, ["shop", "feed", *keep]) if out is not None else None, problems
