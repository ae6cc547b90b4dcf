"""Token counts of a byte-level BPE by a whole-token shortcut.

A tokenizer of this kind cuts a text into pre-tokens and merges bytes inside each, alone. So a vocabulary string that is one pre-token and merges to
one token is one token wherever it is a pre-token. Which strings these are is proved once before the texts are read: the vocabulary is dealt over
the cluster, and each string is cut and merged by the library itself. Texts then need a look-up for most of their pre-tokens, and the rest are merged, each
distinct one once a worker while its memo lasts.

Pre-tokens have to be the library's own too. Its pattern asks for letters, numbers and white space, which depend on a Unicode version; so the
class of every code point is probed in the library, and the pattern is written with these classes as plain ranges. Added
special strings in a text are one token each, as the library takes them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, small_batches, table, trimmed

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Characters of a text that are cut into pre-tokens at a time, and merged pre-tokens that a worker remembers.
PIECE, MEMO = 1 << 18, 200_000
COUNTED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_whole", pa.int64())])
#: The pattern's fixed part: what a contraction ends with.
ENDINGS = r"'(?:[sdmt]|re|ve|ll)"

_LIBRARIES: dict[str, object] = {}


def file_of(name: str) -> str:
    """A path, or the name of a public vocabulary file or of a file sent by ``addFile``."""
    if "/" in name:
        return name
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        from pyspark import SparkFiles

        return SparkFiles.get(name)


def library(vocabulary: str):
    """The tokenizer of a file, loaded once in a worker."""
    if vocabulary not in _LIBRARIES:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(file_of(vocabulary))
        t.no_truncation()
        t.no_padding()
        _LIBRARIES[vocabulary] = t
    return _LIBRARIES[vocabulary]


def special_strings(vocabulary: str) -> list[str]:
    """The added tokens' strings. The proof holds for a byte-level BPE that cuts texts by the usual pattern and changes nothing else; others are refused."""
    with open(file_of(vocabulary), encoding="utf-8") as f:
        spec = json.load(f)
    cut = spec.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not spec.get("normalizer") and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
    added = spec.get("added_tokens", [])
    if not plain or any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
        raise ValueError(f"{vocabulary} isn't a byte-level BPE that takes texts as they are")
    return [a["content"] for a in added]


def class_of(t, points: list[int]) -> list[str]:
    """L, N, S or O of code points: a letter goes with a letter before it, a number with a number behind it, any other sign with a
    sign before it, and white space with none of them. Many are probed in one string."""

    def begins(before: str) -> set[int]:
        return {span[0] for _, span in t.pre_tokenizer.pre_tokenize_str("".join(f"{before}{chr(p)}1" for p in points))}

    after_letter, after_sign, out = begins("a"), begins("!"), []
    for i, p in enumerate(points):
        if 3 * i + 1 not in after_letter:
            out.append("L")
        elif 3 * i + 1 not in after_sign:
            out.append("O")
        else:  # the blank goes with whatever is behind it
            out.append("S" if p == 0x20 or 3 * i + 2 in after_letter else "N")
    return out


def code_point_classes(spark: SparkSession, vocabulary: str) -> dict[str, list[tuple[int, int]]]:
    """Ranges of the code points of L, N and S; as many as Unicode has (some 800), whatever the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = library(vocabulary)
        for batch in batches:
            points = [p for p in batch.column(0).to_pylist() if not 0xD800 <= p < 0xE000]
            kinds = [k for at in range(0, len(points), 2000) for k in class_of(t, points[at : at + 2000])]
            yield pa.RecordBatch.from_arrays([pa.array(points, pa.int64()), pa.array(kinds, pa.string())], ["point", "kind"])

    points = spark.range(0, 0x110000, 1, 16).mapInArrow(run, "point long, kind string").where("kind <> 'O'")
    # runs of one kind within blocks of 4,096 code points; runs that a block's end parts are two ranges
    run_of = F.row_number().over(_by_point())
    runs = points.withColumn("run", F.col("point") - run_of).groupBy("kind", F.shiftright("point", 12), "run").agg(F.min("point").alias("a"), F.max("point").alias("b"))
    out: dict[str, list[tuple[int, int]]] = {"L": [], "N": [], "S": []}
    for r in sorted(runs.collect(), key=lambda r: r["a"]):
        out[r["kind"]].append((r["a"], r["b"]))
    return out


def _by_point():
    from pyspark.sql import Window

    return Window.partitionBy("kind", F.shiftright("point", 12)).orderBy("point")


def pattern_of(classes: dict[str, list[tuple[int, int]]], last: int = 0x10FFFF) -> re.Pattern:
    """The library's pattern with its classes as ranges, for texts without code points beyond the last."""
    letters, numbers, spaces = ("".join(f"\\U{a:08x}-\\U{min(b, last):08x}" for a, b in classes[k] if a <= last) for k in "LNS")
    return re.compile(f"{ENDINGS}| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


def whole_tokens(spark: SparkSession, vocabulary: str) -> DataFrame:
    """token: the vocabulary strings that the library cuts into one pre-token and merges to one token, proved string by string over the cluster.

    Ids are dealt out, not strings; parts of characters aren't strings and drop out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = library(vocabulary)
        for batch in batches:
            found = []
            for i in batch.column(0).to_pylist():
                text = t.decode([i], skip_special_tokens=False)
                if text and len(t.pre_tokenizer.pre_tokenize_str(text)) == 1 and t.encode(text, add_special_tokens=False).ids == [i]:
                    found.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["token"])

    return spark.range(0, library(vocabulary).get_vocab_size(), 1, 8).mapInArrow(run, "token string")


class Counter:
    """Counts of tokens, and of those among them that the shortcut gave."""

    def __init__(self, t, whole: frozenset[str], special: list[str], classes: dict[str, list[tuple[int, int]]]):
        self.t, self.whole, self.memo = t, whole, {}
        self.special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        # the same pattern with shorter classes, for texts that need no more
        self.ascii, self.plain, self.full = (pattern_of(classes, last).findall for last in (0x7F, 0xFFFF, 0x10FFFF))
        space = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in classes["S"])
        self.cut = re.compile(f"[^{space}](?=[{space}])")
        self.astral = re.compile("[\U00010000-\U0010ffff]").search

    def pretokens(self, text: str) -> list[str]:
        return self.ascii(text) if text.isascii() else self.full(text) if self.astral(text) else self.plain(text)

    def merged(self, piece: str) -> int:
        n = self.memo.get(piece)
        if n is None:
            n = len(self.t.encode(piece, add_special_tokens=False).ids)
            if len(piece) <= 64:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[piece] = n
        return n

    def pieces(self, text: str) -> Iterator[str]:
        """The text in pieces that end before white space: no pre-token begins before that place and ends behind it."""
        at = 0
        while len(text) - at > PIECE:
            found = self.cut.search(text, at + PIECE)
            if not found:
                break
            yield text[at : found.end()]
            at = found.end()
        yield text[at:] if at else text

    def of(self, text: str) -> tuple[int, int]:
        parts = self.special.split(text) if self.special else [text]
        tokens = whole = len(parts) - 1
        for part in parts:
            for piece in self.pieces(part):
                found = self.pretokens(piece)
                rest = [p for p in found if p not in self.whole]
                whole += len(found) - len(rest)
                tokens += len(found) - len(rest) + sum(map(self.merged, rest))
        return tokens, whole


_COUNTERS: dict[str, Counter] = {}


def _count(vocabulary: str, special: list[str], proved):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _COUNTERS:
            whole, classes = proved.value
            _COUNTERS[vocabulary] = Counter(library(vocabulary), frozenset(whole), special, classes)
        of = _COUNTERS[vocabulary].of
        for batch in by_bytes(batches):
            texts = batch.column(1).to_pylist()
            counts = [of(t) if t else (0, 0) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())], schema=COUNTED
            )

    return run


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_whole for every row.

    Null and empty texts have no bytes and no tokens. Ids are whole numbers or what casts to them (else null), and may repeat: each row is counted. Very long texts
    are cut into pieces before white space, which changes no count. n_whole: tokens that needed no merging. The strings proved to be
    whole tokens are sent by broadcast; they are fewer than the vocabulary. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    proved = spark.sparkContext.broadcast(([r["token"] for r in whole_tokens(spark, vocabulary).collect()], code_point_classes(spark, vocabulary)))
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].try_cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(trimmed(_count(vocabulary, special_strings(vocabulary), proved)), "doc_id long, n_bytes long, n_tokens long, n_whole long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_whole")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op12_token_counts": op12_token_counts}
