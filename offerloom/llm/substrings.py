"""Substring dedup: repeated word windows found with a compressed FM-index for each shard.

1. Each document selects anchors: of every ``min_words`` consecutive words, the 20-word gram with the smallest
   hash. Equal windows select the same anchor at the same place, so both end up in the anchor's shard.
2. A window whose anchor no other document has can't be repeated; joining the shared anchors back leaves few
   candidate windows. The candidate windows of one anchor in one document form a segment. Equal
   segments of several documents are merged first and keep their smallest document, so large groups
   of copies shrink to one segment before anything is gathered.
3. Of each of a shard's anchors the segment of the smallest document is indexed: a run-length FM-index, which is a wavelet matrix over the heads of the
   Burrows-Wheeler transform's runs, a bit vector of where runs start, and summed run lengths. Neither texts nor suffixes are kept. The
   other segments are then streamed against it: backward search extends every match by a word to the left, and shortens it from the right as far as
   needed where that word doesn't fit, which gives matching statistics. Where they reach ``min_words``, the window
   is reported with the smallest document of its block of rows. Segments with windows that no index has yet go on, GROWTH times as many an index.
4. An anchor with more than SHARD_SEGMENTS distinct segments (a passage that very many documents quote between texts of their own) would
   make a shard too large. Of its windows those that two documents have are found by an aggregation over their 128-bit hashes, which merges map-side; each
   of them becomes a segment of its own, dealt by its hash, and goes through the index like the others.

Reports are joined back to the documents that have the segment, and a word goes if a window over it also
starts in a document with a smaller id.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_GROUP, SPACES, Scratch, broadcast_if, by_bytes, gram_hashes, parallelism, sliced, table, trimmed, words_of

GRAM, MIN_WORDS = 20, 50
SHARD_SEGMENTS = 3000
#: An index after the first takes so many times as many segments of an anchor as the one before it.
GROWTH = 8
#: Repeated windows of hot anchors are broadcast up to so many rows of 30 bytes.
WINDOWS_BROADCAST = 1_000_000
PLACE_BITS = 30

ANCHORS = "doc_id long, anchor long"
CUT = "kind string, doc_id long, text_key string, n_words long, kept_sha256 string, text binary, segments array<struct<anchor:long,id:binary,at:int,windows:int>>"
SEGMENT = pa.struct([("anchor", pa.int64()), ("id", pa.binary()), ("at", pa.int32()), ("windows", pa.int32())])
CUT_ARROW = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("text_key", pa.string()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.binary()), ("segments", pa.list_(SEGMENT))])
PIECES = "anchor long, id binary, doc_id long, last_doc long, words binary"
PIECES_ARROW = pa.schema([("anchor", pa.int64()), ("id", pa.binary()), ("doc_id", pa.int64()), ("last_doc", pa.int64()), ("words", pa.binary())])
REPORTS = "anchor long, id binary, runs array<struct<start:int,end:int,doc_id:long>>"
RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("doc_id", pa.int64())]))
REPORTS_ARROW = pa.schema([("anchor", pa.int64()), ("id", pa.binary()), ("runs", RUNS)])
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", SPANS)])


# --- anchors and segments ---


def window_anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """For each run of span grams the place of the smallest one, the last of equal ones."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    x = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    size = 1
    while 2 * size <= span:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    x = np.minimum(x[:n], x[span - size : span - size + n])
    return (low - (x & low)).astype(np.int64)


def _anchors(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            ids, out = [], []
            w = words_of(batch.column(1))
            grams = gram_hashes(w.hashes, GRAM)
            for doc_id, first, end in zip(batch.column(0).to_pylist(), w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                if end - first >= min_words:
                    g = grams[first : end - GRAM + 1]
                    a = np.unique(g[np.unique(window_anchors(g, min_words - GRAM + 1))])
                    out.append(a.view(np.int64))
                    ids.append(np.full(len(a), doc_id, np.int64))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(out))], ["doc_id", "anchor"])

    return run


def _joined(w, first: int, end: int) -> bytes:
    """Words first..end of a chunk of texts with one space between them."""
    if first >= end:
        return b""
    at = int(w.starts[first])
    data = w.data[at : w.ends[end - 1]]
    gaps = SPACES[data]
    if np.count_nonzero(gaps) == end - first - 1:
        return np.where(gaps, np.uint8(0x20), data).tobytes()
    return b" ".join(data.tobytes().split())


def _cut(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2):
            rows = []
            w = words_of(batch.column(2))
            grams = gram_hashes(w.hashes, GRAM)
            ends = zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)
            for (first, end), doc_id, key, text, marks in zip(ends, *[c.to_pylist() for c in batch.columns], strict=True):
                segments = []
                if marks:
                    g = grams[first : end - GRAM + 1]
                    place = window_anchors(g, min_words - GRAM + 1)
                    open_ = np.flatnonzero(np.isin(g[place].view(np.int64), np.array(marks, np.int64)))
                    if len(open_):
                        breaks = np.flatnonzero((np.diff(open_) != 1) | (np.diff(place[open_]) != 0)) + 1
                        for run_ in np.split(open_, breaks):
                            s, e = int(run_[0]), int(run_[-1])
                            piece = _joined(w, first + s, first + e + min_words)
                            segments.append({"anchor": int(g[place[s]].view(np.int64)), "id": hashlib.blake2b(piece, digest_size=16).digest(), "at": s, "windows": e - s + 1})
                if segments:
                    rows.append(("open", doc_id, key, end - first, None, text, segments))
                else:
                    rows.append(("done", doc_id, key, end - first, hashlib.sha256(_joined(w, first, end)).hexdigest(), None, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), CUT_ARROW.types, strict=True)], schema=CUT_ARROW)

    return run


def _pieces(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[tuple[int, bytes], tuple[int, int]] = {}  # smallest and largest document
            rows = list(zip(*[c.to_pylist() for c in batch.columns], strict=True))
            for doc_id, _, segments in rows:
                for s in segments:
                    key = (s["anchor"], s["id"])
                    a, b = best.get(key, (doc_id, doc_id))
                    best[key] = (min(doc_id, a), max(doc_id, b))
            out = []
            for i, (_, text, segments) in enumerate(rows):
                words = text.split()
                for s in segments:
                    ends = best.pop((s["anchor"], s["id"]), None)
                    if ends is not None:
                        out.append((s["anchor"], s["id"], *ends, b" ".join(words[s["at"] : s["at"] + s["windows"] + min_words - 1])))
                if out and (len(out) >= 10_000 or i + 1 == len(rows)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), PIECES_ARROW.types, strict=True)], schema=PIECES_ARROW)
                    out = []

    return run


# --- the index ---


class Bits:
    """A bit vector with rank: eight bytes of bits and four of a count for each 64 places."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(8 - len(packed) % 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))


class WaveletMatrix:
    """Rank over a sequence of symbols: a bit vector for each bit of the symbols, the highest first."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        x = symbols.astype(np.uint32)
        for level in range(self.bits - 1, -1, -1):
            bit = ((x >> np.uint32(level)) & np.uint32(1)).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(x) - np.count_nonzero(bit)))
            x = np.concatenate([x[~bit], x[bit]])
        # where each symbol's occurrences start in the last level
        self.start = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.levels[k].rank(at)
            at = np.where((symbols >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self._descend(symbols, at) - self.start[symbols]


class FMIndex:
    """Of texts (arrays of word ids from 1 on; a 0 ends each) with a number each, for matches of up to ``depth`` words.

    Kept are the Burrows-Wheeler transform in runs (a wavelet matrix of their heads, a bit vector of their starts, two numbers a run), the common
    prefix of neighbouring rows up to depth (a byte a row), and for each block of rows that agree in depth words the smallest number of their texts.
    """

    def __init__(self, texts: list[np.ndarray], sigma: int, depth: int, numbers: np.ndarray | None = None):
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        n = int(lengths.sum())
        t = np.zeros(n, np.int64)
        starts = np.cumsum(lengths) - lengths
        for s, x in zip(starts.tolist(), texts, strict=True):
            t[s : s + len(x)] = x
        numbers = np.zeros(len(texts), np.int64) if numbers is None else numbers
        rank, size, ranks = t.astype(np.int32), 1, []
        order = np.argsort(t, kind="stable")
        while size < depth:
            ranks.append((size, rank))
            key = rank.astype(np.int64) << 32
            key[: max(0, n - size)] += rank[size:] + 1
            order = np.argsort(key)
            key = key[order]
            rank = np.empty(n, np.int32)
            rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])[:n]
            size *= 2
        ranks.append((size, rank))
        common = np.zeros(n + 1, np.int64)  # of each row with the one before it; none at both ends
        a, b = order[:-1].copy(), order[1:].copy()
        for step, r in reversed(ranks):
            inside = (a < n) & (b < n)
            same = inside & (r[np.minimum(a, n - 1)] == r[np.minimum(b, n - 1)])
            common[1:n] += np.where(same, step, 0)
            a, b = a + step * same, b + step * same
        self.rows, self.depth = n, depth
        self.common = np.minimum(common, depth).astype(np.uint8)
        self.blocks = Bits(self.common[:n] < depth)
        self.least = np.minimum.reduceat(numbers[np.searchsorted(starts, order, "right") - 1], np.flatnonzero(self.common[:n] < depth)) if n else numbers
        bwt = t[order - 1]
        head = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1])) if n else np.empty(0, np.int64)
        self.starts = Bits(np.isin(np.arange(n), head))
        self.heads = WaveletMatrix(bwt[head], sigma)
        by_symbol = np.argsort(bwt[head], kind="stable")
        ends = np.append(head[1:], n)
        self.run_end = ends[by_symbol].astype(np.int32)
        self.summed = np.concatenate([[0], np.cumsum((ends - head)[by_symbol])]).astype(np.int32)
        self.first_run = np.searchsorted(bwt[head][by_symbol], np.arange(sigma + 1)).astype(np.int32)
        self._edges: dict[int, np.ndarray] = {}

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: rows that start with the symbol and then what the rows lo..hi start with."""
        c, at = np.concatenate([symbols, symbols]), np.concatenate([lo, hi])
        first = self.first_run[c]
        run = first + self.heads.rank(c, self.starts.rank(at))  # runs of the symbol that start before the place
        over = np.where(run > first, np.maximum(self.run_end[run - 1] - at, 0), 0)
        rows = self.summed[run] - over
        return rows[: len(lo)], rows[len(lo) :]

    def widen(self, lo: np.ndarray, hi: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows that agree with the rows lo..hi in so many words."""
        if not words:
            return np.zeros_like(lo), np.full_like(hi, self.rows)
        if words not in self._edges:
            self._edges[words] = np.flatnonzero(self.common < words).astype(np.int32)
        edges = self._edges[words]
        return edges[np.searchsorted(edges, lo, "right") - 1], edges[np.searchsorted(edges, hi, "left")]

    def matching_statistics(self, texts: list[np.ndarray], full_only: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each place of each text (a -1 is a word that the index lacks): the length of the longest match that starts there, up to
        depth, and where it is depth the smallest number of the texts that have it, else -1. All texts go right to left side by side.
        full_only: other lengths aren't wanted, so a text is left as soon as no match of full length fits in what remains of it; its other places have 0."""
        lengths = np.array([len(t) for t in texts], np.int64)
        lanes = np.argsort(-lengths, kind="stable")
        n = lengths[lanes]
        ends = np.cumsum(lengths)
        flat = np.concatenate(texts) if texts else np.empty(0, np.int64)
        last = ends[lanes] - 1
        lo, hi, size = np.zeros(len(lanes), np.int64), np.full(len(lanes), self.rows, np.int64), np.zeros(len(lanes), np.int64)
        found, match = np.full(len(flat), -1, np.int64), np.zeros(len(flat), np.int64)
        symbols, live = np.zeros(len(lanes), np.int64), np.arange(len(lanes))
        for step in range(int(n[0]) if len(n) else 0):
            live = live[: int(np.searchsorted(-n[live], -step, "left"))]  # lanes longer than step
            if full_only:  # where the match at hand ends, no later one ends farther right
                live = live[n[live] - step + size[live] >= self.depth]
            if not len(live):
                break
            places = last[live] - step
            symbols[live] = flat[places]
            full = live[size[live] == self.depth]  # a match of full length gives up its last word
            if len(full):
                lo[full], hi[full] = self.widen(lo[full], hi[full], self.depth - 1)
                size[full] = self.depth - 1
            todo = live
            missing = symbols[todo] < 0
            if missing.any():
                gone = todo[missing]
                lo[gone], hi[gone], size[gone] = 0, self.rows, 0
                todo = todo[~missing]
            while len(todo):
                a, b = self.extend(symbols[todo], lo[todo], hi[todo])
                fits = a < b
                good = todo[fits]
                lo[good], hi[good] = a[fits], b[fits]
                size[good] += 1
                todo = todo[~fits]
                todo = todo[size[todo] > 0]  # a word alone that doesn't fit starts anew with the next one
                if len(todo):
                    shorter = np.maximum(self.common[lo[todo]], self.common[hi[todo]]).astype(np.int64)
                    if full_only:
                        useful = n[todo] - step + shorter >= self.depth
                        size[todo[~useful]] = 0
                        todo, shorter = todo[useful], shorter[useful]
                    for words in np.unique(shorter).tolist():
                        part = todo[shorter == words]
                        lo[part], hi[part] = self.widen(lo[part], hi[part], words)
                        size[part] = words
            match[places] = size[live]
            whole = size[live] == self.depth
            found[places[whole]] = self.least[self.blocks.rank(lo[live[whole]] + 1) - 1]
        cuts = list(zip((ends - lengths).tolist(), ends.tolist(), strict=True))
        return [match[a:b] for a, b in cuts], [found[a:b] for a, b in cuts]


def word_ids(texts: pa.Array) -> tuple[list[np.ndarray], int]:
    """Texts of words with one space between them as arrays of ids from 1 on, and one more than the largest id."""
    split = pc.split_pattern(texts.cast(pa.large_binary()), pattern=b" ")
    words = split.flatten().dictionary_encode()
    ids, ends = words.indices.to_numpy().astype(np.int64) + 1, np.cumsum(split.value_lengths().to_numpy())
    return np.split(ids, ends[:-1]), len(words.dictionary) + 1


def _as_runs(docs: np.ndarray) -> list[dict]:
    ends = np.append(np.flatnonzero(np.diff(docs)) + 1, len(docs)).tolist()
    return [{"start": s, "end": e, "doc_id": int(docs[s])} for s, e in zip([0, *ends], ends, strict=False)]


def repeated(values: np.ndarray) -> np.ndarray:
    """Those that are there more than once, each once."""
    each, counts = np.unique(values, return_counts=True)
    return each[counts > 1]


def least_documents(texts: list[np.ndarray], docs: np.ndarray, anchors: np.ndarray, sigma: int, min_words: int, growth: int | None = GROWTH) -> list[np.ndarray]:
    """For each window of each text the smallest document that has it.

    Of each anchor, the text of the smallest document is indexed and all others are streamed against the index. What is found whole there is done, and isn't indexed
    itself; of the others the next ``growth`` texts are indexed, and so on. The last text of an anchor has no other to meet, and the first one none with a smaller document. As documents come in ascending order, the first index that has a window has its smallest one.
    growth None: all texts are indexed at once.
    """
    least = [np.full(len(t) - min_words + 1, d, np.int64) for t, d in zip(texts, docs.tolist(), strict=True)]
    pending, take = np.lexsort((docs, anchors)), 1
    while len(pending):
        first = np.flatnonzero(np.append(True, np.diff(anchors[pending]) != 0))
        turn = np.arange(len(pending)) - np.repeat(first, np.diff(np.append(first, len(pending))))
        chosen, others = (pending, pending[:0]) if growth is None else (pending[turn < take], pending[turn >= take])
        asked = pending if growth is None else pending[turn > 0]
        indexed = [texts[i] for i in chosen.tolist()]
        index = FMIndex(indexed, sigma, min_words, docs[chosen])
        known = np.zeros(sigma, bool)
        known[np.concatenate(indexed)] = True
        sizes, found = index.matching_statistics([np.where(known[texts[i]], texts[i], -1) for i in asked.tolist()], full_only=True)
        open_ = []
        for i, size, doc in zip(asked.tolist(), sizes, found, strict=True):
            whole = size[: len(least[i])] == min_words
            least[i][whole] = np.minimum(least[i][whole], doc[: len(whole)][whole])
            if not whole.all():
                open_.append(i)
        pending = others[np.isin(others, open_)]
        pending = pending[np.isin(anchors[pending], repeated(anchors[pending]))]
        take *= growth or 1
    return least


def _search_shard(min_words: int, growth: int | None = GROWTH):
    def run(part: pa.Table) -> pa.Table:
        texts, sigma = word_ids(part.column("words").combine_chunks())
        least = least_documents(texts, part.column("doc_id").to_numpy(), part.column("anchor").to_numpy(), sigma, min_words, growth)
        return pa.Table.from_arrays([part.column("anchor").combine_chunks(), part.column("id").combine_chunks(), pa.array([_as_runs(x) for x in least], RUNS)], schema=REPORTS_ARROW)

    return run


def _word_places(piece: bytes) -> list[int]:
    """Where the words of a piece start, and one place behind the space that would follow it."""
    return [0, *(np.flatnonzero(np.frombuffer(piece, np.uint8) == 0x20) + 1).tolist(), len(piece) + 1]


def _single(min_words: int):
    """The window of each piece that starts at the word ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1000):
            words = []
            for piece, at in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                ends = _word_places(piece)
                words.append(piece[ends[at] : ends[at + min_words] - 1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(words, pa.binary())], ["anchor", "id", "doc_id", "words"])

    return run


def _windows(min_words: int):
    """Each window of a piece with its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns], strict=True)
            while part := list(itertools.islice(rows, 500)):
                out = []
                for anchor, id_, doc_id, last_doc, piece in part:
                    ends = _word_places(piece)
                    for s in range(len(ends) - min_words):
                        out.append((anchor, id_, doc_id, last_doc, s, hashlib.blake2b(piece[ends[s] : ends[s + min_words] - 1], digest_size=16).digest()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["anchor", "id", "doc_id", "last_doc", "at", "window"])

    return run


def _finish(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for doc_id, text, spans in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words, merged = text.split(), []
                for s, e in sorted((x["start"], x["end"] + min_words - 1) for x in spans or ()):
                    if merged and s <= merged[-1]["end"]:
                        merged[-1]["end"] = max(e, merged[-1]["end"])
                    else:
                        merged.append({"start": s, "end": e})
                kept, at = [], 0
                for x in merged:
                    kept += words[at : x["start"]]
                    at = x["end"]
                kept += words[at:]
                rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), merged))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), RESULT_ARROW.types, strict=True)], schema=RESULT_ARROW)

    return run


def repeated_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed spans (in words) of every row.

    min_words is at least 21, ids are whole numbers (or cast to them). Null texts have no words. Rows that repeat an id don't remove each other's words, whatever
    their texts; rows with a null id lose nothing and remove nothing. An empty table gives an empty result.
    """
    if min_words <= GRAM:
        raise ValueError(f"min_words must be over {GRAM}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    data = F.coalesce(docs[text_col].cast("binary"), F.lit(b""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.md5(data).alias("text_key"), data.alias("text"))
    anchors = scratch.save(rows.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(trimmed(_anchors(min_words)), ANCHORS), "anchors")
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    marks = anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("marks"))
    marks = scratch.save(marks, "marks")
    scratch.drop("anchors")
    cut = rows.join(marks.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text_key", "text", "marks").mapInArrow(trimmed(_cut(min_words)), CUT)
    path = f"{scratch.root}/cut"
    cut.write.option("compression", "zstd").option("parquet.block.size", str(ROW_GROUP)).partitionBy("kind").parquet(path)
    scratch.drop("marks")
    cut = spark.read.schema(CUT.replace("kind string, ", "") + ", kind string").parquet(path)
    done, open_ = cut.where("kind = 'done'"), cut.where("kind = 'open'")

    pieces = open_.select("doc_id", "text", "segments").mapInArrow(trimmed(_pieces(min_words)), PIECES)
    pieces = scratch.save(pieces.groupBy("anchor", "id").agg(F.min("doc_id").alias("doc_id"), F.max("last_doc").alias("last_doc"), F.first("words").alias("words")), "pieces")
    sizes = pieces.groupBy("anchor").count()
    hot = scratch.save(sizes.where(F.col("count") > shard_segments).select("anchor"), "hot")
    any_hot = not hot.isEmpty()
    cool = pieces.join(hot, "anchor", "left_anti") if any_hot else pieces
    shards = max(parallelism(spark), -(-pieces.count() // shard_segments))
    search = trimmed(_search_shard(min_words))
    reports = cool.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInArrow(search, REPORTS)
    if any_hot:
        whole = pieces.join(hot, "anchor")
        windows = whole.select("anchor", "id", "doc_id", "last_doc", "words").mapInArrow(trimmed(_windows(min_words)), "anchor long, id binary, doc_id long, last_doc long, at int, window binary")
        windows = scratch.save(windows, "windows")
        first = F.min_by(F.struct("anchor", "id", "at"), F.struct("doc_id", "id", "at"))
        again = windows.groupBy("window").agg(F.min("doc_id").alias("doc_id"), F.max("last_doc").alias("last_doc"), first.alias("p")).where("doc_id < last_doc")
        again = scratch.save(again.select("window", "doc_id", "last_doc", "p.*"), "again")
        # a window that two documents have is a segment of its own from here on; its words come from the first piece that has it
        single = again.join(whole.select("anchor", "id", "words"), ["anchor", "id"]).select("anchor", F.col("window").alias("id"), "doc_id", "words", "at").mapInArrow(_single(min_words), "anchor long, id binary, doc_id long, words binary")
        shards = max(parallelism(spark), -(-again.count() // shard_segments))
        least = single.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).groupBy("shard").applyInArrow(trimmed(_search_shard(min_words, None)), REPORTS)
        least = scratch.save(least.select(F.col("id").alias("window"), F.get("runs", F.lit(0))["doc_id"].alias("least")), "least")
        found = windows.select("anchor", "id", "at", "window").join(broadcast_if(least, WINDOWS_BROADCAST), "window").groupBy("anchor", "id")
        found = found.agg(F.collect_list(F.struct(F.col("at").alias("start"), (F.col("at") + 1).alias("end"), F.col("least").alias("doc_id"))).alias("runs"))
        reports = reports.unionByName(found)
    reports = scratch.save(reports, "reports")

    segments = open_.select("doc_id", "text_key", F.explode("segments").alias("s")).select("doc_id", "text_key", "s.anchor", "s.id", "s.at")
    runs = segments.join(reports, ["anchor", "id"]).select("doc_id", "text_key", "at", F.filter("runs", lambda r: r["doc_id"] < F.col("doc_id")).alias("runs")).where(F.size("runs") > 0)
    spans = runs.select("doc_id", "text_key", F.transform("runs", lambda r: F.struct((r["start"] + F.col("at")).alias("start"), (r["end"] + F.col("at")).alias("end"))).alias("spans"))
    spans = spans.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    finished = open_.join(spans, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans").mapInArrow(trimmed(_finish(min_words)), RESULT)
    untouched = done.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return untouched.unionByName(finished)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_windows(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op1_substring_dedup": op1_substring_dedup}

ORACLES = {
    "op1_substring_dedup": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s : s + {MIN_WORDS - 1}], ' ') AS win FROM w, LATERAL (SELECT unnest(range(1, len(ws) - {MIN_WORDS - 2})) AS s)),
first AS (SELECT win, min(doc_id) AS first FROM win GROUP BY win HAVING count(*) > 1),
hit AS (SELECT win.doc_id, s FROM win JOIN first USING (win) WHERE first < win.doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM hit, LATERAL (SELECT unnest(range(s, s + {MIN_WORDS})) AS p)),
g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
}
