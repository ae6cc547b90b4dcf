"""N-gram Jaccard join with prefix trees.

A document is the set of its 5-word shingles (64-bit hashes). Equal sets are one node from the start.
All sets are put in one global order: shingles found in over HOT sets come last, the commonest at the very end, the others by hash.
A shingle's key says its place in that order, so sets are sorted arrays of keys.
Two sets of similarity t share one of the first ``n - ceil(t n) + 1`` shingles of each (the prefix), and where
the first such shingle stands bounds their overlap.

1. Frequencies are counted over all sets, for the part of the hash range that prefixes come from. The order may be any,
   as long as it is one: the hot list only makes it better, so its size can be bounded.
2. The tree's first level is spread over the cluster: prefix shingles are gathered by hash range, packed, and those of one set
   only are dropped, and rows that no link can have as its first shared shingle: of two sets the smaller one has that in its first seventh or so (at 75 %), and the
   other's place bounds the smaller one's size. A shingle that a task has seen in many sets goes around the range's task, which gets one of its rows.
3. The prefix tree: a root is a shingle and a class of sizes, below it are the heads (prefixes) of the sets that have it, in the global order, so
   that what they share is stored once. A shard of roots is one tree. All its probes are walked through it at once: an overlap is counted
   once a run of the tree, for all sets below it, and a subtree is left where the lengths that remain, of the probe and of the sets below, can't reach the threshold any more.
4. First round: every member of a shingle's group is compared with one hub only, the member of whose prefix the most
   is shared, in a tree of the hub. Links are merged into components, so most of a large group of near copies needs one comparison each.
5. Second round: trees of the groups that still have sets of several components. The sets outside the group's largest component are walked through it; subtrees of
   their own component are left. A large group is dealt into cells of CELL sets and CELL probes by the same rule.
6. What a tree of heads lets through, and then a bound from parity bitmaps of the sets, is walked through a tree of whole sets in the same way, which gives exact overlaps.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_GROUP, Scratch, broadcast_if, by_bytes, distinct, gram_hashes, mix64, parallelism, table, trimmed, words_of
from .components import components

SHINGLE, PERCENT = 5, 75
HOT, HOT_LIST = 64, 1_000_000
#: Share of the hash range whose shingles are counted, in 256ths.
COUNTED = 90
#: Top bits of a hash that name the range in which it is counted; ranges are put together to about RANGE_ROWS hashes each.
RANGE_BITS, RANGE_ROWS = 16, 100_000
#: Bits of a key that hold the hash; those above say how common the shingle is.
KEY_BITS = 61
FLUSH, BUCKET_ROWS, LOCAL_HOT = 300_000, 500_000, 8
#: Sets or probes of one cell, shingles of either (before they are cut to heads), and shingles that a shard gets.
CELL, CELL_SHINGLES, TREE_SHINGLES = 1000, 4_000_000, 1_000_000
#: Elements that are looked up in one step of a walk, and bytes of bitmaps that are compared at once.
STEP, MAP_BYTES = 1_000_000, 4 << 20
#: Keys of a head that a tree gets at most (what isn't known counts as shared if it may be), and places of a bitmap at least.
HEAD_KEYS, BITMAP_BITS = 64, 2048
#: Roots with the same smallest document, at so many neighbouring places of it, go to one shard: groups of near copies have the same sets again and again.
NEAR = 128
IDS_BROADCAST, COPIES_BROADCAST, CLASSES_BROADCAST, JOBS_BROADCAST = 3_000_000, 1_000_000, 2_000_000, 200_000

SETS = "kind string, doc_id long, n_shingles long, set_id binary, range int, low binary"
SETS_ARROW = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("range", pa.int32()), ("low", pa.binary())])
MEMBERS = "shingle long, doc_id long, n int, pos int"
PAIR = "a long, b long, n int, m int"


def needed(n: np.ndarray | int, m: np.ndarray | int, percent: int):
    """Least overlap of linked sets of these sizes: 100 * overlap >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def shingle_sets(texts: pa.Array, k: int, keys: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, sorted; with fewer than k words the whole sequence is one, without words there is none.
    keys: what to put in the place of the hashes."""
    w = words_of(texts, fold=True)
    grams = gram_hashes(w.hashes, k)
    grams = grams if keys is None else keys(grams)
    for a, b in pairwise(w.first.tolist()):
        if b - a >= k:
            yield distinct(grams[a : b - k + 1])
        else:
            whole = mix64(gram_hashes(w.hashes[a:b], b - a) + np.uint64(b - a)) if b > a else np.empty(0, np.uint64)
            yield whole if keys is None else keys(whole)


def bitmap(s: np.ndarray) -> np.ndarray:
    """One bit for each place: the parity of the number of shingles there; as words. At least twice as many places as shingles, a power of two."""
    places = max(BITMAP_BITS, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(bool)).view(np.uint64)


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps with fewer places: the upper half is laid on the lower one as often as needed."""
    while maps.shape[-1] > words:
        half = maps.shape[-1] // 2
        maps = maps[..., :half] ^ maps[..., half:]
    return maps


def overlap_bounds(n: np.ndarray, maps: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """No sets p[i] and q[i] of these sizes and bitmaps share more: shingles that only one of them has leave odd places."""
    width = np.array([len(x) for x in maps], np.int64)
    place, side = np.zeros(len(maps), np.int64), {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        place[at], side[w] = np.arange(len(at)), np.stack([maps[i] for i in at.tolist()])
    odd = np.zeros(len(p), np.int64)
    both = width[p] * (int(width.max(initial=0)) + 1) + width[q]
    for name in np.unique(both).tolist():
        pairs = np.flatnonzero(both == name)
        x, y = int(width[p[pairs[0]]]), int(width[q[pairs[0]]])
        step = max(1, MAP_BYTES // (8 * max(x, y)))
        for k in range(0, len(pairs), step):
            some = pairs[k : k + step]
            differ = folded(side[x][place[p[some]]], min(x, y)) ^ folded(side[y][place[q[some]]], min(x, y))
            odd[some] = np.bitwise_count(differ).sum(1, dtype=np.int64)
    return (n[p] + n[q] - odd) // 2


def _sets(k: int):
    """Two kinds of rows: every document's set in short, and the counted hashes packed by range (the 32 bits below the range's)."""

    def low_rows(held: list[np.ndarray]) -> pa.RecordBatch:
        x = np.sort(np.concatenate(held))
        part = (x >> np.uint64(64 - RANGE_BITS)).astype(np.int64)
        low = ((x << np.uint64(RANGE_BITS)) >> np.uint64(32)).astype("<u4")
        first = np.flatnonzero(np.diff(part, prepend=-1))
        blobs = [low[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(x)), strict=True)]
        none = [pa.nulls(len(first), t) for t in SETS_ARROW.types[1:4]]
        return pa.RecordBatch.from_arrays([pa.array(["low"] * len(first)), *none, pa.array(part[first].astype(np.int32)), pa.array(blobs, pa.binary())], schema=SETS_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, limit = [], 0, np.uint64(COUNTED << 56)
        for batch in by_bytes(batches):
            rows = []
            for doc_id, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), k), strict=True):
                rows.append(("set", doc_id, len(s), hashlib.blake2b(s, digest_size=16).digest(), None, None))
                if doc_id is not None:
                    held.append(s[: np.searchsorted(s, limit)])
                    size += len(held[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), SETS_ARROW.types, strict=True)], schema=SETS_ARROW)
            if size >= FLUSH:
                yield low_rows(held)
                held, size = [], 0
        if size:
            yield low_rows(held)

    return run


# --- the global order ---


def _hot_in_range(part: pa.Table) -> pa.Table:
    """Names (RANGE_BITS and 32 bits) of shingles of more than HOT sets."""
    held = [(np.int64(r) << np.int64(32)) | np.frombuffer(b, "<u4").astype(np.int64) for r, b in zip(part.column("range").to_pylist(), part.column("low").to_pylist(), strict=True)]
    names = np.sort(np.concatenate(held))
    first = np.flatnonzero(np.diff(names, prepend=-1))
    counts = np.diff(np.append(first, len(names)))
    hot = counts > HOT
    return pa.table({"name": pa.array(names[first[hot]]), "n": pa.array(counts[hot].astype(np.int64))})


class Order:
    """The global order of shingles. Hot ones come last, in seven classes of frequency; within a class the hash decides."""

    def __init__(self, names: np.ndarray, counts: np.ndarray):
        by = np.argsort(names)
        self.names = names[by]
        self.level = np.clip(np.log2(np.maximum(counts[by], 1) / HOT).astype(np.int64) + 1, 1, 7).astype(np.uint64) << np.uint64(KEY_BITS)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers that sort like the shingles."""
        out = hashes >> np.uint64(64 - KEY_BITS)
        if len(self.names) and len(hashes):
            names = (hashes >> np.uint64(32 - RANGE_BITS)).astype(np.int64)
            at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
            out |= np.where(self.names[at] == names, self.level[at], np.uint64(0))
        return out


# --- prefixes ---


def _packed(arrays: tuple[np.ndarray, ...], a: int, b: int) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(x[a:b].tobytes() for x in arrays))


#: Columns of packed rows: a shingle (its key, mixed), the document, the set's size, and the place in its order.
FIELDS = tuple(np.dtype(t) for t in ("<u8", "<i8", "<i4", "<i4"))


def _unpacked(blobs: list[bytes]) -> list[np.ndarray]:
    import zstandard

    parts: list[list[np.ndarray]] = [[] for _ in FIELDS]
    for blob in blobs:
        data = zstandard.ZstdDecompressor().decompress(blob)
        n, at = len(data) // sum(t.itemsize for t in FIELDS), 0
        for held, t in zip(parts, FIELDS, strict=True):
            held.append(np.frombuffer(data, t, n, at))
            at += n * t.itemsize
    return [np.concatenate(p) for p in parts]


def _prefixes(k: int, percent: int, order, buckets: int):
    """(bucket, packed rows). Negative buckets hold groups that one task has seen whole."""
    bounds = np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)

    def flush(held: list[tuple[np.ndarray, int, int]], turn: int) -> pa.RecordBatch:
        lengths = np.array([len(s) for s, _, _ in held])
        shingle = mix64(np.concatenate([s for s, _, _ in held]))
        by = np.argsort(shingle)
        shingle = shingle[by]
        doc = np.repeat(np.array([d for _, d, _ in held], np.int64), lengths)[by]
        n = np.repeat(np.array([m for _, _, m in held], np.int32), lengths)[by]
        pos = (np.arange(len(by)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)[by]
        first = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
        counts = np.diff(np.append(first, len(shingle)))
        crowd = np.repeat(counts > LOCAL_HOT, counts)
        names, blobs = [], []
        if crowd.any():  # these are groups anyway: they need not meet in one task
            names.append(-1 - turn % (1 << 20))
            blobs.append(_packed((shingle[crowd], doc[crowd], n[crowd], pos[crowd]), 0, None))
            n[first[crowd[first]]] *= -1  # a stand-in: it tells the bucket of the group, and isn't returned
            keep = ~crowd
            keep[first] = True
            shingle, doc, n, pos = shingle[keep], doc[keep], n[keep], pos[keep]
        starts = np.searchsorted(shingle, bounds)
        for bucket, (a, b) in enumerate(pairwise([*starts.tolist(), len(shingle)])):
            if a < b:
                names.append(bucket)
                blobs.append(_packed((shingle, doc, n, pos), a, b))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen, turn = [], 0, {}, None
        for batch in by_bytes(batches):
            for doc_id, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), k, order.value.keys), strict=True):
                n = len(s)
                if not n:
                    continue
                turn = doc_id if turn is None else turn
                digest = hashlib.blake2b(s, digest_size=16).digest()
                if seen.get(digest, doc_id + 1) <= doc_id:
                    continue  # an equal set with a smaller id stands for this one
                seen[digest] = doc_id
                held.append((s[: n - -(-percent * n // 100) + 1].copy(), doc_id, n))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield flush(held, turn)
                    held, size, seen, turn = [], 0, {}, turn + 1
        if size:
            yield flush(held, turn)

    return run


def linkable(shingle: np.ndarray, n: np.ndarray, pos: np.ndarray, whole: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of shingles (sorted; sizes, places) may have a link whose first shared shingle is this one. Neither set shares what it has before that, so
    at most n - pos: this bounds the other's size, and the smaller set's own place. whole: all of the shingle's rows are here; the others are kept."""
    first = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
    counts = np.diff(np.append(first, len(shingle)))
    n, rest = n.astype(np.int64), n.astype(np.int64) - pos
    largest = (100 + percent) * rest // percent - n  # the other set's size at most
    smaller = np.minimum.reduceat(np.where(largest >= n, n, np.iinfo(np.int64).max), first)  # the least size that the smaller set of a link can have
    keep = largest >= np.repeat(smaller, counts)
    a = first[counts == 2]  # most groups: the two are compared
    b = a + 1
    fit = (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (np.minimum(rest[a], rest[b]) >= needed(n[a], n[b], percent))
    keep[a] = keep[b] = fit
    keep &= np.repeat(np.add.reduceat(keep, first, dtype=np.int64), counts) > 1
    return keep | ~np.repeat(np.logical_and.reduceat(whole, first), counts)


def _groups(percent: int):
    """The rows of shingles that several sets have, without those that can't be the first shared one of any link."""

    def run(part: pa.Table) -> pa.Table:
        shingle, doc, n, pos = _unpacked(part.column("rows").to_pylist())
        if part.column("bucket")[0].as_py() >= 0:
            by = np.argsort(shingle)
            s = shingle[by]
            twice = np.append(s[1:] == s[:-1], False)
            twice[1:] |= twice[:-1].copy()
            by = by[twice]
            if len(by):
                by = by[linkable(shingle[by], n[by], pos[by], n[by] > 0, percent) & (n[by] > 0)]
            shingle, doc, n, pos = shingle[by], doc[by], n[by], pos[by]
        return pa.table({"shingle": pa.array(shingle.view(np.int64)), "doc_id": pa.array(doc), "n": pa.array(n), "pos": pa.array(pos)})

    return run


# --- trees ---


def _heads(k: int, percent: int, order):
    """Every text's prefix, and the bitmap of the whole set. Of a key the 32 high bits, which keep the order; two shingles that become alike can only raise a bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            sets = list(shingle_sets(batch.column(1), k, order.value.keys))
            heads = [(s[: len(s) - -(-percent * len(s) // 100) + 1] >> np.uint64(32)).astype("<u4").tobytes() for s in sets]
            maps = pa.array([bitmap(s).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(heads, pa.binary()), maps], ["doc_id", "n", "keys", "map"])

    return run


def _whole_sets(k: int, order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            sets = list(shingle_sets(batch.column(1), k, order.value.keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "n", "keys"])

    return run


class Sets(NamedTuple):
    """Sets below their roots. keys: those known (sorted whole numbers under 2**32), from the root's shingle on; rest: how many there are from there on,
    known or not; n: the whole set's size. Sets with equal labels aren't compared."""

    root: np.ndarray
    keys: list[np.ndarray]
    n: np.ndarray
    rest: np.ndarray
    label: np.ndarray

    def take(self, rows: np.ndarray) -> Sets:
        return Sets(self.root[rows], [self.keys[i] for i in rows.tolist()], self.n[rows], self.rest[rows], self.label[rows])


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... counts[i] numbers, for every i."""
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class PrefixTree:
    """Sets in the global order as a prefix tree with compressed edges, for several roots.

    Sets are sorted, and each set adds one run: what lies below the prefix that it shares with the set before it. A run
    hangs on the run that holds the last shingle of that prefix, at that depth. So a shingle shared by many sets from the start is there once.
    """

    def __init__(self, sets: Sets):
        root = sets.root.tolist()
        self.order = np.array(sorted(range(len(root)), key=lambda i: (root[i], sets.keys[i].astype(">u4").tobytes())), np.int64)
        self.sets = sets = sets.take(self.order)
        size = len(root)
        self.length = np.array([len(s) for s in sets.keys], np.int64)
        self.depth = np.zeros(size, np.int64)  # where each run starts
        self.parent = np.full(size, -1, np.int64)
        same = np.append(False, sets.root[1:] == sets.root[:-1]) if size else np.empty(0, bool)
        path: list[int] = []
        for r in range(size):
            if same[r]:
                before, s = sets.keys[r - 1], sets.keys[r]
                shared = min(len(before), len(s))
                differ = before[:shared] != s[:shared]
                at = int(differ.argmax()) if shared else 0
                self.depth[r] = at if shared and differ[at] else shared
                while path and self.depth[path[-1]] >= self.depth[r]:
                    path.pop()
            else:
                path = []
            if path:
                self.parent[r] = path[-1]
            path.append(r)
        # of all sets below a run: children stand behind their parents
        self.least, self.most, self.low, self.high = sets.n.copy(), sets.rest.copy(), sets.label.copy(), sets.label.copy()
        for r in range(size - 1, -1, -1):
            up = self.parent[r]
            if up >= 0:
                for held, best in ((self.least, min), (self.most, max), (self.low, min), (self.high, max)):
                    held[up] = best(held[up], held[r])
        self.children = np.argsort(self.parent, kind="stable")
        self.first = np.searchsorted(self.parent[self.children], np.arange(-1, size + 1))  # first[r + 1]: of the run r; the roots' runs come first
        self.start = np.concatenate([[0], np.cumsum(self.length - self.depth)])
        self.elements = np.concatenate([s[d:] for s, d in zip(sets.keys, self.depth.tolist(), strict=True)] or [np.empty(0)]).astype(np.int64)

    def linked(self, probes: Sets, overlap: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of a probe, number of a set) below the same root that may be linked; where all keys are known, those that are.
        overlap: what a probe and a set share at the root."""
        tops = self.children[: self.first[1]]
        lo, hi = (np.searchsorted(self.sets.root[tops], probes.root, side) for side in ("left", "right"))
        ends = np.searchsorted(self.sets.root, probes.root, "right")
        cost = np.cumsum(self.start[ends] - self.start[np.searchsorted(self.sets.root, probes.root, "left")] + 1)
        found, at = [(np.empty(0, np.int64), np.empty(0, np.int64))], 0
        while at < len(cost):
            stop = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + STEP, "right")))
            rows = np.arange(at, stop)
            counts = hi[rows] - lo[rows]
            p, r = self._walk(probes.take(rows), np.repeat(np.arange(len(rows)), counts), tops[_spread(lo[rows], counts)], overlap, percent)
            found.append((p + at, self.order[r]))
            at = stop
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _walk(self, probes: Sets, p: np.ndarray, r: np.ndarray, overlap: int, percent: int):
        """Probes p at the start of runs r, all at once, a level of the tree at a time."""
        sizes = np.array([len(x) for x in probes.keys], np.int64)
        first = np.cumsum(sizes) - sizes
        keys = (np.repeat(np.arange(len(sizes)), sizes) << 32) | np.concatenate(probes.keys).astype(np.int64)
        last = np.array([x[-1] if len(x) else -1 for x in probes.keys], np.int64)
        # shared so far; keys of the set behind the probe's last known one, which it may have or not; keys of the probe left behind
        shared, open_, passed = np.full(len(p), overlap, np.int64), np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        while len(p):
            bound = shared + np.minimum(open_ + self.most[r] - self.depth[r], probes.rest[p] - passed)
            go = (bound >= needed(probes.n[p], self.least[r], percent)) & ((self.low[r] != probes.label[p]) | (self.high[r] != probes.label[p]))
            p, r, shared, open_, passed = p[go], r[go], shared[go], open_[go], passed[go]
            if not len(p):
                break
            lengths = self.start[r + 1] - self.start[r]
            base = np.cumsum(lengths) - lengths
            elements, of = self.elements[_spread(self.start[r], lengths)], np.repeat(p, lengths)
            wanted = (of << 32) | elements
            at = np.searchsorted(keys, wanted)
            hits = np.concatenate([[0], np.cumsum(keys[np.minimum(at, len(keys) - 1)] == wanted if len(keys) else np.zeros(len(at), bool))])
            beyond = np.concatenate([[0], np.cumsum(elements > last[of])])
            left = np.append(at - first[of], 0)
            end = base + lengths
            ending = np.where(lengths > 0, left[end - 1], passed)
            unknown = np.minimum(open_ + beyond[end] - beyond[base] + self.sets.rest[r] - self.length[r], probes.rest[p] - ending)
            yes = (shared + hits[end] - hits[base] + unknown >= needed(probes.n[p], self.sets.n[r], percent)) & (self.sets.label[r] != probes.label[p])
            out.append((p[yes], r[yes]))
            counts = self.first[r + 2] - self.first[r + 1]
            up, below = np.repeat(np.arange(len(r)), counts), self.children[_spread(self.first[r + 1], counts)]
            end = base[up] + self.depth[below] - self.depth[r[up]]
            p, r, passed = p[up], below, left[end - 1]
            shared, open_ = shared[up] + hits[end] - hits[base[up]], open_[up] + beyond[end] - beyond[base[up]]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _in_trees(percent: int, overlap: int, whole: bool):
    """One shard: its rows as a tree, and its probes walked through it."""

    def run(part: pa.Table) -> pa.Table:
        lists = part.column("cells").combine_chunks()
        of = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))  # the set of each cell's row
        ids, n = (part.column(c).to_numpy()[of] for c in ("doc_id", "n"))
        cell, skip, label, member, probe = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
        keys = [np.frombuffer(x, "<u8" if whole else "<u4") for x in part.column("keys").to_pylist()]
        if whole:  # places in the order of all keys here are smaller than keys
            ranks = np.unique(np.concatenate(keys), return_inverse=True)[1].astype(np.uint32)
            ends = np.cumsum([len(x) for x in keys])
            keys = [ranks[b - len(x) : b] for x, b in zip(keys, ends.tolist(), strict=True)]
        known = None if whole else HEAD_KEYS
        keys = [keys[i][at:][:known] for i, at in zip(of.tolist(), (skip - part.column("least").to_numpy()[of]).tolist(), strict=True)]
        sets = Sets(cell, keys, n.astype(np.int64), n.astype(np.int64) - skip, label)
        member, probe = np.flatnonzero(member), np.flatnonzero(probe)
        p, q = PrefixTree(sets.take(member)).linked(sets.take(probe), overlap, percent)
        p, q = probe[p], member[q]
        if not whole:  # the last check of what the tree lets through
            maps = [np.frombuffer(x, "<u8") for x in part.column("map").to_pylist()]
            close = overlap_bounds(part.column("n").to_numpy().astype(np.int64), maps, of[p], of[q]) >= needed(sets.n[p], sets.n[q], percent)
            p, q = p[close], q[close]
        return pa.table({"a": pa.array(ids[p]), "b": pa.array(ids[q]), "n": pa.array(n[p], pa.int32()), "m": pa.array(n[q], pa.int32())})

    return run


class _Join:
    """docs: doc_id, text. members: doc_id, n, keys (its head), map (its bitmap) of every set that shares a prefix shingle with another one.

    Rows of trees: the cell (a root, or a part of one), the set, its size, how many of its keys the root stands for, its label, and whether it is
    a member of the tree, a probe, or both. near: what its shard is chosen by; a set is sent once to a shard, for all its cells there.
    """

    def __init__(self, docs: DataFrame, members: DataFrame, scratch: Scratch, k: int, percent: int, order):
        self.docs, self.members, self.scratch, self.k, self.percent, self.order = docs, members, scratch, k, percent, order

    def group_jobs(self, groups: DataFrame) -> DataFrame:
        """Rows of the trees of groups: shingle, doc_id, n, pos, label. Linked sets lie in one class of sizes, or in two neighbours: a set is in the trees of its class and
        of the next one. In that it need only be a probe, or a member if it is of the group's largest component, whose sets don't probe."""
        scale = math.log(100 / self.percent) * (1 + 1e-9) + 1e-9
        size, zero = F.floor(F.log("n") / F.lit(scale)), F.lit(0).cast("long")
        rows = groups.select("shingle", "doc_id", "n", (F.col("pos") + 1).alias("skip"), "label", F.explode(F.array(F.struct(size.alias("size"), F.lit(True).alias("own")), F.struct((size + 1).alias("size"), F.lit(False).alias("own")))).alias("c"))
        rows = rows.select("shingle", "c.size", "c.own", "doc_id", "n", "skip", "label")
        root = ["shingle", "size"]
        one = F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"), F.count(F.when(F.col("own"), 1)).alias("own"), F.min(F.struct("doc_id", F.floor(F.col("skip") / NEAR).alias("part"))).alias("near")
        labels = rows.groupBy(*root, "label").agg(*one)
        roots = labels.groupBy(*root).agg(F.max(F.struct("c", "label", "s")).alias("most"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("own").alias("own"), F.min("near").alias("near"), F.count(F.lit(1)).alias("labels"))
        parts = (F.greatest(F.lit(1), F.ceil(x / CELL), F.ceil(y / CELL_SHINGLES)).cast("long") for x, y in ((F.col("c"), F.col("s")), (F.col("c") - F.col("most.c"), F.col("s") - F.col("most.s"))))
        roots = roots.where("labels > 1 AND own > 0").select(*root, F.xxhash64("near").alias("near"), F.col("most.label").alias("largest"), *(x.alias(name) for x, name in zip(parts, ("trees", "batches"), strict=True)))
        m = rows.join(broadcast_if(self.scratch.save(roots, "roots"), CLASSES_BROADCAST), root)
        m = m.withColumn("tree", F.pmod(F.xxhash64("doc_id"), F.col("trees"))).withColumn("batch", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("batches")))
        asks = F.col("label") != F.col("largest")
        lies = F.transform(F.sequence(zero, F.col("batches") - 1), lambda b: F.struct(F.col("tree").alias("tree"), b.alias("batch"), F.lit(True).alias("member"), (asks & (b == F.col("batch"))).alias("probe")))
        asked = F.transform(F.sequence(zero, F.col("trees") - 1), lambda t: F.struct(t.alias("tree"), F.col("batch").alias("batch"), F.lit(False).alias("member"), F.lit(True).alias("probe")))
        asked = F.when(asks, F.filter(asked, lambda x: ~F.col("own") | (x["tree"] != F.col("tree"))))
        none = F.filter(lies, lambda x: F.lit(False))
        m = m.withColumn("x", F.explode(F.concat(F.when(F.col("own") | ~asks, lies).otherwise(none), F.coalesce(asked, none))))
        return m.select(F.xxhash64(*root, "x.tree", "x.batch").alias("cell"), F.xxhash64("near", "x.tree", "x.batch").alias("near"), "doc_id", "n", "skip", "label", "x.member", "x.probe")

    def star_jobs(self, pairs: DataFrame) -> DataFrame:
        """Rows of trees of the b of each a, which the set of a is walked through. pairs: a, b, n, m. Many b, or long ones, make several trees."""
        heads = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c"), F.sum("m").alias("s"), F.max("n").alias("n"))
        parts = heads.select("a", "n", F.greatest(F.ceil(F.col("c") / CELL), F.ceil(F.col("s") / CELL_SHINGLES)).cast("long").alias("parts"))
        parts = self.scratch.save(parts, f"parts-{uuid.uuid4().hex[:8]}")
        own, zero = F.lit(0).alias("skip"), F.lit(0).cast("long")
        sets = pairs.select("a", "b", "m").join(broadcast_if(parts.drop("n"), CLASSES_BROADCAST), "a").select(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts"))).alias("cell"), F.col("b").alias("doc_id"), F.col("m").alias("n"), own, F.col("b").alias("label"), F.lit(True).alias("member"), F.lit(False).alias("probe"))
        asks = parts.select("a", "n", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("part"))
        rows = sets.unionByName(asks.select(F.xxhash64("a", "part").alias("cell"), F.col("a").alias("doc_id"), "n", own, F.col("a").alias("label"), F.lit(False).alias("member"), F.lit(True).alias("probe")))
        return rows.withColumn("near", F.col("cell"))

    def walked(self, jobs: DataFrame, label: str, overlap: int = 0, whole: bool = False) -> DataFrame:
        """a, b, n, m: a probe and a set of its tree that may be linked, and their sizes; whole: that are linked."""
        jobs = self.scratch.save(jobs, f"{label}-rows")
        share = 1 if whole else (100 - self.percent) / 100
        shards = max(parallelism(jobs.sparkSession), int((jobs.agg(F.sum("n")).first()[0] or 0) * share // TREE_SHINGLES) + 1)
        cells = jobs.repartition("doc_id").groupBy("doc_id", F.pmod("near", F.lit(shards)).alias("shard"))
        cells = cells.agg(F.collect_list(F.struct("cell", "skip", "label", "member", "probe")).alias("cells"), F.min("skip").alias("least"), F.max("skip").alias("most"))
        cells = self.scratch.save(cells, f"{label}-cells")
        if whole:
            ids = self.scratch.save(jobs.select("doc_id").distinct(), f"{label}-ids")
            sets = self.docs.join(broadcast_if(ids, IDS_BROADCAST), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(trimmed(_whole_sets(self.k, self.order)), "doc_id long, n int, keys binary")
        else:
            sets = self.members
        keys = ["keys"] if whole else [F.expr(f"substring(keys, 4 * least + 1, 4 * (most - least + {HEAD_KEYS}))").alias("keys"), "map"]
        rows = sets.join(broadcast_if(cells, JOBS_BROADCAST), "doc_id").select("shard", "doc_id", "n", "cells", "least", *keys)
        return self.scratch.save(rows.groupBy("shard").applyInArrow(trimmed(_in_trees(self.percent, overlap, whole)), PAIR).distinct(), label)

    def links(self, pairs: DataFrame, label: str) -> DataFrame:
        return self.walked(self.star_jobs(pairs), label, whole=True).select("a", "b")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Ids are whole numbers (or cast to them). Empty and null texts have no shingle and no link. Rows that repeat an id are one node, with the links of all
    their texts. A null id has no component. Texts of any length are whole sets. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    path = f"{scratch.root}/sets"
    rows.mapInArrow(trimmed(_sets(shingle)), SETS).write.option("parquet.block.size", str(ROW_GROUP)).partitionBy("kind").parquet(path)
    both = spark.read.schema(SETS.replace("kind string, ", "") + ", kind string").parquet(path)
    sets = both.where("kind = 'set'").select("doc_id", "n_shingles", "set_id")
    known = rows.where("doc_id IS NOT NULL")
    nodes = sets.where("doc_id IS NOT NULL AND n_shingles > 0")
    total = nodes.agg(F.sum("n_shingles")).first()[0] or 0

    # equal sets: the smallest id stands for all. Ids with several sets can't be left out, they tie what their sets are equal to
    first = nodes.groupBy("set_id").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    copies = scratch.save(nodes.join(first, "set_id").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct(), "copies")
    several = scratch.save(nodes.groupBy("doc_id").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y")).where("x <> y").select("doc_id"), "several")
    several = broadcast_if(several, COPIES_BROADCAST)
    equal = copies.join(several, F.col("b") == F.col("doc_id"), "left_anti")
    tied = copies.join(several, F.col("b") == F.col("doc_id"), "left_semi")

    shift = max(0, RANGE_BITS - max(4, int(total * COUNTED / 256 // RANGE_ROWS).bit_length()))
    low = both.where("kind = 'low'").select("range", "low", F.shiftright("range", shift).alias("part"))
    hot = low.groupBy("part").applyInArrow(trimmed(_hot_in_range), "name long, n long")
    hot = hot.orderBy(F.desc("n"), "name").limit(HOT_LIST).toPandas()  # at most HOT_LIST rows of 16 bytes
    order = spark.sparkContext.broadcast(Order(hot["name"].to_numpy(np.int64), hot["n"].to_numpy(np.int64)))

    buckets = max(parallelism(spark), int(total * (100 - percent) / 100 // BUCKET_ROWS) + 1)
    groups = known.mapInArrow(trimmed(_prefixes(shingle, percent, order, buckets)), "bucket long, rows binary").groupBy("bucket").applyInArrow(trimmed(_groups(percent)), MEMBERS)
    groups = scratch.save(groups.join(broadcast_if(equal.select(F.col("b").alias("doc_id")), COPIES_BROADCAST), "doc_id", "left_anti"), "all")
    # shingles with the same members say the same; the first of them in the order stands for all (it has the smallest positions)
    h, g = F.xxhash64("doc_id"), F.xxhash64("doc_id", F.lit(1))
    who = groups.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(h).alias("s"), F.bit_xor(g).alias("t"), F.sum(h.bitwiseAND(F.lit((1 << 31) - 1))).alias("u"), F.sum("pos").alias("p")).where("c > 1")
    classes = who.groupBy("c", "s", "t", "u").agg(F.min(F.struct("p", "shingle"))["shingle"].alias("shingle"), F.count(F.lit(1)).alias("stands_for"))
    classes = scratch.save(classes.select("shingle", "stands_for"), "classes")
    groups = scratch.save(groups.join(broadcast_if(classes, CLASSES_BROADCAST), "shingle"), "groups")
    scratch.drop("all")
    ids = scratch.save(groups.select("doc_id").distinct(), "ids")
    members = known.join(broadcast_if(ids, IDS_BROADCAST), "doc_id", "left_semi").select("doc_id", "text")
    members = scratch.save(members.mapInArrow(trimmed(_heads(shingle, percent, order)), "doc_id long, n int, keys binary, map binary"), "members")
    join = _Join(known, members, scratch, shingle, percent, order)

    def fits(n, m, i, j):
        """Sizes allow the link, and so does this shingle if it is the first one that both have."""
        rest = F.least(F.col(n) - F.col(i), F.col(m) - F.col(j))
        return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * rest >= percent * (F.col(n) + F.col(m)))

    prefix = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    hubs = groups.groupBy("doc_id", "n").agg((F.sum("stands_for") / F.first(prefix)).alias("shared"))
    hubs = groups.join(hubs, ["doc_id", "n"])
    best = F.min(F.struct((-F.col("shared")).alias("s"), F.col("doc_id").alias("hub"), F.col("n").alias("m"), F.col("pos").alias("j")))
    heads = scratch.save(hubs.groupBy("shingle").agg(best.alias("h")).select("shingle", "h.hub", "h.m", "h.j"), "heads")
    stars = groups.join(broadcast_if(heads, CLASSES_BROADCAST), "shingle").where((F.col("hub") != F.col("doc_id")) & fits("n", "m", "pos", "j"))
    stars = scratch.save(stars.select(F.col("hub").alias("a"), F.col("doc_id").alias("b"), F.col("m").alias("n"), F.col("n").alias("m")).distinct(), "stars")
    links = join.links(join.walked(join.star_jobs(stars), "first-likely"), "first-links").unionByName(tied)
    merged = components(links, scratch, "merged")

    labelled = groups.join(broadcast_if(merged.withColumnRenamed("node", "doc_id"), COPIES_BROADCAST), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component", "stands_for")
    labelled = scratch.save(labelled, "labelled")
    mixed = labelled.groupBy("shingle").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p < q").select("shingle")
    open_ = scratch.save(labelled.join(broadcast_if(scratch.save(mixed, "mixed"), CLASSES_BROADCAST), "shingle"), "open")
    likely = join.walked(join.group_jobs(open_), "second-likely", overlap=1)
    swap = F.col("a") > F.col("b")
    likely = likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("m")).otherwise(F.col("n")).alias("n"), F.when(swap, F.col("n")).otherwise(F.col("m")).alias("m")).distinct()
    seen = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = scratch.save(likely.join(seen, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        merged = components(links.unionByName(join.links(pairs, "second-links")), scratch, "all-links")
    out = sets.select("doc_id", "n_shingles").join(broadcast_if(equal.withColumnRenamed("b", "doc_id"), COPIES_BROADCAST), "doc_id", "left").withColumn("node", F.coalesce("a", "doc_id")).drop("a")
    return out.join(broadcast_if(merged, COPIES_BROADCAST), "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op10_jaccard_join": op10_jaccard_join}

ORACLES = {
    "op10_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i : i + {SHINGLE - 1}], ' ')) END) AS ss FROM w),
n AS (SELECT doc_id, len(ss) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(ss) AS x FROM s),
link AS MATERIALIZED (SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM e p JOIN e q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL) t
         JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {PERCENT} * (na.n + nb.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT reach.doc_id, CAST(any_value(n.n) AS BIGINT) AS n_shingles, min(r) AS component_id FROM reach JOIN n USING (doc_id) GROUP BY reach.doc_id
""",
}
