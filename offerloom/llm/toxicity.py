"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are given for documents, so token labels are derived first, on a bounded sample of labelled
documents: a token of a toxic document is toxic if one of its features (the word, or its first three to six
letters) is far commoner in toxic documents than in others. The CRF is fitted to those token
labels: a potential for each feature of a token and one for each transition. Forward-backward
gives every token's marginal; a document's score is a logistic function of the expected number of
toxic tokens, fitted on the same sample, and its offending offsets are the runs of tokens with a
marginal of at least one half. Whole texts of any length are scored, in chains of their full length.

Only texts go into a score. The model is a table of at most ``model_features`` weights, those that are largest.
"""

from __future__ import annotations

import array
import math
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh, gathered, gram_hashes, small_batches, table, trimmed, words_of

#: Defaults of the training sample's bounds (documents of each class, and characters in all) and of the model's. They fit a task of 500 MB.
TOXIC_SAMPLE, CLEAN_SAMPLE, SAMPLE_CHARS = 900, 1500, 8_000_000
MODEL_FEATURES = 60_000
PREFIXES = (3, 4, 5, 6)
LIFT, EVIDENCE, STEPS, RIDGE = 20.0, 14.0, 45, 0.3
#: Texts that are scored side by side, in tokens and in bytes: chains of like length make full steps.
CHUNK_TOKENS, SLICE_BYTES = 400_000, 16 << 20
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
INNER = re.compile(r"^\W+|\W+$")

SCORE = "score double, predicted int, spans array<struct<start:int,end:int>>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def features(token: str) -> list[int]:
    """64-bit hashes of the lower-cased word without outer punctuation and of its prefixes; 0 where it is shorter."""
    import xxhash

    w = INNER.sub("", token).lower()
    return [xxhash.xxh64_intdigest("=" + w), *[xxhash.xxh64_intdigest(w[:k]) if len(w) >= k else 0 for k in PREFIXES]]


@dataclass
class Model:
    """Weights of features (label 1 against 0), bias, the transition potentials 01, 10, 11 (00 is 0), and the score's line."""

    weights: dict[int, float]
    bias: float
    trans: tuple[float, float, float]
    line: tuple[float, float]


class Potentials(dict):
    """Token -> potential of label 1, with a memo of bounded size."""

    LIMIT = 150_000

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, token: str) -> float:
        if len(self) >= self.LIMIT:
            self.clear()
        get = self.model.weights.get
        value = self[token] = min(30.0, max(-30.0, self.model.bias + sum(get(f, 0.0) for f in features(token))))
        return value


class Chains:
    """Chains side by side: step t of all chains that are that long lies together, longest chain first."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        n = lengths[self.order]
        steps = int(n[0]) if len(n) else 0
        self.active = np.searchsorted(-n, -np.arange(steps), "left")  # chains longer than t
        self.base = np.concatenate([[0], np.cumsum(self.active)])
        starts = np.concatenate([[0], np.cumsum(lengths)])
        self.place = np.empty(int(starts[-1]), np.int64)
        for rank, i in enumerate(self.order.tolist()):
            self.place[starts[i] : starts[i + 1]] = self.base[: lengths[i]] + rank

    def marginals(self, psi: np.ndarray, trans: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(label 1) of each token in side-by-side order, and forward and backward odds."""
        e = np.exp(psi)
        t01, t10, t11 = np.exp(trans)
        fore, back = np.empty_like(e), np.ones_like(e)
        base, active = self.base.tolist(), self.active.tolist()
        for t, k in enumerate(active):
            at = base[t]
            if t:
                prev = fore[base[t - 1] : base[t - 1] + k]
                fore[at : at + k] = e[at : at + k] * (t01 + t11 * prev) / (1.0 + t10 * prev)
            else:
                fore[:k] = e[:k]
        for t in range(len(active) - 2, -1, -1):
            k, at = active[t + 1], base[t + 1]
            later = e[at : at + k] * back[at : at + k]
            back[base[t] : base[t] + k] = (t10 + t11 * later) / (1.0 + t01 * later)
        odds = fore * back
        return odds / (1.0 + odds), fore, back


def document_scores(model: Model, texts: list[str | None], memo: Potentials) -> list[tuple[float, int, list[dict]]]:
    """(score, predicted, spans) for each text; texts are scored in groups of about CHUNK_TOKENS tokens."""
    out: list = [None] * len(texts)
    group, held, size = [], [], 0
    order = sorted(range(len(texts)), key=lambda i: len(texts[i] or ""))  # texts of like length make full steps
    for i in order:
        group.append(i)
        held.append(TOKEN.findall(texts[i]) if texts[i] else [])
        size += len(held[-1])
        if size >= CHUNK_TOKENS or i == order[-1]:
            for k, r in zip(group, _score_group(model, [texts[k] for k in group], held, size, memo), strict=True):
                out[k] = r
            group, held, size = [], [], 0
    return out


def _score_group(model: Model, texts: list[str | None], tokens: list[list[str]], size: int, memo: Potentials) -> list[tuple[float, int, list[dict]]]:
    lengths = np.array([len(x) for x in tokens], np.int64)
    chains = Chains(lengths)
    psi = np.empty(size)
    flat = np.fromiter((memo[w] for x in tokens for w in x), np.float64, size)
    psi[chains.place] = flat
    p = chains.marginals(psi, model.trans)[0][chains.place]
    ends = np.cumsum(lengths)
    # summed text by text: equal texts get equal scores wherever they are
    expected = np.bincount(np.repeat(np.arange(len(texts)), lengths), p, len(texts))
    a, b = model.line
    score = 1.0 / (1.0 + np.exp(-np.clip(a + b * np.log(expected + 1e-6), -40, 40)))
    spans: list[list[dict]] = [[] for _ in texts]
    hot = np.flatnonzero(p >= 0.5)
    owner = np.searchsorted(ends, hot, "right")
    for d in np.unique(owner).tolist():
        first = int(ends[d] - lengths[d])
        marked = {int(x) - first for x in hot[owner == d]}
        run = None
        for k, m in enumerate(TOKEN.finditer(texts[d])):
            if k in marked and run is not None and run["k"] == k - 1:
                run |= {"end": m.end(), "k": k}
            elif k in marked:
                run = {"start": m.start(), "end": m.end(), "k": k}
                spans[d].append(run)
    return [(float(s), int(s >= 0.5), [{"start": r["start"], "end": r["end"]} for r in x]) for s, x in zip(score, spans, strict=True)]


def _distinct_samples(texts: list[str]) -> list[int]:
    """Leaves out samples that share one of three smallest 5-word hashes with an earlier one: near copies would count as evidence many times."""
    seen, out = set(), []
    for i, t in enumerate(texts):
        words = words_of(pa.array([t])).hashes
        g = gram_hashes(words, min(5, max(1, len(words))))
        keys = {(k, int((g * np.uint64(2 * k + 0x9E3779B97F4A7C15)).min())) for k in range(3)} if len(g) else {("", i)}
        if not keys & seen:
            out.append(i)
        seen |= keys
    return out


def fit(texts: list[str], labels: list[int], toxic_rate: float, model_features: int = MODEL_FEATURES) -> Model:
    """Fits the CRF and the score's line; toxic_rate is the share of toxic documents among all labelled ones."""
    keep = _distinct_samples(texts)
    texts, y = [texts[i] for i in keep], np.array([labels[i] for i in keep], np.int64)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    flat = Model({}, -12.0, (0.0, 0.0, 0.0), (math.log((toxic_rate + 1e-6) / (1 - toxic_rate + 1e-6)), 0.0))
    if not n1 or not n0:
        return flat
    words: dict[str, int] = {}
    ids = [np.array([words.setdefault(w, len(words)) for w in TOKEN.findall(t)], np.int32) for t in texts]
    flat_hashes = array.array("Q")
    for w in words:
        flat_hashes.extend(features(w))
    n_words = len(words)
    del words
    hashes = np.frombuffer(flat_hashes, np.uint64).reshape(n_words, -1)
    known, slots = np.unique(hashes, return_inverse=True)
    slots = slots.reshape(hashes.shape).astype(np.int32)
    in_docs = np.zeros((2, len(known)), np.int64)  # documents of each class that have a feature
    for label, own in zip(y.tolist(), ids, strict=True):
        in_docs[label, np.unique(slots[np.unique(own)])] += 1
    evidence = _evidence(in_docs[1].astype(float), in_docs[0].astype(float), n1, n0)
    evidence[known == 0] = 0.0
    strong = evidence >= max(5.0, min(EVIDENCE, 0.5 * float(evidence.max(initial=0.0))))
    if not strong.any():
        return flat
    suspicious = strong[slots].any(1)
    common = np.flatnonzero((in_docs.sum(0) >= 3) & (known != 0))
    number = np.full(len(known), len(common), np.int32)  # the last slot is no feature
    number[common] = np.arange(len(common))
    slots, known = number[slots], known[common]
    del hashes, number, flat_hashes, in_docs, evidence
    chains = Chains(np.array([len(x) for x in ids], np.int64))
    word_at = np.empty(len(chains.place), np.int64)
    word_at[chains.place] = np.concatenate(ids)
    gold = np.empty(len(chains.place), bool)
    gold[chains.place] = np.concatenate([suspicious[x] & bool(label) for x, label in zip(ids, y.tolist(), strict=True)])
    weights, bias, trans = _fit_crf(chains, word_at, gold, slots, len(known))
    top = np.argsort(-np.abs(weights))[:model_features]
    model = Model({int(known[i]): float(weights[i]) for i in top.tolist() if abs(weights[i]) > 0.01}, bias, trans, (0.0, 1.0))
    kept = np.append(np.where(np.isin(np.arange(len(known)), top) & (np.abs(weights) > 0.01), weights, 0.0), 0.0)
    p = chains.marginals(np.clip(kept[slots].sum(1) + bias, -30, 30)[word_at], trans)[0][chains.place]
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    total = np.concatenate([[0.0], np.cumsum(p)])
    x = np.log(np.maximum(total[cuts[1:]] - total[cuts[:-1]], 0.0) + 1e-6)
    weight = np.where(y == 1, toxic_rate / n1, (1 - toxic_rate) / n0) * len(y)
    model.line = _fit_line(x, y, weight)
    return model


def _evidence(n: np.ndarray, m: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Minus the log of the chance (a Chernoff bound) that n of the n + m documents with a feature are toxic by luck; 0 for
    features of under three toxic documents or without a large lift."""
    q, r = n1 / (n1 + n0), n / np.maximum(n + m, 1)
    lift = (n + 0.5) / (n1 + 1) >= LIFT * (m + 0.5) / (n0 + 1)
    part = np.where(m > 0, (1 - r) * np.log(np.maximum(1 - r, 1e-12) / (1 - q)), 0.0)
    bound = (n + m) * (r * np.log(np.maximum(r, 1e-12) / q) + part)
    return np.where((n >= 3) & (lift | (m == 0)) & (r > q), bound, 0.0)


def _pairs(chains: Chains, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all tokens that have a follower, and of those followers."""
    later = np.arange(chains.base[1] if len(chains.base) > 1 else 0, len(values))
    k = np.repeat(chains.active[:-1], chains.active[1:])
    return values[later - k], values[later]


def _fit_crf(chains: Chains, word_at: np.ndarray, gold: np.ndarray, slots: np.ndarray, n: int) -> tuple[np.ndarray, float, tuple[float, float, float]]:
    """Maximum likelihood with a ridge, by Adam over the whole sample."""
    rate = float(np.clip(gold.mean(), 1e-6, 0.5))
    theta = np.zeros(n + 4)
    theta[n] = math.log(rate / (1 - rate))
    a, b = _pairs(chains, gold)
    seen = np.array([np.count_nonzero(~a & b), np.count_nonzero(a & ~b), np.count_nonzero(a & b)], np.float64)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        unary = np.append(theta[:n], 0.0)[slots].sum(1) + theta[n]
        psi = np.clip(unary, -30, 30)[word_at]
        trans = tuple(theta[n + 1 :].tolist())
        p, fore, back = chains.marginals(psi, trans)
        fa, _ = _pairs(chains, fore)
        _, later = _pairs(chains, np.exp(psi) * back)
        t01, t10, t11 = np.exp(trans)
        w01, w10, w11 = t01 * later, t10 * fa, t11 * fa * later
        z = 1.0 + w01 + w10 + w11
        by_word = np.bincount(word_at, gold - p, len(slots))
        grad = np.empty_like(theta)
        grad[:n] = np.bincount(slots.ravel(), np.repeat(by_word, slots.shape[1]), n + 1)[:n] - RIDGE * theta[:n]
        grad[n] = by_word.sum()
        grad[n + 1 :] = seen - [(w01 / z).sum(), (w10 / z).sum(), (w11 / z).sum()] - RIDGE * theta[n + 1 :]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:n], float(theta[n]), tuple(theta[n + 1 :].tolist())


def _fit_line(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression with one variable, by Newton's method; the slope is not negative."""
    a, b = 0.0, 0.5
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a + b * x, -35, 35)))
        g = weight * (y - p)
        h = weight * p * (1 - p)
        g0, g1 = g.sum() - 0.01 * a, (g * x).sum() - 0.01 * b
        h0, h1, h2 = h.sum() + 0.01, (h * x).sum(), (h * x * x).sum() + 0.01
        det = h0 * h2 - h1 * h1
        a, b = a + float(np.clip((h2 * g0 - h1 * g1) / det, -2, 2)), max(0.0, b + float(np.clip((h0 * g1 - h1 * g0) / det, -1, 1)))
    return a, b


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, *, toxic_sample: int = TOXIC_SAMPLE, clean_sample: int = CLEAN_SAMPLE, sample_chars: int = SAMPLE_CHARS, model_features: int = MODEL_FEATURES
) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic. Held-out rows and null labels are left out. The sample is
    the labelled documents with the smallest digest of their id, up to the bounds. Of rows that repeat an id the smallest text
    counts, and the largest label. Without texts of both labels the model knows no feature and gives every text the labels' rate."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(labels["doc_id"])).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rate = known.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.0
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    sample = known.where("toxic > 0").orderBy(order, "doc_id").limit(toxic_sample).unionByName(known.where("toxic <= 0").orderBy(order, "doc_id").limit(clean_sample))
    # at most toxic_sample + clean_sample ids of 12 bytes, and as many rows after the grouping; the fit is one task, as its input is bounded
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where(F.col("text").isNotNull()).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    found = Scratch(docs.sparkSession, "toxicity").save(found, "sample")
    lengths = sorted(((r["k"], r["doc_id"], r["n"]) for r in found.select("doc_id", order.alias("k"), F.length("text").alias("n")).collect()))
    taken, room = [], sample_chars
    for _, doc_id, n in lengths:
        if n <= room:
            taken.append(doc_id)
            room -= n
    if not taken:
        return fit([], [], float(rate))
    chosen = docs.sparkSession.createDataFrame([(i,) for i in taken], found.select("doc_id").schema)
    rows = found.join(F.broadcast(chosen), "doc_id", "left_semi")

    def fit_task(part: pa.Table) -> pa.Table:
        part = part.sort_by("doc_id")
        model = fit(part.column("text").to_pylist(), [int(t > 0) for t in part.column("toxic").to_pylist()], float(rate), model_features)
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    return pickle.loads(rows.withColumn("all", F.lit(True)).groupBy("all").applyInArrow(trimmed(fit_task), "model binary").first()[0])


def score_texts(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text") -> DataFrame:
    """The columns, score, predicted and spans of every row. Null texts count as empty; equal texts have equal scores.

    Where one of the columns has the name of a result already, in whatever case, the result's name gets an underscore behind it.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(*columns, docs[text_col].alias(fresh(columns, "_scored")))
    results = [T.StructField(fresh(columns, f.name), f.dataType) for f in T.StructType.fromDDL(SCORE).fields]
    types = T.StructType([*docs.select(*columns).schema.fields, *results])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Potentials(shared.value)
        for batch in gathered(batches, SLICE_BYTES):
            found = document_scores(shared.value, batch.column(len(columns)).to_pylist(), memo)
            score, predicted, spans = zip(*found, strict=True)
            marks = [pa.array(score, pa.float64()), pa.array(predicted, pa.int32()), pa.array(spans, SPANS)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *marks], names=types.names)

    return out.mapInArrow(trimmed(run), types)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs with a score under 0.5, columns unchanged. Rows are filtered as Arrow batches, a slice at a time.

    Null and empty texts hold no token and stay, unless the model knows no feature and most labels are toxic. Every row is judged by itself:
    repeated rows stay or go together.
    """
    small_batches(docs.sparkSession)
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Potentials(shared.value)
        for batch in gathered(batches, SLICE_BYTES):
            scores = document_scores(shared.value, batch.column(place).to_pylist(), memo)
            yield batch.filter(pa.array([not predicted for _, predicted, _ in scores], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)


def op4_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_texts(docs.withColumn("held_out", held_out(docs["doc_id"])), model, ["doc_id", "held_out"])


QUERIES = {"op4_toxicity_crf": op4_toxicity_crf}
