"""Vector codes and centroid clusters against brute force in plain Python, token counts against the library."""

import hashlib
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from offerloom.llm import clusters, codes, tokencount
from offerloom.llm.common import Scratch

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(seed=5, n=400, dims=64):
    """Random vectors around a few centres, copies, a hot vector, nulls of all kinds, other lengths and repeated ids."""
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.5) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [c + r.gauss(0, 0.1) for c in centres[i % 6]], i % 5 if i % 9 else None) for i in range(n)]
    rows += [(i, rows[3][1], 1) for i in range(n, n + 90)]
    rows += [(7, rows[7][1], 2), (7, rows[8][1], 2), (None, rows[9][1], None), (n + 100, None, 1), (n + 101, rows[0][1][:-1] + [None], 1)]
    rows += [(n + 102, rows[0][1][:-1] + [math.nan], 1), (n + 103, rows[0][1][:-1] + [math.inf], 1), (n + 104, [0.5] * 32, 3), (n + 105, [], 3), (n + 106, rows[0][1][:-1] + [3e38], 1)]
    return rows


def whole(rows, scale, dims):
    """(usual, others): kept vectors as whole numbers; kept ones of another length or too large."""
    import numpy as np

    usual, others = [], []
    for i, v, label in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(scale * float(np.float32(x))) for x in v]
        (usual if len(v) == dims and max(map(abs, q)) < 1 << 27 else others).append((i, q, label))
    return usual, others


def floor_mean(parts):
    return [sum(c) // len(parts) for c in zip(*parts, strict=True)]


def gap(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def code_by_hand(rows, entries, rounds, parts=16, dims=64):
    usual, others = whole(rows, 256, dims)
    w = dims // parts
    start = sorted((i, q) for i, q, _ in usual if i is not None)[:entries]
    books = [[q[p * w : (p + 1) * w] for _, q in start] for p in range(parts)]

    def near(p, part):
        d = [gap(part, e) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, q, _ in usual:
                own[near(p, q[p * w : (p + 1) * w])[0]].append(q[p * w : (p + 1) * w])
            books[p] = [floor_mean(o) if o else e for o, e in zip(own, books[p], strict=True)]
    out, sums = [], {}
    for i, q, label in usual:
        best = [near(p, q[p * w : (p + 1) * w]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for e, _ in best), sum(d for _, d in best), label))
        sums[label] = sums.get(label, 0) + out[-1][2]
    out += [(i, None, None, label) for i, _, label in others]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums.get(label)) for i, c, e, label in out), key=str), digest


@pytest.mark.parametrize(("entries", "rounds"), [(16, 2), (64, 1)])
def test_codes(spark, entries, rounds):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(5).withColumn("CODE", F.lit("x")).withColumn("error", F.lit(1))
    coded, books = codes.vector_codes(df, Scratch(spark, "codes"), entries=entries, rounds=rounds)
    want, digest = code_by_hand(rows, entries, rounds)
    assert codes.digest(books) == digest
    got = sorted([(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in coded.collect()], key=str)
    assert got == want
    again, same = codes.vector_codes(df.repartition(2), Scratch(spark, "codes"), entries=entries, rounds=rounds)
    assert codes.digest(same) == digest and sorted([(r["vec_id"], r["code"]) for r in again.collect()], key=str) == [w[:2] for w in want]


def test_codes_stand_for_their_entries(spark):
    rows = [r for r in vectors(n=80) if r[0] is not None and r[0] < 80]
    coded, books = codes.vector_codes(spark.createDataFrame(rows, VECTORS), Scratch(spark, "codes"))
    got = coded.where("code IS NOT NULL").collect()
    exact = {(i, tuple(q)) for i, q, _ in whole(rows, 256, 64)[0]}
    for r, x in zip(got, codes.decode([r["code"] for r in got], books), strict=True):
        assert any(i == r["vec_id"] and gap(q, x.tolist()) == r["error"] for i, q in exact)


def test_codes_of_little(spark):
    empty, _ = codes.vector_codes(spark.createDataFrame([], VECTORS), Scratch(spark, "codes"))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label", "label_error"]
    odd, books = codes.vector_codes(spark.createDataFrame([(1, [0.5] * 5, 1), (2, [], None), (3, None, 1)], VECTORS), Scratch(spark, "codes"))
    assert sorted((r["vec_id"], r["code"], r["label_error"]) for r in odd.collect()) == [(1, None, None), (2, None, None)] and books.size == 0
    nobody, _ = codes.vector_codes(spark.createDataFrame([(None, [0.5] * 16, 1)], VECTORS), Scratch(spark, "codes"))
    assert [tuple(r) for r in nobody.collect()] == [(None, None, None, 1, None)]
    words, books = codes.vector_codes(spark.createDataFrame([("4", [1, -1] * 8, "b"), ("x", [0, 0] * 8, "b")], "vec_id string, embedding array<int>, label string"), Scratch(spark, "codes"), entries=2)
    assert sorted([tuple(r) for r in words.collect()], key=str) == [(i, "00" * 16, 16 * 128**2, "b", 32 * 128**2) for i in (4, None)]  # one entry, which comes to lie half-way
    with pytest.raises(ValueError, match="256"):
        codes.vector_codes(spark.createDataFrame([], VECTORS), Scratch(spark, "codes"), entries=257)


def cluster_by_hand(rows, k, rounds, dims=64):
    usual, others = whole([r for r in rows if r[1] is not None and len(r[1]) == dims], 1024, dims)
    keyed = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), q) for i, q, _ in usual if i is not None)
    centres = [q for _, q in keyed[:k]]

    def near(q):
        d = [gap(q, c) for c in centres]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = [[] for _ in centres]
        for _, q, _ in usual:
            own[near(q)[0]].append(q)
        centres = [floor_mean(o) if o else c for o, c in zip(own, centres, strict=True)]
    out = [(i, *near(q)) for i, q, _ in usual] + [(i, None, None) for i, _, _ in others]
    return sorted(out, key=str), centres, [sum(d for _, c, d in out if c == j) for j in range(len(centres))]


@pytest.mark.parametrize(("k", "rounds"), [(8, 10), (5, 3), (1, 2), (8, 0)])
def test_clusters(spark, k, rounds):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(5).withColumn("Cluster", F.lit("x"))
    out, info = clusters.centroid_clusters(df, Scratch(spark, "clusters"), k=k, rounds=rounds)
    want, centres, inertia = cluster_by_hand(rows, k, rounds)
    assert sorted([tuple(r) for r in out.collect()], key=str) == want
    assert info["centroids"].tolist() == centres and info["inertia"] == inertia
    n = info["vectors"]
    if rounds == 10:
        # the bounds skip most of what plain rounds work out
        assert len(info["spent"]) == 11 and sum(info["spent"]) < 0.5 * 11 * k * n
        assert min(info["spent"]) < n


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.lists(st.tuples(st.integers(-3, 3), st.integers(-3, 3)), min_size=1, max_size=30), st.randoms(use_true_random=False))
def test_bounds_keep_ties(k, points, r):
    """On a small grid ties are everywhere: every round has to give the first of the nearest centroids."""
    import numpy as np

    x = np.array(points, np.int64).T
    n = x.shape[1]
    cluster, upper, lower, before = np.zeros(n, np.int32), np.full(n, np.inf, np.float32), np.zeros((k, n), np.float32), None
    for _ in range(5):
        centroids = np.array([[r.randint(-3, 3), r.randint(-3, 3)] for _ in range(k)], np.int64) if before is None else np.clip(before + np.array([[r.randint(-1, 1), r.randint(-1, 1)] for _ in range(k)]), -4, 4)
        clusters.Elkan(centroids, before).assign(x, cluster, upper, lower)
        d = ((x.T[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        assert cluster.tolist() == d.argmin(axis=1).tolist()
        assert (upper.astype(float) >= np.sqrt(d[np.arange(n), cluster])).all() and (lower.T <= np.sqrt(d)).all()
        before = centroids


def test_clusters_of_little(spark):
    empty, info = clusters.centroid_clusters(spark.createDataFrame([], VECTORS), Scratch(spark, "clusters"))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance"] and len(info["centroids"]) == 0
    few, info = clusters.centroid_clusters(spark.createDataFrame([(1, [1.0] * 4, 0), (2, [2.0] * 4, 0), (3, [1.0], 0), (None, [2.0] * 4, 0)], VECTORS), Scratch(spark, "clusters"), dims=None)
    assert len(info["centroids"]) == 2 and {(r["vec_id"], r["distance"]) for r in few.collect()} == {(1, 0), (2, 0), (None, 0)}
    nobody, info = clusters.centroid_clusters(spark.createDataFrame([(None, [1.0] * 64, 0)], VECTORS), Scratch(spark, "clusters"))
    assert [tuple(r) for r in nobody.collect()] == [(None, None, None)]


# --- token counts ---

TEXTS = [
    None, "", " ", "  \n\n x", "it's we'll WE'LL 'tis ''s '", "a  b   c\t\td\n \n e  ", "x y z　  ", "café naïve 你好世界 \U0001f600\U0001f468‍\U0001f469 \U00010400\U0001d7d8",
    "12 345٣٤ ½Ⅷx", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>  <|endoftext|>\n", "<|endoftext|", "!!!...---===   ---", "\x00\x01\x85᠎﻿ \x1c\x1d a", "word " * 3000, "́́e 힣￿\U0010ffff",
]


def truth(text):
    return len(tokencount.library(tokencount.VOCABULARY).encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter(spark):
    t = tokencount.library(tokencount.VOCABULARY)
    proved = frozenset(r["token"] for r in tokencount.whole_tokens(spark, tokencount.VOCABULARY).collect())
    return tokencount.Counter(t, proved, tokencount.special_strings(tokencount.VOCABULARY), tokencount.code_point_classes(spark, tokencount.VOCABULARY))


def test_token_counts(spark):
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice(["the ", "qz", "'s", " \n", "é", "7", "--", "中", "<|endoftext|>"]) for _ in range(400)) for _ in range(20)]
    rows = [(i if i != 4 else None, t, "k") for i, t in enumerate(texts)] + [(0, "again", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_Tokens string").repartition(3)
    got = tokencount.token_counts(df, limit=100).collect()
    want = [(i, len((t or "").encode()), truth(t), truth(t) > 100) for i, t, _ in rows]
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got], key=str) == sorted(want, key=str)
    assert all(0 <= r["n_whole"] <= r["n_tokens"] for r in got)
    assert tokencount.token_counts(df.limit(0)).count() == 0


def test_whole_tokens_are_proved(counter):
    t = counter.t
    assert len(counter.whole) > 40_000
    assert all(len(t.encode(w, add_special_tokens=False).ids) == 1 for w in random.Random(1).sample(sorted(counter.whole), 500))
    assert "<|endoftext|>" not in counter.whole


def test_classes_are_the_librarys(counter):
    t, r = counter.t, random.Random(2)
    for p in [*range(0x250), *(r.randrange(0x110000) for _ in range(3000))]:
        if not 0xD800 <= p < 0xE000:
            for text in (f"a{chr(p)} {chr(p)}1", f"{chr(p)}{chr(p)}!"):
                assert counter.of(text)[0] == truth(text), hex(p)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(counter, text):
    assert counter.of(text)[0] == truth(text)


def test_long_texts_in_pieces(counter, monkeypatch):
    r = random.Random(4)
    monkeypatch.setattr(tokencount, "PIECE", 40)
    for _ in range(50):
        text = "".join(r.choice(["ab", " ", "  ", "\n", "!", "9", "é", "don't", " "]) for _ in range(300))
        assert counter.of(text)[0] == truth(text)
        assert "".join(counter.pieces(text)) == text and len(list(counter.pieces(text))) > 3


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tokencount.special_strings("word_bpe_49k.json")
