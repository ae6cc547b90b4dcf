"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from offerloom.llm import chat, decontamination, jaccard, media, mixing, packing, substrings, toxicity, urls, warc
from offerloom.llm.common import SPACES, Scratch, by_bytes, span_hashes, words_of

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    """Random texts, exact and near copies, shared passages, nulls, empties and one long text."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choices(vocab, k=70))
    texts = []
    for i in range(n):
        base = r.choices(vocab, k=r.randint(3, 140))
        if i % 7 == 3 and texts:
            base = (texts[r.randrange(len(texts))] or "a b").split()
            for _ in range(r.randint(0, 3)):
                base[r.randrange(len(base))] = r.choice(vocab)
        text = " ".join(base)
        if i % 9 == 4:
            text = text + "\n" + passage + "\t" + r.choice(vocab)
        texts.append(text)
    texts += [None, "", "   ", texts[0], texts[0].upper(), " ".join(r.choices(vocab, k=6000))]
    return [(i, t, "en", f"s{i % 4}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORDS.findall(text or "")


# --- substrings ---


def repeated(rows, w):
    first = {}
    for i, t, *_ in rows:
        ws = words(t)
        for s in range(len(ws) - w + 1):
            key = tuple(ws[s : s + w])
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, t, *_ in rows:
        ws = words(t)
        gone = {p for s in range(len(ws) - w + 1) if first[tuple(ws[s : s + w])] < i for p in range(s, s + w)}
        kept = " ".join(x for p, x in enumerate(ws) if p not in gone)
        out[i] = (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("w", "limit"), [(50, 4000), (25, 4000), (25, 1)])
def test_substrings(docs, w, limit):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.repeated_windows(docs, min_words=w, shard_segments=limit).collect()}
    assert got == repeated(corpus(), w)


def test_substrings_ids(spark, empty):
    text = " ".join(f"x{i}" for i in range(80))
    rows = [(None, text), (5, text), (5, text), (7, text)]
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substrings.repeated_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 0), (5, 0), (5, 0), (7, 80)]
    assert substrings.repeated_windows(empty).count() == 0


def test_fm_index_counts():
    r = np.random.default_rng(3)
    texts = [r.integers(1, 6, n) for n in (40, 17, 60, 5)]
    index = substrings.FMIndex(texts, 6, 8)
    for length in (1, 3, 8):
        for _ in range(50):
            t = texts[r.integers(0, 4)]
            if len(t) < length:
                continue
            s = r.integers(0, len(t) - length + 1)
            pattern = t[s : s + length]
            lo, hi = np.array([0]), np.array([index.rows])
            for c in pattern[::-1]:
                lo, hi = index.extend(np.array([c]), lo, hi)
            want = sum(list(x[k : k + length]) == list(pattern) for x in texts for k in range(len(x) - length + 1))
            assert hi[0] - lo[0] == want


@pytest.mark.parametrize("depth", [1, 5, 8])
def test_matching_statistics_of_foreign_texts(depth):
    """Texts that the index doesn't hold, with words it lacks, against a search of all places."""
    r = np.random.default_rng(5)
    texts = [r.integers(1, 5, n) for n in (40, 17, 60, 5, 1)]
    texts += [texts[0][3:30], texts[2][10:50]]
    numbers = np.array([7, 3, 9, 1, 4, 8, 2])
    index = substrings.FMIndex(texts, 6, depth, numbers)
    foreign = [np.where(r.random(n) < 0.1, -1, r.integers(1, 6, n)) for n in (50, 1, 33, 7)] + [np.concatenate([texts[2][5:40], texts[0][:9]]), np.empty(0, np.int64), texts[1]]
    lengths, least = index.matching_statistics(foreign)
    places = [(list(t[k : k + depth]), d) for t, d in zip(texts, numbers, strict=True) for k in range(len(t))]
    for f, got, docs_ in zip(foreign, lengths, least, strict=True):
        for i in range(len(f)):
            want = max((next((k for k in range(min(len(p), len(f) - i)) if p[k] != f[i + k]), min(len(p), len(f) - i)) for p, _ in places), default=0)
            assert got[i] == want
            assert docs_[i] == (min(d for p, d in places if p == list(f[i : i + depth])) if want == depth else -1)


@pytest.mark.parametrize("growth", [1, 2, 8, None])
def test_least_documents_against_brute_force(growth):
    """Three anchors with texts of their own: near copies, several of one document, long and short ones; most are streamed and never indexed."""
    r = np.random.default_rng(12)
    texts, docs, anchors = [], [], []
    for anchor in range(3):
        base = r.integers(1, 9, 60) + 10 * anchor
        for _ in range(30):
            t = base.copy()
            t[r.integers(0, 60, r.integers(0, 4))] = 10 * anchor + 9
            at = r.integers(0, 40)
            texts.append(t[at : at + r.integers(8, 60)] if r.random() < 0.7 else base[:30])
            texts[-1] = texts[-1] if len(texts[-1]) >= 8 else base[:8]
            docs.append(r.integers(-5, 40))
            anchors.append(anchor)
    got = substrings.least_documents(texts, np.array(docs), np.array(anchors), 40, 8, growth)
    first = {}
    for t, d in zip(texts, docs, strict=True):
        for k in range(len(t) - 7):
            first[tuple(t[k : k + 8])] = min(d, first.get(tuple(t[k : k + 8]), d))
    assert [x.tolist() for x in got] == [[first[tuple(t[k : k + 8])] for k in range(len(t) - 7)] for t in texts]


def test_matches_of_full_length_only():
    """The same full matches; a text is left where none fits into the rest of it."""
    r = np.random.default_rng(21)
    texts = [r.integers(1, 4, n) for n in (80, 33, 60)]
    index = substrings.FMIndex(texts, 5, 6, np.array([4, 1, 9]))
    foreign = [np.where(r.random(n) < 0.2, -1, r.integers(1, 5, n)) for n in (70, 5, 6, 41)] + [texts[1], np.array([3, -1, 1, 2, 1])]
    (lengths, least), (some, same) = index.matching_statistics(foreign), index.matching_statistics(foreign, full_only=True)
    assert [x.tolist() for x in same] == [x.tolist() for x in least]
    assert all(((a == 6) == (b == 6)).all() and (a >= b).all() for a, b in zip(lengths, some, strict=True)) and some[5].max() == 0


def test_texts_that_meet_no_other_are_not_searched(monkeypatch):
    """Of two texts of an anchor the first is indexed and the second streamed, once; what is left of the second has nothing more to meet."""
    indexed, asked = [], []

    class Counted(substrings.FMIndex):
        def __init__(self, texts, *args):
            indexed.append(len(texts))
            super().__init__(texts, *args)

        def matching_statistics(self, texts, **args):
            asked.append(len(texts))
            return super().matching_statistics(texts, **args)

    monkeypatch.setattr(substrings, "FMIndex", Counted)
    texts = [np.array(x) for x in ([1, 2, 3, 4], [1, 2, 3, 5], [6, 7, 8], [9, 10, 11, 1], [9, 10, 11, 2], [9, 10, 11, 2, 3])]
    got = substrings.least_documents(texts, np.array([5, 6, 1, 2, 3, 4]), np.array([0, 0, 1, 2, 2, 2]), 12, 3)
    assert [x.tolist() for x in got] == [[5, 5], [5, 6], [1], [2, 2], [2, 3], [2, 3, 4]]
    assert indexed == [3, 2] and asked == [3, 1]


# --- urls ---


def test_urls(spark):
    cases = {
        "http://A.Example.org/es/x?q": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/123#f": ("example.org", "/en/123", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "https://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"),
        "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "http://x.com/fr/a/de/": ("x.com", "/fr/a/de/", "com/fr/", "allow"),
        "http://com?x://y": ("com", "", None, "allow"),
        "no scheme.org/": ("", "", None, "allow"),
        "x://ÄB.org": ("Äb.org", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://" + "a." * 3000 + "org/" + "p" * 50000: ("a." * 3000 + "org", "/" + "p" * 50000, "org/", "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(cases)] + [(0, list(cases)[0], "x", "y")], "page_id long, url string, host string, verdict string")
    rules = spark.createDataFrame(urls.RULES, "rule_host string, rule_path string, verdict string")
    got = [(r["row"]["url"], (r["host"], r["path"], r["rule"], r["verdict"])) for r in urls.match_urls(pages, rules).collect()]
    assert len(got) == len(cases) + 1 and all(cases[u] == v for u, v in got)
    assert {r["verdict"] for r in urls.match_urls(pages, rules.where("false"), default="block").collect()} == {"block"}
    assert urls.match_urls(pages.where("false"), rules).count() == 0


def test_long_lists_of_urls(spark):
    """Two thousand rules of many lengths and depths of host: the longest that fits, as by trying all."""
    r = random.Random(8)
    host = lambda: ".".join(r.choices(["a", "b", "cc", "d"], k=r.randint(1, 4)))
    path = lambda n: "/" + "".join(r.choices("xy/", k=r.randint(0, n)))
    rules = {(host(), path(40)): r.choice(["allow", "block"]) for _ in range(1500)} | {(host(), path(3)): r.choice(["allow", "block"]) for _ in range(500)}
    pages = [(i, f"http://{h}{p}") for i, (h, p) in enumerate([(host(), path(50)) for _ in range(400)] + [(f"z.{h}", p + "y") for h, p in r.sample(sorted(rules), 300)])]
    listed = spark.createDataFrame([(*k, v) for k, v in rules.items()], "rule_host string, rule_path string, verdict string")
    got = urls.match_urls(spark.createDataFrame(pages, "page_id int, url string"), listed)

    def longest(url):
        h, _, p = url.removeprefix("http://").partition("/")
        fits = [(len(a + b), v, a + b) for (a, b), v in rules.items() if (h == a or h.endswith("." + a)) and f"/{p}".startswith(b)]
        return max(fits, default=(0, "allow", None))[1:]

    for row in got.collect():
        want = longest(row["row"]["url"])
        assert (row["verdict"], len(row["rule"] or "")) == (want[0], len(want[1] or ""))


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(5000).select(F.concat(F.lit("h"), "id", F.lit(".org")).alias("rule_host"), F.lit("/p").alias("rule_path"), F.lit("block").alias("verdict"))
    pages = spark.range(20000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit(".org/p/x")).alias("url"))
    got = urls.match_urls(pages, listed)
    assert got.where("verdict = 'block'").count() == 5000
    blocks = 5000 // urls.KEYS_PER_BLOCK + 1
    filled = urls.bloom_table(listed, blocks)
    block, (high, *bits) = urls._block_and_bits(F.col("h"), F.col("p"), blocks)
    probes = spark.range(100000, 140000).select(F.concat(F.lit("h"), "id", F.lit(".org")).alias("h"), F.lit("/p").alias("p")).withColumn("_block", block).withColumn("_high", high)
    hits = probes.join(filled, "_block")
    for i, b in enumerate(bits):
        hits = hits.where(F.col(f"_w{i}").bitwiseAND(b) != 0)
    assert hits.count() < 0.03 * 40000


# --- packing ---


def test_packing_loses_nothing(docs, empty):
    rows = packing.pack_tokens(docs, row_length=64, buffer_tokens=2000).collect()
    t = packing.tokens(packing.VOCABULARY)
    parts = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], t.dtype)
        assert len(ids) == 64 and r["cu_seqlens"][-1] == r["n_tokens"] and r["position_resets"] == r["cu_seqlens"][:-1]
        for d, k, o, a, b in zip(r["doc_ids"], r["pieces"], r["offsets"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            assert (d, k) not in parts and o == 64 * k
            parts[d, k] = ids[a:b]
    twice = packing.pack_tokens(docs.where("doc_id < 9").unionAll(docs.where("doc_id < 9")), row_length=64, buffer_tokens=2000).collect()
    found = [(d, c, k) for r in twice for d, c, k in zip(r["doc_ids"], r["copies"], r["pieces"], strict=True)]
    assert len(found) == len(set(found)) == 2 * sum(d < 9 for d, _ in parts) and len({(d, c) for d, c, _ in found}) == 18
    import tiktoken  # noqa: F401

    for i, text, *_ in corpus():
        own = np.concatenate([parts[i, k] for k in range(sum(d == i for d, _ in parts))]).tolist()
        assert own[-1] == t.end and own[:-1] == t.encode(text or "")
    assert sum(r["n_tokens"] for r in rows) / (64 * len(rows)) > 0.95
    assert packing.pack_tokens(empty).count() == 0


def test_tokens_of_hard_texts():
    t = packing.tokens(packing.VOCABULARY)
    for text in ["a b", " a", "a  b", "", "x \u00a0y", "tail ", "don't  stop", "<|endoftext|> é ü\t z", "a\n\n b"]:
        assert np.frombuffer(t.of(text), t.dtype).tolist() == [*t.encode(text), t.end]
        assert t.encoding.decode(t.encode(text)) == text


def test_best_fit_decreasing():
    r = random.Random(5)
    lengths = [r.randint(1, 40) for _ in range(300)] + [40, 40, 1]
    rows = packing.best_fit_decreasing(lengths, 40)
    assert sorted(i for row in rows for i in row) == list(range(len(lengths))) and all(sum(lengths[i] for i in row) <= 40 for row in rows)
    free, brute = [], 0
    for n in sorted(lengths, reverse=True):
        fits = [x for x in free if x >= n]
        best = min(fits) if fits else 40
        brute += not fits
        if fits:
            free.remove(best)
        free.append(best - n)
    assert len(rows) == brute
    assert packing.position_ids([0, 3, 5], 8).tolist() == [0, 1, 2, 0, 1, 0, 1, 2]


# --- toxicity ---


def test_forward_backward_against_enumeration():
    import itertools
    import math

    r = np.random.default_rng(1)
    lengths, trans = np.array([4, 1, 0, 3]), (0.3, -0.7, 0.9)
    psi = r.normal(size=8)
    chains = toxicity.Chains(lengths)
    side = np.empty(8)
    side[chains.place] = psi
    p = chains.marginals(side, trans)[0][chains.place]
    at = 0
    for n in lengths:
        total, ones = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(psi[at + i] * y[i] for i in range(n)) + sum({(0, 0): 0, (0, 1): trans[0], (1, 0): trans[1], (1, 1): trans[2]}[a] for a in itertools.pairwise(y)))
            total, ones = total + w, ones + w * np.array(y)
        assert np.allclose(p[at : at + n], ones / total)
        at += n


def test_toxicity_learns_and_marks(spark, empty):
    r = random.Random(2)
    vocab, bad = [f"w{i}" for i in range(3000)], ["grobian", "grobianer", "fiesling!"]
    rows, labels = [], []
    for i in range(400):
        ws, toxic = r.choices(vocab, k=r.randint(5, 80)), i % 5 == 0
        for _ in range(3 * toxic):
            ws.insert(r.randrange(len(ws)), r.choice(bad))
        rows.append((i, " ".join(ws), "x"))
        labels.append((i, int(toxic)))
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "w1 " * 30000 + "Grobian,", "x"), (1003, rows[1][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = toxicity.train(docs, spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int"))
    got = {x["doc_id"]: x for x in toxicity.score_texts(docs.select("doc_id", "text"), model, ["doc_id"]).collect()}
    mark = lambda i: (got[i]["score"], got[i]["predicted"], got[i]["spans"])
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == (i % 5 == 0) for i in held]) > 0.95
    for i in (0, 5, 10):
        assert {rows[i][1][s["start"] : s["end"]].split()[0].strip("!") for s in got[i]["spans"]} <= {"grobian", "grobianer", "fiesling"} and got[i]["spans"]
    assert mark(1000) == mark(1001) and got[1000]["predicted"] == 0 and got[1002]["predicted"] == 1 and mark(1003) == mark(1)
    clean = toxicity.keep_clean(docs.unionAll(docs.where("doc_id IN (1, 5)")), model)
    assert clean.columns == docs.columns
    assert sorted(x["doc_id"] for x in clean.collect()) == sorted([i for i in got if not got[i]["predicted"]] + [1])
    assert toxicity.keep_clean(empty, model).count() == 0
    flat = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_texts(docs, flat, ["doc_id"]).where("predicted = 1").count() == 0
    assert toxicity.score_texts(empty, model, ["doc_id"]).count() == 0
    few = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), toxic_sample=20, clean_sample=30, sample_chars=5000, model_features=4)
    assert len(few.weights) <= 4


def test_scores_beside_columns_of_their_names(spark):
    model = toxicity.fit(["you awful thing", "a fine day"] * 4, [1, 0] * 4, 0.5)
    df = spark.createDataFrame([(1, "you awful thing", 7.0, "s"), (2, None, 8.0, "t")], "doc_id long, text string, Score double, _scored string")
    out = toxicity.score_texts(df, model, ["doc_id", "Score", "_scored"])
    assert out.columns == ["doc_id", "Score", "_scored", "score_", "predicted", "spans"]
    assert [(r["Score"], r["_scored"], 0 <= r["score_"] <= 1) for r in out.orderBy("doc_id").collect()] == [(7.0, "s", True), (8.0, "t", True)]


def test_document_scores_against_enumeration():
    """The score is the logistic line over the log of the expected number of toxic tokens, here by all labellings of a text."""
    import itertools
    import math

    words_ = ["ab", "Cd!", "efg"]
    weights = {toxicity.features(w)[0]: x for w, x in zip(words_, (2.0, -1.0, 0.5), strict=True)}
    model = toxicity.Model(weights, -0.4, (0.3, -0.7, 0.9), (0.2, 1.3))
    for text in ["ab", "ab Cd! efg", "efg  efg\nab unknown", ""]:
        ws, total, expected = text.split(), 0.0, 0.0
        psi = [weights.get(toxicity.features(w)[0], 0.0) + model.bias for w in ws]
        for y in itertools.product((0, 1), repeat=len(ws)):
            w = math.exp(sum(p * v for p, v in zip(psi, y, strict=True)) + sum({(0, 0): 0, (0, 1): 0.3, (1, 0): -0.7, (1, 1): 0.9}[a] for a in itertools.pairwise(y)))
            total, expected = total + w, expected + w * sum(y)
        want = 1 / (1 + math.exp(-(0.2 + 1.3 * math.log(expected / total + 1e-6))))
        (score, predicted, _), _ = toxicity.document_scores(model, [text, "ab"], toxicity.Potentials(model))
        assert abs(score - want) < 1e-9 and predicted == (want >= 0.5)


# --- decontamination ---


def test_decontamination(spark, empty):
    item = "A farmer called Anna Berg sells 12 kg of green apples to her old friend Paul for 30 euros every second week of the year."
    renamed = item.replace("Anna", "Maria").replace("Berg", "Stone").replace("12 kg", "45 lb").replace("Paul", "Tom").replace("30", "77")
    mixed = item.replace("sells 12", "sells 45")
    items = spark.createDataFrame([(1, item, "c"), (2, None, "c"), (3, "...", "c"), (4, "", "c")], "item_id long, text string, gram string")
    noise = " ".join(f"word{i}" for i in range(200))
    texts = [item, noise + " " + item.upper().lower().replace("anna berg", "Anna Berg").replace("paul", "Paul") + " " + noise, renamed, mixed, noise, None, "", "7 8 9 1 2 3 4 5 6 7 8", item[:40], renamed.replace("Tom", "Tim", 1), noise * 50]
    docs = spark.createDataFrame([(i, t, "z", "q") for i, t in enumerate([*texts, item])] + [(0, item, "z", "q")], "doc_id long, text string, grams string, at string")
    got = decontamination.find_items(docs, items).collect()
    assert sorted({(r["doc_id"], r["item_id"]) for r in got}) == [(i, 1) for i in (0, 1, 2, 3, 9, 11)]
    left = decontamination.remove_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [4, 5, 6, 7, 8, 10]
    assert decontamination.find_items(empty, items).count() == 0 and decontamination.find_items(docs, items.where("false")).count() == 0


def test_short_items_and_items_of_numbers(spark):
    """Short questions are found with other values if they hold three literal words; lists of numbers, and two words, only verbatim."""
    questions = {1: "Compute 3 + 4", 2: "What is 15% of 80 kg?", 3: "7 8 9 1 2 3 4 5 6 7 8", 4: "too short", 5: "Add 4 and 9 and 12 and 7 and 30 and 8 and 1", 6: "7 8 9 1 2 3 4 5 6 7 9 10 11"}
    noise = "nothing of this kind is written here at all my friend"
    texts = {
        0: noise, 1: f"{noise}. Compute 3 + 4 {noise}", 2: "Compute 5 + 9", 3: f"{noise} what is 22% of 31 lb {noise}", 4: "and 7 8 9 1 2 3 4 5 6 7 8 then", 5: "7 8 9 1 2 3 4 5 6 7", 6: f"{noise} too short {noise}",
        7: "too many short", 8: "Add 5 and 2 and 33 and 6 and 41 and 3 and 2", 9: "Add 5 and 2 and 33 and 6 and 41 and 3 or 2", 10: "what is 22% of 31", 11: "too", 12: "3 5 7 11 13 17 19 23 29 31 37 41 43",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame(list(questions.items()), "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontamination.find_items(docs, items).collect())
    assert got == [(1, 1), (3, 2), (4, 3), (6, 4), (8, 5)]


def test_recall_of_questions_with_other_values(spark):
    """Benchmark items with all numbers and names replaced, between words of other documents: at least nine of ten are found, and no other text."""
    sf = "/root/testdata/sf0.001"
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    other = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").where("text IS NOT NULL").orderBy("doc_id").limit(3).collect()]

    def renewed(text):
        out = []
        for i, w in enumerate(text.split()):
            if w[0].isdigit():
                w = re.sub(r"\d+", lambda m: str(int(m[0]) + 13), w)
            elif i and w[0].isupper() and out[-1][-1] not in ".!?:|":
                w = "Q" + w[1:]
            out.append(w)
        return " ".join(out)

    rows = [(r["item_id"], f"{' '.join(other[0].split()[:40])} ok. {renewed(r['text'])} so it goes {' '.join(other[1].split()[:30])}") for r in items.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_items(docs, items).collect()}
    assert sum((i, i) in got for i, _ in rows) >= 0.9 * len(rows)
    clash = docs.withColumns({"_key": F.lit(1), "_id": F.lit(2), "row": F.lit(3), "found_id": F.lit(4), "row_id": F.lit(5)})
    left = decontamination.remove_contaminated(clash, items)
    assert left.columns == clash.columns and left.count() == len(rows) - len({d for d, _ in got})


def test_slots_have_to_be_consistent(spark):
    twice = "the price of 5 big boxes is shown and then 5 big boxes are sold again today"
    items = spark.createDataFrame([(1, twice)], "item_id long, text string")
    docs = spark.createDataFrame([(1, twice.replace("5", "8")), (2, twice.replace("5", "8", 1))], "doc_id long, text string")
    assert [r["doc_id"] for r in decontamination.find_items(docs, items).collect()] == [1]


# --- WARC ---


def test_warc_round_trip(spark, empty):
    big = "é" * 400_000
    rows = [(3, "http://a/", "same"), (1, "http://b/ x\n", "same"), (2, None, None), (4, "u", ""), (5, "u", big), (5, "u", big), (None, "n", "same"), (6, "u", "other")]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    bundles = warc.write_bundles(pages).collect()
    got = sorted((r["page_id"] or -1, r["payload_bytes"], r["record_type"], r["refers_to"], r["payload_digest"]) for r in warc.read_bundles(spark.createDataFrame(bundles, warc.BUNDLE)).collect())
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = [(-1, 4, "revisit", 1, sha("same")), (1, 4, "response", None, sha("same")), (2, 0, "response", None, sha("")), (3, 4, "revisit", 1, sha("same")), (4, 0, "revisit", 2, sha("")), (5, 800_000, "response", None, sha(big)), (5, 800_000, "response", None, sha(big)), (6, 5, "response", None, sha("other"))]
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want] and [x[3] for x in got] == [x[3] for x in want]
    import zstandard

    data = bundles[0]["bytes"]
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == bundles[0]["n_records"]  # any reader skips the seek table
    entry = bundles[0]["index"][-1]
    at, size, full = warc.read_seek_table(data)[entry["frame"]]
    frame = zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=full)
    assert warc.parse_record(frame, entry["offset"])[0]["warc-record-id"] == entry["record_id"]
    assert warc.write_bundles(empty.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))).count() == 0


# --- mixing ---


def test_targets(spark):
    totals = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 50), (None, 10)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(totals, (5.0, 2.0, 1.0), 1.5, 2.0).collect()}
    sizes, weights = {"a": 100, "b": 1000, "c": 50, None: 10}, {"a": 5, "b": 2, "c": 1, None: 5}
    left, free, want = 1.5 * 1160, dict(weights), {}
    while True:
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
            del free[s]
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix(spark, docs, empty):
    mixed = mixing.mix_sources(docs)
    rows = mixed.collect()
    assert mixed.columns[: len(docs.columns)] == docs.columns and len(rows) == docs.count()
    by = {}
    for r in rows:
        assert r["mix_size"] == len(words(r["text"])) and 0 <= r["mix_copies"] <= 2
        by.setdefault(r["source"], []).append(r)
    for group in by.values():
        taken = sum(r["mix_copies"] * r["mix_size"] for r in group)
        assert abs(taken - group[0]["mix_target"]) <= max(r["mix_size"] for r in group) / 2 + 1
    again = mixing.mix_sources(docs.repartition(9)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    out = mixing.mixed_rows(docs.withColumn("mix_copies", F.lit("x")).withColumn("_copy", F.lit(1)))
    assert out.count() == sum(r["mix_copies"] for r in rows) and out.columns == [*docs.columns, "mix_copies", "_copy"]
    clash = mixing.mix_sources(docs.withColumn("MIX_SIZE", F.lit(1)))
    assert clash.columns[-4:] == ["mix_size_", "mix_source_size", "mix_target", "mix_copies"] and clash.count() == len(rows)
    assert mixing.mix_sources(empty).count() == 0


def test_inclusion_follows_the_weights(spark):
    """Over many seeds documents are taken as often as their weights say, at the limit too, and every sample has the target's size."""
    r = random.Random(6)
    rows = [(i, " ".join(["w"] * r.choice([1, 2, 4])), "s", w) for i, w in enumerate([1, 1, 2, 3, 5, 9, 40, None] * 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, w int")
    size = [len(t.split()) for _, t, *_ in rows]
    w = [x or 1 for *_, x in rows]
    target, rate = 0.9 * sum(size), 0.0
    for cut in sorted(set(w), reverse=True):
        rate = (target - sum(2 * s for s, x in zip(size, w, strict=True) if x > cut)) / sum(x * s for s, x in zip(size, w, strict=True) if x <= cut)
        if rate * cut <= 2:
            break
    taken, seeds = np.zeros(len(rows)), 10
    for seed in range(seeds):
        got = sorted(mixing.mix_sources(docs, share=0.9, seed=seed, propensity=F.col("w"), keep=["doc_id"]).select("doc_id", "mix_copies").collect())
        copies = np.array([c for _, c in got])
        assert abs((copies * size).sum() - target) <= 2 and copies.max() <= 2
        taken += copies
    for x in set(w):
        same = [i for i, y in enumerate(w) if y == x]
        want = min(2.0, rate * x)
        assert abs(taken[same].sum() / seeds / len(same) - want) < 0.1 + 0.1 * want


# --- media ---


def test_media(spark, docs, empty):
    back = {}
    lists, stored, chunks = media.store_media(docs, Scratch(spark, "t"))
    for r in lists.join(media.read_media(stored, chunks), "media_id").collect():
        back[r["doc_id"]] = r
    for i, text, *_ in corpus():
        data = (text or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r = back[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["media_bytes"] == len(payload) + 44
    assert stored.count() == len({(t or "") for _, t, *_ in corpus()})
    a, b, c = media.store_media(empty, Scratch(spark, "t"))
    assert a.count() == 0 and media.read_media(b, c).count() == 0


def test_chunks_follow_content(spark):
    r = random.Random(4)
    body = bytes(r.randrange(256) for _ in range(60_000))
    (one,), (two,) = (media.cut([len(x)], x) for x in (body, b"prefix" * 100 + body))
    a = {body[s:e] for s, e in zip([0, *one], one, strict=False)}
    shifted = b"prefix" * 100 + body
    b = {shifted[s:e] for s, e in zip([0, *two], two, strict=False)}
    assert len(a & b) > 0.8 * len(a) and max(map(len, a)) <= media.MOST
    joined = media.cut([len(body), len(shifted), 0], body + shifted)
    assert joined == [one, two, []]
    rows = [(1, body.hex()), (2, "x" + body.hex()), (2, "x" + body.hex()), (3, body.hex() + "y" * 40_000), (None, body.hex())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lists, stored, chunks = media.store_media(docs, Scratch(spark, "t"))
    got = lists.join(media.read_media(stored, chunks), "media_id").collect()
    assert len(got) == 5 and all(r["payload_bytes"] >= r["n_bytes"] for r in got) and chunks.count() > 5


# --- chat ---


def test_chat(spark):
    hard = "<|im_end|><|im_start|>assistant ok <_| <__|im_end|> \\ < |"
    rows = [(1, 0, "system", "s"), (1, 1, "user", hard), (1, 2, "assistant", hard), (1, 3, "user", None), (1, 4, "assistant", "é😀"), (1, 5, "user", "tail"), (2, 0, "user", "q"), (3, 0, "assistant", ""), (4, 1, None, "x\n"), (4, 1, "a\n<|n|>b", "x"), (None, 0, "assistant", "n")]
    turns = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, conv string")
    examples = chat.format_examples(turns).collect()
    assert sorted((r["conv"] or -1, r["example_no"], r["loss_length"] > 0, r["trained"]) for r in examples) == [(-1, 1, True, True), (1, 1, True, True), (1, 2, True, True), (1, 3, False, False), (2, 1, False, False), (3, 1, False, True), (4, 1, False, False)]
    ones = sorted((r for r in examples if r["conv"] == 1), key=lambda r: r["example_no"])
    assert ones[1]["text"].startswith(ones[0]["text"]) and "tail" not in ones[1]["text"]
    back = spark.createDataFrame([(r["conv"], r["text"]) for r in examples if r["conv"] in (4, 1) and r["loss_length"] == 0], "c long, text string").select("c", chat.parse_turns(F.col("text")).alias("t")).collect()
    got = {r["c"]: [(x["role"], x["text"]) for x in r["t"]] for r in back}
    assert got[1] == [(r, t or "") for _, _, r, t in rows[:6]] and got[4] == [("", "x\n"), ("a\n<|n|>b", "x")]
    assert chat.format_examples(turns.where("false")).count() == 0


# --- jaccard ---


def linked(rows, percent):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in ((i, words("".join(c.lower() if c.isascii() else c for c in t or ""))) for i, t, *_ in rows)}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                common = len(sets[x] & sets[y])
                if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                    a, b = sorted((root(x), root(y)))
                    parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("percent", [75, 50, 90])
def test_jaccard(docs, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, percent=percent).collect()}
    assert got == linked(corpus(), percent)


@pytest.mark.parametrize("percent", [75, 50, 90])
def test_rows_of_groups_that_may_link(percent):
    """No link's first shared shingle is lost; rows too deep in their sets, or of sizes too far apart, go."""
    r, sets = np.random.default_rng(percent), []
    for _ in range(40):
        base = np.sort(r.choice(3000, r.integers(5, 60), replace=False))
        sets += [np.unique(np.append(base[r.random(len(base)) < 0.98], r.integers(0, 3000, r.integers(0, 3)))) for _ in range(4)]
    rows = sorted((int(x), len(s), i, d) for d, s in enumerate(sets) for i, x in enumerate(s[: len(s) - -(-percent * len(s) // 100) + 1]))
    shingle, n, pos, doc = (np.array(x) for x in zip(*rows, strict=True))
    size = np.bincount(shingle)[shingle]
    shingle, n, pos, doc = (x[size > 1] for x in (shingle, n, pos, doc))
    keep = jaccard.linkable(shingle, n, pos, np.ones(len(n), bool), percent)
    kept = set(zip(shingle[keep].tolist(), doc[keep].tolist(), strict=True))
    found = 0
    for a, b in itertools.combinations(range(len(sets)), 2):
        if share(sets[a], sets[b], percent):
            first = int(np.intersect1d(sets[a], sets[b])[0])
            assert {(first, a), (first, b)} <= kept
            found += 1
    assert found > 5 and 0 < keep.sum() < 0.9 * len(keep)
    assert jaccard.linkable(shingle, n, pos, np.zeros(len(n), bool), percent).all()


def test_groups_without_rows_that_cannot_link():
    """Two sets of 100 that share a shingle no sooner than at place 20: at most 80 shingles, where 86 are needed."""
    arrays = [np.array(x, t) for x, t in zip(([5, 5, 6, 6, 7, 7], [1, 2, 1, 2, 1, 3], [100, 100, 100, 100, 100, 60], [20, 22, 3, 9, 1, 1]), jaccard.FIELDS, strict=True)]
    got = jaccard._groups(75)(pa.table({"bucket": [0], "rows": [jaccard._packed(tuple(arrays), 0, None)]}))
    assert got.column("shingle").to_pylist() == [6, 6] and sorted(got.column("doc_id").to_pylist()) == [1, 2]


def test_jaccard_with_tiny_limits(spark, monkeypatch):
    """Cells, trees, batches and groups of a few sets each, most shingles hot: the same components."""
    r = random.Random(8)
    vocab = [f"v{i}" for i in range(300)]
    base, rows = r.choices(vocab, k=120), []
    for i in range(70):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, " ".join(w), "en", "s", 0))
    for name, value in (("CELL", 9), ("CELL_SHINGLES", 900), ("TREE_SHINGLES", 500), ("STEP", 40), ("HEAD_KEYS", 3), ("HOT", 3), ("LOCAL_HOT", 2), ("FLUSH", 400)):
        monkeypatch.setattr(jaccard, name, value)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == linked(rows, 75)


def test_jaccard_ids(spark, empty):
    rows = [(7, "a b c d e f g"), (7, "a b c d e f g"), (3, "A B C D E F G"), (None, "a b c d e f g"), (9, "x"), (10, "X"), (11, "x y"), (12, None)]
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 3, None), (3, 3, 3), (7, 3, 3), (7, 3, 3), (9, 1, 9), (10, 1, 9), (11, 1, 11), (12, 0, 12)]
    assert jaccard.jaccard_components(empty).count() == 0


def share(a, b, percent):
    return 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))


def rooted(sets, known, roots, labels):
    n = np.array([len(s) for s in sets], np.int64)
    return jaccard.Sets(roots, [s[:k] for s, k in zip(sets, known, strict=True)], n, n.copy(), labels)


@pytest.mark.parametrize("step", [1, 1_000_000])
def test_prefix_tree_against_brute_force(monkeypatch, step):
    """Whole sets: the linked pairs of equal roots and other labels, no more. Probes of any number at once."""
    monkeypatch.setattr(jaccard, "STEP", step)
    r = np.random.default_rng(7)
    sets = [np.unique(r.integers(0, 60, n).astype(np.uint32)) for n in r.integers(1, 50, 200)]
    sets += [sets[3], sets[3][:-1], sets[4][1:]]
    roots, labels = r.integers(0, 3, len(sets)) * 7, r.integers(0, 60, len(sets))
    all_ = rooted(sets, [len(s) for s in sets], roots, labels)
    p, q = jaccard.PrefixTree(all_).linked(all_, 0, 60)
    want = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if roots[i] == roots[j] and labels[i] != labels[j] and share(a, b, 60)]
    assert want and sorted(zip(p.tolist(), q.tolist(), strict=True)) == want


def test_prefix_tree_of_heads_loses_no_link():
    """Heads and keys that became alike: every linked pair is let through, and none of sets that have little in common."""
    r = np.random.default_rng(5)
    base = [np.sort(r.choice(5000, 60, replace=False)) for _ in range(12)]
    sets = []
    for i in range(150):
        s = base[i % 12].copy()
        s[r.integers(0, 60, i % 25)] = r.integers(0, 5000, i % 25)
        sets.append(np.unique(s).astype(np.uint32))
    known, one, ids = [len(s) - -(-75 * len(s) // 100) + 1 for s in sets], np.zeros(len(sets), np.int64), np.arange(len(sets))
    want = {(i, j) for i in ids for j in ids if i != j and share(sets[i], sets[j], 75)}
    for shift in (0, 3):
        all_ = rooted([s >> np.uint32(shift) for s in sets], known, one, ids)
        got = set(zip(*(x.tolist() for x in jaccard.PrefixTree(all_).linked(all_, 0, 75)), strict=True))
        assert want <= got and (shift or all(i % 12 == j % 12 for i, j in got))


def test_prefix_tree_shares_what_near_copies_share():
    """A planted group: one tree, in which the common beginning of the sets is there once."""
    r = np.random.default_rng(4)
    base = np.sort(r.choice(1 << 30, 400, replace=False)).astype(np.uint32)
    sets = [np.sort(np.append(np.delete(base, r.integers(0, 400)), np.uint32(r.integers(0, 1 << 30)))) for _ in range(60)]
    all_ = rooted(sets, [len(s) for s in sets], np.zeros(60, np.int64), np.arange(60))
    tree = jaccard.PrefixTree(all_)
    assert len(tree.elements) < 0.8 * sum(map(len, sets)) and len(tree.linked(all_, 0, 75)[0]) == 60 * 59


def test_overlap_bound_holds(monkeypatch):
    monkeypatch.setattr(jaccard, "MAP_BYTES", 2000)
    r = np.random.default_rng(9)
    sets = list(jaccard.shingle_sets(pa.array([" ".join(map(str, r.integers(0, 9, n))) for n in r.integers(2, 4000, 40)]), 4))
    p, q = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40)))
    bounds = jaccard.overlap_bounds(np.array([len(s) for s in sets]), [jaccard.bitmap(s) for s in sets], p, q)
    assert all(b >= len(np.intersect1d(sets[i], sets[j])) for b, i, j in zip(bounds, p, q, strict=True))


def test_order_puts_common_shingles_last():
    r = np.random.default_rng(2)
    hashes = r.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2)
    names = (hashes[:20] >> np.uint64(16)).astype(np.int64)
    order = jaccard.Order(names, np.arange(65, 65 + 2000 * 20, 2000))
    keys = order.keys(hashes)
    assert len(set(keys.tolist())) == 500 and keys[:20].min() > keys[20:].max() and keys[19] > keys[0]
    assert (np.argsort(keys[20:]) == np.argsort(hashes[20:])).all()


def test_jaccard_ids_with_several_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    near = two.replace("b29", "b99")
    rows = [(5, one), (5, two), (2, one), (7, near), (8, "c d e"), (3, two), (3, "c d e"), (9, "lone"), (9, "")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(2, 26, 2), (3, 1, 2), (3, 26, 2), (5, 26, 2), (5, 26, 2), (7, 26, 2), (8, 1, 2), (9, 0, 9), (9, 1, 9)]


# --- words ---


def test_words_of_texts():
    texts = ["a b  c\n", "", None, "  x", "abc", "é\u00a0ü\tabc", " ", "A bC", "x" * 3_000_000 + " y", "\x1c\x85"]
    for batch in by_bytes([pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])], size=9):
        w = words_of(batch.column(1))
        found = [[bytes(w.data[s:e]) for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)] for a, b in zip(w.first, w.first[1:], strict=False)]
        assert found == [[x.encode() for x in words(t)] for t in batch.column(1).to_pylist()]
    w = words_of(pa.array(texts))
    names = {bytes(w.data[s:e]): h for s, e, h in zip(w.starts, w.ends, w.hashes, strict=True)}
    assert len(set(names.values())) == len(names) and all(names[bytes(w.data[s:e])] == h for s, e, h in zip(w.starts, w.ends, w.hashes, strict=True))
    assert (words_of(pa.array(["A bC x1"]), fold=True).hashes == words_of(pa.array(["a Bc X1"]), fold=True).hashes).all()
    assert not SPACES[0x1C] and len(span_hashes(w.data, w.starts[:0], w.ends[:0])) == 0
