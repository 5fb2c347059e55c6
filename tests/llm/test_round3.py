"""Toxicity filters, centroid heaps and the conversation trie beside brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import centroids, toxic, turns

VECTORS = "vec_id long, embedding array<double>, label int, cluster int, `id` string"


def lloyd(rows, k, rounds, dimension, scale):
    """Plain k-means in Python integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(centres)), key=lambda c: (square(v, centres[c]), c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)].append(v)
        centres = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else centres[c]
                   for c in range(len(centres))]
    found = [(i, nearest(v), square(v, centres[nearest(v)])) for i, v in kept]
    inertia = defaultdict(int)
    for _, c, d in found:
        inertia[c] += d
    key = lambda c: hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), key(c)) for i, c, d in found), key=str)


@pytest.mark.parametrize("seed,spread", [(1, 1.0), (2, 0.01), (3, 9000.0)])
def test_centroid_clusters(spark, seed, spread):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1, 0, 1]) * spread + rng.random() * 0.2 * spread for _ in range(4)]) for i in range(300)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (7, [0.0] * 4), (None, [0.5] * 4)] + [(i, [spread, 0.0, -spread, 0.0]) for i in range(400, 440)]
    rows += [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 0.0, 0.0]), (904, [float("nan")] * 4), (905, [float("inf")] + [0.0] * 3)]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], VECTORS).repartition(5)
    got = centroids.centroid_clusters(df, k=5, rounds=6, dimension=4).collect()
    assert sorted((tuple(r) for r in got), key=str) == lloyd(rows, 5, 6, 4, 1024)


def test_centroid_clusters_few_rows(spark):
    assert centroids.centroid_clusters(spark.createDataFrame([], VECTORS)).collect() == []
    rows = [(i, [float(i)] * 4) for i in range(3)]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], VECTORS)
    got = centroids.centroid_clusters(df, dimension=4).collect()
    assert sorted((tuple(r) for r in got), key=str) == lloyd(rows, 8, 10, 4, 1024)
    huge = spark.createDataFrame([(1, [1e30] * 4, 1, 2, "x")], VECTORS)
    with pytest.raises(Exception, match="no long holds"):
        centroids.centroid_clusters(huge, dimension=4).collect()


def test_heaps_pop_only_used_up_gaps():
    heaps = centroids._Heaps(2)
    for row, key in enumerate([5.0, 1.0, 3.0, 1.0]):
        heaps.push(0, key, row)
    heaps.push(1, 0.5, 9)
    again = centroids._Heaps(2, *heaps.flat())
    assert again.expired([1.0, 0.1]) == [1, 3] and again.expired([1.0, 0.5]) == [9] and again.expired([2.9, 0.5]) == []


def trie(rows):
    """The nodes by lists of turns in a dictionary."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns_ = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in turns_.items():
        h = zlib.crc32(str(c).encode()) % 6
        s = turns_.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    out = []
    for node, some in members.items():
        below = [v for v in members if v[:len(node)] == node]
        leaf = lambda v: not any(len(w) == len(v) + 1 and w[:len(v)] == v for w in members)
        text = ",".join(map(str, sorted(ends.get(node, []))))
        out.append((min(some), len(node), min(members[node[:-1]]) if node else None, len(some),
                    sum(len(v) == len(node) + 1 for v in below), sum(map(leaf, below)),
                    sum((len(members[v]) - 1) * len(v[-1][1]) for v in below if v), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in list(range(0, 40)) + [100, 101, 103, 150, 199, 305, 306, 307, 1100, 1105]:
        same = rng.random() < 0.5
        for t in range(rng.randint(1, 8)):
            rows.append((c, t, rng.choice(["user", "user", None]) if not same else "user",
                         None if rng.random() < 0.1 else "ab"[rng.randint(0, 1)] * rng.randint(1, 2) if not same else f"turn {t}"))
    rows += [(39, None, "system", "first"), (39, None, "user", ""), (0, 3, "user", "tie"), (0, 3, "assistant", "tie"),
             (None, 1, "user", "lost"), (20, 2, "user", "twice"), (20, 2, "user", "twice")]
    rows += [(150, 10 + t, "user", "long") for t in range(40)] + [(151, 10 + t, "user", "long") for t in range(35)]
    return rows


@pytest.mark.parametrize("seed,chunk", [(1, 4096), (2, 3)])
def test_conversation_trie(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(turns, "CHUNK", chunk)
    rows = conversations(seed)
    df = spark.createDataFrame([(*r, 1, "k", "m") for r in rows],
                               "conv_id long, turn long, role string, text string, depth int, k1 string, conv string").repartition(7)
    got = turns.conversation_trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == trie(rows)


def test_conversation_trie_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert turns.conversation_trie(spark.createDataFrame([], schema)).collect() == []
    one = [(101, 0, "user", "x" * 200_000)]  # its opening comes from a conversation that is not there
    assert sorted((tuple(r) for r in turns.conversation_trie(spark.createDataFrame(one, schema)).collect()), key=str) == trie(one)


def test_end_lists_in_pieces():
    many = list(range(0, 5000, 2))
    rows = [(2, 1, 1, 1, 1, c) for c in many] + [(3, 1, 1, 1, 1, 7)]
    names = ["m", "k1", "k2", "k3", "k4", "conv"]
    cut = lambda part: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], names=names)
    pieces = list(turns._id_pieces(iter([cut(rows[:1800]), cut(rows[1800:])])))
    assert all(len(p.split(",")) <= turns.IDS for b in pieces for p in b.column(6).to_pylist())
    got = [r for b in turns._hash_pieces(iter(pieces)) for r in zip(*[c.to_pylist() for c in b.columns])]
    want = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in (many, [7])]
    assert got == [(2, 1, 1, 1, 1, want[0]), (3, 1, 1, 1, 1, want[1])]


def test_scores_equal_plain_convolution():
    rng = np.random.default_rng(0)
    size = len(toxic.WIDTHS) * toxic.FILTERS
    model = toxic.Model(rng.normal(0, 1, (toxic.BUCKETS, toxic.DIM)).astype(np.float32),
                        [rng.normal(0, 1, (k, toxic.DIM, toxic.FILTERS)).astype(np.float32) for k in toxic.WIDTHS],
                        rng.normal(0, 1, size).astype(np.float32), rng.normal(0, 1, size), 0.1)
    model.embeddings[0] = 0
    long = " ".join(f"w{i % 700}x{i % 11}" for i in range(toxic.PIECE + 500))
    texts = ["", "One", "one, two three!", long, "?!", "two " * 5]

    def plain(text):
        words = toxic.words_of(text)
        x = np.array([model.embeddings[list(toxic._features(w))].sum(0) for w in words]).reshape(-1, toxic.DIM)
        best = []
        for w, k in enumerate(toxic.WIDTHS):
            padded = np.concatenate([np.zeros((k - 1, toxic.DIM)), x, np.zeros((k - 1, toxic.DIM))])
            windows = [sum(padded[i + j] @ model.filters[w][j] for j in range(k)) for i in range(len(padded) - k + 1)] if words else []
            best.append(np.max(windows, axis=0) if words else np.zeros(toxic.FILTERS))
        z = np.maximum(np.concatenate(best) + model.bias, 0) @ model.weights + model.offset
        return 1 / (1 + math.exp(-z))
    assert np.allclose(toxic.Scorer(model).scores(texts), [plain(t) for t in texts], atol=1e-4)


def test_score_toxicity(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["an", "er", "th", "in", "on", "re"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(700):
        words = [word() for _ in range(rng.randint(5, 80))]
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["grobu", "krell"]) + word())
        rows.append((i, " ".join(words), rng.choice(["xx", "yy"]), 0.5, i % 2))
        labels.append((i, int(bad)))
    rows += [(1000, None, None, 0.1, 1), (1001, "", "zz", 0.1, 1), (None, "the words", "xx", 0.1, 1), (3, rows[3][1], "xx", 0.1, 0)]
    labels += [(None, 1), (5, None), (4, 0), (7777, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, id int").repartition(4)
    out = toxic.score_toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert out.columns == ["doc_id", "held_out", "score", "predicted", "threshold", "flagged"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert {r.doc_id for r in held} == {i for i in range(700) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95
    assert np.mean([r.flagged == (r.doc_id % 4 == 0) for r in held]) > 0.95
    empty = {r.score for r in got if r.doc_id in (1000, 1001)}
    assert len(empty) == 1 and len({r.score for r in got if r.doc_id == 3}) == 1


def test_score_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (2, None, None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxic.score_toxicity(docs, none).collect()} == {0.5}
    assert toxic.score_toxicity(docs.where("doc_id > 9"), none).collect() == []
    only = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert {r.score for r in toxic.score_toxicity(docs, only).collect()} == {0.0}


def test_thresholds():
    scores = np.array([0.1, 0.2, 0.3, 0.7] * 20)
    labels = np.array([0.0, 0.0, 1.0, 1.0] * 20)
    per, rest = toxic.thresholds(scores, labels, ["a"] * 76 + ["b", "b", None, "b"])
    assert set(per) == {"a"} and per["a"] == pytest.approx(0.25) and rest == pytest.approx(0.25)


def test_toxic_model_and_thresholds_come_from_all_labels(spark, monkeypatch):
    monkeypatch.setattr(toxic, "SAMPLE_TOXIC", 30)
    monkeypatch.setattr(toxic, "SAMPLE_CLEAN", 30)
    monkeypatch.setattr(toxic, "SHARE_DOCS", 500)
    rng = np.random.default_rng(5)
    bad, good = [f"vile{chr(97 + i)}{i}" for i in range(24)], [f"calm{chr(97 + i)}{i}" for i in range(24)]
    text = lambda y: " ".join(rng.permutation([*[f"w{k}" for k in rng.integers(0, 300, 20)], (bad if y else good)[rng.integers(24)]]))
    rows = [(i, text(i % 3 == 0), "a" if i % 2 else "b", int(i % 3 == 0)) for i in range(3000)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    got = toxic.score_toxicity(docs, labels).collect()
    held = [(r["predicted"], int(r["doc_id"] % 3 == 0)) for r in got if r["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.97
    again = toxic.score_toxicity(docs.repartition(5), labels.repartition(3)).collect()
    assert {r["doc_id"]: r["score"] for r in got} == pytest.approx({r["doc_id"]: r["score"] for r in again}, abs=1e-6)


def test_thresholds_of_a_table_equal_those_of_arrays(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 400)
    score = np.round(np.clip(0.3 * y + rng.random(400) * 0.7, 0, 1), 2)
    lang = [("a", "b", "rare", None)[min(3, i % 50) if i % 50 in (2, 3) else i % 2] for i in range(400)]
    table = spark.createDataFrame([(c, float(s), int(v)) for c, s, v in zip(lang, score, y)], "lang string, score double, y int")
    per, rest = toxic.thresholds(score, y.astype(float), lang)
    got, got_rest = toxic.spread_thresholds(table)
    assert got == pytest.approx(per) and got_rest == pytest.approx(rest)
