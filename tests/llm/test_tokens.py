"""Surrogates, packing, segmentations and n-gram scores beside brute force."""

import itertools
import math
import random
import re
import tempfile
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import ngrams, packing, private, segment


def test_surrogate_texts(spark):
    letter = ("Dear Mr. John Smith, Mrs Anna Smith and Frau Müller; call +1 (212) 555-0188 or +1 212-555-0188. SMITH? Smith said "
              "господин Иван Петров wrote to A.B@Mail.COM and a.b@mail.com. IBAN DE89 3704 0044 0532 0130 00, number 123-45-6789, "
              "hosts 192.168.1.7 and 8.8.4.4, card 4111 1111 1111 1111 or 4111111111111111. My name is Alice Jones.")
    clean = "The year 1999-2000 had 365.25 days, v1.2.3 of smith, 12345 mr smith e.g. a@b and Order 66."
    rows = [(1, letter), (2, "again a.b@mail.com at 8.8.4.4"), (3, clean), (4, None), (5, ""), (2, "again a.b@mail.com at 8.8.4.4"),
            (None, "8.8.4.4"), (6, "x " * 50_000 + "8.8.4.4")]
    df = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in rows], "doc_id long, text string, n_chars long") \
        .withColumns({"digest": F.lit("d"), "kind": F.lit(1), "_qnew": F.lit(2), "_part": F.lit(3), "a.b": F.lit(4)})
    out = private.surrogate_texts(df, "k")
    assert out.dtypes == df.dtypes
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r.text)
        assert r.n_chars == (None if r.text is None else len(r.text))
    new = got[1][0]
    for gone in ("John", "Smith", "SMITH", "Anna", "Müller", "Иван", "Петров", "Alice", "Jones", "0188", "Mail", "mail", "3704", "6789",
                 "192.168.1.7", "8.8.4.4", "4111"):
        assert gone not in new
    assert got[3] == [clean] and got[4] == [None] and got[5] == [""]
    assert len(got[2]) == 2 and got[2][0] == got[2][1]
    host = got[None][0]
    assert host in new and got[2][0].endswith(host) and got[6][0].endswith(host)           # one surrogate everywhere
    m = re.match(r"Dear Mr\. (\w+) (\w+), Mrs (\w+a) (\w+) and Frau \w+; call \+1 \((\d{3})\) 555-(\d{4}) or \+1 (\d{3})-555-(\d{4})\. (\w+)\?"
                 r" (\w+) said господин ([а-яА-Я]+н) [а-яА-Я]+ wrote to (\w\.\w@\w{4}\.COM) and (\w\.\w@\w{4}\.com)\.", new)
    assert m and m[2] == m[4] == m[10] and m[9] == m[2].upper() and m[5] == m[7] and m[6] == m[8]
    assert m[12].lower() == m[13]
    assert re.search(r"192\.168\.\d+\.\d+", new)
    cards = re.findall(r"\b\d{4} \d{4} \d{4} \d{4}\b|\b\d{16}\b", new.partition("card ")[2])
    assert len(cards) == 2 and cards[0].replace(" ", "") == cards[1] and private.luhn(cards[1])
    assert private.surrogate_texts(df.limit(0), "k").count() == 0


def test_surrogates_are_distinct_and_not_real(spark):
    first = "20.30.40.50"
    taken = private.draw("ip", first, 0, "k")
    values = [first, taken] + [f"20.30.{i}.{j}" for i in range(40) for j in range(40)]
    got = private.assign(spark.createDataFrame([("ip", v) for v in values], "kind string, value string").distinct(), "k").collect()
    names = [r.surrogate for r in got]
    assert len(got) == len(set(values)) == len(set(names)) and not set(names) & set(values)


def test_surrogates_by_brute_force(spark):
    hosts = [f"192.168.{i % 7}.{i}" for i in range(1, 90)]
    rows = [(i, f"{hosts[i % 89]} met {hosts[i * i % 89]} and U{i % 50}@x{i % 9}.org, card 4111111111111111") for i in range(300)] * 2
    got = private.surrogate_texts(spark.createDataFrame(rows, "doc_id long, text string"), "k", count_col="n").collect()
    spans = {i: private.find(t) for i, t in rows}
    entities = {(kind, value) for found in spans.values() for *_, kind, value in found}
    table, attempt = {e: private.draw(*e, 0, "k") for e in entities}, dict.fromkeys(entities, 0)
    while True:
        owner = {}
        for kind, value in sorted(entities):
            owner.setdefault((kind, table[kind, value]), value)
        again = [e for e in entities if (e[0], table[e]) in entities or owner[e[0], table[e]] != e[1]]
        if not again:
            break
        for e in again:
            attempt[e] += 1
            table[e] = private.draw(*e, attempt[e], "k")
    want = Counter()
    for i, t in rows:
        parts, last = [], 0
        for start, end, kind, value in spans[i]:
            parts += [t[last:start], private.render(kind, t[start:end], table[kind, value])]
            last = end
        want[i, "".join([*parts, t[last:]]), len(spans[i])] += 1
    assert Counter((r.doc_id, r.text, r.n) for r in got) == want


def test_full_surrogate_space(spark, monkeypatch):
    values = spark.range(800).selectExpr("'ip' as kind", "concat('192.168.', 1 + id div 200, '.', 1 + id % 200) as value")
    few = lambda kind, value, attempt, key, gender="n": f"192.168.1.{attempt}"
    monkeypatch.setattr(private, "draw", few)
    with pytest.raises(ValueError, match="800 of kind ip|no free surrogate"):
        private.assign(values, "k", most_attempts=3)
    monkeypatch.undo()
    wide = {private.draw("ip", "192.168.1.1", private._WIDER + i, "k").partition(".")[0] for i in range(5)}
    assert wide == {"10"} and private.draw("ip", "192.168.1.1", 0, "k").startswith("192.168.")


def test_names_are_one_entity_in_every_document(spark):
    rows = [(1, "Mrs Anna Smith"), (2, "Dr Anna Smith"), (3, "My name is Anna Smith"), (4, "Dr Smith")]
    got = {r.doc_id: r.text for r in private.surrogate_texts(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    given, family = got[1].removeprefix("Mrs ").split()
    assert given.endswith("a") and got[2] == f"Dr {given} {family}" and got[3] == f"My name is {given} {family}" and got[4] == f"Dr {family}"
    taken = private.draw("name_l", "Smith", 0, "k")
    people = [("name_l", v, "n") for v in ("Smith", taken, "Jones")]
    names = [r.surrogate for r in private.assign(spark.createDataFrame(people, "kind string, value string, gender string"), "k").collect()]
    assert len(set(names)) == 3 and taken not in names


@pytest.mark.parametrize("text, gone", [
    ("and/or Mr. Smith", "Smith"), ("*Dr. Jones*", "Jones"), ("<b>Mrs. Miller</b>", "Miller"), ("so-Mr. Lee", "Lee"),
    ("x,Mr. Lee", "Lee"), ("\u2018Mr. Lee", "Lee"), ("card 3782 822463 10005.", "3782 822463 10005"),
    ("card 2223 0031 2200 3222.", "2223 0031 2200 3222"), ("call 555 123 4567.", "555 123 4567"),
    ("host 2001:db8::8a2e:370:7334, up", "2001:db8::8a2e:370:7334"), ("host fe80:0:0:0:1:2:3:4: up", "fe80:0:0:0:1:2:3:4")])
def test_mentions_in_every_form(text, gone):
    assert [text[a:b] for a, b, *_ in private.find(text)] == [gone]
    (_, _, kind, value), = private.find(text)
    new = private.render(kind, gone, private.draw(kind, value, 0, "k"))
    assert new != gone and private.find(text.replace(gone, new))[0][2] == kind
    assert not private.find("at 12:30:45 in a::b::c and 2020 1111 2222 3333")


def test_word_ids_of_any_characters():
    path = public_tokenizers.path(packing.VOCABULARY)
    rng, plain = random.Random(1), Tokenizer.from_file(path)
    kinds = [lambda: rng.randrange(1, 128), lambda: rng.randrange(128, 0x250), lambda: rng.randrange(0x300, 0x370),
             lambda: rng.randrange(0x370, 0x3000), lambda: rng.choice([0x130, 0xAD, 0x15, 0x20, 0x41])]
    texts = ["".join(chr(rng.choice(kinds)()) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    got = packing.WordEncoder(path)([*texts, None, ""])
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert got == [*want, b"", b""]


def test_packing(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["don't", "Été", "été", "naïve", "b́", "x\x1cy", "日本", "<|endoftext|>z", "I'S", "ΣΑΣ", "12", "..."])
                      for _ in range(rng.choice([0, 1, 40, 900, 9000]))) for _ in range(120)]
    rows = [*enumerate(texts), (500, None), (501, ""), (None, "no id"), (7, texts[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows)
    pieces = packing.pack(df).collect()
    table = packing.pack_table(df)
    assert sorted(r.ids_crc32 for r in table.collect()) == sorted(zlib.crc32(bytes(p.ids)) for p in pieces)
    windows, whole = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) // 4 > 0
        windows[p.sequence_id].append(p)
        whole[p.doc_id].append(p)
    for ps in windows.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 4096 or at & (at - 1) == 0
    for (i, ids), n in want.items():
        mine = [p for p in whole[i] if p.doc_tokens == len(ids)]
        marks = Counter((p.start, bytes(p.ids)) for p in mine)
        if n == 1:
            assert b"".join(ids for _, ids in sorted(marks)) == np.array(ids, "<u4").tobytes()
        assert sum(p.length for p in mine) == n * len(ids)
    assert packing.pack(df.limit(0)).count() == 0


def test_sum_of_squares():
    packer = packing.Packer(10)
    for size in (6, 6, 4):
        packer.add("d", b"abcd" * size)
    assert packer.level[6] == 1 and len(packer.full) == 1      # 4 fills one of the two windows of 6
    packer.add("d", b"abcd" * 3)                                # level 9 or a new window: equal squares, the fuller wins
    assert packer.level[9] == 1 and packer.level[6] == 0


def vocabulary():
    return segment.pieces(public_tokenizers.path(segment.MODEL))


def test_segmentations_are_drawn_by_weight():
    v = vocabulary()
    unit = segment.SPACE + "then"
    lattice = segment.Lattice([unit, segment.SPACE + "a"], v)
    known = {v.text[i]: i for i in v.ids}

    def ways(s):
        return [()] if not s else [(s[:i], *rest) for i in range(1, len(s) + 1) if s[:i] in known for rest in ways(s[i:])]
    every = list(itertools.product(ways(unit), ways(segment.SPACE + "a")))
    every = [a + b for a, b in every]
    p = np.exp([sum(v.weight[known[x]] for x in way) for way in every])
    p = dict(zip(every, p / p.sum(), strict=True))
    starts = np.array([lattice.start[unit], lattice.start[segment.SPACE + "a"]])
    rng, first, estimate, n = np.random.default_rng(0), Counter(), Counter(), 4000
    for _ in range(n):
        got = segment.sample(lattice, starts, 3, rng)
        ways_ = [tuple(v.text[x] for x in segment.token_ids(lattice, path, v)) for path, _, _ in got]
        assert len(set(ways_)) == 3
        first[ways_[0]] += 1
        for way, (_, logp, score) in zip(ways_, got, strict=True):
            assert logp == pytest.approx(math.log(p[way]), abs=1e-9) and 0 < score <= 1
            estimate[way] += math.exp(logp) / score
    for way, chance in p.items():
        assert abs(first[way] / n - chance) < 5 * math.sqrt(chance * (1 - chance) / n) + 1e-3
        assert abs(estimate[way] / n - chance) < 0.05
    all_of_it = segment.sample(lattice, starts[:1], 1000, rng)
    assert len(all_of_it) == len(ways(unit)) and all(score == 1 for *_, score in all_of_it)


def test_lattices_are_small_and_samples_do_not_depend_on_them(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join("".join(rng.choice(list("abcdeiou"), 5)) for _ in range(5000)) for _ in range(30)]     # 900,000 characters
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(texts), pa.array(["x"] * 30)], ["a", "b", "c"])
    made, build = [], segment.Lattice
    monkeypatch.setattr(segment, "Lattice", lambda units, v: made.append(sum(map(len, units))) or build(units, v))
    run, got = segment._encoded(segment._path(None), 1), []
    for size in (None, 10_000_000):
        if size:
            monkeypatch.setattr(segment, "LATTICE_CHARS", size)
        got.append([v for out in run([batch]) for v in out.column(3).to_pylist()])
    assert len(made) == 3 and max(made[:2]) <= 520_000 and got[0] == got[1]


def test_texts_of_a_lattice_draw_together(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("abcdeiou"), 6)) for _ in range(40)) for _ in range(50)]
    calls, walk = [], segment.Lattice.walk
    monkeypatch.setattr(segment.Lattice, "walk", lambda self, *a: calls.append(len(a[0])) or walk(self, *a))
    run = segment._encoded(segment._path(None), 3)

    def samples(some):
        batch = pa.RecordBatch.from_arrays([pa.array(some), pa.array([texts[i] for i in some]), pa.array(["x"] * len(some))], ["a", "b", "c"])
        return {(r["doc_id"], r["sample"]): (r["ids"], r["log_prob"], r["inclusion"]) for out in run([batch]) for r in out.to_pylist()}
    together = samples(range(50))
    assert len(calls) == 3 and calls[0] == 50 * 40       # a walk a round, not one a text
    alone = {}
    for i in range(50):
        alone |= samples([i])
    assert together == alone and len(together) == 150


def test_segmentations_spell_the_text(spark):
    rng = random.Random(6)
    texts = ["  two  spaces\nnl\t ", "日本 é😀 \x00", "▁odd ▁▁", "x" * 3000, " " * 500, "a", *(" ".join(
        rng.choice(["the", "Ünder", "nnn", "123", "…"]) for _ in range(rng.randrange(400))) for _ in range(20))]
    rows = [*enumerate(texts), (100, None), (101, ""), (None, "no id"), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = segment.decode_samples(segment.encode_samples(df, 3)).collect()
    by_row = defaultdict(set)
    given = defaultdict(set)
    for i, t in rows:
        given[i].add(t or "")
    for r in one:
        assert r.text.replace("▁", " ") in {g.replace("▁", " ") for g in given[r.doc_id]}
        by_row[r.doc_id].add(bytes(r.ids))
    assert all(len(by_row[i]) == 3 for i in (0, 3, 10)) and len(by_row[100]) == len(by_row[101]) == 1
    two = segment.encode_samples(df.repartition(5), 3).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.sample, bytes(r.ids), round(r.log_prob, 6))
    assert sorted(map(key, one)) == sorted(map(key, two))       # noise hangs on the row's key alone
    assert segment.sample_table(df.limit(0)).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in itertools.product((0, 1, 5, 1000, 20_000), (10, 1000, 10 ** 7, 10 ** 12)):
        values = np.sort(rng.integers(0, top, n))
        with tempfile.TemporaryDirectory() as folder:
            coded = ngrams.EliasFano(folder, "x", values, top)
            assert (coded.values() == values).all()
            wanted = np.sort(np.concatenate([values[:200], rng.integers(0, top, 200)]))
            assert (coded.find(wanted) == np.searchsorted(values, wanted)).all()


@pytest.mark.parametrize("order, block", [(2, 2_000), (3, 3_000), (3, 10 ** 7)])
def test_scores(spark, order, block):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("A a b c dd Ee é".split()) for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [(None, None), (500, ""), (7, rows[7][1]), (501, "unseen words only"), (502, "a " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("x"))
    texts = [(i, zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1,
              re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b" "]) for i, t in rows]
    counts = [Counter() for _ in range(order)]
    for _, held, words in texts:
        padded = [b" "] * (order - 1) + words
        for k, n in itertools.product(range(order - 1, len(padded)), range(order)):
            if not held:
                counts[n][tuple(padded[k - n:k + 1])] += 1
    total, distinct = sum(counts[0].values()), len(counts[0])
    want = []
    for i, held, words in texts:
        padded, base, score = [b" "] * (order - 1) + words, 0.0, 0.0
        for k in range(order - 1, len(padded)):
            p = (counts[0][padded[k],] + 0.5) / (total + 0.5 * (distinct + 1))
            base += math.log10(p)
            for n in range(1, order):
                gram = tuple(padded[k - n:k + 1])
                p = (counts[n][gram] + 50 * p) / (counts[n - 1][gram[:-1]] + 50)
            score += math.log10(p)
        want.append((str(i), held, len(words), sum(counts[0][w,] > 0 for w in words), total, base, score))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
                 for r in ngrams.score_texts(df, order, 50.0, block).collect())
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)
        assert abs(g[6] - w[6]) < 2e-4 * w[2]       # quantised
    assert ngrams.score_texts(df.limit(0)).count() == 0


def test_score_beats_unigrams_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base, score = ngrams.score_texts(docs).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base


def test_scores_use_contexts_of_two_words(spark):
    rows = [(i, ("p b c " if i % 2 else "q b d ") * 2000) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    score = {order: {r.doc_id: r.score for r in ngrams.score_texts(df, **order_arg).collect()}
             for order, order_arg in ((0, {}), (2, {"order": 2}), (3, {"order": 3}))}
    assert score[0] == score[3]
    assert all(score[0][i] > score[2][i] + 100 for i, _ in rows)     # the word after b follows from the one before it


def test_blocks_get_back_what_others_count():
    lists = pd.DataFrame({"level": 2, "range": 0, "block": [1, 2], "keys": [ngrams._squeeze_sorted(np.array(k, np.uint64)) for k in (
        [5, 9, 2 ** 63], [9, 11])], "counts": [ngrams._squeeze(np.array(c)) for c in ([4, 2, 7], [3, 0])]})
    out = ngrams._summed(lists)
    assert [ngrams._expand(o).tolist() for o in out["others"]] == [[0, 3, 0], [2, 0]]
    assert out["n"].sum() == 16 and out["distinct"].sum() == 3


def test_block_is_scored_in_little_memory():
    rng, n = np.random.default_rng(1), 400_000
    tokens = rng.zipf(1.2, n) % 30_000
    tokens[999::1000] = 29_999
    words, tokens = np.unique(tokens, return_inverse=True)
    hashes = np.sort(rng.integers(0, 2 ** 63, len(words), dtype=np.uint64))
    row = {"docs": list(range(400)), "lengths": np.full(400, 1000), "held": [i % 5 == 0 for i in range(400)],
           "tokens": ngrams._squeeze(tokens), "words": ngrams._squeeze_sorted(hashes)}
    tracemalloc.start()
    block = ngrams.Block(row, 3)
    totals = [block.counts(level) for level in range(3)]
    with tempfile.TemporaryDirectory() as folder:
        out = ngrams.score_block(block, totals, int(totals[0].sum()), len(words), 1000.0, folder)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 210 * n
    assert out["n_tokens"].sum() == n
    for level in range(3):
        assert (np.diff(block.codes[level]) > 0).all()


def test_few_texts_of_a_batch_are_python_objects():
    mail, n = "ann@example.org", 1500
    text = "x" * 20_000 + mail + "y"
    spans = [{"start": 20_000, "end": 20_000 + len(mail), "kind": "email", "value": mail, "gender": "n"}]
    other = "bob@example.org"
    arrays = (pa.array([text] * n), pa.array([spans] * n),
              pa.array([[{"kind": "email", "value": mail, "surrogate": other}]] * n))
    tracemalloc.start()
    try:
        out = private._replaced.func(*arrays)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out.to_pylist() == ["x" * 20_000 + other + "y"] * n
    assert peak < 10_000_000             # all at once: twice 30 million
    assert len(private._replaced.func(*(a.slice(0, 0) for a in arrays))) == 0
