"""Quality rules, near-duplicates, secrets and components beside brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import minhash, quality, secrets
from plumbline.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def find_root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def grouped(nodes, edges):
    parent = {n: n for n in nodes}
    for a, b in edges:
        x, y = sorted((find_root(parent, a), find_root(parent, b)))
        parent[y] = x
    return {n: find_root(parent, n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000, x) for x in range(1001, 1100)] \
        + [(x, x + 1) for x in range(2000, 2060)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = grouped({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if n in got}
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_signals(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    many = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in many for j in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(covered), n < 20 or 100 * len(covered) > 30 * n)


def quality_rows():
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.choice([3, 19, 20, 60, 200]))) for i in range(60)]
    rows += [(100 + i, "\n".join([prose(rng, 12) + "."] * rng.randrange(1, 4) + [prose(rng, 30)])) for i in range(20)]
    rows += [(200 + i, " ".join(w + rng.choice(["###", "***", "%%%"]) for w in prose(rng, 80).split())) for i in range(12)]
    rows += [(300 + i, " ".join(["same"] * 70)) for i in range(4)]
    rows += [(400, None), (401, ""), (402, " \t\n\x0b "), (403, "é😀 " * 30), (404, "a b c\x85d " * 9), (None, prose(rng, 50)),
             (405, prose(rng, 60)), (405, prose(rng, 60)), (406, "x" * 50_000), (407, prose(rng, 30_000))]
    return rows


def test_signals(spark):
    rows = quality_rows()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in quality.quality_table(table(spark, rows)).collect())
    assert got == Counter((i, *brute_signals(t)) for i, t in rows)


def brute_model(patterns, rounds=quality.ROUNDS):
    """The mixture of the docstring, in plain Python."""
    n_rules, bad, good = quality.N_RULES, quality.BAD, quality.GOOD
    votes = {p: [p // 3 ** j % 3 for j in range(n_rules)] for p in patterns}
    weight = {}
    for p, v in votes.items():
        n_bad = v.count(bad)
        weight[p] = [0.1] + [0.9 / n_bad if x == bad else 0.0 for x in v] if n_bad else [0.9] + [0.1 / n_rules] * n_rules
    every = sum(patterns.values())
    for _ in range(rounds):
        model = []
        for c in range(n_rules + 1):
            def total(test, c=c):
                return sum(n * weight[p][c] for p, n in patterns.items() if test(votes[p]))
            model.append((math.log((total(lambda v: True) + 0.01) / (every + 0.1)),
                          [(total(lambda v, j=j: v[j] == bad) + 0.01) / (total(lambda v, j=j: v[j] != quality.NONE) + 0.02)
                           for j in range(n_rules)]))
        for p, v in votes.items():
            odds = [prior + sum(math.log(b) if x == bad else math.log(1 - b) if x == good else 0.0 for x, b in zip(v, chance))
                    for prior, chance in model]
            e = [math.exp(o - max(odds)) for o in odds]
            weight[p] = [x / sum(e) for x in e]
    return {p: w[0] for p, w in weight.items()}


def test_label_model(spark):
    df, p = quality.judge(table(spark, quality_rows()))
    rows = df.select(p + "pattern", p + "p_good", p + "failed", p + "kept").collect()
    want = brute_model(Counter(r[0] for r in rows))
    for pattern, p_good, failed, kept in rows:
        assert p_good == pytest.approx(want[pattern], abs=1e-6)
        assert kept == (not failed and p_good >= 0.5)
    ids = {r.doc_id for r in quality.keep_good(table(spark, quality_rows())).collect()}
    assert not ids & {*range(200, 212), *range(300, 304), 400, 401}
    assert 407 in ids and None in ids


def test_quality_keeps_columns(spark):
    clash = table(spark, quality_rows()[:30]).withColumns({"_qn_words": F.lit(1), "kept": F.lit("x"), "pattern": F.lit(2.0)})
    assert quality.keep_good(clash).dtypes == clash.dtypes
    assert quality.keep_good(clash.limit(0)).count() == 0 == quality.quality_table(clash.limit(0)).count()


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def near_rows():
    rng = random.Random(3)
    rows, i = [], 0
    shared = prose(rng, 60)
    for _ in range(40):
        base = prose(rng, rng.choice([2, 6, 30, 150, 600]), 5000).split()
        for _ in range(rng.choice([1, 1, 2, 4])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10 ** 6)}"
            rows.append((i, " ".join(w)))
            i += 1
    hot = prose(rng, 200, 5000).split()
    for _ in range(60):      # one large group of near copies, and copies of these
        w = list(hot)
        for _ in range(3):
            w[rng.randrange(len(w))] = f"hot{rng.randrange(10 ** 6)}"
        rows += [(i, " ".join(w)), (i + 1, " ".join(w).upper())][:rng.randrange(1, 3)]
        i += 2
    rows += [(i + k, prose(rng, 100, 5000) + " " + shared) for k in range(50)]
    i += 50
    rows += [(i, None), (i + 1, ""), (i + 2, " \n "), (i + 3, "one"), (i + 4, "ONE"), (None, rows[0][1]), (0, rows[0][1]),
             (i + 5, prose(rng, 20_000, 5000))]
    return rows


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, width):
    rows = near_rows()
    got = minhash.near_duplicates(table(spark, rows), width=width).collect()
    sets = {i: shingles(t, width) for i, t in rows if i is not None}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = grouped(sets, edges)
    assert Counter((r.id, r.n, r.component) for r in got) == Counter(
        (i, len(shingles(t, width)), None if i is None else want[i]) for i, t in rows)


def test_keep_one(spark):
    rows = near_rows()
    df = table(spark, rows).withColumns({"id": F.lit(1), "digest": F.lit("d"), "Component": F.lit(0)})
    kept = minhash.keep_one(df)
    assert kept.dtypes == df.dtypes
    ids = Counter(r.doc_id for r in kept.collect())
    groups = {r.id: r.component for r in minhash.near_duplicates(df).collect()}
    assert ids == Counter({i: 1 for i, c in groups.items() if i == c})
    assert minhash.keep_one(df.limit(0)).count() == 0


def test_secrets(spark):
    rng = random.Random(4)
    bits = ["password", "secret =", "token: ", '"', "api_KEY=", "abc123def4567890", "AKIA" + "Q7" * 8, "é😀", "\n", " ", "-",
            "Zz9+" * 7, "=", "deadbeefdeadbeef", 'passwd="k', "ghp_" + "aB3" * 7, " EXAMPLE" + "aB3" * 8]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(30))), rng.choice(["a", "b", "c", "d", None])) for i in range(200)]
    rows += [(900, None, "a"), (901, "", "a"), (902, "token: password: abcdefghijklmn", "a"), (None, "ab" * 10, "a"),
             (903, "x " * 30_000 + "ab" * 10, "b"), (904, "lone ghp_" + "xY7" * 9, "a"), (904, "lone ghp_" + "xY7" * 9, "a")]
    df = spark.createDataFrame([(i, t, o, "en", "z") for i, t, o in rows], "doc_id long, text string, source string, lang string, row string")
    got = secrets.find_secrets(df).collect()
    base = [("assign", re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A), 1, 12),
            ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]
    want = Counter()
    for i, t, _ in rows:
        found = sorted((m.start(), k, m.end(), name) for k, (name, p, g, n) in enumerate(base)
                       for m in p.finditer(t or "") if len(m[g]) >= n)
        joined = ",".join(f"{name}:{a}:{b}" for a, _, b, name in found)
        want[i, *(sum(f[3] == name for f in found) for name, *_ in base), hashlib.sha256(joined.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    added = {r.doc_id: r.spans for r in got}
    assert added[904] == "vendor:5:36" and added[901] == ""
    # a value of many owners is an example, one of a few is live
    copied = spark.createDataFrame([(i, "key ghp_" + "qW5" * 8, f"o{i}") for i in range(5)] + [(9, "key ghp_" + "rT6" * 8, "o1")],
                                   "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    verdict = {r.doc_id: (r.spans, r.n_live, r.n_example) for r in secrets.find_secrets(copied).collect()}
    assert verdict[0] == ("", 0, 1) and verdict[9] == ("vendor:4:32", 1, 0)
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_secrets_copied_inside_one_source(spark):
    rows = [(i, "key ghp_" + "qW5" * 8, "hot") for i in range(40)] + [(90, "key ghp_" + "rT6" * 8, "hot"), (91, "key ghp_" + "rT6" * 8, "o")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    got = {r.doc_id: (r.spans, r.n_live, r.n_example, r.ownership) for r in secrets.find_secrets(df).collect()}
    assert got[0] == ("", 0, 1, "vendor:4:32:1:40")
    assert got[90] == got[91] == ("vendor:4:32", 1, 0, "vendor:4:32:2:2")
