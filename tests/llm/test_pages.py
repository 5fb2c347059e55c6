"""Vectors, pages, archives and the pipeline beside brute force."""

import base64
import hashlib
import html as entities
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.functions.session import scratch_path
from plumbline.llm import html, minhash, private, quality, vectors, warc
from tests.llm.test_text import grouped

FOLDER = "/root/testdata/sf0.001"


def cluster_rows():
    rng = np.random.default_rng(8)
    rows, i = [], 0
    for _ in range(40):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 12)):
            rows.append((i, (centre + rng.normal(size=16) * 0.1 * rng.random()).tolist(), int(rng.integers(2))))
            i += 1
    hot = rng.normal(size=16)
    rows += [(i + k, (hot + rng.normal(size=16) * 0.05).tolist(), 0) for k in range(200)]
    i += 200
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] + [1.0] * 15]
    rows += [(i + k, v, 1) for k, v in enumerate(bad)] + [(i + 10, rows[0][1], None), (None, rows[0][1], 0)]
    rows += [(i + 20, rows[0][1], rows[0][2]), (3, rows[3][1], rows[3][2]), (i + 21, rows[0][1][:8], rows[0][2])]
    return rows


@pytest.mark.parametrize("most", [3000, 60])
def test_near_vectors(spark, most):
    rows = cluster_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("path", F.lit(1))
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, most=most).collect())

    def good(i, v, label):
        return i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    fine = [k for k, r in enumerate(rows) if good(*r)]
    unit = {k: np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in fine}
    edges = [(a, b) for a in fine for b in fine if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b])
             and unit[a] @ unit[b] >= 0.98]
    group = grouped(range(len(rows)), edges)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[group[k]] = min(least.get(group[k], i), i)
    n = Counter(x for e in edges for x in e)
    want = Counter()
    for k, (i, *_) in enumerate(rows):
        component = least[group[k]] if k in unit else i
        want[i, n[k], component, i == component] += 1
    assert sum((got & want).values()) >= (len(rows) if most > 300 else 0.97 * len(rows))
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_search_leaves_a_group_of_many_copies():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(2, 48))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    turn = base[1] - (base[1] @ base[0]) * base[0]
    other = 0.987 * base[0] + np.sqrt(1 - 0.987 ** 2) * turn / np.linalg.norm(turn)
    unit = np.concatenate([c + rng.normal(size=(150, 48)) * 0.002 for c in (base[0], other)] + [rng.normal(size=(500, 48))])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    lists = vectors.build(unit)
    edges = np.full((len(unit), max(map(len, lists))), -1)
    for i, near in enumerate(lists):
        edges[i, :len(near)] = near
    medoid = int(np.argmax(unit @ unit.sum(axis=0)))
    for i in range(300):
        got = vectors.search(unit[i], unit, edges, [medoid, i], 0.98)
        assert got.tolist() == np.flatnonzero(unit @ unit[i] >= 0.98).tolist()


PAGE = """<html><head><title>T</title></head><body><div id="cookie-notice">We use cookies</div><header class=site><h1>Site</h1></header>
<div class="wrap has-sidebar"><div class="post-{n} post"><header><h1>Head &amp; line</h1><span>by X</span></header><p>Long paragraph {n},
with text that goes on&nbsp;and on for a while.</p><p>Second para <a href=x>link</a>graph here<div class="ad-box">Buy!</div><ul><li>one<li>two
</ul><form><input><p>Your mail</form><script>if(a<b)"</p>"</script><style>p{{}}</style><!-- <p>no</p> --></div>
<div class=sidebar>Side text</div><section id="comments"><p>First! a long comment about nothing, longer than all that the article
has to say, which goes on and on and on and on, and on and on</p></section></div><footer>(c)</footer></body>"""


def test_extract_templates(spark):
    want = "Head & line Long paragraph {n}, with text that goes on and on for a while. Second para linkgraph here one two"
    rows = [(i, f"http://a.example/{i}", PAGE.format(n=i)) for i in range(5)]
    # a short article beside a long list outside it: the host's other pages decide
    odd = '<body><div class="wrap has-sidebar"><div class="post post-7"><p>Tiny.</p></div><div class="feed"><p>' + "words of a feed " * 40 + "</p></div></div>"
    rows += [(7, "http://A.example/x", odd), (8, None, odd), (9, "http://b.example/", None), (10, "http://b.example/", ""),
             (11, "c", "plain <b>te</b>xt &lt; more"), (12, "http://b.example", "a < b <p>c"), (None, "http://a.example/", PAGE.format(n=1)),
             (13, "http://b.example", "<p>" + "long " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "path": F.lit(2), "text": F.lit(3)})
    for most in (1000, 0):      # winners broadcast, winners joined
        got = {r.page_id: r.text for r in html.extract_pages(df, most).collect()}
        assert all(got[i] == want.format(n=i) for i in range(5)) and got[None] == want.format(n=1)
        assert got[7] == "Tiny." and got[8].startswith("words of a feed") and got[9] == got[10] == ""
        assert got[11] == "plain text < more" and got[12] == "a < b c" and len(got[13]) == 499_999
    assert html.page_table(df.limit(0)).count() == 0


def test_extract_keeps_text_of_forms_and_topics():
    body = "<p>" + "prose of the article, told at length. " * 5 + "</p>"
    want = ("prose of the article, told at length. " * 5).strip()
    ask = "<form><label>Mail</label><p>Write to us today</p><input><button>Send</button></form>"
    # a form around the page, by its frame or by its prose; forms for input beside it
    assert html.extract(f'<form id="aspnetForm"><header>Site</header><div class=post>{body}</div>{ask}<footer>(c)</footer></form>') \
        .startswith(want)
    assert html.extract(f"<form><label>Go</label><div><h2>Head</h2>{body}</div></form><div>{ask}</div>") == "Head " + want
    assert html.extract(f"<article>{body}{ask}</article>") == want
    assert html.extract(f'<article>{body}<form class="comment-form"><h1>Reply</h1>{body}</form></article>') == want
    # names that are topics
    assert html.extract(f'<article>{body}<section class="related-work"><p>Others did so.</p></section></article>') == want + " Others did so."
    assert html.extract(f'<article>{body}<p class="share-price">It rose.</p></article>') == want + " It rose."
    assert html.extract(f'<article>{body}<p>The <span class="search-term">term</span> <i class=ad>Buy</i>counts.</p></article>') \
        == want + " The term counts."
    for name in ("related-posts", "share-buttons", "search-form", "social", "newsletter-daily", "ad-mpu"):
        assert html.extract(f'<article>{body}<div class="{name}"><p>Other things.</p></div></article>') == want, name
    # headline and lede in front of an article
    assert html.extract(f"<main><h1>Head</h1><p>Lede</p><article>{body}</article><p>More like it</p></main>") == "Head Lede " + want
    assert html.extract(f"<main><p>Kicker</p><article>{body}</article></main>") == want
    assert html.extract(f"<main><h1>Latest</h1><article>{body}</article><article><p>short</p></article></main>").startswith("prose")


def test_extract_widens_to_the_article():
    long = "<p>" + "prose of the article " * 200 + "</p>"
    words = " ".join("prose of the article " * 200 for _ in "x").split()
    for inner, outer in (("<blockquote>{}</blockquote>", "<article><h1>Head</h1><p>lede</p>{}<p>end</p></article>"),
                         ("<section>{}</section>", "<article><h1>Head</h1><p>lede</p>{}<section><p>end</p></section></article>"),
                         ("<div class=entry>{}</div>", "<div class=post><h1>Head</h1><p>lede</p>{}<p>end</p></div>"),
                         ("<div class=text>{}</div>", "<div class=x><h1>Head</h1><p>lede</p>{}<p>end</p></div>")):
        page = "<body><nav>menu</nav><div class=wrap><div class=feed><p>feed text</p></div>" + outer.format(inner.format(long)) + "</div></body>"
        for path in (None, html.parse(page).label[html.best(html.parse(page))[0][1]]):
            assert html.extract(page, path).split() == ["Head", "lede", *words, "end"]
    links = "<div class=x><div class=text>" + long + "</div><a href=a>one more to read</a></div>"
    assert html.extract("<body><div class=y>" + links + "</div></body>").split() == words


def test_extract_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in html.page_table(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        text = " ".join(entities.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", article))).split())
        assert got[r.page_id] == (text, len(text))


def test_archive(spark):
    rng = random.Random(9)
    tricky = "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    payloads = [None, "", "x", tricky, "\r\n", "é" * 100, "l\n" * 5000, "y" * 300_000]
    rows = [(i, f"http://h.example/{i}\r\nEvil: 1" if i % 7 == 0 else f"http://h.example/{i}#f", rng.choice(payloads)) for i in range(60)]
    rows += [(None, None, "x"), (100, "u", "x"), (100, "u", "x"), (100, "t", "x"), (101, None, "only here")]
    rows += [(None, None, "x"), (101, "-", "only here")] + [(102, "r", "again")] * 2500
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"row": F.lit(1), "sha1": F.lit("s")}).repartition(3)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want, seen = Counter(), Counter()
    rows = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""), reverse=True)
    for i, _, h in rows:
        data = (h or "").encode()
        top = (-1 if i is None else i) == last[h or ""] and not seen[h or ""]
        seen[h or ""] += top
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if top else "revisit",
             None if top else last[h or ""]] += 1
    assert Counter(tuple(r) for r in warc.archive_table(df).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == want
    path = scratch_path(spark, "archive")
    warc.write_warc(df, path)
    one = warc.captures(warc.read_warc(spark, path)).collect()
    assert len(one) == len(rows)
    assert all(c.requests[0].type == "request" and len(c.requests) == len(c.metadata) == 1 and not c.others
               and c.metadata[0].concurrent_to == c.capture_id == c.response.record_id for c in one)
    bodies = Counter(bytes(c.response.block).partition(b"\r\n\r\n")[2].decode() for c in one if c.response.type == "response")
    assert bodies == Counter({h or "": 1 for _, _, h in rows})
    assert all("evil" not in {h.name for h in c.response.headers} for c in one)
    assert warc.archive_table(df.limit(0)).count() == 0


def test_captures_of_foreign_records(spark):
    def record(kind, name, near=(), size=None, block=""):
        lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *[f"WARC-Concurrent-To: {n}" for n in near],
                 f"Content-Length: {len(block) if size is None else size}"]
        return "\r\n".join([*lines, "", block])
    records = [record("response", "a", block="12345"), record("metadata", "m2", "a"), record("metadata", "m1", "a", block="x: y"),
               record("request", "q", "ab"), record("response", "b", "q"), record("warcinfo", "i"), record("conversion", "c", "a"),
               record("metadata", "odd", "b", size="many"), record("request", "lone"), record("metadata", "m1", "a", block="x: y")]
    path = scratch_path(spark, "archive")
    spark.createDataFrame([(r,) for r in records], "value string").repartition(3).write.text(
        path, compression="gzip", lineSep=warc.CRLF * 2)
    got = {c.capture_id: (c.response and c.response.record_id, *([r.record_id for r in x] for x in (c.requests, c.metadata, c.others)))
           for c in warc.captures(warc.read_warc(spark, path)).collect()}
    assert got == {"a": ("a", ["q"], ["m1", "m1", "m2"], ["c"]), "b": ("b", ["q"], ["odd"], []), "i": (None, [], [], ["i"]),
                   "lone": (None, ["lone"], [], [])}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    judged = {r.doc_id: r.kept for r in quality.quality_table(docs).collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, FOLDER)
    assert good.dtypes == docs.dtypes and {r.doc_id for r in good.collect()} == {i for i, k in judged.items() if k}
    one = stages["near_dedup"](spark, good, FOLDER)
    groups = {r.id: r.component for r in minhash.near_duplicates(good).collect()}
    assert one.dtypes == docs.dtypes and {r.doc_id for r in one.collect()} == set(groups.values())
    masked = stages["surrogates"](spark, one, FOLDER)
    rows = masked.collect()
    assert masked.dtypes == docs.dtypes and {r.doc_id for r in rows} == set(groups.values())
    for r in rows:
        found = private.find(texts[r.doc_id])
        assert (r.text == texts[r.doc_id]) == (not found) and not any(texts[r.doc_id][a:b] in r.text for a, b, _, _ in found)
    packed = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in packed.collect()} == set(groups.values())
    assert packed.columns == stages["packing"](spark, masked, FOLDER).columns


def test_vectors_pruned_and_searched_together_are_like_single_ones(monkeypatch):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(30, 16))
    unit = centre[rng.integers(0, 30, 400)] + 0.15 * rng.normal(size=(400, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T
    ids = np.argsort(-near, axis=1, kind="stable")[:, 1:50]
    ids[::3, 40:] = -1
    cos = np.where(ids >= 0, np.take_along_axis(near, ids, 1), -2)
    want = [vectors.prune(row[row >= 0], near[i][row[row >= 0]], unit, 9, 1.2) for i, row in enumerate(ids)]
    lists = vectors.build(unit)
    edges = np.full((400, max(map(len, lists))), -1)
    for i, x in enumerate(lists):
        edges[i, :len(x)] = x
    found = None
    for cells, expanded in ((1 << 20, 1 << 14), (1, 3)):
        monkeypatch.setattr(vectors, "PRUNED_CELLS", cells)
        monkeypatch.setattr(vectors, "EXPANDED", expanded)
        assert vectors.prune_many(ids, cos, unit, 9, 1.2) == want
        query, hits = vectors.search_many(unit, unit, edges, np.stack([np.zeros(400, int), np.arange(400)], 1), 0.98)
        assert found is None or (query.tolist(), hits.tolist()) == found
        found = query.tolist(), hits.tolist()
    one = [vectors.search(unit[i], unit, edges, [0, i], 0.98).tolist() for i in range(400)]
    assert one == [hits[query == i].tolist() for i in range(400)]
    true = near >= 0.98
    assert true[query, hits].all() and len(hits) > 0.99 * true.sum() > 400
