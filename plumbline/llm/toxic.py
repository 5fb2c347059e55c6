"""Toxicity scores from a small convolutional text classifier.

A word is the sum of hashed embeddings of itself, its beginnings of three to
seven characters and its last four.  Filters of several widths run over the words; the
largest response of each filter anywhere in the text goes through a logistic
layer.  Embeddings of hashes that no training text holds stay zero, so unknown
words say nothing.  The model starts from a bounded number of labelled
documents; from there Spark tasks each learn a share of all of them, whole texts, and
their changes are averaged.  A fifth of the labelled documents is kept back, and
thresholds per language are set on all of it.

Scoring needs no shuffle.  Filter responses of a word do not depend on its
neighbours, so they are computed once per distinct word of a task and added up
for the words of each window; long texts pass in pieces that overlap by the
widest filter.
"""

import copy
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ordered import running_sums
from plumbline.functions.session import cut_lineage

WIDTHS, FILTERS, DIM, BUCKETS = (1, 2, 3), 12, 12, 1 << 17
PREFIXES, SUFFIX = (3, 4, 5, 6, 7), 4
FEATURES = len(PREFIXES) + 2
# At least EPOCHS passes over the sample, more of them while that makes under STEPS batches.
EPOCHS, STEPS, MOST_EPOCHS, BATCH, RATE, DECAY = 4, 600, 30, 32, 0.08, 1e-5
# The start sees so many labelled documents of each class, those with the smallest hashed ids, up to so many code points of each.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 2000, 4000, 20_000
FOLDS = 5
# Labelled documents of a share, all learnt once at this rate, and rows of the embeddings that are averaged together.
SHARE_DOCS, SHARE_RATE, SLICE = 8192, RATE / 2, 2048
# Labelled ids that travel to all tasks; of more of them all texts are shuffled.
BROADCAST_IDS = 5_000_000
# Words of a text that are scored together, and distinct words whose responses a task keeps.
PIECE, KNOWN_WORDS = 1 << 15, 1 << 17
# A language needs so many kept-back documents of each class for a threshold of its own.
CALIBRATION = 10

_ENDS = ".,;:!?\"'()[]{}<>*%$#&|`~-_=+/\\"


def words_of(text: str) -> list[str]:
    """Lower-cased words without the marks around them."""
    return [w for w in (x.strip(_ENDS) for x in text.lower().split()) if w]


def _features(word: str) -> tuple[int, ...]:
    """Row numbers of a word's embeddings; row 0 stays empty and stands for parts that are the whole word."""
    row = lambda kind, part: 1 + crc32(kind + part.encode("utf-8", "surrogatepass")) % (BUCKETS - 1)
    n = len(word)
    return (row(b"w", word), *[row(b"p", word[:k]) if n > k else 0 for k in PREFIXES],
            row(b"s", word[-SUFFIX:]) if n > SUFFIX else 0)


@dataclass
class Model:
    """Embeddings, filters by width, output weights; ``constant`` is the score where one class alone was seen."""
    embeddings: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    constant: float | None = None

    def responses(self, words: list[str]) -> np.ndarray:
        """What each word adds to every filter at every place in it: (words, sum of widths * FILTERS)."""
        rows = self.embeddings[np.array([_features(w) for w in words], np.int64).reshape(-1, FEATURES)].sum(1)
        table = np.concatenate([f for width in self.filters for f in width], 1)
        # no matrix product: its rounding depends on the number of rows, and equal texts must score alike
        out = np.zeros((len(rows), table.shape[1]), np.float32)
        for d in range(DIM):
            out += rows[:, d:d + 1] * table[d]
        return out

    def pooled(self, parts: np.ndarray) -> np.ndarray:
        """Largest response of every filter over the windows of consecutive words, at least zero."""
        out, at = [], 0
        n = len(parts)
        for k in WIDTHS:
            held = np.zeros((n + 2 * (k - 1), FILTERS), np.float32)  # windows may hang over both ends
            for j in range(k):
                held[k - 1 - j:k - 1 - j + n] += parts[:, at:at + FILTERS]
                at += FILTERS
            out.append(held[:n + k - 1].max(0) if n else np.zeros(FILTERS, np.float32))
        return np.concatenate(out)

    def score(self, pooled: np.ndarray) -> np.ndarray:
        """Probabilities from pooled responses, one row per document."""
        if self.constant is not None:
            return np.full(len(pooled), self.constant)
        z = (np.maximum(pooled + self.bias, 0) * self.weights).sum(1) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Scorer:
    """Scores texts of one task, remembering the responses of the words seen."""

    def __init__(self, model: Model):
        self.model, self.width = model, sum(WIDTHS) * FILTERS
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((1024, self.width), np.float32)

    def _rows(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if len(self.place) + len(new) > KNOWN_WORDS:
            self._forget()
            new = list(dict.fromkeys(words))
        if new:
            start, end = len(self.place), len(self.place) + len(new)
            if end > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(end, 2 * len(self.table)) - len(self.table),
                                                                   self.width), np.float32)])
            self.table[start:end] = self.model.responses(new)
            self.place.update(zip(new, range(start, end)))
        return self.table[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]

    def pooled(self, text: str) -> np.ndarray:
        words, overlap = words_of(text), max(WIDTHS) - 1
        best = self.model.pooled(self._rows(words[:PIECE]))
        for at in range(PIECE - overlap, len(words) - overlap, PIECE - overlap):
            best = np.maximum(best, self.model.pooled(self._rows(words[at:at + PIECE])))
        return best

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant)
        return self.model.score(np.stack([self.pooled(t) for t in texts])) if texts else np.zeros(0)


def _batch_words(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of several texts in one array, with empty words (0) between them, and where each text starts."""
    gap = np.zeros(max(WIDTHS) - 1, np.int64)
    parts, starts, at = [gap], [], len(gap)
    for t in texts:
        starts.append(at)
        parts += [t, gap]
        at += len(t) + len(gap)
    return np.concatenate(parts), np.array(starts)


class Learner:
    """Parameters of a model and their Adagrad sums."""

    def __init__(self, seen: np.ndarray, seed: int):
        rng, n = np.random.default_rng(seed), len(WIDTHS) * FILTERS
        self.rng = rng
        self.emb = np.zeros((BUCKETS, DIM), np.float32)
        self.emb[seen] = rng.normal(0, 0.1, (len(seen), DIM))
        self.emb[0] = 0
        self.known = np.zeros(BUCKETS, bool)
        self.known[seen] = True
        self.filters = [rng.normal(0, 0.3, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.bias = np.zeros(n, np.float32)
        self.weights, self.offset = rng.normal(0, 0.3, n), 0.0
        self.sums = {"emb": np.full((BUCKETS, 1), 1e-6, np.float32), "w": np.full(n, 1e-6), "o": 1e-6,
                     "b": np.full(n, 1e-6), "f": [np.full(f.shape, 1e-6) for f in self.filters]}

    def model(self) -> Model:
        return Model(self.emb, self.filters, self.bias, self.weights, self.offset)

    def dense(self) -> np.ndarray:
        """All parameters but the embeddings in one array."""
        return np.concatenate([*[f.ravel() for f in self.filters], self.bias, self.weights, [self.offset]]).astype(np.float64)

    def add_dense(self, change: np.ndarray) -> None:
        at = 0
        for f in [*self.filters, self.bias, self.weights]:
            f += change[at:at + f.size].reshape(f.shape).astype(f.dtype)
            at += f.size
        self.offset += float(change[at])

    def step(self, docs: list[np.ndarray], y: np.ndarray, features: np.ndarray, class_weight: dict, rate: float) -> None:
        """One batch: word numbers of each text, its labels, and the features of the numbered words."""
        n_filters = len(WIDTHS) * FILTERS
        words, starts = _batch_words(docs)
        distinct, at_word = np.unique(words, return_inverse=True)
        lengths = np.array([len(d) for d in docs])
        x = self.emb[features[distinct]].sum(1)[at_word]
        pooled, places = np.zeros((len(docs), n_filters), np.float32), np.zeros((len(docs), n_filters), np.int64)
        for w, k in enumerate(WIDTHS):
            z = sum(x[j:len(x) - k + 1 + j] @ self.filters[w][j] for j in range(k))
            for d, (s, n) in enumerate(zip(starts, lengths)):
                if n:
                    window = z[s - (k - 1):s + n]
                    best = window.argmax(0)
                    pooled[d, w * FILTERS:(w + 1) * FILTERS] = window[best, np.arange(FILTERS)]
                    places[d, w * FILTERS:(w + 1) * FILTERS] = best + s - (k - 1)
        active = (pooled + self.bias > 0) & (lengths > 0)[:, None]
        hidden = np.where((lengths > 0)[:, None], np.maximum(pooled + self.bias, 0), np.maximum(self.bias, 0))
        p = 1 / (1 + np.exp(-np.clip(hidden @ self.weights + self.offset, -60, 60)))
        g = (p - y) * np.where(y == 1, class_weight[1.0], class_weight[0.0]) / len(docs)
        back = np.where(active, g[:, None] * self.weights[None], 0).astype(np.float32)
        grad_w, grad_o = hidden.T @ g + DECAY * self.weights, float(g.sum())
        self.sums["w"] += grad_w ** 2
        self.sums["o"] += grad_o ** 2
        grad_b = back.sum(0)
        self.sums["b"] += grad_b ** 2
        doc, unit = np.nonzero(back)
        value, place = back[doc, unit], places[doc, unit]
        rows, grads = [], []
        for w, k in enumerate(WIDTHS):
            own = unit // FILTERS == w
            f, v, where = unit[own] % FILTERS, value[own], place[own]
            grad_f = np.zeros(self.filters[w].shape)
            for j in range(k):
                np.add.at(grad_f[j].T, f, v[:, None] * x[where + j])
                rows.append(features[words[where + j]])
                grads.append(v[:, None] * self.filters[w][j].T[f])
            grad_f += DECAY * self.filters[w]
            self.sums["f"][w] += grad_f ** 2
            self.filters[w] -= (rate * grad_f / np.sqrt(self.sums["f"][w])).astype(np.float32)
        if rows:
            touched, slot = np.unique(np.concatenate(rows).ravel(), return_inverse=True)
            grad_e = np.zeros((len(touched), DIM), np.float32)
            np.add.at(grad_e, slot, np.repeat(np.concatenate(grads), FEATURES, 0))
            self.sums["emb"][touched] += (grad_e ** 2).mean(1, keepdims=True)
            self.emb[touched] -= rate * grad_e / np.sqrt(self.sums["emb"][touched])
            self.emb[0] = 0
        self.weights = self.weights - rate * grad_w / np.sqrt(self.sums["w"])
        self.bias -= (rate * grad_b / np.sqrt(self.sums["b"])).astype(np.float32)
        self.offset -= rate * grad_o / np.sqrt(self.sums["o"])


def train(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    """Fit the classifier by Adagrad on the logistic loss; classes weigh the same in sum."""
    learner = start(texts, labels, seed)
    if learner is not None:
        return learner.model()
    n_filters = len(WIDTHS) * FILTERS
    return Model(np.zeros((BUCKETS, DIM), np.float32), [np.zeros((k, DIM, FILTERS), np.float32) for k in WIDTHS],
                 np.zeros(n_filters, np.float32), np.zeros(n_filters), 0.0, float(np.mean(labels)) if len(labels) else 0.5)


def start(texts: list[str], labels: list[int], seed: int = 11) -> Learner | None:
    """What some texts teach; None without both classes."""
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        return None
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number) + 1) for w in words_of(t)], np.int64) for t in texts]
    features = np.array([(0,) * FEATURES, *map(_features, number)], np.int64)
    learner = Learner(np.unique(features), seed)
    class_weight = {c: len(y) / (2 * max(1, (y == c).sum())) for c in (0.0, 1.0)}
    epochs = min(MOST_EPOCHS, max(EPOCHS, -(-STEPS * BATCH // len(docs))))
    for epoch in range(epochs):
        order = learner.rng.permutation(len(docs))
        rate = RATE * (1 - epoch / (epochs + 1))
        for at in range(0, len(order), BATCH):
            some = order[at:at + BATCH]
            learner.step([docs[i] for i in some], y[some], features, class_weight, rate)
    return learner


def _first_values(seed: int) -> np.ndarray:
    """What embeddings start from that the start has not seen."""
    return np.random.default_rng(seed + 1).normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)


def learn_shares(rows: DataFrame, learner: Learner, class_weight: dict, seed: int = 11) -> Learner:
    """Every row (``share, mix, text, y``) is learnt once, share by share; the shares' changes are averaged.

    An embedding takes the mean over the shares that hold it.
    """
    spark = rows.sparkSession
    shipped = spark.sparkContext.broadcast(learner)  # BUCKETS * DIM floats, whatever the input
    n_slices = BUCKETS // SLICE

    def learn(batches):
        begun, first = shipped.value, _first_values(seed)
        base = np.where(begun.known[:, None], begun.emb, first)
        base[0] = 0
        total, dense, shares = np.zeros((BUCKETS, DIM + 1), np.float32), np.zeros(len(begun.dense()) + 1), 0
        own, now, texts, labels, number, features = None, None, [], [], {}, None

        def flush():
            nonlocal number, features
            if not texts:
                return
            words = [words_of(t) for t in texts]
            if len(number) > KNOWN_WORDS:
                number, features = {}, None
            new = [w for w in dict.fromkeys(w for d in words for w in d) if w not in number]
            number.update(zip(new, range(len(number) + 1, len(number) + 1 + len(new))))
            if features is None:
                features = np.zeros((1, FEATURES), np.int64)
            if new:
                if len(number) + 1 > len(features):
                    features = np.concatenate([features, np.zeros((max(len(number) + 1, 2 * len(features)) - len(features), FEATURES), np.int64)])
                features[len(number) + 1 - len(new):len(number) + 1] = [_features(w) for w in new]
            docs = [np.array([number[w] for w in d], np.int64) for d in words]
            at = np.unique(np.concatenate([np.zeros(0, np.int64), *docs]))
            own.known[features[at].ravel()] = True
            own.step(docs, np.array(labels, np.float64), features, class_weight, SHARE_RATE)
            texts.clear()
            labels.clear()

        def close():
            nonlocal shares
            if own is None:
                return
            flush()
            held = own.known
            total[held, :DIM] += own.emb[held] - base[held]
            total[held, DIM] += 1
            dense[:-1] += own.dense() - begun.dense()
            shares += 1

        for batch in batches:
            for share, text, y in zip(*[c.to_pylist() for c in batch.columns]):
                if share != now:
                    close()
                    own, now = copy.deepcopy(begun), share
                    own.emb, own.known = base.copy(), np.zeros(BUCKETS, bool)
                texts.append(text)
                labels.append(y)
                if len(texts) == BATCH or sum(map(len, texts)) > BATCH * SAMPLE_CHARS:
                    flush()
        close()
        if shares:
            dense[-1] = shares
            parts = [*(total[k * SLICE:(k + 1) * SLICE].tobytes() for k in range(n_slices)), dense.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(range(n_slices + 1), pa.int32()), pa.array(parts, pa.binary())], names=["at", "sums"])

    def added(batches):
        sums = {}
        for batch in batches:
            for at, part in zip(*[c.to_pylist() for c in batch.columns]):
                part = np.frombuffer(part, np.float64 if at == n_slices else np.float32)
                sums[at] = sums[at] + part if at in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())],
                                             names=["at", "sums"])

    kind = "at int, sums binary"
    found = (rows.select("share", "mix", "text", "y").sortWithinPartitions("share", "mix").select("share", "text", "y").mapInArrow(learn, kind)
             .repartition(n_slices, "at").mapInArrow(added, kind).collect())  # as large as the model
    out, first = copy.deepcopy(learner), _first_values(seed)
    for r in found:
        if r["at"] == n_slices:
            dense = np.frombuffer(r["sums"])
            out.add_dense(dense[:-1] / dense[-1])
            continue
        part = np.frombuffer(r["sums"], np.float32).reshape(SLICE, DIM + 1)
        at = np.flatnonzero(part[:, DIM]) + r["at"] * SLICE
        change = part[at - r["at"] * SLICE]
        out.emb[at] = np.where(out.known[at, None], out.emb[at], first[at]) + change[:, :DIM] / change[:, DIM:]
        out.known[at] = True
    out.emb[0] = 0
    return out


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """Threshold with the best mean of both classes' recall; the middle of the gap it lies in."""
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], labels[order]
    below_toxic = np.concatenate([[0], np.cumsum(y)])
    below_clean = np.concatenate([[0], np.cumsum(1 - y)])
    balance = (1 - below_toxic / max(1, y.sum())) + below_clean / max(1, (1 - y).sum())
    cut = np.concatenate([[True], s[1:] > s[:-1], [True]])
    at = int(np.where(cut, balance, -1).argmax())
    low, high = (0.0 if at == 0 else s[at - 1]), (1.0 if at == len(s) else s[at])
    return float((low + high) / 2)


def thresholds(scores: np.ndarray, labels: np.ndarray, langs: list[str | None]) -> tuple[dict[str, float], float]:
    """A threshold per language with enough documents of both classes, and one for the rest."""
    langs_ = np.array([x or "" for x in langs], object)
    enough = lambda y: min(y.sum(), (1 - y).sum()) >= CALIBRATION
    rest = best_threshold(scores, labels) if enough(labels) else 0.5
    per = {}
    for lang in sorted({x for x in langs if x}):
        own = langs_ == lang
        if enough(labels[own]):
            per[lang] = best_threshold(scores[own], labels[own])
    return per, rest


def spread_thresholds(scored: DataFrame) -> tuple[dict[str, float], float]:
    """``thresholds`` of a table ``lang, score, y`` of any size."""
    everything = scored.select(F.lit("").alias("lang"), "score", "y")
    own = scored.where("lang <> ''").select("lang", "score", "y")
    counts = everything.unionAll(own).groupBy("lang", "score").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    counts = cut_lineage(counts)
    sizes = (counts.groupBy("lang").agg(F.sum("t").alias("all_t"), F.sum("c").alias("all_c"))
             .where(F.least("all_t", "all_c") >= CALIBRATION))
    run = running_sums(counts, ["lang"], ["score"], {"below_t": F.col("t"), "below_c": F.col("c")}).join(sizes, "lang")
    balance = 1 - F.col("below_t") / F.col("all_t") + F.col("below_c") / F.col("all_c")
    best = run.groupBy("lang").agg(F.max(F.struct(balance.alias("b"), (-F.col("score")).alias("s"))).alias("m")).select(
        "lang", (-F.col("m.s")).alias("high"))
    cuts = (counts.join(best, "lang").groupBy("lang", "high")
            .agg(F.max(F.when(F.col("score") < F.col("high"), F.col("score"))).alias("low")).collect())  # one row per language
    per = {r["lang"]: ((r["low"] or 0.0) + r["high"]) / 2 for r in cuts}
    return {k: v for k, v in sorted(per.items()) if k}, per.get("", 0.5)


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, label_col: str) -> DataFrame:
    """``share, mix, id, text, lang, y, back``: every labelled document outside the held-out fold, once."""
    key = F.col(id_col).cast("string")
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (F.crc32(key) % FOLDS != 0))
    # one label per id: a document that carries both counts as toxic
    marked = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    n = marked.count()
    shares = max(1, -(-n // SHARE_DOCS))
    if n <= BROADCAST_IDS:
        marked = F.broadcast(marked)
    mix = F.xxhash64("id")
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                         F.col(lang_col).cast("string").alias("lang"))
    rows = (chosen.join(marked, "id").withColumn("share", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(shares)).cast("int"))
            .repartition(shares, "share").groupBy("share", "id").agg(F.min(F.struct("text", "lang")).alias("d"), F.max("y").alias("y")))
    return cut_lineage(rows.select("share", mix.alias("mix"), "id", "d.text", "d.lang", "y",
                                   (F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(5)) == 4).alias("back")))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        label_col: str = "toxic") -> tuple[Model, dict[str, float], float]:
    """The classifier from all labelled documents, and its thresholds from all that are kept back of them."""
    rows = _labelled(docs, labels, id_col, text_col, lang_col, label_col)
    train_rows, back = rows.where("not back"), rows.where("back")
    look = [F.count("*").alias("n"), F.sum("y").alias("toxic"), F.max(F.length("text")).alias("longest")]
    facts = train_rows.agg(*look).first()
    if facts["toxic"] in (None, 0, facts["n"]):  # a handful of documents: none can be spared
        train_rows, facts = rows, rows.agg(*look).first()
    begin = []
    for value, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        own = train_rows.where(F.col("y") == value)
        last = own.select("mix").orderBy("mix").limit(most).agg(F.max("mix")).first()[0]  # only these rows' texts travel
        begin += own.where(F.col("mix") <= F.lit(last)).select("id", F.left("text", F.lit(SAMPLE_CHARS)).alias("text"), "y").collect()
    begin.sort(key=lambda r: crc32(str(r["id"]).encode()))
    texts, ys = [r["text"] for r in begin], [r["y"] for r in begin]
    learner = start(texts, ys)
    if learner is None:
        return train(texts, ys), {}, 0.5
    if len(begin) < facts["n"] or facts["longest"] > SAMPLE_CHARS:
        learner = learn_shares(train_rows, learner, {1.0: facts["n"] / (2 * facts["toxic"]),
                                                     0.0: facts["n"] / (2 * (facts["n"] - facts["toxic"]))})
    model = learner.model()
    per, default = spread_thresholds(cut_lineage(_scored(back, model, "lang string, y int")))
    return model, per, default


def _scored(rows: DataFrame, model: Model, kept: str) -> DataFrame:
    """The columns ``kept`` of the rows and the ``score`` of their ``text``."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)  # BUCKETS * DIM floats, whatever the input
    names = [c.split(" ")[0] for c in kept.split(", ")]

    def score(batches):
        scorer = Scorer(shipped.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(names)], pa.array(scorer.scores(texts), pa.float64())], names=[*names, "score"])

    return rows.select(*names, "text").mapInArrow(score, f"{kept}, score double")


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   lang_col: str = "lang", label_col: str = "toxic") -> DataFrame:
    """One row per document: ``id_col, held_out, score, predicted, threshold, flagged``.

    ``score`` comes from the whole text alone; ``predicted`` cuts it at 0.5, ``flagged`` at the threshold of
    the document's language (a common one for null or rare languages).  Labels are learnt from ids whose
    crc32 modulo 5 is not 0.  Null texts count as empty and score like any text without words; a null id is
    never learnt from and not held out; repeated rows score alike; an empty table gives no rows, and without
    labels of both classes every score is the share of toxic ones (0.5 without any).  Columns other than the
    named ones are not read, whatever their names.
    """
    model, per, default = fit(docs, labels, id_col, text_col, lang_col, label_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _scored(docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
                               F.col(text_col).cast("string").alias("text")), model, f"id {kind}, lang string")
    table = F.create_map(*[F.lit(x) for pair in per.items() for x in pair]) if per else F.create_map(F.lit(""), F.lit(default))
    threshold = F.coalesce(table[F.coalesce("lang", F.lit(""))], F.lit(default))
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % FOLDS == 0, F.lit(False))
    return rows.select(F.col("id").alias(id_col), held_out.alias("held_out"), "score",
                       F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
                       threshold.alias("threshold"), (F.col("score") >= threshold).alias("flagged"))
