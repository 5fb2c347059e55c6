"""Language-model scores from n-gram tries in Elias-Fano code.

Texts are dealt into blocks of bounded size.  A block lists its distinct n-grams
with their counts in its training documents; lists are summed by ranges of the
n-grams' hashes, over the whole corpus, and every block gets the totals of its
own n-grams back.  With them a block builds a trie of just what its texts ask
for, writes the levels to files, maps these, and scores its texts by lookup.  No
task holds the model of the corpus.
"""

import os
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored

ORDER = 3                    # longest n-gram
BLOCK_BYTES = 12_000_000     # text of a block, but for one longer document
RANGE_KEYS = 2_000_000       # n-grams summed by one task, about
PRIOR = 1000.0               # weight of the shorter context, in observations
FOLDS, TEST_FOLD = 5, 1
END = b" "                   # no word holds a space

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and the number of each value among them, by one sort."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.empty(len(values), bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    number = np.empty(len(values), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], number


def _squeeze(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _expand(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _squeeze_sorted(keys: np.ndarray) -> bytes:
    return _squeeze(np.diff(keys, prepend=np.uint64(0)))


def _expand_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_expand(data), dtype=np.uint64)


class EliasFano:
    """A non-decreasing sequence of whole numbers, in files that are mapped.

    The low bytes of a number are stored as they are.  The high part is a bit
    string: number i sets bit (high + i), so the zeros close buckets of equal high
    part.  A directory keeps where every 4096th zero lies.
    """

    STEP = 4096

    def __init__(self, folder: str, name: str, values: np.ndarray, top: int):
        self.n = len(values)
        per = max(1, top // max(1, self.n))
        self.low_bytes = max(0, round((per.bit_length() - 1) / 8))
        shift = np.uint64(8 * self.low_bytes)
        values = values.astype(np.uint64)
        high = (values >> shift).astype(np.int64)
        self.buckets = (top >> int(shift)) + 1
        low = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :self.low_bytes]
        bits = np.zeros(self.n + self.buckets, np.uint8)
        bits[high + np.arange(self.n)] = 1
        zeros = np.flatnonzero(bits == 0)
        self.zeros = np.concatenate([zeros[self.STEP - 1::self.STEP], [len(bits)]])
        self.low = self._mapped(os.path.join(folder, name + ".low"), low)
        self.bits = self._mapped(os.path.join(folder, name + ".bits"), np.packbits(bits, bitorder="little"))

    @staticmethod
    def _mapped(path: str, data: np.ndarray) -> np.ndarray:
        np.ascontiguousarray(data).tofile(path)
        return np.memmap(path, data.dtype, "r", shape=data.shape) if data.size else data

    def _value_low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for b in range(self.low_bytes):
            out |= self.low[at, b].astype(np.uint64) << np.uint64(8 * b)
        return out

    def _chunks(self):
        """``(first bucket, starts)``: where the buckets of each piece of the bit string begin."""
        bit, first = 0, 0
        for k, stop in enumerate(self.zeros):
            last = min((k + 1) * self.STEP, self.buckets)
            lo = bit // 8 * 8
            bits = np.unpackbits(self.bits[lo // 8:(int(stop) + 8) // 8], bitorder="little")[bit - lo:int(stop) + 1 - lo]
            if len(bits) > stop + 1 - bit:
                bits = bits[:stop + 1 - bit]
            closes = np.flatnonzero(bits == 0)[:last - first] + bit
            ends = closes - np.arange(first, first + len(closes))   # numbers up to the end of each bucket
            yield first, np.concatenate([[bit - first], ends])
            first += len(closes)
            bit = int(stop) + 1
            if first >= self.buckets:
                return

    def values(self) -> np.ndarray:
        out = np.empty(self.n, np.uint64)
        for first, starts in self._chunks():
            span = np.arange(starts[0], starts[-1])
            high = first + np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            out[span] = (high.astype(np.uint64) << np.uint64(8 * self.low_bytes)) | self._value_low(span)
        return out

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of the first number >= each of ``wanted`` (ascending), by successor search in its bucket."""
        wanted = wanted.astype(np.uint64)
        shift = np.uint64(8 * self.low_bytes)
        high = (wanted >> shift).astype(np.int64)
        low = wanted & ((np.uint64(1) << shift) - np.uint64(1)) if self.low_bytes else np.zeros(len(wanted), np.uint64)
        out = np.full(len(wanted), self.n, np.int64)
        for first, starts in self._chunks():
            a, b = np.searchsorted(high, [first, first + len(starts) - 1])
            if a == b:
                continue
            left, right = starts[high[a:b] - first], starts[high[a:b] - first + 1]
            while True:
                open_ = left < right
                if not open_.any():
                    break
                middle = (left + right) // 2
                less = np.zeros(len(left), bool)
                less[open_] = self._value_low(middle[open_]) < low[a:b][open_]
                left = np.where(open_ & less, middle + 1, left)
                right = np.where(open_ & ~less, middle, right)
            out[a:b] = left
        return out


class Quantiser:
    """Logarithms in 16 bits between their least and largest value."""

    def __init__(self, logs: np.ndarray):
        self.low = float(logs.min()) if len(logs) else 0.0
        self.step = max((float(logs.max()) - self.low) / 65535, 1e-12) if len(logs) else 1.0
        self.codes = np.round((logs - self.low) / self.step).astype("<u2")

    def __getitem__(self, at):
        return self.low + self.step * self.codes[at]


class Trie:
    """N-grams of a block with a training count, level by level.

    A node is found below its context: the successors of a context are adjacent,
    monotone pointers tell where they begin, and a successor is searched among
    them.  From the third level on a successor is named by its rank among those
    of the context's last word, a smaller number than its word.
    """

    def __init__(self, folder: str, n_words: int):
        self.folder, self.n_words = folder, n_words
        self.levels: list[dict] = []

    def add(self, context: np.ndarray, word: np.ndarray, logs: np.ndarray, n_contexts: int, width: int) -> None:
        """A level from nodes sorted by (context, word); ``width`` is over every word number."""
        name = str(len(self.levels))
        code = context.astype(np.uint64) * np.uint64(width) + word.astype(np.uint64)
        pointers = np.concatenate([[0], np.cumsum(np.bincount(context, minlength=n_contexts))])
        quantiser = Quantiser(logs)
        quantiser.codes = EliasFano._mapped(os.path.join(self.folder, name + ".logs"), quantiser.codes)
        self.levels.append({"nodes": EliasFano(self.folder, name, code, n_contexts * width + 1), "width": width,
                            "pointers": EliasFano(self.folder, name + ".ptr", pointers, len(context) + 1), "logs": quantiser,
                            "n": len(context)})

    def find(self, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Node numbers of (context, word) pairs, or -1; any order."""
        if not len(context):
            return np.empty(0, np.int64)
        of = self.levels[level]
        code = context.astype(np.uint64) * np.uint64(of["width"]) + word.astype(np.uint64)
        asked, back = (code, slice(None)) if (code[1:] > code[:-1]).all() else _numbered(code)
        at = of["nodes"].find(asked)
        ends = of["pointers"].values()
        ctx = (asked // np.uint64(of["width"])).astype(np.int64)
        inside = (at >= ends[ctx]) & (at < ends[ctx + 1])      # never past the successors of the context
        # the successor is the node itself when the next number would lie behind it
        hit = np.zeros(len(asked), bool)
        hit[inside] = of["nodes"].find(asked[inside] + np.uint64(1)) > at[inside]
        return np.where(hit, at, -1)[back]


def _tokenised(block_bytes: int):
    """Texts to blocks of word numbers; words are numbered by the order of their hashes."""
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
    names = ["block", "docs", "held", "lengths", "n_tokens", "tokens", "words"]

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        numbers: dict[bytes, int] = {}
        docs, held, parts, size = [], [], [], 0

        def out():
            nonlocal block, numbers, docs, held, parts, size
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
            words, rank = np.unique(hashes, return_inverse=True)
            tokens = rank[np.concatenate(parts)]
            row = [block, docs, held, [len(p) for p in parts], len(tokens), _squeeze(tokens), _squeeze_sorted(words)]
            block += 1
            numbers, docs, held, parts, size = {}, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                for doc, test, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    data = (text or "").encode()
                    if docs and size + len(data) > block_bytes:
                        yield out()
                    add = numbers.setdefault
                    words = [add(w, len(numbers)) for w in data.lower().split()]
                    words.append(add(END, len(numbers)))
                    docs.append(doc)
                    held.append(test)
                    parts.append(np.array(words, np.int64))
                    size += len(data)
        if docs:
            yield out()
    return run, names


class Block:
    """Tokens of a block and, for each level, its distinct n-grams.

    An n-gram is its context's number one level lower and its last word; a text
    begins in the context of an end.
    """

    def __init__(self, row, order: int):
        self.docs, self.lengths = row["docs"], np.asarray(row["lengths"], np.int64)
        self.held = np.asarray(row["held"], bool)
        self.tokens = _expand(row["tokens"]).astype(np.int64)
        self.words = _expand_sorted(row["words"])
        self.train = ~np.repeat(self.held, self.lengths)
        first = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        end = self.tokens[-1]
        self.rank = [self.tokens]           # at each token, the number of the n-gram that ends there
        self.codes = [np.arange(len(self.words))]
        self.keys = [self.words]
        start = end                          # number of the n-gram before a text
        for n in range(2, order + 1):
            before = np.empty(len(self.tokens), np.int64)
            before[1:] = self.rank[-1][:-1]
            before[first] = start
            code = before * len(self.words) + self.tokens
            # the n-gram of ends alone is the context of a text's first words
            codes, rank = _numbered(np.append(code, start * len(self.words) + end))
            start = int(rank[-1])
            context, word = np.divmod(codes, len(self.words))
            self.keys.append(_mix(self.keys[-1][context] * _MULTIPLY + self.words[word] + np.uint64(n)))
            self.codes.append(codes)
            self.rank.append(rank[:-1])

    def counts(self, level: int) -> np.ndarray:
        return np.bincount(self.rank[level][self.train], minlength=len(self.codes[level]))


def _parts(keys: np.ndarray, n_ranges: int):
    """``(range, positions)``: the places of a level's n-grams, by hash within equal ranges of hashes."""
    order = np.argsort(keys)
    width = (1 << 64) // n_ranges + 1
    cuts = np.searchsorted(keys[order], np.array([i * width for i in range(1, n_ranges)], np.uint64))
    return [(i, p) for i, p in enumerate(np.split(order, cuts)) if len(p)]


def _listed(order: int, n_ranges: int):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = ["level", "range", "block", "keys", "counts"]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, order)
                for level in range(order):
                    counts = block.counts(level)
                    for part, at in _parts(block.keys[level], n_ranges):
                        values = [level, part, row["block"], _squeeze_sorted(block.keys[level][at]), _squeeze(counts[at])]
                        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)
    return run


def _summed(lists: pd.DataFrame) -> pd.DataFrame:
    """What the other blocks count in one range of one level, handed back to each block in the block's order.

    A block adds its own counts.  Most long n-grams occur in one block, and their
    zeros take no room.
    """
    lists = lists.sort_values("block")
    keys = [_expand_sorted(k) for k in lists["keys"]]
    own = np.concatenate([_expand(c) for c in lists["counts"]]).astype(np.int64)
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, own).astype(np.int64)
    backs = np.split(total[place] - own, np.cumsum([len(k) for k in keys])[:-1])
    return pd.DataFrame({
        "level": lists["level"], "range": lists["range"], "block": lists["block"], "others": [_squeeze(b) for b in backs],
        "n": [int(total.sum())] + [0] * (len(lists) - 1), "distinct": [int((total > 0).sum())] + [0] * (len(lists) - 1)})


def score_block(block: Block, totals: list[np.ndarray], n: int, distinct: int, prior: float, folder: str) -> pd.DataFrame:
    """Scores of the documents of a block; ``totals`` has the corpus counts of each level's n-grams."""
    n_words, order = len(block.words), len(totals)
    unigram = np.log10((totals[0] + 0.5) / (n + 0.5 * (distinct + 1)))
    trie = Trie(folder, n_words)
    logs = [unigram]                          # of each listed n-gram, smoothed by its shorter forms
    names: list = [None]                      # by what number a context knows it
    for level in range(1, order):
        context, word = np.divmod(block.codes[level], n_words)
        suffix = _suffix(block, level)
        shorter = 10.0 ** logs[level - 1][suffix]
        # an end is followed by the first word of the next text, so a context's total counts its successors
        above = totals[level - 1][context]
        logs.append(np.log10((totals[level] + prior * shorter) / (above + prior)))
        there = totals[level] > 0
        label, width = word, n_words
        if level > 1:
            # rank among the successors of the context's last word
            starts = np.searchsorted(block.codes[1], np.arange(n_words + 1) * n_words)
            pair = _suffix_pair(block, level)
            label = pair - starts[block.codes[1][pair] // n_words]
            width = int(np.diff(starts).max()) + 1
        trie.add(context[there], label[there], logs[level][there], len(block.codes[level - 1]), width)
        names.append(label.astype(np.int32))
    del logs
    first = Quantiser(unigram)
    picked = first[block.rank[0]]
    for level in range(1, order):
        at = block.rank[level]
        context = block.codes[level] // n_words
        found = trie.find(level - 1, context, names[level])
        # without a node the shorter form is weighed by what the context leaves to it
        rest = np.log10(prior / (totals[level - 1] + prior))[context][at] + picked
        value = trie.levels[level - 1]["logs"][np.maximum(found, 0)] if trie.levels[level - 1]["n"] else np.zeros(len(found))
        picked = np.where(found[at] >= 0, value[at], rest)
    cuts = np.concatenate([[0], np.cumsum(block.lengths)[:-1]])

    def per_text(values):
        return np.add.reduceat(values, cuts)
    return pd.DataFrame({
        "doc_id": pd.array(block.docs, dtype="Int64"), "held_out": block.held, "n_tokens": block.lengths,
        "n_known": per_text((totals[0] > 0)[block.rank[0]].astype(np.int64)), "train_tokens": n,
        "base_score": per_text(unigram[block.rank[0]]), "score": per_text(picked)})


def _suffix(block: Block, level: int) -> np.ndarray:
    """For each n-gram of a level, the number of the n-gram without its first word."""
    out = np.zeros(len(block.codes[level]), np.int64)
    out[block.rank[level]] = block.rank[level - 1]
    # the n-gram of ends alone occurs in no text
    there = np.zeros(len(out), bool)
    there[block.rank[level]] = True
    ends = np.flatnonzero(~there)
    end = block.tokens[-1]
    code = int(end)
    for n in range(1, level):
        code = int(np.searchsorted(block.codes[n], code * len(block.words) + end))
    out[ends] = code
    return out


def _suffix_pair(block: Block, level: int) -> np.ndarray:
    out = _suffix(block, level)
    for n in range(level - 1, 1, -1):
        out = _suffix(block, n)[out]
    return out


def _scored(order: int, n_ranges: int, n: int, distinct: int, prior: float):
    def run(block_rows: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        block = Block(block_rows.iloc[0], order)
        totals = []
        del block_rows
        for level in range(order):
            level_sums = sums[sums["level"] == level].set_index("range")["others"]
            total = block.counts(level)
            for part, at in _parts(block.keys[level], n_ranges):
                total[at] += _expand(level_sums[part]).astype(np.int64)
            totals.append(total)
            block.keys[level] = None         # not asked for any more
        with tempfile.TemporaryDirectory(prefix="trie-") as folder:
            return score_block(block, totals, n, distinct, prior, folder)
    return run


def score_texts(docs: DataFrame, order: int = ORDER, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Documents whose crc32 of the id falls in the test fold are scored, not
    learned from.  Tokens are words, A-Z lowered, and an end.  ``base_score`` is
    the sum of smoothed unigram logarithms, ``score`` that of an interpolated
    model: counts of an n-gram, and ``prior`` observations dealt out by the model
    one word shorter.  A null or empty text is an end alone; a null id counts as
    an empty one; repeated rows are texts of their own; an empty table gives an
    empty one.
    """
    run, _ = _tokenised(block_bytes)
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    blocks = stored(docs.select(F.col("doc_id").cast("long"), (fold == TEST_FOLD).alias("held"), F.col("text").cast("string"))
                    .mapInArrow(run, "block long, docs array<long>, held array<boolean>, lengths array<long>, "
                                     "n_tokens long, tokens binary, words binary"), "blocks")
    tokens = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    n_ranges = max(1, -(-tokens // RANGE_KEYS))
    lists = blocks.mapInArrow(_listed(order, n_ranges), "level long, range long, block long, keys binary, counts binary")
    sums = stored(lists.groupBy("level", "range").applyInPandas(
        _summed, "level long, range long, block long, others binary, n long, distinct long"), "totals")
    n, distinct = sums.where("level = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    return blocks.groupBy("block").cogroup(sums.groupBy("block")).applyInPandas(
        _scored(order, n_ranges, n, distinct, prior),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
