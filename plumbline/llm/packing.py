"""Packing of token ids into fixed windows by sum-of-squares online placement.

Every task packs the rows it reads; nothing is shuffled.  The state of a task is
a level array (how many open windows hold h tokens, for every h) and the open
windows, whose number is bounded.
"""

import os
import sys
import unicodedata
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
WINDOW, END = 4096, 2
OPEN_WINDOWS = 4096
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_CACHED_WORDS = 1_200_000
# Fixed value: how the vocabulary cuts text without white space.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class WordEncoder:
    """Token ids of texts as little-endian 32-bit bytes, with a memo of words.

    The vocabulary drops white space and never joins across it, so the ids of a
    text are those of its pieces between white space, one after the other.  A
    piece of Latin letters and ASCII is cut further, as the vocabulary's own
    pattern cuts it, and its parts go to the vocabulary's model; other pieces are
    encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on every core already
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        assert sys.byteorder == "little" and array("I").itemsize == 4
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def __call__(self, texts: list[str | bytes | None]) -> list[bytes]:
        words = [(t if isinstance(t, bytes) else t.encode()).split() if t else [] for t in texts]
        self.learn(set().union(*words))
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in words]

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > _CACHED_WORDS:
            self.known.clear()
            new = words
        if len(self.parts) > _CACHED_WORDS // 2:
            self.parts.clear()
        cut, whole = {}, {}
        for w in new:
            ps = _cut(w.decode())
            if ps is None:
                whole[w] = w.decode()
            else:
                cut[w] = ps
        # parts are normalised and cut already, so the vocabulary's model alone is asked
        tokenize = self.tokenizer.model.tokenize
        for p in {p for ps in cut.values() for p in ps}.difference(self.parts):
            spelled = p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(_BYTE_NAMES)
            self.parts[p] = array("I", [token.id for token in tokenize(spelled)]).tobytes()
        get = self.parts.__getitem__
        self.known.update((w, b"".join(map(get, ps)) if len(ps) != 1 else get(ps[0])) for w, ps in cut.items())
        found = self.tokenizer.encode_batch_fast(list(whole.values()), add_special_tokens=False)
        self.known.update((w, array("I", e.ids).tobytes()) for w, e in zip(whole, found, strict=True))


def _byte_names() -> dict[int, str]:
    """How a byte-level vocabulary writes bytes: visible ones as themselves, others from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in visible]
    return {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_NAMES = _byte_names()


def _cut(word: str) -> list[str] | None:
    """The normalised parts that the vocabulary's pattern makes of a word; None where the word is left to it."""
    if word.isascii():
        if word.isalpha():
            return [word.lower()]
        if "<|" in word:
            return None
        return _PARTS.findall(word.lower())
    if "<|" in word or "\u0130" in word or max(word) > "\u024f":     # U+0130 has no single lower-case letter
        return None
    return _PARTS.findall(unicodedata.normalize("NFC", word).lower())


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Packer:
    """Places pieces ``(document, start, ids)`` into windows; full ones are handed out.

    A document longer than a window is cut into whole windows and a rest.  The
    rest goes to the level that makes the sum of squared window counts smallest;
    the fullest such level on a tie, a new window only where that is smaller
    still.  Partly filled windows are at last closed by cutting the emptiest up
    to fill the fullest; what remains is cut into powers of two, which need no
    padding.
    """

    def __init__(self, window: int = WINDOW, most_open: int = OPEN_WINDOWS):
        self.window, self.most_open = window, most_open
        self.level = np.zeros(window + 1, np.int64)
        self.at: dict[int, list[list]] = {}
        self.n_open = 0
        self.full: list[list] = []

    def add(self, doc, ids: bytes) -> None:
        size, step = len(ids) // 4, self.window
        whole = size // step * step
        for start in range(0, whole, step):
            self.full.append([(doc, start, ids[4 * start:4 * (start + step)])])
        if whole < size:
            self.place((doc, whole, ids[4 * whole:]), size - whole)
            if self.n_open > self.most_open:
                self.merge()

    def place(self, piece, size: int) -> None:
        count, top = self.level, self.window - size
        after = 2 * count[size + 1:] + 1
        after[-1] = 0  # a full window leaves the count
        change = np.where(count[1:top + 1] > 0, after - 2 * count[1:top + 1] + 1, np.iinfo(np.int64).max)
        best = top - int(np.argmin(change[::-1])) if top else 0
        if top and change[best - 1] <= 2 * count[size] + 1:
            window = self.at[best].pop()
            count[best] -= 1
            self.n_open -= 1
        else:
            best, window = 0, []
        window.append(piece)
        if best + size == self.window:
            self.full.append(window)
        else:
            self.at.setdefault(best + size, []).append(window)
            count[best + size] += 1
            self.n_open += 1

    def merge(self) -> list:
        """Cuts the emptiest open windows up into the fullest; returns what is left open."""
        opened = [(fill, w) for fill in sorted(self.at, reverse=True) for w in self.at[fill]]
        self.level[:] = 0
        self.at, self.n_open = {}, 0
        i, j, left = 0, len(opened) - 1, []
        while i < j:
            fill, window = opened[i]
            donor = opened[j][1]
            doc, start, ids = donor.pop()
            take = min(self.window - fill, len(ids) // 4)
            window.append((doc, start, ids[:4 * take]))
            if 4 * take < len(ids):
                donor.append((doc, start + take, ids[4 * take:]))
            opened[i] = (fill + take, window)
            opened[j] = (opened[j][0] - take, donor)
            if opened[i][0] == self.window:
                self.full.append(window)
                i += 1
            if not donor:
                j -= 1
        if i == j and opened[i][1]:
            fill, left = opened[i]
            if fill == self.window:
                self.full.append(left)
                return []
            self.at, self.n_open = {fill: [left]}, 1
            self.level[fill] = 1
        return left

    def close(self) -> None:
        left = self.merge()
        self.at, self.n_open = {}, 0
        self.level[:] = 0
        size = sum(len(p[2]) for p in left) // 4
        while size:
            room = want = 1 << (size.bit_length() - 1)
            part = []
            while room:
                doc, start, ids = left.pop(0)
                take = min(room, len(ids) // 4)
                part.append((doc, start, ids[:4 * take]))
                if 4 * take < len(ids):
                    left.insert(0, (doc, start + take, ids[4 * take:]))
                room -= take
            self.full.append(part)
            size -= want

    def rows(self):
        """``(document, start, ids, sequence, offset)`` of the windows handed out since the last call."""
        done, self.full = self.full, []
        return done


def _pack(path: str, window: int, end: int):
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        encode, packer = encoder(path), Packer(window)
        sequence = TaskContext.get().partitionId() << 40

        def out():
            nonlocal sequence
            columns = [[] for _ in range(7)]
            for pieces in packer.rows():
                offset = 0
                for (doc, total), start, ids in pieces:
                    for column, value in zip(columns, (doc, start, len(ids) // 4, ids, total, sequence, offset), strict=True):
                        column.append(value)
                    offset += len(ids) // 4
                sequence += 1
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).cast(pa.binary()).to_pylist()), strict=True):
                    ids += tail
                    packer.add((doc, len(ids) // 4), ids)
                yield out()
        packer.close()
        yield out()
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
         window: int = WINDOW, end: int = END) -> DataFrame:
    """The pieces of all documents, with their ids as little-endian 32-bit bytes.

    A document is its token ids and the id ``end``; a null or empty text is that
    id alone.  Every id lies in exactly one piece.  Sequences hold ``window`` ids
    or a power of two.  ``sequence_id`` holds the task and a running number.  A task
    keeps at most ``OPEN_WINDOWS`` open windows; beyond that the emptiest are cut up
    to fill the fullest, with nothing lost.  Texts of any length are packed whole.
    Other columns are left out, whatever their names.
    Repeated rows are packed each on their own; an empty table gives no pieces.
    """
    if vocabulary is None:
        import public_tokenizers
        vocabulary = public_tokenizers.path(VOCABULARY)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(_pack(vocabulary, window, end), SCHEMA)


def pack_table(docs: DataFrame) -> DataFrame:
    """One row per piece, the ids as their checksum."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                             "doc_tokens", "sequence_id", "offset")
