"""Sampled SentencePiece segmentations without replacement, and their decoding.

The lattice of a text holds all ways to write it in pieces of a vocabulary.  The
weight of a piece falls with its rank (Zipf); sums over the lattice make choosing
a piece at a place a conditional probability.  Perturbing the log-probabilities
of whole segmentations by Gumbel noise and keeping the k largest draws k distinct
ones.  A best-first search finds these without listing the others: a set of
segmentations that share a beginning has the noise maximum of its total weight,
and the set with the largest maximum is opened next.

The lattice is built for many texts at once, and what their searches want to
draw next is drawn together.
"""

import heapq
import re
from collections import defaultdict
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "piece_bpe_32k.model"
SAMPLES = 2
# Characters of the texts that share a lattice (a longer text has its own).
LATTICE_CHARS = 500_000
DECODED_ROWS = 500           # samples that are text at a time
SPACE = "▁"
_MULTIPLY, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D)
_SLOTS, _ROWS = 22, 18
_PIECE, _BEGINNING = 1, 2
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
SCHEMA = "doc_id long, digest string, sample int, ids binary, log_prob double, inclusion double"


class Pieces:
    """The vocabulary: pieces, log-weights and a table of their hashes."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        # a unit of the lattice begins at a space; no piece goes on behind one
        assert all(SPACE not in self.text[i].lstrip(SPACE) for i in plain)
        ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.weight = np.full(size, -np.inf)
        self.weight[ranked] = -np.log(np.arange(len(ranked)) + 2.7)
        self.weight -= np.log(np.exp(self.weight[ranked]).sum())
        self.rare = float(self.weight[ranked].min()) - 1.0     # of a byte
        self.longest = max(len(self.text[i]) for i in plain)
        hashes, beginnings = [], set()
        for i in plain:
            of = self._hashes(self.text[i])
            hashes.append(of[-1])
            beginnings.update(of[:-1])
        hashes = np.array(hashes, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(plain, np.int32)[order]
        # by the first bits of a hash: where the search for it begins, and whether a piece, or the beginning of one, can have it
        self.row = np.searchsorted(self.hashes, np.arange(1 << _ROWS, dtype=np.uint64) << np.uint64(64 - _ROWS)).astype(np.int32)
        self.maybe = np.zeros(1 << _SLOTS, np.uint8)
        self.maybe[(self.hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)] |= _PIECE
        beginnings = np.fromiter(beginnings, np.uint64, len(beginnings))
        self.maybe[np.unique(beginnings >> np.uint64(64 - _SLOTS)).astype(np.int64)] |= _BEGINNING
        self.bytes = [t.replace(SPACE, " ").encode() for t in self.text]
        for value, i in self.byte.items():
            self.bytes[i] = bytes([value])

        self.spelled = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.sizes = np.array([len(b) for b in self.bytes])
        self.places = np.cumsum(self.sizes) - self.sizes

    @staticmethod
    def _hashes(piece: str) -> list[int]:
        """Hashes of the beginnings of a piece, of itself last."""
        h, out = int(_START), []
        for c in piece:
            h = (h ^ ord(c)) * int(_MULTIPLY) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
            out.append(h)
        return out

    def place(self, wanted: np.ndarray) -> np.ndarray:
        """Where the first hash >= each of ``wanted`` is, or the last hash."""
        out = np.minimum(self.row[(wanted >> np.uint64(64 - _ROWS)).astype(np.int64)], len(self.hashes) - 1)
        on = np.flatnonzero((self.hashes[out] < wanted) & (out < len(self.hashes) - 1))
        while len(on):
            out[on] += 1
            on = on[(self.hashes[out[on]] < wanted[on]) & (out[on] < len(self.hashes) - 1)]
        return out

    def decode(self, ids: np.ndarray) -> str:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.places[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.spelled[at].tobytes()[1:].decode("utf-8", "replace")


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lattice:
    """All segmentations of distinct units, as choices with cumulative probabilities.

    State s is a place in a unit, numbered by what is left of the unit there; 0 is
    the end of any unit.  Its choices, long pieces first, are numbered first[s] ..
    first[s + 1], and ``cumulative`` holds the probability of the choices up to each.
    """

    def __init__(self, units: list[str], vocabulary: Pieces):
        v, self.units = vocabulary, units
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        chars = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").astype(np.uint64)
        ends = np.cumsum(lengths)
        left = (np.repeat(ends, lengths) - np.arange(len(chars))).astype(np.int32)
        most = int(left.max(initial=0))
        state = np.zeros(len(chars) + 1, np.int32)
        state[np.argsort(left.astype(np.uint16) if most < 1 << 16 else left, kind="stable")] = np.arange(1, len(chars) + 1)
        self.starts = state[ends - lengths]
        found = self._found(chars, left, v)
        counts = np.zeros(len(chars) + 1, np.int64)
        for at, _ in found:
            counts[state[at]] += 1
        self.first = first = np.concatenate([[0], np.cumsum(counts)])
        self.piece, self.to = np.empty(first[-1], np.int32), np.empty(first[-1], np.int32)
        weight, free = np.empty(first[-1]), first[state]
        for size in range(len(found), 0, -1):
            at, ids = found[size - 1]
            choice = free[at]
            free[at] += 1
            self.piece[choice] = ids
            weight[choice] = self._weight(ids, v)
            self.to[choice] = state[at + size] * (left[at] > size)
        self.states = np.repeat(np.arange(len(counts), dtype=np.int32), counts)      # of every choice
        self.prob = self._probabilities(weight, np.bincount(left, minlength=1), counts)
        self.cumulative = self.prob.copy()
        some, j = np.flatnonzero(counts > 1), 1
        while len(some):
            at = first[some] + j
            self.cumulative[at] += self.cumulative[at - 1]
            j += 1
            some = some[counts[some] > j]
        # the last choice of a state takes what rounding leaves
        np.minimum(self.cumulative, 1.0, out=self.cumulative)
        self.cumulative[first[1:][counts > 0] - 1] = 1.0
        with np.errstate(divide="ignore"):
            self.log = np.log(self.prob)
            # of all other choices; where a place has one choice only, nothing leaves
            self.log_rest = np.log(np.where(counts[self.states] > 1, np.maximum(0.0, 1 - self.prob), 0.0))

    @cached_property
    def start(self) -> dict[str, int]:
        return dict(zip(self.units, self.starts.tolist(), strict=True))

    @staticmethod
    def _found(chars: np.ndarray, left: np.ndarray, v: Pieces) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each size, the places where a piece of it begins, and the piece.

        A character without a piece is written in bytes and numbered behind the
        vocabulary.  Places where no longer piece can begin are not looked at again.
        """
        found, at = [], np.arange(len(chars), dtype=np.int32)
        h = (_START ^ chars) * _MULTIPLY
        while len(at):
            size = len(found) + 1
            h ^= h >> np.uint64(29)
            kind = v.maybe[(h >> np.uint64(64 - _SLOTS)).astype(np.int64)]
            likely = np.flatnonzero(kind & _PIECE)
            wanted = h[likely]
            place = v.place(wanted)
            hit = v.hashes[place] == wanted
            here, ids = at[likely[hit]], v.ids[place[hit]]
            if size == 1:
                lacking = np.ones(len(chars), bool)
                lacking[here] = False
                spelled = np.flatnonzero(lacking).astype(np.int32)
                here = np.concatenate([here, spelled])
                ids = np.concatenate([ids, (len(v.text) + chars[spelled].astype(np.int64)).astype(np.int32)])
            found.append((here, ids))
            on = np.flatnonzero((kind & _BEGINNING > 0) & (left[at] > size))
            at = at[on]
            h = (h[on] ^ chars[at + size]) * _MULTIPLY
        return found

    @staticmethod
    def _weight(ids: np.ndarray, v: Pieces) -> np.ndarray:
        out = v.weight[np.minimum(ids, len(v.text) - 1)]
        spelled = np.flatnonzero(ids >= len(v.text))
        code = ids[spelled] - len(v.text)
        out[spelled] = v.rare * (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        return out

    def _probabilities(self, weight: np.ndarray, per_left: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Conditional probabilities of the choices, from log-sums of what can follow a place."""
        after, prob, a = np.zeros(len(counts)), np.empty(len(weight)), 1
        for n in per_left[1:].tolist():
            b = a + n
            if n:
                c, d = self.first[a], self.first[b]
                cuts, per = self.first[a:b] - c, counts[a:b]
                x = weight[c:d] + after[self.to[c:d]]
                top = np.maximum.reduceat(x, cuts)
                x = np.exp(x - np.repeat(top, per))
                total = np.add.reduceat(x, cuts)
                after[a:b] = top + np.log(total)
                prob[c:d] = x / np.repeat(total, per)
            a = b
        return prob

    def walk(self, states: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Choices from each state to the end of its unit, unit after unit, and how many each unit has.

        The draws of a unit hang on its seed alone.
        """
        counts, steps = np.zeros(len(states), np.int64), []
        unit = np.flatnonzero(states)
        states, seeds = states[unit], seeds[unit]
        while len(unit):
            drawn, choice = (_mix(seeds) >> np.uint64(11)) * 2.0 ** -53, self.first[states]
            later = np.flatnonzero(self.cumulative[choice] <= drawn)
            while len(later):       # the last choice of a state has 1
                choice[later] += 1
                later = later[self.cumulative[choice[later]] <= drawn[later]]
            counts[unit] += 1
            steps.append((unit, choice))
            states = self.to[choice]
            on = np.flatnonzero(states)
            unit, states, seeds = unit[on], states[on], seeds[on] + _MULTIPLY
        start = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        for i, (unit, choice) in enumerate(steps):
            out[start[unit] + i] = choice
        return out, counts


def _search(lattice: Lattice, starts: np.ndarray, k: int, rng: np.random.Generator):
    """The search for the samples of a text, see ``sample``.

    It gives out ``(states, seed)`` of a walk it needs and is sent the walk.
    """
    first, prob, from_state = lattice.first, lattice.prob, lattice.states
    heap: list[tuple] = []
    found: list[tuple[np.ndarray, float]] = []
    tie = 0

    def open_sets(path: np.ndarray, since: int, unit_of: np.ndarray, bound: float, barred: tuple[int, ...]) -> None:
        """The sets that leave ``path`` at a step from ``since`` on; ``barred`` choices are gone at ``since``."""
        nonlocal tie
        logs = lattice.log[path]
        found.append((path, float(logs.sum())))
        mass = (np.cumsum(logs) - logs)[since:]
        rest = lattice.log_rest[path[since:]]
        with np.errstate(divide="ignore"):
            if barred:
                state = from_state[path[since]]
                gone = prob[list(barred)].sum() + prob[path[since]]
                left = first[state + 1] - first[state] - len(barred) - 1
                rest[0] = np.log(max(0.0, 1 - gone) if left else 0.0)
            # a set's Gumbel maximum under the bound is -logaddexp(-bound, late)
            late = np.log(rng.standard_exponential(len(mass))) - (mass + rest)
        # only as many of the largest as can still be wanted
        keep = np.flatnonzero(late < np.inf)
        if len(keep) > k:
            keep = keep[np.argpartition(late[keep], k)[:k + 1]]
        for t, noise in zip(keep.tolist(), np.logaddexp(-bound, late[keep]).tolist(), strict=True):
            tie += 1
            heapq.heappush(heap, (noise, tie, path, since + t, unit_of, barred if t == 0 else ()))

    def seed() -> np.uint64:
        return rng.integers(0, 1 << 64, dtype=np.uint64)

    path, counts = yield starts, seed()
    top = float(rng.gumbel())
    open_sets(path, 0, np.repeat(np.arange(len(counts)), counts), top, ())
    while heap and len(found) < k:
        noise, _, path, t, unit_of, barred = heapq.heappop(heap)
        barred = (*barred, int(path[t]))
        state = from_state[path[t]]
        choices = np.setdiff1d(np.arange(first[state], first[state + 1]), barred, assume_unique=True)
        p = prob[choices]
        choice = int(choices[min(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), side="right"), len(choices) - 1)])
        unit = int(unit_of[t])
        rest, counts = yield np.concatenate([lattice.to[choice:choice + 1], starts[unit + 1:]]), seed()
        path = np.concatenate([path[:t], [choice], rest])
        unit_of = np.concatenate([unit_of[:t + 1], np.repeat(np.arange(unit, unit + len(counts)), counts)])
        open_sets(path, t, unit_of, -noise, barred)
    bar = -heap[0][0] if heap else -np.inf
    return [(path, logp, float(-np.expm1(-np.exp(min(logp - bar, 700.0)))) if bar > -np.inf else 1.0) for path, logp in found]


def sample_all(lattice: Lattice, starts: list[np.ndarray], k: int,
               rngs: list[np.random.Generator]) -> list[list[tuple[np.ndarray, float, float]]]:
    """``sample`` of several texts; a text's samples do not depend on the others."""
    out: list = [None] * len(starts)
    searches = [_search(lattice, s, k, rng) for s, rng in zip(starts, rngs, strict=True)]
    asked = [(i, search, *next(search)) for i, search in enumerate(searches)]
    while asked:
        sizes = np.array([len(states) for _, _, states, _ in asked])
        ends = np.cumsum(sizes)
        of_text = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        seeds = np.repeat(np.array([seed for *_, seed in asked], np.uint64), sizes)
        choices, counts = lattice.walk(np.concatenate([states for _, _, states, _ in asked]),
                                       _mix(seeds + of_text.astype(np.uint64) * _MULTIPLY))
        steps = np.concatenate([[0], np.cumsum(counts)])
        again = []
        for (i, search, *_), a, b in zip(asked, (ends - sizes).tolist(), ends.tolist(), strict=True):
            try:
                again.append((i, search, *search.send((choices[steps[a]:steps[b]], counts[a:b]))))
            except StopIteration as done:
                out[i] = done.value
        asked = again
    return out


def sample(lattice: Lattice, starts: np.ndarray, k: int, rng: np.random.Generator) -> list[tuple[np.ndarray, float, float]]:
    """``(choices, log-probability, inclusion score)`` of k distinct segmentations, largest noise first.

    Fewer when the text has fewer.  The inclusion score is the chance that a
    segmentation's noise passes the (k+1)-th largest.
    """
    return sample_all(lattice, [starts], k, [rng])[0]


def token_ids(lattice: Lattice, path: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    ids = lattice.piece[path]
    spelled = np.flatnonzero(ids >= len(vocabulary.text))
    if not len(spelled):
        return ids
    parts, last = [], 0
    for at in spelled:
        parts += [ids[last:at], [vocabulary.byte[b] for b in chr(ids[at] - len(vocabulary.text)).encode()]]
        last = at + 1
    return np.concatenate([*parts, ids[last:]]).astype(np.int64)


def _encoded(path: str, k: int):
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.float64(), pa.float64()]
    names = ["doc_id", "digest", "sample", "ids", "log_prob", "inclusion"]

    def run(batches):
        vocabulary = pieces(path)
        for batch in batches:
            lengths, at = pc.utf8_length(batch.column(1)).fill_null(0).to_pylist(), 0
            while at < len(lengths):      # some text at a time
                size, to = 0, at
                while to < len(lengths) and (to == at or size + lengths[to] <= LATTICE_CHARS):
                    size += lengths[to]
                    to += 1
                keys, texts, digests = (batch.column(i).slice(at, to - at).to_pylist() for i in range(3))
                units = [_UNIT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
                number: dict[str, int] = defaultdict()
                number.default_factory = number.__len__
                sizes = [len(us) for us in units]
                which = np.fromiter(map(number.__getitem__, chain.from_iterable(units)), np.int64, sum(sizes))
                lattice = Lattice(list(number), vocabulary)
                starts = np.split(lattice.starts[which], np.cumsum(sizes)[:-1])
                rngs = [np.random.Generator(np.random.SFC64(xxhash.xxh64_intdigest(f"{key}"))) for key in keys]
                columns = [[] for _ in kinds]
                for key, digest, found in zip(keys, digests, sample_all(lattice, starts, k, rngs), strict=True):
                    for i, (choices, logp, score) in enumerate(found):
                        ids = token_ids(lattice, choices, vocabulary).astype("<i4").tobytes()
                        for column, value in zip(columns, (key, digest, i, ids, logp, score), strict=True):
                            column.append(value)
                del units, number, which, lattice, starts, rngs, found     # before the next ones are made
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)
                at = to
    return run


def _path(model: str | None) -> str:
    if model is None:
        import public_tokenizers
        return public_tokenizers.path(MODEL)
    return model


def encode_samples(docs: DataFrame, k: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text",
                   model: str | None = None) -> DataFrame:
    """Up to ``k`` distinct sampled segmentations per row: ids (32-bit little-endian), log-probability, inclusion.

    Noise is seeded by the row's key alone, so a row gets the same samples in any
    partition; a null key is a key like any other and repeated rows get equal
    samples.  A null or empty text has one segmentation, of no pieces.  Texts may
    hold anything; what the vocabulary lacks is written in bytes.
    """
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long"), text, F.md5(F.coalesce(text, F.lit("")))) \
        .mapInArrow(_encoded(_path(model), k), SCHEMA)


def decode_samples(samples: DataFrame, model: str | None = None) -> DataFrame:
    """``samples`` with the column ``text`` that their ids spell."""
    path, names = _path(model), [*samples.columns, "text"]
    at = names.index("ids")

    def run(batches):
        vocabulary = pieces(path)
        for batch in batches:
            for start in range(0, batch.num_rows, DECODED_ROWS):
                some = batch.slice(start, DECODED_ROWS)
                texts = [vocabulary.decode(np.frombuffer(ids, "<i4")) for ids in some.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names)
    return samples.mapInArrow(run, T.StructType([*samples.schema.fields, T.StructField("text", T.StringType())]))


def sample_table(docs: DataFrame) -> DataFrame:
    """One row per sample, ids as a checksum, and whether they spell the document again."""
    return decode_samples(encode_samples(docs)).select(
        "doc_id", "sample", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
        "log_prob", "inclusion", (F.md5("text") == F.col("digest")).alias("decoded"))
