"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is a sequence of tokens: its words, A-Z lower-cased, and an end. A token is a row of binary decisions: whether
training knows it, the octave of its frequency rank along a Huffman code, and the bits of its rank inside the octave.
A word that training does not know goes on with its bytes, bit by bit, and a closing space.

Several predictors give each decision a logit: of words the counts of all training tokens and those after the previous
word, of bytes the counts of all, after one byte and after two. A gate, the kind of decision and how often the contexts
were met, selects the weights that mix the logits; an adaptive map of the mixed logit refines the probability. The two outcomes of a decision always share a probability of 1, so a text's score is a log10
probability over all texts. The weights are learned online, in an order of its own making, over joint counts of what the
predictors said and what came: training documents fall into two halves, and the tokens of one are predicted from the
pairs of the other, as those of a new document are.

Counts are exact sums over all training texts at every size, so scores do not depend on partitions. Words of equal
count lie side by side in rank, so the first predictor is a table with a row for each different count: at most the
square root of twice the tokens, small enough to broadcast. Pairs of words are a table that grows with the corpus. What
one task reads is one or several groups with a vocabulary, of a few blocks each; a block sends its different pairs, packed by bucket of the previous word, and
each different pair of the corpus is scored once, in its bucket, and the result sent back. Previous words with a
thousandth of all tokens are dealt by the octave of the word that follows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, cut, drop_cut, release, table

#: Tokens of a block, about, and blocks and vocabulary of a group, about: a task begins another one beyond them.
BLOCK_TOKENS, GROUP_BLOCKS, GROUP_WORDS = 1_000_000, 3, 300_000
#: Bytes of texts whose words are listed at once, about.
TOGETHER = 1 << 21
#: Words of groups that are packed at once, about; one for each group that has the word.
PLACES = 1 << 19
#: Tokens whose pairs are in a bucket, about.
BUCKET = 1_000_000
#: Pairs of a bucket, as they were sent, that are worked on at once, about.
SLICE = 1 << 18
#: A context is dealt by octaves from this share of all tokens on, and from HOT_LEAST tokens.
HOT, HOT_LEAST = 1024, 64
#: States of a context: all counts (own, other) of up to EXACT in sum, then 4 steps of size by 31 of ratio.
EXACT = 12
PAIRS = (EXACT + 1) * (EXACT + 2) // 2
STATES = PAIRS + 4 * 31
KINDS, LOGITS, LEVELS = 4, 32, 7
#: The state of a context that was never met, or that a decision does not have.
NONE = np.uint8(0)
FLAG, OCTAVE, RANK, BYTE = range(KINDS)
BINS = 49
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def spread(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of several places each: every row's first place, and each place's row and number in the row."""
    start = np.cumsum(size) - size
    row = np.repeat(np.arange(len(size)), size)
    return start, row, np.arange(len(row)) - start[row]


# ---- states of contexts: how often the decision's own outcome and the other one were met


_SIDE = EXACT + 2
_FEW = np.array([(a + b) * (a + b + 1) // 2 + b if a + b <= EXACT else 255 for a in range(_SIDE) for b in range(_SIDE)], np.uint8)


def state_of(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    out = _FEW[np.minimum(own, _SIDE - 1) * _SIDE + np.minimum(other, _SIDE - 1)]
    many = np.flatnonzero(out == 255)
    if len(many):
        own, other = own[many], other[many]
        size = np.searchsorted(np.array([32, 256, 4096]), own + other, "right")
        ratio = np.log((own + 0.4) / (other + 0.4)) * 2
        out[many] = PAIRS + size * 31 + np.rint(np.clip(ratio, -15, 15)).astype(np.int64) + 15
    return out


def _state_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each state: its logit, its level of evidence, the state with outcomes exchanged, and the one with one own outcome less."""
    logit, level, mirror, less = np.zeros(STATES, np.float32), np.zeros(STATES, np.int64), np.zeros(STATES, np.int64), np.arange(STATES)
    for t in range(EXACT + 1):
        for b in range(t + 1):
            s, a = t * (t + 1) // 2 + b, t - b
            logit[s], mirror[s] = np.log((a + 0.4) / (b + 0.4)), t * (t + 1) // 2 + a
            level[s] = np.searchsorted([0, 1, 2, 5], t)
            if a:
                less[s] = (t - 1) * t // 2 + b
    for size in range(4):
        for r in range(31):
            s = PAIRS + size * 31 + r
            logit[s], mirror[s], level[s] = (r - 15) / 2, PAIRS + size * 31 + 30 - r, 5 if size < 2 else 6
    return logit, level, mirror, less


STATE_LOGIT, STATE_LEVEL, MIRROR, LESS = _state_tables()


# ---- mixing


@dataclass
class Mixer:
    """Weights of the three logits by gate, and the counts of own outcomes by (kind, level, bin of the mixed logit)."""

    weights: np.ndarray = field(default_factory=lambda: np.tile(np.array([0.9, 0.3, 0.3], np.float32), (KINDS * LEVELS * LEVELS, 1)))
    own: np.ndarray = field(default_factory=lambda: np.zeros(KINDS * LEVELS * BINS))
    _ready: tuple | None = field(default=None, repr=False)
    _alone: tuple | None = field(default=None, repr=False)
    _refined: tuple | None = field(default=None, repr=False)

    def logit(self, kind: np.ndarray, x: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mixed logits of the own outcome, given the first predictor's and the contexts' states; and the refining cell."""
        scale, shift = self._tables()
        at = (kind * np.int32(STATES) + one) * STATES + two
        mixed = scale[at] * x + shift[at]
        return mixed, (kind * np.int32(LEVELS) + STATE_LEVEL[one]) * BINS + np.rint(np.clip(mixed * 2, -24, 24)).astype(np.int32) + 24

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The first logit's weight, and what the other two add, by kind and states."""
        if self._ready is None:
            kind, one, two = np.meshgrid(np.arange(KINDS), np.arange(STATES), np.arange(STATES), indexing="ij")
            w = self.weights[(kind * LEVELS + STATE_LEVEL[one]) * LEVELS + STATE_LEVEL[two]]
            self._ready = w[..., 0].ravel().copy(), (w[..., 1] * STATE_LOGIT[one] + w[..., 2] * STATE_LOGIT[two]).ravel()
        return self._ready

    def logit_of_one(self, kind: np.ndarray, x: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`logit` of decisions without a second context, by tables of their few states."""
        if self._alone is None:
            kinds, states = np.divmod(np.arange(KINDS * STATES), STATES)
            base = (kinds * LEVELS + STATE_LEVEL[states]) * BINS + 24
            self._alone = *(t[NONE::STATES].copy() for t in self._tables()), base.astype(np.int32)
        scale, shift, base = self._alone
        at = kind * np.int32(STATES) + one
        mixed = scale[at] * x + shift[at]
        return mixed, base[at] + np.rint(np.clip(mixed * 2, -24, 24)).astype(np.int32)

    def log10(self, kind: np.ndarray, x: np.ndarray, one: np.ndarray, two: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each decision's own outcome. With own and other exchanged the two sum to 1."""
        mixed, cell = self.logit_of_one(kind, x, one) if two is None else self.logit(kind, x, one, two)
        p = 1 / (1 + np.exp(np.clip(-mixed, -16, 16)))
        share, weight = self._refinement()
        return np.log10(np.clip(share[cell] + weight[cell] * p, np.float32(1e-6), np.float32(1 - 1e-6)))

    def _refinement(self) -> tuple[np.ndarray, np.ndarray]:
        """By cell: the mean of the refined probability and the mixed one is the first, and so much of the mixed one."""
        if self._refined is None:
            cell = np.arange(len(self.own))
            total = self.own + self.own[cell - 2 * (cell % BINS - 24)] + 20
            self._refined = (self.own / total / 2).astype(np.float32), (10 / total + 0.5).astype(np.float32)
        return self._refined


def step_of(x: np.ndarray) -> np.ndarray:
    """A logit in steps of a half, from 0."""
    return np.clip(np.rint(x * 2), -LOGITS // 2, LOGITS // 2 - 1).astype(np.int32) + LOGITS // 2


def cell_of(kind: np.ndarray, step: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Number of a joint state: kind of decision, step of the first logit, and both contexts' states."""
    return word_cell(kind, step, one) * STATES + two


def word_cell(kind: np.ndarray, step: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The same of words, which have no second context."""
    return (kind * np.int32(LOGITS) + step) * STATES + one


def learn(cell: np.ndarray, n: np.ndarray, epochs: int = 30, batch: int = 512, rate: float = 0.05) -> Mixer:
    """Online: joint states come in a pseudorandom order, and each small batch moves the weights along its gradient."""
    mixer = Mixer()
    if not len(cell):
        return mixer
    order = np.argsort(_mix(cell.astype(np.uint64) * _M), kind="stable")
    cell, n = cell[order], n[order].astype(np.float64)
    rest, two = np.divmod(cell, STATES)
    rest, one = np.divmod(rest, STATES)
    kind, step = np.divmod(rest, LOGITS)
    x = ((step - LOGITS // 2) / 2).astype(np.float32)
    gate = (kind * LEVELS + STATE_LEVEL[one]) * LEVELS + STATE_LEVEL[two]
    inputs = np.stack([x, STATE_LOGIT[one], STATE_LOGIT[two]], 1).astype(np.float64)
    square = np.full(mixer.weights.shape, 1e-3)
    mass = np.bincount(gate, weights=n, minlength=len(square)) * min(1.0, batch / len(cell))  # of a batch, on average
    weights = mixer.weights.astype(np.float64)
    for epoch in range(epochs):
        for a in range(0, len(cell), batch):
            b = slice(a, a + batch)
            error = (1 - 1 / (1 + np.exp(-np.clip((weights[gate[b]] * inputs[b]).sum(1), -16, 16)))) * n[b]
            gates, at = np.unique(gate[b], return_inverse=True)
            for k in range(3):
                g = np.bincount(at, weights=error * inputs[b, k]) / mass[gates]
                square[gates, k] += g * g
                weights[gates, k] += rate * g / np.sqrt(square[gates, k])
    mixer.weights, mixer._ready, mixer._alone = weights.astype(np.float32), None, None
    _, at = mixer.logit(kind, x, one, two)
    mixer.own, mixer._refined = np.bincount(at, weights=n, minlength=len(mixer.own)).astype(np.float64), None
    return mixer


def tally(cells: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Joint states met, and how often, from those of words, as `word_cell` numbers them, and numbers of tokens."""
    total = np.zeros(KINDS * LOGITS * STATES, np.int64)
    for cell, n in cells:
        total += np.bincount(cell, weights=n, minlength=len(total)).astype(np.int64)
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at * STATES + NONE), pa.array(total[at])], ["cell", "n"])


def learn_from(counted: DataFrame) -> Mixer:
    """counted: (cell, n) rows; there are no more different cells than joint states."""
    found = counted.groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toArrow()
    return learn(found["cell"].to_numpy(), found["n"].to_numpy())


# ---- words by rank


def huffman(mass: list[float]) -> list[str]:
    """A code for each of the given masses."""
    if not mass:
        return []
    heap = [(m + 1e-3, i, (i,)) for i, m in enumerate(mass)]
    heapq.heapify(heap)
    codes = [""] * len(mass)
    serial = len(mass)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for bit, part in (("0", a), ("1", b)):
            for i in part[2]:
                codes[i] = bit + codes[i]
        heapq.heappush(heap, (a[0] + b[0], serial, a[2] + b[2]))
        serial += 1
    return codes


class Words:
    """Counts of the training words by rank (from 1; 0 is an unknown word), by the different counts and how many words have each."""

    def __init__(self, count: np.ndarray, words: np.ndarray) -> None:
        """count: falling. words: how many have it."""
        self.count = count
        self.first = np.cumsum(words) - words + 1
        self.before = np.cumsum(count * words) - count * words
        self.different, self.total = int(words.sum()), int((count * words).sum())
        self.singles = int(words[count == 1].sum())
        edges = self.upto(2 ** np.arange(self.different.bit_length() + 1)) if self.different else np.zeros(1, np.int64)
        self.mass = np.diff(edges)
        codes = huffman(self.mass.astype(float).tolist())
        self.size = np.array([len(c) for c in codes], np.int64)
        self.value = np.array([int(c or "0", 2) for c in codes], np.uint64)
        self.own, self.other = np.zeros((len(codes), max([1, *self.size])), np.int64), np.zeros((len(codes), max([1, *self.size])), np.int64)
        for o, c in enumerate(codes):
            for j in range(len(c)):
                node = sum(int(m) for x, m in zip(codes, self.mass) if x.startswith(c[:j]))
                self.own[o, j] = sum(int(m) for x, m in zip(codes, self.mass) if x.startswith(c[: j + 1]))
                self.other[o, j] = node - self.own[o, j]

    def upto(self, rank: np.ndarray) -> np.ndarray:
        """Training tokens of lesser rank."""
        if not self.different:
            return np.zeros(len(rank), np.int64)
        rank = np.minimum(rank, self.different + 1)
        i = np.maximum(np.searchsorted(self.first, rank, "right") - 1, 0)
        return self.before[i] + (rank - self.first[i]) * self.count[i]

    def count_of(self, rank: np.ndarray) -> np.ndarray:
        """Training tokens of that rank; 0 of none."""
        if not self.different:
            return np.zeros(len(rank), np.int64)
        i = np.maximum(np.searchsorted(self.first, rank, "right") - 1, 0)
        return np.where((rank > 0) & (rank <= self.different), self.count[i], 0)

    def octave(self, rank: np.ndarray) -> np.ndarray:
        return np.frexp(np.maximum(rank, 1).astype(np.float64))[1].astype(np.int64) - 1

    def place(self, rank: np.ndarray) -> np.ndarray:
        """Each rank's place in the order of the codes' bits, from 0; unknown words come last."""
        if not self.different:
            return np.ones(len(rank), np.int64)
        order = np.argsort(self.value << (np.uint64(63) - self.size.astype(np.uint64)), kind="stable")
        count = np.minimum(2 ** (np.arange(len(self.size)) + 1), self.different + 1) - 2 ** np.arange(len(self.size))
        before = np.empty(len(order), np.int64)
        before[order] = np.cumsum(count[order]) - count[order]
        o = self.octave(rank)
        return np.where(rank > 0, before[o] + rank - (np.int64(1) << o), self.different + 1)

    def codes(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Decisions after the flag: bits (from the 63rd down), how many of them tell the octave, and how many there are."""
        known = rank > 0
        if not self.different:
            return np.full(len(rank), 2**63 - 1), np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        o = self.octave(rank)
        size = self.size[o]
        shift = (63 - size).astype(np.uint64)
        bits = (self.value[o] << shift) | ((rank.astype(np.uint64) ^ (np.uint64(1) << o.astype(np.uint64))) << (shift - o.astype(np.uint64)))
        return np.where(known, bits.astype(np.int64), 2**63 - 1), np.where(known, size, 0), np.where(known, size + o, 0)

    def decisions(self, rank: np.ndarray, less: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of different words: decisions each, from which on these are even (as all words there have one count), and of every
        decision the logit by the counts of its own and other outcome, 0 of even ones. less: 1 takes a token of each word off."""
        _, octave_size, size = self.codes(rank)
        size = size + 1
        start, places = np.cumsum(size) - size, int(size.sum())
        even_from = size.copy()
        out, known = np.zeros(places, np.float32), rank > 0

        def logit(own: np.ndarray, other: np.ndarray) -> np.ndarray:
            return np.log((np.maximum(own - less, 0) + 0.4) / (other + 0.4))

        once, more = np.array([self.singles]), np.array([self.total - self.singles])
        out[start] = np.where(known, logit(more, once), logit(once, more))
        octave = self.octave(rank)
        for step in range(int(octave_size.max(initial=0))):
            rows = np.flatnonzero(octave_size > step)
            o = octave[rows]
            out[start[rows] + 1 + step] = logit(self.own[:, step], self.other[:, step])[o]
        # halves of the octave, one after another: what lies below and above is known, the middle is looked up. Where all
        # words of a stretch have one count, so have its parts.
        word = np.flatnonzero(size - 1 > octave_size)
        r, o = rank[word], octave[word]
        low, width = np.int64(1) << o, np.int64(1) << o
        below, above = self.upto(low), self.upto(low + width)
        first, last = self._step(low), self._step(low + width - 1)
        place = start[word] + 1 + octave_size[word]
        while len(word):
            even = (width > 1) & (first == last) & (low + width - 1 <= self.different)
            even_from[word[even]] = (place - start[word])[even]
            on = (width > 1) & ~even
            if not on.all():
                word, r, low, width, below, above, first, last, place = (v[on] for v in (word, r, low, width, below, above, first, last, place))
            width = width >> 1
            mid = np.minimum(low + width, self.different + 1)
            i = self._step(mid)
            middle = self.before[i] + (mid - self.first[i]) * self.count[i]
            upper = (r & width) > 0
            own = np.where(upper, above - middle, middle - below)
            out[place] = logit(own, above - below - own)
            last = np.where(upper, last, np.maximum(np.where(self.first[i] == mid, i - 1, i), 0))
            low, below, above, first = np.where(upper, low + width, low), np.where(upper, middle, below), np.where(upper, above, middle), np.where(upper, i, first)
            place = place + 1
        return size, even_from, out

    def _step(self, rank: np.ndarray) -> np.ndarray:
        return np.maximum(np.searchsorted(self.first, rank, "right") - 1, 0)


# ---- bytes of unknown words


class Bytes:
    """Counts of the byte after each two bytes of the training words, each word once. Bounded by the alphabet."""

    def __init__(self, key: np.ndarray, n: np.ndarray) -> None:
        """key: sorted; two bytes to base 257 (0: before the word) times 256, and the next byte."""
        self.tables = []
        for base in (256, 257 * 256, None):
            k = key % base if base else key
            unique, at = np.unique(k, return_inverse=True)
            self.tables.append((unique, np.concatenate([[0], np.cumsum(np.bincount(at, weights=n, minlength=len(unique)))]).astype(np.int64)))

    @staticmethod
    def keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all bytes of the words and their closing spaces, and each word's length."""
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        raw = np.frombuffer(b" ".join(words) + b" ", np.uint8)[: int(size.sum())].astype(np.int64)
        _, _, step = spread(size)
        one, two = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        one[1:], two[2:] = raw[:-1] + 1, raw[:-2] + 1
        return (np.where(step > 1, two, 0) * 257 + np.where(step > 0, one, 0)) * 256 + raw, size

    def decisions(self, key: np.ndarray, less: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First logit and both states of each byte's eight bits. less: 1 predicts as if the byte had been met once less."""
        out = []
        for k, (base, (unique, before)) in enumerate(zip((256, 257 * 256, None), self.tables)):
            own, other = np.zeros((len(key), 8), np.int64), np.zeros((len(key), 8), np.int64)
            full = key % base if base else key
            low = full - full % 256
            at = lambda x: before[np.searchsorted(unique, x)]  # noqa: B023, E731
            below, above = at(low), at(low + 256)
            for j in range(8):
                width = 128 >> j
                middle = at(low + width)
                upper = (full & width) > 0
                own[:, j], other[:, j] = np.where(upper, above - middle, middle - below), np.where(upper, middle - below, above - middle)
                low, below, above = np.where(upper, low + width, low), np.where(upper, middle, below), np.where(upper, above, middle)
            own = np.maximum(own - less, 0).ravel()
            out.append(np.log((own + 0.4) / (other.ravel() + 0.4)).astype(np.float32) if k == 0 else state_of(own, other.ravel()))
        return tuple(out)

    def log10(self, words: list[bytes], mixer: Mixer) -> np.ndarray:
        key, size = self.keys(words)
        unique, at = np.unique(key, return_inverse=True)
        each = mixer.log10(np.full(8 * len(unique), BYTE), *self.decisions(unique)).reshape(-1, 8).sum(1, dtype=np.float64)
        return np.add.reduceat(each[at], np.cumsum(size) - size) if len(size) else np.zeros(0)

    def learn(self, n: np.ndarray) -> Mixer:
        """Weights for the keys that the tables are made of, n times each, every one predicted as if it were not counted."""
        key = self.tables[2][0]
        x, one, two = self.decisions(key, 1)
        cell, at = np.unique(cell_of(np.full(8 * len(key), BYTE), step_of(x), one, two), return_inverse=True)
        return learn(cell, np.bincount(at, weights=np.repeat(n, 8)).astype(np.int64))


def byte_model(known: DataFrame) -> tuple[Bytes, Mixer]:
    """From (token) rows, each training word once; the end has no bytes."""

    def words_in(batch: pa.RecordBatch) -> list[bytes]:
        return [w for w in byte_strings(batch.column(0)) if w != b" "]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = np.unique(Bytes.keys(words_in(batch))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    found = known.select("token").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").toArrow()
    model = Bytes(found["key"].to_numpy(), found["n"].to_numpy())
    return model, model.learn(found["n"].to_numpy())


# ---- blocks


def held_out(docs: DataFrame) -> Column:
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 2, F.lit(False))


def together(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have TOGETHER bytes of text, so that fewer words are listed twice."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.column(text).nbytes for b in held) >= TOGETHER:
            whole, held = pa.Table.from_batches(held).combine_chunks(), []
            yield from whole.to_batches()
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def gather(docs: DataFrame) -> DataFrame:
    """Documents as token numbers of their group, a row a group with a list of blocks, and the groups' vocabularies, in one table.

    A group is what one task reads, or a part of it, so texts are not shuffled. A task's rows are written together, so
    its numbers fit whatever attempt they come from. Token 0 is the end.
    Groups: block (the group's number), docs and ids (compressed) of each block; docs: doc_id, half (0 or 1, -1 of held-out
    ones), n_bytes, n_tokens. Words: block, id, token, n in training.
    """
    half = F.when(held_out(docs), -1).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(2))).cast("int")
    dealt = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), half.alias("half"))
    doc = pa.struct([("doc_id", pa.int64()), ("half", pa.int32()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    types = {"block": pa.int64(), "docs": pa.list_(pa.list_(doc)), "ids": pa.list_(pa.binary()), "id": pa.int32(), "token": pa.binary(), "n": pa.int64()}

    def rows(length: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(length, t) for c, t in types.items()], list(types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId() << 24
        pack = zstandard.ZstdCompressor(level=1)

        def fresh() -> dict:
            numbers: dict[bytes, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            numbers[b" "]
            return numbers

        numbers, blocks, packed, parts, given, tokens, train = fresh(), [], [], [], [], 0, np.zeros(0, np.int64)

        def end_block() -> None:
            nonlocal parts, given, tokens, train
            taught = [p for p, d in zip(parts, given) if d["half"] >= 0]
            n = np.bincount(np.concatenate(taught), minlength=len(numbers)) if taught else np.zeros(len(numbers), np.int64)
            n[: len(train)] += train
            blocks.append(given)
            packed.append(pack.compress(np.ascontiguousarray(np.concatenate(parts).view(np.uint8).reshape(-1, 4).T).tobytes()))
            parts, given, tokens, train = [], [], 0, n

        def flush() -> Iterator[pa.RecordBatch]:
            yield rows(1, block=pa.array([group]), docs=pa.array([blocks], types["docs"]), ids=pa.array([packed], types["ids"]))
            words = list(numbers)
            for at in range(0, len(words), 20_000):
                part = words[at : at + 20_000]
                size = len(part)
                yield rows(size, block=pa.array(np.full(size, group)), id=pa.array(np.arange(at, at + size, dtype=np.int32)), token=pa.array(part, pa.binary()), n=pa.array(train[at : at + size]))

        for batch in together(batches, 1):
            known, places, ends = split_words(batch.column(1))
            held = np.full(len(known), -1, np.int32)  # the group's number of each word of the batch, where it has one
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            for doc_id, n_bytes, half, a, b in zip(batch.column(0).to_pylist(), sizes, batch.column(2).to_pylist(), ends, ends[1:]):
                own = places[a:b]
                ids = held[own]
                if (ids < 0).any():
                    new, first = np.unique(own[ids < 0], return_index=True)
                    new = new[np.argsort(first)]
                    held[new] = [numbers[known[i]] for i in new.tolist()]
                    ids = held[own]
                parts.append(np.append(ids, np.int32(0)))
                given.append({"doc_id": doc_id, "half": half, "n_bytes": n_bytes, "n_tokens": len(ids) + 1})
                tokens += len(ids) + 1
                full = len(numbers) >= GROUP_WORDS
                if tokens >= BLOCK_TOKENS or full:
                    end_block()
                    if full or len(blocks) == GROUP_BLOCKS:
                        yield from flush()
                        numbers, blocks, packed, train, group = fresh(), [], [], np.zeros(0, np.int64), group + 1
                        held[:] = -1
            del batch, known, places, held  # before the next ones are made
        if parts:
            end_block()
        if blocks:
            yield from flush()

    schema = "block long, docs array<array<struct<doc_id: long, half: int, n_bytes: long, n_tokens: long>>>, ids array<binary>, id int, token binary, n long"
    with arrow_rows(docs.sparkSession, 256):
        return cut(dealt.mapInArrow(run, schema), "blocks")


def rank_words(listed: DataFrame) -> tuple[DataFrame, Words]:
    """(block, id, token, n) to the vocabulary: token, n, places (block, id) and rank, by falling count, then token; a token that
    training has not has no rank."""
    spark = listed.sparkSession
    summed = cut(listed.groupBy("token").agg(F.sum("n").alias("n"), F.collect_list(F.struct("block", "id")).alias("places")), "tokens")
    release(spark)
    order = [F.desc("n"), F.asc("token")]
    dealt = summed.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut(dealt.select("token", "n", "places", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("at")), "vocabulary")
    drop_cut(summed)
    release(spark)
    parts = dealt.where("n > 0").groupBy("part").agg(F.count(F.lit(1)).alias("rows")).orderBy("part").collect()
    starts = np.cumsum([0, *(p["rows"] for p in parts)]).tolist()
    by_part = spark.createDataFrame([(p["part"], s) for p, s in zip(parts, starts)], "part int, start long")
    ranked = dealt.join(F.broadcast(by_part), "part", "left").select("token", "n", "places", F.when(F.col("n") > 0, F.col("start") + F.col("at") + 1).alias("rank"))
    steps = dealt.where("n > 0").groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).toArrow()
    return ranked, Words(steps["n"].to_numpy(), steps["words"].to_numpy())


def byte_strings(column: pa.Array) -> list[bytes]:
    """As `to_pylist`, of a column without nulls, in a fraction of the time."""
    return column.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def split_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Of texts as bytes: their different words in order of appearance, A-Z lower-cased; each word as its place among these;
    and the n + 1 offsets of the texts among the words. White space is that of ASCII."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    words, ends = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    full = pc.binary_length(words).to_numpy() > 0
    if not full.all():
        words, ends = words.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[ends]
    coded = words.dictionary_encode()
    return byte_strings(coded.dictionary), coded.indices.to_numpy(), ends


def deal_words(batches: Iterator[pa.RecordBatch], bytes_: Bytes, spelling: Mixer) -> Iterator[pa.RecordBatch]:
    """(token, rank, places) to the words of groups: block, packed (rank and number of each) and costs of those without a rank.

    A row is what a group has of some PLACES words, so that no row of a word and group is made."""
    held, many = [], 0
    for batch in batches:
        rank, cost = batch.column(1).to_numpy(), np.zeros(len(batch))
        unknown = np.flatnonzero(rank == 0)
        if len(unknown):
            tokens = byte_strings(batch.column(0).take(pa.array(unknown)))
            cost[unknown] = bytes_.log10([b"" if t == b" " else t for t in tokens], spelling)
        places = batch.column(2).flatten()
        row = np.repeat(np.arange(len(rank)), pc.list_value_length(batch.column(2)).to_numpy())
        held.append((places.field("block").to_numpy(), places.field("id").to_numpy(), rank[row], cost[row]))
        many += len(row)
        if many >= PLACES:
            yield pack_words(*map(np.concatenate, zip(*held)))
            held, many = [], 0
    if many:
        yield pack_words(*map(np.concatenate, zip(*held)))


def pack_words(block: np.ndarray, number: np.ndarray, rank: np.ndarray, cost: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(block, kind="stable")
    block, number, rank, cost = block[order], number[order], rank[order], cost[order]
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    widths, planes = _planes([_steps(rank, starts), number])
    pack = zstandard.ZstdCompressor(level=3)
    edges = [*starts.tolist(), len(block)]
    packed = [widths + pack.compress(planes[:, a:b].tobytes()) for a, b in zip(edges, edges[1:])]
    costs = [cost[a:b][rank[a:b] == 0].tobytes() for a, b in zip(edges, edges[1:])]
    return pa.RecordBatch.from_arrays([pa.array(block[starts]), pa.array(packed, pa.binary()), pa.array(costs, pa.binary())], ["block", "packed", "costs"])


def words_of(packed: list[bytes], costs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rank and cost of a group's words by their numbers, from all rows that `pack_words` made of it."""
    sizes, (step, number) = _of_planes(packed, 2)
    given = _of_steps(step, sizes)
    rank, cost = np.zeros(len(number), np.int64), np.zeros(len(number))
    rank[number] = given
    cost[number[given == 0]] = np.frombuffer(b"".join(costs), np.float64)
    return rank, cost


class Block:
    """The tokens of a block in order, and its different pairs (previous word, word)."""

    def __init__(self, docs: pa.StructArray, ids: bytes, rank: np.ndarray, n: np.ndarray, cost: np.ndarray, words: Words) -> None:
        """rank, n, cost: of the group's tokens by their numbers. n: training tokens."""
        self.docs, self.rank, self.n, self.cost = docs, rank, n, cost
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), np.uint8).reshape(4, -1)
        self.ids = np.ascontiguousarray(planes.T).view(np.int32).ravel().astype(np.int64)
        self.sizes = self.docs.field("n_tokens").to_numpy()
        self.first = np.cumsum(self.sizes) - self.sizes
        wide = len(self.rank) + 1
        before = np.empty_like(self.ids)
        before[1:] = self.ids[:-1]
        before[self.first] = wide - 1  # a text's beginning
        before *= wide
        before += self.ids
        pair, self.of_pair = np.unique(before, return_inverse=True)
        del before
        before, after = np.divmod(pair, wide)
        del pair
        self.word, self.word_n = self.rank[after], self.n[after]
        self.context, self.context_n = np.append(self.rank, words.different + 1)[before], np.append(self.n, 0)[before]

    @classmethod
    def of(cls, row: dict, words: Words) -> Iterator[tuple[int, Block]]:
        """The blocks of a group with their numbers. Nothing here holds one that the caller has let go."""
        known = row["vocabulary"]
        rank, cost = words_of(known.field("packed").to_pylist(), known.field("costs").to_pylist())
        n = words.count_of(rank)
        for i, ids in enumerate(row["ids"]):
            yield i, cls(row["docs"][i].values, ids, rank, n, cost, words)

    def counts(self) -> list[np.ndarray]:
        """Training tokens of each pair, of either half."""
        half = np.repeat(self.docs.field("half").to_numpy(), self.sizes)
        return [np.bincount(self.of_pair[half == h], minlength=len(self.word)).astype(np.int32) for h in (0, 1)]


class Pairs:
    """A block's different pairs as they are sent to buckets: those of hot contexts in two parts, the octave and the rest."""

    def __init__(self, block: Block, words: Words, buckets: int) -> None:
        context, rank = block.context, block.word
        hot = (context == 0) | (context > words.different) | (block.context_n >= max(HOT_LEAST, words.total // HOT))
        cold, warm, lower = np.flatnonzero(~hot), np.flatnonzero(hot), np.flatnonzero(hot & (rank > 0))
        del hot
        octave = words.octave(rank).astype(np.int8)
        self.part = np.repeat(np.array([0, 1, 2], np.int8), [len(cold), len(warm), len(lower)])
        # a part's context: the word, and the octave of the word that follows from 1 on
        self.context = np.concatenate([context[cold], context[warm], context[lower]])
        self.context *= 64
        self.context[len(cold) + len(warm) :] += octave[lower] + 1
        self.rank = np.concatenate([rank[cold], np.where(rank[warm] > 0, np.int64(1) << octave[warm].astype(np.int64), 0), rank[lower]])
        self.pair = np.concatenate([x.astype(np.int32) for x in (cold, warm, lower)])
        del cold, warm, lower, octave
        self.bucket = (_mix(self.context.astype(np.uint64) * _M) % np.uint64(buckets)).astype(np.uint16 if buckets <= 60_000 else np.int64)
        self.order = np.argsort(self.bucket, kind="stable").astype(np.int32)
        self.pair = self.pair[self.order]

    def sent(self, group: int, number: int, counts: list[np.ndarray], single: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A packed row a bucket, and the end of these pairs. counts: tokens of each pair by half. single: pairs of a word that training has once."""
        if not len(self.order):
            return
        pack = zstandard.ZstdCompressor(level=3)
        self.bucket = self.bucket[self.order]
        starts = np.flatnonzero(np.concatenate([[True], self.bucket[1:] != self.bucket[:-1]]))
        bucket = self.bucket[starts].astype(np.int32)

        def columns() -> Iterator[np.ndarray]:
            """One after another, each in the place of what it is made of."""
            self.context = self.context[self.order]
            yield _steps(self.context, starts)
            self.context = self.bucket = None
            yield self.rank[self.order]
            self.rank = None
            while counts:
                yield counts.pop(0)[self.pair]
            yield self.part[self.order] + np.int8(4) * single[self.pair]

        widths, planes = _planes(columns())
        starts, ends = starts.tolist(), [*starts[1:].tolist(), len(self.order)]
        for at in range(0, len(starts), 64):
            rows = [widths + pack.compress(planes[:, a:b].tobytes()) for a, b in zip(starts[at : at + 64], ends[at : at + 64])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at : at + 64]), pa.array([group] * len(rows), pa.int64()), pa.array([number] * len(rows), pa.int32()), pa.array(rows, pa.binary())], ["bucket", "block", "number", "packed"])

    def scores(self, told: list[bytes], pairs: int) -> np.ndarray:
        """Each pair's score from what the buckets tell, in their order."""
        parts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.float32) for x in told]
        return np.bincount(self.pair, weights=np.concatenate([np.zeros(0, np.float32), *parts]), minlength=pairs)


#: What is sent of a pair: context (the difference to the one before, its sign last), rank, tokens of both halves, and the part with
#: 4 added for a word that training has once.
COLUMNS = 5


def _steps(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The difference of each number to the one before in its row, its sign last; of a row's first the number itself."""
    step = np.diff(x, prepend=0)
    step[starts] = x[starts]
    sign = step >> 63
    step <<= 1
    step ^= sign
    return step


def _of_steps(step: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The numbers of which `_steps` made these, given the rows' sizes."""
    step = (step >> 1) ^ -(step & 1)
    out, starts = np.cumsum(step), np.cumsum(sizes) - sizes
    out -= np.repeat(out[starts] - step[starts], sizes)
    return out


def _planes(columns: Iterable[np.ndarray]) -> tuple[bytes, np.ndarray]:
    """Whole numbers from 0 on by places of their bytes, which compress better: how many each column needs, and a row for each."""
    parts = []
    for column in columns:
        width = max(1, (int(column.max(initial=0)).bit_length() + 7) // 8)
        parts.append(np.empty((width, len(column)), np.uint8))
        places = column.view(np.uint8).reshape(len(column), -1)
        parts[-1][: places.shape[1]] = places[:, :width].T
        del column, places
    return bytes(map(len, parts)), np.concatenate(parts)


def _of_planes(packed: list[bytes], columns: int = COLUMNS) -> tuple[list[int], list[np.ndarray]]:
    """How many numbers each of some packed rows has, and the columns of all of them, one row after another, as narrow as they may be."""
    unpack = zstandard.ZstdDecompressor()
    parts = [np.frombuffer(unpack.decompress(x[columns:]), np.uint8).reshape(sum(x[:columns]), -1) for x in packed]
    sizes = [x.shape[1] for x in parts]
    wide = bytes(map(max, zip(*(x[:columns] for x in packed))))
    first = np.cumsum([0, *wide]).tolist()
    whole, at = np.zeros((sum(wide), sum(sizes)), np.uint8), 0
    for x, part, size in zip(packed, parts, sizes):
        if x.startswith(wide):
            whole[:, at : at + size] = part
        else:
            row = 0
            for i, width in enumerate(x[:columns]):
                whole[first[i] : first[i] + width, at : at + size] = part[row : row + width]
                row += width
        at += size
    del parts
    out = []
    for a, b in zip(first, first[1:]):
        kind = np.int16 if b - a < 2 else np.int32 if b - a < 4 else np.int64
        column = whole[a].astype(kind)
        for j in range(a + 1, b):
            column |= whole[j].astype(kind) << kind(8 * (j - a))
        out.append(column)
    return sizes, out


def _bits(x: np.ndarray) -> np.ndarray:
    """Number of binary places, exact for all positive 64-bit numbers."""
    high = x >> 32
    return np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], np.frexp((x & 0xFFFFFFFF).astype(np.float64))[1])


class Contexts:
    """All pairs of some contexts: the different ones, and the state of the context at each of their decisions.

    Pairs of a context are sorted by the bits of their words, so that a node of the code is a stretch of them; going down
    the code, a stretch's sum is the node's count, and that of the part which goes on alike the own outcome's.
    """

    def __init__(self, context: np.ndarray, rank: np.ndarray, given: list[np.ndarray], part: np.ndarray, words: Words, less: int) -> None:
        """Of pairs as blocks sent them. given: tokens of either half."""
        part, single = part & 3, part >> 2
        self.words = words
        place = words.place(rank)
        wide = words.different + 2
        dense = context if wide * wide * 64 < 2**63 else np.unique(context, return_inverse=True)[1]
        key = dense * np.int64(wide) + place
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        self.of = np.empty(len(key), np.int64)
        self.of[order] = np.cumsum(new) - 1
        #: Tokens of either half, and those of them whose word training has once.
        given, single = [n[order] for n in given], single[order]
        self.n, self.once = ([np.add.reduceat(n, first) for n in v] for v in (given, [n * single for n in given]))
        self.rank, self.part, group = rank[order][first], part[order][first], dense[order][first]
        self.bits, octave_size, size = words.codes(self.rank)
        # the flag, then octave and rank; a hot context's first part ends with the octave, its second begins after it
        self.flag = self.part != 2
        self.low, self.high = np.where(self.part == 2, octave_size, 0), np.where(self.part == 1, octave_size, size)
        self.octave_size = octave_size
        self.begins = np.ones(len(first), bool)
        self.begins[1:] = group[1:] != group[:-1]
        same = np.full(len(first) + 1, -1, np.int64)  # bits shared with the pair before, of the same context
        same[1:-1] = np.where(self.begins[1:], -1, 63 - _bits(self.bits[1:] ^ self.bits[:-1]))
        self.same, alone = same[:-1], np.maximum(same[:-1], same[1:]) + 1
        # a pair that shares no bits with others any more keeps its first state from there on; where the word's decisions
        # are even too, the rest are alike, and are known by their number alone
        ranks, at = np.unique(self.rank, return_inverse=True)
        sizes, even, self.first_logits = words.decisions(ranks, less)
        self.first = (np.cumsum(sizes) - sizes)[at] + np.where(self.flag, 0, 1 + octave_size)
        begun = np.maximum(even[at] - 1, alone)
        self.rest = np.where(self.part == 1, 0, np.maximum(self.high - np.maximum(begun, self.low), 0))
        self.size = self.flag + self.high - self.low - self.rest
        self.start = np.cumsum(self.size) - self.size
        self.busy = np.minimum(self.high, alone)

    def states(self, n: np.ndarray, once: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of counts of each pair's tokens, and of those of words that training has once: the state of every decision, and that of
        each pair's rest."""
        of_group = np.flatnonzero(self.begins)
        members = np.diff(np.append(of_group, len(self.begins)))
        known, f = self.rank > 0, np.flatnonzero(self.flag)
        rest = state_of(n, np.zeros(len(n), np.int64))
        out = np.repeat(rest, self.size)
        total, single = (np.repeat(np.add.reduceat(v, of_group), members)[f] for v in (n, once))
        out[self.start[f]] = state_of(np.where(known[f], total - single, single), np.where(known[f], single, total - single))
        high, shared, depth = self.busy, self.same, 0
        alive = np.flatnonzero(high > 0)
        at, n = alive, n[alive]
        ends, place = high[alive], (self.start + self.flag - self.low)[alive]
        low = self.low[alive]
        while len(at):
            # what was left out between two pairs may part them
            shared = np.minimum.reduceat(shared[: at[-1] + 1], np.append(0, at[:-1] + 1)) if len(at) < len(shared) else shared
            node, below = np.flatnonzero(shared < depth), np.flatnonzero(shared < depth + 1)
            node_size, below_size = np.diff(np.append(node, len(at))), np.diff(np.append(below, len(at)))
            write = low <= depth
            write = slice(None) if write.all() else write
            target = place[write] + depth
            own = np.repeat(np.add.reduceat(n, below), below_size)
            total = np.repeat(np.add.reduceat(n, node), node_size)
            out[target] = state_of(own[write], (total - own)[write])
            depth += 1
            at = np.flatnonzero(ends > depth)
            if len(at) < len(ends):
                ends, place, low, n = ends[at], place[at], low[at], n[at]
        return out, rest

    def by_size(self, rows: np.ndarray) -> np.ndarray:
        """Those of some pairs that have decisions, the ones with more first."""
        rows = rows[self.size[rows] > 0]
        return rows[np.argsort(-self.size[rows].astype(np.int16), kind="stable")]

    def walk(self, states: np.ndarray, rows: np.ndarray, table: np.ndarray) -> Iterator[tuple]:
        """The decisions of pairs `by_size`, by their number: kind, the table's entry, and the state after the previous word, of
        as many pairs from the first on as have one."""
        left = len(rows) - np.cumsum(np.bincount(self.size[rows], minlength=1))
        first, start = self.first[rows], self.start[rows]
        skip = np.where(self.flag[rows], 0, 1 + self.octave_size[rows])
        rank_from = self.octave_size[rows] + 1 - skip
        for step in range(len(left) - 1):
            k = int(left[step])
            kind = (rank_from[:k] <= step) + (np.int32(1) if step else (skip[:k] > 0).astype(np.int32))
            yield kind, table[first[:k] + step], states[start[:k] + step]

    def cells(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Joint states of the second half's tokens, predicted from the first half, and how many they are; of a bucket with less 1.

        A word that training has once is unknown to the other half, and ends with the flag."""
        states, of_rest = self.states(self.n[0], self.once[0])
        less = np.log((max(self.words.singles - 1, 0) + 0.4) / (self.words.total - self.words.singles + 0.4))
        n, once = self.n[1], self.once[1]
        rows = self.by_size(np.flatnonzero(n > 0))
        known = (n - once)[rows]
        for kind, step, one in self.walk(states, rows, step_of(self.first_logits)):
            yield word_cell(kind, step, one), known[: len(one)]
        alone = np.flatnonzero(self.flag & (once > 0))
        yield word_cell(np.full(len(alone), FLAG, np.int32), step_of(np.float32(less)), MIRROR[states[self.start[alone]]]), once[alone]
        rest = np.flatnonzero((n > 0) & (self.rest > 0))
        yield word_cell(np.full(len(rest), RANK, np.int32), step_of(np.float32(0)), of_rest[rest]), (n - once)[rest] * self.rest[rest]

    def scores(self, mixer: Mixer) -> np.ndarray:
        """log10 probability of the word of each pair, as it was sent."""
        states, of_rest = self.states(self.n[0] + self.n[1], self.once[0] + self.once[1])
        rows = self.by_size(np.arange(len(self.rank)))
        each = np.zeros(len(rows))
        for kind, x, one in self.walk(states, rows, self.first_logits):
            each[: len(one)] += mixer.log10(kind, x, one)
        total = np.zeros(len(self.rank))
        total[rows] = each
        rest = np.flatnonzero(self.rest)
        total[rest] += mixer.log10(np.full(len(rest), RANK, np.int32), np.zeros(len(rest), np.float32), of_rest[rest]) * self.rest[rest]
        return total.astype(np.float32)[self.of]


class Bucket:
    """What blocks sent to a bucket. Contexts do not need each other, so a slice of them is worked on after another."""

    def __init__(self, packed: list[bytes], words: Words, less: int = 0) -> None:
        """less: 1 predicts a word by the counts of all tokens as if it had been met once less."""
        self.sizes, (step, self.rank, *self.given, self.part) = _of_planes(packed)
        self.context = _of_steps(step, self.sizes)
        self.words, self.less = words, less

    def slices(self) -> Iterator[tuple[np.ndarray, Contexts]]:
        """Places of some pairs, and these; all of a context are together. Nothing here holds what the caller has let go."""
        slices = -(-len(self.rank) // SLICE)
        dealt = ((_mix(self.context.astype(np.uint64) * _M) >> np.uint64(32)) % np.uint64(max(1, slices))).astype(np.uint16)
        edges = np.cumsum([0, *np.bincount(dealt, minlength=slices)]).tolist()
        order = np.argsort(dealt, kind="stable").astype(np.int32)
        for a, b in zip(edges, edges[1:]):
            if b > a:
                context, rank, *given, part = (v[order[a:b]].astype(np.int64) for v in (self.context, self.rank, *self.given, self.part))
                yield order[a:b], Contexts(context, rank, given, part, self.words, self.less)

    def cells(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, contexts in self.slices():
            yield from contexts.cells()
            del contexts

    def scores(self, mixer: Mixer) -> list[np.ndarray]:
        """log10 probability of the word of each pair, as its block sent it."""
        out = np.empty(len(self.rank), np.float32)
        for at, contexts in self.slices():
            out[at] = contexts.scores(mixer)
            del contexts
        return np.split(out, np.cumsum(self.sizes)[:-1])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield {c: (batch.column(c)[i].values if c in ("docs", "vocabulary") else batch.column(c)[i].as_py()) for c in batch.schema.names}


@dataclass
class Corpus:
    """A corpus with its counts. coded: blocks, with the rank of each token. pairs: buckets, with the pairs of each block."""

    words: Words
    bytes_: Bytes
    spelling: Mixer
    coded: DataFrame
    pairs: DataFrame
    buckets: int


def count_corpus(docs: DataFrame) -> Corpus:
    """All counts: of words, of bytes in words, and of words after others."""
    spark = docs.sparkSession
    gathered = gather(docs)
    vocabulary, words = rank_words(gathered.where("token IS NOT NULL").select("block", "id", "token", "n"))
    bytes_, spelling = byte_model(vocabulary.where("n > 0"))
    sent = spark.sparkContext.broadcast((bytes_, spelling))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from deal_words(batches, *sent.value)

    with arrow_rows(spark, 1024):  # a word has as many places as groups that know it
        packed = vocabulary.select("token", F.coalesce("rank", F.lit(0)).cast("long").alias("rank"), "places").mapInArrow(deal, "block long, packed binary, costs binary")
        met = packed.groupBy("block").agg(F.collect_list(F.struct("packed", "costs")).alias("vocabulary"))
        coded = cut(gathered.where("docs IS NOT NULL").select("block", "docs", "ids").join(met.hint("merge"), "block"), "coded")
    drop_cut(gathered)
    drop_cut(vocabulary)
    tokens = coded.select(F.explode(F.flatten("docs")).alias("d")).select("d.n_tokens").toDF("n").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = int(max(8, tokens // BUCKET))
    shared = spark.sparkContext.broadcast(words)
    release(spark)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            for number, block in Block.of(row, shared.value):
                pairs, counts, single = Pairs(block, shared.value, buckets), block.counts(), block.word_n == 1
                del block  # before its pairs are packed, as those are before the next block is read
                yield from pairs.sent(row["block"], number, counts, single)
                del pairs

    with arrow_rows(spark, 1):
        rows = coded.mapInArrow(send, "bucket int, block long, number int, packed binary")
        grouped = rows.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("block", "number", "packed"))).alias("sent"))
        pairs = cut(grouped.select("bucket", "sent.block", "sent.number", "sent.packed"), "pairs")
    release(spark)
    return Corpus(words, bytes_, spelling, coded, pairs, buckets)


def learn_weights(corpus: Corpus) -> Mixer:
    """Weights and refinement over all training documents: what those of one half tell of those of the other."""
    words = corpus.coded.sparkSession.sparkContext.broadcast(corpus.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield tally(x for row in _rows(batches) for x in Bucket(row["packed"], words.value, 1).cells())

    with arrow_rows(corpus.coded.sparkSession, 1):
        return learn_from(corpus.pairs.select("packed").mapInArrow(run, "cell long, n long"))


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every whole text.

    Null texts count as empty: one token, the end. Repeated rows are rows of their own, and count each as training
    text. Without training tokens the counts are 0 and the model is that of no data. An empty table gives no rows;
    rows without a doc_id are training text; other columns are ignored. Scores are log10 probabilities; bits_per_byte
    divides the score's bits by the text's bytes, one at least. A score depends on the rows of the table, not on their
    order or partitions. doc_id is an integer.
    """
    corpus = count_corpus(docs)
    return score_corpus(corpus, learn_weights(corpus))


def score_corpus(corpus: Corpus, mixer: Mixer) -> DataFrame:
    """The scores as score_texts gives them; the corpus's tables are deleted."""
    spark, buckets = corpus.coded.sparkSession, corpus.buckets
    sent = spark.sparkContext.broadcast((corpus.words, mixer))
    base_of = float(np.log10(corpus.words.total + corpus.words.different + 1))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for row in _rows(batches):
            found = Bucket(row["packed"], sent.value[0]).scores(sent.value[1])
            for a in range(0, len(found), 64):
                part = [pack.compress(x.tobytes()) for x in found[a : a + 64]]
                yield pa.RecordBatch.from_arrays([pa.array(row["block"][a : a + 64], pa.int64()), pa.array(row["number"][a : a + 64], pa.int32()), pa.array([row["bucket"]] * len(part), pa.int32()), pa.array(part, pa.binary())], ["block", "number", "bucket", "told"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value[0]
        for row in _rows(batches):
            told: dict[int, list[bytes]] = defaultdict(list)
            for number, packed in zip(row["number"], row["told"]):
                told[number].append(packed)
            for number, block in Block.of(row, words):
                each = Pairs(block, words, buckets).scores(told.pop(number), len(block.word))
                base = np.log10(block.n + 1.0) - base_of
                score = np.add.reduceat(each[block.of_pair] + block.cost[block.ids], block.first)
                known = np.add.reduceat((block.n > 0)[block.ids].astype(np.int64), block.first)
                bits = -score / np.log10(2) / np.maximum(block.docs.field("n_bytes").to_numpy(), 1)
                columns = [block.docs.field("doc_id"), pa.array(block.docs.field("half").to_numpy() < 0), pa.array(block.sizes), pa.array(known), pa.array(np.add.reduceat(base[block.ids], block.first)), pa.array(score), pa.array(bits)]
                del block, each, base, score, known, bits  # before the next one is read
                yield pa.RecordBatch.from_arrays(columns, names)

    with arrow_rows(spark, 1):
        rows = corpus.pairs.mapInArrow(tell, "block long, number int, bucket int, told binary")
        listed = F.array_sort(F.collect_list(F.struct("number", "bucket", "told"))).alias("t")
        told = cut(rows.groupBy("block").agg(listed).select("block", "t.number", "t.told"), "told")
        release(spark)
        drop_cut(corpus.pairs)
        met = corpus.coded.join(told.hint("merge"), "block")
        done = cut(met.mapInArrow(add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"), "scores")
    drop_cut(corpus.coded)
    drop_cut(told)
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(corpus.words.total).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
