"""Quality rules and n-gram perplexity bands by language.

The model is one of code points: texts in lower case, white space as one blank, digits as 0. Spark counts the n-grams of
ORDER code points of every text, by language; counts of lower orders are those of different points before them. Discounts are
the modified Kneser-Ney ones (three for each order and language, from counts of counts), lower orders are interpolated, and
a uniform share over all code points ends the chain, so that a context's probabilities sum to one.

The model is tables: counts of n-grams, and for contexts the total and the rest that goes to the lower order. They hold all
n-grams at every size. One with a count under LEAST_COUNT has no share of its own, so that a text is not told by what it
alone says; its mass is part of its context's rest. Joins give each different n-gram of the corpus its probability. Those
that make up a 2**-20th or more of all n-grams, 2**20 at most, are broadcast as sorted 64-bit hashes; a text's other ones
are joined with the rest of the table. Languages with under a 256th of the documents share one model and one set of bands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, segment_sum, table

#: Longer n-grams know texts that have many copies by heart, and tell them from others.
ORDER = 3
#: n-grams that every task gets at most: those with a KEPTth of all or more. The others are joined.
KEPT = 1 << 20
#: n-grams of a smaller count are left to lower orders.
LEAST_COUNT = 4
#: Languages with fewer than a SHAREth of the documents go together.
SHARE = 256
#: Part of every context's mass that always goes on to the lower order.
LEAST_REST = 1e-6
#: Code points that there are.
POINTS = 0x110000
#: Standard deviations from the median that a band allows on either side, documents that stand for the language's own
#: spread in each class of lengths, and the least part of the variance of single points that a text's spread can have.
WIDTH, PRIOR, LEAST_SPREAD = 6.0, 50, 0.5
#: Different n-grams that a task holds before it lets them go, and places of a table of n-grams.
HELD, DENSE = 1 << 20, 1 << 24
#: Bytes of texts that a task takes up at a time, one text at least.
SLICE = 1 << 21
#: Logarithms are summed as integers of this unit, so that sums don't depend on their order.
UNIT = 1 << 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SYMBOLS = np.zeros(128, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_BLANKS = " \t\n\x0b\x0c\r"


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of SLICE bytes of text, so that a task's arrays stay small; a longer text is a part of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, "right"))
        upto = max(upto, at + 1)
        yield batch.slice(at, upto - at)
        at = upto


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, one array, and the n + 1 offsets."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def blank(cp: np.ndarray) -> np.ndarray:
    return (cp == 32) | ((cp >= 9) & (cp <= 13))


def spread_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Points of the texts as the model sees them: ORDER - 1 blanks, the normalised text, a line feed."""
    cp, at = points([t.lower() for t in texts])
    space = blank(cp)
    first = np.zeros(len(cp), bool)
    first[at[:-1][at[:-1] < at[1:]]] = True
    before = np.concatenate([[False], space[:-1]]) & ~first
    keep = ~(space & (before | first))
    at = np.concatenate([[0], np.cumsum(segment_sum(keep.astype(np.int32), at))])
    cp = np.where(space, 32, np.where((cp >= 48) & (cp <= 57), 48, cp)).astype(np.uint32)[keep]
    n = len(texts)
    wide = np.full(len(cp) + ORDER * n, 32, np.uint32)
    starts = at + ORDER * np.arange(n + 1)
    wide[np.arange(len(cp)) + np.repeat(ORDER * np.arange(n) + ORDER - 1, np.diff(at))] = cp
    wide[starts[1:] - 1] = 10
    return wide, starts


def hashed(seed: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of rows of code points; the number of columns counts."""
    h = seed + np.uint64(len(columns))
    for c in columns:
        h = (h ^ c) * _A
        h ^= h >> np.uint64(32)
    h = (h ^ h >> np.uint64(29)) * _B
    return h ^ h >> np.uint64(32)


def seeds(voices: np.ndarray) -> np.ndarray:
    return (voices.astype(np.uint64) + np.uint64(1)) * _B


def distinct(wide: np.ndarray, starts: np.ndarray, voices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams of ORDER points of some texts: a number for each of them in the order of the texts, and for those numbers
    that occur how often, their voice and their points; with the offsets of the texts among the n-grams.

    Numbers are places in a table of all combinations of the code points at hand where that has DENSE places at most (no
    sorting then), else the n-grams are sorted.
    """
    n = len(wide) - ORDER + 1
    there = np.zeros(POINTS, bool)
    there[wide] = True
    alphabet = np.flatnonzero(there)
    number = np.zeros(POINTS, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    ids = number[wide]
    spoken, voice = np.unique(voices, return_inverse=True)
    key = np.repeat(voice, np.diff(starts))[:n]
    dense = len(spoken) * len(alphabet) ** ORDER <= DENSE
    for i in range(ORDER):
        if not dense and i:  # renumbered, so that no number grows past 64 bits
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(alphabet) + ids[i : n + i]
    good = np.ones(n, bool)
    for back in range(1, ORDER):
        good[starts[1:-1] - back] = False
    offsets = starts - (ORDER - 1) * np.arange(len(starts))
    key = key[good]
    if dense:
        counts = np.bincount(key)
        found = np.flatnonzero(counts)
        rest, columns = found, []
        for _ in range(ORDER):
            rest, c = np.divmod(rest, len(alphabet))
            columns.append(alphabet[c])
        return key, offsets, counts, spoken[rest], np.stack(columns[::-1], axis=1).astype(np.uint32)
    _, first, key, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    place = np.flatnonzero(good)[first]
    text = np.searchsorted(starts, place, "right") - 1
    return key, offsets, counts, voices[text], wide[place[:, None] + np.arange(ORDER)]


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts keys, where each run of equal ones begins in it, and how long it is."""
    order = np.argsort(keys)
    ranked = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return order, begins, np.diff(np.append(begins, len(keys)))


def voice_of(lang: Column, names: list[str | None]) -> Column:
    """The number of a language's model: its place in names, else one for all others."""
    out = F.lit(len(names))
    for i, name in enumerate(names):
        out = F.when(lang.eqNullSafe(F.lit(name)), i).otherwise(out)
    return out


def large_languages(docs: DataFrame, lang: str) -> list[str | None]:
    """Languages (null may be one) with a SHAREth of the documents at least: SHARE of them at most."""
    counts = docs.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).collect()[0][0] or 0
    return [r[0] for r in counts.where(F.col("n") * SHARE >= total).select("lang").orderBy(F.col("lang").asc_nulls_last()).collect()]


def count_grams(rows: DataFrame) -> DataFrame:
    """(voice, text) to (voice, gram, n): n-grams of ORDER points, summed in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> None:
            keys, voice, gram, n = (np.concatenate(c) for c in zip(*held))
            order, begins, _ = runs(keys)
            first = order[begins]
            held[:] = [(keys[first], voice[first], gram[first], np.add.reduceat(n[order], begins))]

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                merged()
                _, voice, gram, n = held.pop()
                for a in range(0, len(n), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(voice[a : a + (1 << 16)]), strings(gram[a : a + (1 << 16)]), pa.array(n[a : a + (1 << 16)])], ["voice", "gram", "n"])

        for batch in (part for whole in batches for part in slices(whole, 1)):
            voices = batch.column(0).to_numpy()
            wide, starts = spread_out([t or "" for t in batch.column(1).to_pylist()])
            _, _, counts, voice, gram = distinct(wide, starts, voices)
            held.append((hashed(seeds(voice), list(gram.T)), voice, gram, counts[counts > 0]))
            if sum(len(h[0]) for h in held) > HELD:
                merged()
                if len(held[0][0]) > HELD // 2:
                    yield from out()
        yield from out()

    return rows.select("voice", "text").mapInArrow(run, "voice int, gram string, n long").groupBy("voice", "gram").agg(F.sum("n").alias("n"))


def discounts(of_counts: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2, and 3 or more, from how many n-grams have count 1, 2, 3 and 4."""
    n1, n2, n3, n4 = of_counts
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    return [min(max(c - (c + 1) * y * more / n, 0.0), float(c)) if n else 0.0 for c, n, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


@dataclass
class Order:
    """Of n-grams of one length: their counts (voice, gram, n), their contexts (voice, context, total, rest: what goes to the
    lower order), the discounts by voice, and the least count that has a share."""

    grams: DataFrame
    contexts: DataFrame
    off: Column
    least: int


def discount(off: Column) -> Column:
    """Of a count n of a voice."""
    return F.get(F.try_element_at(off, "voice"), F.least(F.col("n"), F.lit(3)).cast("int") - 1)


class Model:
    """The orders, from single points on."""

    def __init__(self, orders: list[Order]):
        self.orders = orders

    def probabilities(self, asked: DataFrame) -> DataFrame:
        """Different (voice, gram of ORDER points) to voice, gram, n (null if the corpus has none) and p, the probability of the
        last point after those before it."""
        levels = [asked.select("voice", "gram")]
        for k in range(ORDER - 1, 0, -1):
            levels.append(levels[-1].select("voice", F.substring("gram", 2, k).alias("gram")).distinct())
        lower = None
        for k, (level, order) in enumerate(zip(levels[::-1], self.orders), 1):
            contexts = F.broadcast(order.contexts) if k == 1 else order.contexts.hint("merge")  # of single points one a voice
            rows = level.join(order.grams.hint("merge"), ["voice", "gram"], "left").withColumn("context", F.substring("gram", 1, k - 1))
            rows = rows.join(contexts, ["voice", "context"], "left")
            if lower is None:
                rows = rows.withColumn("lower", F.lit(1 / POINTS))
            else:
                rows = rows.withColumn("tail", F.substring("gram", 2, k - 1)).join(lower.hint("merge"), ["voice", "tail"])
            share = F.when(F.col("n") >= order.least, (F.col("n") - discount(order.off)) / F.col("total") * (1 - LEAST_REST))
            p = F.coalesce(share, F.lit(0.0)) + F.coalesce("rest", F.lit(1.0)) * F.col("lower")
            found = rows.select("voice", "gram", "n", p.alias("p"))
            lower = found.select("voice", F.col("gram").alias("tail"), F.col("p").alias("lower"))
        return found

    def probability(self, voice: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """`probabilities` of a few rows of ORDER points."""
        rows = [(int(v), "".join(map(chr, g))) for v, g in zip(voice, gram)]
        asked = self.orders[0].grams.sparkSession.createDataFrame(list(set(rows)), "voice int, gram string")
        found = {(r.voice, r.gram): r.p for r in self.probabilities(asked).collect()}
        return np.array([found[r] for r in rows])


def fit(counts: DataFrame, kept: int | None = None) -> Model:
    """The model of (voice, gram, n), a written table. kept: a caller may ask for a smaller model, in which n-grams with less
    than a kept-th of their order's total have no share of their own; by default none is left out for its share."""
    level, orders = counts, []
    for k in range(ORDER, 0, -1):
        if k < ORDER:
            level = cut(level.groupBy("voice", F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"grams-{k}")
        stats = level.groupBy("voice").agg(F.sum("n"), *[F.count_if(F.col("n") == c) for c in (1, 2, 3, 4)]).collect()
        least = max(LEAST_COUNT, -(-sum(r[1] for r in stats) // kept)) if kept else LEAST_COUNT
        found = {-1: [0.0] * 3} | {r[0]: discounts(list(r[2:])) for r in stats}
        off = F.create_map(*[x for v, d in found.items() for x in (F.lit(v), F.array(*map(F.lit, d)))])
        own = level.select("voice", F.substring("gram", 1, k - 1).alias("context"), "n")
        big = F.col("n") >= least
        cls = F.least(F.col("n"), F.lit(3)).cast("int")
        sums = [F.sum("n").alias("total"), F.sum(F.when(big, F.col("n"))).alias("mass")] + [F.count_if(big & (cls == c)).alias(f"n{c}") for c in (1, 2, 3)]
        taken = sum((F.col(f"n{c}") * F.get(F.try_element_at(off, "voice"), F.lit(c - 1)) for c in (1, 2, 3)), F.lit(0.0))
        rest = 1 - (F.col("mass") - taken) / F.col("total") * (1 - LEAST_REST)
        contexts = own.groupBy("voice", "context").agg(*sums).where("mass > 0").select("voice", "context", "total", rest.alias("rest"))
        orders.append(Order(level, cut(contexts, f"contexts-{k}"), off, least))
    return Model(orders[::-1])


class Usual:
    """n-grams by their sorted hashes, with a whole number each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    @classmethod
    def of(cls, rows: DataFrame) -> Usual:
        """(voice, gram of ORDER points, value); so few rows that they may be broadcast."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cp = points(batch.column(1).to_pylist())[0].reshape(-1, ORDER)
                keys = hashed(seeds(batch.column(0).to_numpy()), list(cp.T))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(2)], ["h", "value"])

        found = rows.select("voice", "gram", "value").mapInArrow(run, "h long, value long").toArrow()
        return cls(found.column("h").to_numpy().view(np.uint64), found.column("value").to_numpy().astype(np.int32))

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are there, and their numbers; 0 of the others."""
        if not len(self.keys):
            return np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        there = self.keys[at] == asked
        return there, np.where(there, self.values[at], 0).astype(np.int64)


def strings(gram: np.ndarray) -> pa.Array:
    """Rows of ORDER points as strings."""
    text = np.ascontiguousarray(gram).tobytes().decode("utf-32-le", "surrogatepass")
    return pa.array([text[k : k + ORDER] for k in range(0, len(text), ORDER)], pa.string())


def repeated_words(cp: np.ndarray, at: np.ndarray, space: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, its words, and the words that stand in windows of `size` words which occur twice or more in it."""
    ink = np.flatnonzero(~space)
    after = np.concatenate([[True], space[:-1]]) if len(cp) else np.zeros(0, bool)
    after[at[:-1][at[:-1] < len(cp)]] = True
    begins = np.flatnonzero(after[ink])
    n = len(begins)
    ends = np.searchsorted(ink[begins], at) if n else np.zeros(len(at), np.int64)
    words = np.diff(ends)
    if n < size:
        return words, np.zeros(len(words), np.int64)
    lengths = np.diff(np.append(begins, len(ink)))
    place = np.arange(len(ink)) - np.repeat(begins, lengths)
    power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(int(lengths.max()), _A))])
    h = np.add.reduceat((cp[ink] + np.uint64(1)) * power[place], begins)
    h = hashed(lengths.astype(np.uint64), [h, h >> np.uint64(32)])
    text = np.repeat(np.arange(len(words)), words)
    start = np.flatnonzero(text[size - 1 :] == text[: n - size + 1])
    if not len(start):
        return words, np.zeros(len(words), np.int64)
    keys = hashed(text[start].astype(np.uint64) * _B, [h[start + i] for i in range(size)])
    order, first, length = runs(keys)
    twice = start[order[np.repeat(length > 1, length)]]
    cover = np.bincount(twice, minlength=n + size + 1) - np.bincount(twice + size, minlength=n + size + 1)
    covered = np.cumsum(cover)[:n] > 0
    return words, segment_sum(covered.astype(np.int64), ends)


def duplicate_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier one."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    return len(lines) - len(set(lines))


def score_rows(rows: DataFrame, key: str, usual: Usual) -> DataFrame:
    """(key, voice, text, text_hash) to the counts of the rules, and of the normalised text n points with the sums of
    their logarithms (to base 10, in units of 1 / UNIT) and of squares, of the usual n-grams; the others come as a list
    (gram, n), with a number of the row. To be written before that number is used."""
    sent = rows.sparkSession.sparkContext.broadcast(usual)
    kind = rows.schema[key].dataType.simpleString()
    names = [key, "voice", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "points", "log_sum", "square_sum", "row", "others"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, at_row = sent.value, TaskContext.get().partitionId() << 33
        for batch in (part for whole in batches for part in slices(whole, 3)):
            voices = batch.column(1).to_numpy()
            texts = [t or "" for t in batch.column(3).to_pylist()]
            cp, at = points(texts)
            space = blank(cp)
            words, repeated = repeated_words(cp, at, space)
            low = np.minimum(cp, 127)
            symbols = segment_sum((_SYMBOLS[low] & (cp < 127)).astype(np.int64), at)
            chars = segment_sum((~space).astype(np.int64), at)
            wide, starts = spread_out(texts)
            number, offsets, counts, voice, gram = distinct(wide, starts, voices)
            found = np.flatnonzero(counts)
            there, values = told.find(hashed(seeds(voice), list(gram.T)))
            value = np.zeros(len(counts), np.int64)
            value[found] = values
            logs, squares, n = segment_sum(value[number], offsets), segment_sum(((value >> 10) ** 2)[number], offsets), np.diff(offsets)
            lines = pa.array([duplicate_lines(t) for t in texts], pa.int64())
            others = other_grams(number, offsets, found[~there], gram[~there], len(counts))
            row = pa.array(np.arange(at_row, at_row + len(texts)))
            at_row += len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(words), pa.array(chars), pa.array(symbols), lines, pa.array(repeated), pa.array(n), pa.array(logs), pa.array(squares), row, others], names)

    longs = ", ".join(f"{c} long" for c in names[3:-1])
    return rows.select(key, "voice", "text_hash", "text").mapInArrow(run, f"`{key}` {kind}, voice int, text_hash long, {longs}, others array<struct<gram: string, n: long>>")


def other_grams(number: np.ndarray, offsets: np.ndarray, places: np.ndarray, gram: np.ndarray, size: int) -> pa.ListArray:
    """Of each text, the different n-grams with one of the given numbers (under size), and how often it has them."""
    where = np.full(size, -1, np.int32)
    where[places] = np.arange(len(places))
    at = np.flatnonzero(where[number] >= 0)
    text = np.searchsorted(offsets, at, "right") - 1
    pair, n = np.unique(text * np.int64(max(len(places), 1)) + where[number[at]], return_counts=True)
    text, which = np.divmod(pair, max(len(places), 1))
    ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(offsets) - 1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([strings(gram[which]), pa.array(n)], ["gram", "n"]))


def add_others(scored: DataFrame, values: DataFrame) -> DataFrame:
    """Rows of `score_rows`, written, with the sums over all their n-grams. values: (voice, gram, value) of those not sent. None
    of these has many rows, as only what is rare in the corpus is among them."""
    others = scored.select("row", "voice", F.explode("others").alias("o")).select("row", "voice", "o.gram", F.col("o.n").alias("times"))
    met = others.join(values.select("voice", "gram", "value").hint("merge"), ["voice", "gram"])
    more = met.groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("logs"), F.sum(F.col("times") * F.shiftright("value", 10) * F.shiftright("value", 10)).alias("squares"))
    whole = scored.drop("others").join(more.hint("merge"), "row", "left")
    return whole.withColumn("log_sum", F.col("log_sum") + F.coalesce("logs", F.lit(0))).withColumn("square_sum", F.col("square_sum") + F.coalesce("squares", F.lit(0))).drop("row", "logs", "squares")


def quantile(rows: DataFrame, by: list[str], bin_: str, share: float, name: str) -> DataFrame:
    """Of rows (by, bin, n), bins of whole numbers: the least bin up to which `share` of the group's rows lie."""
    total = rows.groupBy(*by).agg(F.sum("n").alias("_all"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy(bin_))
    met = rows.withColumn("_upto", upto).join(total, by)
    return met.where(F.col("_upto") >= F.col("_all") * share).groupBy(*by).agg(F.min(bin_).alias(name))


def bands(scored: DataFrame) -> DataFrame:
    """(voice, octave) to middle and spread: of mean logarithms their median in the language, and how far a text's mean
    strays, times the root of its points. Of equal texts one counts; octave: the logarithm of points to base 2, rounded down.

    The spread is the interquartile range of the class of lengths over that of the normal distribution, drawn to the
    language's own with the weight of PRIOR texts, and at least LEAST_SPREAD of the variance of single points.
    """
    mean = F.col("log_sum") / F.col("points") / UNIT
    texts = scored.where("NOT base_failed").groupBy("voice", "text_hash").agg(F.min("points").alias("points"), F.min("log_sum").alias("log_sum"), F.min("square_sum").alias("square_sum"))
    texts = cut(texts.select("voice", F.floor(F.log2("points") + 1e-9).cast("int").alias("octave"), "points", mean.alias("mean"), (F.col("square_sum") / F.col("points") / (1 << 20) - mean * mean).alias("own")), "texts")
    one = F.count(F.lit(1)).alias("n")
    middle = quantile(texts.groupBy("voice", F.floor(F.col("mean") * 4096).alias("bin")).agg(one), ["voice"], "bin", 0.5, "m").select("voice", ((F.col("m") + 0.5) / 4096).alias("middle"))
    single = texts.groupBy("voice").agg(F.avg(F.round("own", 6)).alias("single"))
    strays = texts.join(F.broadcast(middle), "voice").select("voice", "octave", F.floor((F.col("mean") - F.col("middle")) * F.sqrt("points") * 64).alias("bin"))
    bins = cut(strays.groupBy("voice", "octave", "bin").agg(one), "bins")

    def spread(rows: DataFrame, by: list[str], name: str) -> DataFrame:
        met = quantile(rows, by, "bin", 0.25, "q1").join(quantile(rows, by, "bin", 0.75, "q3"), by)
        return met.select(*by, ((F.col("q3") - F.col("q1")) / 64 / 1.349).alias(name))

    whole = spread(bins.groupBy("voice", "bin").agg(F.sum("n").alias("n")), ["voice"], "whole")
    own = spread(bins, ["voice", "octave"], "part").join(bins.groupBy("voice", "octave").agg(F.sum("n").alias("n")), ["voice", "octave"])
    met = own.join(whole, "voice").join(single, "voice").join(middle, "voice")
    drawn = (F.col("n") * F.col("part") ** 2 + PRIOR * F.col("whole") ** 2) / (F.col("n") + PRIOR)
    return met.select("voice", "octave", "middle", F.sqrt(F.greatest(drawn, LEAST_SPREAD * F.col("single"))).alias("spread"))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", kept: int | None = None, sent: int = KEPT) -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity, least, most.

    base_failed: under 10 words, or over a fifth of them in repeated 5-word windows. kept: it did not fail, and its
    perplexity a code point lies in the band (least to most) of its language and length. Null texts count as empty, and a
    null language is one of its own; empty and very long texts (a task needs some 50 bytes for each of its code points), repeated rows and rows without a key are judged by their
    own text like any other. An empty table gives no rows; further columns are ignored.

    kept: see `fit`. sent: n-grams that are broadcast at most; the result is the same for any number. Counting and fitting run
    while the DataFrame is built; scores are a table of the shared folder.
    """
    names = large_languages(docs, lang)
    rows = docs.select(F.col(key), voice_of(F.col(lang), names).alias("voice"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    counts = cut(count_grams(rows), "grams")
    value = F.rint(F.log10("p") * UNIT).cast("long")
    values = cut(fit(counts, kept).probabilities(counts).select("voice", "gram", "n", value.alias("value")), "values")
    least = max(1, -(-(values.agg(F.sum("n")).first()[0] or 0) // sent))
    usual = Usual.of(values.where(F.col("n") >= least))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = cut(score_rows(rows, key, usual), "usual")
    scored = cut(add_others(scored, values.where(F.col("n") < least)).withColumn("base_failed", failed), "scored")
    limits = bands(scored)  # at most SHARE + 1 languages by 64 octaves
    met = scored.withColumn("octave", F.floor(F.log2("points") + 1e-9).cast("int")).join(F.broadcast(limits), ["voice", "octave"], "left")
    mean = F.col("log_sum") / F.col("points") / UNIT
    reach = WIDTH * F.col("spread") / F.sqrt("points")
    inside = (mean >= F.col("middle") - reach) & (mean <= F.col("middle") + reach)
    told = [F.pow(F.lit(10.0), -mean).alias("perplexity"), F.pow(F.lit(10.0), -F.col("middle") - reach).alias("least"), F.pow(F.lit(10.0), reach - F.col("middle")).alias("most")]
    return met.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"), *told)


def op11_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
