"""Near-duplicate classes by Order MinHash and banded alignment.

A text is its sequence of overlapping five-word shingles, each labelled with its occurrence number in the text. For
each band one random order of all labelled shingles picks the text's few least ones; the band's key hashes these in the
order in which the text has them, so texts meet if they share the shingles and their order. Candidates are verified by
aligning the two labelled sequences inside a diagonal band: with L aligned of n and m shingles the similarity is
L / (n + m - L), an order-aware Jaccard similarity.

Texts with equal words are collapsed first. In a bucket every text is verified against one hub, another one in each
band. Where the links so far leave a bucket in several components, each text outside its largest component is compared
with all texts of other components there, blockwise: no pair of candidates that could join two classes is skipped.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hot_keys, salted_join, small_batches, table
from .components import connected_components

#: Bound of the memo of word hashes in a worker.
MEMO = 400_000
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Options:
    """words: of a shingle. bands, least: orders, and shingles that each picks. At similarity 0.8 one band meets with
    probability about 0.8**4, so that 12 miss a pair with probability 0.002; at 0.9, below 1e-5."""

    similarity: float = 0.8
    words: int = 5
    bands: int = 12
    least: int = 4
    seed: int = 1


class _Hash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str | None, memo: dict) -> np.ndarray:
    """Hashes of the lower-cased words; a text without words is one word, itself."""
    words = _WORD.findall((text or "").lower()) or [f"\0{text or ''}"]
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def shingles(words: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Labelled shingles of several texts, one after another, and their offsets. A text of under k words has one."""
    lengths = np.array([len(w) for w in words], np.int64)
    counts = np.maximum(lengths - k + 1, 1)
    ends = np.concatenate([[0], np.cumsum(counts)])
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    starts = np.repeat(np.concatenate([[0], np.cumsum(lengths)])[:-1], counts) + np.arange(ends[-1]) - np.repeat(ends[:-1], counts)
    stop = np.repeat(np.cumsum(lengths), counts)
    out = np.zeros(ends[-1], np.uint64)
    for i in range(k):
        at = starts + i
        out = np.where(at < stop, _mix(out * _MIX + flat[np.minimum(at, max(len(flat) - 1, 0))]), out) if len(flat) else out
    # occurrence numbers: rank among equal shingles of the same text
    doc = np.repeat(np.arange(len(words)), counts)
    tagged = out + _mix(doc.astype(np.uint64) * _MIX)
    order = np.argsort(tagged, kind="stable")
    run = np.concatenate([[True], tagged[order][1:] != tagged[order][:-1]]) if len(order) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(run, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
    number = np.empty(len(order), np.uint64)
    number[order] = (np.arange(len(order)) - first).astype(np.uint64)
    return _mix(out + number * _MIX), ends


def order_minhash(labelled: np.ndarray, ends: np.ndarray, options: Options) -> np.ndarray:
    """Band keys, one row a text: a hash of its least shingles under the band's order, in text order."""
    n, texts = np.diff(ends), len(ends) - 1
    doc = np.repeat(np.arange(texts), n)
    # the least few of n values lie below 4 * least / n of the range, nearly always
    cut_at = np.where(n > 4 * options.least, (4 * options.least / np.maximum(n, 1) * 2.0**64).clip(max=2.0**64 - 4096), 2.0**64 - 4096).astype(np.uint64)
    limit = np.where(n > 4 * options.least, cut_at, _LAST)[doc]
    want = np.minimum(n, options.least)
    out = np.zeros((texts, options.bands), np.uint64)
    numbers = np.random.default_rng(options.seed).integers(1, 2**63, options.bands, dtype=np.uint64)
    for band, salt in enumerate(numbers):
        h = _mix(labelled ^ salt)
        at = np.flatnonzero(h <= limit)
        short = np.flatnonzero(np.bincount(doc[at], minlength=texts) < want)
        if len(short):
            at = np.union1d(at, np.concatenate([np.arange(ends[i], ends[i + 1]) for i in short]))
        at = at[np.lexsort((h[at], doc[at]))]
        d = doc[at]
        start = np.searchsorted(d, np.arange(texts))
        at = np.sort(at[np.arange(len(at)) - start[d] < options.least])
        key, d = np.full(texts, salt, np.uint64), doc[at]
        start = np.searchsorted(d, np.arange(texts))
        place = np.arange(len(at)) - start[d]
        for i in range(options.least):
            own = place == i
            key[d[own]] = _mix(key[d[own]] * _MIX + h[at[own]])
        out[:, band] = key
    return out


def aligned(sorted_a: np.ndarray, order_a: np.ndarray, b: np.ndarray, similarity: float) -> float:
    """Similarity of two labelled sequences by alignment within the band that `similarity` allows; 0 if below it for sure.

    sorted_a, order_a: a's shingles in ascending order and their places. Labels are unique in a text, so the longest
    common subsequence is the longest increasing run of matched places.
    """
    n, m = len(sorted_a), len(b)
    least = similarity / (1 + similarity) * (n + m)
    if min(n, m) < least - 1e-9:
        return 0.0
    band = n + m - 2 * least
    at = np.minimum(np.searchsorted(sorted_a, b), n - 1)
    j = np.flatnonzero(sorted_a[at] == b)
    i = order_a[at[j]]
    i = i[np.abs(i - j) <= band + 1e-9]
    if len(i) < least - 1e-9:
        return 0.0
    if not (np.diff(i) > 0).all():
        tails: list[int] = []
        for x in i.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        common = len(tails)
    else:
        common = len(i)
    return common / (n + m - common)


def sketch(docs: DataFrame, options: Options) -> DataFrame:
    """doc_id, n shingles, w1 and w2 (128 bits of the word sequence), keys: the band keys."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hash()
        for batch in batches:
            words = [word_hashes(t, memo) for t in batch.column(1).to_pylist()]
            labelled, ends = shingles(words, options.words)
            keys = order_minhash(labelled, ends, options).view(np.int64)
            whole = np.array([(xxhash.xxh64_intdigest(w.tobytes(), 1), xxhash.xxh64_intdigest(w.tobytes(), 2)) for w in words], np.uint64).reshape(-1, 2).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * options.bands, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), pa.array(whole[:, 0].copy()), pa.array(whole[:, 1].copy()), lists], ["doc_id", "n", "w1", "w2", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, w1 long, w2 long, keys array<long>")


class Held:
    """The sequences that a group's other texts are compared with, and an index of their labels."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.classes: list[int] = []
        self.sorted: list[np.ndarray] = []
        self.order: list[np.ndarray] = []
        self.all: np.ndarray | None = None
        self.parent: dict[int, int] = {}

    def find(self, label: int) -> int:
        """What a label has come to be joined with inside this group."""
        while (up := self.parent.get(label, label)) != label:
            label = up
        return label

    def add(self, doc: int, label: int, labelled: np.ndarray) -> None:
        order = np.argsort(labelled, kind="stable")
        self.ids.append(doc)
        self.classes.append(label)
        self.sorted.append(labelled[order])
        self.order.append(order)
        self.all = None

    def links(self, label: int, b: np.ndarray, similarity: float) -> list[int]:
        """Ids of sequences that align with b, one at most for each label that was not joined with b's before.

        Only those that share enough labels are aligned: no alignment can have more pairs than there are shared labels.
        """
        if not self.ids:
            return []
        if self.all is None:
            self.lengths, self.roots = np.array([len(x) for x in self.sorted]), np.array([self.find(c) for c in self.classes])
            flat = np.concatenate(self.sorted)
            order = np.argsort(flat, kind="stable")
            self.all, self.owner = flat[order], np.repeat(np.arange(len(self.ids)), self.lengths)[order]
        root = self.find(label)
        if (self.roots == root).all():
            return []
        low, high = np.searchsorted(self.all, b, "left"), np.searchsorted(self.all, b, "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        shared = np.bincount(self.owner[at], minlength=len(self.ids))
        enough = (shared >= similarity / (1 + similarity) * (self.lengths + len(b)) - 1e-9) & (self.roots != root)
        out = []
        for i in np.flatnonzero(enough):
            if self.roots[i] != root and aligned(self.sorted[i], self.order[i], b, similarity) >= similarity - 1e-12:
                out.append(self.ids[i])
                self.parent[int(self.roots[i])] = root
                self.roots[self.roots == self.roots[i]] = root
        return out


def _verify(rows: DataFrame, group: list[str], options: Options) -> DataFrame:
    """Links (a, b) of rows that stream in groups, those of kind 0 (held, with their shingles) before those of kind 1.

    Columns: the group's, kind, doc_id, label, text. Rows of one label are not compared with each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, now, held = _Hash(), None, Held()
        for batch in batches:
            kinds, ids, labels, texts = (batch.column(len(group) + i).to_pylist() for i in range(4))
            groups = list(zip(*(batch.column(i).to_pylist() for i in range(len(group)))))
            labelled, ends = shingles([word_hashes(t, memo) for t in texts], options.words)
            links = []
            for i, own in enumerate(groups):
                if own != now:
                    now, held = own, Held()
                b = labelled[ends[i] : ends[i + 1]]
                if kinds[i] == 0:
                    held.add(ids[i], labels[i], b)
                else:
                    links += [(doc, ids[i]) for doc in held.links(labels[i], b, options.similarity)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    ordered = rows.select(*group, "kind", "doc_id", "label", "text").repartition(*group).sortWithinPartitions(*group, "kind", "doc_id")
    return ordered.mapInArrow(run, "a long, b long")


def near_duplicate_classes(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), class_size, kept (doc_id is class_id): one row a document.

    Words are runs of letters, digits and underscores, lower-cased, so case and punctuation do not tell texts apart.
    Texts without words are equal only if identical; null counts as empty; texts of under five words are equal only if
    their words are. Rows of one doc_id are one document: they share their class, and if their texts differ it has the
    links of all of them. Rows without a doc_id are left out, for nothing could name them.
    An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    sketches = cut(sketch(docs, options), "sketches")
    total = sketches.count()
    whole = ["w1", "w2"]
    equal = cut(sketches.groupBy(*whole).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size")), "equal-words")

    # buckets of different texts; a row of sketches stands for its words
    firsts = equal.select(F.col("first").alias("doc_id"), *whole)
    one = sketches.join(firsts, ["doc_id", *whole], "left_semi").select("doc_id", *whole, "keys").dropDuplicates(["doc_id", *whole])
    entries = one.select("doc_id", F.posexplode("keys").alias("band", "key"))
    bucket = ["band", "key"]
    rank = F.struct(F.xxhash64("doc_id", "band", "key").alias("h"), F.col("doc_id").alias("hub"))
    buckets = cut(entries.groupBy(*bucket).agg(F.min(rank).getField("hub").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    hot = hot_keys(buckets, bucket, "n", total)
    members = cut(salted_join(entries, buckets, bucket, hot, "doc_id").select(*bucket, "doc_id", "hub", "n"), "members")

    # the texts of all buckets, fetched once for both rounds
    texts = cut(docs.join(members.select("doc_id").distinct().hint("merge"), "doc_id"), "texts")

    # each text against the hubs of its buckets
    pairs = members.where("doc_id <> hub").groupBy("hub", "doc_id").agg(F.max(F.ceil(F.col("n") / 256)).alias("salts"))
    pairs = cut(pairs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), "salts")), "pairs")
    group = ["hub", "salts", "salt"]
    rows = pairs.select(*group, F.lit(1).alias("kind"), "doc_id").unionByName(pairs.select(*group).distinct().select(*group, F.lit(0).alias("kind"), F.col("hub").alias("doc_id")))
    links = cut(_verify(rows.hint("merge").join(texts, "doc_id").withColumn("label", F.col("doc_id")), group, options), "links")
    # a doc_id with several texts joins their groups
    shared = sketches.groupBy("doc_id").agg(F.min(F.struct(*whole)).alias("low"), F.max(F.struct(*whole)).alias("high")).where("low <> high").select("doc_id")
    firsts = sketches.join(shared, "doc_id", "left_semi").select("doc_id", *whole).distinct().join(equal, whole).select("doc_id", "first")
    links = links.unionByName(firsts.join(firsts.groupBy("doc_id").agg(F.min("first").alias("a")), "doc_id").select("a", F.col("first").alias("b")).where("a <> b"))
    labels = connected_components(links)

    # texts outside the largest component of a bucket, against all others there
    known = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(*bucket, "doc_id", F.coalesce("label", "doc_id").alias("label"))
    known = cut(known, "known")
    parts = known.groupBy(*bucket, "label").agg(F.count(F.lit(1)).alias("n"))
    open_buckets = parts.groupBy(*bucket).agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    open_buckets = cut(open_buckets.select(*bucket, F.col("top.label").alias("main"), "n", F.ceil((F.col("n") - F.col("top.n")) / 128).alias("blocks"), F.ceil(F.col("n") / 512).alias("salts")), "open")
    here = cut(salted_join(known, open_buckets, bucket, hot_keys(open_buckets, bucket, "n", total), "doc_id"), "open-members")
    if not here.isEmpty():
        h = F.xxhash64("doc_id", F.lit(1))
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c).cast("int") - 1))
        stray = here.where("label <> main").select(*bucket, F.pmod(h, "blocks").cast("int").alias("block"), every("salts").alias("salt"), F.lit(0).alias("kind"), "doc_id", "label")
        other = here.select(*bucket, every("blocks").alias("block"), F.pmod(h, "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), "doc_id", "label")
        more = cut(_verify(stray.unionByName(other).hint("merge").join(texts, "doc_id"), [*bucket, "block", "salt"], options), "links").distinct()
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = connected_components(links)

    # back to documents
    named = equal.join(labels.withColumnRenamed("node", "first"), "first", "left").select(*whole, "first", "size", F.coalesce("label", "first").alias("label"))
    classes = cut(named.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("size").alias("class_size")), "classes")
    sized = salted_join(named, classes, ["label"], hot_keys(classes, ["label"], "class_size", total), "first")
    sized = cut(sized.select(*whole, "class_id", "class_size"), "classed")
    big = equal.where(F.col("size") >= max(1000, total // 1000)).select(*whole)
    out = salted_join(sketches.select("doc_id", *whole), sized, whole, big, "doc_id")
    return out.select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
