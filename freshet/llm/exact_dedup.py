"""Exact deduplication by composable polynomial fingerprints and chunkwise comparison.

A text's fingerprint is the sum of (byte + 1) * base**i modulo two primes. Chunks are hashed by themselves and combined
by shifting each with the length before it, so a huge text can be hashed in parts, in any order, by several tasks.
Texts of over HUGE code points become a row a piece, so that several tasks hash them, and an aggregate combines the parts.
Rows whose fingerprints and lengths agree are then compared byte by byte, chunk after chunk, against one row of their
run; nothing is dropped on a fingerprint's word alone. Only these rows' texts are shuffled: a bit map of fixed size over
their keys meets all rows by broadcast, and lets few others pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hot_keys, salted_join, segment_sum, small_batches, table, utf8_bytes

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Bytes hashed as one chunk: products stay under 2**39, so that a chunk's sum fits in 64 bits.
CHUNK = 4096
#: Bytes compared at a time.
COMPARE = 1 << 16
#: Code points from which on a text is hashed in pieces of as many, by several tasks.
HUGE = 1 << 22
#: Bits of the map of keys whose texts are compared: 2 MB to broadcast, at most.
BITS = 1 << 24

_POWERS = [np.array([pow(b, i, p) for i in range(CHUNK)], np.int64) for b, p in zip(BASES, PRIMES)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shift(fingerprint: int, length: int, which: int) -> int:
    """A chunk's fingerprint as it counts after `length` bytes."""
    return fingerprint * pow(BASES[which], length, PRIMES[which]) % PRIMES[which]


def combine(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    """Of two adjacent parts (length, fingerprint modulo each prime), that of the whole. Associative."""
    return a[0] + b[0], (a[1] + shift(b[1], a[0], 0)) % PRIMES[0], (a[2] + shift(b[2], a[0], 1)) % PRIMES[1]


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 62-bit fingerprint for each stretch of data between offsets: chunk hashes, then their shifted sums."""
    lengths = np.diff(offsets)
    counts = -(-lengths // CHUNK)
    first = np.concatenate([[0], np.cumsum(counts)])
    number = np.arange(first[-1]) - np.repeat(first[:-1], counts)
    starts = np.repeat(offsets[:-1], counts) + number * CHUNK
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    value = data.astype(np.int64) + 1
    parts = []
    for which, prime in enumerate(PRIMES):
        hashes = segment_sum(value * _POWERS[which][place], np.append(starts, len(data))) % prime
        step, shifts = pow(BASES[which], CHUNK, prime), [1]
        for _ in range(int(number.max(initial=0))):
            shifts.append(shifts[-1] * step % prime)
        parts.append(segment_sum(hashes * np.array(shifts, np.int64)[number] % prime, first) % prime)
    return parts[0] << 31 | parts[1]


def normalise(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without ASCII white space."""
    kept = ~_SPACE[raw]
    count = np.concatenate([[0], np.cumsum(kept)])
    return raw[kept], count[offsets]


def fingerprint_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """key, n_points (code points of the text), norm_len, fp, text_sha256; with_text: norm (bytes) in place of the digest."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = utf8_bytes(batch.column(1))
            points = segment_sum(((raw & 0xC0) != 0x80).astype(np.int64), ends)
            norm, at = normalise(raw, ends)
            view = memoryview(np.ascontiguousarray(norm))
            spans = list(zip(at[:-1].tolist(), at[1:].tolist()))
            if with_text:
                last = pa.array([bytes(view[a:b]) for a, b in spans], pa.binary())
            else:
                last = pa.array([hashlib.sha256(view[a:b]).digest() for a, b in spans], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(points), pa.array(np.diff(at)), pa.array(fingerprints(norm, at)), last], [key, "n_points", "norm_len", "fp", "norm" if with_text else "sha"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_points long, norm_len long, fp long, {'norm' if with_text else 'sha'} binary")


def huge_rows(docs: DataFrame, key: str, text: str, huge: int) -> DataFrame:
    """As fingerprint_rows, of texts over `huge` code points: each piece is hashed by itself, and the parts are combined."""
    kind = docs.schema[key].dataType.simpleString()
    n = F.length(text)
    norm = F.regexp_replace(F.col(text), r"[\x20\x09-\x0D]", "")
    whole = docs.where(n > huge).select(F.monotonically_increasing_id().alias("row"), key, n.cast("long").alias("n_points"), F.sha2(norm, 256).alias("sha"), text)
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(n / huge).cast("int") - 1), lambda i: F.substring(F.col(text), i * huge + 1, F.lit(huge)))
    dealt = whole.select("row", key, "n_points", "sha", F.posexplode(pieces).alias("pos", "piece")).repartition("row", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = utf8_bytes(batch.column(5))
            norm, at = normalise(raw, ends)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.diff(at)), pa.array(fingerprints(norm, at))], ["row", key, "n_points", "sha", "pos", "length", "fp"])

    parts = dealt.mapInArrow(run, f"row long, `{key}` {kind}, n_points long, sha string, pos int, length long, fp long")
    listed = parts.groupBy("row").agg(F.first(key).alias(key), F.first("n_points").alias("n_points"), F.first("sha").alias("sha"), F.array_sort(F.collect_list(F.struct("pos", "length", "fp"))).alias("p"))

    @F.pandas_udf("struct<length: long, fp: long>")
    def joined(lengths: pd.Series, prints: pd.Series) -> pd.DataFrame:
        out = []
        for n, f in zip(lengths, prints):
            whole = reduce(combine, [(int(a), int(b) >> 31, int(b) & 0x7FFFFFFF) for a, b in zip(n, f)])
            out.append((whole[0], whole[1] << 31 | whole[2]))
        return pd.DataFrame(out, columns=["length", "fp"])

    met = listed.withColumn("w", joined("p.length", "p.fp"))
    return met.select(key, "n_points", F.col("w.length").alias("norm_len"), F.col("w.fp").alias("fp"), F.unhex("sha").alias("sha"))


def _same(a: bytes, b: bytes) -> bool:
    return len(a) == len(b) and all(a[i : i + COMPARE] == b[i : i + COMPARE] for i in range(0, len(a), COMPARE))


def compare_runs(rows: DataFrame, key: str) -> DataFrame:
    """Stream over rows sorted by (fp, norm_len): each gets `same`, the key of the first row of its run with its bytes.

    rows: key, fp, norm_len, norm. Only the different texts of the present run are held, one unless fingerprints
    collide. norm stays with the rows that are first and is null elsewhere.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, firsts = None, []
        for batch in batches:
            same, kept = [], []
            for k, fp, n, norm in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (fp, n):
                    now, firsts = (fp, n), []
                found = next((f for f, t in firsts if _same(t, norm)), None)
                if found is None:
                    firsts.append((k, norm))
                same.append(k if found is None else found)
                kept.append(norm if found is None else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(same, batch.column(0).type), pa.array(kept, pa.binary())], [key, "fp", "norm_len", "same", "norm"])

    return rows.select(key, "fp", "norm_len", "norm").mapInArrow(run, f"`{key}` {kind}, fp long, norm_len long, same {kind}, norm binary")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", huge: int = HUGE) -> DataFrame:
    """Groups of equal texts: key, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical without ASCII white space. Null counts as empty, and all empty texts are one group.
    The row with the most code points in the original text stays, then the smallest key. Repeated rows (one key
    twice) each count in group_size and share keep_id and kept; rows without a key stand alone. An empty table gives no rows; further columns are
    ignored. Groups of any size are dealt over many tasks: large fingerprints by a salt of their rows.
    huge: code points from which on a text is hashed in pieces.
    """
    ids = ["fp", "norm_len"]
    docs = docs.select(key, text)
    short = docs.where(F.coalesce(F.length(text), F.lit(0)) <= huge)
    prints = cut(fingerprint_rows(short, key, text).unionByName(huge_rows(docs, key, text, huge)), "fingerprints")
    total = prints.count()
    many = prints.groupBy(*ids).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    many = cut(many, "fingerprint-groups")
    hot = hot_keys(many, ids, "n", total)

    # byte-wise: rows meet the others of their fingerprint (and salt), then the firsts of each run meet
    slot = F.pmod(F.xxhash64(key), F.lit(BITS))
    word, bit = F.floor(slot / 64), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    asked = salted_join(prints.select(key, *ids), many.select(*ids), ids, hot, key)
    bits = cut(asked.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")), "key-bits")  # at most BITS / 64 rows
    passed = docs.withColumn("word", word).join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(bit) != 0).select(key, text)
    rows = salted_join(fingerprint_rows(passed, key, text, with_text=True).select(key, *ids, "norm"), many.select(*ids), ids, hot, key)
    runs = cut(compare_runs(rows.sortWithinPartitions(*ids, "_salt", key), key), "compared")
    firsts = runs.where("norm is not null").select(key, *ids, "norm")
    several = firsts.groupBy(*ids).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*ids)
    meet = firsts.join(several, ids, "left_semi").repartition(*ids).sortWithinPartitions(*ids, key)
    roots = compare_runs(meet, key).select(*ids, F.col(key).alias("same"), F.col("same").alias("root")).distinct()

    members = runs.select(key, *ids, "same").distinct().join(roots, [*ids, "same"], "left").select(key, *ids, F.coalesce("root", "same").alias("root"))
    # a key may stand for several texts, so a row is known by its key and fingerprint
    classed = prints.join(members, [key, *ids], "left").withColumn("root", F.coalesce("root", key))
    classed = cut(classed, "classes")
    group = ["root", *ids]
    sizes = classed.groupBy(*group).agg(F.count(F.lit(1)).alias("group_size"), F.max("n_points").alias("top"))
    sizes = sizes.where("group_size > 1")
    big = hot_keys(sizes, group, "group_size", total)
    best = salted_join(classed, sizes.select(*group, "top"), group, big, key).where("n_points = top").groupBy(*group).agg(F.min(key).alias("keep_id"))
    groups = cut(sizes.join(best, group), "groups")
    out = salted_join(classed, groups.select(*group, "keep_id", "group_size"), group, hot_keys(groups, group, "group_size", total), key, how="left")
    keep = F.coalesce("keep_id", key)
    return out.select(F.col(key), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.coalesce(F.col(key) == keep, F.lit(True)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_points DESC, doc_id) AS keep_id FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
