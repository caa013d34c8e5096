"""Grouping of spelling variants by neighbourhoods of one edit, guided by Bloom filters.

A word's neighbours at one edit are probed, not searched for: every deletion and every replacement of a letter is hashed
and looked up in Bloom filters of the vocabulary, one for each length (split into parts where a length has very many
words). A filter's blocks are single 64-bit words, so a probe costs one memory access. Insertions are the deletions seen
from the other word. Only what the filters let pass is shuffled, to an exact join with the vocabulary that drops false
positives and tells the counts. Filters are broadcast in rounds of at most `round_bytes`, so that what is sent has a bound
whatever the vocabulary: a larger one takes more rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Letters of words: every one of them is one byte of Latin-1.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of filter for each word, and bits set in a word's block.
BITS_A_WORD, SET = 24, 4
#: Filter bytes that are broadcast in one round, and those of one part.
ROUND_BYTES, PART_BYTES = 64 << 20, 8 << 20
#: Probes that a task holds at a time.
PROBES = 1 << 21

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def misspelt(doc_id: Column, run: Column, every: int) -> Column:
    """run without the code point h % length where `every` divides h, the crc32 of `<doc_id>:<run>`; unchanged else."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run).cast("long")).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, every: int | None = None) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, of `least_length` code points and `least_count` occurrences in all texts.

    every: one run in about so many loses a letter first (a planted misspelling); None leaves all as they are.
    """
    runs = docs.select(F.col(key).alias("_key"), F.explode(F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("run"))
    word = misspelt(F.col("_key"), F.col("run"), every) if every else F.col("run")
    words = runs.select(word.alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def letters(words: pa.Array, length: int) -> np.ndarray:
    """Words of one length as a matrix of Latin-1 bytes."""
    return np.frombuffer("".join(words.to_pylist()).encode("latin-1"), np.uint8).reshape(-1, length)


def powers(length: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(length, _BASE))])


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a polynomial's bits over all 64."""
    h = (h ^ h >> np.uint64(30)) * _A
    h = (h ^ h >> np.uint64(27)) * _B
    return h ^ h >> np.uint64(31)


def places(h: np.ndarray, parts: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of mixed hashes: the part, the block inside it, and the block's bits."""
    top, low = h >> np.uint64(32), h & np.uint64(0xFFFFFFFF)
    part = top % np.uint64(parts)
    block = top // np.uint64(parts) % np.uint64(blocks)
    bits = np.zeros(h.shape, np.uint64)
    for i in range(SET):
        bits |= np.uint64(1) << (low >> np.uint64(6 * i) & np.uint64(63))
    return part, block, bits


def rounds_of(sizes: dict[int, int], round_bytes: int = ROUND_BYTES, part_bytes: int = PART_BYTES) -> tuple[dict[int, tuple[int, int]], list[list[tuple[int, int]]]]:
    """From words a length: parts and blocks a part of each length, and the (length, part) filters of each round."""
    plan, rounds, room = {}, [], 0
    for length, n in sorted(sizes.items()):
        blocks = max(1, -(-n * BITS_A_WORD // 64))
        parts = -(-blocks * 8 // part_bytes)
        blocks = -(-blocks // parts)
        plan[length] = (parts, blocks)
        for part in range(parts):
            if not rounds or room + blocks * 8 > round_bytes:
                rounds.append([])
                room = 0
            rounds[-1].append((length, part))
            room += blocks * 8
    return plan, rounds


def filters(words: DataFrame, plan: dict[int, tuple[int, int]], wanted: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """The blocks of the wanted filters: bits are joined with OR by Spark, block by block."""
    parts = set(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for length in np.unique(sizes).tolist():
                w = letters(batch.column(0).filter(pa.array(sizes == length)), length)
                part, block, bits = places(mixed((w * powers(length)[:length]).sum(axis=1, dtype=np.uint64)), *plan[length])
                held = np.isin(part, [p for n, p in parts if n == length])
                n = int(held.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, length), pa.int32()), pa.array(part[held].astype(np.int32)), pa.array(block[held].astype(np.int32)), pa.array(bits[held].view(np.int64))], ["length", "part", "block", "bits"])

    kept = words.where(F.col("length").isin(sorted({n for n, _ in wanted}))).select("word", "length")
    rows = kept.mapInArrow(run, "length int, part int, block int, bits long").groupBy("length", "part", "block").agg(F.bit_or("bits").alias("bits"))
    found = rows.toArrow()
    length, part, block, bits = (c.to_numpy() for c in found.columns)
    out = {}
    for n, p in wanted:
        here = (length == n) & (part == p)
        out[n, p] = np.zeros(plan[n][1], np.uint64)
        out[n, p][block[here]] = bits[here].view(np.uint64)
    return out


def passed(h: np.ndarray, length: int, plan: dict, held: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """Which probes of `length` letters the held filters let pass."""
    ok = np.zeros(h.shape, bool)
    if length not in plan:
        return ok
    part, block, bits = places(mixed(h), *plan[length])
    for p in range(plan[length][0]):
        if (length, p) in held:
            here = (part == p) if plan[length][0] > 1 else slice(None)
            ok[here] = held[length, p][block[here]] & bits[here] == bits[here]
    return ok


def candidates(w: np.ndarray, alphabet: np.ndarray, plan: dict, held: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For words of one length: (which word, the edited bytes) of deletions and replacements that pass, each edit once.

    Of replacements only those by a greater letter are probed, since the other word probes the reverse.
    """
    n, length = w.shape
    power = powers(length)
    term = w * power[:length]
    before = np.zeros((n, length + 1), np.uint64)
    np.cumsum(term, axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    if length - 1 in plan:
        # letters after the lost one move down a place; a lost letter equal to the one before gives the same word
        after = np.zeros((n, length), np.uint64)
        after[:, :-1] = np.cumsum((w[:, 1:] * power[: length - 1])[:, ::-1], axis=1)[:, ::-1]
        ok = passed(before[:, :length] + after, length - 1, plan, held)
        ok[:, 1:] &= w[:, 1:] != w[:, :-1]
        which, at = np.nonzero(ok)
        if len(which):
            keep = np.arange(length)[None, :] != at[:, None]
            yield which, w[which][keep].reshape(-1, length - 1)
    if any(size == length for size, _ in held):
        for i in range(length):
            h = (whole - term[:, i : i + 1]) + alphabet[None, :].astype(np.uint64) * power[i]
            later = alphabet[None, :] > w[:, i : i + 1]
            which, letter = np.nonzero(later)
            ok = passed(h[later], length, plan, held)
            which, letter = which[ok], letter[ok]
            if len(which):
                out = w[which].copy()
                out[:, i] = alphabet[letter]
                yield which, out


def near_pairs(words: DataFrame, round_bytes: int = ROUND_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """All pairs of words that differ by one edit, both ways round: word, near, near_n. words: word, n, written."""
    spark = words.sparkSession
    sized = words.select("word", F.length("word").alias("length"), "n")
    sizes = {r[0]: r[1] for r in sized.groupBy("length").count().collect()}
    singles = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()
    alphabet = np.array(sorted(ord(r[0]) for r in singles), np.uint8)  # at most the 90 letters
    plan, rounds = rounds_of(sizes, round_bytes, part_bytes)
    found = None
    for wanted in rounds:
        sent = spark.sparkContext.broadcast(filters(sized, plan, wanted))
        has = {n for n, _ in wanted}

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = sent.value
            for batch in batches:
                lengths = batch.column(1).to_numpy()
                for length in np.unique(lengths).tolist():
                    own = batch.filter(pa.array(lengths == length))
                    step = max(1, PROBES // (len(alphabet) + length))
                    for at in range(0, own.num_rows, step):
                        part = own.slice(at, step)
                        w = letters(part.column(0), length)
                        for which, edited in candidates(w, alphabet, plan, held):
                            size = edited.shape[1]
                            text = edited.tobytes().decode("latin-1")
                            cand = pa.array([text[k : k + size] for k in range(0, len(text), size)], pa.string())
                            of = pa.array(which)
                            yield pa.RecordBatch.from_arrays([cand, part.column(0).take(of).cast(pa.string()), part.column(2).take(of)], ["cand", "word", "n"])

        asking = sized.where(F.col("length").isin(sorted(has | {n + 1 for n in has})))
        got = asking.mapInArrow(run, "cand string, word string, n long")
        found = got if found is None else found.unionByName(got)
    if found is None:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n"))
    exact = cut(found.join(words.select(F.col("word").alias("cand"), F.col("n").alias("cand_n")).hint("merge"), "cand"), "near-words")
    return exact.select("word", F.col("cand").alias("near"), F.col("cand_n").alias("near_n")).unionByName(exact.select(F.col("cand").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root), the last of the forms that follow: each round doubles the steps taken."""
    at = cut(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("done")), "roots")
    while not at.where("not done").isEmpty():
        jump = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = at.where("not done").join(jump.hint("merge"), "root", "left")
        moved = met.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNull().alias("done"))
        at = cut(at.where("done").unionByName(moved), "roots")
    return at.select("word", "root")


def spelling_forms(words: DataFrame, ratio: int = 2, round_bytes: int = ROUND_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """From (word, n), a row a word, words of letters of Latin-1: word, form, root, n, n_near, form_n.

    Two words are near if one code point inserted, deleted or replaced makes one the other. A word's form is its near word
    of largest n, of ties the least in code-point order, if that has `ratio` times the word's n or more; else null. root
    follows forms to the last one and is the word itself where it has no form. Rows whose word is null or empty are left
    out, repeated words must be summed before; an empty table gives no rows and further columns are ignored.

    Most of the work runs while the DataFrame is built; intermediate tables are in the shared folder.
    """
    words = cut(words.where("word <> ''").select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    near = near_pairs(words, round_bytes, part_bytes)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    told = words.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    follows = F.col("near_n") >= ratio * F.col("n")
    told = cut(told.select("word", "n", "n_near", F.when(follows, F.col("near")).alias("form"), F.when(follows, F.col("near_n")).alias("form_n")), "forms")
    ends = roots(told.where("form is not null"))
    return told.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(vocabulary(table(spark, sf_dir, "documents"), every=97))
