"""Mixing sources to target weights over fixed-length blocks.

Each source's words, its documents one after another, are cut into blocks of a fixed number of words. A target number of
words is set for each source. Output shards have a fixed number of slots, and each draws its counts of the sources from a
multinomial; as the sources' slots are used up in the end, the draws go down a tree of halves of the shards, each half
from what is left for it, so any shard can be drawn on its own. The slots so drawn are mapped through a pseudorandom
permutation of the source's block numbers, a new one for each pass. Blocks and slots meet in a join by source and block
number. All of it moves numbers only; texts are read where they are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, cut, table

#: Words of a block.
BLOCK = 128
#: Slots of an output shard; the last one has what is left.
SHARD = 4096
#: Documents of a bucket, about: the unit in which running totals are formed.
BUCKET = 1024
MOST = 3


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, pattern: tuple[int, ...] = (1, 2, 3), most: float = MOST) -> DataFrame:
    """(source, source_size) to source, source_size, target. One row a source.

    Sources in code-point order, null last, weigh as the repeating pattern says. Targets share the total by weight
    and stop at `most` times the source's size; the excess is shared again by weight until none is above. Sources are
    capped in the order of size to weight: with the first k capped, the rest get (total - caps) / (their weights) each.
    """
    by_name, none = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    weights = F.array(*map(F.lit, pattern))
    cap = F.col("source_size") * F.lit(most)
    ranked = sizes.withColumn("weight", F.element_at(weights, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(pattern))) + 1).cast("int")).cast("double"))
    by_ratio = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(none) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    level = rest / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    leveled = ranked.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= cap)
    # the level is that of the first source that its share does not fill; all after it have the same
    first = F.min(F.when(F.col("free"), F.struct(cap / F.col("weight"), F.col("level"))))
    level = first.over(none).getField("level")
    return leveled.select("source", "source_size", F.least(cap, F.coalesce(level * F.col("weight"), cap)).cast("double").alias("target"))


def _feistel(x: np.ndarray, size: int, keys: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(size): four Feistel rounds on the next even power of two, walked into range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for key in keys:
            f = (right ^ key) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return left << np.uint64(half) | right

    out = once(x.astype(np.uint64))
    while (far := np.flatnonzero(out >= size)).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


def _keys(*what: object) -> np.ndarray:
    import hashlib

    digest = hashlib.sha256("\0".join(map(repr, what)).encode()).digest()
    return np.frombuffer(digest, np.uint64)


def draw(left: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Multinomial counts of `size` slots over sources with `left` slots each, none above what is left."""
    out = np.zeros_like(left)
    while (open_ := size - int(out.sum())) > 0:
        rest = left - out
        out = np.minimum(out + rng.multinomial(open_, rest / rest.sum()), left)
    return out


def draw_shards(slots: np.ndarray, shards: range, of: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each of `shards` among `of`: its number, the first slot of each source that falls to it, and its counts.

    The shards are halved again and again; each halving draws what falls to the first half, by a generator of its own.
    """
    total = int(slots.sum())
    walk = [(0, of, np.zeros_like(slots), slots)]
    while walk:
        low, high, first, left = walk.pop()
        if low >= shards.stop or high <= shards.start:
            continue
        if high - low == 1:
            yield low, first, left
            continue
        middle = (low + high) // 2
        mine = draw(left, min(middle * SHARD, total) - low * SHARD, np.random.default_rng(_keys(seed, low, high)))
        walk += [(middle, high, first + mine, left - mine), (low, middle, first, mine)]


def draw_slots(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """Slots of the mix: source, shard, slot, pass, block, take (words).

    sources: source, source_size, take_words. A source of n words has n // block full blocks and a rest; a pass takes
    its full blocks in permuted order, then the rest. The last pass ends when take_words are reached, inside a block if
    need be. Shards are drawn and unrolled in as many tasks as there are eight shards; a row a source is sent to each.
    """
    spark = sources.sparkSession
    full, rest = F.floor(F.col("source_size") / block), F.col("source_size") % block
    passes, left = F.floor(F.col("take_words") / F.col("source_size")), F.col("take_words") % F.col("source_size")
    a_pass = full + F.when(rest > 0, 1).otherwise(0)
    plan = sources.where("take_words > 0").withColumn("blocks", full).withColumn("per_pass", a_pass).withColumn("slots", passes * a_pass + F.ceil(left / block))
    rows = plan.select("source", "source_size", "take_words", "blocks", "per_pass", "slots").orderBy(F.col("source").asc_nulls_last()).collect()
    names = [r["source"] for r in rows]
    size, words, blocks, per_pass, slots = (np.array([r[c] for r in rows], np.int64) for c in ("source_size", "take_words", "blocks", "per_pass", "slots"))
    shards = -(-int(slots.sum()) // SHARD)

    def unroll(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            for shard, first, count in draw_shards(slots, range(int(frame["id"].min()), int(frame["id"].max()) + 1), shards, seed):
                out = []
                for i in np.flatnonzero(count):
                    slot = np.arange(first[i], first[i] + count[i])
                    turn, place = slot // per_pass[i], slot % per_pass[i]
                    number = np.full(len(slot), blocks[i])
                    for t in np.unique(turn):
                        own = (turn == t) & (place < blocks[i])
                        if own.any():
                            number[own] = _feistel(place[own], int(blocks[i]), _keys(seed, names[i], int(t)))
                    length = np.where(place < blocks[i], block, size[i] - blocks[i] * block)
                    take = np.minimum(length, words[i] - turn * size[i] - place * block)
                    out.append(pd.DataFrame({"source": names[i], "shard": shard, "slot": slot, "pass": turn, "block": number, "take": take}).astype({"source": object}))
                yield pd.concat(out)

    tasks = min(max(1, shards // 8), 10_000)
    return spark.range(0, shards, 1, tasks).mapInPandas(unroll, "source string, shard long, slot long, pass long, block long, take long")


def mix_sources(docs: DataFrame, pattern: tuple[int, ...] = (1, 2, 3), most: float = MOST, block: int = BLOCK, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The mix of all documents: spans, and one row a document.

    spans: doc_id, source, shard, slot, pass, start, n - n words of the document from word `start` on, as a slot takes
    them; ordered by shard and slot they are the packed mix. documents: doc_id, size, source_size, target, row.
    A word is a run without ASCII white space; null and empty texts have none and are never drawn. A null source is a
    source like any other, the last. Each source's mix has the whole number of words next to its target, and no word
    is taken more than `most` times. Rows are kept apart by a row number, so repeated rows and doc_ids count as they
    stand. An empty table gives empty results; other columns are ignored. Running totals are formed by buckets of
    documents, so a large source is spread like a small one. Draws depend on the seed and the rows, not on partitions.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", words_in(F.col("text")).alias("size"))
    # equal (doc_id, source, size) rows are alike for every purpose here, so they stand as one row with a count
    sized = cut(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("times")), "sizes")
    rows = sized.count()
    buckets = max(1, rows // BUCKET)
    by_source = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"))
    targets = cut(source_targets(by_source, pattern, most).withColumn("take_words", F.least(F.round("target"), F.floor(F.col("source_size") * most)).cast("long")), "targets")

    order = ["h", "doc_id", "size"]
    placed = sized.withColumn("h", F.xxhash64("doc_id", "size")).withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)).cast("int"))
    sums = placed.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("times")).alias("words"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("words").over(running), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("times")).over(inside), F.lit(0)))
    same = placed["source"].eqNullSafe(offsets["source"]) & (placed["bucket"] == offsets["bucket"])
    placed = placed.join(offsets, same).select("doc_id", placed["source"], "size", "times", (F.col("offset") + F.col("before")).alias("at"))
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("times").cast("int") - 1))).withColumn("at", F.col("at") + F.col("copy") * F.col("size")).where("size > 0")

    # blocks that a document touches, and the stretch of each that is its own
    touched = copies.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    low = F.greatest(F.col("at"), F.col("block") * block)
    touched = touched.select("doc_id", "source", "copy", "size", "block", (low - F.col("at")).alias("start"), (low - F.col("block") * block).alias("inside"), (F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - low).alias("length"))
    # hints: Spark takes what Python functions give for as small as what they read, and would broadcast it
    slots = draw_slots(targets.select("source", "source_size", "take_words"), block, seed)
    mark = lambda d: d.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    met = mark(touched).join(mark(slots).drop("source").hint("merge"), ["source_key", "block"]).withColumn("n", F.least("length", F.col("take") - F.col("inside"))).where("n > 0")
    spans = met.select("doc_id", "source", "size", "copy", "shard", "slot", "pass", "start", "n")
    named = targets.select(F.col("source").alias("s"), "source_size", "target")
    documents = sized.join(F.broadcast(named) if targets.count() <= 10_000 else named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return spans, documents


def taken_words(docs: DataFrame, **options: object) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words of each document that the mix takes, repeats counted.

    Rows that repeat a doc_id, source and size share what the mix takes of them: copies differ by one word at most.
    """
    spans, documents = mix_sources(docs, **options)
    keys = ["doc_id", "source", "size"]
    taken = spans.groupBy(*keys, "copy").agg(F.sum("n").alias("taken"))
    rows = documents.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("times").cast("int") - 1)))
    same = F.lit(True)
    for k in (*keys, "copy"):
        same = same & rows[k].eqNullSafe(taken[k])
    out = rows.join(taken, same, "left")
    return out.select(rows["doc_id"], rows["size"], "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The mix as documents: the columns of docs, one row for each document and pass that takes of it.

    text has the words taken in that pass: the whole text, unchanged, where all are; else its stretches in order, as
    they stand in the text, joined by a line break. n_chars, where docs has it, is the new text's.
    """
    spans, _ = mix_sources(docs, **options)
    parts = spans.groupBy("doc_id", "source", "size", "copy", "pass").agg(F.sum("n").alias("taken"), F.array_sort(F.collect_list(F.struct("start", "n"))).alias("spans"))
    # keys without nulls; rows alike are numbered, and the number is compared after the join, which then needs no other shuffle
    keys = {"k": F.coalesce("doc_id", F.lit(-(2**63))), "s": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))}
    parts = parts.select(*[c.alias(k) for k, c in keys.items()], F.col("size").alias("z"), F.col("copy").alias("number"), "taken", "spans")
    whole = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("doc")  # columns of any name
    rows = docs.select(whole, *[c.alias(k) for k, c in keys.items()], words_in(F.col("text")).alias("z")).where("z > 0")
    rows = rows.withColumn("row", F.row_number().over(Window.partitionBy("k", "s", "z").orderBy("z")) - 1)
    joined = rows.join(parts.hint("merge"), ["k", "s", "z"]).where("row - number = 0")
    # word i of the text is its i-th run without white space, kept with what follows it; touching stretches are one
    pieces = F.when(F.col("taken") < F.col("z"), F.regexp_extract_all("doc.text", F.lit(rf"{WORD}[{SPACE}]*"), F.lit(0)))
    last = lambda done: F.element_at(done, -1)
    grown = lambda done, x: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last(done)["start"].alias("start"), (last(done)["n"] + x["n"]).alias("n"))))
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:bigint,n:bigint>>"),
        lambda done, x: F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["start"] + F.try_element_at(done, F.lit(-1))["n"] == x["start"]), grown(done, x)).otherwise(F.concat(done, F.array(x))),
    )
    stretch = lambda x: F.regexp_replace(F.array_join(F.slice("pieces", (x["start"] + 1).cast("int"), x["n"].cast("int")), ""), rf"[{SPACE}]+$", "")
    text = F.when(F.size("pieces") > 0, F.array_join(F.transform("merged", stretch), "\n")).otherwise(F.col("doc.text"))
    mixed = joined.withColumn("pieces", pieces).withColumn("merged", merged).withColumn("mixed", text)
    made = {"text": F.col("mixed"), "n_chars": F.length("mixed").cast("long")}
    return mixed.select(*[made.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))
