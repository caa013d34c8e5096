"""Exact top-k search by inner product: ball trees per shard, branch and bound, kth scores shared.

Vectors are dealt into cells by the nearest of a bounded number of pivots, and large cells into shards by a hash of the
id; every shard builds a ball tree. Cells are balls too, the top of the tree: a query goes only to the cells whose bound
reaches its kth score so far. Inside a shard a block of queries descends best bound first: a node waits in a heap under
its largest inner-product bound q.c + |q|r over the queries that still need it, and is left out for each query whose kth
score exceeds its bound there. A first round only follows each query to its best cell, and there to its best leaf; the
largest kth score that any shard found is then shared with all for the full round.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, cut, table

LEAF = 128
LOW = np.iinfo(np.int64).min
#: Rows of a shard, at least and at most.
SHARD_ROWS = (4096, 131072)
#: Pivots, at most: these and the cells' radii are broadcast.
PIVOTS = 256


@dataclass
class BallTree:
    """Nodes in breadth-first order: centre, radius, rows [start, end) of the reordered points, first child or -1."""

    points: np.ndarray
    ids: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    spans: np.ndarray
    child: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> BallTree:
        order = np.arange(len(ids))
        centres, radii, spans, child = [], [], [(0, len(ids))], []
        i = 0
        while i < len(spans):
            a, b = spans[i]
            own = points[order[a:b]].astype(np.float64)
            centre = own.mean(0)
            away = ((own - centre) ** 2).sum(1)
            centres.append(centre)
            radii.append(float(np.sqrt(away.max(initial=0))))
            if b - a > leaf and radii[-1] > 0:
                far = own[away.argmax()]
                other = own[((own - far) ** 2).sum(1).argmax()]
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own @ (other - far), half)]
                child.append(len(spans))
                spans += [(a, a + half), (a + half, b)]
            else:  # equal points stay one leaf, however many
                child.append(-1)
            i += 1
        return cls(points[order], ids[order], np.array(centres), np.array(radii), np.array(spans), np.array(child))

    def bounds(self, queries: np.ndarray, norms: np.ndarray, node: int) -> np.ndarray:
        """No score in the node is above this; rounding is on the safe side."""
        reach = norms * self.radii[node]
        return (queries @ self.centres[node] + reach) + 1e-9 * (reach + norms * np.sqrt((self.centres[node] ** 2).sum())) + 1e-6

    def search(self, queries: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int, first_leaf: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best for each query, best first; rows beyond what there is have score LOW.

        own: ids that are left out. kth: scores that k candidates elsewhere reach at least; it grows as better are found.
        """
        n = len(queries)
        scores, found = np.full((n, k), LOW), np.zeros((n, k), np.int64)
        as_float = queries.astype(np.float64)
        norms = np.sqrt((as_float**2).sum(1))
        exact = float(norms.max(initial=0)) * (float(np.sqrt((self.points.astype(np.float64) ** 2).sum(1).max(initial=0)))) < 2.0**52
        root = self.bounds(as_float, norms, 0)
        heap = [(-float(root.max(initial=-np.inf)), 0, np.arange(n), root)]
        left = np.full(n, first_leaf)
        while heap:
            _, node, who, bound = heapq.heappop(heap)
            need = bound >= np.maximum(kth[who], scores[who, -1])
            who = who[need]
            if not len(who):
                continue
            if (c := self.child[node]) >= 0:
                sides = np.stack([np.minimum(self.bounds(as_float[who], norms[who], c + s), bound[need]) for s in (0, 1)])
                for s in (0, 1):
                    go = np.flatnonzero(~left[who] | ((sides[s] > sides[1 - s]) | ((sides[s] == sides[1 - s]) & (s == 0))))
                    if len(go):
                        heapq.heappush(heap, (-float(sides[s][go].max()), int(c + s), who[go], sides[s][go]))
                continue
            a, b = self.spans[node]
            for at in range(a, b, 4096):
                ids, part = self.ids[at : min(b, at + 4096)], self.points[at : min(b, at + 4096)]
                new = (as_float[who] @ part.T.astype(np.float64)).astype(np.int64) if exact else queries[who] @ part.T
                new[ids[None, :] == own[who][:, None]] = LOW
                if len(ids) > 4 * k:  # the k best of these by score, and all that tie with the last
                    least = np.partition(new, len(ids) - k, axis=1)[:, len(ids) - k]
                    some = (new >= least[:, None]).any(0)
                    ids, new = ids[some], new[:, some]
                all_scores = np.concatenate([scores[who], new], axis=1)
                all_ids = np.concatenate([found[who], np.broadcast_to(ids, new.shape)], axis=1)
                top = np.lexsort((all_ids, -np.maximum(all_scores, LOW + 1)), axis=-1)[:, :k]
                scores[who], found[who] = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_ids, top, 1)
        return scores, found


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, zeros after the end of a short one."""
    ends = column.offsets.to_numpy()
    length = np.diff(ends)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), length)
    out[row, np.arange(len(row)) - np.repeat(ends[:-1] - ends[0], length)] = column.values.to_numpy()[ends[0] : ends[-1]]
    return out


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component as double. Vectors null or with null or non-finite components go."""
    x = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda e: F.coalesce(F.abs(e) < F.lit(float("inf")), F.lit(False)))
    return vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double"))).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k best other rows by integer inner product.

    vectors, queries: vec_id, v (array of long). Ties go to the smaller vec_id; with fewer rows all are given. Vectors
    of different lengths are compared as if the shorter had zeros at its end. A row is never its own query's result,
    nor is another row with the query's id; a repeated query id is asked once, with its least vector, while repeated
    candidates are rows of their own. Empty tables give no rows. Scores are 64-bit integers and assumed to fit.

    A shard's points are held in memory (shard_rows of them), queries stream through it in batches. A query is copied to
    the shards of the cells that it has to ask, which grow fewer as cells grow smaller.
    """
    spark = vectors.sparkSession
    vectors, queries = cut(vectors, "vectors"), cut(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    rows = vectors.count()
    per_shard = shard_rows or min(max(rows // (4 * spark.sparkContext.defaultParallelism), SHARD_ROWS[0]), SHARD_ROWS[1])
    cells = min(max(1, -(-rows // per_shard)), PIVOTS)
    width = vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    chosen = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(cells).select("v").collect()
    pivots = np.zeros((max(1, len(chosen)), width), np.float64)
    for i, r in enumerate(chosen):
        pivots[i, : len(r["v"])] = r["v"]
    sent = spark.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        square = (own**2).sum(1)
        for batch in batches:
            x = _matrix(batch.column(1), own.shape[1]).astype(np.float64)
            cell = (square - 2 * (x @ own.T)).argmin(1)
            away = np.sqrt(((x - own[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], ["vec_id", "v", "cell", "away"])

    with arrow_rows(spark, 1024):
        placed = cut(vectors.mapInArrow(nearest, "vec_id long, v array<long>, cell int, away double"), "cells")
    balls = {r["cell"]: (r["away"], r["n"]) for r in placed.groupBy("cell").agg(F.max("away").alias("away"), F.count(F.lit(1)).alias("n")).collect()}
    parts = np.array([-(-balls[c][1] // per_shard) if c in balls else 0 for c in range(len(pivots))], np.int64)
    radii = np.array([balls[c][0] if c in balls else 0.0 for c in range(len(pivots))])
    first_shard, shards = np.cumsum(parts) - parts, max(1, int(parts.sum()))
    base = F.element_at(F.array(*[F.lit(int(x)) for x in first_shard]), F.col("cell") + 1)
    many = F.element_at(F.array(*[F.lit(int(max(1, x))) for x in parts]), F.col("cell") + 1)
    shard = (base + F.pmod(F.xxhash64("vec_id"), many)).cast("int")
    dealt = placed.select(shard.alias("shard"), F.lit(0).alias("kind"), "vec_id", "v", F.lit(LOW).alias("kth"))

    def ask(first: bool):
        """Rows of queries for the shards of their best cell, or of all cells that may hold a score as high as kth."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                q = _matrix(batch.column(1), max(own.shape[1], int(np.diff(batch.column(1).offsets.to_numpy()).max(initial=0))))[:, : own.shape[1]].astype(np.float64)
                norms = np.sqrt((q**2).sum(1))[:, None]
                reach = norms * radii
                bound = q @ own.T + reach + 1e-9 * (reach + norms * np.sqrt((own**2).sum(1))) + 1e-6
                bound[:, parts == 0] = -np.inf
                if first:
                    wanted = np.zeros(bound.shape, bool)
                    if len(q):
                        wanted[np.arange(len(q)), bound.argmax(1)] = True
                else:
                    wanted = bound >= batch.column(2).to_numpy()[:, None]
                i, c = np.nonzero(wanted & (parts > 0))
                row = np.repeat(i, parts[c])
                number = np.arange(len(row)) - np.repeat(np.cumsum(parts[c]) - parts[c], parts[c])
                taken = [batch.column(k).take(pa.array(row)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array((np.repeat(first_shard[c], parts[c]) + number).astype(np.int32)), pa.array(np.ones(len(row), np.int32)), *taken], ["shard", "kind", "vec_id", "v", "kth"])

        return run

    def visit(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, tree, held, width = None, None, [], 0
            for whole in batches:
                shard_of, kind_of = whole.column(0).to_numpy(), whole.column(1).to_numpy()
                edges = np.flatnonzero(np.diff(shard_of) | np.diff(kind_of)) + 1
                for a, b in zip([0, *edges], [*edges, len(shard_of)]):
                    batch = whole.slice(a, b - a)
                    if not len(batch):
                        continue
                    if shard_of[a] != now:
                        now, tree, held = shard_of[a], None, []
                    if kind_of[a] == 0:
                        held.append(batch)
                        continue
                    longest = max([0, *(int(np.diff(x.column(3).offsets.to_numpy()).max(initial=0)) for x in [*held, batch])])
                    if tree is None or longest > width:
                        if not held:
                            continue
                        width = longest
                        tree = BallTree.build(np.concatenate([_matrix(x.column(3), width) for x in held]), np.concatenate([x.column(2).to_numpy() for x in held]))
                    own, kth = batch.column(2).to_numpy(), batch.column(4).to_numpy()
                    scores, found = tree.search(_matrix(batch.column(3), width), own, kth, k, first)
                    if first:
                        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(scores[:, -1])], ["vec_id", "kth"])
                    else:
                        i, j = np.nonzero((scores > LOW) & (scores >= kth[:, None]))
                        yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(found[i, j]), pa.array(scores[i, j])], ["query_id", "vec_id", "score"])

        return run

    def asked(with_kth: DataFrame, first: bool) -> DataFrame:
        each = with_kth.select("vec_id", "v", "kth").mapInArrow(ask(first), "shard int, kind int, vec_id long, v array<long>, kth long")
        return dealt.unionByName(each).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "vec_id")

    with arrow_rows(spark, 1024):
        shared = cut(asked(queries.withColumn("kth", F.lit(LOW)), True).mapInArrow(visit(True), "vec_id long, kth long").groupBy("vec_id").agg(F.max("kth").alias("kth")), "kth")
        known = queries.join(shared, "vec_id", "left").withColumn("kth", F.coalesce("kth", F.lit(LOW)))
        hits = cut(asked(known, False).mapInArrow(visit(False), "query_id long, vec_id long, score long"), "hits")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
