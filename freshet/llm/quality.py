"""Quality classifier: similarity-weighted voting of the nearest labelled documents in a latent-semantic space.

Each text becomes hashed counts of words and of word shapes (case, digits, punctuation). A truncated SVD of a bounded
sample of labelled texts gives the latent space; the sample's vectors are broadcast, every document's exact cosine with
all of them is a blocked matrix product, and the nearest ones vote with a power of their similarity as weight.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

WORDS, SHAPES = 4096, 1024
#: Bound of the memo of words in a worker; it is emptied when full.
MEMO = 400_000

_PUNCT = re.compile(r"(.)\1+", re.S)


def _shape(token: str) -> str:
    kinds = "".join("X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c for c in token)
    return _PUNCT.sub(r"\1", kinds)


class _Memo(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        word = zlib.crc32(token.lower().strip(".,;:!?\"'()").encode("utf-8", "replace")) % WORDS
        code = self[token] = (1 + zlib.crc32(_shape(token).encode("utf-8", "replace")) % (SHAPES - 1)) * WORDS + word
        return code


def counts(text: str, memo: dict) -> np.ndarray:
    """Counts of hashed words, then of hashed shapes; the first shape counts words that repeat the one before."""
    codes = np.fromiter(map(memo.__getitem__, text.split()), np.int64)
    out = np.zeros(WORDS + SHAPES, np.float32)
    out[:WORDS] = np.bincount(codes % WORDS, minlength=WORDS)
    out[WORDS:] = np.bincount(codes // WORDS, minlength=SHAPES)
    out[WORDS] = np.count_nonzero(codes[1:] == codes[:-1])
    return out


@dataclass
class Model:
    """idf: weight of each feature; axes: features to latent; vectors: unit rows with their labels (0 or 1)."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    power: float

    def weigh(self, block: np.ndarray) -> np.ndarray:
        """In place, a few rows at a time: the sample's rows are the largest thing that the driver holds."""
        for at in range(0, len(block), 256):
            x = block[at : at + 256]
            np.log1p(x, out=x)
            x *= self.idf
            for part in (x[:, :WORDS], x[:, WORDS:]):
                part /= np.maximum(np.sqrt(np.einsum("ij,ij->i", part, part))[:, None], 1e-9)
        return block

    def latent(self, block: np.ndarray) -> np.ndarray:
        return self.unit(self.weigh(block))

    def unit(self, weighed: np.ndarray) -> np.ndarray:
        z = weighed @ self.axes
        return z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-9)

    def score(self, block: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest vectors, and all as near as the last of them, by cosine to the given power; without
        any, the share among all."""
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(block), prior)
        cosine = self.latent(block) @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        close = np.take_along_axis(cosine, near, 1)
        weight = np.maximum(close, 0).astype(np.float64) ** self.power
        total, share = weight.sum(1), (weight * self.labels[near]).sum(1)
        last = close.min(1)
        for row in np.flatnonzero((cosine >= last[:, None]).sum(1) > k):  # all that are as near as the last one vote
            weight = np.where(cosine[row] >= last[row], np.maximum(cosine[row], 0), 0).astype(np.float64) ** self.power
            total[row], share[row] = weight.sum(), (weight * self.labels).sum()
        return np.where(total > 1e-12, share / np.maximum(total, 1e-12), prior)


def fit(features: np.ndarray, labels: np.ndarray, dimensions: int = 64, neighbours: int = 24, power: float = 8.0, seed: int = 7) -> Model:
    """A latent space and labelled vectors from count rows, by randomised SVD."""
    n = len(features)
    if not n:
        return Model(np.ones(WORDS + SHAPES, np.float32), np.zeros((WORDS + SHAPES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), neighbours, power)
    idf = np.log((n + 1) / (np.count_nonzero(features, axis=0) + 1)).astype(np.float32) + 1
    model = Model(idf, np.zeros((0, 0)), np.zeros((0, 0)), labels.astype(np.float64), neighbours, power)
    x = model.weigh(features)
    y = x @ np.random.default_rng(seed).standard_normal((x.shape[1], dimensions + 16)).astype(np.float32)
    for _ in range(3):
        y = x @ (x.T @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    model.axes = np.ascontiguousarray(np.linalg.svd(q.T @ x, full_matrices=False)[2][:dimensions].T)
    model.vectors = model.unit(x)
    return model


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Count rows and labels of at most `bound` labelled documents outside the held-out fold, picked by hash.

    A document with several labels takes the smallest; labels that are null or lack a document are left out. Of several
    texts with one doc_id, that with the smallest hash counts.
    """
    picked = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo()
        for batch in batches:
            rows = [counts(t or "", memo) for t in batch.column(2).to_pylist()]
            at = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array([r[i] for r, i in zip(rows, at)], pa.list_(pa.float32())), pa.array([zlib.crc32((t or "").encode("utf-8", "replace")) for t in batch.column(2).to_pylist()], pa.int64())], ["doc_id", "quality", "at", "n", "h"])

    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text")
    rows = texts.mapInArrow(run, "doc_id long, quality int, at array<int>, n array<float>, h long")
    found = rows.groupBy("doc_id").agg(F.min_by(F.struct("quality", "at", "n"), F.struct("h", "at", "n")).alias("x")).select("doc_id", "x.*").toArrow().sort_by("doc_id")
    features = np.zeros((len(found), WORDS + SHAPES), np.float32)
    for row, (at, n) in enumerate(zip(found["at"], found["n"])):
        features[row, at.values.to_numpy()] = n.values.to_numpy()
    return features, found["quality"].to_numpy().astype(np.float64)


def quality_scores(docs: DataFrame, labels: DataFrame, bound: int = 4096, threshold: float = 0.3, keep_columns: bool = False) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    The model is fitted on a sample of at most `bound` labelled documents (a parameter; 4096 vectors of 64 floats are
    about 1 MB to broadcast); only text enters a score. Null and empty texts share one score, that of no words. With
    no labels every score is 0.5. Repeated rows get equal scores, an empty table gives no rows. keep_columns: only the
    rows with predicted = 1, with the columns of docs, for use as a filter.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(*labelled_sample(docs, labels, bound)))
    small_batches(spark)
    columns = docs.columns if keep_columns else ["doc_id"]
    docs = docs.select(*columns, *([] if keep_columns else ["text"]))
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, own = _Memo(), model.value
        for batch in batches:
            texts = batch.column(where).to_pylist()
            score = np.concatenate([own.score(np.stack([counts(t or "", memo) for t in texts[i : i + 128]])) for i in range(0, len(texts), 128)]) if texts else np.zeros(0)
            score = np.round(np.clip(score, 0, 1), 9)
            if keep_columns:
                yield batch.filter(pa.array(score >= threshold))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    if keep_columns:
        return docs.mapInArrow(run, docs.schema)
    scored = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
