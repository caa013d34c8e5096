"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton of character strings finds every vocabulary entry in a
piece. The encoder takes the longest token at a place, checks that it may stand after the previous one (the pair must
be what merging by rank leaves), and backtracks to the next shorter token if not. A place that was given up is never
tried again, so the work is linear in the piece. Pair checks are memoised.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Bounds of the memos in a worker; they are emptied when full and never change results.
PIECES, PAIRS = 700_000, 500_000


class Bpe:
    """Encoder and decoder for ranks {token bytes: id}; every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.tokens = {i: t for t, i in ranks.items()}
        self.text = {i: t.decode("latin-1") for t, i in ranks.items()}
        self.ids = {t: i for i, t in self.text.items()}
        self.length = {i: len(t) for i, t in self.text.items()}
        self.find = regex.compile(pattern).findall
        self.trie = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.trie.add_word(t, i)
        self.trie.make_automaton()
        # the longest shorter token that a token begins with, -1 for none
        self.shorter = {i: next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), -1) for t, i in self.ids.items()}
        # how a token splits: the last merge that forms it, or none for single bytes
        self.split: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for i in sorted(self.text):
            t = self.text[i]
            if len(t) > 1 and (found := self._halves(t, i)):
                self.split[i] = found
                self.merge[found] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, str, bytes]] = {}

    def _halves(self, t: str, rank: int) -> tuple[int, int] | None:
        """The two tokens that the merges below this rank leave of t, by plain merging."""
        parts = list(t)
        while len(parts) > 2:
            best = min(((self.ids[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if self.ids.get(a + b, rank) < rank), default=None)
            if best is None:
                return None
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return self.ids[parts[0]], self.ids[parts[1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging left's and right's bytes by rank leaves just these two tokens."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self._fits(left, right)
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def _fits(self, left: int, right: int) -> bool:
        # Undo merges from the highest rank downwards on either side of the border. A merge across the border that
        # comes before the one last undone would have been done instead; of equal ranks the one further left is first.
        limit = 1 << 62
        merge, split = self.merge, self.split
        while True:
            across = merge.get((left, right))
            if across is not None and across < limit:
                return False
            first, second = split.get(left), split.get(right)
            if first is None and second is None:
                return True
            if second is None or (first is not None and left > right):
                limit, left = left, first[1]
            else:
                limit, right = right + 1, second[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        s = piece.decode("latin-1")
        whole = self.ids.get(s)
        if whole is not None and (whole in self.split or len(s) == 1):
            return [whole]
        n, length, shorter, fits = len(s), self.length, self.shorter, self.fits
        longest = [-1] * (n + 1)
        for end, i in self.trie.iter(s):  # ends ascend, so the last one to start at a place is the longest there
            longest[end - length[i] + 1] = i
        out: list[int] = []
        dead = bytearray(n + 1)
        place, token = 0, longest[0]
        while place < n:
            while token >= 0 and (dead[place + length[token]] or (out and not fits(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                place += length[token]
                token = longest[place]
            else:
                dead[place] = 1
                token = out.pop()
                place -= length[token]
                token = shorter[token]
        return out

    def piece(self, text: str) -> tuple[int, str, bytes]:
        """Of a pattern match: number of ids, ids joined by commas, the bytes that decoding them gives; memoised if short."""
        found = self.pieces.get(text)
        if found is None:
            ids = self.encode_piece(text.encode("utf-8", "surrogatepass"))
            found = (len(ids), ",".join(map(str, ids)), self.decode(ids))
            if len(text) <= 64:
                if len(self.pieces) >= PIECES:
                    self.pieces.clear()
                self.pieces[text] = found
        return found

    def encode(self, text: str) -> list[int]:
        return [i for p in self.find(text) for i in self.encode_piece(p.encode("utf-8", "surrogatepass"))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Bpe:
    """The encoder for a tiktoken rank file; built once in each Python worker."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return Bpe(ranks, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each whole text and decode the ids again.

    Gives key, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids (array of int). The rank file must be installed
    on every executor, as a library's file is. Null texts count as empty: no tokens, the digests of nothing. Row order,
    repeated rows and further columns do not matter; each row is encoded by itself, so long texts need memory for
    themselves only.
    """
    if path is None or pattern is None:
        own = default_vocabulary()
        path, pattern = path or own[0], pattern or own[1]
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], **({"ids": []} if with_ids else {})}
            for value in batch.column(1).to_pylist():
                known, own = bpe.pieces.get, bpe.piece
                found = [known(p) or own(p) for p in bpe.find(value or "")]
                out["n_tokens"].append(sum([x[0] for x in found]))
                out["ids_sha256"].append(hashlib.sha256((ids := ",".join([x[1] for x in found])).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(b"".join([x[2] for x in found])).hexdigest())
                if with_ids:
                    out["ids"].append(np.array(ids.split(",") if ids else [], np.int32))
            arrays = [batch.column(0), pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids_sha256"], pa.string()), pa.array(out["decoded_sha256"], pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array(out["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
