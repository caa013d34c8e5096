"""The language model against a plain twin, its probabilities, and its independence of partitions."""

import collections
import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from freshet.llm import lm_score as L

END = b" "


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


def corpus(n=150):
    r = random.Random(4)
    words = [f"{r.choice('abcdeé')}{r.choice(('ing', 'er', 'on', 'le'))}{i % 7}" for i in range(90)]
    texts = [" ".join(r.choice(words[: 10 + r.randrange(80)]) for _ in range(r.randrange(60))) + (f" only{i}" if i % 3 else "") for i in range(n)]
    return [*enumerate(texts), (n, None), (n + 1, ""), (3, texts[3]), (None, "no key"), (n + 2, texts[5])]


class Twin:
    """Counts in dictionaries, one token after another; shares weights and states with the model, nothing else."""

    def __init__(self, rows, mixer, spelling):
        self.mixer, self.spelling = mixer, spelling
        train = [tokens(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
        self.n = collections.Counter(w for t in train for w in t)
        self.rank = {w: i + 1 for i, w in enumerate(sorted(self.n, key=lambda w: (-self.n[w], w)))}
        self.total, self.singles = sum(self.n.values()), sum(c == 1 for c in self.n.values())
        mass = collections.Counter()
        for w, c in self.n.items():
            mass[self.rank[w].bit_length() - 1] += c
        self.code = L.huffman([float(mass[o]) for o in range(max(mass) + 1)])
        self.all, self.after = collections.Counter(), collections.Counter()
        self.followers = collections.defaultdict(collections.Counter)
        for t in train:
            for before, w in zip(["<", *t], t):
                self.followers[before if before == "<" or before in self.rank else None][w] += 1
        for w, c in self.n.items():
            path = self.path(w)
            for j in range(len(path) + 1):
                self.all[path[:j]] += c
        for c, found in self.followers.items():
            for w, k in found.items():
                path = self.path(w)
                for j in range(len(path) + 1):
                    self.after[c, path[:j]] += k
        self.bytes = [collections.Counter() for _ in range(3)]
        for w in self.n:
            if w != END:
                for context, node in self.steps(w):
                    for k in range(3):
                        self.bytes[k][context[2 - k :], node] += 1

    @staticmethod
    def steps(word):
        for i, byte in enumerate(word + b" "):
            for j in range(9):
                yield tuple([None, None, *word][i : i + 2]), f"{byte:08b}"[:j]

    def path(self, word):
        r = self.rank[word]
        return self.code[r.bit_length() - 1] + f"{r:b}"[1:]

    def decision(self, kind, first, one, two):
        x = np.float32(math.log((first[0] + 0.4) / (first[1] + 0.4)))
        state = [L.state_of(np.array([a]), np.array([b])) for a, b in (one, two)]
        return float(self.mixer.log10(np.array([kind], np.int32), np.array([x]), *state)[0])

    def log10(self, before, word):
        c = before if before == "<" or before in self.rank else None
        found = self.followers[c]
        known, once = (sum(k for w, k in found.items() if (self.n[w] == 1) == single) for single in (False, True))
        first = (self.total - self.singles, self.singles)
        out = self.decision(L.FLAG, first if word in self.rank else first[::-1], (known, once) if word in self.rank else (once, known), (0, 0))
        if word not in self.rank:
            return out
        path, octave = self.path(word), len(self.code[self.rank[word].bit_length() - 1])
        for j in range(len(path)):
            here, there = path[:j], path[: j + 1]
            pairs = [(t[(*k, there) if k else there], t[(*k, here) if k else here] - t[(*k, there) if k else there]) for t, k in ((self.all, ()), (self.after, (c,)))]
            out += self.decision(L.OCTAVE if j < octave else L.RANK, *pairs, (0, 0))
        return out

    def spelled(self, word):
        own, out = self.mixer, 0.0
        self.mixer = self.spelling
        steps = list(self.steps(word))
        for i in range(0, len(steps), 9):
            for j in range(8):
                context, here, there = steps[i][0], steps[i + j][1], steps[i + j + 1][1]
                pairs = [(t[context[2 - k :], there], t[context[2 - k :], here] - t[context[2 - k :], there]) for k, t in enumerate(self.bytes)]
                out += self.decision(L.BYTE, *pairs)
        self.mixer = own
        return out


@pytest.fixture(scope="module")
def learned(spark):
    rows = corpus()
    counted = L.count_corpus(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    mixer = L.learn_weights(counted)
    return rows, counted, mixer, Twin(rows, mixer, counted.spelling)


def test_scores_are_the_twins(learned):
    rows, counted, mixer, twin = learned
    got = collections.defaultdict(list)
    for r in L.score_corpus(counted, mixer).collect():
        got[r.doc_id].append(r)
    unknown = 0
    for i, text in rows:
        t = tokens(text)
        unknown += sum(w not in twin.rank for w in t)
        want = sum(twin.log10(a, w) + (0 if w in twin.rank else twin.spelled(w)) for a, w in zip(["<", *t], t))
        assert any(abs(r.score - want) <= 1e-6 * max(1, abs(want)) for r in got[i]), (i, want, got[i])
    assert unknown > 5 and sum(map(len, got.values())) == len(rows)


def test_words_after_a_context_share_one(learned):
    """All known words and the unknown ones together have the probability 1, after frequent, rare and unknown words."""
    _, _, _, twin = learned
    for before in ("<", END, b"never-seen", *list(twin.rank)[:5], *list(twin.rank)[-5:]):
        mass = sum(10 ** twin.log10(before, w) for w in twin.rank) + 10 ** twin.log10(before, b"never-seen")
        assert mass == pytest.approx(1, abs=2e-3) and mass <= 1 + 1e-6


def test_spellings_share_one(learned):
    """The closings and continuations of a word share its probability: over all first bytes and a next one they give at most 1."""
    _, counted, _, _ = learned
    every = [bytes([a]) for a in range(256) if a not in (9, 10, 11, 12, 13, 32)]
    words = [b"", *every, *[a + b for a in every for b in every]]
    assert 0 < (10 ** counted.bytes_.log10(words, counted.spelling)).sum() <= 1 + 1e-6


def test_outcomes_share_one():
    r = np.random.default_rng(1)
    n = 4000
    mixer = L.Mixer()
    mixer.weights = r.normal(0.5, 0.3, mixer.weights.shape).astype(np.float32)
    mixer.own = r.integers(0, 1000, len(mixer.own)).astype(float)
    kind, x = r.integers(0, L.KINDS, n).astype(np.int32), r.normal(0, 2, n).astype(np.float32)
    one, two = r.integers(0, L.STATES, (2, n))
    both = 10 ** mixer.log10(kind, x, one, two) + 10 ** mixer.log10(kind, -x, L.MIRROR[one], L.MIRROR[two])
    assert np.allclose(both, 1, atol=1e-6)


def test_partitions_do_not_matter(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in corpus()], "doc_id long, text string, token string, block int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for parts in (4, 13):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            found.append(sorted(map(str, L.score_texts(docs.repartition(parts)).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_words_of_a_group_come_back_whole(monkeypatch):
    """Whatever number of words is packed at once, each group gets the rank or the spelled cost of each of its words."""
    r = random.Random(8)
    mixer, bytes_ = L.Mixer(), L.Bytes(np.arange(0), np.arange(0))
    words = [(f"w{k}é".encode(), k + 1 + 70_000 * (k > 200) if k < 300 else 0) for k in range(400)]
    members = {g << 24: [k for k in range(400) if g in (0, 4) or k % (g + 1) == 0] for g in range(6)}
    places, want = collections.defaultdict(list), {}
    for g, own in members.items():
        r.shuffle(own)
        for i, k in enumerate(own):
            places[k].append({"block": g, "id": i})
            want[g, i] = (words[k][1], 0.0 if words[k][1] else float(bytes_.log10([words[k][0]], mixer)[0]))
    columns = [pa.array(c, t) for c, t in zip([*zip(*words), [places[k] for k in range(400)]], (pa.binary(), pa.int64(), pa.list_(pa.struct([("block", pa.int64()), ("id", pa.int32())]))))]
    table = pa.table(columns, ["token", "rank", "places"])
    for at_once in (1, 300, 1 << 20):
        monkeypatch.setattr(L, "PLACES", at_once)
        found = collections.defaultdict(list)
        for batch in L.deal_words(iter(table.to_batches(37)), bytes_, mixer):
            for row in batch.to_pylist():
                found[row["block"]].append(row)
        for g, parts in found.items():
            r.shuffle(parts)
            rank, cost = L.words_of([x["packed"] for x in parts], [x["costs"] for x in parts])
            assert [*zip(rank.tolist(), cost.tolist())] == [want[g, i] for i in range(len(members[g]))]
        assert found.keys() == members.keys()
    assert sum(map(len, found.values())) == len(members)


def test_groups_do_not_get_a_row_a_word(spark):
    """A group's words are gathered in one row of the JVM: packed, a few parts from each task, not an object for each word."""
    counted = L.count_corpus(spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3))
    groups = counted.coded.selectExpr("block", "size(vocabulary) AS parts", "flatten(transform(docs, x -> x.n_tokens)) AS n").collect()
    assert len(groups) == 3
    for g in groups:
        assert sum(g.n) > 500 and g.parts <= 8


def test_memory_of_a_block():
    """At most that many bytes a token, from the numbers of a block to its packed pairs."""
    r = np.random.default_rng(2)
    n, kinds = 400_000, 100_000
    words = L.Words(np.array([9, 4, 1]), np.array([kinds // 10, kinds // 2, kinds - kinds // 10 - kinds // 2]))
    rank = r.permutation(kinds + 500)
    rank = np.where(rank > kinds, 0, rank)
    ids = (r.random(n) ** 3 * len(rank)).astype(np.int32)
    packed = zstandard.ZstdCompressor().compress(np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T).tobytes())
    half = r.integers(-1, 2, 1000).astype(np.int32)
    docs = pa.StructArray.from_arrays([pa.array(np.arange(1000)), pa.array(half), pa.array(np.full(1000, 9)), pa.array(np.full(1000, n // 1000))], ["doc_id", "half", "n_bytes", "n_tokens"])
    count = words.count_of(rank)
    del ids
    tracemalloc.start()
    try:
        block = L.Block(docs, packed, rank, count, np.zeros(len(rank)), words)
        pairs, counts, single = L.Pairs(block, words, 20), block.counts(), block.word_n == 1
        different = len(block.word)
        del block
        sent = sum(map(len, pairs.sent(5, 0, counts, single)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sent == 20 and different > n // 2 and peak < 120 * n


def packed_blocks(words, n, blocks):
    r = np.random.default_rng(3)
    kinds, out = words.different, []
    for _ in range(blocks):
        pair = np.unique((r.random(n) ** 2 * kinds).astype(np.int64) * (kinds + 1) + (r.random(n) ** 2 * (kinds + 1)).astype(np.int64))
        context, rank = np.divmod(pair, kinds + 1)
        octave = words.octave(rank)
        part = np.where(context % 50 == 1, 2, 0) * (rank > 0)
        counts = [r.integers(0, 4, len(pair)) for _ in range(2)]
        columns = [L._steps(context * 64 + np.where(part == 2, octave + 1, 0), np.array([0])), rank, *counts, part + 4 * (words.count_of(rank) == 1)]
        widths, planes = L._planes(columns)
        out.append(widths + zstandard.ZstdCompressor().compress(planes.tobytes()))
    return out


def test_slices_of_a_bucket_do_not_matter(monkeypatch):
    words = L.Words(np.array([9, 4, 1]), np.array([60, 200, 400]))
    packed, mixer, found = packed_blocks(words, 4000, 3), L.Mixer(), []
    for at_once in (1 << 30, 3000, 7):
        monkeypatch.setattr(L, "SLICE", at_once, raising=False)
        total = L.tally(iter(L.Bucket(packed, words, 1).cells()))
        found.append(([x.tolist() for x in L.Bucket(packed, words).scores(mixer)], total.to_pydict()))
    assert found[0] == found[1] == found[2] and len(found[0][0]) == 3 and len(found[0][1]["n"]) > 100


def test_memory_of_a_bucket():
    """At most that many bytes a pair, from the packed pairs of a bucket to their scores."""
    words = L.Words(np.array([9, 4, 1]), np.array([10_000, 50_000, 40_000]))
    packed, mixer = packed_blocks(words, 300_000, 4), L.Mixer()
    mixer._tables()
    tracemalloc.start()
    try:
        pairs = sum(map(len, L.Bucket(packed, words).scores(mixer)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert pairs > 1_000_000 and peak < 150 * pairs, peak / pairs
