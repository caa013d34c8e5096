"""Quality rules by brute force, and the n-gram model against a twin of dictionaries."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.llm import perplexity as P

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string"


def rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    twice = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(twice) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice), failed


def normal(text):
    text = re.sub(r"[\x20\x09-\x0D]+", " ", (text or "").lower())
    text = re.sub("[0-9]", "0", text).removeprefix(" ")
    return " " * (P.ORDER - 1) + text + "\n"


class Twin:
    """Interpolated modified Kneser-Ney by dictionaries; n-grams under a `kept`th of their order's total are dropped."""

    def __init__(self, docs, kept):
        grams = {}
        for voice, text in docs:
            t = normal(text)
            grams.setdefault(voice, Counter()).update(t[i : i + P.ORDER] for i in range(len(t) - P.ORDER + 1))
        self.share, self.rest = {}, {}
        for k in range(P.ORDER, 0, -1):
            if k < P.ORDER:
                grams = {v: Counter(g[1:] for g in c) for v, c in grams.items()}
            least = max(P.LEAST_COUNT, math.ceil(sum(sum(c.values()) for c in grams.values()) / kept))
            for v, c in grams.items():
                off = [0.0, *P.discounts([sum(n == i for n in c.values()) for i in (1, 2, 3, 4)])]
                total = Counter()
                for g, n in c.items():
                    total[g[:-1]] += n
                for g, n in c.items():
                    if n >= least:
                        x = (n - off[min(n, 3)]) / total[g[:-1]] * (1 - P.LEAST_REST)
                        self.share[v, g] = x
                        self.rest[v, k, g[:-1]] = self.rest.get((v, k, g[:-1]), 1.0) - x

    def probability(self, voice, gram):
        p = 1 / P.POINTS
        for k in range(1, P.ORDER + 1):
            p = self.share.get((voice, gram[P.ORDER - k :]), 0.0) + self.rest.get((voice, k, gram[P.ORDER - k : -1]), 1.0) * p
        return p

    def perplexity(self, voice, text):
        t = normal(text)
        return 10 ** (-sum(math.log10(self.probability(voice, t[i : i + P.ORDER])) for i in range(len(t) - P.ORDER + 1)) / (len(t) - P.ORDER + 1))


@pytest.mark.parametrize("kept", [P.KEPT, 2000])
def test_query_is_brute_force(spark, kept):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in P.quality_rules(spark.read.parquet(f"{SF}/documents.parquet"), kept=kept).collect()}
    assert len(got) == len(docs)
    twin = Twin([(d.lang, d.text) for d in docs], kept)
    for d in docs:
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == rules(d.text)
        assert r.perplexity == pytest.approx(twin.perplexity(d.lang, d.text), rel=1e-4)
        assert r.kept == (not r.base_failed and r.least <= r.perplexity <= r.most)


def test_probabilities_sum_to_one(spark):
    docs = [(0, "abra cadabra abracadabra"), (0, "bracket abba"), (1, "zzz yyy")] * 4
    counts = P.cut(P.count_grams(spark.createDataFrame(docs, "voice int, text string")), "grams")
    model = P.fit(counts)
    letters = sorted({ord(c) for _, t in docs for c in t} | {10})
    for voice, context in ((0, "ra"), (0, "ca"), (0, "  "), (1, "zz"), (0, "qq"), (1, "br")):
        gram = np.array([[*map(ord, context), c] for c in letters], np.uint32)
        p = model.probability(np.full(len(letters), voice), gram)
        unseen = model.probability(np.array([voice]), np.array([[*map(ord, context), 0x4E00]], np.uint32))[0]
        assert (p > 0).all() and p.sum() + unseen * (P.POINTS - len(letters)) == pytest.approx(1, abs=1e-5)


def test_kept_share_of_clean_and_of_noise(spark):
    """Letters in random order leave the band on either side; clean texts stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").collect()
    rng = np.random.default_rng(1)
    wild = [(-i - 1, " ".join("".join(rng.choice(list("qxzkvjwpbgfyåøæßðþñéèêçàüöäïîôûœ@^~"), 6)) for _ in range(120)), "en") for i in range(3)]
    flat = [(-i - 9, " ".join("the that with " + chr(97 + i) * (j % 7 + 1) for j in range(60)), "en") for i in range(3)]
    got = {r.doc_id: r for r in P.quality_rules(spark.createDataFrame([(d.doc_id, d.text, d.lang) for d in docs] + wild + flat, SCHEMA)).collect()}
    assert all(got[i].perplexity > got[i].most and not got[i].kept for i, _, _ in wild)
    assert all(got[i].perplexity < got[i].least and not got[i].kept for i, _, _ in flat)
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    fine = [got[d.doc_id] for d in docs if d.doc_id in clean and not got[d.doc_id].base_failed]
    assert len(fine) > 20 and sum(r.kept for r in fine) >= 0.97 * len(fine)


def test_copies_do_not_move_the_bands(spark):
    docs = [(d.doc_id, d.text, d.lang) for d in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").collect()]
    text = next(t for _, t, _ in docs if not rules(t)[5] and len(t) > 500)
    got = P.quality_rules(spark.createDataFrame(docs + [(10_000 + i, text, "en") for i in range(60)], SCHEMA)).where("NOT base_failed")
    lost = [r.doc_id for r in got.where("NOT kept").collect()]
    assert len(lost) <= 0.1 * len(docs) and not any(i >= 10_000 for i in lost)


def test_edge_cases_and_partitions(spark):
    assert P.quality_rules(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "Ein Wort und noch eins, 12 mal.\n" * 60_000
    rows = [(1, None, None), (None, "a b c d e f g h i j k", "xx"), (2, "", "en"), (2, "", "en"), (3, long, "de"), (4, "x" * 50_000, "de"), (5, "\x0b \r\n\t", None), (6, "é😀ﬁ İ 漢字 " * 9, "zz"), (7, "\n\nq\n\nq\n q\n", "en")]
    rows = [(k, t, v, 1, "y") for k, t, v in rows]
    docs = spark.createDataFrame(rows, SCHEMA + ", n_words int, kept string")
    got = P.quality_rules(docs.repartition(3)).collect()
    assert len(got) == len(rows)
    want = sorted((str(k), *rules(t)) for k, t, *_ in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    again = P.quality_rules(docs.repartition(1)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_tables_and_sorting_give_the_same(monkeypatch):
    texts = ["abc  déf\n", "", "Zz 9", "q" * 40]
    voices = np.array([0, 1, 0, 2])
    wide, starts = P.spread_out(texts)
    assert "".join(map(chr, wide)) == "".join(normal(t) for t in texts) and list(np.diff(starts)) == [len(normal(t)) for t in texts]
    want = [[(v, tuple(map(ord, normal(t)[i : i + P.ORDER]))) for i in range(len(normal(t)) - P.ORDER + 1)] for t, v in zip(texts, voices)]
    for dense in (P.DENSE, 0):
        monkeypatch.setattr(P, "DENSE", dense)
        key, offsets, counts, voice, gram = P.distinct(wide, starts, voices)
        grams = dict(zip(np.flatnonzero(counts).tolist(), zip(voice.tolist(), map(tuple, gram.tolist()))))
        assert [[grams[k] for k in key[a:b].tolist()] for a, b in zip(offsets, offsets[1:])] == want
        assert Counter(g for w in want for g in w) == {g: counts[k] for k, g in grams.items()}


def test_no_gram_is_left_out_for_its_share(spark):
    """Some texts beside eight million points of others: rare n-grams keep their probability."""
    docs = [(d.doc_id, d.text, "en") for d in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").limit(40).collect()]
    long = spark.range(4).select((-1 - F.col("id")).alias("doc_id"), F.repeat(F.lit("so it goes "), 190_000).alias("text"), F.lit("en").alias("lang"))
    got = {r.doc_id: r for r in P.quality_rules(spark.createDataFrame(docs, SCHEMA).unionByName(long)).collect()}
    twin = Twin([("en", t) for _, t, _ in docs] + [("en", "so it goes " * 190_000)] * 4, 1 << 40)
    for i, t, _ in docs:
        assert got[i].perplexity == pytest.approx(twin.perplexity("en", t), rel=1e-4)


@pytest.mark.parametrize("sent", [1, 30, 3000])
def test_joined_grams_score_as_sent_ones(spark, sent):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    rows = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted(map(str, P.quality_rules(rows, sent=sent).collect())) == sorted(map(str, P.quality_rules(rows).collect()))
