"""Spelling variants against all pairs by brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from freshet.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def counted(rows, every=97):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 3}


def edits(word, letters):
    gone = {word[:i] + word[i + 1 :] for i in range(len(word))}
    other = {word[:i] + a + word[i + 1 :] for i in range(len(word)) for a in letters}
    more = {word[:i] + a + word[i:] for i in range(len(word) + 1) for a in letters}
    return (gone | other | more) - {word}


def brute(counts, ratio=2):
    letters = {c for w in counts for c in w}
    near = {w: [v for v in edits(w, letters) if v in counts] for w in counts}
    best = {w: min(v, key=lambda u: (-counts[u], u)) for w, v in near.items() if v}
    form = {w: (best[w] if w in best and counts[best[w]] >= ratio * n else None) for w, n in counts.items()}
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None)
    return out


def as_told(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_whole_query_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = spelling.op12_spelling(spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(counted(docs))
    assert as_told(got) == want and any(v[0] for v in want.values())


@pytest.mark.parametrize(("round_bytes", "part_bytes"), [(1 << 26, 1 << 23), (256, 64), (64, 64)])
def test_rounds_and_parts_give_the_same(spark, round_bytes, part_bytes):
    rng = random.Random(5)
    counts = {"".join(rng.choice("abÿ") for _ in range(rng.randint(1, 7))): rng.choice([1, 2, 4, 8, 16]) for _ in range(400)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert as_told(spelling.spelling_forms(words, round_bytes=round_bytes, part_bytes=part_bytes)) == brute(counts)


def test_filters_only_add_false_positives(spark):
    """With one block a length every probe passes that hits its bits; the exact join takes the rest away."""
    plan, rounds = spelling.rounds_of({5: 1000, 6: 10}, round_bytes=1 << 20, part_bytes=1024)
    assert plan[5][0] == 3 and sum(n == 5 for r in rounds for n, _ in r) == 3 and len(rounds) == 1
    plan, rounds = spelling.rounds_of({5: 1000, 6: 10}, round_bytes=1024, part_bytes=1024)
    assert len(rounds) == 4 and all(sum(plan[n][1] * 8 for n, _ in r) <= 1024 for r in rounds)


def test_chains_ties_and_hubs(spark):
    counts = {"abcde": 3, "abcdf": 3, "abcdee": 8, "abcdeee": 16, "abcdeeee": 40, "zzzzz": 5, "xbcde": 8}
    hub = {f"hubwor{chr(97 + i)}": 3 for i in range(26)} | {"hubword": 1000}
    words = spark.createDataFrame(list((counts | hub).items()), "word string, n long")
    got = as_told(spelling.spelling_forms(words))
    assert got == brute(counts | hub)
    assert got["abcde"][:2] == ("abcdee", "abcdeeee")  # a tie with xbcde
    assert got["hubword"][3] == 25 and got["zzzzz"] == (None, "zzzzz", 5, 0, None)


def test_edge_cases(spark):
    schema = "doc_id long, text string, word string, n int"
    assert spelling.spelling_forms(spelling.vocabulary(spark.createDataFrame([], schema))).collect() == []
    long = "Wörter " * 200_000 + "a" * 30_000
    rows = [(1, None), (None, "Hällo hällo HäLLO"), (2, ""), (3, long), (3, long), (4, "ÄÄÄÄÄ ääääa ×÷×÷× ×÷×÷× ×÷×÷×")]
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in rows], schema)
    got = {r.word: r.n for r in spelling.vocabulary(docs, every=97).collect()}
    assert got == counted(rows) and "×÷×÷×" in got
    told = as_told(spelling.spelling_forms(spark.createDataFrame([("", 3), (None, 4), ("x" * 3000, 4), ("x" * 2999, 9)], "word string, n long")))
    assert told["x" * 3000] == ("x" * 2999, "x" * 2999, 4, 1, 9) and len(told) == 2
