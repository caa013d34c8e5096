"""Each operator on a small table with nulls, empty and long texts, ties, repeats and clashing columns, and on none."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from freshet.llm import bpe, components, exact_dedup, html_text, lm_score, mixing, near_dedup, quality, quotes, topk, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, hash string, label long, n int, fp long, kept boolean, row int, k int, h long"
WORDS = "the of and river basin flow gauge water year storm rain snow melt soil slope stream reach stage flood peak".split()


def rows(extra=()):
    r = random.Random(5)
    text = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))
    base, long = text(120), text(6000)
    near = base.split()
    near[50] = "changed"
    half = " ".join(near[:60] + text(60).split())
    texts = [base, base, base.replace(" ", "\n", 7), " ".join(near), half, "", None, "   \n", "one two three", "one two three", "!!!", long, long + " end", "é漢字 ñ", "A " * 300, *[text(80) for _ in range(12)], *extra]
    out = [(i, t, "en", ["a", "b", None, "ä"][i % 4], None, 1, 0.0, "x", 1, 1, 1, True, 1, 1, 1) for i, t in enumerate(texts)]
    return [*out, out[0], (None, "no key", None, None, None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_dedup_is_brute_force(spark, docs):
    own = [(d[0], d[1] or "") for d in rows() if d[0] is not None]
    groups = collections.defaultdict(list)
    for i, t in own:
        groups[norm(t)].append((-len(t), i))
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    for i, t in own:
        g = groups[norm(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(g)[1], len(g), min(g)[1] == i)
        assert got[i].text_sha256 == hashlib.sha256(norm(t).encode()).hexdigest()
    assert got[None].kept and exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    pieces = exact_dedup.exact_dedup(docs, huge=100)  # most texts hashed in pieces
    assert sorted(map(str, pieces.collect())) == sorted(map(str, exact_dedup.exact_dedup(docs).collect()))


def test_fingerprints_compose():
    r = np.random.default_rng(1)
    for n in (0, 1, 4095, 4096, 4097, 20000):
        data = r.integers(0, 256, n).astype(np.uint8)
        whole = int(exact_dedup.fingerprints(data, np.array([0, n]))[0])
        a = n // 3
        part = lambda x: (len(x), *divmod(int(exact_dedup.fingerprints(x, np.array([0, len(x)]))[0]), 1 << 31))  # noqa: E731, B023
        _, one, two = exact_dedup.combine(part(data[:a]), part(data[a:]))
        assert whole == one << 31 | two
        assert one == sum((int(b) + 1) * pow(exact_dedup.BASES[0], i, exact_dedup.PRIMES[0]) for i, b in enumerate(data)) % exact_dedup.PRIMES[0]


def test_equal_fingerprints_are_compared(spark):
    data = [(1, 7, 3, b"abc"), (2, 7, 3, b"abd"), (3, 7, 3, b"abc"), (4, 7, 3, b"abd"), (5, 8, 3, b"abc")]
    out = exact_dedup.compare_runs(spark.createDataFrame(data, "doc_id long, fp long, norm_len long, norm binary").coalesce(1), "doc_id")
    assert {r.doc_id: r.same for r in out.collect()} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5}


def brute_classes(own, similarity=0.8):
    memo = near_dedup._Hash()
    seq = {i: near_dedup.shingles([near_dedup.word_hashes(t, memo)], 5)[0] for i, t in own}
    parent = {i: i for i in seq}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(seq)
    for a in ids:
        order = np.argsort(seq[a], kind="stable")
        for b in ids:
            if a < b and near_dedup.aligned(seq[a][order], order, seq[b], similarity) >= similarity:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates_are_brute_force(docs):
    own = {d[0]: d[1] for d in rows() if d[0] is not None}
    want = brute_classes(own.items())
    got = {r.doc_id: r for r in near_dedup.near_duplicate_classes(docs).collect()}
    assert {i: r.class_id for i, r in got.items()} == want
    assert want[3] == 0 and want[4] == 4 and want[12] == 11 and want[5] == want[6] != want[10]
    assert near_dedup.near_duplicate_classes(docs.limit(0)).count() == 0


def test_near_duplicates_of_a_family(spark):
    """Copies of one text with edits of different places: many hubs do not reach all, components must be brute force's."""
    r = random.Random(2)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    texts = []
    for _ in range(120):
        t = list(base)
        for _ in range(r.randrange(6)):
            t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.class_id for x in near_dedup.near_duplicate_classes(df).collect()} == brute_classes(enumerate(texts))


def test_near_duplicate_recall(spark):
    """Of all pairs of sf0.01 that alignment finds alike, nine in ten at least are in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    memo, seq, held = near_dedup._Hash(), {}, {}
    for d in docs.collect():
        seq[d.doc_id] = near_dedup.shingles([near_dedup.word_hashes(d.text, memo)], 5)[0]
        for h in set(seq[d.doc_id].tolist()):
            held.setdefault(h, []).append(d.doc_id)
    shared = {}
    for ids in held.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    pairs = []
    for (a, b), n in shared.items():
        if n * 1.8 >= 0.8 * (len(seq[a]) + len(seq[b])):
            order = np.argsort(seq[a], kind="stable")
            if near_dedup.aligned(seq[a][order], order, seq[b], 0.8) >= 0.8:
                pairs.append((a, b))
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(docs).collect()}
    assert len(pairs) > 50 and sum(found[a] == found[b] for a, b in pairs) >= 0.9 * len(pairs)


def test_alignment_minds_order():
    a = np.arange(100, dtype=np.uint64)
    order = np.argsort(a, kind="stable")
    assert near_dedup.aligned(a, order, a, 0.8) == 1
    assert near_dedup.aligned(a, order, np.roll(a, 50), 0.8) == 0
    b = np.delete(a, [3, 50, 70])
    assert near_dedup.aligned(a, order, b, 0.8) == pytest.approx(0.97)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60) if i % 20] + [(100, 61), (61, 100)]
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(1, 21)}) == 1 and got[1] != got[21] and got[100] == got[61]


def test_bpe_is_the_libraries(docs):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.default_vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    own = bpe.load(path, pattern)
    r = random.Random(3)
    for text in ["", "a" * 4000, "ab" * 2000, "  \n\n x", "it's we'LL", *["".join(r.choice("abcé漢 \n\t😀'12.-") for _ in range(200)) for _ in range(150)]]:
        ids = lib.encode_ordinary(text)
        assert own.encode(text) == ids and own.decode(ids) == text.encode()
    want = {d[0]: d[1] or "" for d in rows()}
    for row in bpe.encode_documents(docs, with_ids=True).collect():
        ids = lib.encode_ordinary(want[row.doc_id])
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(want[row.doc_id].encode()).hexdigest()


def test_mixing(spark, docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = mixing.taken_words(docs, block=16).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(d[0]), size(d[1])) for d in rows())
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    total = sum(r.size for r in got)
    by = collections.defaultdict(lambda: [0, 0.0])
    source = {d[0]: d[3] for d in rows()}
    for r in got:
        by[source[r.doc_id]][0] += r.taken
        by[source[r.doc_id]][1] = r.target
    assert sum(t for _, t in by.values()) == pytest.approx(total)
    assert all(abs(n - t) <= 0.5 for n, t in by.values())
    again = mixing.taken_words(docs.repartition(7), block=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mixed_documents(docs, block=16)
    assert mixed.columns == docs.columns
    words = collections.Counter()
    for r in mixed.collect():
        words[r.doc_id] += size(r.text)
    taken = collections.Counter()
    for r in got:
        taken[r.doc_id] += r.taken
    assert +words == +taken
    assert mixing.taken_words(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_targets_fill_up(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1), (None, 50)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # weights 1 2 3 1: c stops at 3, b at 30; the rest, 128, is shared evenly
    assert got == {"a": 64.0, "b": 30.0, "c": 3.0, None: 64.0}


def test_permutation():
    for n in (1, 2, 3, 5, 17, 100, 1000):
        assert sorted(mixing._feistel(np.arange(n), n, mixing._keys("x", n))) == list(range(n))


def test_topk_is_brute_force(spark):
    r = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in r.normal(0, 0.2, 8)]) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(40)]
    bad = [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (1004, []), (None, [1.0] * 8)]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<float>")
    ints = topk.integer_vectors(df)
    table = {i: [math.floor(1024 * x) for x in np.float32(v).astype(float)] for i, v in [*vectors, (1004, [])]}
    got = collections.defaultdict(list)
    for row in topk.top_k(ints, ints.where("vec_id % 10 = 0"), shard_rows=64).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.vec_id, row.score))
    for q in [i for i in table if i % 10 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(table[q], v)), i) for i, v in table.items() if i != q)[:10]
        assert got[q] == [(i, -s) for s, i in scores], q
    few = topk.top_k(ints.where("vec_id < 4"), ints.where("vec_id = 0")).collect()
    assert len(few) == 3 and topk.top_k(ints.limit(0), ints.limit(0)).count() == 0


def test_lm_counts(spark, docs):
    tokens = lambda t: (t or "").encode().lower().split() + [0]
    train = collections.Counter()
    for d in rows():
        if d[0] is None or zlib.crc32(str(d[0]).encode()) % 7 != 2:
            train.update(tokens(d[1]))
    total, kinds = sum(train.values()), len(train)
    want = {d[0]: d[1] for d in rows()}
    got = lm_score.score_texts(docs).collect()
    assert len(got) == len(rows())
    for r in got:
        t = tokens(want[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(train[w] > 0 for w in t), total)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 1) / (total + kinds + 1)) for w in t))
        assert math.isfinite(r.score) and r.score < 0
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    assert lm_score.score_texts(docs.limit(0)).count() == 0


def test_quality(spark):
    r = random.Random(6)
    good = lambda: " ".join(r.choice(WORDS) for _ in range(60)) + "."
    bad = lambda: " ".join(r.choice(WORDS).upper() + "!!" for _ in range(60))
    data = [(i, good() if i % 3 else bad()) for i in range(300)] + [(300, None), (301, ""), (302, "x" * 50_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1.5 AS score", "7 AS quality", "true AS predicted", "1 AS n")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(5, None, 0), (None, 1, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.quality_scores(docs, labels, bound=128).collect()}
    assert len(got) == 303 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got.values())
    assert got[300].score == got[301].score
    held = [x for i, x in got.items() if i < 300 and x.held_out]
    assert len(held) > 30 and all(x.predicted == int(x.doc_id % 3 > 0) for x in held)
    kept = quality.quality_scores(docs, labels, bound=128, keep_columns=True)
    assert kept.columns == docs.columns and kept.count() == sum(x.predicted for x in got.values())
    assert quality.quality_scores(docs, labels.limit(0)).where("score = 0.5").count() == 303
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_quotes(spark):
    data = [(1, 0, "u", "Hello there friend.\nHow are you?"), (1, 1, "a", "> Hello there friend.\n> How are you?\nFine thanks."), (1, 2, "u", "unrelated"), (1, 3, "a", "Bob wrote:\n> > How are  you?\n> fine THANKS.\n>> zzz\nok\n\n"), (1, 4, "b", "> unrelated\nyes"), (1, 4, "b", "> unrelated\nyes"), (None, None, None, None), (2, 0, "u", "")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.position): r for r in quotes.rebuild_conversations(df).collect()}
    assert [(got[1, i].turn, got[1, i].text, got[1, i].reply_to, got[1, i].thread) for i in range(1, 7)] == [(0, "Hello there friend.\nHow are you?", None, 0), (1, "Fine thanks.", 0, 0), (3, "ok", 1, 0), (2, "unrelated", None, 2), (4, "yes", 2, 2), (4, "yes", 2, 2)]
    assert [q.source for q in got[1, 3].quotes] == [0, 1, None] and got[None, 1].text == ""
    assert quotes.rebuild_conversations(df.limit(0)).count() == 0


def test_urls(spark):
    data = [(1, "https://WWW.cheap-pills.Example.com/en/1?x", "<title>cheap the river</title>"), (2, "http://example.org/en/12", None), (3, "http://a.org/x", ""), (4, None, None), (5, "nothing", "x"), (6, "ftp://riverbasin.example.net/flow#t", "<title>river basin river basin</title>"), (6, "ftp://riverbasin.example.net/flow#t", "<title>river basin river basin</title>"), (7, "http://b.com/de/", ""), (8, "http://notorg/", ""), (9, "x://h?y", ""), (10, "http://" + "ab" * 3000 + "/" + "c" * 20_000, "<title>" + "q" * 5000 + "</title>"), (11, "http://x" + "q" * 5000 + "/", "")]
    df = spark.createDataFrame([(*x, "t", "r", 1) for x in data], "page_id long, url string, html string, tokens string, host string, block int")
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.cheap-pills.example.com", "/en/1", None, "block")
    assert (got[2].rule, got[2].verdict, got[3].rule, got[3].verdict) == ("example.org/en/1", "block", "org/", "allow")
    assert (got[4].host, got[5].path, got[8].rule, got[9].host, got[9].path) == ("", "", None, "h", "")
    assert got[6].tokens[:2] == ["river", "basin"] and got[6].verdict == "allow" and got[7].verdict == "block"
    assert got[11].tokens == ["x", "q" * 5000] and len("".join(got[10].tokens)) == 6000
    assert url_filter.filter_urls(df).count() == 12 and url_filter.filter_urls(df.limit(0)).count() == 0


def test_urls_are_brute_force_bayes(spark):
    """A host without a seed word is blocked for what a rule says of its pages; scores are those of a plain naive Bayes."""
    urls = [f"http://lucky-casino.example.com/{'en' if i % 6 == 0 else 'de'}/{i}" for i in range(80)] + [f"http://river{i % 5}.example.net/en/{i}" for i in range(60)] + [f"http://a.org/{i}" for i in range(20)]
    df = spark.createDataFrame([(i, u, "<title>lucky river</title>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.filter_urls(df, seeds={"none": ["pills"]}).collect()}
    assert all(r.verdict == "block" for i, r in got.items() if "casino" in urls[i]) and all(r.verdict == "allow" for i, r in got.items() if "casino" not in urls[i])

    def path_tokens(path):
        return [f"p:#{len(x)}.{x[0]}" if x[0].isdigit() else f"p:{x}" for x in re.findall(r"[^\W\d_]+|\d+", path.lower())]

    counts, pages = [collections.Counter(), collections.Counter()], [0, 0]
    for r in got.values():
        ruled = {"com/de/": 1, "org/": 0}.get(r.rule)
        prefix = {"com/de/": "/de/", "org/": "/"}.get(r.rule, "")
        counts[ruled or 0].update(["h:" + t for t in r.tokens] + path_tokens(r.path[len(prefix) :]))
        pages[ruled or 0] += 1
    seen = len(set(counts[0]) | set(counts[1])) + 1
    total = [sum(c.values()) + seen for c in counts]
    for r in got.values():
        own = ["h:" + t for t in r.tokens] + path_tokens(r.path)
        odds = math.log((pages[1] + 1) / (pages[0] + 1)) + sum(math.log((counts[1][t] + 1) / total[1]) - math.log((counts[0][t] + 1) / total[0]) for t in own)
        assert r.score == pytest.approx(odds, abs=1e-5)


def test_viterbi_is_brute_force():
    r = random.Random(1)
    for _ in range(40):
        word = "".join(r.choice("abc") for _ in range(7))
        cost = {word[i:j]: r.random() * 9 for i in range(7) for j in range(i + 1, 8) if r.random() < 0.5}
        price = lambda parts: sum(cost.get(p, 5.0 * (1 + len(p))) for p in parts)  # noqa: E731, B023
        every = [[word[a:b] for a, b in zip((0, *c), (*c, 7))] for n in range(7) for c in __import__("itertools").combinations(range(1, 7), n)]
        assert price(url_filter.viterbi(word, cost, 5.0)) == pytest.approx(min(map(price, every)))


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><div class='x{0}'>Follow us everywhere</div><article><h1>A &amp; {0}</h1><p>one\n two<br>three<div class=ad>buy</div><p>shared</p><form>f</form><section id=comments>c</section></article><footer>f</body>"
    bare = "<div><span>Top of the site</span></div><div><p>body {0}</p></div>"
    data = [(i, "http://h.com/p", page.format(i)) for i in range(12)] + [(20 + i, "http://g.com/p", bare.format(i)) for i in range(12)] + [(50, None, None), (51, "u", ""), (52, "http://h.com", "cut <p>text &lt;b&gt; <fo"), (0, "http://h.com/p", page.format(0))]
    df = spark.createDataFrame([(*x, "", 1, 2, [3]) for x in data], "page_id long, url string, html string, text string, row int, host int, lines array<int>")
    got = {r.page_id: r for r in html_text.extract_text(df).collect()}
    assert got[3].text == "A & 3\none two three\nshared" and got[3].n_chars == len(got[3].text)
    assert got[25].text == "body 5" and got[50].text == "" and got[51].text == "" and got[52].text == "cut\ntext <b>"
    assert html_text.extract_text(df).count() == len(data) and html_text.extract_text(df.limit(0)).count() == 0
