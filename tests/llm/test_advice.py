"""Places where a review found that an operator did less than the whole job."""

import collections
import math
import random
import re
import time

import numpy as np

import corpus_pipeline
from freshet.llm import html_text, mixing, near_dedup, quality, quotes


def test_pipeline_keeps_rows_without_or_with_shared_doc_ids(spark, tmp_path):
    """Copies go, and nothing else: not for want of a doc_id, nor because another text has the same one."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    near = text(3).replace("w3x40", "changed")
    data = [(3, text(3)), (7, text(3)), (7, text(7)), (None, text(8)), (None, text(9)), (None, text(9)), (9, near), (7, text(10)), (None, text(7) + " end"), (11, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    exact = corpus_pipeline.drop_exact(spark, docs, str(tmp_path))
    want = [(3, text(3)), (7, text(10)), (7, text(7)), (9, near), (11, None), (None, text(7) + " end"), (None, text(8)), (None, text(9))]
    assert [tuple(r) for r in sorted(exact.collect(), key=key)] == want
    left = corpus_pipeline.drop_near(spark, exact, str(tmp_path))
    assert [tuple(r) for r in sorted(left.collect(), key=key)] == [w for w in want if w not in (want[3], want[5])]


def test_html_templates_of_a_large_host(spark):
    """A block on a small share of a large host's pages is its template; content of an article is kept."""
    promo = "<div>Spring offers for all our readers</div>"
    page = "<body>{1}<article><p>same words</p><p>own {0}</p>{1}</article></body>"
    df = spark.createDataFrame([(i, "http://h.com/p", page.format(i, promo if i % 33 == 0 else "")) for i in range(1000)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    assert all(got[i] == f"same words\nown {i}" for i in range(1000))


def test_html_joined_templates_do_not_mind_page_ids(spark):
    """Pages without a page_id, or with that of a page of another host, lose their own host's templates and no others."""
    page = "<div><span>Top of {1}</span></div><div><p>body {0}</p></div>"
    data = [(None if i % 2 else i, f"http://{h}.com/p", page.format(i, "a" if i == 7 else h)) for h in "ab" for i in range(12)] + [(None, None, None)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    want = sorted(str((k, u, "" if h is None else "Top of a\nbody 7" if "b.com" in u and "body 7<" in h else "body " + h.split("body ")[1].split("<")[0])) for k, u, h in data)
    for bound in (200_000, 0):  # templates broadcast, and joined
        assert sorted(str((r.page_id, r.url, r.text)) for r in html_text.extract_text(df, broadcast_rows=bound).collect()) == want


def test_html_templates_alone(spark):
    """Without any rule, what recurs on a host goes: menus, adverts and footers by their form, whatever they say."""
    r = random.Random(3)
    word = lambda: f"w{r.randrange(10**6)}"
    page = "<body><nav><ul><li><a>{0}</a></li><li><a>{1}</a></li></ul></nav><div class=offer>{2}</div><header><b>{6}</b></header><article><h1>{3}</h1><p>{4}</p></article><footer>{5}</footer></body>"
    given = [[word() for _ in range(7)] for _ in range(30)]
    df = spark.createDataFrame([(i, "http://h.com/p", page.format(*g)) for i, g in enumerate(given)], "page_id long, url string, html string")
    got = {x.page_id: x for x in html_text.extract_text(df, rules=False).collect()}
    assert all(got[i].text == f"{g[3]}\n{g[4]}" and got[i].n_template == sum(map(len, (g[0], g[1], g[2], g[5], g[6]))) for i, g in enumerate(given))


def test_html_template_counts_are_brute_force(spark):
    pages = [(i, f"http://h{i % 3}.com", "<body>" + "".join(f"<div class=c{k}>{'t' if k % 2 else i}</div>" for k in range(6) if i % (k + 2) == 0) + f"<article><p>{i % 20}</p></article></body>") for i in range(200)]
    parsed = html_text.parse_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), "page_id")
    seen, total = collections.defaultdict(set), collections.defaultdict(set)
    for _, url, source in pages:
        page = html_text.Page(source)
        (whole, form), may = page.hashes(), page.candidates()
        total[html_text._host(url)].add(whole[0])
        for n in range(len(may)):
            if may[n]:
                seen[html_text._host(url), whole[n]].add(whole[0])
                if not page.inside[n]:
                    seen[html_text._host(url), form[n]].add(whole[0])
    least = lambda host: 8 * (1 + math.log(max(1, len(total[host]) * 0.05 / 8)))
    want = {k for k, v in seen.items() if len(v) >= 8 and len(v) >= least(k[0])}
    assert {tuple(x) for x in html_text.template_table(parsed).collect()} == want and want


def test_hostile_pages_take_linear_time():
    for page in ('<a "' * 250_000, '<a "' * 250_000 + "'>x", "<div>" * 8000 + "</b>" * 8000, "<div>t" * 20_000, "<b>" * 20_000 + "<li></li>" * 20_000, '<a ">" ' * 60_000 + "'", "<" * 200_000):
        began = time.process_time()
        tree = html_text.Page(page)
        tree.hashes(), tree.lines(), tree.candidates()
        assert time.process_time() - began < 5


def test_mixing_slots_are_replayed(spark, monkeypatch):
    """Each shard's draws, and each slot's pass, block and words, against a plain replay of the same draws."""
    monkeypatch.setattr(mixing, "SHARD", 16)
    sources = [("a", 1000, 2500), ("b", 130, 390), (None, 7, 3), ("z", 64, 64), ("none", 50, 0)]
    df = spark.createDataFrame(sources, "source string, source_size long, take_words long")
    block, seed = 8, 5
    got = collections.defaultdict(list)
    # the tasks do not see the patched number, so the draws are replayed here
    plan = []
    for name, size, take in sorted((s for s in sources if s[2]), key=lambda s: (s[0] is None, s[0] or "")):
        a_pass = -(-size // block)
        plan.append((name, size, take, size // block, a_pass, take // size * a_pass + -(-(take % size) // block)))
    slots = np.array([p[5] for p in plan])
    shards = -(-int(slots.sum()) // 16)
    drawn = {n: (f, c) for n, f, c in mixing.draw_shards(slots, range(shards), shards, seed)}
    assert sorted(drawn) == list(range(shards)) and all(int(drawn[n][1].sum()) == 16 for n in range(shards - 1))
    assert (sum(c for _, c in drawn.values()) == slots).all()
    for n in range(shards):  # one shard alone is drawn as among all, and sources go on where earlier shards ended
        (_, first, count), = mixing.draw_shards(slots, range(n, n + 1), shards, seed)
        assert (count == drawn[n][1]).all() and (first == sum(drawn[k][1] for k in range(n))).all()
    monkeypatch.undo()
    for row in mixing.draw_slots(df, block, seed).collect():
        got[row.source].append((row.slot, row["pass"], row.block, row.take))
    for name, size, take, full, a_pass, n in plan:
        want, left = [], take
        for slot in range(n):
            turn, place = divmod(slot, a_pass)
            number = int(mixing._feistel(np.array([place]), full, mixing._keys(seed, name, turn))[0]) if place < full else full
            words = min(left, block if place < full else size - full * block)
            want.append((slot, turn, number, words))
            left -= words
        assert sorted(got[name]) == want and left == 0


def test_quality_votes_are_brute_force():
    """Exact cosines and votes, where several neighbours are as near as the last one too."""
    r = np.random.default_rng(2)
    features = r.poisson(0.3, (60, quality.WORDS + quality.SHAPES)).astype(np.float32)
    features[40:] = features[7]  # ties
    labels = (r.random(60) < 0.5).astype(float)
    model = quality.fit(features.copy(), labels, dimensions=16, neighbours=5)
    asked = np.concatenate([features[7:8], r.poisson(0.3, (9, features.shape[1]))]).astype(np.float32)
    vectors = model.latent(asked.copy())
    got = model.score(asked.copy())
    for q, score in zip(vectors, got):
        cosine = np.array([float(np.float32(x)) for x in (q[None] @ model.vectors.T)[0]])
        last = sorted(cosine, reverse=True)[4]
        weight = np.where(cosine >= last - 1e-6, np.maximum(cosine, 0), 0) ** 8
        assert abs((weight * labels).sum() / weight.sum() - score) < 1e-3
    assert quality._shape("a" * 100 + "1") != quality._shape("a" * 100 + "!")


def test_near_duplicates_with_shared_doc_ids(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    data = [(1, text(1)), (1, text(2)), (2, text(1) + " end"), (3, text(2) + " end"), (4, text(4))]
    got = [tuple(r) for r in near_dedup.near_duplicate_classes(spark.createDataFrame(data, "doc_id long, text string")).collect()]
    assert sorted(got) == [(1, 1, 4, True), (1, 1, 4, True), (2, 1, 4, False), (3, 1, 4, False), (4, 4, 1, True)]


def brute_quotes(messages):
    """turn: sources of the passages, by the latest earlier message that has the passage, else most of its lines or sentences."""
    flat = lambda t: " ".join(t.lower().split())
    cut = lambda t: [x for x in re.split(r"(?<=[.!?])\s+", t) if x]
    own, out = {}, {}
    for turn, text in messages:
        lines = text.split("\n")
        passages, last = [], 0
        for line in lines:
            marks = re.match(r"^(?:[ \t]*>)+[ \t]?", line)
            level = marks[0].count(">") if marks else 0
            if level:
                if level != last:
                    passages.append((level, []))
                passages[-1][1].append(re.sub(r"^(?:[ \t]*>)+[ \t]?", "", line))
            last = level
        found = []
        for level, parts in passages:
            whole = flat(" ".join(parts))
            if not whole:
                continue
            keys = [x for x in map(flat, parts) if x]
            keys += sorted(set(cut(whole)) - set(keys))
            best = None
            latest = lambda k: max((t for t in own if t < turn and k in own[t]), default=None)  # noqa: B023, E731
            if (source := latest(whole)) is not None:
                best = source
            else:
                votes = collections.Counter(x for x in map(latest, keys) if x is not None)
                if votes:
                    best = max(votes, key=lambda t: (votes[t], t))
            found.append((level, best))
        kept = [x for x in lines if not re.match(r"^[ \t]*>", x)]
        mine = flat(" ".join(kept))
        own[turn] = {mine, *map(flat, kept), *cut(mine)} - {""}
        out[turn] = found
    return out


def test_quotes_of_generated_mail_are_brute_force(spark):
    """Nested, reordered, re-wrapped and partial quotes, and lines that everybody repeats, in conversations of many turns."""
    r = random.Random(8)
    data, want = [], {}
    for conv, turns in ((1, 60), (2, 60), (3, 5000)):
        messages, texts = [], {}
        for turn in range(turns):
            lines = [f"{r.choice(('Yes.', 'Thanks!', 'No.'))} s{r.randrange(10**6)} is so. t{r.randrange(10**6)} too." for _ in range(r.randrange(1, 4))]
            quoted = []
            for _ in range(r.randrange(3) if turn and (conv < 3 or turn % 50 == 0) else 0):
                source = r.choice(texts[r.randrange(turn)])
                kind = r.randrange(4)
                part = source if kind < 2 else source.split(". ")[0] + "." if kind == 2 else f"lost{r.randrange(10**6)}"
                words = part.split()
                at = r.randrange(1, len(words)) if kind == 1 and len(words) > 1 else len(words)
                depth = "> " * r.randrange(1, 3)
                quoted += [depth + " ".join(w) for w in (words[:at], words[at:]) if w] + ["me"]
            texts[turn] = lines
            messages.append((turn, "\n".join([*quoted, *lines])))
        want |= {(conv, t): x for t, x in brute_quotes(messages).items()}
        data += [(conv, t, "u", x, 1, 2, "z") for t, x in messages]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, position int, bucket int, lines string")
    got = quotes.rebuild_conversations(df).collect()
    assert len(got) == len(data)
    for x in got:
        assert [(q.level, q.source) for q in x.quotes] == want[x.conv_id, x.turn], x
    by = {(x.conv_id, x.turn): x.position for x in got}
    assert all(by[x.conv_id, x.reply_to] < x.position for x in got if x.reply_to is not None)
