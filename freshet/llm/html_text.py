"""Main text of web pages: site templates found by counting subtrees per host, then rules for what is of one page alone.

Each page is parsed once, into lines of text and the elements that they stand in, with a hash of each element's whole
subtree, and outside the article also one of its form: tags and names without the text, since menus, adverts and footers
may say something else on each page. Spark counts on how many of its different pages a host has a subtree; those that
recur on many are the site's template, and all lines in them go, whether inside the article or not. What remains is held
against tags, roles and class names that mark furniture (of rare kinds, and in articles), and against the article's
bounds. Paragraphs and headings of an article are never deleted for recurring.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, cut, hot_keys, salted_join, table

DROP_TAGS = frozenset("nav aside footer form script style noscript template iframe svg button select textarea dialog menu head object canvas".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
DROP_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent banner notice notices popup modal comment comments disqus share sharing social related newsletter subscribe login widget pagination masthead skip".split()
)
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Content as such: inside an article (or anywhere in a page without one) these are kept even if other pages have the same.
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption summary".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript iframe".split())
#: An open element of the second set ends where one of the first begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A subtree is of the template if on this many pages of its host; where that is under this share of them, the number
#: grows with the logarithm of the host's pages.
LEAST_PAGES, LEAST_SHARE = 8, 0.05

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_NAME = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[a-z0-9]+")
_GAP = re.compile(r"\s+")
_CLOSE = {t: re.compile(rf"</{t}(?=[\s>/])[^>]*>", re.I) for t in RAW}


def _end_of_tag(html: str, at: int) -> int:
    """Where the tag ends whose attributes begin at `at`; -1 if one of its quotes is never closed."""
    while at < len(html):
        at = _PLAIN.match(html, at).end()
        if at == len(html):
            break
        if html[at] == ">":
            return at
        at = html.find(html[at], at + 1) + 1
        if not at:
            break
    return -1


def markup(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kind is `text`, `open` or `close`. In one pass over the page, whatever its quotes.

    Comments and declarations are left out, raw elements come without their content. A tag that the page breaks off in is
    left out. From a tag on with a quote that is never closed, tags end at the next `>`, whatever quotes they have.
    """
    at, size, last, quotes = 0, len(html), html.rfind(">"), True
    while at < size:
        start = html.find("<", at)
        if start < 0 or start + 1 == size:
            yield "text", html[at:], ""
            return
        m = _TAG.match(html, start)
        if not m and html[start + 1] not in "!?/":
            yield "text", html[at : start + 1], ""
            at = start + 1
            continue
        if start > at:
            yield "text", html[at:start], ""
        if html.startswith("<!--", start):
            stop = html.find("-->", start + 4)
            at = size if stop < 0 else stop + 3
            continue
        if start > last:
            return
        if not m:
            at = html.index(">", start) + 1
            continue
        stop = _end_of_tag(html, m.end()) if quotes else html.index(">", m.end())
        if stop < 0:
            stop, quotes = html.index(">", m.end()), False
        name = m[2].lower()
        at = stop + 1
        yield "close" if m[1] else "open", name, html[m.end() : stop]
        if name in RAW and not m[1]:
            end = _CLOSE[name].search(html, at)
            at = end.end() if end else size
            yield "close", name, ""


class Page:
    """Lines of a page (text, element, whether a rule drops it) and its elements (parent, hash, whether it may be of a template)."""

    def __init__(self, html: str) -> None:
        self.tags, self.parents, self.dropped, self.article, self.inside = ["#"], [-1], [False], [False], [False]
        self.content: list[list] = [[]]
        self.names = [""]
        self.has = Counter()
        stack, blocks, names = [0], [], Counter()

        def close(depth: int) -> None:
            for node in stack[depth:]:
                names[self.tags[node]] -= 1
            del stack[depth:]
            while blocks and blocks[-1] >= depth:
                blocks.pop()

        for kind, name, rest in markup(html):
            if kind == "text":
                self.content[stack[-1]].append(name)
            elif kind == "close":
                if names[name]:
                    depth = len(stack) - 1
                    while self.tags[stack[depth]] != name:
                        depth -= 1
                    close(depth)
            else:
                ends = ({"p"} if name in BLOCKS else set()) | ENDS.get(name, set())
                for depth in reversed(blocks[-2:]):
                    own = self.tags[stack[depth]]
                    if own in ends:
                        close(depth)
                        break
                    if own != "p":
                        break
                node = self._open(name, rest, stack[-1])
                if name not in VOID and not rest.endswith("/"):
                    if name in BLOCKS:
                        blocks.append(len(stack))
                    stack.append(node)
                    names[name] += 1

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        node = len(self.tags)
        names, role, hidden = set(), "", False
        if attributes:
            for key, *values in _NAME.findall(attributes):
                key, value = key.lower(), "".join(values).lower()
                if key == "role":
                    role = value
                elif key == "hidden":
                    hidden = True
                else:
                    names.update(_PART.findall(value))
        inside = self.inside[parent] or tag in ("article", "main") or role == "main"
        large = tag in ("html", "body", "main", "article")
        drop = tag in DROP_TAGS or role in DROP_ROLES or hidden or (tag == "header" and not inside)
        drop = drop or bool(names & (DROP_NAMES if not large else {"comment", "comments"})) or ("header" in names and not inside and not large)
        drop = drop or self.dropped[parent]
        self.tags.append(tag)
        self.names.append(" ".join(sorted(names)) + "\2" + role)
        self.parents.append(parent)
        self.dropped.append(drop)
        self.article.append(self.article[parent] or (tag == "article" and not drop))
        self.inside.append(inside)
        self.content[parent].append(node)
        self.content.append([])
        if not drop:
            self.has["article"] += tag == "article"
            self.has["main"] += inside
        return node

    def hashes(self) -> tuple[list[int], list[int]]:
        """Of each element's subtree a hash of tags and text, with white space made equal, and one of tags and names alone."""
        whole, form = [0] * len(self.tags), [0] * len(self.tags)
        for node in range(len(self.tags) - 1, -1, -1):
            parts, names = [self.tags[node]], [self.tags[node], self.names[node]]
            for x in self.content[node]:
                if isinstance(x, int):
                    parts.append(f"\1{whole[x]:x}")
                    names.append(f"\1{form[x]:x}")
                elif text := _GAP.sub(" ", x).strip():
                    parts.append(text)
            whole[node] = xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "replace")) - 2**63
            form[node] = xxhash.xxh64_intdigest("\0".join(names).encode("utf-8", "replace"), seed=1) - 2**63
        return whole, form

    def candidates(self) -> list[bool]:
        """Which elements may be of the template: all blocks of the page but its large ones and the content of an article."""
        bounded = self.has["main"] > 0
        large = ("html", "body", "main", "article")
        return [tag in BLOCKS and tag not in large and not (tag in CONTENT and (inside or not bounded)) for tag, inside in zip(self.tags, self.inside)]

    def outside(self, node: int) -> bool:
        """Whether an element lies outside the outermost articles, else outside main, of a page that has them."""
        if self.has["article"]:
            return not self.article[node]
        return bool(self.has["main"]) and not self.inside[node]

    def lines(self) -> list[tuple[str, int]]:
        """Text of each block in page order, and the element it stands in. Elements of other kinds do not break a line; what
        rules drop stands in lines of its own."""
        found: list[tuple[str, int]] = []
        now: list[str] = []
        own = 0

        def flush() -> None:
            if now:
                if line := _GAP.sub(" ", unescape("".join(now))).strip():
                    found.append((line, own))
                now.clear()

        walk: list = [(0, 0)]
        while walk:
            x, block = walk.pop()
            if isinstance(x, str):
                if own != block:
                    flush()
                    own = block
                now.append(x)
                continue
            if x < 0:
                flush()
                continue
            tag = self.tags[x]
            apart = tag in BLOCKS or self.dropped[x] != self.dropped[block] or x == 0
            if tag == "br":
                now.append(" ")
            if apart:
                flush()
                block = x
                walk.append((-1, x))
            walk += [(y, block) for y in reversed(self.content[x])]
        return found


def _host(url: str) -> str:
    return (re.match(r".*?://([^/?#]*)", url, re.S) or ["", ""])[1].lower() if "://" in url else ""


def parse_pages(pages: DataFrame, key: str) -> DataFrame:
    """key, url, and of each page: row (its number), host, page (hash), parents, hashes and forms of the elements that may be of
    a template (parent: the next such element above, -1 if none; form: null inside an article, or in a page without one),
    lines: text, element among these (-1: none), kept (whether no rule drops the line)."""
    kind = pages.schema[key].dataType.simpleString()
    line = pa.struct([("text", pa.string()), ("at", pa.int32()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            hosts, whole, parents, hashes, forms, lines = [], [], [], [], [], []
            for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                page = Page(html or "")
                (all_hashes, all_forms), may = page.hashes(), page.candidates()
                near, up, own, form, bounded = [-1] * len(may), [], [], [], page.has["main"] > 0
                for node, parent in enumerate(page.parents):
                    above = near[parent] if parent >= 0 else -1
                    near[node] = above
                    if may[node]:
                        near[node] = len(own)
                        up.append(above)
                        own.append(all_hashes[node])
                        form.append(all_forms[node] if bounded and not page.inside[node] else None)
                hosts.append(_host(url or ""))
                whole.append(all_hashes[0])
                parents.append(up)
                hashes.append(own)
                forms.append(form)
                lines.append([{"text": t, "at": near[n], "kept": not page.dropped[n] and not page.outside(n)} for t, n in page.lines()])
            rows = pa.array(range(number, number + len(hosts)), pa.int64())
            number += len(hosts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows, pa.array(hosts, pa.string()), pa.array(whole, pa.int64()), pa.array(parents, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64())), pa.array(forms, pa.list_(pa.int64())), pa.array(lines, pa.list_(line))], [key, "url", "row", "host", "page", "parents", "hashes", "forms", "lines"])

    schema = f"`{key}` {kind}, url string, row long, host string, page long, parents array<int>, hashes array<long>, forms array<long>, lines array<struct<text: string, at: int, kept: boolean>>"
    with arrow_rows(pages.sparkSession, 64):
        return cut(pages.select(key, "url", "html").mapInArrow(run, schema), "parsed-pages")


def subtrees() -> Column:
    return F.array_compact(F.array_union("hashes", "forms")).alias("subtrees")


def template_table(parsed: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """host, subtree: hashes of the template subtrees of each host. Equal pages of a host count as one page."""
    seen = parsed.select("host", "page", subtrees()).dropDuplicates(["host", "page"])
    totals = parsed.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = seen.select("host", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    bound = least_pages * (1 + F.log(F.greatest(F.lit(1.0), F.col("pages") * least_share / least_pages)))
    return counts.join(totals, "host").where(F.col("n") >= bound).select("host", "subtree")


def extract_text(pages: DataFrame, key: str = "page_id", rules: bool = True, broadcast_rows: int = 200_000) -> DataFrame:
    """Main text of each whole page: key, url, text, n_chars (code points), n_template (code points that templates took).

    Null html counts as empty and gives an empty text, as do pages without main text. Unclosed elements end with their
    parents, a tag that the page breaks off in is left out. Line breaks inside a block are white space. Null urls share
    the empty host. Repeated rows are rows of their own, an empty table gives none, other columns are ignored.
    rules: False deletes templates alone. The templates are broadcast if they have at most broadcast_rows rows; more are
    joined to the pages, each of which gets those that it has. Both ways give the same rows.
    """
    pages = pages.select(key, "url", "html")
    parsed = parse_pages(pages, key)
    templates = cut(template_table(parsed), "templates")
    kind = pages.schema[key].dataType.simpleString()
    by_host: dict[str, set[int]] = {}

    def texts(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 256):
                batch = whole.slice(a, 256)
                found, taken = [], []
                for host, parents, hashes, forms, lines, gone in zip(*(batch.column(i).to_pylist() for i in range(2, 8))):
                    gone, dead = set(gone or ()) if known is None else known.get(host, ()), []
                    for parent, h, form in zip(parents, hashes, forms):
                        dead.append(h in gone or form in gone or (parent >= 0 and dead[parent]))
                    left = [x for x in lines if x["at"] < 0 or not dead[x["at"]]]
                    taken.append(sum(len(x["text"]) for x in lines) - sum(len(x["text"]) for x in left))
                    found.append("\n".join(x["text"] for x in left if x["kept"] or not rules))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64()), pa.array(taken, pa.int64())], [key, "url", "text", "n_chars", "n_template"])

    columns = [key, "url", "host", "parents", "hashes", "forms", "lines"]
    schema = f"`{key}` {kind}, url string, text string, n_chars long, n_template long"
    if templates.count() <= broadcast_rows:
        for host, subtree in templates.collect():
            by_host.setdefault(host, set()).add(subtree)
        sent = pages.sparkSession.sparkContext.broadcast(by_host)
        return parsed.select(*columns, F.lit(None).cast("array<long>").alias("gone")).mapInArrow(lambda batches: texts(batches, sent.value), schema)
    each = parsed.select("row", "host", F.explode(subtrees()).alias("subtree"))
    counts = each.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counts, ["host", "subtree"], "n", parsed.count())
    # a template stands on many pages: its rows are dealt over many tasks, and each page gets back what it has of them
    gone = salted_join(each, templates, ["host", "subtree"], hot, "row").groupBy("row").agg(F.collect_set("subtree").alias("gone"))
    return parsed.join(gone.hint("merge"), "row", "left").select(*columns, "gone").mapInArrow(lambda batches: texts(batches, None), schema)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
