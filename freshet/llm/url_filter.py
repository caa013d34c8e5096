"""URL filter: rules for hosts and paths, else naive Bayes over segmented host and path words.

Host names are run-together words. A unigram model of the words in page titles and of the seed words splits each label
by Viterbi; a string that is no known word costs more the longer it is. Words and their shares are counted over all
pages, and each different host label is split once: its substrings meet the word table in a join, so no table is
broadcast. A multinomial naive Bayes over a fixed number of hashed tokens scores the segmented host and the path. It
learns from the pages that a rule decides, with its verdict, from those whose host has a seed word, as examples to block,
and takes all others as background, examples to allow. The part of a path that made a rule fit is no evidence and is
left out of the example.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hot_keys, salted_join, table

#: (verdict, host, path prefix)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Seed words by kind of site: pages whose host has one, as a word of its own, are examples to block. A parameter.
SEED_WORDS = {
    "adult": "adult porn sex xxx".split(),
    "gambling": "bet bets betting casino gambling poker".split(),
    "drugs": "pharmacy pills viagra".split(),
    "fraud": "malware phishing spam warez".split(),
    "adverts": "ads adserver tracker".split(),
}
#: Occurrences that a seed word counts for among the words that hosts are split into.
SEED_COUNT = 50
BUCKETS = 1 << 16


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column, Column]:
    """The longest rule (host and path together) that fits, its verdict and its path; null if none does."""
    name, verdict, prefix = (F.lit(None).cast("string") for _ in range(3))
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict, prefix = (F.when(fits, F.lit(v)).otherwise(c) for v, c in ((h + p, name), (what, verdict), (p, prefix)))
    return name, verdict, prefix


def viterbi(label: str, cost: dict[str, float], unknown: float) -> list[str]:
    """The split of least cost; a word that is not in `cost` costs `unknown` and as much again for each character. Ties go to
    the split whose last word begins first, and so on backwards."""
    sizes = sorted({len(w) for w in cost})
    best, back, run, began = [0.0], [0], [math.inf], [0]
    for end in range(1, len(label) + 1):
        # a string of no known word goes on, or begins here
        on, new = (run[end - 1] + unknown, began[end - 1]), (best[end - 1] + 2 * unknown, end - 1)
        least = min(on, new)
        run.append(least[0])
        began.append(least[1])
        for size in sizes:
            if size > end:
                break
            word = label[end - size : end]
            if word in cost:
                least = min(least, (best[end - size] + cost[word], end - size))
        best.append(least[0])
        back.append(least[1])
    out, end = [], len(label)
    while end:
        out.append(label[back[end] : end])
        end = back[end]
    return out[::-1]


def segment_labels(labels: DataFrame, words: DataFrame) -> DataFrame:
    """label, parts: each label of `labels` split by Viterbi over `words` (word, n), costs -ln(n / all).

    A label is cut into its substrings as long as some word is, and these meet the words as equals.
    """
    total = words.agg(F.sum("n").alias("n")).first()["n"] or 1
    sizes = [r[0] for r in words.select(F.length("word").alias("k")).distinct().orderBy("k").collect()]
    fits = F.filter(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>"), lambda k: k <= F.length("label"))
    cuts = labels.where("length(label) > 0").withColumn("k", F.explode(fits)).withColumn("at", F.explode(F.sequence(F.lit(1), F.length("label") - F.col("k") + 1)))
    parts = cuts.select("label", F.col("label").substr(F.col("at"), F.col("k")).alias("word")).distinct()
    known = parts.join(words, "word").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("word", (-F.log(F.col("n") / F.lit(float(total)))).alias("cost")))).alias("k"))

    @F.pandas_udf("array<string>")
    def split(label: pd.Series, word: pd.Series, cost: pd.Series) -> pd.Series:
        return pd.Series([viterbi(a, {} if w is None else dict(zip(w, c)), math.log(1e6)) for a, w, c in zip(label, word, cost)])

    met = labels.where("length(label) > 0").join(known, "label", "left")
    return met.select("label", split("label", "k.word", "k.cost").alias("parts"))


def _path_tokens(path: Column) -> Column:
    """Runs of letters and of digits in the path, numbers by their length and first digit, each marked as of the path."""
    parts = F.regexp_extract_all(F.lower(path), F.lit(r"(?U)\p{L}+|\p{N}+"), F.lit(0))
    shape = lambda x: F.when(x.rlike(r"^\p{N}"), F.concat(F.lit("#"), F.length(x).cast("string"), F.lit("."), x.substr(1, 1))).otherwise(x)
    return F.transform(parts, lambda x: F.concat(F.lit("p:"), shape(x)))


def filter_urls(pages: DataFrame, rules=RULES, key: str = "page_id", smoothing: float = 1.0, seeds: dict[str, list[str]] = SEED_WORDS) -> DataFrame:
    """key, host, path, rule, verdict, and score (log odds of block, also where a rule decides), tokens (host words).

    Null urls and urls without `://` have an empty host and path, no rule and no tokens; the class shares decide, and
    a tie is allowed. Repeated rows are judged alike, an empty table gives no rows, and other columns than url and html's
    title are not read. Words and labels of any length count. seeds: words by kind of site.
    """
    pages = pages.select(key, "url", "html")
    listed_words = sorted({w for words in seeds.values() for w in words})
    spark = pages.sparkSession
    title = F.regexp_extract(F.coalesce(F.col("html"), F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    words = pages.select(F.explode(F.regexp_extract_all(F.lower(title), F.lit(r"(?U)\p{L}+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    extra = spark.createDataFrame([(w, SEED_COUNT) for w in listed_words], "word string, n long")
    words = cut(words.unionByName(extra).groupBy("word").agg(F.sum("n").alias("n")), "words")

    # hosts, each once: labels split at dots and hyphens, then into words
    hosts = cut(pages.select(host.alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    labels = hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit(r"(?U)[\p{L}\p{N}]+"), F.lit(0))).alias("place", "label"))
    split = segment_labels(labels.select("label").distinct(), words)
    parts = labels.join(split, "label").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "parts"))).alias("s"))
    named = hosts.join(parts, "host", "left").select("host", "pages", F.coalesce(F.flatten(F.col("s.parts")), F.array().cast("array<string>")).alias("tokens"))
    named = cut(named, "segmented")
    total = pages.count()
    urls = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    urls = salted_join(urls, named.select("host", "tokens"), ["host"], hot_keys(named, ["host"], "pages", total), key, how="left").drop("_salt")
    rule, verdict, prefix = rule_of(F.col("host"), F.col("path"), rules)

    def hashed(path: Column) -> Column:
        all_tokens = F.concat(F.transform(F.coalesce("tokens", F.array().cast("array<string>")), lambda x: F.concat(F.lit("h:"), x)), _path_tokens(path))
        return F.transform(all_tokens, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int"))

    own = F.expr("substring(path, length(coalesce(prefix, '')) + 1)")
    urls = urls.select(key, "host", "path", rule.alias("rule"), verdict.alias("ruled"), prefix.alias("prefix"), "tokens")
    listed = F.coalesce(F.arrays_overlap("tokens", F.array(*map(F.lit, listed_words)).cast("array<string>")), F.lit(False))
    label = F.coalesce((F.col("ruled") == "block").cast("int"), listed.cast("int"))
    urls = cut(urls.select(key, "host", "path", "rule", "ruled", "tokens", label.alias("block"), hashed(own).alias("example"), hashed(F.col("path")).alias("hashed")), "urls")
    taught = urls.select("block", F.col("example").alias("hashed"))
    examples = taught.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = taught.select("block", F.explode("hashed").alias("token")).groupBy("token").agg(F.sum("block").alias("bad"), F.sum(1 - F.col("block")).alias("good"))
    # one row a bucket at most, so BUCKETS bounds what comes to the driver and is broadcast
    found = counts.collect()
    bad, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for token, b, g in found:
        bad[token], good[token] = b, g
    seen = smoothing * (len(found) + 1)
    weight = np.log((bad + smoothing) / (bad.sum() + seen)) - np.log((good + smoothing) / (good.sum() + seen))
    share = {r["block"]: r["n"] for r in examples}
    prior = math.log((share.get(1, 0) + smoothing) / (share.get(0, 0) + smoothing))
    sent = spark.sparkContext.broadcast((weight, prior))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, base = sent.value
        for batch in batches:
            hashed = batch.column(batch.schema.get_field_index("hashed"))
            ends = hashed.offsets.to_numpy()
            sums = np.concatenate([[0.0], np.cumsum(w[hashed.values.to_numpy()[ends[0] : ends[-1]]])])
            odds = np.round(base + sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]], 6)
            keep = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(odds)], [*batch.schema.names[:-1], "score"])

    kind = pages.schema[key].dataType.simpleString()
    scored = urls.drop("block", "example").mapInArrow(score, f"`{key}` {kind}, host string, path string, rule string, ruled string, tokens array<string>, score double")
    verdict = F.coalesce("ruled", F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select(key, "host", "path", "rule", verdict.alias("verdict"), "score", "tokens")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
