"""Quotation linking: chats with quoted text, rebuilt in reply order without quotes. DataFrame operations only.

Lines that start with `>` are quotes, as deep as their marks are many. Adjacent lines of one depth are a passage. A
passage is found in earlier messages of its conversation by hashes of normalised text: the passage as a whole, or else
its lines and sentences, so parts of a line and paragraphs that were wrapped anew are found too. Every lookup takes the latest earlier message with the hash, by running maxima over buckets of turns, so a
sentence that everybody repeats makes no pairs. Messages follow the thread that they answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

MARKS = r"^(?:[ \t]*>)+[ \t]?"
ATTRIBUTION = r"(?i)^.{1,200}(?:wrote|a écrit|schrieb|escribió) ?:\s*$"
#: Turns of a bucket.
BUCKET = 4096
_LATE = 2**62


def is_quote(line: Column) -> Column:
    return line.rlike(r"^[ \t]*>")


def level_of(line: Column) -> Column:
    """Depth of the quote: 0 for a line of the message's own."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def normalised(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda x: x != "")


def own_lines(lines: Column) -> Column:
    """Lines that are not quoted, without the line that names the author of the quote below it."""
    return F.filter(lines, lambda x, i: ~is_quote(x) & ~(x.rlike(ATTRIBUTION) & F.coalesce(is_quote(F.get(lines, i + 1)), F.lit(False))))


def latest_before(rows: DataFrame) -> DataFrame:
    """rows (conv, h, turn, kind): for those of kind 1, the latest turn before theirs that is of kind 0, as `source`.

    Two levels of running maxima, by buckets of turns, so no key's rows need to meet in one task.
    """
    own = F.when(F.col("kind") == 0, F.col("turn"))
    rows = rows.withColumn("bucket", F.floor(F.col("turn") / BUCKET))
    inside = Window.partitionBy("conv", "h", "bucket").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    maxima = rows.groupBy("conv", "h", "bucket").agg(F.max(own).alias("top"))
    over = Window.partitionBy("conv", "h").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    maxima = maxima.select("conv", "h", "bucket", F.max("top").over(over).alias("earlier"))
    here = rows.withColumn("near", F.max(own).over(inside)).where("kind = 1")
    return here.join(maxima, ["conv", "h", "bucket"]).withColumn("source", F.greatest("near", "earlier")).where("source IS NOT NULL").drop("bucket", "near", "earlier", "kind")


def _links(base: DataFrame) -> DataFrame | None:
    """conv, turn, m, quotes (level, passage, hash, source) and reply_to; None if nothing is quoted."""
    message = ["conv", "turn", "m"]
    quoted = base.where(F.exists("lines", is_quote)).select(*message, "lines").distinct()
    lines = quoted.select(*message, F.posexplode("lines").alias("pos", "line")).withColumn("level", level_of(F.col("line"))).withColumn("content", F.regexp_replace("line", MARKS, ""))
    order = Window.partitionBy(*message).orderBy("pos")
    starts = F.coalesce((F.col("level") != F.lag("level").over(order)).cast("int"), F.lit(0))
    lines = lines.withColumn("starts", starts).withColumn("passage", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("level > 0")
    passages = lines.groupBy(*message, "passage", "level").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]).alias("parts"))
    whole = normalised(F.array_join("parts", " "))
    passages = cut(passages.withColumn("whole", whole).where("whole <> ''").withColumn("hash", F.sha2("whole", 256)), "passages")
    if passages.isEmpty():
        return None
    tag = lambda w: lambda t: F.struct(F.lit(w).alias("weight"), F.sha2(t, 256).alias("h"))
    lines_of = F.filter(F.transform("parts", normalised), lambda t: t != "")
    line_keys = F.transform(F.concat(lines_of, F.array_except(sentences(F.col("whole")), lines_of)), tag(0))
    keys = passages.select(*message, "passage", "level", "hash", F.explode(F.concat(F.array(tag(1)(F.col("whole"))), line_keys)).alias("k")).select(*message, "passage", "level", "hash", "k.weight", "k.h")
    keys = cut(keys.groupBy(*message, "passage", "level", "hash", "weight", "h").agg(F.count(F.lit(1)).alias("times")), "quote-keys")
    mine = normalised(F.array_join("own", " "))
    texts = F.filter(F.array_distinct(F.concat(F.array(mine), F.transform("own", normalised), sentences(mine))), lambda t: t != "")
    originals = base.select("conv", "turn", F.explode(F.transform(texts, lambda t: F.sha2(t, 256))).alias("h")).join(keys.select("conv", "h").distinct(), ["conv", "h"], "left_semi").distinct()
    asked = keys.select("conv", "h", "turn").distinct()
    found = latest_before(originals.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1))))
    # of a passage's sources: one that has all of it, else one with most of its lines and sentences, else the latest
    hits = keys.join(found, ["conv", "h", "turn"]).groupBy(*message, "passage", "level", "hash", "source").agg(F.struct(F.max("weight"), F.sum("times"), F.col("source").alias("turn")).alias("best"))
    best = hits.groupBy(*message, "passage", "level", "hash").agg(F.max("best")["turn"].alias("source"))
    every = passages.select(*message, "passage", "level", "hash").join(best, [*message, "passage", "level", "hash"], "left")
    quotes = F.array_sort(F.collect_list(F.struct("passage", "level", "hash", "source")))
    nearest = F.max(F.when(F.col("source").isNotNull(), F.struct(-F.col("level"), "source")))["source"]
    return cut(every.groupBy(*message).agg(quotes.alias("quotes"), nearest.alias("reply_to")), "links")


def _threads(links: DataFrame) -> DataFrame:
    """conv, turn, thread: the first message that following answers backwards leads to, by pointer doubling."""
    step = cut(links.where("reply_to IS NOT NULL").groupBy("conv", "turn").agg(F.max("reply_to").alias("thread")), "threads")
    while True:
        up = step.select("conv", F.col("turn").alias("thread"), F.col("thread").alias("further"))
        new = cut(step.join(up, ["conv", "thread"], "left").select("conv", "turn", F.coalesce("further", "thread").alias("thread"), F.col("further").isNotNull().alias("moved")), "threads")
        step = new.drop("moved")
        if new.where("moved").isEmpty():
            return step


def rebuild_conversations(messages: DataFrame) -> DataFrame:
    """One row a message: conv_id, turn, role, text (without quotes), position, reply_to, thread, quotes.

    position counts from 1 in reply order: threads by their first message, messages of a thread by turn, so each comes
    after the one it answers. reply_to is the turn that its quote of least depth was found in (of several the latest),
    null without. thread is the turn of the first message on that way, its own if it quotes none. quotes lists
    passages in order, with level, hash and source turn (null if no earlier message has the text).
    Null texts count as empty and stay as empty messages; null conv_ids form one conversation, null turns come last
    in theirs. Repeated rows stay, next to each other. An empty table gives no rows; other columns are ignored.
    """
    lines = F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1)
    base = messages.select("conv_id", F.col("turn").alias("given"), "role", F.coalesce(F.col("conv_id").cast("long"), F.lit(-(2**63))).alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(_LATE)).alias("turn"), F.xxhash64("role", "text").alias("m"), lines.alias("lines"))
    base = base.withColumn("own", own_lines(F.col("lines")))
    links = _links(base)
    text = F.regexp_replace(F.array_join("own", "\n"), r"^\s+|\s+$", "")
    out = base.select("conv_id", "given", "role", "conv", "turn", "m", text.alias("text"))
    none = "array<struct<passage:bigint,level:int,hash:string,source:bigint>>"
    if links is None:
        out = out.withColumn("reply_to", F.lit(None).cast("long")).withColumn("thread", F.col("turn")).withColumn("quotes", F.array().cast(none))
    else:
        out = out.join(links, ["conv", "turn", "m"], "left").join(_threads(links), ["conv", "turn"], "left")
        out = out.withColumn("thread", F.coalesce("thread", "turn")).withColumn("quotes", F.coalesce("quotes", F.array().cast(none)))
    # positions: ranges of the whole order, counted by conversation, then ranks inside each range
    order = ["thread", "turn", "role", "text"]
    dealt = cut(out.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order))
    placed = dealt.withColumn("rank", rank).join(sizes, ["conv", "part"])
    late = lambda c: F.when(F.col(c) < _LATE, F.col(c))
    return placed.select("conv_id", F.col("given").alias("turn"), "role", "text", (F.col("rank") + F.col("ahead")).alias("position"), "reply_to", late("thread").alias("thread"), "quotes")


def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuild_conversations(table(spark, sf_dir, "conversations"))
