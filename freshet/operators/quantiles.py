"""Exact quantiles of groups of any size, by selection in rounds of counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.scratch import written

#: Bins that a round divides an interval into.
BINS = 1024
#: Values up to which a group's quantiles are taken from its values in one task.
AT_ONCE = 1_000_000


def scale(v: Column) -> Column:
    """Rises with v, by the logarithm of its size on either side of 0."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1100))


def select_ranks(rows: DataFrame, keys: list[str], value: str, ranks: DataFrame, bins: int = BINS) -> DataFrame:
    """(keys, rank), ranks from 0, to the value of that rank among the group's values: keys, rank, value.

    A round counts the values of each asked interval by bins of equal width, with each bin's least and greatest value, and
    narrows every rank to the bin that holds it, until a bin holds one value only. Counts are made in each task before the
    shuffle, so a large group is no large task; rounds end in written tables, and from the second on only values inside
    asked intervals are read. An interval's bounds are values that occur; where most of an interval's values fall into one
    bin, its next bins are of equal ratio, so that values of very different size take few rounds too.
    """
    v = F.col("_v")
    rows = rows.select(*keys, S.finite(F.col(value)).alias("_v")).where(v.isNotNull())
    span = rows.groupBy(*keys).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    asked = written(ranks.select(*keys, F.col("rank").cast("long").alias("rank"), F.lit(0).cast("long").alias("below"), F.lit(False).alias("ratio")).join(span, keys), "ranks")
    done = []
    while True:
        done.append(asked.where("lo = hi").select(*keys, "rank", F.col("lo").alias("value")))
        asked = asked.where("lo < hi")
        if asked.isEmpty():
            break
        intervals = asked.select(*keys, "lo", "hi", "ratio").distinct()
        inside = rows.join(intervals, keys).where((v >= F.col("lo")) & (v <= F.col("hi")))
        lo, hi = F.col("lo"), F.col("hi")
        far = (F.abs(lo) > 1e300) | (F.abs(hi) > 1e300)  # halved, so that the width is finite
        even = F.when(far, F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2)).otherwise(F.try_divide(v - lo, hi - lo))
        part = F.when(F.col("ratio"), F.try_divide(scale(v) - scale(lo), scale(hi) - scale(lo))).otherwise(even)
        place = F.least(F.floor(F.coalesce(part, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
        counts = inside.groupBy(*keys, "lo", "hi", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"))
        w = Window.partitionBy(*keys, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        upto = counts.withColumn("upto", F.sum("n").over(w)).withColumn("whole", F.sum("n").over(Window.partitionBy(*keys, "lo", "hi")))
        met = asked.join(upto, [*keys, "lo", "hi"])
        at = F.col("rank") - F.col("below")
        met = met.where((at >= F.col("upto") - F.col("n")) & (at < F.col("upto")))
        asked = written(met.select(*keys, "rank", (F.col("below") + F.col("upto") - F.col("n")).alias("below"), F.col("least").alias("lo"), F.col("most").alias("hi"), (~F.col("ratio") & (F.col("n") * 4 > F.col("whole"))).alias("ratio")), "ranks")
        near = asked.where("lo < hi").select(*keys, "lo", "hi").distinct()
        rows = written(rows.join(near, keys).where((v >= F.col("lo")) & (v <= F.col("hi"))).select(*keys, "_v"), "values")
    return reduce(DataFrame.unionByName, done)


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], at_once: int = AT_ONCE, bins: int = BINS) -> DataFrame:
    """keys, n, and an array of the quantiles of each group in the order of `shares`, interpolated between the neighbouring
    values (type 7, as `percentile`); NULL, NaN and infinite values do not count, and a group without others has NULLs.

    Groups of up to `at_once` values go through `percentile`, which holds a group's different values in one task; larger
    ones through `select_ranks`, with the same result. Which are large is found out while the DataFrame is built.
    """
    v = S.finite(F.col(value))
    rows = rows.select(*keys, v.alias("_value"))
    sizes = written(rows.groupBy(*keys).agg(F.count("_value").alias("n")), "sizes")
    large = sizes.where(F.col("n") > at_once)
    if large.isEmpty():
        return rows.groupBy(*keys).agg(F.count("_value").alias("n"), F.percentile("_value", F.array(*map(F.lit, shares))).alias("quantiles"))
    small = rows.join(large, keys, "left_anti")
    out = small.groupBy(*keys).agg(F.count("_value").alias("n"), F.percentile("_value", F.array(*map(F.lit, shares))).alias("quantiles"))
    each = large.select(*keys, "n", F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("place", "share")).withColumn("h", F.col("share") * (F.col("n") - 1))
    ends = each.select(*keys, "n", "place", "h", F.explode(F.array(F.floor("h"), F.ceil("h"))).alias("rank")).distinct()
    held = select_ranks(rows.join(large.select(*keys), keys), keys, "_value", ends.select(*keys, "rank").distinct(), bins)
    met = ends.join(held, [*keys, "rank"]).groupBy(*keys, "n", "place", "h").agg(F.min_by("value", "rank").alias("a"), F.max_by("value", "rank").alias("b"))
    part = F.col("h") - F.floor("h")
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b"))
    told = met.groupBy(*keys, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", between.alias("q")))), lambda x: x["q"]).alias("quantiles"))
    return out.unionByName(told)
