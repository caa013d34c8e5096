"""Daily series: cleaning, calendars, summaries, runs, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

K = "site_id"


def make_series(raw: DataFrame, date: str = "date", value: str = "value", key: str = K) -> tuple[DataFrame, DataFrame]:
    """Clean series and rejects. Values that are no finite number are NULL; a site's repeated day goes to rejects, all of its rows."""
    rows = raw.select(key, S.day_of(F.col(date)).alias("date"), S.finite(F.expr(f"try_cast(`{value}` AS double)")).alias("value"))
    counted = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key, "date")))
    good = counted.where("date IS NOT NULL AND n = 1").drop("n")
    bad = counted.where("date IS NULL OR n > 1").groupBy(key, "date").agg(F.count(F.lit(1)).alias("n"))
    return good, bad


def window(series: DataFrame, start: str, end: str) -> DataFrame:
    """Days from start to end, both included."""
    if start > end:
        raise ValueError(f"the window ends ({end}) before it starts ({start})")
    return series.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def drop_null(series: DataFrame, keep_dates: int = 20, key: str = K) -> tuple[DataFrame, DataFrame]:
    """Series without NULL values, and for each site their count and first dates."""
    order = F.row_number().over(Window.partitionBy(key).orderBy("date"))
    first = series.where("value IS NULL").withColumn("_i", order).where(F.col("_i") <= keep_dates)
    first = first.groupBy(key).agg(F.array_sort(F.collect_list("date")).alias("null_dates"))
    counts = series.groupBy(key).agg(F.count_if(F.col("value").isNull()).alias("n_null"))
    met = counts.join(first, key, "left").withColumn("null_dates", F.coalesce("null_dates", F.array().cast("array<date>")))
    return series.where("value IS NOT NULL"), met


def spine(series: DataFrame, start: str | None = None, end: str | None = None, key: str = K) -> DataFrame:
    """Every calendar day of each site's span, or of the given one."""
    low = F.lit(start).cast("date") if start else F.min("date")
    high = F.lit(end).cast("date") if end else F.max("date")
    return series.groupBy(key).agg(low.alias("lo"), high.alias("hi")).where("lo <= hi").select(key, F.explode(F.sequence("lo", "hi")).alias("date"))


def missing_days(series: DataFrame, start: str | None = None, end: str | None = None, valued: bool = False, key: str = K) -> DataFrame:
    """Days of the span that the series has no row of; valued: days without a value too."""
    there = series.where("value IS NOT NULL") if valued else series
    return spine(series, start, end, key).join(there.select(key, "date"), [key, "date"], "left_anti")


def islands(days: DataFrame, key: str = K) -> DataFrame:
    """Runs of consecutive days: start, end, days."""
    number = F.row_number().over(Window.partitionBy(key).orderBy("date"))
    return days.withColumn("island", F.date_sub("date", number)).groupBy(key, "island").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("days")).drop("island")


def summarise(series: DataFrame, quantiles: tuple[float, ...] = (0.05, 0.5, 0.95), key: str = K) -> DataFrame:
    """Counts, mean, extremes, quantiles (interpolated, non-exceedance) and span of each site."""
    v = F.col("value")
    parts = [F.percentile(v, F.lit(q)).alias(f"q{round(q * 100):02d}") for q in quantiles]
    return series.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("n_finite"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), *parts, F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def statistic(name: str, value: str = "value") -> Column:
    """mean, median, std (sample), min, max, sum or pNN."""
    v = F.col(value)
    named = {"mean": F.avg, "median": F.median, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}
    if name in named:
        return named[name](v)
    if name[:1] == "p" and name[1:].isdigit() and int(name[1:]) <= 100:
        return F.percentile(v, F.lit(int(name[1:]) / 100))
    raise ValueError(f"unknown statistic {name}")


def _bounded(series: DataFrame, bounds: DataFrame | None, key: str) -> DataFrame:
    """Each site's rows with its span (lo, hi): that of bounds (key, start, end), where NULL or without bounds the first to
    the last date. Rows outside have no date and value; a site of bounds without rows has one such row."""
    rows = series.select(key, F.col("date").cast("date").alias("date"), "value")
    span = rows.groupBy(key).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    if bounds is None:
        return rows.join(span, key)
    given = bounds.select(key, F.col("start").cast("date").alias("_start"), F.col("end").cast("date").alias("_end"))
    span = span.join(given, key, "full").select(key, F.coalesce("_start", "lo").alias("lo"), F.coalesce("_end", "hi").alias("hi"))
    inside = F.col("date").between(F.col("lo"), F.col("hi"))
    return span.join(rows, key, "left").select(key, "lo", "hi", F.when(inside, F.col("date")).alias("date"), F.when(inside, F.col("value")).alias("value"))


def _days(lo: Column, hi: Column) -> Column:
    return F.coalesce(F.greatest(F.datediff(hi, lo) + 1, F.lit(0)), F.lit(0))


def calendar_block(series: DataFrame, bounds: DataFrame | None = None, key: str = K) -> DataFrame:
    """Expected, present and missing days of each site's span: the given one (bounds: key, start, end), else that of its
    dates. A day with a row is present, with or without a value; a span that ends before it starts expects none."""
    rows = _bounded(series, bounds, key)
    g = rows.groupBy(key).agg(_days(F.first("lo"), F.first("hi")).alias("expected"), F.count_distinct("date").alias("present"))
    return g.select(key, "expected", "present", (F.col("expected") - F.col("present")).alias("missing"))


def served_summary(series: DataFrame, bounds: DataFrame | None = None, daily: bool = True, key: str = K) -> DataFrame:
    """Summary as served, of the rows inside the given span (as for `calendar_block`): counts, the fraction of its days with a
    value and whether that is partial (both NULL for a series that is not daily), values to six significant digits."""
    rows = _bounded(series, bounds, key)
    expected = _days(F.first("lo"), F.first("hi"))
    g = rows.groupBy(key).agg(F.count("date").alias("n_dates"), F.count("value").alias("n_finite"), expected.alias("expected"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    fraction = F.try_divide(F.col("n_finite"), F.col("expected")) if daily else F.lit(None).cast("double")
    return g.select(key, "n_dates", "n_finite", "expected", S.significant(fraction).alias("fraction_with_value"), (fraction < 1).alias("partial"), *[S.significant(F.col(c)).alias(c) for c in ("mean", "min", "max")], "first_date", "last_date")


COMPARE = {"gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}


def threshold_runs(series: DataFrame, threshold: float | Column, comparison: str = "gt", gaps: str = "break", relative_to: str | None = None, key: str = K) -> DataFrame:
    """Runs of values past a threshold: start, end, length (observations), calendar_days.

    gaps: `break` - a missing day or value ends a run; `skip` - only valued rows count, days between them do not.
    relative_to: the threshold is a factor on that statistic of the site.
    """
    level = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    rows = series
    if relative_to:
        own = series.groupBy(key).agg(statistic(relative_to).alias("_level"))
        rows, level = rows.join(own, key), level * F.col("_level")
    rows = rows.where("value IS NOT NULL").withColumn("hit", COMPARE[comparison](F.col("value"), level))
    if gaps == "break":
        hits = rows.where("hit").withColumn("island", F.date_sub("date", F.row_number().over(Window.partitionBy(key).orderBy("date"))))
    elif gaps == "skip":
        rank = F.row_number().over(Window.partitionBy(key).orderBy("date"))
        both = rows.withColumn("island", rank - F.row_number().over(Window.partitionBy(key, "hit").orderBy("date")))
        hits = both.where("hit")
    else:
        raise ValueError(f"unknown gap policy {gaps}")
    runs = hits.groupBy(key, "island").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("length"))
    return runs.drop("island").withColumn("calendar_days", F.datediff("end", "start") + 1)


def longest_run(runs: DataFrame, key: str = K) -> DataFrame:
    """The longest run of each site, the first of equals, with the number of runs and of observations in them."""
    best = F.max_by(F.struct("start", "end", "length"), F.struct(F.col("length"), -F.datediff("start", F.lit("1970-01-01"))))
    return runs.groupBy(key).agg(best.alias("b"), F.count(F.lit(1)).alias("n_runs"), F.sum("length").alias("n_passing")).select(key, "n_runs", "n_passing", F.col("b.start").alias("longest_start"), F.col("b.end").alias("longest_end"), F.col("b.length").alias("longest"))


def pair(a: DataFrame, b: DataFrame, key: str = K) -> DataFrame:
    """Common days of two series, as value_a and value_b."""
    return a.select(key, "date", F.col("value").alias("value_a")).join(b.select(key, "date", F.col("value").alias("value_b")), [key, "date"])


def agreement(a: DataFrame, b: DataFrame, key: str = K) -> DataFrame:
    """How b (simulated) agrees with a (observed): pairs, means, bias, correlation, spread, KGE (2009), RMSE and NSE.

    Results that would divide by nothing, such as those of a constant series, are NULL.
    """
    both = pair(a, b, key)
    common = F.count(F.lit(1)).alias("n_common")
    ok = F.col("value_a").isNotNull() & F.col("value_b").isNotNull()
    x, y = F.when(ok, F.col("value_a")), F.when(ok, F.col("value_b"))
    e = y - x
    m = both.groupBy(key).agg(common, F.count(x).alias("n_pairs"), F.avg(x).alias("mean_a"), F.avg(y).alias("mean_b"), F.stddev_pop(x).alias("sd_a"), F.stddev_pop(y).alias("sd_b"), F.covar_pop(x, y).alias("cov"), F.avg(e * e).alias("mse"), F.min(F.when(ok, F.col("date"))).alias("start"), F.max(F.when(ok, F.col("date"))).alias("end"))
    spread = (F.col("n_pairs") >= 2) & (F.col("sd_a") > 1e-12) & (F.col("sd_b") > 1e-12)
    r = F.when(spread, F.col("cov") / (F.col("sd_a") * F.col("sd_b")))
    alpha, beta = F.when(F.col("sd_a") > 1e-12, F.col("sd_b") / F.col("sd_a")), F.when(F.abs("mean_a") > 1e-12, F.col("mean_b") / F.col("mean_a"))
    kge = F.when(F.col("mean_a") >= 1e-12, 1) - F.sqrt(F.pow(r - 1, 2) + F.pow(alpha - 1, 2) + F.pow(beta - 1, 2))
    bias = F.when(F.col("mean_a") != 0, 100 * (F.col("mean_b") - F.col("mean_a")) / F.col("mean_a"))
    nse = F.when(F.col("sd_a") > 1e-12, 1 - F.col("mse") / F.pow("sd_a", F.lit(2)))
    return m.select(key, "n_common", "n_pairs", "mean_a", "mean_b", bias.alias("percent_bias"), r.alias("r"), "sd_a", "sd_b", alpha.alias("sd_ratio"), beta.alias("beta"), kge.alias("kge"), nse.alias("nse"), F.sqrt("mse").alias("rmse"), "start", "end")


def skill_rating(nse: Column) -> Column:
    return F.when(nse >= 0.75, "excellent").when(nse >= 0.5, "satisfactory").when(nse.isNotNull(), "poor").otherwise("unknown")


def run_lengths(codes: DataFrame, order: str = "date", key: str = K) -> DataFrame:
    """Run-length encoding of the `code` column in order: run_no (from 1), code, n."""
    w = Window.partitionBy(key).orderBy(order)
    starts = F.coalesce((~F.col("code").eqNullSafe(F.lag("code").over(w))).cast("int"), F.lit(1))
    first = F.row_number().over(w) == 1
    numbered = codes.withColumn("s", F.when(first, 1).otherwise(starts)).withColumn("run_no", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "run_no", "code").agg(F.count(F.lit(1)).alias("n"))


def step_check(instants: DataFrame, first: int = 5000, least_hours: float = 20.0, declared: str | None = None, key: str = K) -> DataFrame:
    """Median and largest step in hours, and whether a site is refused as not daily: its declared interval (a column, the
    first that a site states) is another than daily, or the median of its first instants lies above 0 and below least_hours
    (of three instants at least)."""
    w = Window.partitionBy(key).orderBy("ts")
    steps = instants.withColumn("step", (F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)) / 3.6e9).withColumn("no", F.row_number().over(w))
    early = F.median(F.when(F.col("no") <= first, F.col("step")))
    short = (F.count(F.lit(1)) > 2) & (early > 0) & (early < least_hours)
    other = F.min_by(F.col(declared), F.when(F.col(declared).isNotNull(), F.col("ts"))) != "daily" if declared else F.lit(False)
    return steps.groupBy(key).agg(F.median("step").alias("median_step_h"), F.max("step").alias("largest_gap_h"), (F.coalesce(short, F.lit(False)) | F.coalesce(other, F.lit(False))).alias("not_daily"))


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by the given columns; list a unique one to settle ties."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def union_first(parts: DataFrame, key: str = K) -> DataFrame:
    """Of overlapping chunks (column chunk_no) the first one's row for each day."""
    w = Window.partitionBy(key, "date").orderBy("chunk_no")
    return parts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def quality_summary(codes: DataFrame, key: str = K) -> DataFrame:
    """Rows (approval, qualifier cells, value) to counts of codes, the provisional share and negatives; valued days only."""
    rows = codes.where("value IS NOT NULL").withColumn("a", S.approval_tokens(F.col("approval"))).withColumn("q", S.code_tokens(F.col("qualifier")))
    has = lambda code: F.count_if(F.array_contains("a", code))
    some = F.count_if(F.size("a") > 0)
    others = F.sum(F.size(F.filter("q", lambda x: ~x.isin("A", "P", "e"))))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), has("A").alias("approved"), has("P").alias("provisional"), F.count_if(F.array_contains("q", "e")).alias("estimated"), others.alias("other_codes"), F.try_divide(has("P"), some).alias("provisional_fraction"), F.count_if(F.col("value") < 0).alias("negative"))


def code_counts(codes: DataFrame, key: str = K) -> DataFrame:
    """Rows (approval, qualifier cells, value) to how often each code stands on a valued day: key, kind (approval, qualifier),
    code, n, other (a qualifier that is none of A, P and e)."""
    rows = codes.where("value IS NOT NULL").select(key, F.explode(F.array(F.struct(F.lit("approval").alias("kind"), S.code_tokens(F.col("approval")).alias("codes")), F.struct(F.lit("qualifier").alias("kind"), S.code_tokens(F.col("qualifier")).alias("codes")))).alias("x"))
    each = rows.select(key, "x.kind", F.explode("x.codes").alias("code"))
    return each.groupBy(key, "kind", "code").agg(F.count(F.lit(1)).alias("n")).withColumn("other", (F.col("kind") == "qualifier") & ~F.col("code").isin("A", "P", "e"))
