"""Forcing: units, monthly climatology, water balance, erosivity, completeness, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .series import K, spine

#: Fixed value: mean days of the months, in order.
MONTH_DAYS = (31, 28.25, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def wide(long: DataFrame, variables: list[str], key: str = K) -> DataFrame:
    """(date, variable, value) to one column a variable, in one shuffle."""
    return long.groupBy(key, "date").pivot("variable", variables).agg(F.first("value", ignorenulls=True))


def forcing_units(rows: DataFrame, names: dict[str, str] | None = None, key: str = K) -> DataFrame:
    """tmin and tmax to degrees Celsius as tmin_C and tmax_C, with their mean as tavg_C.

    A recorded unit (columns tmin_unit, tmax_unit, where there are such) decides: K is converted, any other is not. Where
    it is NULL or not there, a site's mean above 200 means Kelvin. names: further columns and the standard ones that they
    become, such as {"pr": "prcp_mm"}.
    """
    w = Window.partitionBy(key)

    def celsius(c: str) -> Column:
        guess = F.avg(c).over(w) > 200
        kelvin = F.coalesce(F.col(f"{c}_unit") == "K", guess) if f"{c}_unit" in rows.columns else guess
        return F.when(kelvin, F.col(c) - 273.15).otherwise(F.col(c))

    out = rows.withColumns({f"{c}_C": celsius(c) for c in ("tmin", "tmax")}).drop("tmin_unit", "tmax_unit").withColumnsRenamed(names or {})
    return out.withColumn("tavg_C", (F.col("tmin_C") + F.col("tmax_C")) / 2).drop("tmin", "tmax")


def valid_months(series: DataFrame, most_missing: int = 10, run_below: int = 5, key: str = K) -> DataFrame:
    """Monthly means and whether valid: at most most_missing days of the whole month absent, no gap of run_below days.

    Days outside the record count as missing in its first and last month.
    """
    edges = series.groupBy(key).agg(F.trunc(F.min("date"), "MM").alias("lo"), F.last_day(F.max("date")).alias("hi"))
    days = edges.select(key, F.explode(F.sequence("lo", "hi")).alias("date")).join(series.select(key, "date", "value"), [key, "date"], "left")
    days = days.withColumn("year", F.year("date")).withColumn("month", F.month("date"))
    gone = days.where("value IS NULL")
    island = F.date_sub("date", F.row_number().over(Window.partitionBy(key, "year", "month").orderBy("date")))
    longest = gone.withColumn("i", island).groupBy(key, "year", "month", "i").agg(F.count(F.lit(1)).alias("n")).groupBy(key, "year", "month").agg(F.max("n").alias("longest"), F.sum("n").alias("missing"))
    means = days.groupBy(key, "year", "month").agg(F.avg("value").alias("mean"), F.sum("value").alias("total"))
    out = means.join(longest, [key, "year", "month"], "left").fillna(0, ["longest", "missing"])
    return out.withColumn("valid", (F.col("missing") <= most_missing) & (F.col("longest") < run_below))


def climatology(months: DataFrame, least_share: float = 0.8, key: str = K) -> DataFrame:
    """Mean of valid monthly means, one row a calendar month; usable if valid in least_share of the month's years."""
    g = months.groupBy(key, "month").agg(F.avg(F.when(F.col("valid"), F.col("mean"))).alias("clim"), (F.count_if("valid") / F.count(F.lit(1))).alias("share"))
    return g.withColumn("ok", F.col("share") >= least_share)


def annual_total(clim: DataFrame, key: str = K) -> DataFrame:
    """Mean annual total and mean; NULL with the months at fault if any calendar month is unusable or absent."""
    days = F.element_at(F.array(*[F.lit(float(x)) for x in MONTH_DAYS]), F.col("month"))
    g = clim.groupBy(key).agg(F.sum(F.col("clim") * days).alias("t"), F.count_if("ok").alias("n"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("month")))).alias("bad"))
    good = F.col("n") == 12
    return g.select(key, F.when(good, F.col("t")).alias("annual"), F.when(good, F.col("t") / 365.25).alias("mean"), F.when(~good, F.concat(F.lit("unusable months: "), F.array_join("bad", ","))).alias("reason"))


def water_balance(forcing: DataFrame, key: str = K) -> DataFrame:
    """(prcp, pet, tavg) to annual totals, aridity, wet days above 1 mm and the share of snow (tavg <= 0 on wet days)."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("variable"), c.cast("double").alias("value")) for n, c in (("prcp", F.col("prcp")), ("pet", F.col("pet")), ("wet", F.col("prcp") > 1))]))
    long = forcing.select(key, "date", each.alias("x")).select(F.struct(F.col(key).alias("site"), "x.variable").alias("_k"), "date", "x.value")
    totals = annual_total(climatology(valid_months(long, key="_k"), key="_k"), "_k").select("_k.site", "_k.variable", "annual")
    pick = lambda v: F.max(F.when(F.col("variable") == v, F.col("annual")))
    wide_totals = totals.groupBy(F.col("site").alias(key)).agg(pick("prcp").alias("annual_prcp"), pick("pet").alias("annual_pet"), pick("wet").alias("wet_days"))
    snow = forcing.where("prcp IS NOT NULL AND tavg IS NOT NULL").groupBy(key).agg(F.try_divide(F.sum(F.when(F.col("tavg") <= 0, F.col("prcp")).otherwise(0.0)), F.sum("prcp")).alias("snow_fraction"))
    out = wide_totals.join(snow, key, "left")
    return out.withColumn("aridity", F.when(F.col("annual_prcp") > 0, F.col("annual_pet") / F.col("annual_prcp"))).withColumn("wet_day_frequency", F.col("wet_days") / 365.25)


def completeness(forcing: DataFrame, requested: list[str], key: str = K) -> DataFrame:
    """Valued and missing days of each requested variable, whether it was served, and whether the site's forcing is complete.

    A variable that forcing has no column of, or no value, was not served. Complete: all were, and no day is missing.
    """
    there = [v for v in requested if v in forcing.columns]
    long = forcing.select(key, "date", *[F.col(v).cast("double") if v in there else F.lit(None).cast("double").alias(v) for v in requested]).unpivot([key, "date"], requested, "variable", "value")
    g = long.groupBy(key, "variable").agg(F.count("value").alias("finite_days"), F.count_if(F.col("value").isNull()).alias("missing_days"))
    g = g.withColumn("served", F.col("finite_days") > 0)
    return g.withColumn("forcing_complete", F.max("missing_days").over(Window.partitionBy(key)) == 0)


def merge_coverage(parts: DataFrame, key: str = K) -> DataFrame:
    """Coverage of chunks (chunk_no, head, tail, internal, complete, ranges) to that of the whole fetch.

    internal is NULL if one chunk's is; an inner edge that is NULL counts as no missing day. complete looks at known flags.
    """
    edge = lambda c: F.coalesce(F.col(c), F.lit(0))
    inner = F.sum("internal") + F.sum(edge("head")) - F.min_by(edge("head"), "chunk_no") + F.sum(edge("tail")) - F.max_by(edge("tail"), "chunk_no")
    inner = F.when(F.bool_and(F.col("internal").isNotNull()), inner)
    ranges = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "ranges"))), lambda x: x["ranges"]))
    return parts.groupBy(key).agg(F.min_by("head", "chunk_no").alias("head"), F.max_by("tail", "chunk_no").alias("tail"), inner.alias("internal"), F.every("complete").alias("complete"), ranges.alias("ranges"))


def erosivity(series: DataFrame, key: str = K) -> DataFrame:
    """Modified Fournier index and R factor (Renard and Freimund 1994); here a missing day of a month counts as none of its rain."""
    totals = series.groupBy(key, F.year("date").alias("year"), F.month("date").alias("month")).agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("p"))
    months = totals.groupBy(key, "month").agg(F.avg("p").alias("p"))
    g = months.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.sum(F.col("p") * F.col("p")), F.sum("p")).alias("fournier")).where("n = 12")
    f = F.col("fournier")
    return g.select(key, "fournier", F.when(f <= 55, 0.07397 * F.pow(f, 1.847)).otherwise(95.77 - 6.081 * f + 0.4770 * f * f).alias("r_factor"))


def aggregate_time(series: DataFrame, unit: str, key: str = K) -> DataFrame:
    """Means by month (yyyy-MM) or year (yyyy); rows without a day or value are left out."""
    form = {"monthly": "yyyy-MM", "yearly": "yyyy"}[unit]
    return series.where("date IS NOT NULL AND value IS NOT NULL").groupBy(key, F.date_format("date", form).alias("period")).agg(F.avg("value").alias("value"))


def no_leap_calendar(series: DataFrame, key: str = K) -> DataFrame:
    """Whether each leap year inside the record lacks 31 December, and there is one."""
    span = series.groupBy(key).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    ends = span.select(key, F.explode(F.sequence(F.year("lo"), F.year("hi"))).alias("y"), "lo", "hi").where("y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0)").withColumn("date", F.make_date("y", F.lit(12), F.lit(31))).where("date BETWEEN lo AND hi")
    met = ends.join(series.where("value IS NOT NULL").select(key, "date", F.lit(True).alias("there")), [key, "date"], "left")
    g = met.groupBy(key).agg(F.every(F.col("there").isNull()).alias("no_leap"), F.count(F.lit(1)).alias("leap_years"))
    return span.select(key).join(g, key, "left").select(key, F.coalesce("no_leap", F.lit(False)).alias("no_leap"), F.coalesce("leap_years", F.lit(0)).alias("leap_years"))


def monthly_totals(series: DataFrame, min_month_fraction: float = 1.0, key: str = K) -> DataFrame:
    """Each calendar month of a site's record with its total, share of days with a value, and whether that share will do."""
    g = series.groupBy(key, F.year("date").alias("year"), F.month("date").alias("month")).agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    span = series.groupBy(key).agg(F.trunc(F.min("date"), "MM").alias("lo"), F.trunc(F.max("date"), "MM").alias("hi"))
    months = span.select(key, F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("m"))
    months = months.select(key, F.year("m").alias("year"), F.month("m").alias("month"), F.dayofmonth(F.last_day("m")).alias("days"))
    met = months.join(g, [key, "year", "month"], "left").withColumn("share", F.coalesce("n", F.lit(0)) / F.col("days"))
    return met.select(key, "year", "month", "total", "share", (F.col("share") >= min_month_fraction).alias("kept"))


def whole_periods(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Periods that the range does not clip, and those that are dropped for it."""
    return rows.where("NOT clipped").drop("clipped"), rows.where("clipped").drop("clipped")


def periods(start: str, end: str, unit: str, frame: DataFrame) -> DataFrame:
    """Months or years between start and end of each row of frame, clipped to the range."""
    floor, step = {"monthly": ("MM", "INTERVAL 1 MONTH"), "yearly": ("YEAR", "INTERVAL 1 YEAR")}[unit]
    each = frame.withColumn("p", F.explode(F.sequence(F.trunc(start, floor), F.col(end), F.expr(step))))
    last = F.last_day("p") if unit == "monthly" else F.make_date(F.year("p"), F.lit(12), F.lit(31))
    return each.withColumn("period_start", F.greatest("p", start)).withColumn("period_end", F.least(last, end)).withColumn("clipped", (F.col("period_start") > F.col("p")) | (F.col("period_end") < last)).drop("p")
