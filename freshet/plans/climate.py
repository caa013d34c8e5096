"""Queries over forcing, drought, fits and validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import climate as C
from ..operators import fits, signatures
from ..operators import series as O
from ..operators import validators as V
from .registry import daily, gappy, instants, query, read
from .series import rounded

FORCING = "(SELECT site_id, date, value / 100 AS prcp, CASE WHEN value > 1200 THEN NULL ELSE greatest(prcp * 8 - 3, 0) END AS pet, prcp * 30 - 12 AS tavg FROM daily)"


def forcing(spark, d):
    s = daily(spark, d)
    return s.select("site_id", "date", (F.col("value") / 100).alias("prcp"), F.when(~(F.col("value") > 1200), F.greatest(F.col("prcp") * 8 - 3, F.lit(0.0))).alias("pet"), (F.col("prcp") * 30 - 12).alias("tavg"))


def months_sql(value: str, source: str = "daily") -> str:
    return f"""(SELECT *, missing <= 10 AND longest < 5 AS valid FROM (SELECT d.site_id, d.y, d.m, avg(v) AS mean, sum(v) AS total, count(*) FILTER (v IS NULL) AS missing, coalesce(any_value(longest), 0) AS longest FROM (SELECT s.*, year(s.date) AS y, month(s.date) AS m, x.v FROM (SELECT site_id, CAST(unnest(generate_series(date_trunc('month', min(date)), last_day(max(date)), INTERVAL 1 DAY)) AS DATE) AS date FROM {source} GROUP BY site_id) s LEFT JOIN (SELECT site_id, date, {value} AS v FROM {source}) x ON x.site_id = s.site_id AND x.date = s.date) d
 LEFT JOIN (SELECT site_id, y, m, max(n) AS longest FROM (SELECT site_id, y, m, count(*) AS n FROM (SELECT *, date - CAST(row_number() OVER (PARTITION BY site_id, y, m ORDER BY date) AS INTEGER) AS i FROM (SELECT s.site_id, s.date, year(s.date) AS y, month(s.date) AS m FROM (SELECT site_id, CAST(unnest(generate_series(date_trunc('month', min(date)), last_day(max(date)), INTERVAL 1 DAY)) AS DATE) AS date FROM {source} GROUP BY site_id) s LEFT JOIN (SELECT site_id, date, {value} AS v FROM {source}) x ON x.site_id = s.site_id AND x.date = s.date WHERE x.v IS NULL)) GROUP BY site_id, y, m, i) GROUP BY ALL) g ON g.site_id = d.site_id AND g.y = d.y AND g.m = d.m GROUP BY ALL))"""


def clim_sql(value: str, source: str = "daily") -> str:
    return f"(SELECT site_id, m AS month, avg(mean) FILTER (valid) AS clim, count(*) FILTER (valid) / count(*) AS share, count(*) FILTER (valid) / count(*) >= 0.8 AS ok FROM {months_sql(value, source)} GROUP BY ALL)"


def annual_sql(value: str, source: str = "daily") -> str:
    return f"(SELECT site_id, CASE WHEN n = 12 THEN t END AS annual, CASE WHEN n = 12 THEN t / 365.25 END AS mean, CASE WHEN n < 12 THEN 'unusable months: ' || coalesce(bad, '') END AS reason FROM (SELECT site_id, sum(clim * [31, 28.25, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][month]) AS t, count(*) FILTER (ok) AS n, string_agg(CASE WHEN NOT ok THEN CAST(month AS VARCHAR) END, ',' ORDER BY month) AS bad FROM {clim_sql(value, source)} GROUP BY site_id))"


@query("a13_valid_months", f"SELECT site_id, CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month, round(mean, 8) AS mean, round(total, 4) AS total, longest, missing, valid FROM {months_sql('value', 'gappy')}")
def a13(spark, d):
    return rounded(rounded(C.valid_months(gappy(spark, d)), "mean", digits=8), "total", digits=4)


@query("a14_climatology", f"SELECT site_id, CAST(month AS INTEGER) AS month, round(clim, 6) AS clim, round(share, 6) AS share, ok FROM {clim_sql('value')}")
def a14(spark, d):
    return rounded(C.climatology(C.valid_months(daily(spark, d))), "clim", "share")


@query("a15_annual_total", f"SELECT site_id, round(annual, 4) AS annual, round(mean, 6) AS mean, reason FROM {annual_sql('value')}")
def a15(spark, d):
    return rounded(rounded(C.annual_total(C.climatology(C.valid_months(daily(spark, d)))), "annual", digits=4), "mean")


@query("a16_water_balance", f"SELECT p.site_id, round(p.annual, 4) AS annual_prcp, round(e.annual, 4) AS annual_pet, round(w.annual, 4) AS wet_days, round(s.f, 6) AS snow_fraction, round(CASE WHEN p.annual > 0 THEN e.annual / p.annual END, 6) AS aridity, round(w.annual / 365.25, 6) AS wet_day_frequency FROM {annual_sql('value / 100')} p JOIN {annual_sql('CASE WHEN value > 1200 THEN NULL ELSE greatest(prcp * 8 - 3, 0) END')} e USING (site_id) JOIN {annual_sql('CAST(value / 100 > 1 AS INTEGER)')} w USING (site_id) LEFT JOIN (SELECT site_id, sum(CASE WHEN tavg <= 0 THEN prcp ELSE 0 END) / sum(prcp) AS f FROM {FORCING} GROUP BY 1) s USING (site_id)")
def a16(spark, d):
    out = C.water_balance(forcing(spark, d))
    return rounded(rounded(out, "annual_prcp", "annual_pet", "wet_days", digits=4), "snow_fraction", "aridity", "wet_day_frequency")


@query("a17_completeness", f"SELECT site_id, variable, finite_days, missing_days, finite_days > 0 AS served, max(missing_days) OVER (PARTITION BY site_id) = 0 AS forcing_complete FROM (SELECT site_id, 'prcp' AS variable, count(prcp) AS finite_days, count(*) - count(prcp) AS missing_days FROM {FORCING} GROUP BY 1 UNION ALL SELECT site_id, 'pet', count(pet), count(*) - count(pet) FROM {FORCING} GROUP BY 1 UNION ALL SELECT site_id, 'srad', 0, count(*) FROM {FORCING} GROUP BY 1)")
def a17(spark, d):
    return C.completeness(forcing(spark, d), ["prcp", "pet", "srad"])


PARTS = "(SELECT CAST(l_suppkey % 9 AS VARCHAR) AS site_id, l_linenumber AS chunk_no, CASE WHEN count(*) % 13 <> 0 THEN CAST(count(*) % 5 AS INTEGER) END AS head, CASE WHEN count(*) % 7 <> 0 THEN CAST(count(*) % 3 AS INTEGER) END AS tail, CASE WHEN count(*) % 17 <> 0 THEN CAST(count(*) % 2 AS INTEGER) END AS internal, CASE WHEN count(*) % 11 = 0 THEN NULL ELSE count(*) % 7 <> 0 END AS complete, min(l_shipdate) AS s FROM lineitem GROUP BY ALL)"


@query("a18_coverage", f"SELECT site_id, any_value(head) FILTER (chunk_no = f) AS head, any_value(tail) FILTER (chunk_no = l) AS tail, CASE WHEN count(internal) = count(*) THEN CAST(sum(internal) + coalesce(sum(head) FILTER (chunk_no > f), 0) + coalesce(sum(tail) FILTER (chunk_no < l), 0) AS BIGINT) END AS internal, bool_and(complete) AS complete, string_agg(strftime(s, '%Y-%m-%d'), ',' ORDER BY chunk_no) AS ranges FROM (SELECT *, min(chunk_no) OVER (PARTITION BY site_id) AS f, max(chunk_no) OVER (PARTITION BY site_id) AS l FROM {PARTS}) GROUP BY site_id")
def a18(spark, d):
    n = F.count(F.lit(1))
    parts = read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 9).cast("string").alias("site_id"), F.col("l_linenumber").alias("chunk_no")).agg(F.when(n % 13 != 0, (n % 5).cast("int")).alias("head"), F.when(n % 7 != 0, (n % 3).cast("int")).alias("tail"), F.when(n % 17 != 0, (n % 2).cast("int")).alias("internal"), F.when(n % 11 != 0, n % 7 != 0).alias("complete"), F.array(F.date_format(F.min("l_shipdate"), "yyyy-MM-dd")).alias("ranges"))
    return C.merge_coverage(parts).withColumn("ranges", F.array_join("ranges", ","))


@query("a19_erosivity", "SELECT site_id, round(f, 6) AS fournier, round(CASE WHEN f <= 55 THEN 0.07397 * power(f, 1.847) ELSE 95.77 - 6.081 * f + 0.4770 * f * f END, 4) AS r_factor FROM (SELECT site_id, sum(p * p) / sum(p) AS f FROM (SELECT site_id, m, avg(p) AS p FROM (SELECT site_id, year(date) AS y, month(date) AS m, sum(coalesce(prcp, 0)) AS p FROM daily GROUP BY ALL) GROUP BY ALL) GROUP BY site_id HAVING count(*) = 12)")
def a19(spark, d):
    p = daily(spark, d).select("site_id", "date", F.col("prcp").alias("value"))
    return rounded(rounded(C.erosivity(p), "fournier"), "r_factor", digits=4)


@query("a20_monthly_means", "SELECT site_id, strftime(date, '%Y-%m') AS period, round(avg(value), 8) AS value FROM gappy WHERE value IS NOT NULL GROUP BY ALL")
def a20(spark, d):
    return rounded(C.aggregate_time(gappy(spark, d), "monthly"), "value", digits=8)


@query("a20_yearly_means", "SELECT site_id, strftime(date, '%Y') AS period, round(avg(value), 8) AS value FROM gappy WHERE value IS NOT NULL GROUP BY ALL")
def a20y(spark, d):
    return rounded(C.aggregate_time(gappy(spark, d), "yearly"), "value", digits=8)


@query("a23_periods", "SELECT site_id, greatest(p, lo) AS period_start, least(last_day(p), hi) AS period_end, greatest(p, lo) > p OR least(last_day(p), hi) < last_day(p) AS clipped FROM (SELECT site_id, min(date) AS lo, max(date) AS hi, CAST(unnest(generate_series(date_trunc('month', min(date)), max(date), INTERVAL 1 MONTH)) AS DATE) AS p FROM gappy GROUP BY site_id)")
def a23(spark, d):
    span = gappy(spark, d).groupBy("site_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return C.periods("lo", "hi", "monthly", span).select("site_id", "period_start", "period_end", "clipped")


YEARS = "(SELECT site_id, greatest(p, lo) AS period_start, least(make_date(CAST(year(p) AS INTEGER), 12, 31), hi) AS period_end, greatest(p, lo) > p OR make_date(CAST(year(p) AS INTEGER), 12, 31) > hi AS clipped FROM (SELECT site_id, min(date) AS lo, max(date) AS hi, CAST(unnest(generate_series(date_trunc('year', min(date)), max(date), INTERVAL 1 YEAR)) AS DATE) AS p FROM gappy GROUP BY site_id))"


@query("a23_whole_years", f"SELECT site_id, period_start, period_end, CASE WHEN clipped THEN 'dropped' ELSE 'kept' END AS state FROM {YEARS}")
def a23_years(spark, d):
    span = gappy(spark, d).groupBy("site_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    kept, dropped = C.whole_periods(C.periods("lo", "hi", "yearly", span).select("site_id", "period_start", "period_end", "clipped"))
    return kept.withColumn("state", F.lit("kept")).unionByName(dropped.withColumn("state", F.lit("dropped")))


@query("p8_forcing_units", "SELECT site_id, date, pr AS prcp_mm, round(CASE WHEN ku IS NOT NULL AND ku = 'K' OR ku IS NULL AND avg(a) OVER w > 200 THEN a - 273.15 ELSE a END, 4) AS tmin_C, round(CASE WHEN avg(b) OVER w > 200 THEN b - 273.15 ELSE b END, 4) AS tmax_C, round((CASE WHEN ku IS NOT NULL AND ku = 'K' OR ku IS NULL AND avg(a) OVER w > 200 THEN a - 273.15 ELSE a END + CASE WHEN avg(b) OVER w > 200 THEN b - 273.15 ELSE b END) / 2, 4) AS tavg_C FROM (SELECT site_id, date, value AS pr, prcp * 20 + CASE WHEN site_id = '0' THEN 260 ELSE 0 END AS a, prcp * 25 + CASE WHEN site_id = '0' THEN 260 ELSE 0 END AS b, CASE WHEN site_id = '1' THEN 'K' WHEN site_id = '2' THEN 'degC' WHEN value > 1000 AND site_id = '0' THEN 'degC' END AS ku FROM daily) WINDOW w AS (PARTITION BY site_id)")
def p8(spark, d):
    """One site in Kelvin without a recorded unit but for some days, others with one."""
    site = F.col("site_id")
    shift = F.when(site == "0", 260).otherwise(0)
    unit = F.when(site == "1", "K").when(site == "2", "degC").when((F.col("value") > 1000) & (site == "0"), "degC")
    rows = daily(spark, d).select("site_id", "date", F.col("value").alias("pr"), (F.col("prcp") * 20 + shift).alias("tmin"), (F.col("prcp") * 25 + shift).alias("tmax"), unit.alias("tmin_unit"))
    return rounded(C.forcing_units(rows, {"pr": "prcp_mm"}), "tmin_C", "tmax_C", "tavg_C", digits=4)


@query("p9_hargreaves_pet", "SELECT site_id, date, round(greatest(0.0023 * coalesce(srad * 0.0864 * 1.5, 15 + 10 * sin(2 * pi() * (dayofyear(date) - 81) / 365)) * ((lo + hi) / 2 + 17.8) * sqrt(greatest(hi - lo, 0)), 0), 6) AS pet FROM (SELECT site_id, date, prcp * 20 - 5 AS lo, prcp * 30 - 6 AS hi, CASE WHEN value > 1000 THEN value / 8 END AS srad FROM daily)")
def p9(spark, d):
    p = daily(spark, d)
    pet = S.hargreaves_pet(F.col("prcp") * 20 - 5, F.col("prcp") * 30 - 6, F.when(F.col("value") > 1000, F.col("value") / 8), F.col("date"))
    return p.select("site_id", "date", F.round(pet, 6).alias("pet"))


@query("j2_wide_forcing", "SELECT site_id, CAST(ts AS DATE) AS date, sum(value) FILTER (event_type = 'click') AS click, sum(value) FILTER (event_type = 'view') AS view FROM (SELECT site_id, CAST(ts AS DATE) AS ts, event_type, min(value) AS value FROM instants WHERE event_type IN ('click', 'view') GROUP BY ALL) GROUP BY ALL")
def j2(spark, d):
    long = instants(spark, d).where("event_type IN ('click', 'view')").groupBy("site_id", F.to_date("ts").alias("date"), F.col("event_type").alias("variable")).agg(F.min("value").alias("value"))
    return C.wide(long, ["click", "view"])


MONTHLY = "(SELECT site_id, year(date) AS year, month(date) AS month, round(sum(prcp), 4) AS total FROM daily GROUP BY ALL HAVING count(*) >= 25)"


def monthly(spark, d):
    g = daily(spark, d).groupBy("site_id", F.year("date").alias("year"), F.month("date").alias("month")).agg(F.round(F.sum("prcp"), 4).alias("total"), F.count(F.lit(1)).alias("n"))
    return g.where("n >= 25").drop("n")


@query("w10_rolling_months", f"SELECT site_id, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, round(rolled, 4) AS rolled FROM (SELECT *, sum(total) OVER w AS rolled, count(*) OVER w AS n FROM {MONTHLY} WINDOW w AS (PARTITION BY site_id ORDER BY year * 12 + month RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE n = 3")
def w10_rolling(spark, d):
    return rounded(fits.rolling_months(monthly(spark, d), 3), "rolled", digits=4)


@query("w10_excluded_months", "SELECT site_id, CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month, round(n / day(last_day(m)), 6) AS share FROM (SELECT x.site_id, x.m, count(d.prcp) AS n FROM (SELECT site_id, CAST(unnest(generate_series(date_trunc('month', min(date)), max(date), INTERVAL 1 MONTH)) AS DATE) AS m FROM daily GROUP BY site_id) x LEFT JOIN daily d ON d.site_id = x.site_id AND date_trunc('month', d.date) = x.m GROUP BY x.site_id, x.m) WHERE n / day(last_day(m)) < 0.9")
def w10_excluded(spark, d):
    p = daily(spark, d).select("site_id", "date", F.col("prcp").alias("value"))
    return rounded(fits.drought_from_days(p, 3, "spi", 0.9)[1], "share")


@query("w10_spi")
def w10_spi(spark, d):
    p = daily(spark, d).select("site_id", "date", F.col("prcp").alias("value"))
    return rounded(fits.drought_from_days(p, 3, "spi", 0.9)[0], "value", "rolled")


@query("w10_spei")
def w10_spei(spark, d):
    m = monthly(spark, d).withColumn("total", F.col("total") - 2.4)
    return rounded(fits.drought_index(m, 3, "spei"), "value", "rolled")


@query("k2_drought_extremes", f"SELECT site_id, arg_max(p, no) AS latest, arg_min(p, (value, no)) AS driest, arg_max(p, (value, -no)) AS wettest FROM (SELECT site_id, round(total, 1) AS value, year * 12 + month AS no, printf('%d-%02d', year, month) AS p FROM {MONTHLY}) GROUP BY site_id")
def k2(spark, d):
    return fits.drought_extremes(rounded(monthly(spark, d).withColumnRenamed("total", "value"), "value", digits=1))


@query("w11_no_leap_calendar", "SELECT s.site_id, coalesce(bool_and(g.date IS NULL) FILTER (e.date IS NOT NULL), false) AS no_leap, count(e.date) AS leap_years FROM (SELECT site_id, min(date) AS lo, max(date) AS hi FROM gappy GROUP BY 1) s LEFT JOIN (SELECT make_date(y, 12, 31) AS date FROM (SELECT CAST(unnest(range(1990, 2010)) AS INTEGER) AS y) WHERE y % 4 = 0) e ON e.date BETWEEN lo AND hi LEFT JOIN (SELECT * FROM gappy WHERE value IS NOT NULL) g ON g.site_id = s.site_id AND g.date = e.date GROUP BY 1")
def w11(spark, d):
    return C.no_leap_calendar(gappy(spark, d))


@query("w12_baseflow")
def w12(spark, d):
    return rounded(fits.baseflow(daily(spark, d)), "baseflow")


@query("w12_baseflow_index")
def w12_bfi(spark, d):
    return rounded(fits.baseflow_index(fits.baseflow(daily(spark, d))), "bfi")


MINIMA = """WITH daily AS (SELECT CAST(l_suppkey // 33 AS VARCHAR) AS site_id, CAST(l_shipdate AS DATE) AS date, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY ALL),
rows_ AS (SELECT *, (row_number() OVER (PARTITION BY site_id ORDER BY date) - 1) // 5 AS block FROM daily WHERE value IS NOT NULL),
lows AS (SELECT site_id, block, min(value) AS m, arg_min(date, (value, date)) AS date FROM rows_ GROUP BY ALL HAVING count(*) = 5),
turning AS (SELECT site_id, date, m FROM lows QUALIFY 0.9 * m <= lag(m) OVER (PARTITION BY site_id ORDER BY block) AND 0.9 * m <= lead(m) OVER (PARTITION BY site_id ORDER BY block)),
ends AS (SELECT r.site_id, r.date, r.value, max(t.date) FILTER (t.date <= r.date) AS a, min(t.date) FILTER (t.date >= r.date) AS z FROM rows_ r JOIN turning t ON t.site_id = r.site_id GROUP BY ALL)
SELECT e.site_id, e.date, e.value, round(least(e.value, CASE WHEN a = z THEN x.m ELSE x.m + (y.m - x.m) * datediff('day', a, e.date) / datediff('day', a, z) END), 6) AS baseflow FROM ends e JOIN turning x ON x.site_id = e.site_id AND x.date = a JOIN turning y ON y.site_id = e.site_id AND y.date = z"""


@query("w13_smoothed_minima", MINIMA.replace("FROM daily", "FROM daily_").replace("WITH daily AS", "WITH daily_ AS"))
def w13(spark, d):
    return rounded(fits.smoothed_minima(daily(spark, d)), "baseflow")


@query("f2_gumbel_likelihood")
def f2(spark, d):
    return rounded(fits.flood_frequency(signatures.annual_maxima(daily(spark, d))), "level", "ci_low", "ci_high", digits=3)


@query("f2_gev")
def f2_gev(spark, d):
    return rounded(fits.flood_frequency(signatures.annual_maxima(daily(spark, d)), "gev"), "level", "ci_low", "ci_high", digits=3)


@query("f2_log_pearson")
def f2_lp3(spark, d):
    return rounded(fits.flood_frequency(signatures.annual_maxima(daily(spark, d)), "lp3"), "level", "ci_low", "ci_high", digits=3)


@query("a38_bootstrap_mean")
def a38(spark, d):
    return rounded(fits.bootstrap(gappy(spark, d)), "estimate", "low", "high", digits=4)


@query("a38_block_bootstrap")
def a38_block(spark, d):
    return rounded(fits.bootstrap(gappy(spark, d), "p90", "block"), "estimate", "low", "high", digits=4)


COMPLETE_YEARS = "(SELECT site_id, wy, sum(value) AS v, sum(prcp) AS p FROM (SELECT *, CAST(year(date + INTERVAL 3 MONTH) AS INTEGER) AS wy FROM daily WHERE value IS NOT NULL AND prcp IS NOT NULL) GROUP BY site_id, wy HAVING count(*) >= 0.95 * datediff('day', make_date(wy - 1, 10, 1), make_date(wy, 10, 1)))"


@query("a38_complete_years", f"SELECT site_id, CAST(count(wy) AS INTEGER) AS n_years, round(sum(v) / sum(p), 6) AS estimate, CASE WHEN count(wy) < 10 THEN 'under 10 complete water years' END AS withheld FROM (SELECT DISTINCT site_id FROM daily) LEFT JOIN {COMPLETE_YEARS} USING (site_id) GROUP BY site_id")
def a38_years(spark, d):
    """What the water-year bootstrap says before it draws: years, estimate, and whether the interval is withheld."""
    s = daily(spark, d).withColumnRenamed("prcp", "other")
    return rounded(fits.water_year_bootstrap(s, "ratio").select("site_id", "n_years", "estimate", "withheld"), "estimate")


@query("a38_water_year_bootstrap")
def a38_water_years(spark, d):
    return rounded(fits.water_year_bootstrap(daily(spark, d), least_years=5), "estimate", "low", "high", digits=4)


@query("a35_stationarity")
def a35(spark, d):
    return rounded(fits.stationarity(daily(spark, d)), "tau", "p", "slope")


YEARLY = "(SELECT site_id, year(date) AS t, avg(value) AS value FROM gappy GROUP BY ALL)"


@query("a36_trend_slope", f"SELECT a.site_id, any_value(n) AS n, CAST(sum(sign(b.value - a.value)) AS BIGINT) AS s, round(sum(sign(b.value - a.value)) / (any_value(n) * (any_value(n) - 1) / 2), 6) AS tau, round(median((b.value - a.value) / (b.t - a.t)), 6) AS slope FROM {YEARLY} a JOIN {YEARLY} b ON a.site_id = b.site_id AND a.t < b.t JOIN (SELECT site_id, CAST(count(*) AS INTEGER) AS n FROM {YEARLY} GROUP BY 1) c ON c.site_id = a.site_id GROUP BY a.site_id")
def a36(spark, d):
    points = gappy(spark, d).groupBy("site_id", F.year("date").alias("t")).agg(F.avg("value").alias("value"))
    return rounded(fits.mann_kendall(points).drop("p"), "tau", "slope")


@query("a36_trend_test")
def a36_test(spark, d):
    points = gappy(spark, d).groupBy("site_id", F.year("date").alias("t")).agg(F.avg("value").alias("value"))
    return rounded(fits.mann_kendall(points), "tau", "p", "slope")


@query("a37_seasonal_trend")
def a37(spark, d):
    rows = gappy(spark, d).groupBy("site_id", F.year("date").alias("year"), F.month("date").alias("month")).agg(F.avg("value").alias("value"))
    return rounded(fits.seasonal_kendall(rows), "slope", "z", "p")


@query("a31_record_length", "SELECT site_id, CASE WHEN n * 4 < 3650 THEN 'fail' WHEN n * 4 < 7300 THEN 'warning' ELSE 'pass' END AS status FROM (SELECT site_id, count(value) AS n FROM gappy GROUP BY 1)")
def a31(spark, d):
    return gappy(spark, d).groupBy("site_id").agg(F.count("value").alias("n")).select("site_id", V.record_length(F.col("n") * 4)["status"].alias("status"))


@query("a32_qualification", "SELECT o_orderkey, CASE WHEN coalesce(p, 0) + coalesce(x, 0) + coalesce(e, 0) = 0 AND coalesce(n, 0) = 0 THEN 'insufficient_data' WHEN p + x + e > 0 THEN 'warning' ELSE 'pass' END AS status, CASE WHEN p > 0 OR x > 0 THEN 'medium' WHEN e > 0 THEN 'low' END AS severity, CASE WHEN p > 0 THEN 'provisional_data' WHEN x > 0 THEN 'other_qualifiers' WHEN e > 0 THEN 'estimated_data' WHEN n IS NULL THEN 'qualification_codes_unreadable' WHEN n = 0 THEN 'qualification_codes_absent' END AS quality_flag FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_quantity > 25) AS n, count(*) FILTER (l_returnflag = 'A' AND l_tax > 0.06) AS p, count(*) FILTER (l_returnflag = 'R' AND l_tax > 0.06) AS x, count(*) FILTER (l_linestatus = 'F' AND l_discount > 0.08) AS e FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def a32(spark, d):
    high = F.col("l_tax") > 0.06
    g = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_quantity") > 25).alias("n"), F.count_if((F.col("l_returnflag") == "A") & high).alias("p"), F.count_if((F.col("l_returnflag") == "R") & high).alias("x"), F.count_if((F.col("l_linestatus") == "F") & (F.col("l_discount") > 0.08)).alias("e"))
    met = read(spark, d, "orders").join(g, "o_orderkey", "left")
    told = met.select("o_orderkey", V.qualification(F.col("n"), F.col("p"), F.col("x"), F.col("e")).alias("v"))
    return told.select("o_orderkey", "v.status", "v.severity", "v.quality_flag")


@query("a33_water_balance_verdict", "SELECT o_orderkey, CASE WHEN r < 1e-3 OR r > 3 THEN 'insufficient_data' WHEN r > 1 THEN 'warning' ELSE 'pass' END AS status, CASE WHEN r > 1 AND r <= 3 THEN CASE WHEN r < 1.1 THEN 'medium' ELSE 'high' END END AS severity FROM (SELECT o_orderkey, o_totalprice / 50000 - 0.5 AS r FROM orders)")
def a33(spark, d):
    told = read(spark, d, "orders").select("o_orderkey", V.water_balance(F.col("o_totalprice") / 50000 - 0.5).alias("v"))
    return told.select("o_orderkey", "v.status", "v.severity")


@query("a34_unit_consistency", "SELECT p_partkey, CASE WHEN p_size > 45 THEN 'insufficient_data' WHEN split_part(p_name, ' ', 1) NOT IN ('red', 'blue', 'small') THEN 'warning' WHEN split_part(p_name, ' ', 1) = 'red' THEN 'pass' ELSE 'fail' END AS status, CASE WHEN p_size > 45 THEN NULL WHEN split_part(p_name, ' ', 1) NOT IN ('red', 'blue', 'small') THEN 'low' WHEN split_part(p_name, ' ', 1) = 'red' THEN NULL ELSE 'high' END AS severity FROM part")
def a34(spark, d):
    unit = F.try_element_at(F.create_map(*map(F.lit, ("red", "mm/d", "blue", "m3/s", "small", "ft3/s"))), F.split_part("p_name", F.lit(" "), F.lit(1)))
    told = read(spark, d, "part").select("p_partkey", V.unit_consistency(unit, F.lit("mm/d"), F.col("p_size") <= 45).alias("v"))
    return told.select("p_partkey", "v.status", "v.severity")


SLOTS = "(SELECT o_custkey AS k, CAST(min(CAST(o_orderdate AS DATE)) FILTER ({0}) AS VARCHAR) AS s, CAST(max(CAST(o_orderdate AS DATE)) FILTER ({0}) AS VARCHAR) AS e FROM orders GROUP BY 1)"


@query("j12_temporal_alignment", f"SELECT CAST(a.k AS VARCHAR) AS site_id, CASE WHEN a.s IS NULL OR b.s IS NULL THEN 'warning' WHEN a.s = b.s AND a.e = b.e THEN 'pass' ELSE 'fail' END AS status FROM {SLOTS.format('true')} a JOIN {SLOTS.format('o_totalprice > 60000')} b ON b.k = a.k")
def j12(spark, d):
    def slot(keep):
        day = F.when(keep, F.to_date("o_orderdate"))
        return read(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("site_id")).agg(F.min(day).cast("string").alias("start"), F.max(day).cast("string").alias("end"))

    return V.temporal_alignment(slot(F.lit(True)), slot(F.col("o_totalprice") > 60000)).select("site_id", "status")


@query("a45_uncertainty_present", "SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') THEN 'pass' ELSE 'warning' END AS status FROM orders")
def a45(spark, d):
    intervals = read(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return V.uncertainty_present(read(spark, d, "orders").select("o_orderkey"), intervals, ["o_orderkey"])


FACTS = """(SELECT o_custkey AS site_id, CASE WHEN count(*) % 7 <> 0 THEN count(*) * 500 END AS n_days, count(*) FILTER (o_orderstatus = 'P' AND o_totalprice > 480000) AS p, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 470000) AS x, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 440000) AS e, count(*) AS coded, avg(o_totalprice) / 150000 AS ratio, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS a0, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS a1, CAST(min(CAST(o_orderdate AS DATE)) FILTER (o_totalprice > 60000) AS VARCHAR) AS b0, CAST(max(CAST(o_orderdate AS DATE)) FILTER (o_totalprice > 60000) AS VARCHAR) AS b1, any_value(c_mktsegment) AS segment, any_value(c_acctbal) AS acctbal FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)"""
PROBLEM = "CASE WHEN acctbal < -800 THEN 'series_mismatch' END"
VERDICTS = f"""SELECT CAST(site_id AS VARCHAR) AS site_id, validator, status, severity, quality_flag, round(metric, 6) AS metric FROM (
SELECT site_id, 'record_length' AS validator, CASE WHEN {PROBLEM} IS NOT NULL OR n_days IS NULL THEN 'insufficient_data' WHEN n_days < 3650 THEN 'fail' WHEN n_days < 7300 THEN 'warning' ELSE 'pass' END AS status, CASE WHEN {PROBLEM} IS NOT NULL THEN NULL WHEN n_days < 3650 THEN 'high' WHEN n_days < 7300 THEN 'medium' END AS severity, CASE WHEN {PROBLEM} IS NOT NULL THEN {PROBLEM} WHEN n_days < 3650 THEN 'record_too_short' WHEN n_days < 7300 THEN 'record_length_low' END AS quality_flag, CASE WHEN {PROBLEM} IS NULL THEN CAST(n_days AS DOUBLE) END AS metric FROM {FACTS}
UNION ALL SELECT site_id, 'usgs_qualification_codes', CASE WHEN {PROBLEM} IS NOT NULL THEN 'insufficient_data' WHEN p + x + e > 0 THEN 'warning' ELSE 'pass' END, CASE WHEN {PROBLEM} IS NOT NULL THEN NULL WHEN p + x > 0 THEN 'medium' WHEN e > 0 THEN 'low' END, CASE WHEN {PROBLEM} IS NOT NULL THEN {PROBLEM} WHEN p > 0 THEN 'provisional_data' WHEN x > 0 THEN 'other_qualifiers' WHEN e > 0 THEN 'estimated_data' END, CASE WHEN {PROBLEM} IS NULL THEN p / coded END FROM {FACTS}
UNION ALL SELECT site_id, 'regulated_basin', CASE WHEN {PROBLEM} IS NOT NULL OR segment = 'BUILDING' THEN 'insufficient_data' WHEN segment = 'MACHINERY' THEN 'warning' ELSE 'pass' END, CASE WHEN {PROBLEM} IS NULL AND segment = 'MACHINERY' THEN 'high' END, CASE WHEN {PROBLEM} IS NOT NULL THEN {PROBLEM} WHEN segment = 'BUILDING' THEN 'regulation_unknown' WHEN segment = 'MACHINERY' THEN 'regulated_basin' END, NULL FROM {FACTS}
UNION ALL SELECT site_id, 'water_balance_consistency', CASE WHEN acctbal > 9000 OR ratio < 1e-3 OR ratio > 3 THEN 'insufficient_data' WHEN ratio > 1 THEN 'warning' ELSE 'pass' END, CASE WHEN acctbal > 9000 OR ratio > 3 OR ratio <= 1 THEN NULL WHEN ratio < 1.1 THEN 'medium' ELSE 'high' END, NULL, ratio FROM {FACTS}
UNION ALL SELECT site_id, 'temporal_alignment', CASE WHEN b0 IS NULL THEN 'warning' WHEN a0 = b0 AND a1 = b1 THEN 'pass' ELSE 'fail' END, CASE WHEN b0 IS NULL THEN 'low' WHEN a0 = b0 AND a1 = b1 THEN NULL ELSE 'medium' END, NULL, NULL FROM {FACTS}
UNION ALL SELECT site_id, 'unit_consistency', CASE segment WHEN 'FURNITURE' THEN 'warning' WHEN 'AUTOMOBILE' THEN 'fail' ELSE 'pass' END, CASE segment WHEN 'FURNITURE' THEN 'low' WHEN 'AUTOMOBILE' THEN 'high' END, NULL, NULL FROM {FACTS}
UNION ALL SELECT site_id, 'uncertainty_present', 'insufficient_data', NULL, 'input_absent', NULL FROM {FACTS}
UNION ALL SELECT site_id, 'credit', CASE WHEN acctbal < 0 THEN 'fail' ELSE 'pass' END, CASE WHEN acctbal < 0 THEN 'low' END, CASE WHEN acctbal < 0 THEN 'in_debt' END, acctbal FROM {FACTS})"""


def facts(spark, d):
    """A site a customer: counts, dates and units from its orders, what it says of regulation and units from its segment."""
    day, price, segment = F.to_date("o_orderdate"), F.col("o_totalprice"), F.col("c_mktsegment")
    met = read(spark, d, "orders").join(read(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    n, high = F.count(F.lit(1)), F.when(price > 60000, day)
    g = met.groupBy(F.col("o_custkey").cast("string").alias("site_id")).agg(
        F.when(n % 7 != 0, n * 500).alias("n_days"), n.alias("n_codes"), n.alias("n_coded"),
        F.count_if((F.col("o_orderstatus") == "P") & (price > 480000)).alias("n_provisional"), F.count_if((F.col("o_orderstatus") == "F") & (price > 470000)).alias("n_other"), F.count_if((F.col("o_orderstatus") == "O") & (price > 440000)).alias("n_estimated"),
        (F.avg(price) / 150000).alias("runoff_ratio"), F.min(day).cast("string").alias("a_start"), F.max(day).cast("string").alias("a_end"), F.min(high).cast("string").alias("b_start"), F.max(high).cast("string").alias("b_end"),
        F.any_value(segment).alias("c_mktsegment"), F.any_value("c_acctbal").alias("c_acctbal"),
    )
    return g.select(
        "*", F.when(segment != "BUILDING", segment == "MACHINERY").alias("regulated"), (F.col("c_acctbal") <= 9000).alias("precipitation_usable"),
        F.when(segment == "AUTOMOBILE", "ft3/s").when(segment != "FURNITURE", "m3/s").alias("unit"), F.lit("m3/s").alias("expected_unit"), F.when(F.col("c_acctbal") < -800, "series_mismatch").alias("series_problem"),
    )


@query("a31_validator_table", VERDICTS)
def validator_table(spark, d):
    """Seven built-in validators, one of which lacks its input, and one of the caller's."""
    credit = lambda: V.first_of((F.col("c_acctbal") < 0, "fail", "low", "in_debt"), metric=F.col("c_acctbal"))
    only = ["record_length", "usgs_qualification_codes", "regulated_basin", "water_balance_consistency", "temporal_alignment", "unit_consistency", "uncertainty_present"]
    return V.validator_table(facts(spark, d), only=only, own={"credit": credit}).withColumn("metric", F.round("metric", 6))
