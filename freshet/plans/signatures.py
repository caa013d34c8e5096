"""Queries over signatures and extremes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ledger as L
from ..operators import signatures as O
from .registry import daily, gappy, query, read
from .series import rounded

WY = "SELECT site_id, year(date + INTERVAL 3 MONTH) AS wy, count(*) AS n_days, sum(value) AS total_value, sum(prcp) AS total_prcp, max(value) AS max_value, max(prcp) AS max_prcp FROM daily GROUP BY ALL"
EXPECT = "datediff('day', make_date(CAST(wy - 1 AS INTEGER), 10, 1), make_date(CAST(wy AS INTEGER), 10, 1))"
FULL = f"SELECT * FROM (SELECT *, {EXPECT} AS expected FROM ({WY})) WHERE n_days >= 0.95 * expected"


@query("a7_flow_statistics", "SELECT site_id, count(value) AS n, round(avg(value), 6) AS q_mean, round(stddev_samp(value), 6) AS q_std, round(quantile_cont(value, 0.05), 6) AS q5, round(median(value), 6) AS q_median, round(quantile_cont(value, 0.95), 6) AS q95 FROM daily GROUP BY site_id")
def a7(spark, d):
    return rounded(O.flow_statistics(daily(spark, d)), "q_mean", "q_std", "q5", "q_median", "q95")


@query("a8_runoff_ratio", f"SELECT site_id, count(*) AS n_years, round(any_value(qm / pm), 6) AS runoff_ratio, round(median((total_value - qm) * pm / ((total_prcp - pm) * qm)), 4) AS elasticity FROM (SELECT *, avg(total_value) OVER (PARTITION BY site_id) AS qm, avg(total_prcp) OVER (PARTITION BY site_id) AS pm FROM ({FULL})) GROUP BY site_id")
def a8(spark, d):
    return rounded(rounded(O.runoff_ratio(daily(spark, d)), "runoff_ratio"), "elasticity", digits=4)


RUNS = "SELECT site_id, {n} AS hit, count(*) AS length FROM (SELECT *, date - CAST(row_number() OVER (PARTITION BY site_id ORDER BY date) AS INTEGER) AS island FROM (SELECT g.* FROM gappy g JOIN m USING (site_id) WHERE {cond})) GROUP BY site_id, island"


EVENT_COLUMNS = ("high_q_freq", "high_q_dur", "low_q_freq", "low_q_dur", "zero_q_fraction", "flow_variability")


def events_sql(high: float, low: float) -> str:
    return ("SELECT m.site_id, round(coalesce(h.d, 0) / n * 365.25, 6) AS high_q_freq, round(coalesce(h.l, 0), 6) AS high_q_dur, round(coalesce(w.d, 0) / n * 365.25, 6) AS low_q_freq, round(coalesce(w.l, 0), 6) AS low_q_dur, round(z / n, 6) AS zero_q_fraction, round(sd / mean, 6) AS flow_variability FROM m LEFT JOIN (SELECT site_id, sum(length) AS d, avg(length) AS l FROM (" + RUNS.format(n=1, cond=f"value > {high} * med") + ") GROUP BY 1) h USING (site_id) LEFT JOIN (SELECT site_id, sum(length) AS d, avg(length) AS l FROM (" + RUNS.format(n=0, cond=f"value < {low} * mean") + ") GROUP BY 1) w USING (site_id)")


@query("a9_flow_events", events_sql(9.0, 0.2))
def a9(spark, d):
    return rounded(O.flow_events(gappy(spark, d)), *EVENT_COLUMNS)


@query("a9_flow_events_near", events_sql(2.0, 0.5))
def a9_near(spark, d):
    return rounded(O.flow_events(gappy(spark, d), high=2.0, low=0.5), *EVENT_COLUMNS)


@query("a10_a11_slope_fdc", "SELECT site_id, round((quantile_cont(value, 0.66) - quantile_cont(value, 0.33)) / (avg(value) * 0.33), 6) AS slope_fdc, round((ln(quantile_cont(value, 0.67) FILTER (value > 0)) - ln(quantile_cont(value, 0.34) FILTER (value > 0))) / 0.33, 6) AS slope_fdc_log FROM gappy GROUP BY site_id")
def a10(spark, d):
    return rounded(O.slope_fdc(gappy(spark, d)), "slope_fdc", "slope_fdc_log")


@query("a12_exceedance_flows", "SELECT site_id, round(quantile_cont(value, 0.95), 6) AS Q05, round(quantile_cont(value, 0.9), 6) AS Q10, round(quantile_cont(value, 0.5), 6) AS Q50, round(quantile_cont(value, 0.1), 6) AS Q90, round(quantile_cont(value, 0.05), 6) AS Q95 FROM gappy GROUP BY site_id")
def a12(spark, d):
    return rounded(O.exceedance_flows(gappy(spark, d)), "Q05", "Q10", "Q50", "Q90", "Q95")


@query("w5_duration_curve", "SELECT site_id, date, value, round(row_number() OVER (PARTITION BY site_id ORDER BY value DESC, date) / (count(*) OVER (PARTITION BY site_id) + 1), 9) AS exceedance FROM gappy WHERE value IS NOT NULL")
def w5(spark, d):
    return rounded(O.duration_curve(gappy(spark, d)), "exceedance", digits=9)


MAXIMA = f"SELECT site_id, CAST(wy AS INTEGER) AS year, max_value AS annual_max, n_days, CAST({EXPECT} AS INTEGER) AS expected_days, n_days >= 0.95 * {EXPECT} AS complete FROM ({WY})"


@query("w7_annual_maxima", MAXIMA)
def w7(spark, d):
    return O.annual_maxima(daily(spark, d))


@query("w7_custom_year_maxima", "SELECT *, n_days >= 0.95 * expected_days AS complete FROM (SELECT site_id, CAST(year(date - INTERVAL 5 MONTH) AS INTEGER) AS year, max(value) AS annual_max, count(*) AS n_days, CAST(datediff('day', make_date(CAST(year(date - INTERVAL 5 MONTH) AS INTEGER), 6, 1), make_date(CAST(year(date - INTERVAL 5 MONTH) AS INTEGER) + 1, 6, 1)) AS INTEGER) AS expected_days FROM daily GROUP BY site_id, year(date - INTERVAL 5 MONTH))")
def w7_custom(spark, d):
    return O.annual_maxima(daily(spark, d), first_month=6)


@query("w14_plotting_positions", f"SELECT site_id, year, annual_max, round(p, 9) AS exceedance, round(1 / p, 6) AS return_period FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY annual_max DESC, year) / (count(*) OVER (PARTITION BY site_id) + 1) AS p FROM ({MAXIMA}) WHERE complete)")
def w14(spark, d):
    return rounded(rounded(O.plotting_positions(O.annual_maxima(daily(spark, d))), "exceedance", digits=9), "return_period")


GUMBEL = "SELECT site_id, n_years, t AS return_period, m - 0.5772156649015329 * b - b * ln(-ln(1 - 1.0 / t)) AS level, 1.0 / t AS exceedance FROM (SELECT site_id, count(*) AS n_years, avg({v}) AS m, stddev_samp({v}) * sqrt(6) / pi() AS b FROM ({full}) GROUP BY site_id HAVING count(*) >= 5) CROSS JOIN (SELECT CAST(unnest([{t}]) AS INTEGER) AS t)"


@query("f1_gumbel_moments", "SELECT site_id, n_years, return_period, round(level, 6) AS level, round(exceedance, 9) AS exceedance FROM (" + GUMBEL.format(v="max_value", full=FULL, t="2, 5, 10, 25, 50, 100, 200, 500") + ")")
def f1(spark, d):
    return rounded(rounded(O.gumbel_moments(O.annual_maxima(daily(spark, d))), "level"), "exceedance", digits=9)


@query("f3_design_rainfall", "SELECT site_id, return_period, round(level, 6) AS rain_mm FROM (" + GUMBEL.format(v="max_prcp", full=FULL, t="50") + ")")
def f3(spark, d):
    p = daily(spark, d).select("site_id", "date", F.col("prcp").alias("value"))
    return rounded(O.design_rainfall(p, 50), "rain_mm")


@query("j13_design_discharge", "SELECT x.site_id, x.t AS return_period, round(CASE WHEN x.t = 5 AND x.site_id = '0' THEN 1234.5 ELSE coalesce(level, CASE WHEN x.site_id <> '1' THEN 99.0 END, mx) END, 4) AS discharge, CASE WHEN x.t = 5 AND x.site_id = '0' THEN 'explicit' WHEN level IS NOT NULL THEN 'return_level' WHEN x.site_id <> '1' THEN 'design_peak' ELSE 'series_max' END AS origin FROM (SELECT site_id, max(value) AS mx, CAST(unnest([5, 77, 100]) AS INTEGER) AS t FROM daily GROUP BY site_id) x LEFT JOIN (" + GUMBEL.format(v="max_value", full=FULL, t="5, 100") + ") g ON g.site_id = x.site_id AND g.return_period = x.t")
def j13(spark, d):
    s = daily(spark, d)
    drivers = s.groupBy("site_id").agg(F.max("value").alias("series_max")).withColumn("return_period", F.explode(F.array(F.lit(5), F.lit(77), F.lit(100))))
    drivers = drivers.withColumn("explicit", F.when((F.col("return_period") == 5) & (F.col("site_id") == "0"), 1234.5)).withColumn("peak", F.when(F.col("site_id") != "1", 99.0).otherwise(-1.0))
    return rounded(O.pick_discharge(O.gumbel_moments(O.annual_maxima(s), (5, 100)), drivers), "discharge", digits=4)


@query("w8_seven_day_low", "SELECT site_id, count(*) AS n_years, round(min(m), 6) AS least, CASE WHEN count(*) >= 10 THEN round(quantile_cont(m, 0.1), 6) END AS q7_10, CASE WHEN count(*) < 10 THEN 'fewer than 10 years' END AS note FROM (SELECT site_id, year(date - INTERVAL 3 MONTH) AS y, min(m7) AS m FROM (SELECT *, avg(value) OVER w AS m7, count(*) OVER w AS n7 FROM (SELECT * FROM gappy WHERE value IS NOT NULL) WINDOW w AS (PARTITION BY site_id ORDER BY date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)) WHERE n7 = 7 GROUP BY ALL) GROUP BY site_id")
def w8(spark, d):
    return rounded(O.seven_day_low(gappy(spark, d)), "least", "q7_10")


@query("w9_half_flow_date", f"SELECT site_id, round(avg(day), 6) AS hfd_mean, round(stddev_samp(day), 6) AS hfd_std, count(*) AS n_years FROM (SELECT d.site_id, d.wy, datediff('day', make_date(CAST(d.wy - 1 AS INTEGER), 10, 1), min(d.date)) + 1 AS day FROM (SELECT *, year(date + INTERVAL 3 MONTH) AS wy, sum(value) OVER (PARTITION BY site_id, year(date + INTERVAL 3 MONTH) ORDER BY date) AS run FROM daily) d JOIN ({FULL}) f ON d.site_id = f.site_id AND d.wy = f.wy WHERE run >= f.total_value / 2 GROUP BY d.site_id, d.wy) GROUP BY site_id")
def w9(spark, d):
    return rounded(O.half_flow_date(daily(spark, d)), "hfd_mean", "hfd_std")


@query("f4_scs_runoff", "SELECT p_partkey, CASE WHEN cn > 0 AND cn <= 100 THEN round(CASE WHEN p > 0.2 * s THEN power(p - 0.2 * s, 2) / (p + 0.8 * s) ELSE 0 END, 6) END AS runoff_mm FROM (SELECT p_partkey, p_retailprice / 10 AS p, CAST(p_size * 2.5 AS DOUBLE) AS cn, 25400 / (p_size * 2.5) - 254 AS s FROM part)")
def f4(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(S.scs_runoff(F.col("p_retailprice") / 10, F.col("p_size") * 2.5), 6).alias("runoff_mm"))


@query("f5_unit_hydrograph", "SELECT p_partkey, round(tc, 6) AS tc_h, round(0.133 * tc / 2 + 0.6 * tc, 6) AS tp_h, round(0.208 * p_size * 2 / (0.133 * tc / 2 + 0.6 * tc), 6) AS qp, round(2.67 * (0.133 * tc / 2 + 0.6 * tc), 6) AS tb_h FROM (SELECT *, 0.0663 * power(p_retailprice / 1000, 0.77) * power(0.001 * p_size, -0.385) AS tc FROM part)")
def f5(spark, d):
    p = read(spark, d, "part").withColumn("tc", S.kirpich_hours(F.col("p_retailprice"), 0.001 * F.col("p_size")))
    h = S.triangular_hydrograph(F.col("p_size").cast("double"), F.col("tc"), F.lit(2.0))
    return p.select("p_partkey", F.round("tc", 6).alias("tc_h"), F.round(h["time_to_peak_hr"], 6).alias("tp_h"), F.round(h["peak_cms"], 6).alias("qp"), F.round(h["base_time_hr"], 6).alias("tb_h"))


@query("f5_hydrograph_ordinates", "SELECT event_id, CAST(i AS INTEGER) AS i, round(t, 6) AS time_hr, round(qp * CASE WHEN t <= tp THEN t / tp ELSE (2.67 * tp - t) / (1.67 * tp) END, 6) AS discharge FROM (SELECT *, least(i * 0.25, 2.67 * tp) AS t FROM (SELECT *, unnest(range(CAST(ceil(2.67 * tp / 0.25) AS BIGINT) + 1)) AS i FROM (SELECT *, 0.208 * p_size * 2 / tp AS qp FROM (SELECT p_partkey AS event_id, p_size, 0.133 * tc / 2 + 0.6 * tc AS tp FROM (SELECT *, 0.0663 * power(p_retailprice / 1000, 0.77) * power(0.001 * p_size, -0.385) AS tc FROM part)))))")
def f5_ordinates(spark, d):
    p = read(spark, d, "part").withColumn("tc", S.kirpich_hours(F.col("p_retailprice"), 0.001 * F.col("p_size")))
    events = p.select(F.col("p_partkey").alias("event_id"), *[c.alias(k) for k, c in S.triangular_hydrograph(F.col("p_size").cast("double"), F.col("tc"), F.lit(2.0)).items()])
    return rounded(L.hydrograph_ordinates(events), "time_hr", "discharge")


@query("f6_cover_factor", "SELECT p_partkey, CASE WHEN p_name LIKE '%water%' THEN 0.0 WHEN p_name LIKE '%red%' THEN 0.5 WHEN p_name LIKE '%ring%' THEN 0.25 ELSE 0.1 END AS c FROM part")
def f6_cover(spark, d):
    return read(spark, d, "part").select("p_partkey", S.cover_factor(F.col("p_name"), {"water": 0.0, "red": 0.5, "ring": 0.25}).alias("c"))


@query("f6_soil_loss", """SELECT p_partkey, round(a, 6) AS soil_loss, CASE WHEN a < 2 THEN 'low' WHEN a < 10 THEN 'moderate' WHEN a < 50 THEN 'high' ELSE 'severe' END AS severity FROM (SELECT p_partkey, p_retailprice * k * ls * 0.1 AS a FROM (SELECT *, 0.1317 * (0.2 + 0.3 * exp(-0.0256 * sand * (1 - 0.3))) * power(30.0 / (70 - sand + 30), 0.3) * (1 - 0.25 * 1.5 / (1.5 + exp(3.72 - 2.95 * 1.5))) * (1 - 0.7 * (1 - sand / 100) / ((1 - sand / 100) + exp(-5.51 + 22.9 * (1 - sand / 100)))) AS k, power(80 / 22.13, CASE WHEN sl >= 5 THEN 0.5 WHEN sl >= 3.5 THEN 0.4 WHEN sl >= 1 THEN 0.3 ELSE 0.2 END) * (65.41 * power(sin(atan(sl / 100)), 2) + 4.56 * sin(atan(sl / 100)) + 0.065) AS ls FROM (SELECT *, CAST(10 + p_size AS DOUBLE) AS sand, p_size / 4.0 AS sl FROM part)))""")
def f6(spark, d):
    p = read(spark, d, "part").withColumn("sand", (10 + F.col("p_size")).cast("double")).withColumn("sl", F.col("p_size") / 4.0)
    a = F.col("p_retailprice") * S.soil_erodibility(F.col("sand"), F.lit(30.0), 70 - F.col("sand"), F.lit(1.5)) * S.slope_length_factor(F.lit(80.0), F.col("sl")) * 0.1
    return p.select("p_partkey", F.round(a, 6).alias("soil_loss"), S.erosion_severity(a).alias("severity"))
