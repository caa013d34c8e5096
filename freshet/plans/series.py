"""Queries over daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import series as O
from .registry import daily, gappy, instants, query, read

HITS = "SELECT *, date - CAST(row_number() OVER (PARTITION BY site_id ORDER BY date) AS INTEGER) AS island FROM gappy WHERE value > 100"
RUNS = f"SELECT site_id, min(date) AS \"start\", max(date) AS \"end\", count(*) AS length, CAST(max(date) - min(date) + 1 AS INTEGER) AS calendar_days FROM ({HITS}) GROUP BY site_id, island"
BEST = "SELECT site_id, count(*) AS n_runs, CAST(sum(length) AS BIGINT) AS n_passing, arg_max(\"start\", length * 100000 - datediff('day', DATE '1970-01-01', \"start\")) AS longest_start, arg_max(\"end\", length * 100000 - datediff('day', DATE '1970-01-01', \"start\")) AS longest_end, max(length) AS longest FROM r GROUP BY site_id"
SUMMARY = "SELECT site_id, count(*) AS n, count(value) AS n_finite, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95, min(date) AS first_date, max(date) AS last_date FROM gappy GROUP BY site_id"
CALENDAR = "SELECT site_id, CAST(max(date) - min(date) + 1 AS INTEGER) AS expected, count(DISTINCT date) AS present, CAST(max(date) - min(date) + 1 AS INTEGER) - count(DISTINCT date) AS missing FROM gappy GROUP BY site_id"
SPAN = "(SELECT site_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM gappy GROUP BY site_id)"
MISSING = f"SELECT s.site_id, s.date FROM {SPAN} s ANTI JOIN (SELECT * FROM gappy WHERE value IS NOT NULL) g ON s.site_id = g.site_id AND s.date = g.date"
ABSENT = f"SELECT s.site_id, s.date FROM {SPAN} s ANTI JOIN gappy g ON s.site_id = g.site_id AND s.date = g.date"


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("site_profile", f"SELECT s.*, c.expected, c.present, c.missing, b.n_runs, b.n_passing, b.longest_start, b.longest_end, b.longest FROM ({SUMMARY}) s JOIN ({CALENDAR}) c USING (site_id) LEFT JOIN ({BEST.replace('FROM r', f'FROM ({RUNS})')}) b USING (site_id)")
def site_profile(spark, d):
    s = gappy(spark, d)
    out = rounded(O.summarise(s), "mean", "q05", "q50", "q95").join(O.calendar_block(s), "site_id")
    return out.join(O.longest_run(O.threshold_runs(s, 100)), "site_id", "left")


@query("p1_rejects", "SELECT o_orderpriority AS site_id, CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def p1_rejects(spark, d):
    raw = read(spark, d, "orders").select(F.col("o_orderpriority").alias("site_id"), F.col("o_orderdate").cast("string").alias("date"), F.col("o_totalprice").cast("string").alias("value"))
    return O.make_series(raw)[1]


@query("p1_series", "SELECT CAST(o_custkey % 1000 AS VARCHAR) AS site_id, CAST(any_value(o_orderdate) AS DATE) AS date, CASE WHEN any_value(o_orderkey) % 7 <> 0 THEN any_value(o_totalprice) END AS value FROM orders GROUP BY o_custkey % 1000, CAST(o_orderdate AS DATE) HAVING count(*) = 1")
def p1_series(spark, d):
    value = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice").cast("string")).when(F.col("o_orderkey") % 2 == 0, "NaN").otherwise("n/a")
    raw = read(spark, d, "orders").select((F.col("o_custkey") % 1000).cast("string").alias("site_id"), F.col("o_orderdate").cast("string").alias("date"), value.alias("value"))
    return O.make_series(raw)[0]


@query("p2_window", "SELECT site_id, date, value FROM gappy WHERE date BETWEEN DATE '1996-10-01' AND DATE '1997-09-30'")
def p2_window(spark, d):
    return O.window(gappy(spark, d), "1996-10-01", "1997-09-30")


@query("p3_exclusive_end", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate + INTERVAL 90 MINUTE END AS end_ts FROM orders")
def p3_exclusive_end(spark, d):
    end = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).otherwise(F.col("o_orderdate") + F.expr("INTERVAL 90 MINUTE"))
    return read(spark, d, "orders").select("o_orderkey", S.exclusive_end(end).alias("end_ts"))


@query("p4_null_report", "SELECT site_id, count(*) FILTER (value IS NULL) AS n_null, array_to_string((list(CAST(date AS VARCHAR) ORDER BY date) FILTER (value IS NULL))[1:20], ',') AS null_dates FROM gappy GROUP BY site_id")
def p4_null_report(spark, d):
    return O.drop_null(gappy(spark, d))[1].withColumn("null_dates", F.array_join("null_dates", ","))


AREA = "CASE site_id WHEN '0' THEN 120.5 WHEN '1' THEN 88.0 ELSE 0.0 END"


@query("p5_depth", f"SELECT site_id, date, CASE WHEN {AREA} > 0 THEN round(value * 86.4 / {AREA}, 6) END AS mm FROM daily")
def p5_depth(spark, d):
    area = spark.createDataFrame([("0", 120.5), ("1", 88.0)], "site_id string, area double")
    return daily(spark, d).join(F.broadcast(area), "site_id", "left").select("site_id", "date", F.round(S.to_mm_per_day(F.col("value"), F.coalesce("area", F.lit(0.0))), 6).alias("mm"))


SPELLINGS = ("cfs", " M^3/S", "m³/s", "CUMECS", "mm d^-1", "°C", "deg F", "Kelvin", "in/day", "furlong", "km²")
SPELL_SQL = "CASE id % 11 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SPELLINGS)) + " END"
KEY_SQL = "CASE id % 11 WHEN 0 THEN 'ft3/s' WHEN 1 THEN 'm3/s' WHEN 2 THEN 'm3/s' WHEN 3 THEN 'm3/s' WHEN 4 THEN 'mm/d' WHEN 5 THEN 'c' WHEN 6 THEN 'f' WHEN 7 THEN 'k' WHEN 8 THEN 'in/d' WHEN 9 THEN 'furlong' ELSE 'km2' END"


def spelled(spark, d):
    table = F.array(*map(F.lit, SPELLINGS))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.get(table, (F.col("p_partkey") % 11).cast("int")).alias("unit"), F.col("p_retailprice").alias("price"))


@query("p6_unit_key", f"SELECT p_partkey AS id, {SPELL_SQL.replace('id', 'p_partkey')} AS unit, {KEY_SQL.replace('id', 'p_partkey')} AS key FROM part")
def p6_unit_key(spark, d):
    return spelled(spark, d).select("id", "unit", S.unit_key(F.col("unit")).alias("key"))


@query("p7_convert", """SELECT p_partkey AS id, round(CASE p_partkey % 11 WHEN 0 THEN p_retailprice * 0.028316846592 WHEN 1 THEN p_retailprice WHEN 2 THEN p_retailprice WHEN 3 THEN p_retailprice END, 6) AS cms,
  round(CASE p_partkey % 11 WHEN 5 THEN p_retailprice WHEN 6 THEN (p_retailprice - 32) * 5 / 9 WHEN 7 THEN p_retailprice - 273.15 END, 6) AS celsius FROM part""")
def p7_convert(spark, d):
    s = spelled(spark, d)
    return s.select("id", F.round(S.convert(F.col("price"), F.col("unit"), F.lit("m3/s")), 6).alias("cms"), F.round(S.convert(F.col("price"), F.col("unit"), F.lit("degC")), 6).alias("celsius"))


@query("p10_gauge_key", "SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' AND length(k) BETWEEN 8 AND 15 THEN k END AS gauge, CASE WHEN c_custkey * 997 >= 1000000 THEN lpad(CAST(c_custkey * 997 AS VARCHAR), CAST(greatest(8, length(CAST(c_custkey * 997 AS VARCHAR))) AS INTEGER), '0') END AS of_number, CASE WHEN length(CAST(c_custkey * 1009 AS VARCHAR)) IN (7, 8) THEN lpad(CAST(c_custkey * 1009 AS VARCHAR), 8, '0') END AS of_table FROM (SELECT *, CAST(c_custkey * (CASE WHEN c_nationkey < 12 THEN 1000003 ELSE 99 END) AS VARCHAR) || CASE WHEN c_acctbal > 9000 THEN '00000000000' ELSE '' END AS k FROM customer)")
def p10_gauge_key(spark, d):
    k = F.concat((F.col("c_custkey") * F.when(F.col("c_nationkey") < 12, 1000003).otherwise(99)).cast("string"), F.when(F.col("c_acctbal") > 9000, "00000000000").otherwise(""))
    raw = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("XYZ-"), k)).when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("USGS-"), k)).otherwise(F.concat(F.lit(" "), k))
    return read(spark, d, "customer").select("c_custkey", S.gauge_key(raw).alias("gauge"), S.gauge_of_number(F.col("c_custkey") * 997).alias("of_number"), S.attribute_gauge(F.col("c_custkey") * 1009).alias("of_table"))


@query("p11_code_tokens", "SELECT o_orderkey, array_to_string(list_filter(string_split_regex(replace(c, ',', ' '), '\\s+'), lambda x: x <> ''), '|') AS tokens, array_to_string(list_filter(string_split_regex(replace(c, ',', ' '), '\\s+'), lambda x: x IN ('A', 'P')), '|') AS approvals FROM (SELECT o_orderkey, o_orderstatus || ', ' || (CASE WHEN o_orderkey % 2 = 0 THEN 'A  e' ELSE ',A' END) AS c FROM orders)")
def p11_code_tokens(spark, d):
    c = F.concat(F.col("o_orderstatus"), F.lit(", "), F.when(F.col("o_orderkey") % 2 == 0, "A  e").otherwise(",A"))
    return read(spark, d, "orders").select("o_orderkey", F.array_join(S.code_tokens(c), "|").alias("tokens"), F.array_join(S.approval_tokens(c), "|").alias("approvals"))


@query("p12_information_class", "SELECT p_partkey, CASE WHEN p_size > 40 OR p_brand LIKE 'Brand#1%' THEN 'observation' WHEN p_brand LIKE 'Brand#2%' OR p_brand LIKE 'Brand#3%' OR p_brand LIKE 'Brand#4%' THEN 'model_simulation' ELSE 'unclassified' END AS class FROM part")
def p12_information_class(spark, d):
    """Products and sources by brand, a resolved site by size."""
    names = {"Brand#1": ("NWIS_STREAMFLOW", None), "Brand#2": ("reanalysis", "cds_glofas"), "Brand#3": (None, "geoglows_retro"), "Brand#4": ("forecast", "openmeteo_flood"), "Brand#5": ("daily gauge", "nwis model")}
    pick = lambda i: F.try_element_at(F.create_map(*[x for m, v in names.items() for x in (F.lit(m), F.lit(v[i]).cast("string"))]), F.substring("p_brand", 1, 7))
    return read(spark, d, "part").select("p_partkey", S.information_class(pick(0), pick(1), F.when(F.col("p_size") > 40, F.col("p_name"))).alias("class"))


STEPS = "SELECT site_id, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY site_id ORDER BY ts)) / 3.6e9 AS step, row_number() OVER (PARTITION BY site_id ORDER BY ts) AS no FROM instants"


@query("p13_w4_steps", f"SELECT site_id, round(median(step), 6) AS median_step_h, round(max(step), 6) AS largest_gap_h, coalesce(count(*) > 2 AND median(step) FILTER (no <= 5000) > 0 AND median(step) FILTER (no <= 5000) < 20, false) OR coalesce(any_value(first_type) <> 'daily', false) AS not_daily FROM ({STEPS}) LEFT JOIN (SELECT site_id AS k, arg_min(CASE WHEN event_type = 'click' THEN 'daily' ELSE event_type END, ts) AS first_type FROM instants WHERE event_type <> 'view' GROUP BY 1) ON k = site_id GROUP BY site_id")
def p13_w4_steps(spark, d):
    """The declared interval of a site: what its first event that is no view says, a click for daily."""
    declared = F.when(F.col("event_type") == "click", "daily").when(F.col("event_type") != "view", F.col("event_type"))
    return rounded(O.step_check(instants(spark, d).withColumn("interval", declared), declared="interval"), "median_step_h", "largest_gap_h")


@query("a1_summary", SUMMARY)
def a1_summary(spark, d):
    return rounded(O.summarise(gappy(spark, d)), "mean", "q05", "q50", "q95")


@query("a2_statistics", "SELECT site_id, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max, round(sum(value), 2) AS sum, round(quantile_cont(value, 0.9), 6) AS p90 FROM gappy GROUP BY site_id")
def a2_statistics(spark, d):
    names = ("mean", "median", "std", "min", "max", "sum", "p90")
    out = gappy(spark, d).groupBy("site_id").agg(*[O.statistic(n).alias(n) for n in names])
    return rounded(rounded(out, "mean", "median", "std", "p90"), "sum", digits=2)


@query("a3_calendar", CALENDAR)
def a3_calendar(spark, d):
    return O.calendar_block(gappy(spark, d))


BOUNDS = "(SELECT 'g' || CAST(c_custkey // 300 AS VARCHAR) AS site_id, min(DATE '1992-06-01' + CAST(c_nationkey AS INTEGER)) AS s, CASE WHEN min(c_acctbal) < -900 THEN DATE '1999-03-01' END AS e FROM customer WHERE c_custkey // 300 <> 1 GROUP BY 1 UNION ALL SELECT 'nowhere', DATE '2000-01-01', DATE '2000-01-10' UNION ALL SELECT 'turned', DATE '2000-01-02', DATE '2000-01-01')"
BOUNDED = f"(SELECT site_id, lo, hi, g.date, g.value FROM (SELECT coalesce(a.site_id, b.site_id) AS site_id, coalesce(s, lo) AS lo, coalesce(e, hi) AS hi FROM (SELECT site_id, min(date) AS lo, max(date) AS hi FROM gappy GROUP BY 1) a FULL JOIN {BOUNDS} b ON b.site_id = a.site_id) x LEFT JOIN (SELECT site_id AS k, date, value FROM gappy) g ON g.k = x.site_id AND g.date BETWEEN lo AND hi)"
SIX = "CASE WHEN {0} = 0 THEN 0 ELSE round({0} * power(10.0, 5 - floor(log10(abs({0}))))) / power(10.0, 5 - floor(log10(abs({0})))) END"


def bounds(spark, d):
    """Spans that sites were asked for: one site has none, some have no end, one has no rows and one is turned around."""
    c = read(spark, d, "customer").where("floor(c_custkey / 300) <> 1")
    g = c.groupBy(F.concat(F.lit("g"), F.floor(F.col("c_custkey") / 300).cast("string")).alias("site_id")).agg(F.min(F.date_add(F.lit("1992-06-01").cast("date"), F.col("c_nationkey").cast("int"))).alias("start"), F.when(F.min("c_acctbal") < -900, F.lit("1999-03-01").cast("date")).alias("end"))
    return g.unionByName(spark.sql("SELECT 'nowhere' AS site_id, DATE '2000-01-01' AS start, DATE '2000-01-10' AS end UNION ALL SELECT 'turned', DATE '2000-01-02', DATE '2000-01-01'"))


@query("a3_bounded_calendar", f"SELECT site_id, greatest(0, CAST(any_value(hi) - any_value(lo) + 1 AS INTEGER)) AS expected, count(DISTINCT date) AS present, greatest(0, CAST(any_value(hi) - any_value(lo) + 1 AS INTEGER)) - count(DISTINCT date) AS missing FROM {BOUNDED} GROUP BY site_id")
def a3_bounded(spark, d):
    return O.calendar_block(gappy(spark, d), bounds(spark, d))


@query("a4_served_summary", f"SELECT site_id, n_dates, n_finite, expected, {SIX.format('f')} AS fraction_with_value, f < 1 AS partial, {SIX.format('mean')} AS mean, {SIX.format('min')} AS min, {SIX.format('max')} AS max, first_date, last_date FROM (SELECT *, n_finite / nullif(expected, 0) AS f FROM (SELECT site_id, count(date) AS n_dates, count(value) AS n_finite, greatest(0, CAST(any_value(hi) - any_value(lo) + 1 AS INTEGER)) AS expected, avg(value) AS mean, min(value) AS min, max(value) AS max, min(date) AS first_date, max(date) AS last_date FROM {BOUNDED} GROUP BY site_id))")
def a4_served_summary(spark, d):
    return O.served_summary(gappy(spark, d), bounds(spark, d))


CODES = "SELECT 's' || CAST(o_custkey % 7 AS VARCHAR) AS site_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice - 20000 END AS value, o_orderkey % 5 AS k FROM orders"


@query("a5_quality_summary", f"SELECT site_id, count(*) AS n, count(*) FILTER (k IN (0, 1)) AS approved, count(*) FILTER (k = 2) AS provisional, count(*) FILTER (k IN (1, 2)) AS estimated, count(*) FILTER (k IN (2, 3)) AS other_codes, round(count(*) FILTER (k = 2) / nullif(count(*) FILTER (k IN (0, 1, 2)), 0), 6) AS provisional_fraction, count(*) FILTER (value < 0) AS negative FROM ({CODES}) WHERE value IS NOT NULL GROUP BY site_id")
def a5_quality_summary(spark, d):
    k = (F.col("o_orderkey") % 5).cast("int")
    approval, qualifier = F.get(F.array(*map(F.lit, ("A", "A", "P", "", ""))), k), F.get(F.array(*map(F.lit, ("", "e", "e, Ice", "Eqp", ""))), k)
    rows = read(spark, d, "orders").select(F.concat(F.lit("s"), (F.col("o_custkey") % 7).cast("string")).alias("site_id"), approval.alias("approval"), qualifier.alias("qualifier"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice") - 20000).alias("value"))
    return rounded(O.quality_summary(rows), "provisional_fraction")


CODED = "(SELECT l_suppkey // 33 AS site_id, l_quantity, CASE WHEN l_shipdate > DATE '1998-06-01' THEN 'P' WHEN l_linenumber < 6 THEN 'A' ELSE '' END AS approval, CASE WHEN l_returnflag = 'R' THEN ['e', 'Ice'] WHEN l_returnflag = 'A' THEN [l_linestatus] ELSE [] END AS qualifier FROM lineitem WHERE l_tax > 0.01)"


@query("a5_code_counts", f"SELECT CAST(site_id AS VARCHAR) AS site_id, kind, code, count(*) AS n, kind = 'qualifier' AND code NOT IN ('A', 'P', 'e') AS other FROM (SELECT site_id, 'approval' AS kind, approval AS code FROM {CODED} WHERE approval <> '' UNION ALL SELECT site_id, 'qualifier', unnest(qualifier) FROM {CODED}) GROUP BY ALL")
def a5_codes(spark, d):
    li = read(spark, d, "lineitem")
    approval = F.when(F.to_date("l_shipdate") > "1998-06-01", "P").when(F.col("l_linenumber") < 6, "A").otherwise("")
    qualifier = F.when(F.col("l_returnflag") == "R", "e, Ice").when(F.col("l_returnflag") == "A", F.col("l_linestatus"))
    return O.code_counts(li.select(F.floor(F.col("l_suppkey") / 33).cast("string").alias("site_id"), approval.alias("approval"), qualifier.alias("qualifier"), F.when(F.col("l_tax") > 0.01, F.col("l_quantity")).alias("value")))


PAIRS = "SELECT a.site_id, a.date, a.value AS x, CASE WHEN a.prcp > 0.05 THEN a.value + 400 * a.prcp END AS y FROM daily a"


@query("a6_agreement", f"""SELECT site_id, count(*) AS n_common, count(x) AS n_pairs, round(avg(x), 4) AS mean_a, round(avg(y), 4) AS mean_b, round(100 * (avg(y) - avg(x)) / avg(x), 4) AS percent_bias, round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) AS r, round(stddev_pop(x), 4) AS sd_a, round(stddev_pop(y), 4) AS sd_b, round(stddev_pop(y) / stddev_pop(x), 6) AS sd_ratio, round(avg(y) / avg(x), 6) AS beta,
round(1 - sqrt(power(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) - 1, 2) + power(stddev_pop(y) / stddev_pop(x) - 1, 2) + power(avg(y) / avg(x) - 1, 2)), 6) AS kge, round(1 - avg((y - x) * (y - x)) / var_pop(x), 6) AS nse, round(sqrt(avg((y - x) * (y - x))), 4) AS rmse, min(date) AS "start", max(date) AS "end" FROM (SELECT site_id, date, CASE WHEN y IS NOT NULL THEN x END AS x, y, CASE WHEN y IS NOT NULL THEN 1 END AS ok FROM ({PAIRS})) WHERE ok = 1 OR ok IS NULL GROUP BY site_id""".replace('min(date) AS "start", max(date) AS "end"', 'min(date) FILTER (ok = 1) AS "start", max(date) FILTER (ok = 1) AS "end"'))
def a6_agreement(spark, d):
    s = daily(spark, d)
    b = s.select("site_id", "date", F.when(F.col("prcp") > 0.05, F.col("value") + 400 * F.col("prcp")).alias("value"))
    out = O.agreement(s, b)
    return rounded(rounded(out, "r", "sd_ratio", "beta", "kge", "nse"), "mean_a", "mean_b", "percent_bias", "sd_a", "sd_b", "rmse", digits=4)


@query("a46_skill_rating", f"SELECT site_id, CASE WHEN nse >= 0.75 THEN 'excellent' WHEN nse >= 0.5 THEN 'satisfactory' WHEN nse IS NOT NULL THEN 'poor' ELSE 'unknown' END AS rating FROM (SELECT site_id, 1 - avg((y - x) * (y - x)) / var_pop(x) AS nse FROM ({PAIRS}) WHERE y IS NOT NULL GROUP BY site_id)")
def a46_skill_rating(spark, d):
    s = daily(spark, d)
    b = s.select("site_id", "date", F.when(F.col("prcp") > 0.05, F.col("value") + 400 * F.col("prcp")).alias("value"))
    return O.agreement(s, b).select("site_id", O.skill_rating(F.col("nse")).alias("rating"))


@query("j1_pairs", "SELECT a.site_id, a.date, a.value AS value_a, b.value AS value_b FROM gappy a JOIN (SELECT 'g0' AS site_id, date, value FROM daily WHERE site_id = '0') b ON a.site_id = b.site_id AND a.date = b.date")
def j1_pairs(spark, d):
    b = daily(spark, d).where("site_id = '0'").select(F.lit("g0").alias("site_id"), "date", "value")
    return O.pair(gappy(spark, d), b)


@query("j3_missing_days", MISSING)
def j3_missing_days(spark, d):
    """Days without a value: those that have no row and those whose value is NULL."""
    return O.missing_days(gappy(spark, d), valued=True)


@query("w2_missing_ranges", f"SELECT site_id, min(date) AS \"start\", max(date) AS \"end\", count(*) AS days FROM (SELECT *, date - CAST(row_number() OVER (PARTITION BY site_id ORDER BY date) AS INTEGER) AS island FROM ({MISSING})) GROUP BY site_id, island")
def w2_missing_ranges(spark, d):
    """Ranges of days without a value."""
    return O.islands(O.missing_days(gappy(spark, d), valued=True))


@query("w2_absent_ranges", f"SELECT site_id, min(date) AS \"start\", max(date) AS \"end\", count(*) AS days FROM (SELECT *, date - CAST(row_number() OVER (PARTITION BY site_id ORDER BY date) AS INTEGER) AS island FROM ({ABSENT})) GROUP BY site_id, island")
def w2_absent_ranges(spark, d):
    """Ranges of days without a row, as the calendar block (A3) counts them."""
    return O.islands(O.missing_days(gappy(spark, d)))


@query("w1_runs_break", RUNS)
def w1_runs_break(spark, d):
    return O.threshold_runs(gappy(spark, d), 100)


@query("w1_runs_skip", """SELECT site_id, min(date) AS "start", max(date) AS "end", count(*) AS length, CAST(max(date) - min(date) + 1 AS INTEGER) AS calendar_days FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY date) - row_number() OVER (PARTITION BY site_id, hit ORDER BY date) AS island FROM (SELECT g.*, value <= 0.8 * m AS hit FROM gappy g JOIN (SELECT site_id, avg(value) AS m FROM gappy GROUP BY 1) USING (site_id) WHERE value IS NOT NULL)) WHERE hit GROUP BY site_id, island""")
def w1_runs_skip(spark, d):
    return O.threshold_runs(gappy(spark, d), 0.8, "le", gaps="skip", relative_to="mean")


@query("w1_longest_run", BEST.replace("FROM r", f"FROM ({RUNS})"))
def w1_longest_run(spark, d):
    return O.longest_run(O.threshold_runs(gappy(spark, d), 100))


@query("w3_run_lengths", "SELECT site_id, run_no, code, count(*) AS n FROM (SELECT *, CAST(sum(s) OVER (PARTITION BY site_id ORDER BY o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_no FROM (SELECT site_id, event_type AS code, (ts, value) AS o, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY site_id ORDER BY ts, value) THEN 0 ELSE 1 END AS s FROM instants)) GROUP BY ALL")
def w3_run_lengths(spark, d):
    return O.run_lengths(instants(spark, d).select("site_id", F.col("event_type").alias("code"), F.struct("ts", "value").alias("o")), order="o")


@query("w6_latest", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def w6_latest(spark, d):
    return O.latest(read(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


CHUNKS = "SELECT CAST(l_suppkey % 3 AS VARCHAR) AS site_id, CAST(l_shipdate AS DATE) AS date, l_linenumber AS chunk_no, sum(l_quantity) AS value FROM lineitem GROUP BY ALL"


@query("u1_union_first", f"SELECT site_id, date, chunk_no, value FROM ({CHUNKS}) QUALIFY row_number() OVER (PARTITION BY site_id, date ORDER BY chunk_no) = 1")
def u1_union_first(spark, d):
    rows = read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 3).cast("string").alias("site_id"), F.to_date("l_shipdate").alias("date"), F.col("l_linenumber").alias("chunk_no")).agg(F.sum("l_quantity").alias("value"))
    return O.union_first(rows)


@query("u3_common_dates", "SELECT date FROM gappy WHERE site_id = 'g0' INTERSECT SELECT date FROM gappy WHERE site_id = 'g1'")
def u3_common_dates(spark, d):
    s = gappy(spark, d)
    return s.where("site_id = 'g0'").select("date").intersect(s.where("site_id = 'g1'").select("date"))


@query("u3_only_in_first", "SELECT date FROM gappy WHERE site_id = 'g0' EXCEPT SELECT date FROM gappy WHERE site_id = 'g1'")
def u3_only_in_first(spark, d):
    s = gappy(spark, d)
    return s.where("site_id = 'g0'").select("date").subtract(s.where("site_id = 'g1'").select("date"))
