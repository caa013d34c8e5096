"""Queries over cell tables, sites and networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import grid as G
from ..operators import network as N
from .registry import cells, query, read, sites
from .series import rounded

TABLE = [(i, c) for i, c in enumerate(["open_water", "developed", "forest", "shrub", "grass", "crops", "wetland", "barren"] * 5, 1)]
CLASS_SQL = "CASE WHEN lulc <= 40 THEN ['open_water', 'developed', 'forest', 'shrub', 'grass', 'crops', 'wetland', 'barren'][(lulc - 1) % 8 + 1] END"


def classed(spark, d):
    table = spark.createDataFrame(TABLE, "code int, class string")
    return G.remap_codes(cells(spark, d), table)


@query("p15_remap_codes", f"SELECT id, lulc, {CLASS_SQL} AS class FROM cells")
def p15(spark, d):
    return classed(spark, d).select("id", "lulc", "class")


@query("p16_flood_depth", "SELECT id, CASE WHEN hand IS NOT NULL THEN round(greatest(2.5 - hand, 0), 6) END AS depth FROM cells")
def p16(spark, d):
    return cells(spark, d).select("id", F.round(S.flood_depth(F.col("hand"), F.lit(2.5)), 6).alias("depth"))


@query("p17_spectral_index", "SELECT id, name, round(v, 6) AS value, CASE WHEN v > least_ THEN kind WHEN v IS NOT NULL THEN 'other' END AS class FROM (SELECT id, unnest(['ndvi', 'ndwi', 'mndwi', 'nbr', 'ndbi']) AS name, unnest([(nir - red) / nullif(nir + red, 0), (green - nir) / nullif(green + nir, 0), (green - swir1) / nullif(green + swir1, 0), (nir - swir2) / nullif(nir + swir2, 0), (swir1 - nir) / nullif(swir1 + nir, 0)]) AS v, unnest([0.2, 0.3, 0.0, 0.1, 0.0]) AS least_, unnest(['vegetation', 'open_water', 'open_water', 'unburned', 'built_up']) AS kind FROM (SELECT id, CAST(col AS DOUBLE) AS nir, lulc - 1.0 AS red, lulc / 2.0 AS green, price / 100 AS swir1, CASE WHEN hand IS NULL THEN NULL ELSE hand + 10 END AS swir2 FROM cells))")
def p17(spark, d):
    bands = cells(spark, d).select("id", F.col("col").cast("double").alias("nir"), (F.col("lulc") - 1.0).alias("red"), (F.col("lulc") / 2.0).alias("green"), (F.col("price") / 100).alias("swir1"), (F.col("hand") + 10).alias("swir2"))
    each = bands.select("id", *[S.spectral_index(n).alias(n) for n in S.INDICES]).unpivot(["id"], list(S.INDICES), "name", "value")
    kind = F.lit(None).cast("string")
    for n in S.INDICES:
        kind = F.when(F.col("name") == n, S.index_class(n, F.col("value"))).otherwise(kind)
    return each.select("id", "name", F.round("value", 6).alias("value"), kind.alias("class"))


@query("p18_wetness_index", "SELECT id, CASE WHEN lulc > 1 THEN round(ln(price / tan(radians(lulc - 1))), 6) END AS twi FROM cells")
def p18(spark, d):
    return cells(spark, d).select("id", F.round(S.wetness_index(F.col("price"), F.col("lulc") - 1), 6).alias("twi"))


@query("a21_zonal", "SELECT basin_id, lulc, round(avg(price), 6) AS mean, round(sum(price), 2) AS sum, round(median(price), 6) AS median, min(price) AS min, max(price) AS max FROM cells WHERE hand < 5 GROUP BY ALL")
def a21(spark, d):
    c = cells(spark, d)
    out = G.zonal(c, c.where("hand < 5").select(*G.AT), "price", ["basin_id", "lulc"])
    return rounded(rounded(out, "mean", "median"), "sum", digits=2)


@query("a22_pixel_statistics", "SELECT basin_id, count(hand) AS n_valid, round(avg(hand), 6) AS mean, round(median(hand), 6) AS median, round(stddev_pop(hand), 6) AS std, round(quantile_cont(hand, 0.1), 6) AS p10, round(quantile_cont(hand, 0.25), 6) AS p25, round(quantile_cont(hand, 0.75), 6) AS p75, round(quantile_cont(hand, 0.9), 6) AS p90 FROM cells GROUP BY basin_id")
def a22(spark, d):
    return rounded(G.pixel_statistics(cells(spark, d), "hand", ["basin_id"]), "mean", "median", "std", "p10", "p25", "p75", "p90")


@query("a22_composite", "SELECT CAST(l_suppkey % 5 AS VARCHAR) AS basin_id, CAST(l_partkey // 50 AS INTEGER) AS \"row\", CAST(l_partkey % 50 AS INTEGER) AS col, round(median(l_extendedprice), 4) AS composite FROM lineitem GROUP BY ALL")
def a22_composite(spark, d):
    k = F.col("l_partkey")
    pixels = read(spark, d, "lineitem").select((F.col("l_suppkey") % 5).cast("string").alias("basin_id"), F.floor(k / 50).cast("int").alias("row"), (k % 50).cast("int").alias("col"), "l_extendedprice")
    return rounded(G.composite(pixels, "l_extendedprice"), "composite", digits=4)


MASKS = "(SELECT *, CASE WHEN id % 13 = 0 THEN NULL ELSE CAST(coalesce(hand, 9) < 3 AS INTEGER) END AS model, CASE WHEN id % 19 = 0 THEN NULL ELSE CAST(lulc < 20 AS INTEGER) END AS reference FROM cells)"


def masks(spark, d):
    return cells(spark, d).withColumn("model", F.when(F.col("id") % 13 != 0, (F.coalesce("hand", F.lit(9)) < 3).cast("int"))).withColumn("reference", F.when(F.col("id") % 19 != 0, (F.col("lulc") < 20).cast("int")))


@query("a24_contingency", f"SELECT basin_id, h AS hits, m AS misses, f AS false_alarms, c AS correct_negatives, x AS excluded, round(h / nullif(h + m + f, 0), 6) AS csi, round(h / nullif(h + m, 0), 6) AS pod, round(f / nullif(h + f, 0), 6) AS far, round((h + f) / nullif(h + m, 0), 6) AS bias FROM (SELECT basin_id, count(*) FILTER (model = 1 AND reference = 1) AS h, count(*) FILTER (model = 0 AND reference = 1) AS m, count(*) FILTER (model = 1 AND reference = 0) AS f, count(*) FILTER (model = 0 AND reference = 0) AS c, count(*) FILTER (model IS NULL OR reference IS NULL) AS x FROM {MASKS} GROUP BY 1)")
def a24(spark, d):
    return rounded(G.contingency(masks(spark, d)), "csi", "pod", "far", "bias")


@query("a25_band_statistics", "SELECT basin_id, lulc, round(count(*) FILTER (hand < 2.5) * 0.0009, 6) AS area_km2, round(max(greatest(2.5 - hand, 0)) FILTER (hand IS NOT NULL), 6) AS max_depth FROM cells GROUP BY ALL")
def a25(spark, d):
    c = cells(spark, d).withColumn("depth", S.flood_depth(F.col("hand"), F.lit(2.5)))
    return rounded(G.band_statistics(c, 30.0, ["basin_id", "lulc"]), "area_km2", "max_depth")


@query("a26_stage_lookup", "SELECT t.basin_id, CAST(k AS INTEGER) AS step, round(top * k / 10, 6) AS stage, count(c.hand) FILTER (c.hand <= top * k / 10 + 1e-9) AS cells FROM (SELECT basin_id, max(hand) AS top, unnest(range(11)) AS k FROM cells GROUP BY 1) t JOIN cells c ON c.basin_id = t.basin_id GROUP BY t.basin_id, k, top")
def a26(spark, d):
    return rounded(G.stage_lookup(cells(spark, d)), "stage")


@query("a27_exposure", "SELECT basin_id, round(count(*) FILTER (hand < 2.5) * 0.0009, 6) AS area_km2, round(CASE WHEN basin_id <> '2' THEN coalesce(sum(CASE WHEN id % 5 = 0 THEN 0 ELSE price END) FILTER (hand < 2.5), 0) ELSE count(*) FILTER (hand < 2.5) * 0.0009 * 45 END, 4) AS exposed, CASE WHEN basin_id <> '2' THEN 'population' ELSE 'density' END AS basis FROM cells GROUP BY basin_id")
def a27(spark, d):
    c = cells(spark, d).withColumn("depth", S.flood_depth(F.col("hand"), F.lit(2.5))).withColumn("population", F.when((F.col("basin_id") != "2") & (F.col("id") % 5 != 0), F.col("price")))
    return rounded(rounded(G.exposure(c, 30.0), "area_km2"), "exposed", digits=4)


@query("a28_class_fractions", "SELECT basin_id, lulc, n, round(n / sum(n) OVER (PARTITION BY basin_id), 6) AS fraction, row_number() OVER (PARTITION BY basin_id ORDER BY n DESC, lulc) = 1 AS dominant FROM (SELECT basin_id, lulc, count(*) AS n FROM cells GROUP BY ALL)")
def a28(spark, d):
    return rounded(G.class_fractions(cells(spark, d), "lulc"), "fraction")


CN = " ".join(f"WHEN '{c}{'ABCD'[i]}' THEN {n}" for c, row in G.CURVE_NUMBERS.items() for i, n in enumerate(row))


@query("j10_curve_numbers", f"SELECT id, class, hsg, CAST(CASE class || hsg {CN} END AS DOUBLE) AS cn FROM (SELECT id, {CLASS_SQL} AS class, CASE id % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'D' ELSE 'D' END AS hsg FROM cells)")
def j10(spark, d):
    soils = cells(spark, d).select(*G.AT, F.get(F.array(*map(F.lit, ("A", "B", "c", "D", "A/D", "B/D"))), (F.col("id") % 6).cast("int")).alias("hsg"))
    return G.curve_numbers(classed(spark, d).select(*G.AT, "id", "class"), soils).select("id", "class", "hsg", F.col("cn").cast("double").alias("cn"))


CN_CELLS = f"(SELECT id, basin_id, lulc <= 30 AS valid, CAST(CASE class || hsg {CN} END AS DOUBLE) AS cn FROM (SELECT id, basin_id, lulc, {CLASS_SQL} AS class, CASE WHEN brand < 'Brand#15' THEN 'A' WHEN brand < 'Brand#20' THEN 'B' WHEN brand < 'Brand#5' THEN 'C' ELSE 'D' END AS hsg FROM cells))"
SPREAD = "count(cn) AS n, round(avg(cn), 6) AS mean, median(cn) AS median, min(cn) AS min, max(cn) AS max, round(stddev_pop(cn), 6) AS std, " + ", ".join(f"round(quantile_cont(cn, {p / 100}), 6) AS p{p}" for p in (10, 25, 75, 90))


@query("j10_curve_number_statistics", f"SELECT basin_id, 'polygon' AS basis, {SPREAD} FROM {CN_CELLS} WHERE valid GROUP BY ALL UNION ALL SELECT basin_id, 'raster_extent', {SPREAD} FROM {CN_CELLS} GROUP BY ALL")
def j10_statistics(spark, d):
    brand = F.col("brand")
    hsg = F.when(brand < "Brand#15", "A").when(brand < "Brand#20", "B/C").when(brand < "Brand#5", "C").otherwise("A/D")
    c = classed(spark, d)
    drained = G.curve_numbers(c.where("brand >= 'Brand#15' AND brand < 'Brand#20'").select(*G.AT, "id", "class", "lulc"), c.select(*G.AT, hsg.alias("hsg")), drained=True)
    others = G.curve_numbers(c.where("NOT (brand >= 'Brand#15' AND brand < 'Brand#20')").select(*G.AT, "id", "class", "lulc"), c.select(*G.AT, hsg.alias("hsg")))
    met = drained.unionByName(others).withColumn("valid", F.col("lulc") <= 30).withColumn("cn", F.col("cn").cast("double"))
    return rounded(G.curve_number_statistics(met), "mean", "std", "p10", "p25", "p75", "p90")


@query("a28_mean_texture", "SELECT basin_id, round(avg(sand), 6) AS sand, round(avg(silt), 6) AS silt, round(avg(clay), 6) AS clay, count(*) AS n FROM (SELECT basin_id, lulc * 1.0 AS sand, CASE WHEN hand IS NULL THEN NULL ELSE 30.0 END AS silt, 70.0 - lulc AS clay FROM cells) WHERE silt IS NOT NULL GROUP BY basin_id")
def a28_texture(spark, d):
    c = cells(spark, d).select("basin_id", (F.col("lulc") * 1.0).alias("sand"), F.when(F.col("hand").isNotNull(), 30.0).alias("silt"), (70.0 - F.col("lulc")).alias("clay"))
    return rounded(G.mean_texture(c), "sand", "silt", "clay")


@query("j11_nearest_epoch", "SELECT id, CAST(CASE WHEN y <= 1995 THEN 1990 WHEN y <= 2005 THEN 2000 WHEN y <= 2015 THEN 2010 ELSE 2020 END AS INTEGER) AS epoch FROM (SELECT id, 1980 + lulc AS y FROM cells)")
def j11(spark, d):
    return G.nearest_epoch(cells(spark, d).select("id", (F.lit(1980) + F.col("lulc")).alias("year")), [1990, 2000, 2010, 2020]).select("id", "epoch")


BISECT = "WITH RECURSIVE c AS (SELECT p_partkey AS id, p_retailprice AS q, CAST(20.0 + p_size AS DOUBLE) AS w, unnest([0.030::DOUBLE, 0.035::DOUBLE, 0.050::DOUBLE]) AS n FROM part), b AS (SELECT id, q, w, n, 0.0::DOUBLE AS lo, 50.0::DOUBLE AS hi, 0 AS i FROM c UNION ALL SELECT id, q, w, n, CASE WHEN f < q THEN mid ELSE lo END, CASE WHEN f < q THEN hi ELSE mid END, i + 1 FROM (SELECT *, w * mid * power(w * mid / (w + 2 * mid), 2.0 / 3) * sqrt(0.001) / n AS f FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE i < 60))) SELECT id, round(max((lo + hi) / 2) FILTER (n = 0.030), 6) AS stage_30, round(max((lo + hi) / 2) FILTER (n = 0.035), 6) AS stage_35, round(max((lo + hi) / 2) FILTER (n = 0.050), 6) AS stage_50 FROM b WHERE i = 60 GROUP BY id"


@query("f7_manning_stage", BISECT)
def f7(spark, d):
    return cells(spark, d).select("id", *[F.round(G.manning_stage(F.col("price"), F.lit(20.0) + F.col("lulc"), F.lit(0.001), F.lit(n)), 6).alias(f"stage_{int(n * 1000)}") for n in (0.030, 0.035, 0.050)])


GRADIENT = "coalesce((max(elev) FILTER ({1}) - max(elev) FILTER ({0})) / 60, (max(elev) FILTER ({1}) - max(elev) FILTER (dr = 0 AND dc = 0)) / 30, (max(elev) FILTER (dr = 0 AND dc = 0) - max(elev) FILTER ({0})) / 30, 0)"


@query("f8_channel_geometry", "SELECT basin_id, round(greatest(30 * sqrt(any_value(acc)) * 0.5, 60.0), 6) AS width, round(greatest(sqrt(power(" + GRADIENT.format("dr = -1 AND dc = 0", "dr = 1 AND dc = 0") + ", 2) + power(" + GRADIENT.format("dr = 0 AND dc = -1", "dr = 0 AND dc = 1") + ", 2)), 0.001), 6) AS slope FROM (SELECT c.basin_id, o.acc, c.price / 10 + c.col AS elev, c.\"row\" - o.r AS dr, c.col - o.c AS dc FROM cells c JOIN (SELECT basin_id, max(price) AS acc, arg_max(\"row\", (price, -\"row\", -col)) AS r, arg_max(col, (price, -\"row\", -col)) AS c FROM cells GROUP BY 1) o ON o.basin_id = c.basin_id) WHERE abs(dr) + abs(dc) <= 1 GROUP BY basin_id")
def f8(spark, d):
    c = cells(spark, d).withColumn("acc", F.col("price")).withColumn("elev", F.col("price") / 10 + F.col("col"))
    return rounded(G.channel_geometry(c, 30.0), "width", "slope")


@query("f9_dilation", "SELECT DISTINCT g.basin_id, g.\"row\", g.col FROM cells g JOIN cells m ON m.basin_id = g.basin_id AND abs(m.\"row\" - g.\"row\") <= 2 AND abs(m.col - g.col) <= 2 WHERE m.hand < 0.5")
def f9(spark, d):
    c = cells(spark, d)
    return G.dilate(c.where("hand < 0.5").select(*G.AT), c, 2)


@query("f9_best_dilation", "SELECT basin_id, CAST(arg_max(k, csi * 1000 + k * 1e-6) AS INTEGER) AS iterations, round(max(csi), 6) AS csi FROM (SELECT basin_id, k, count(*) FILTER (away <= k AND t) / count(*) FILTER (away <= k OR t) AS csi FROM (SELECT g.basin_id, g.id, g.hand < 2.5 AS t, min(greatest(abs(m.\"row\" - g.\"row\"), abs(m.col - g.col))) AS away FROM cells g LEFT JOIN cells m ON m.basin_id = g.basin_id AND m.hand < 0.5 GROUP BY ALL) , (SELECT unnest(range(5)) AS k) GROUP BY ALL) GROUP BY basin_id")
def f9_best(spark, d):
    c = cells(spark, d)
    return rounded(G.best_dilation(c.where("hand < 0.5").select(*G.AT), c.where("hand < 2.5").select(*G.AT), c), "csi")


GRIDS = "(SELECT b AS sample_id, r AS \"row\", c AS col, max(CASE WHEN p_brand = b AND p_size > 25 THEN 1 ELSE 0 END) AS hand, max(CASE WHEN p_brand = b AND p_size > 15 THEN 1 ELSE 0 END) AS physics FROM (SELECT DISTINCT p_brand AS b FROM part) CROSS JOIN (SELECT *, CAST(p_partkey // 50 AS INTEGER) AS r, CAST(p_partkey % 50 AS INTEGER) AS c FROM part) GROUP BY ALL)"


def grids(spark, d):
    """A full grid for each brand of parts: 1 where a part of the brand is, and large enough."""
    part = read(spark, d, "part")
    brands = part.select(F.col("p_brand").alias("sample_id")).distinct()
    k = F.col("p_partkey")
    at = part.select(F.floor(k / 50).cast("int").alias("row"), (k % 50).cast("int").alias("col"), "p_brand", "p_size")
    mark = lambda least: ((F.col("p_brand") == F.col("sample_id")) & (F.col("p_size") > least)).cast("int")
    return at.crossJoin(F.broadcast(brands)).select("sample_id", "row", "col", mark(25).alias("hand"), mark(15).alias("physics"))


@query("f10_mask_roundtrip", f'SELECT sample_id, "row", col, hand AS value FROM {GRIDS}')
def f10(spark, d):
    g = grids(spark, d).select("sample_id", "row", "col", F.col("hand").alias("value"))
    return G.decode_mask(G.encode_mask(g, 50, "sample_id"), 50, "sample_id")


@query("f10_surrogate_samples", f"SELECT s.sample_id, s.a AS area_km2, CAST(50 AS INTEGER) AS n_columns, g.wet_in, g.wet_out FROM (SELECT p_brand AS sample_id, round(sum(p_retailprice), 2) AS a FROM part GROUP BY 1) s JOIN (SELECT sample_id, sum(hand) AS wet_in, sum(physics) AS wet_out FROM {GRIDS} GROUP BY 1) g USING (sample_id)")
def f10_samples(spark, d):
    g = grids(spark, d)
    summaries = read(spark, d, "part").groupBy(F.col("p_brand").alias("sample_id")).agg(F.round(F.sum("p_retailprice"), 2).alias("area_km2"), F.max("p_size").cast("double").alias("discharge_m3s"), F.lit(1.5).alias("stage_m"), F.lit("rational").alias("method"), F.lit("ok").alias("status"))
    masks_of = lambda c: g.select("sample_id", "row", "col", F.col(c).alias("value"))
    out = G.surrogate_samples(summaries, masks_of("hand"), masks_of("physics"), 50, 30.0)
    wet = lambda c: F.aggregate(F.sequence(F.lit(0), (F.size(c) / 2 - 1).cast("int")), F.lit(0), lambda a, i: a + F.get(c, 2 * i) * F.get(c, 2 * i + 1)).cast("long")
    return out.select("sample_id", "features.area_km2", F.get("features.shape", F.lit(1)).alias("n_columns"), wet(F.col("input_counts")).alias("wet_in"), wet(F.col("target.counts")).alias("wet_out"))


@query("f11_shape_ratios", "SELECT id, round(price / (lulc * lulc), 6) AS form_factor, round(4 * pi() * price / power(price / 5, 2), 6) AS circularity, round(2 * sqrt(price / pi()) / lulc, 6) AS elongation, round(300.0 / (1000 * lulc), 6) AS relief_ratio, round(lulc * 7 / price, 6) AS drainage_density FROM cells")
def f11(spark, d):
    r = G.shape_ratios(F.col("price"), F.col("price") / 5, F.col("lulc"), F.lit(300.0), F.col("lulc") * 7)
    return cells(spark, d).select("id", *[F.round(c, 6).alias(k) for k, c in r.items()])


@query("p14_site_search", "SELECT gauge_id, name, lon, lat, area, CASE WHEN gauge_id = '12' THEN 0 ELSE 2 END AS rank FROM sites WHERE gauge_id = '12' OR (lon BETWEEN -130 AND 150 AND lat BETWEEN -70 AND 70 AND (name ILIKE '%12%' OR gauge_id LIKE '%12%')) ORDER BY rank, gauge_id LIMIT 20")
def p14(spark, d):
    return N.search_sites(sites(spark, d), "12", (-130.0, -70.0, 150.0, 70.0), 20)  # the site 12 lies outside


META = "(SELECT CAST(l_suppkey AS VARCHAR) AS gauge_id, CASE l_linenumber WHEN 1 THEN '00060' ELSE '00065' END AS parameter_code, CASE WHEN l_returnflag = 'A' THEN '00003' ELSE '00001' END AS statistic_id, CAST(l_shipdate AS DATE) AS b, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) AS e FROM lineitem)"


def metadata(spark, d):
    li = read(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").cast("string").alias("gauge_id"), F.when(F.col("l_linenumber") == 1, "00060").otherwise("00065").alias("parameter_code"), F.when(F.col("l_returnflag") == "A", "00003").otherwise("00001").alias("statistic_id"), F.to_date("l_shipdate").alias("begin"), F.date_add(F.to_date("l_shipdate"), F.col("l_quantity").cast("int")).alias("end"))


@query("j4_with_daily_series", f"SELECT gauge_id, name FROM sites WHERE gauge_id IN (SELECT gauge_id FROM {META} WHERE parameter_code = '00060' AND statistic_id = '00003')")
def j4(spark, d):
    return N.with_daily_series(sites(spark, d), metadata(spark, d)).select("gauge_id", "name")


@query("a29_record_span", f"SELECT gauge_id, min(b) AS \"begin\", max(e) AS \"end\" FROM {META} GROUP BY gauge_id")
def a29(spark, d):
    return N.record_span(metadata(spark, d))


@query("j5_record_status", f"SELECT s.gauge_id, m.b AS \"begin\", m.e AS \"end\", CASE WHEN m.b IS NOT NULL THEN 'yes' WHEN CAST(s.gauge_id AS INTEGER) % 2 = 0 THEN 'none' ELSE 'unknown' END AS status FROM sites s LEFT JOIN (SELECT gauge_id, min(b) AS b, max(e) AS e FROM {META} WHERE CAST(gauge_id AS INTEGER) % 3 = 0 GROUP BY 1) m ON m.gauge_id = s.gauge_id")
def j5(spark, d):
    s = sites(spark, d)
    asked = s.where(F.col("gauge_id").cast("int") % 2 == 0).select("gauge_id")
    return N.record_status(s, asked, metadata(spark, d).where(F.col("gauge_id").cast("int") % 3 == 0)).select("gauge_id", "begin", "end", "status")


HAV = "2 * 6371.0 * asin(least(1.0, sqrt(power(sin(radians(m.lat - o.lat) / 2), 2) + cos(radians(o.lat)) * cos(radians(m.lat)) * power(sin(radians(m.lon - o.lon) / 2), 2))))"
EDGES = "(SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS origin_id, CASE WHEN l_returnflag = 'N' THEN 'downstream' ELSE 'upstream' END AS direction, CAST(l_partkey % 100 + 1 AS VARCHAR) AS member_id FROM lineitem)"


def edges(spark, d):
    li = read(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").cast("string").alias("origin_id"), F.when(F.col("l_returnflag") == "N", "downstream").otherwise("upstream").alias("direction"), (F.col("l_partkey") % 100 + 1).cast("string").alias("member_id"))


@query("j6_neighbours", f"SELECT origin_id, direction, CAST(rank AS INTEGER) AS rank, member_id, name, round(km, 6) AS distance_km, round(ratio, 6) AS area_ratio, greatest(n - 20, 0) AS excluded, CAST(not_checked AS INTEGER) AS not_checked FROM (SELECT *, row_number() OVER (PARTITION BY origin_id, direction ORDER BY km, member_id) AS rank, count(*) OVER (PARTITION BY origin_id, direction) AS n FROM (SELECT *, greatest(max(near) OVER (PARTITION BY origin_id) - 80, 0) AS not_checked FROM (SELECT *, dense_rank() OVER (PARTITION BY origin_id ORDER BY km, member_id) AS near FROM (SELECT e.*, m.name, {HAV} AS km, m.area / nullif(o.area, 0) AS ratio FROM {EDGES} e JOIN sites m ON m.gauge_id = e.member_id JOIN sites o ON o.gauge_id = e.origin_id))) WHERE near <= 80) WHERE rank <= 20")
def j6(spark, d):
    return rounded(N.neighbours(edges(spark, d), sites(spark, d)), "distance_km", "area_ratio")


@query("j7_points_in_basins", "SELECT CAST(b AS VARCHAR) AS basin_id, gauge_id AS point_id FROM sites, (SELECT unnest(range(12)) AS b) WHERE lon > b * 30 - 180.013 AND lon < b * 30 - 150.013 AND lat > -40.017 AND lat < 40.017")
def j7(spark, d):
    corner = lambda x, y: F.struct((F.col("id") * 30 - 180.013 + x * 30).alias("lon"), F.lit(y * 40.017).alias("lat"))
    basins = spark.range(12).select(F.col("id").cast("string").alias("basin_id"), F.array(corner(0, -1), corner(1, -1), corner(1, 1), corner(0, 1), corner(0, -1)).alias("ring"))
    return N.points_in_basins(sites(spark, d).select(F.col("gauge_id").alias("point_id"), "lon", "lat"), basins, grid=5.0)


@query("j7_regulated", "SELECT CAST(s_suppkey AS VARCHAR) AS basin_id, coalesce(n, 0) AS dams, CASE WHEN s_acctbal < 0 THEN 'warning' WHEN s_acctbal > 9000 THEN 'pass' WHEN coalesce(n, 0) > 0 THEN 'warning' ELSE 'pass' END AS status FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1 GROUP BY 1) ON l_suppkey = s_suppkey")
def j7_regulated(spark, d):
    basins = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("basin_id"), F.when(F.col("s_acctbal") < 0, True).when(F.col("s_acctbal") > 9000, False).alias("flag"))
    dams = read(spark, d, "lineitem").where("l_quantity = 50 AND l_discount = 0.1").select(F.col("l_suppkey").cast("string").alias("basin_id"))
    return N.regulated(basins, dams)


@query("u2_network_members", "SELECT origin_id, member_id, CASE WHEN bool_or(up) THEN 'upstream' ELSE 'downstream' END AS direction FROM (SELECT CAST(l_suppkey AS VARCHAR) AS origin_id, CAST(l_partkey AS VARCHAR) AS member_id, l_returnflag <> 'N' AS up FROM lineitem) GROUP BY ALL")
def u2(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("origin_id"), F.col("l_partkey").cast("string").alias("member_id"), "l_returnflag")
    return N.network_members(li.where("l_returnflag <> 'N'").drop("l_returnflag"), li.where("l_returnflag = 'N'").drop("l_returnflag"))


@query("j8_attribute_lookup", "SELECT CAST(c_custkey AS VARCHAR) AS gauge_id, s.name, s.area, s.name IS NOT NULL AS in_table FROM customer LEFT JOIN sites s ON s.gauge_id = CAST(c_custkey AS VARCHAR)")
def j8(spark, d):
    wanted = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("gauge_id"))
    return N.attribute_lookup(wanted, sites(spark, d).select("gauge_id", "name", "area"))


@query("j9_compare_reference", "SELECT site_id, signature, round(value, 6) AS value, round(reference, 6) AS reference, round(value - reference, 6) AS diff, CASE WHEN reference <> 0 THEN round(100 * (value - reference) / abs(reference), 6) END AS percent FROM (SELECT gauge_id AS site_id, unnest(['lat', 'lon']) AS signature, unnest([lat, lon]) AS value, unnest([lat * 0.9, lon + 1]) AS reference FROM sites)")
def j9(spark, d):
    s = sites(spark, d).withColumnRenamed("gauge_id", "site_id")
    ref = s.select("site_id", (F.col("lat") * 0.9).alias("lat"), (F.col("lon") + 1).alias("lon"))
    return rounded(N.compare_reference(s.select("site_id", F.col("lat").cast("double"), F.col("lon").cast("double")), ref.select("site_id", F.col("lat").cast("double"), F.col("lon").cast("double")), ["lat", "lon"]), "value", "reference", "diff", "percent")


@query("j9_reference_context", "SELECT CAST(s_suppkey AS VARCHAR) AS site_id, round(s_acctbal / a, 6) AS area_ratio, abs(s_acctbal / a - 1) > 0.05 AS area_differs, y < 1999 AS period_differs FROM supplier JOIN (SELECT l_suppkey, avg(l_extendedprice) / 10 AS a, max(year(l_shipdate)) AS y FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")
def j9_context(spark, d):
    own = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("site_id"), F.col("s_acctbal").alias("area_km2"), F.lit(1990).alias("start"), F.lit(1999).alias("end"))
    g = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("site_id")).agg((F.avg("l_extendedprice") / 10).alias("area_km2"), F.max(F.year("l_shipdate")).alias("y"))
    ref = g.select("site_id", "area_km2", F.lit(1990).alias("start"), F.when(F.col("y") >= 1999, 1999).otherwise(F.col("y")).alias("end"))
    return rounded(N.reference_context(own, ref), "area_ratio").select("site_id", "area_ratio", "area_differs", "period_differs")


@query("a47_error_summary", "SELECT method, count(*) AS n, list_sort(list(error))[count(*) // 2 + 1] AS median, list_sort(list(error))[CAST(floor(0.9 * (count(*) - 1)) AS BIGINT) + 1] AS p90, max(error) AS max, count(*) FILTER (error <= 20) AS within_20 FROM (SELECT p_brand AS method, CAST(p_size AS DOUBLE) AS error FROM part) GROUP BY method")
def a47(spark, d):
    return N.error_summary(read(spark, d, "part").select(F.col("p_brand").alias("method"), F.col("p_size").cast("double").alias("error")))


@query("a43_quantile_breaks", "SELECT layer, array_to_string(list_sort(list_distinct(list_transform(range(1, 6), lambda i: v[greatest(CAST(floor((CAST(i AS DOUBLE) / 5) * len(v)) AS BIGINT) - 1, 0) + 1]))), ',') AS breaks FROM (SELECT p_brand AS layer, list_sort(list(CAST(p_size AS INTEGER))) AS v FROM part GROUP BY 1)")
def a43(spark, d):
    return N.class_breaks(read(spark, d, "part").select(F.col("p_brand").alias("layer"), F.col("p_size").cast("int").alias("value")), 5).withColumn("breaks", F.array_join(F.transform("breaks", lambda x: x.cast("string")), ","))


@query("a43_equal_breaks", "SELECT layer, array_to_string(list_transform(range(1, 5), lambda i: CAST(lo + (hi - lo) * i / 4 AS DECIMAL(10, 2))), ',') AS breaks FROM (SELECT p_brand AS layer, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1)")
def a43_equal(spark, d):
    return N.class_breaks(read(spark, d, "part").select(F.col("p_brand").alias("layer"), F.col("p_size").cast("int").alias("value")), 4, "equal").withColumn("breaks", F.array_join(F.transform("breaks", lambda x: x.cast("decimal(10,2)").cast("string")), ","))


LINES = "(SELECT origin_id, direction, round(2 * 6371.0 * asin(least(1.0, sqrt(power(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * power(sin(radians(x2 - x1) / 2), 2)))), 3) AS km, least(x1, x2) AS w, greatest(x1, x2) AS e, least(y1, y2) AS s, greatest(y1, y2) AS n FROM (SELECT CAST(l_suppkey % 20 AS VARCHAR) AS origin_id, CASE WHEN l_returnflag = 'N' THEN 'DM' ELSE 'UT' END AS direction, CASE WHEN l_partkey % 9 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS comid, concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_partkey) AS line_id, l_partkey % 360 - 180 AS x1, l_partkey % 160 - 80 AS y1, l_suppkey % 360 - 180 AS x2, l_suppkey % 160 - 80 AS y2 FROM lineitem) QUALIFY comid IS NULL OR row_number() OVER (PARTITION BY origin_id, direction, comid ORDER BY line_id) = 1)"


@query("a30_flowline_totals", f"SELECT origin_id, direction, count(*) AS n_lines, round(sum(km), 3) AS total_km, min(w)::DOUBLE AS west, min(s)::DOUBLE AS south, max(e)::DOUBLE AS east, max(n)::DOUBLE AS north, count(*) > 500 AS truncated FROM {LINES} GROUP BY ALL")
def a30(spark, d):
    li = read(spark, d, "lineitem")
    point = lambda c: F.struct((F.col(c) % 360 - 180).cast("double").alias("lon"), (F.col(c) % 160 - 80).cast("double").alias("lat"))
    lines = li.select((F.col("l_suppkey") % 20).cast("string").alias("origin_id"), F.when(F.col("l_returnflag") == "N", "DM").otherwise("UT").alias("direction"), F.when(F.col("l_partkey") % 9 != 0, F.col("l_partkey").cast("string")).alias("comid"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("line_id"), F.array(point("l_partkey"), point("l_suppkey")).alias("coords"))
    return rounded(N.flowline_totals(lines), "total_km", digits=3)


@query("j17_training_table", "SELECT f.site_id, f.date, f.prcp, round(CASE WHEN f.site_id <> '2' THEN CASE WHEN area > 0 THEN f.value * 86.4 / area END END, 6) AS q_mm, area, lat, lon FROM daily f LEFT JOIN (SELECT '0' AS site_id, 100.0::DOUBLE AS area, 40.0::DOUBLE AS lat, -70.0::DOUBLE AS lon UNION ALL SELECT '1', 55.0, 41.0, -71.0 UNION ALL SELECT '2', 80.0, 42.0, -72.0) s USING (site_id)")
def j17(spark, d):
    from .registry import daily

    f = daily(spark, d)
    basins = spark.createDataFrame([("0", 100.0, 40.0, -70.0), ("1", 50.0, 41.0, -71.0), ("2", 80.0, 42.0, -72.0)], "site_id string, area double, lat double, lon double")
    attributes = spark.createDataFrame([("0", None, None, None), ("1", 55.0, None, -71.0)], "site_id string, attr_area double, attr_lat double, attr_lon double")
    out, _ = N.training_table(f.where("site_id <> '2'").select("site_id", "date", "value"), f.select("site_id", "date", "prcp"), attributes, basins)
    return rounded(out, "q_mm")


@query("f10_mask_runs", 'SELECT basin_id, min(pos) AS "start", count(*) AS n, value FROM (SELECT *, pos - row_number() OVER (PARTITION BY basin_id, value ORDER BY pos) AS island FROM (SELECT \'m\' || CAST(p_partkey // 1000 AS VARCHAR) AS basin_id, p_partkey % 1000 AS pos, CAST(p_size > 8 AS INTEGER) AS value FROM part)) GROUP BY basin_id, value, island')
def f10_runs(spark, d):
    """Masks of a thousand parts each, encoded by stretches of 64 cells, decoded and encoded again."""
    k = F.col("p_partkey")
    at = (k % 1000).cast("int")
    cells_ = read(spark, d, "part").select(F.concat(F.lit("m"), F.floor(k / 1000).cast("string")).alias("basin_id"), F.floor(at / 40).cast("int").alias("row"), (at % 40).alias("col"), (F.col("p_size") > 8).cast("int").alias("value"))
    back = G.cells_of_runs(G.mask_runs(cells_, 40, block=64), 40, block=64)
    return G.mask_runs(back, 40, block=100)


def _ring_sql() -> str:
    """Edges of a rectangle of latitudes and longitudes around each site, half as wide as its name is long, in tenths."""
    w, h = "length(name) / 20.0", "(length(name) % 7 + 1) / 20.0"
    corners = [(f"lon - {w}", f"lat - {h}"), (f"lon + {w}", f"lat - {h}"), (f"lon + {w}", f"lat + {h}"), (f"lon - {w}", f"lat + {h}")]
    lists = {n: ", ".join(f"CAST({corners[(i + end) % 4][k]} AS DOUBLE)" for i in range(4)) for n, end, k in (("x1", 0, 0), ("y1", 0, 1), ("x2", 1, 0), ("y2", 1, 1))}
    return "(SELECT gauge_id, " + ", ".join(f"unnest([{v}]) AS {n}" for n, v in lists.items()) + " FROM sites)"


def _shape_sql() -> str:
    e, a, flat = S.ECCENTRICITY, S.WGS84_A, (S.WGS84_A - S.WGS84_B) / S.WGS84_A
    half = lambda y: f"tan(asin({1 - e * e!r} * (sin(radians({y})) / (1 - {e * e!r} * sin(radians({y})) * sin(radians({y}))) - ln((1 - {e!r} * sin(radians({y}))) / (1 + {e!r} * sin(radians({y})))) / {2 * e!r}) / {S.POLE_Q!r}) / 2)"
    edges = f"(SELECT *, {half('y1')} AS t1, {half('y2')} AS t2, atan({1 - flat!r} * tan(radians(y1))) AS b1, atan({1 - flat!r} * tan(radians(y2))) AS b2 FROM {_ring_sql()})"
    arcs = f"(SELECT *, 2 * asin(sqrt(power(sin((b2 - b1) / 2), 2) + cos(b1) * cos(b2) * power(sin(radians(x2 - x1) / 2), 2))) AS s FROM {edges})"
    excess = "2 * atan2(tan(radians(x2 - x1) / 2) * (t1 + t2), 1 + t1 * t2)"
    length = f"{a!r} * (s - {flat / 2!r} * ((s - sin(s)) * power(sin((b1 + b2) / 2) * cos((b2 - b1) / 2) / cos(s / 2), 2) + (s + sin(s)) * power(cos((b1 + b2) / 2) * sin((b2 - b1) / 2) / sin(s / 2), 2)))"
    return f"SELECT gauge_id, round(abs(sum({excess})) * {S.AUTHALIC_KM**2!r}, 4) AS area_km2, round(sum({length}), 4) AS perimeter_km FROM {arcs} GROUP BY gauge_id"


@query("geo_area_perimeter", _shape_sql())
def geo_shapes(spark, d):
    w, h = F.length("name") / 20.0, (F.length("name") % 7 + 1) / 20.0
    corner = lambda x, y: F.struct((F.col("lon") + x * w).cast("double").alias("lon"), (F.col("lat") + y * h).cast("double").alias("lat"))
    ring = F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))
    rows = sites(spark, d).select("gauge_id", ring.alias("ring"))
    return rows.select("gauge_id", F.round(S.polygon_area_km2(F.col("ring")), 4).alias("area_km2"), F.round(S.polygon_perimeter_km(F.col("ring")), 4).alias("perimeter_km"))
