"""Sites, networks and attribute tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def search_sites(sites: DataFrame, text: str | None = None, box: tuple[float, float, float, float] | None = None, limit: int = 50) -> DataFrame:
    """The site of an id wherever it lies; then those of an exact name, then of a part of id or name, inside a box of (west,
    south, east, north). An id is also found without its leading zeros. Texts under 2 signs find nothing."""
    q = (text or "").strip().lower()
    exact = (F.lower("gauge_id") == q) | (F.lower("gauge_id") == q.zfill(8)) if q.isdigit() else F.lower("gauge_id") == q
    rank = F.when(exact, 0).when(F.lower("name") == q, 1).when(F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower("gauge_id"), F.lit(q)), 2)
    inside_box = F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]) if box else F.lit(True)
    found = sites.withColumn("rank", rank).where((F.col("rank") == 0) | inside_box).where("rank IS NOT NULL" if len(q) >= 2 else "false")
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("gauge_id").orderBy("rank", "name"))).where("n = 1").drop("n")
    return first.orderBy("rank", "gauge_id").limit(limit)


def with_daily_series(sites: DataFrame, metadata: DataFrame, parameter: str = "00060", statistic: str = "00003") -> DataFrame:
    """Sites that have a series of daily mean discharge."""
    own = metadata.where((F.col("parameter_code") == parameter) & (F.col("statistic_id") == statistic))
    return sites.join(own, "gauge_id", "left_semi")


def record_span(metadata: DataFrame) -> DataFrame:
    return metadata.groupBy("gauge_id").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))


def record_status(sites: DataFrame, asked: DataFrame, metadata: DataFrame) -> DataFrame:
    """yes with the span, none if asked without a series, unknown if not asked."""
    met = sites.join(record_span(metadata), "gauge_id", "left").join(asked.select("gauge_id").distinct().withColumn("asked", F.lit(True)), "gauge_id", "left")
    return met.withColumn("status", F.when(F.col("begin").isNotNull(), "yes").when(F.col("asked"), "none").otherwise("unknown")).drop("asked")


def network_members(up: DataFrame, down: DataFrame, key: str = "member_id") -> DataFrame:
    """Features of two directions (origin_id, key, ...), each once for its origin: the upstream one of those found twice."""
    both = up.withColumn("direction", F.lit("upstream")).unionByName(down.withColumn("direction", F.lit("downstream")))
    w = Window.partitionBy("origin_id", key).orderBy(F.desc("direction"))
    return both.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def neighbours(edges: DataFrame, sites: DataFrame, per_side: int = 20, candidates: int = 80) -> DataFrame:
    """Members up and down the network of each origin, nearest first (unknown positions last), capped for each side by
    per_side, the report's length; with distance, area ratio to the origin and how many of the side were left out.
    Only the `candidates` nearest members of both sides together are looked at; not_checked counts the others."""
    o = sites.select(F.col("gauge_id").alias("origin_id"), F.col("lon").alias("olon"), F.col("lat").alias("olat"), F.col("area").alias("oarea"))
    m = sites.select(F.col("gauge_id").alias("member_id"), "name", "lon", "lat", "area")
    met = edges.select("origin_id", "direction", "member_id").distinct().join(m, "member_id").join(o, "origin_id")
    met = met.withColumn("distance_km", S.haversine_km(F.col("olon"), F.col("olat"), F.col("lon"), F.col("lat")))
    near = Window.partitionBy("origin_id").orderBy(F.asc_nulls_last("distance_km"), "member_id")
    met = met.withColumn("_near", F.dense_rank().over(near)).withColumn("not_checked", F.greatest(F.max("_near").over(Window.partitionBy("origin_id")) - candidates, F.lit(0))).where(F.col("_near") <= candidates)
    w = Window.partitionBy("origin_id", "direction")
    ranked = met.withColumn("rank", F.row_number().over(w.orderBy(F.asc_nulls_last("distance_km"), "member_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    out = ranked.where(F.col("rank") <= per_side)
    return out.select("origin_id", "direction", "rank", "member_id", "name", "distance_km", F.try_divide("area", "oarea").alias("area_ratio"), F.greatest(F.col("n") - per_side, F.lit(0)).alias("excluded"), "not_checked")


def inside(lon: Column, lat: Column, ring: Column) -> Column:
    """Ray casting: whether a point is in a ring, an array of (lon, lat) whose last equals its first."""
    n = F.size(ring)
    edges = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crosses = lambda e: ((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)) & (lon < (e["b"]["lon"] - e["a"]["lon"]) * F.try_divide(lat - e["a"]["lat"], e["b"]["lat"] - e["a"]["lat"]) + e["a"]["lon"])
    return F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def points_in_basins(points: DataFrame, basins: DataFrame, grid: float = 0.25) -> DataFrame:
    """(point_id, lon, lat) and (basin_id, ring) to pairs. Basins cover cells of a grid, points are in one: an equi-join
    on cells, then the exact test."""
    lons, lats = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    cell = lambda c: F.floor(c / grid)
    cover = basins.withColumn("cx", F.explode(F.sequence(cell(F.array_min(lons)), cell(F.array_max(lons))))).withColumn("cy", F.explode(F.sequence(cell(F.array_min(lats)), cell(F.array_max(lats)))))
    dealt = points.withColumn("cx", cell(F.col("lon"))).withColumn("cy", cell(F.col("lat")))
    return dealt.join(cover, ["cx", "cy"]).where(inside(F.col("lon"), F.col("lat"), F.col("ring"))).select("basin_id", "point_id")


def regulated(basins: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """An explicit flag decides; else dams in the basin warn, none passes, and no inventory is insufficient."""
    flag = F.when(F.col("flag"), "warning").when(~F.col("flag"), "pass")
    if pairs is None:
        return basins.select("basin_id", F.lit(None).cast("long").alias("dams"), F.coalesce(flag, F.lit("insufficient_data")).alias("status"))
    n = pairs.groupBy("basin_id").agg(F.count(F.lit(1)).alias("dams"))
    met = basins.join(n, "basin_id", "left").fillna(0, ["dams"])
    return met.select("basin_id", "dams", F.coalesce(flag, F.when(F.col("dams") > 0, "warning").otherwise("pass")).alias("status"))


def attribute_lookup(wanted: DataFrame, attributes: DataFrame) -> DataFrame:
    """Attributes of the wanted gauges, with in_table false and NULLs for those that have none."""
    return wanted.join(attributes.withColumn("in_table", F.lit(True)), "gauge_id", "left").fillna(False, ["in_table"])


def compare_reference(values: DataFrame, reference: DataFrame, names: list[str], key: str = "site_id") -> DataFrame:
    """Each signature's value, reference and difference; only those that both have."""
    a = values.unpivot([key], names, "signature", "value")
    b = reference.unpivot([key], names, "signature", "reference")
    met = a.join(b, [key, "signature"]).where("value IS NOT NULL AND reference IS NOT NULL")
    return met.withColumn("diff", F.col("value") - F.col("reference")).withColumn("percent", F.try_divide(100 * F.col("diff"), F.abs("reference")))


def reference_context(values: DataFrame, reference: DataFrame, key: str = "site_id", area_within: float = 0.05) -> DataFrame:
    """(area_km2, start, end) of a comparison beside the reference's: the ratio of areas, whether it is off by more than
    area_within, and whether the periods differ."""
    r = reference.select(key, F.col("area_km2").alias("area_ref_km2"), F.col("start").alias("start_ref"), F.col("end").alias("end_ref"))
    ratio = F.try_divide("area_km2", "area_ref_km2")
    return values.join(r, key).withColumn("area_ratio", ratio).withColumn("area_differs", F.abs(ratio - 1) > area_within).withColumn("period_differs", ~(F.col("start").eqNullSafe(F.col("start_ref")) & F.col("end").eqNullSafe(F.col("end_ref"))))


def flowline_totals(lines: DataFrame, rows: int = 500) -> DataFrame:
    """Count, length and box of an origin's flowlines by direction; a comid counts once, lines without one each."""
    w = Window.partitionBy("origin_id", "direction", F.coalesce(F.col("comid"), F.concat(F.lit("#"), F.col("line_id")))).orderBy("line_id")
    once = lines.withColumn("n", F.row_number().over(w)).where("n = 1").withColumn("km", F.round(S.line_length_km(F.col("coords")), 3))
    box = [f(F.expr(f"{g}(transform(coords, p -> p.{c}))")).alias(a) for f, g, c, a in ((F.min, "array_min", "lon", "west"), (F.min, "array_min", "lat", "south"), (F.max, "array_max", "lon", "east"), (F.max, "array_max", "lat", "north"))]
    return once.groupBy("origin_id", "direction").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("km").alias("total_km"), *box).withColumn("truncated", F.col("n_lines") > rows)


def training_table(flow: DataFrame, forcing: DataFrame, attributes: DataFrame, basins: DataFrame, key: str = "site_id") -> tuple[DataFrame, DataFrame]:
    """Daily rows of flow in mm, forcing and static attributes (area, lat, lon fall back to the basin's own), and the sites
    of the forcing that have no flow."""
    static = basins.join(attributes, key, "left").select(key, *[F.coalesce(F.col(f"attr_{c}"), F.col(c)).alias(c) for c in ("area", "lat", "lon")])
    met = forcing.join(flow.select(key, "date", "value"), [key, "date"], "left").join(static, key, "left")
    out = met.withColumn("q_mm", S.to_mm_per_day(F.col("value"), F.col("area"))).drop("value")
    return out, forcing.select(key).distinct().join(flow.select(key).distinct(), key, "left_anti")


def error_summary(errors: DataFrame, by: str = "method") -> DataFrame:
    """Of absolute percent errors: n, median and 90th as picks from the sorted list (places n // 2 and int(0.9 (n - 1))), max, within 20."""
    w = Window.partitionBy(by)
    ranked = errors.withColumn("i", F.row_number().over(w.orderBy("error")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    pick = lambda at: F.max(F.when(F.col("i") == at, F.col("error")))
    return ranked.groupBy(by).agg(F.max("n").alias("n"), pick(F.floor(F.col("n") / 2)).alias("median"), pick(F.floor(0.9 * (F.col("n") - 1))).alias("p90"), F.max("error").alias("max"), F.count_if(F.col("error") <= 20).alias("within_20"))


def class_breaks(values: DataFrame, classes: int, method: str = "quantile", value: str = "value", by: str = "layer") -> DataFrame:
    """Upper class limits: equal steps, or the values at places (i / classes) * n, cut to a whole number, less 1, each once; 2
    to 12 classes. The product is that of doubles, in this order: 7 of 10 classes of 90 values end at place 62."""
    k = min(max(classes, 2), 12)
    rows = values.where(F.col(value).isNotNull())
    if method == "equal":
        g = rows.groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        return g.select(by, F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / k).alias("breaks"))
    w = Window.partitionBy(by)
    ranked = rows.withColumn("i", F.row_number().over(w.orderBy(value)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    places = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.greatest(F.floor((i / F.lit(float(k))) * F.col("n")) - 1, F.lit(0)))
    picked = ranked.where(F.array_contains(places, F.col("i").cast("long")))
    return picked.groupBy(by).agg(F.array_sort(F.collect_set(value)).alias("breaks"))
