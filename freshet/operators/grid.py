"""Cell tables (basin_id, row, col, bands): depths, classes, masks, scores, lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import AT_ONCE, exact_quantiles

B = "basin_id"
AT = [B, "row", "col"]


def remap_codes(cells: DataFrame, table: DataFrame, code: str = "lulc") -> DataFrame:
    """Codes through a (code, mapped) table that is small by nature; unmapped codes become NULL."""
    t = F.broadcast(table.withColumnRenamed("code", "_code"))
    return cells.join(t, F.round(cells[code]).cast("int") == t["_code"], "left").drop("_code")


def with_quantiles(rows: DataFrame, value: str, by: list[str], sums: list[Column], names: dict[str, float], at_once: int = AT_ONCE) -> DataFrame:
    """Sums of each group beside its exact quantiles by name; a group of any size, see `exact_quantiles`."""
    asked = exact_quantiles(rows, by, value, list(names.values()), at_once)
    held = asked.select(*[F.col(c).alias(f"_{c}") for c in by], *[F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(names)])
    met = rows.groupBy(*by).agg(*sums)
    same = [met[c].eqNullSafe(held[f"_{c}"]) for c in by]
    return met.join(held, reduce(lambda a, b: a & b, same)).drop(*[f"_{c}" for c in by])


def zonal(cells: DataFrame, zones: DataFrame, value: str, by: list[str], at_once: int = AT_ONCE) -> DataFrame:
    """Mean, sum, median, min and max of the cells of each zone, zones of any size."""
    v = F.col(value)
    inside = cells.join(zones, AT, "left_semi").select(*by, value)
    out = with_quantiles(inside, value, by, [F.avg(v).alias("mean"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max")], {"median": 0.5}, at_once)
    return out.select(*by, "mean", "sum", "median", "min", "max")


def pixel_statistics(pixels: DataFrame, value: str, by: list[str], at_once: int = AT_ONCE) -> DataFrame:
    """Count, mean, deviation and quantiles of the pixels of each group, groups of any size."""
    v = F.col(value)
    quantiles = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    out = with_quantiles(pixels, value, by, [F.count(v).alias("n_valid"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")], quantiles, at_once)
    return out.select(*by, "n_valid", "mean", "median", "std", "p10", "p25", "p75", "p90")


def composite(pixels: DataFrame, value: str) -> DataFrame:
    """Median over time of each cell."""
    return pixels.groupBy(*AT).agg(F.median(value).alias("composite"))


def contingency(cells: DataFrame, model: str = "model", reference: str = "reference", by: str = B) -> DataFrame:
    """Scores of a mask of 0 and 1 against another where both are valid (not NULL); other codes raise an error."""
    m, r = F.col(model), F.col(reference)
    ok = m.isNotNull() & r.isNotNull()
    binary = F.when(ok & ~(m.isin(0, 1) & r.isin(0, 1)), F.raise_error(F.lit("a valid cell is neither 0 nor 1"))).otherwise(F.lit(True))
    rows = cells.where(F.coalesce(binary.cast("boolean"), F.lit(True)))
    g = rows.groupBy(by).agg(F.count_if(ok & (m == 1) & (r == 1)).alias("hits"), F.count_if(ok & (m == 0) & (r == 1)).alias("misses"), F.count_if(ok & (m == 1) & (r == 0)).alias("false_alarms"), F.count_if(ok & (m == 0) & (r == 0)).alias("correct_negatives"), F.count_if(~ok).alias("excluded"))
    h, s, f = F.col("hits"), F.col("misses"), F.col("false_alarms")
    return g.withColumns({"csi": F.try_divide(h, h + s + f), "pod": F.try_divide(h, h + s), "far": F.try_divide(f, h + f), "bias": F.try_divide(h + f, h + s)})


def band_statistics(depths: DataFrame, cell_m: float, by: list[str]) -> DataFrame:
    """Wet area in km2 and greatest depth."""
    return depths.groupBy(*by).agg((F.count_if(F.col("depth") > 0) * (cell_m * cell_m / 1e6)).alias("area_km2"), F.max("depth").alias("max_depth"))


def stage_lookup(cells: DataFrame, steps: int = 11) -> DataFrame:
    """Cells at or below each of `steps` stages from 0 to a basin's greatest height: each cell is counted once, at the
    first stage that reaches it, and the counts are summed up."""
    top = cells.groupBy(B).agg(F.max("hand").alias("top")).where("top > 0")
    stages = top.select(B, F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"), "top").withColumn("stage", F.col("top") * F.col("step") / (steps - 1))
    first = F.greatest(F.ceil(F.round(F.col("hand") / F.col("top") * (steps - 1), 9)), F.lit(0)).cast("int")
    counts = cells.where("hand IS NOT NULL").join(top, B).groupBy(B, first.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    run = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(B).orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return stages.join(counts, [B, "step"], "left").select(B, "step", "stage", run.alias("cells"))


def exposure(cells: DataFrame, cell_m: float, density: float = 45.0) -> DataFrame:
    """People on wet cells: the population there, or area by density in basins without population cells."""
    wet = F.col("depth") > 0
    g = cells.groupBy(B).agg(F.sum(F.when(wet, F.coalesce("population", F.lit(0.0))).otherwise(0.0)).alias("p"), F.count("population").alias("n"), (F.count_if(wet) * (cell_m * cell_m / 1e6)).alias("area_km2"))
    return g.select(B, "area_km2", F.when(F.col("n") > 0, F.col("p")).otherwise(F.col("area_km2") * density).alias("exposed"), F.when(F.col("n") > 0, "population").otherwise("density").alias("basis"))


def class_fractions(cells: DataFrame, code: str) -> DataFrame:
    """Share of each class of a basin's valid cells, and whether it is the largest (of equals the smaller code)."""
    n = cells.where(F.col(code).isNotNull()).groupBy(B, code).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(B)
    order = F.row_number().over(w.orderBy(F.desc("n"), code))
    return n.select(B, code, "n", (F.col("n") / F.sum("n").over(w)).alias("fraction"), (order == 1).alias("dominant"))


def hydrologic_group(raw: Column, drained: bool) -> Column:
    """Dual soil groups such as A/D by drainage."""
    parts = F.split(F.upper(raw), "/")
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(0 if drained else 1))).otherwise(F.get(parts, F.lit(0)))


#: TR-55 curve numbers (good condition) by class, for soil groups A, B, C, D.
CURVE_NUMBERS = {"open_water": (100, 100, 100, 100), "developed": (77, 85, 90, 92), "forest": (30, 55, 70, 77), "shrub": (30, 48, 65, 73), "grass": (39, 61, 74, 80), "crops": (67, 78, 85, 89), "wetland": (100, 100, 100, 100), "barren": (77, 86, 91, 94)}


def curve_numbers(landcover: DataFrame, soils: DataFrame, drained: bool = False) -> DataFrame:
    """Land cover (class) by soil group (hsg) to cn on common cells; unknown classes and groups give NULL."""
    spark = landcover.sparkSession
    table = spark.createDataFrame([(c, "ABCD"[i], n) for c, row in CURVE_NUMBERS.items() for i, n in enumerate(row)], "class string, hsg string, cn int")
    met = landcover.join(soils.withColumn("hsg", hydrologic_group(F.col("hsg"), drained)), AT)
    return met.join(F.broadcast(table), ["class", "hsg"], "left")


def curve_number_statistics(cells: DataFrame, valid: str = "valid", at_once: int = AT_ONCE) -> DataFrame:
    """Mean, median, least, greatest, deviation and percentiles of cn over a basin's polygon (valid cells) and over the whole
    extent of its raster; a row for each basis."""
    both = cells.where(valid).select(B, F.lit("polygon").alias("basis"), "cn").unionByName(cells.select(B, F.lit("raster_extent").alias("basis"), "cn"))
    v = F.col("cn")
    sums = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std")]
    out = with_quantiles(both, "cn", [B, "basis"], sums, {"median": 0.5, "p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9}, at_once)
    return out.select(B, "basis", "n", "mean", "median", "min", "max", "std", "p10", "p25", "p75", "p90")


def mean_texture(cells: DataFrame) -> DataFrame:
    """Mean sand, silt and clay of a basin's cells that have all three."""
    parts = ("sand", "silt", "clay")
    return cells.where(" AND ".join(f"{c} IS NOT NULL" for c in parts)).groupBy(B).agg(*[F.avg(c).alias(c) for c in parts], F.count(F.lit(1)).alias("n"))


def nearest_epoch(rows: DataFrame, epochs: list[int], year: str = "year") -> DataFrame:
    """The epoch nearest to a year, the earlier of two as near."""
    options = F.array_sort(F.array(*[F.struct(F.abs(F.col(year) - e).alias("away"), F.lit(e).alias("epoch")) for e in epochs]))
    return rows.withColumn("epoch", F.get(options, F.lit(0))["epoch"])


#: Cells of a stretch of a mask that one task encodes.
BLOCK = 1 << 16


def mask_runs(cells: DataFrame, columns: int, by: str = B, value: str = "value", block: int = BLOCK) -> DataFrame:
    """Row-major runs of a full grid's mask: by, start (place of the first cell, from 0), n, value.

    The grid is cut into stretches of `block` cells, whose runs are found side by side. A stretch is told the value before
    it and where the next run begins after it by a table of one row a stretch, so runs pass over borders whole, and no
    window or row holds a basin's cells. A NULL value is a value of its own.
    """
    at = (F.col("row").cast("long") * columns + F.col("col")).alias("start")
    rows = cells.select(by, at, F.col(value).alias("value")).withColumn("block", F.floor(F.col("start") / block))
    inside, along = Window.partitionBy(by, "block").orderBy("start"), Window.partitionBy(by).orderBy("block")
    blocks = rows.groupBy(by, "block").agg(F.max("start").alias("last"), F.max_by(F.struct("value"), "start").alias("tail"))
    before = blocks.select(by, "block", F.lag("tail").over(along).alias("before"))
    own = F.struct("value")
    previous = F.coalesce(F.lag(own).over(inside), F.col("before"))
    starts = rows.join(before, [by, "block"]).withColumn("previous", previous).where(F.col("previous").isNull() | ~F.col("value").eqNullSafe(F.col("previous.value")))
    firsts = starts.groupBy(by, "block").agg(F.min("start").alias("begins"))
    later = along.rowsBetween(1, Window.unboundedFollowing)
    ends = blocks.join(firsts, [by, "block"], "left").select(by, "block", F.coalesce(F.first("begins", True).over(later), F.max("last").over(Window.partitionBy(by)) + 1).alias("until"))
    each = starts.select(by, "block", "start", "value", F.lead("start").over(inside).alias("next")).join(ends, [by, "block"])
    return each.select(by, "start", (F.coalesce("next", "until") - F.col("start")).alias("n"), "value")


def cells_of_runs(runs: DataFrame, columns: int, by: str = B, block: int = BLOCK) -> DataFrame:
    """Cells (row, col, value) of runs; a long run is dealt out by stretches of `block` cells."""
    end = F.col("start") + F.col("n")
    parts = runs.where("n > 0").select(by, "start", end.alias("end"), "value", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block")).repartition(by, "block")
    low, high = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("end"), (F.col("block") + 1) * block)
    each = parts.select(by, "value", F.explode(F.sequence(low, high - 1)).alias("at"))
    return each.select(by, F.floor(F.col("at") / columns).cast("int").alias("row"), (F.col("at") % columns).cast("int").alias("col"), "value")


def encode_mask(cells: DataFrame, columns: int, by: str = B, value: str = "value", block: int = BLOCK) -> DataFrame:
    """Row-major run lengths of a full grid's mask in one row: counts as [run, value, run, value, ...]. The row holds all of a
    basin's runs; `mask_runs` gives a row a run."""
    runs = mask_runs(cells, columns, by, value, block)
    pairs = F.array_sort(F.collect_list(F.struct("start", F.col("n").cast("int").alias("n"), F.col("value").cast("int").alias("v"))))
    return runs.groupBy(by).agg(F.flatten(F.transform(pairs, lambda x: F.array(x["n"], x["v"]))).alias("counts"))


def decode_mask(masks: DataFrame, columns: int, by: str = B) -> DataFrame:
    """Cells (row, col, value) of run lengths."""
    pairs = F.transform(F.sequence(F.lit(0), (F.size("counts") / 2).cast("int") - 1), lambda i: F.array_repeat(F.get("counts", 2 * i + 1), F.get("counts", 2 * i)))
    each = masks.select(by, F.posexplode(F.flatten(pairs)).alias("at", "value"))
    return each.select(by, F.floor(F.col("at") / columns).cast("int").alias("row"), (F.col("at") % columns).cast("int").alias("col"), "value")


def surrogate_samples(summaries: DataFrame, inputs: DataFrame, targets: DataFrame, columns: int, cell_m: float, by: str = "sample_id") -> DataFrame:
    """Training samples: a summary's features (discharge, stage, area), the input mask and the target mask as run lengths.

    summaries: by, discharge_m3s, stage_m, area_km2, method, status. inputs, targets: full grids (by, row, col, value).
    Samples without one of the masks are left out.
    """
    shape = inputs.groupBy(by).agg((F.max("row") + 1).alias("_rows"))
    masks = encode_mask(inputs, columns, by).withColumnRenamed("counts", "input_counts").join(encode_mask(targets, columns, by).withColumnRenamed("counts", "target_counts"), by).join(shape, by)
    met = summaries.join(masks, by)
    features = F.struct("discharge_m3s", "stage_m", "area_km2", F.lit(float(cell_m)).alias("cell_m"), F.array("_rows", F.lit(columns)).alias("shape"))
    return met.select(by, features.alias("features"), "input_counts", F.struct("method", "status", F.col("target_counts").alias("counts")).alias("target"))


def dilate(mask: DataFrame, grid: DataFrame, times: int = 1) -> DataFrame:
    """Cells of the grid within `times` king's moves of a mask cell, one join whatever the number of times."""
    steps = F.sequence(F.lit(-times), F.lit(times))
    near = mask.select(B, F.col("row").alias("r"), F.col("col").alias("c")).withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps))
    return grid.join(near.select(B, (F.col("r") + F.col("dr")).alias("row"), (F.col("c") + F.col("dc")).alias("col")).distinct(), AT, "left_semi").select(*AT)


def best_dilation(mask: DataFrame, target: DataFrame, grid: DataFrame, most: int = 4) -> DataFrame:
    """The number of dilations whose result scores best (CSI) against the target; of equals the larger."""
    steps = F.sequence(F.lit(-most), F.lit(most))
    near = mask.select(B, F.col("row").alias("r"), F.col("col").alias("c")).withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps))
    away = near.select(B, (F.col("r") + F.col("dr")).alias("row"), (F.col("c") + F.col("dc")).alias("col"), F.greatest(F.abs("dr"), F.abs("dc")).alias("d")).groupBy(*AT).agg(F.min("d").alias("d"))
    met = grid.select(*AT).join(away, AT, "left").join(target.select(*AT, F.lit(1).alias("t")), AT, "left")
    each = met.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("m", F.coalesce(F.col("d") <= F.col("k"), F.lit(False))).withColumn("t", F.col("t").isNotNull())
    g = each.groupBy(B, "k").agg(F.try_divide(F.count_if(F.col("m") & F.col("t")), F.count_if(F.col("m") | F.col("t"))).alias("csi"))
    return g.groupBy(B).agg(F.max(F.struct("csi", "k")).alias("x")).select(B, F.col("x.k").alias("iterations"), F.col("x.csi").alias("csi"))


def manning_stage(discharge: Column, width: Column, slope: Column, roughness: Column, top: float = 50.0, steps: int = 60) -> Column:
    """Depth of a rectangular channel that carries the discharge, by bisection between 0 and top, which is also the most.

    Widths under 1 m, slopes under 1e-6 and roughness under 0.01 count as these."""
    width, slope, roughness = F.greatest(width, F.lit(1.0)), F.greatest(slope, F.lit(1e-6)), F.greatest(roughness, F.lit(0.01))

    def flow(depth: Column) -> Column:
        area = width * depth
        return area * F.pow(area / (width + 2 * depth), 2 / 3) * F.sqrt(slope) / roughness

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(top).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        return F.struct(F.when(flow(mid) < discharge, mid).otherwise(s["lo"]).alias("lo"), F.when(flow(mid) < discharge, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when(discharge <= 0, 0.0).when(flow(F.lit(top)) < discharge, F.lit(top)).otherwise(found)


def channel_geometry(cells: DataFrame, cell_m: float) -> DataFrame:
    """Width and slope at a basin's outlet, its cell of greatest accumulation: central differences of the neighbours, one-sided at an edge."""
    outlet = cells.groupBy(B).agg(F.max(F.struct("acc", -F.col("row"), -F.col("col"))).alias("o")).select(B, F.col("o.acc").alias("acc"), (-F.col("o").getItem("col2")).alias("r"), (-F.col("o").getItem("col3")).alias("c"))
    near = cells.select(B, "row", "col", "elev").join(outlet, B).where("abs(row - r) + abs(col - c) <= 1")
    pick = lambda dr, dc: F.max(F.when((F.col("row") - F.col("r") == dr) & (F.col("col") - F.col("c") == dc), F.col("elev")))
    g = near.groupBy(B).agg(F.first("acc").alias("acc"), pick(0, 0).alias("e"), pick(-1, 0).alias("n"), pick(1, 0).alias("s"), pick(0, -1).alias("w"), pick(0, 1).alias("x"))

    def gradient(a: str, b: str) -> Column:
        both = (F.col(b) - F.col(a)) / (2 * cell_m)
        return F.coalesce(both, (F.col(b) - F.col("e")) / cell_m, (F.col("e") - F.col(a)) / cell_m, F.lit(0.0))

    slope = F.sqrt(F.pow(gradient("n", "s"), 2) + F.pow(gradient("w", "x"), 2))
    return g.select(B, F.greatest(cell_m * F.sqrt("acc") * 0.5, F.lit(2.0 * cell_m)).alias("width"), F.greatest(slope, F.lit(0.001)).alias("slope"))


def shape_ratios(area: Column, perimeter: Column, length: Column, relief: Column, stream_length: Column) -> dict[str, Column]:
    """Basin form after Horton (1932), Miller (1953) and Schumm (1956); km and km2, relief in metres."""
    return {"form_factor": area / (length * length), "circularity": 4 * F.pi() * area / (perimeter * perimeter), "elongation": 2 * F.sqrt(area / F.pi()) / length, "relief_ratio": relief / (1000 * length), "drainage_density": stream_length / area}
