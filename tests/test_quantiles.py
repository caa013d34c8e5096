"""Exact quantiles by selection against sorting."""

import random

import numpy as np
import pytest

from freshet.operators import grid, quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]


def values(kind, n, rng):
    if kind == "ties":
        return [float(rng.choice([1, 2, 2, 3])) for _ in range(n)]
    if kind == "scales":
        return [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(n)]
    if kind == "near":
        return [1.0 + rng.randrange(40) * 2.0**-52 for _ in range(n)]
    if kind == "least":
        return [rng.choice([0.0, 5e-324, -5e-324, 1e-323]) for _ in range(n)]
    if kind == "wide":
        return [rng.choice([-1.7e308, 1.7e308, 0.0, 1.0, 2.0]) for _ in range(n)]
    return [rng.gauss(0, 1) for _ in range(n)]


def test_selection_is_sorting(spark):
    rng = random.Random(3)
    data = {(k, z): values(k, n, rng) for k, n in (("gauss", 700), ("ties", 300), ("scales", 300), ("near", 300), ("least", 90), ("wide", 200)) for z in ("x", "y")}
    data["one", "x"] = [5.5]
    rows = [(k, z, v) for (k, z), vs in data.items() for v in [*vs, None, float("nan"), float("inf")]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "kind string, zone string, value double").repartition(5)
    got = {(r.kind, r.zone): r for r in quantiles.exact_quantiles(df, ["kind", "zone"], "value", SHARES, at_once=0, bins=256).collect()}
    assert got.keys() == data.keys()
    for k, vs in data.items():
        vs = sorted(vs)
        h = [s * (len(vs) - 1) for s in SHARES]
        want = [vs[int(x)] if x == int(x) or vs[int(x)] == vs[int(x) + 1] else (1 - (x - int(x))) * vs[int(x)] + (x - int(x)) * vs[int(x) + 1] for x in h]
        assert got[k].n == len(vs) and got[k].quantiles == pytest.approx(want, rel=1e-12)
    both = quantiles.exact_quantiles(df.where("kind <> 'wide'"), ["kind", "zone"], "value", SHARES, at_once=500).collect()
    for r in both:
        assert r.quantiles == pytest.approx(got[r.kind, r.zone].quantiles, rel=1e-9)


def test_groups_without_values(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("b", 1.0), ("b", 3.0)], "zone string, value double")
    for at_once in (0, 10):
        got = {r.zone: r for r in quantiles.exact_quantiles(df, ["zone"], "value", [0.5], at_once=at_once).collect()}
        assert got["b"].quantiles == [2.0] and got["a"].n == 0 and not (got["a"].quantiles or [None])[0]
    assert quantiles.exact_quantiles(df.where("false"), ["zone"], "value", [0.5]).collect() == []


def test_statistics_of_large_zones_are_those_of_small_ones(spark):
    rng = np.random.default_rng(1)
    cells = spark.createDataFrame([(str(i % 2), i // 40, i % 40, float(v)) for i, v in enumerate(rng.gamma(2.0, 3.0, 1600))], "basin_id string, row int, col int, hand double")
    small, large = (sorted(map(tuple, grid.pixel_statistics(cells, "hand", ["basin_id"], at_once).collect())) for at_once in (10_000, 100))
    assert [r[0] for r in small] == ["0", "1"] and all(a[1:] == pytest.approx(b[1:], rel=1e-12) for a, b in zip(small, large))
    zones = cells.where("row < 20").select("basin_id", "row", "col")
    small, large = (sorted(map(tuple, grid.zonal(cells, zones, "hand", ["basin_id"], at_once).collect())) for at_once in (10_000, 100))
    assert all(a[1:] == pytest.approx(b[1:], rel=1e-12) for a, b in zip(small, large))
