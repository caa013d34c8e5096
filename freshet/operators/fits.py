"""Per-site helpers behind groupBy().applyInPandas: baseflow, drought indices, frequency fits, bootstrap, trends."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import scalars as S
from ..sources.scratch import written
from .climate import monthly_totals
from .series import K
from .signatures import water_years, year_days


#: Days that one task filters as an array; longer stretches are cut into pieces of as many.
PIECE = 1 << 15


def baseflow(series: DataFrame, alpha: float = 0.925, passes: int = 3, piece: int = PIECE, reflect: int = 30, key: str = K) -> DataFrame:
    """Lyne-Hollick baseflow of each gap-free stretch of more than `reflect` days: date, value, baseflow (within 0 and flow).

    Inside a pass the filter is an affine map of its state. Stretches of more than `piece` days are cut: every piece gives
    its map, a stretch's maps (a row a piece) are put together in order to each piece's entering state, and the pieces are
    filtered with it, all tasks at once; so no task holds a long stretch. That takes a written table a pass, while the
    DataFrame is built, if there are such stretches.
    """
    rows = series.where("value IS NOT NULL").select(key, "date", F.col("value").cast("double").alias("value"))
    rows = rows.withColumn("segment", F.date_sub("date", F.row_number().over(Window.partitionBy(key).orderBy("date"))))
    spans = rows.groupBy(key, "segment").agg(F.min("date").alias("start"), F.count(F.lit(1)).alias("n")).where(F.col("n") > reflect)
    kind = series.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, date date, value double, baseflow double"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date")
        q = frame["value"].to_numpy(float)
        return frame[[key, "date", "value"]].assign(baseflow=np.minimum(np.maximum(N.lyne_hollick(q, alpha, passes, reflect), 0), q))

    short = rows.join(spans.where(F.col("n") <= piece).select(key, "segment"), [key, "segment"])
    out = short.groupBy(key, "segment").applyInPandas(run, schema)
    long = spans.where(F.col("n") > piece)
    if long.isEmpty():
        return out
    return out.unionByName(_filtered_in_pieces(rows.join(long, [key, "segment"]), alpha, passes, piece, reflect, key))


def _one_pass(table: DataFrame, at: list[str], alpha: float, back: bool) -> DataFrame:
    """Pieces (at: key, segment, no) with `base` filtered once, in the order of `no` or against it."""
    turned = (lambda b: b[::-1]) if back else (lambda b: b)

    @F.pandas_udf("struct<first: double, last: double, end: double, length: int>")
    def edge(base: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(*N.filter_edge(turned(b), alpha), len(b)) for b in base], columns=["first", "last", "end", "length"])

    def carry(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("no", ascending=not back)
        return frame[at].assign(state=N.filter_carry(*(frame[c].to_numpy() for c in ("first", "last", "end", "length")), alpha))

    @F.pandas_udf("array<double>")
    def filtered(base: pd.Series, state: pd.Series) -> pd.Series:
        return pd.Series([turned(N.filter_piece(turned(b), s, alpha)) for b, s in zip(base, state)])

    edges = table.select(*at, edge("base").alias("e")).select(*at, "e.*")
    kinds = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in at)
    states = edges.groupBy(*at[:2]).applyInPandas(carry, f"{kinds}, state double")
    return table.join(states, at).withColumn("base", filtered("base", "state")).drop("state")


def _filtered_in_pieces(rows: DataFrame, alpha: float, passes: int, piece: int, reflect: int, key: str) -> DataFrame:
    """Rows (key, segment, start, n, date, value) of stretches of over `piece` days to key, date, value, baseflow."""
    i, n = F.datediff("date", "start"), F.col("n").cast("int")
    mirrored = F.array_compact(F.array(i, F.when((i >= 1) & (i <= reflect), -i), F.when((i >= n - 1 - reflect) & (i <= n - 2), 2 * (n - 1) - i)))
    placed = rows.select(key, "segment", "start", n.alias("n"), F.explode(mirrored).alias("i"), "value")
    no = F.floor((F.col("i") + reflect) / piece).cast("int")
    at = [key, "segment", "no"]
    packed = placed.groupBy(key, "segment", no.alias("no")).agg(F.first("start").alias("start"), F.min("i").alias("first_i"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "value"))).alias("x"))
    table = written(packed.select(*at, "start", "first_i", "n", F.col("x.value").alias("q"), F.col("x.value").alias("base")), "pieces")
    for turn in range(passes):
        table = _one_pass(table, at, alpha, back=turn % 2 == 1)
        table = written(table, "pieces") if turn + 1 < passes else table
    each = table.select(key, "start", "n", "first_i", F.posexplode(F.arrays_zip("q", "base")).alias("at", "x")).withColumn("i", F.col("first_i") + F.col("at"))
    inside = each.where((F.col("i") >= 0) & (F.col("i") < F.col("n")))
    q = F.col("x.q")
    return inside.select(key, F.date_add("start", F.col("i")).alias("date"), q.alias("value"), F.least(F.greatest(F.col("x.base"), F.lit(0.0)), q).alias("baseflow"))


def baseflow_index(parts: DataFrame, key: str = K) -> DataFrame:
    """Share of baseflow in flow, and whether the record is too short (under 365 days) to be free of bias."""
    return parts.groupBy(key).agg(F.count(F.lit(1)).alias("n_days"), F.try_divide(F.sum("baseflow"), F.sum("value")).alias("bfi")).withColumn("biased", F.col("n_days") < 365)


def smoothed_minima(series: DataFrame, block: int = 5, key: str = K) -> DataFrame:
    """UKIH baseflow (Gustard 1992): block minima, turning points below 0.9 rule, straight lines between, capped at flow."""
    w = Window.partitionBy(key).orderBy("date")
    rows = series.where("value IS NOT NULL").withColumn("block", F.floor((F.row_number().over(w) - 1) / block))
    lows = rows.groupBy(key, "block").agg(F.min(F.struct("value", "date")).alias("low"), F.count(F.lit(1)).alias("n")).where(F.col("n") == block).select(key, "block", F.col("low.value").alias("m"), F.col("low.date").alias("date"))
    b = Window.partitionBy(key).orderBy("block")
    turning = lows.withColumn("before", F.lag("m").over(b)).withColumn("after", F.lead("m").over(b)).where("0.9 * m <= before AND 0.9 * m <= after").select(key, "date", F.col("m").alias("t"))
    joined = rows.join(turning, [key, "date"], "left")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col("t").isNotNull(), F.struct("date", "t"))
    met = joined.withColumn("a", F.last(point, True).over(back)).withColumn("z", F.first(point, True).over(ahead)).where("a IS NOT NULL AND z IS NOT NULL")
    span = F.datediff("z.date", "a.date")
    line = F.when(span == 0, F.col("a.t")).otherwise(F.col("a.t") + (F.col("z.t") - F.col("a.t")) * F.datediff("date", "a.date") / span)
    return met.select(key, "date", "value", F.least(line, F.col("value")).alias("baseflow"))


def rolling_months(monthly: DataFrame, scale: int, key: str = K) -> DataFrame:
    """(year, month, total) to sums over `scale` consecutive months."""
    rows = monthly.withColumn("no", F.col("year") * 12 + F.col("month"))
    w = Window.partitionBy(key).orderBy("no").rangeBetween(1 - scale, 0)
    return rows.withColumn("rolled", F.sum("total").over(w)).withColumn("_n", F.count("total").over(w)).where(F.col("_n") == scale).select(key, "year", "month", "rolled")


def drought_index(monthly: DataFrame, scale: int = 3, kind: str = "spi", key: str = K) -> DataFrame:
    """Standardised index per calendar month; sites of scale + 12 months or fewer give none."""
    rolled = rolling_months(monthly, scale, key)
    enough = monthly.groupBy(key).agg(F.count("total").alias("_m")).where(F.col("_m") > scale + 12).select(key)
    f = {"spi": N.standardise_gamma, "spei": N.standardise_loglogistic}[kind]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(value=f(frame["rolled"].to_numpy()))

    t = monthly.schema[key].dataType.simpleString()
    out = rolled.join(enough, key, "left_semi").groupBy(key, "month").applyInPandas(run, f"`{key}` {t}, year int, month int, rolled double, value double")
    return out.withColumn("value", S.finite(F.col("value")))


def drought_from_days(series: DataFrame, scale: int = 3, kind: str = "spi", min_month_fraction: float = 1.0, key: str = K) -> tuple[DataFrame, DataFrame]:
    """The index of a daily series, of months with enough days, and the months that were left out (year, month, share)."""
    months = monthly_totals(series, min_month_fraction, key)
    return drought_index(months.where("kept").select(key, "year", "month", "total"), scale, kind, key), months.where("NOT kept").select(key, "year", "month", "share")


def drought_extremes(index: DataFrame, key: str = K) -> DataFrame:
    """Latest, driest and wettest month, the first of equals."""
    no = F.col("year") * 12 + F.col("month")
    pick = lambda agg, order: agg(F.format_string("%d-%02d", "year", "month"), order)
    rows = index.where("value IS NOT NULL")
    return rows.groupBy(key).agg(pick(F.max_by, no).alias("latest"), pick(F.min_by, F.struct("value", no)).alias("driest"), pick(F.max_by, F.struct(F.col("value"), -no)).alias("wettest"))


def flood_frequency(maxima: DataFrame, dist: str = "gumbel", periods: tuple[int, ...] = (2, 5, 10, 25, 50, 100, 200, 500), resamples: int = 200, level: float = 0.9, seed: int = 1, key: str = K) -> DataFrame:
    """Return levels fitted to complete years (Gumbel by likelihood, GEV by L-moments, log-Pearson III by moments of logs),
    with percentile intervals of a parametric-free bootstrap that always hold the estimate."""

    t, tail = np.array(periods), (1 - level) / 2

    def site_levels(site, maxima) -> tuple:
        x = np.sort(np.array(maxima, float))
        best = np.maximum.accumulate(N.return_levels(x, t, dist))
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}|{site}".encode()).digest()[:8], "big"))
        if dist == "lp3":  # all draws at once
            draws = N.log_pearson_levels(x[rng.integers(0, len(x), (resamples, len(x)))], t)
        else:
            draws = np.array([N.return_levels(rng.choice(x, len(x)), t, dist) for _ in range(resamples)])
        with np.errstate(all="ignore"):
            low, high = np.nanquantile(draws, [tail, 1 - tail], axis=0)
        return best, np.fmin(low, best), np.fmax(high, best)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            each = [site_levels(site, maxima) for site, maxima in zip(frame[key], frame["x"])]
            best, low, high = (np.concatenate([e[i] for e in each]) if each else np.zeros(0) for i in range(3))
            yield pd.DataFrame({key: frame[key].repeat(len(t)).to_numpy(), "return_period": np.tile(t, len(each)), "level": best, "ci_low": low, "ci_high": high, "n_years": frame["n_years"].repeat(len(t)).to_numpy()})

    kind = maxima.schema[key].dataType.simpleString()
    sites = maxima.where("complete").groupBy(key).agg(F.collect_list("annual_max").alias("x"), F.count(F.lit(1)).cast("int").alias("n_years")).where("n_years >= 5")
    return sites.mapInPandas(run, f"`{key}` {kind}, return_period int, level double, ci_low double, ci_high double, n_years int")


STATISTICS = {"mean": np.mean, "median": np.median, "std": lambda a, axis: np.std(a, axis=axis, ddof=1), "min": np.min, "max": np.max, "sum": np.sum}


def bootstrap(series: DataFrame, statistic: str = "mean", method: str = "iid", block: int | None = None, resamples: int = 500, level: float = 0.95, seed: int = 1, key: str = K) -> DataFrame:
    """Percentile interval of a named statistic; at least 5 values. The seed and the site fix the draws, not partitions."""
    f = STATISTICS.get(statistic) or (lambda a, axis, q=int(statistic[1:]) / 100: np.quantile(a, q, axis=axis))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x, site = frame.sort_values("date")["value"].to_numpy(float), frame[key].iloc[0]
        own = int.from_bytes(hashlib.sha256(f"{seed}|{site}".encode()).digest()[:8], "big")
        estimate, low, high = N.bootstrap_interval(x, f, method, block, resamples, level, own) if len(x) >= 5 else (np.nan,) * 3
        return pd.DataFrame({key: [site], "n": [len(x)], "estimate": [estimate], "low": [low], "high": [high]})

    t = series.schema[key].dataType.simpleString()
    out = series.where("value IS NOT NULL").select(key, "date", "value").groupBy(key).applyInPandas(run, f"`{key}` {t}, n long, estimate double, low double, high double")
    return out.withColumns({c: S.finite(F.col(c)) for c in ("estimate", "low", "high")})


#: Statistics of a series that follow from sums over its days: each sum's term by column names, and the statistic of them.
OF_SUMS = {
    "mean": (("1", "value"), lambda s: s[..., 1] / s[..., 0]),
    "std": (("1", "value", "value * value"), lambda s: np.sqrt(np.maximum(s[..., 2] - s[..., 1] ** 2 / s[..., 0], 0) / (s[..., 0] - 1))),
    "variability": (("1", "value", "value * value"), lambda s: np.sqrt(np.maximum(s[..., 2] - s[..., 1] ** 2 / s[..., 0], 0) / (s[..., 0] - 1)) / (s[..., 1] / s[..., 0])),
    "zero_fraction": (("1", "CASE WHEN value <= 0 THEN 1.0 ELSE 0.0 END"), lambda s: s[..., 1] / s[..., 0]),
    "ratio": (("value", "other"), lambda s: s[..., 0] / s[..., 1]),
}


def water_year_bootstrap(series: DataFrame, statistic: str = "mean", resamples: int = 1000, level: float = 0.9, least_years: int = 10, seed: int = 1, key: str = K) -> DataFrame:
    """Percentile interval of a statistic of OF_SUMS when whole complete water years are drawn with replacement.

    Gives n_years, estimate (over all complete years), low, high, withheld: under `least_years` complete years there is no
    interval, only the estimate and the reason. `ratio` is that of the sums of `value` and `other`, over days that have both.

    A year stands for its sums: a resample's sums are those of the years times how often each was drawn, so days are added
    up by Spark and what a site's draws see is a row a year. The seed and the site fix the draws, not partitions.
    """
    terms, f = OF_SUMS[statistic]
    names = [f"s{i}" for i in range(len(terms))]
    valued = [c for c in ("value", "other") if any(c in t for t in terms)]
    days = series.where(" AND ".join(f"{c} IS NOT NULL" for c in valued)).select(key, S.water_year(F.col("date")).alias("wy"), *[F.expr(t).cast("double").alias(n) for t, n in zip(terms, names)])
    years = days.groupBy(key, "wy").agg(F.count(F.lit(1)).alias("n_days"), *[F.sum(n).alias(n) for n in names]).where(F.col("n_days") >= 0.95 * year_days(F.col("wy")))
    packed = years.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("wy", F.array(*names).alias("s")))).alias("y"))
    sites = series.select(key).distinct().join(packed.select(key, F.col("y.s").alias("sums")), key, "left")
    tail = (1 - level) / 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for site, sums in zip(frame[key], frame["sums"]):
                s = np.array([list(r) for r in sums], float) if sums is not None else np.zeros((0, len(terms)))
                m = len(s)
                with np.errstate(all="ignore"):
                    estimate = float(f(s.sum(axis=0))) if m else np.nan
                    low = high = np.nan
                    if m >= least_years:
                        own = int.from_bytes(hashlib.sha256(f"{seed}|{site}".encode()).digest()[:8], "big")
                        drawn = np.random.default_rng(own).integers(0, m, (resamples, m))
                        counts = np.bincount((drawn + m * np.arange(resamples)[:, None]).ravel(), minlength=m * resamples).reshape(resamples, m)
                        low, high = np.nanquantile(f(counts @ s), [tail, 1 - tail])
                out.append((site, m, estimate, low, high, None if m >= least_years else f"under {least_years} complete water years"))
            yield pd.DataFrame(out, columns=[key, "n_years", "estimate", "low", "high", "withheld"])

    kind = series.schema[key].dataType.simpleString()
    out = sites.mapInPandas(run, f"`{key}` {kind}, n_years int, estimate double, low double, high double, withheld string")
    return out.withColumns({c: S.finite(F.col(c)) for c in ("estimate", "low", "high")})


def mann_kendall(points: DataFrame, key: str = K) -> DataFrame:
    """(t, value) per site to n, S, Kendall's tau, p and Theil-Sen slope; a pair table of tens of points a site."""
    rows = points.where("value IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("p"))
    pairs = rows.select(key, F.size("p").alias("n"), "p", F.posexplode("p").alias("i", "a")).select(key, "n", F.col("a"), F.explode(F.slice("p", F.col("i") + 2, F.col("n"))).alias("b"))
    sign = F.signum(F.col("b.value") - F.col("a.value"))
    slope = F.try_divide(F.col("b.value") - F.col("a.value"), F.col("b.t") - F.col("a.t"))
    out = pairs.groupBy(key, "n").agg(F.sum(sign).cast("long").alias("s"), F.median(slope).alias("slope"))
    groups = points.where("value IS NOT NULL").groupBy(key, "value").agg(F.count(F.lit(1)).alias("c")).where("c > 1").groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("ties"))

    @F.pandas_udf("double")
    def p_value(s: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([N.mann_kendall_p(int(a), int(b), [] if c is None else [int(x) for x in c]) for a, b, c in zip(s, n, ties)])

    met = out.join(groups, key, "left")
    return met.select(key, "n", "s", (F.col("s") / (F.col("n") * (F.col("n") - 1) / 2)).alias("tau"), p_value("s", "n", "ties").alias("p"), "slope")


def stationarity(series: DataFrame, least_days: int = 330, least_years: int = 5, key: str = K) -> DataFrame:
    """Trend test of water-year totals with enough non-negative days: status pass, warning (p < 0.05) or insufficient_data."""
    years = water_years(series.where("value >= 0"), least_share=0.0, key=key).where(F.col("n_days") >= least_days).select(key, F.col("wy").alias("t"), F.col("total_value").alias("value"))
    test = mann_kendall(years, key).where(F.col("n") >= least_years)
    out = series.select(key).distinct().join(test, key, "left")
    return out.withColumn("status", F.when(F.col("p").isNull(), "insufficient_data").when(F.col("p") < 0.05, "warning").otherwise("pass"))


def seasonal_kendall(monthly: DataFrame, key: str = K) -> DataFrame:
    """(year, month, value) to Sen's seasonal slope and the Kendall test with ties and covariance between seasons
    (Hirsch and Slack 1984); p is withheld where two seasons share fewer than 3 years."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        table = frame.pivot_table(index="year", columns="month", values="value", aggfunc="first")
        table = table[[c for c in table.columns if table[c].notna().sum() >= 2]]
        site, p, slope, z = frame[key].iloc[0], np.nan, np.nan, np.nan
        if table.shape[1] >= 6:
            x, t = table.to_numpy(float), table.index.to_numpy(float)
            slopes, s, var = [], 0.0, 0.0
            sign = np.sign(x[None, :, :] - x[:, None, :])  # of pairs (i, j), NaN if one is missing
            upper = np.triu_indices(len(t), 1)
            for c in range(x.shape[1]):
                d = sign[:, :, c][upper]
                ok = ~np.isnan(d)
                s += d[ok].sum()
                diff = (x[None, :, c] - x[:, None, c])[upper] / (t[None, :] - t[:, None])[upper]
                slopes.append(diff[ok])
            shared = True
            for a in range(x.shape[1]):
                for b in range(x.shape[1]):
                    both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
                    n = int(both.sum())
                    if a == b:
                        counts = np.unique(x[both, a], return_counts=True)[1]
                        var += (n * (n - 1) * (2 * n + 5) - (counts * (counts - 1) * (2 * counts + 5)).sum()) / 18
                        continue
                    shared = shared and n >= 3
                    ka = np.nansum(sign[:, :, a][np.ix_(both, both)][np.triu_indices(n, 1)] * sign[:, :, b][np.ix_(both, both)][np.triu_indices(n, 1)])
                    ra, rb = (pd.Series(x[both, c]).rank().to_numpy() for c in (a, b))
                    var += (ka + 4 * (ra * rb).sum() - n * (n + 1) ** 2) / 3
            slope = float(np.median(np.concatenate(slopes))) if slopes else np.nan
            if shared and var > 0 and len(t) >= 3:
                z = 0.0 if s == 0 else (s - np.sign(s)) / np.sqrt(var)
                p = 2 * (1 - N.normal_cdf(abs(z)))
        return pd.DataFrame({key: [site], "slope": [slope], "z": [z], "p": [p]})

    t = monthly.schema[key].dataType.simpleString()
    out = monthly.where("value IS NOT NULL").select(key, "year", "month", "value").groupBy(key).applyInPandas(run, f"`{key}` {t}, slope double, z double, p double")
    return out.withColumns({c: S.finite(F.col(c)) for c in ("slope", "z", "p")})
