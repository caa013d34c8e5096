"""Queries with functions of the caller."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import custom
from .registry import gappy, query


@query("udf_fold_drawdown", "SELECT site_id, count(*) AS n, round(max(m - value), 4) AS drawdown FROM (SELECT *, max(value) OVER (PARTITION BY site_id ORDER BY date) AS m FROM gappy WHERE value IS NOT NULL) GROUP BY site_id")
def drawdown(spark, d):
    """The greatest fall below what a site had reached before, by a fold that keeps three numbers a site."""

    def step(state, columns):
        n, top, fall = state
        v = columns["value"]
        tops = np.maximum.accumulate(np.append(top, v))[1:]
        return n + len(v), float(tops[-1]), max(fall, float((tops - v).max()))

    rows = gappy(spark, d).where("value IS NOT NULL")
    out = custom.fold_sites(rows, ["value"], lambda: (0, -np.inf, -np.inf), step, lambda s: {"n": s[0], "drawdown": s[2]}, "site_id string, n long, drawdown double")
    return out.withColumn("drawdown", F.round("drawdown", 4))


@query("udf_site_peaks", "SELECT site_id, count(*) FILTER (value > a AND value > z) AS peaks, CAST(max(value) FILTER (value > a AND value > z) AS DOUBLE) AS highest FROM (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS z FROM gappy WHERE value IS NOT NULL WINDOW w AS (PARTITION BY site_id ORDER BY date)) GROUP BY site_id")
def peaks(spark, d):
    """Days above both of their neighbours, by a function of a site's whole frame."""

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        v = frame["value"].to_numpy()
        at = v[1:-1][(v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])]
        return pd.DataFrame({"site_id": frame["site_id"].iloc[:1], "peaks": [len(at)], "highest": [at.max() if len(at) else np.nan]})

    rows = gappy(spark, d).where("value IS NOT NULL")
    return custom.per_site(rows, count, "site_id string, peaks long, highest double").withColumn("highest", F.nanvl("highest", F.lit(None).cast("double")))
