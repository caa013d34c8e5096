"""Functions of the caller: frames and folds, and what is checked of them."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from freshet.operators import custom

D = dt.date(2000, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(f"s{s}", D + dt.timedelta(i), float((i * 37 + s) % 101)) for s in range(7) for i in range(50 * s + 1)] + [(None, D, 5.0), ("gap", D, None)]
    return spark.createDataFrame(data, "site_id string, date date, value double").repartition(5)


def weights(state, columns):
    """Depends on the order: each value halves what came before it."""
    for v in columns["value"]:
        state = (state[0] / 2 + v, state[1] + 1)
    return state


@pytest.mark.parametrize("batch", [3, 10_000])
def test_fold_is_in_order_and_whole(spark, rows, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {r.site_id: (r.level, r.n) for r in custom.fold_sites(rows.fillna(0.0, ["value"]), ["value"], lambda: (0.0, 0), weights, lambda s: {"level": s[0], "n": s[1]}, "site_id string, level double, n long").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for r in sorted(rows.fillna(0.0, ["value"]).collect(), key=lambda r: (r.site_id or "", r.date)):
        a, n = want.get(r.site_id, (0.0, 0))
        want[r.site_id] = (a / 2 + r.value, n + 1)
    assert got == want and len(got) == 9


def test_frame_of_a_site(rows):
    def last(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(frame)], "site_id": frame["site_id"].iloc[:1], "rising": [bool((np.diff(frame["date"].map(dt.date.toordinal)) > 0).all())]})

    got = {r.site_id: (r.n, r.rising) for r in custom.per_site(rows, last, "site_id string, n long, rising boolean").collect()}
    assert got == {f"s{s}": (50 * s + 1, True) for s in range(7)} | {None: (1, True), "gap": (1, True)}


def test_what_is_declared_must_come(rows):
    with pytest.raises(ValueError, match="must declare the key"):
        custom.per_site(rows, lambda f: f, "n long")
    with pytest.raises(Exception, match="declared are"):
        custom.fold_sites(rows, ["value"], lambda: 0, lambda s, c: s + 1, lambda s: {"m": s}, "site_id string, n long").collect()
    with pytest.raises(Exception, match="declared are"):
        custom.per_site(rows, lambda f: f, "site_id string, n long").collect()


def test_no_rows(spark):
    empty = spark.createDataFrame([], "site_id string, date date, value double")
    assert custom.fold_sites(empty, ["value"], lambda: 0, lambda s, c: s, lambda s: {"n": s}, "site_id string, n long").collect() == []
