"""Whitening against a singular value decomposition of all rows at once."""

import numpy as np
import pytest

from freshet.llm import whitening

SF = "/root/testdata/sf0.001"


def brute(vectors):
    x = np.array([[np.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors])
    n = len(x)
    y = x - x.mean(axis=0)
    _, s, right = np.linalg.svd(y, full_matrices=False)
    whole = x.astype(object).astype(int).tolist()
    sums = [sum(c) for c in zip(*whole)]
    far = [sum((n * a - b) ** 2 for a, b in zip(row, sums)) for row in whole]
    return y, s, right, far


def test_query_is_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    y, s, right, far = brute([r.embedding for r in rows])
    got = whitening.op13_whitening(spark, SF).toPandas().sort_values(["component", "vec_id"])
    assert len(got) == 8 * len(rows) and (got.n == len(rows)).all() and got.identity_error.max() < 1e-10
    for k in range(8):
        part = got[got.component == k + 1]
        want = y @ right[k] / np.sqrt(s[k] ** 2 / len(rows))
        assert min(np.abs(part.whitened - want).max(), np.abs(part.whitened + want).max()) < 1e-8
        assert part.explained.iloc[0] == pytest.approx(s[k] ** 2 / (s**2).sum(), rel=1e-10)
        assert part.deviation.tolist() == far


def test_ill_conditioned_rows(spark):
    """Dimensions of very different scale: the Gram matrix alone loses the small ones."""
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 6)) * 10.0 ** np.array([8, 6, 4, 2, 0, -1]) @ np.linalg.qr(rng.standard_normal((6, 6)))[0]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>").repartition(7)
    y, s, right, _ = brute(v.tolist())
    got = whitening.whiten(df).toPandas().sort_values(["component", "vec_id"])
    assert got.identity_error.max() < 1e-4
    for k in range(6):
        assert got[got.component == k + 1].explained.iloc[0] == pytest.approx(s[k] ** 2 / (s**2).sum(), rel=1e-5)


def test_dependent_dimensions_have_no_variance(spark):
    rng = np.random.default_rng(4)
    a = rng.standard_normal((300, 2))
    v = np.column_stack([a, a[:, 0], np.full(300, 2.5)])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    got = whitening.whiten(df).toPandas()
    assert got[got.component <= 2].whitened.notna().all() and got[got.component > 2].whitened.isna().all()
    assert (got[got.component > 2].explained == 0).all() and got.identity_error.max() < 1e-10


def test_edge_cases(spark):
    schema = "vec_id long, embedding array<float>, n long, component string"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [3e38, 1.0]), (7, [1.0, 2.0, 3.0])]
    rows += [(8, [1.0, 2.0]), (8, [1.0, 2.0]), (None, [3.0, 5.0]), (9, [2.0, -4.0])]
    got = whitening.whiten(spark.createDataFrame([(*r, 5, "x") for r in rows], schema)).toPandas()
    assert len(got) == 8 and sorted(got.vec_id.dropna()) == [8, 8, 8, 8, 9, 9] and set(got.n) == {4}
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")).toPandas()
    assert one.whitened.isna().all() and (one.explained == 0).all() and (one.deviation == 0).all()


def test_large_numbers_stay_exact():
    x = np.array([[1 << 50, 5], [3, -7]], np.int64)
    assert whitening.deviations(x, 2, x.sum(axis=0).tolist()) == [None, None]
    y = np.array([[1 << 29, 5], [3, -7]], np.int64)
    want = [sum((2 * int(a) - int(s)) ** 2 for a, s in zip(r, y.sum(axis=0))) for r in y]
    assert whitening.deviations(y, 2, y.sum(axis=0).tolist()) == want


def test_partitions_do_not_matter(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    a, b = (whitening.whiten(df.repartition(p)).toPandas().sort_values(["vec_id", "component"]) for p in (1, 9))
    assert np.abs(a.whitened.to_numpy() - b.whitened.to_numpy()).max() < 1e-9
