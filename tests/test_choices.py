import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.operators import fits
from labelweave.plans import choices


@pytest.mark.parametrize("name", list(choices.QUERIES))
def test_query_runs(spark, sf, name):
    rows = choices.QUERIES[name](spark, sf).collect()
    assert rows
    if name == "d22_complement_subset":
        assert sorted(x["rank"] for x in rows) == list(range(1, 2 ** len(choices.NAMES) - len(choices.NAMES)))  # every subset of two or more
    if name == "d23_reliability_posterior":
        assert all(0 <= x["posterior"] <= 1 for x in rows)
    if name == "d31_stacker":
        assert np.mean([x["right"] for x in rows]) > 0.7


def test_smooth_is_the_direct_solution(spark):
    rng = np.random.default_rng(0)
    n = 40
    y, w = rng.uniform(size=n + 1), [0.5 + i / 100 for i in range(n - 1)]
    laplace = np.zeros((n + 1, n + 1))
    for i, x in enumerate(w):
        laplace[[i, i + 1], [i, i + 1]] += x
        laplace[[i, i + 1], [i + 1, i]] -= x
    want = np.linalg.solve(np.eye(n + 1) + 0.8 * laplace, y)
    values = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "node long, value double")
    adj = spark.createDataFrame([(a, b, x) for i, x in enumerate(w) for a, b in ((i, i + 1), (i + 1, i))], "node long, nbr long, weight double")
    got = {r["node"]: r["smooth"] for r in fits.laplacian_smooth(values, adj, 0.8).collect()}
    assert np.allclose([got[i] for i in range(n + 1)], want, atol=1e-6) and got[n] == pytest.approx(y[n])


def test_logistic_finds_the_optimum(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=300) > 0.8).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    m = fits.logistic(df, ["a", "b"], "y", l2=0.1)
    z = np.column_stack([np.ones(300), (x - x.mean(0)) / x.std(0)])
    sw = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    p = 1 / (1 + np.exp(-z @ m["weights"]))
    grad = z.T @ (sw * (p - y)) / 300 + np.array([0, 0.1, 0.1]) * m["weights"]
    assert np.abs(grad).max() < 1e-6
    assert df.select(F.lit(1)).count() == 300
