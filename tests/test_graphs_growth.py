import random

import numpy as np

from labelweave.operators import fits, graphs


def _both(spark, pairs):
    rows = [(a, b, w) for x, y, w in pairs for a, b in ((x, y), (y, x))]
    return spark.createDataFrame(rows, "node long, nbr long, weight double")


def test_components_contract_a_long_path(spark, monkeypatch):
    """A path of ordered numbers, rings, a star and single nodes: the tables written shrink (before: all nodes were written twice a round)."""
    written, plain = [], graphs.kept

    def counted(df):
        out = plain(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(graphs, "kept", counted)
    n = 600
    pairs = [(i, i + 1, 1.0) for i in range(n - 1)] + [(1000 + i, 1000 + (i + 1) % 7, 1.0) for i in range(7)] + [(2000, 2001 + i, 1.0) for i in range(50)]
    nodes = spark.createDataFrame([(p,) for a, b, _ in pairs for p in (a, b)] + [(5000,)], "node long")
    got = {r["node"]: r["component"] for r in graphs.components(_both(spark, pairs), nodes).collect()}
    assert got == {p: 0 if p < 1000 else 1000 if p < 2000 else 2000 if p < 5000 else 5000 for p in got} and len(got) == n + 7 + 51 + 1
    assert sum(written) < 8 * len(got)


def test_smooth_is_exact_in_fewer_rounds(spark, monkeypatch):
    """Against a dense solve; the tables written are few (before: a round for each 0.63 of the error, on such weights more than 30)."""
    made, plain = [], fits.bucketed
    monkeypatch.setattr(fits, "bucketed", lambda *a: made.append(1) or plain(*a))
    rng = random.Random(3)
    pairs = [(i, i + 1, 1.0) for i in range(119)] + [(i, i + 40, round(rng.random(), 3)) for i in range(0, 80, 3)]
    values = [(i, rng.random()) for i in range(125)]
    out = {r["node"]: r["smooth"] for r in fits.laplacian_smooth(spark.createDataFrame(values, "node long, value double"), _both(spark, pairs), 0.8).collect()}
    a = np.zeros((125, 125))
    for x, y, w in pairs:
        a[x, y] = a[y, x] = w
    want = np.linalg.solve(np.eye(125) + 0.8 * (np.diag(a.sum(0)) - a), np.array([v for _, v in values]))
    assert max(abs(out[i] - want[i]) for i in range(125)) < 5e-7
    assert len(made) < 24
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("labelweave_")]
