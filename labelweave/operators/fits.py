"""Small models and smooths that Spark fits by sums over all rows: only sums of a few numbers reach the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.functions.mathx import clip, sigmoid
from labelweave.operators.graphs import bucketed, drop, kept


def logistic(df: DataFrame, features: list[str], target: str, l2: float = 0.01, rounds: int = 12) -> dict[str, np.ndarray]:
    """Class-balanced logistic regression on standardised features by Newton steps; each step is one aggregation. l2 spares the bias."""
    n_pos, n = df.agg(F.sum(target), F.count(F.lit(1))).first()
    n_pos = int(n_pos or 0)
    if not n:
        raise ValueError("no rows to fit")
    moments = df.agg(*[f(F.col(c).cast("double")) for c in features for f in (F.avg, F.stddev_pop)]).first()
    mean, scale = np.array(moments[0::2], float), np.array(moments[1::2], float)
    scale[scale < 1e-8] = 1.0
    x = [F.lit(1.0), *[(F.col(c) - float(m)) / float(s) for c, m, s in zip(features, mean, scale)]]
    y = F.col(target).cast("double")
    weight = F.when(y == 1, n / (2.0 * max(1, n_pos))).otherwise(n / (2.0 * max(1, n - n_pos)))
    k, beta = len(x), np.zeros(len(x))
    for _ in range(rounds):
        p = sigmoid(clip(sum((c * float(b) for c, b in zip(x, beta)), F.lit(0.0)), -30, 30))
        s = df.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], (weight * (p - y)).alias("g"), (weight * p * (1 - p)).alias("h"))
        row = s.agg(*[F.sum(F.col(f"x{i}") * F.col("g")) for i in range(k)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}") * F.col("h")) for i in range(k) for j in range(i, k)]).first()
        grad, hess, at = np.array(row[:k], float) / n, np.zeros((k, k)), k
        for i in range(k):
            for j in range(i, k):
                hess[i, j] = hess[j, i] = row[at] / n
                at += 1
        ridge = np.diag([0.0, *[l2] * (k - 1)])
        step = np.linalg.solve(hess + ridge + 1e-9 * np.eye(k), grad + ridge @ beta)
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return {"mean": mean, "scale": scale, "weights": beta}


#: Nodes of one bucket of a smooth.
BUCKET_NODES = 100_000


def laplacian_smooth(values: DataFrame, adj: DataFrame, weight: float, tolerance: float = 1e-7, rounds: int = 200) -> DataFrame:
    """(node, value, smooth): the minimum of sum (f - y)^2 + weight * sum w (f_u - f_v)^2, until a Jacobi round would move no node by more than the tolerance.

    values (node, value); adj (node, nbr, weight) in both directions. A node without neighbours keeps its value. The rounds
    are Jacobi's, sped up by Chebyshev's factors, as the eigenvalues lie within the largest share that neighbours have in a
    node: half as many or fewer. Edges and nodes lie in buckets, so a round shuffles what edges carry and writes a number a node.
    """
    buckets = -(-values.count() // BUCKET_NODES) or 1
    adj = bucketed(adj.select("node", "nbr", "weight").repartition(buckets, "nbr"), "nbr", buckets)
    degree = adj.groupBy(F.col("nbr").alias("node")).agg(F.sum("weight").alias("degree"))
    base = values.repartition(buckets, "node").join(degree, "node", "left").select("node", "value", F.coalesce("degree", F.lit(0.0)).alias("degree"))
    base = bucketed(base, "node", buckets)
    most = base.agg(F.max("degree")).first()[0] or 0.0
    rho = weight * most / (1 + weight * most)
    tables = [adj, base]
    state, old, factor = base.select("node", F.col("value").alias("f")), None, 1.0
    try:
        for k in range(rounds):
            sent = adj.join(state.select(F.col("node").alias("nbr"), "f"), "nbr").select("node", (F.col("weight") * F.col("f")).alias("x"))
            pull = sent.repartition(buckets, "node").groupBy("node").agg(F.sum("x").alias("pull"))
            j = base.join(pull, "node", "left").join(state, "node")
            jacobi = (F.col("value") + weight * F.coalesce("pull", F.lit(0.0))) / (1 + weight * F.col("degree"))
            new = jacobi
            if old is not None:
                factor = 1 / (1 - rho * rho / 2) if k == 1 else 1 / (1 - rho * rho * factor / 4)
                j, new = j.join(old.withColumnRenamed("f", "before"), "node"), F.lit(factor) * (jacobi - F.col("before")) + F.col("before")
            made = bucketed(j.select("node", new.alias("f"), F.abs(jacobi - F.col("f")).cast("float").alias("moved")), "node", buckets)
            tables.append(made)
            moved = made.agg(F.max("moved")).first()[0]
            old, state = state, made.select("node", "f")
            if moved is None or moved < tolerance:
                break
        else:
            raise RuntimeError(f"the smooth didn't settle in {rounds} rounds")
        return kept(base.join(state, "node").select("node", "value", clip(F.col("f"), 0, 1).alias("smooth")))
    finally:
        for t in tables:
            drop(t)
