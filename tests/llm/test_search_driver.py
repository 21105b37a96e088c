"""What a search sends to the driver: a bounded sample, and neither vectors nor queries for a join."""

import re

import numpy as np
from pyspark.sql import functions as F

from labelweave.llm import vector_search as V


def test_vectors_do_not_go_through_the_driver(spark, monkeypatch):
    plans = {}
    real = V.staged

    def staged(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(V, "staged", staged)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8))
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = V.top_k(df, F.col("vec_id") % 50 == 0, n_pivots=5, fit_rows=40, ring_rows=16, first_rings=2).collect()
    q = np.floor(x * 256).astype(int)
    want = {(i, k + 1): (j, -s) for i in range(0, 400, 50) for k, (s, j) in enumerate(sorted((-int(q[i] @ q[j]), j) for j in range(400) if j != i)[:5])}
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want
    # before: BroadcastHashJoin [pivot, ring], whose one side is all vectors or all queries of a round
    assert plans["best"] and not any(re.search(r"BroadcastHashJoin \[pivot#\d+, ring", p) for p in plans["best"])


def test_sample_is_bounded_whatever_the_tasks(spark):
    rows = spark.range(20_000, numPartitions=50).select(F.col("id").alias("vec_id"), F.array(F.col("id")).alias("v"))
    assert 100 <= V.fit_sample(rows, 20_000, 100).count() <= 400
    assert V.fit_sample(rows, 20_000, 20_000).count() == 20_000
