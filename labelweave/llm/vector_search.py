"""Exact top-k inner products with a pivot-distance index.

Vectors are lifted by one component, sqrt(M^2 - |x|^2) with M the largest norm, so that the nearest vector to a query
(lifted by 0) is the one with the largest inner product. Each vector is keyed by its nearest pivot and its distance
from it; the vectors of a pivot, sorted by that distance, are cut into annuli (rings). By the triangle inequality a
vector of a ring with distances [near, far] from pivot p can't be nearer to q than max(d(q, p) - far, near - d(q, p)).
Queries visit rings in the order of that bound, more of them in each round, and stop at the first ring whose bound is
beyond their k-th best. Nothing that could be a result is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.llm.common import staged

BLOCK = "pivot int, ring int, near double, far double, ids binary, vectors binary"
#: Queries that one block of a round holds.
QUERY_BLOCK = 512


def quantised(embedding: str = "embedding") -> Column:
    """floor(256 x) of every component as longs; null for a vector that is null or holds a null or non-finite number."""
    x = F.col(embedding)
    fine = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(v.cast("double") * 256)))


def _lengthened(x: list, dim: int) -> np.ndarray:
    out = np.zeros((len(x), dim), np.int64)
    for i, v in enumerate(x):
        out[i, : len(v)] = v
    return out


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    f = x.astype(np.float64)
    rest = np.sqrt(np.maximum(0.0, top - (f * f).sum(1)))
    return np.concatenate([f, rest[:, None]], 1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0.0))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floating point where that is exact, else in integers."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    return np.rint(q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if bound < 2**52 else q @ x.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def build_index(vectors: DataFrame, pivots: np.ndarray, top: float, dim: int, ring_rows: int) -> DataFrame:
    """vectors (vec_id, v) as blocks of one ring each: pivot, ring, the span of distances, ids and vectors.

    A pivot's rings hold about ring_rows vectors: their borders are percentiles of all distances to the pivot. Vectors at one
    distance from the pivot - copies - share a ring, however many; a ring's vectors are dealt over blocks of at most ring_rows.
    """

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _lifted(pivots, top)
        for batch in batches:
            x = _lengthened(batch.column(1).to_pylist(), dim)
            d = _distances(_lifted(x, top), p)
            near = d.argmin(1)
            rows = [r.tobytes() for r in x.astype("<i8")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.int32()), pa.array(d[np.arange(len(x)), near], pa.float64()), pa.array(rows, pa.binary())], ["vec_id", "pivot", "distance", "v"])

    keyed = staged(vectors.mapInArrow(key, "vec_id long, pivot int, distance double, v binary"), "pivot-keys")
    # ring borders: cells of equal width with their counts, bounded by pivots x 1024, give cuts of about ring_rows
    span = keyed.groupBy("pivot").agg(F.min("distance").alias("low"), F.max("distance").alias("high"))
    cell = F.least(F.lit(1023), F.floor((F.col("distance") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-9)) * 1024)).cast("int")
    celled = keyed.join(F.broadcast(span), "pivot").withColumn("cell", cell)  # span: a row for each pivot
    counts = celled.groupBy("pivot", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("pivot").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    rings = counts.withColumn("ring", F.floor(F.coalesce(before, F.lit(0)) / ring_rows).cast("int"))
    # a ring of copies may be far larger than ring_rows: parts of it are blocks of their own
    sizes = rings.groupBy("pivot", "ring").agg(F.sum("n").alias("ring_n"))
    rings = rings.join(sizes, ["pivot", "ring"]).select("pivot", "cell", "ring", F.ceil(F.col("ring_n") / ring_rows).cast("int").alias("parts"))
    dealt = celled.join(F.broadcast(rings), ["pivot", "cell"])  # pivots x 1024 rows at most
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    packed = dealt.groupBy("pivot", "ring", "part").applyInArrow(_pack, BLOCK)
    return staged(packed, "pivot-blocks")


def _pack(table: pa.Table) -> pa.Table:
    d = table.column("distance").to_numpy()
    ids = table.column("vec_id").to_numpy().astype("<i8")
    one = lambda name: table.column(name)[0].as_py()
    return pa.table({"pivot": pa.array([one("pivot")], pa.int32()), "ring": pa.array([one("ring")], pa.int32()), "near": [float(d.min())], "far": [float(d.max())], "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([b"".join(table.column("v").to_pylist())], pa.binary())})


def fit_sample(rows: DataFrame, n: int, most: int) -> DataFrame:
    """Of n distinct rows (vec_id, v) about twice as many as `most`, by a hash: tasks send no more than these to the driver, however many tasks there are."""
    share = min(1.0, 2 * most / n)
    return rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 40)) < int(share * (1 << 40))).select("vec_id", "v")


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    n_pivots: int = 64,
    fit_rows: int = 4096,
    ring_rows: int = 512,
    first_rings: int = 8,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k largest integer inner products with other rows.

    Components x count as floor(256 x); ties go to the smaller vec_id. Vectors that are null or hold a null or
    non-finite component take no part, nor do rows without an id; shorter vectors count as padded with zeros. Rows that
    repeat an id and a vector count once; rows of one id but different vectors are candidates each, never for a query of
    that id, whose query is the smallest of its vectors. Fewer than k candidates give as many rows; an empty table gives none. Products must fit in a long.
    The pivots are n_pivots of at most fit_rows vectors chosen by a hash; all vectors are indexed, and no more than
    n_pivots x 1024 ring borders reach the driver.
    """
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(embedding).alias("v"), is_query.alias("is_query")).where("vec_id is not null and v is not null")
    rows = staged(rows.dropDuplicates(["vec_id", "v"]), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    dim, top, n = rows.agg(F.max(F.size("v")), F.max(norm), F.count(F.lit(1))).first()
    out_type = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], out_type)
    found = fit_sample(rows, n, fit_rows).orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(fit_rows, n)).select("v").collect()
    sample = _lengthened([r[0] for r in found or rows.select("v").limit(1).collect()], dim)
    # pivots far from one another: each next is the farthest of the sample from those before
    lifted = _lifted(sample, top)
    chosen, gap = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n_pivots, len(sample)):
        gap = np.minimum(gap, _distances(lifted, lifted[chosen[-1:]])[:, 0])
        if gap.max() <= 0:
            break
        chosen.append(int(gap.argmax()))
    pivots = sample[chosen]
    blocks = build_index(rows.select("vec_id", "v"), pivots, top, dim, ring_rows)
    catalogue = blocks.groupBy("pivot", "ring").agg(F.min("near").alias("near"), F.max("far").alias("far")).toPandas()  # pivots x 1024 rows at most
    shared = spark.sparkContext.broadcast((pivots, top, catalogue))
    slack = 1e-6 * (1.0 + top)

    def plan(done: int, many: int):
        """Visits of a round: the rings from place `done` on in the order of their bounds that a query still needs."""

        def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            p, m, rings = shared.value
            lifted_p, ring_pivot = _lifted(p, m), rings["pivot"].to_numpy()
            near, far = rings["near"].to_numpy(), rings["far"].to_numpy()
            for batch in batches:
                for at in range(0, len(batch), 1024):
                    part = batch.iloc[at : at + 1024]
                    q = _lengthened(part["v"].tolist(), dim).astype(np.float64)
                    norms = (q * q).sum(1)
                    d = _distances(np.concatenate([q, np.zeros((len(q), 1))], 1), lifted_p)[:, ring_pivot]
                    bound = np.maximum(np.maximum(d - far, near - d), 0.0)
                    # |q - x|^2 = |q|^2 + M^2 - 2 q.x: a distance bound is an upper bound of the product
                    upper = (norms[:, None] + m - bound * bound) / 2 + slack
                    order = np.argsort(bound, axis=1, kind="stable")[:, done : done + many]
                    need = np.take_along_axis(upper, order, 1) >= part["worst"].to_numpy(np.float64, na_value=-np.inf)[:, None]
                    who, where = np.nonzero(need)
                    ring = order[who, where]
                    yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[who], "v": part["v"].to_numpy()[who], "pivot": ring_pivot[ring], "ring": rings["ring"].to_numpy()[ring]})

        return visits

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for q_ids, q, ids, x in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q", "ids", "vectors"))):
                ids, x = np.frombuffer(ids, "<i8"), np.frombuffer(x, "<i8").reshape(-1, dim)
                scores = _products(_lengthened(q, dim), x)
                for i, own in enumerate(q_ids):
                    at = np.flatnonzero(ids != own)
                    row = scores[i][at]
                    if len(at) > k:  # all that reach the k-th largest score, so ties as well
                        fit = row >= np.partition(row, -k)[-k]
                        row, at = row[fit], at[fit]
                    row, other = _best(row, ids[at], k)
                    found += zip([own] * len(row), other.tolist(), row.tolist())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["query_id", "vec_id", "score"])

    queries = staged(rows.where("is_query").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")), "queries")
    query_parts = F.lit(max(1, queries.count() // QUERY_BLOCK))
    open_queries = queries.withColumn("worst", F.lit(None).cast("long"))
    best, done, many = None, 0, first_rings
    while done < len(catalogue):
        visits = open_queries.mapInPandas(plan(done, many), "query_id long, v array<long>, pivot int, ring int")
        # queries of a ring in blocks: a block of vectors meets a block of queries, not one query at a time
        visits = visits.groupBy("pivot", "ring", F.pmod(F.xxhash64("query_id"), query_parts).alias("part")).agg(F.collect_list("query_id").alias("q_ids"), F.collect_list("v").alias("q"))
        # neither side goes through the driver, as either may look small to the planner in its packed form
        scored = blocks.join(visits.hint("merge"), ["pivot", "ring"]).select("q_ids", "q", "ids", "vectors").mapInArrow(score, "query_id long, vec_id long, score long")
        every = scored if best is None else scored.unionByName(best)
        ranked = every.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("vec_id")))), 1, k).alias("top"))
        best = staged(ranked.select("query_id", F.inline("top")).select("query_id", "vec_id", (-F.col("s")).alias("score")), "best")
        worst = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("worst"))
        open_queries = queries.join(worst, "query_id", "left")
        done, many = done + many, many * 4
    if best is None:
        return spark.createDataFrame([], out_type)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return best.select("query_id", rank.alias("rank"), "vec_id", "score")
