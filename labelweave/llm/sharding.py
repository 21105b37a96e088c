"""Sharding by sampled splitters.

A size-weighted sample of keys gives quantile boundaries; records are range-partitioned between them; ranges that
turn out overfull are sampled again and subdivided. Exact totals of the ranges then place the shard borders, so the
shards differ by about one record however the sample fell.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.llm.common import free_name, kept_columns, staged, text_or_empty

Key = tuple[int, int, int]
#: Groups of equal records up to which a table of them is broadcast.
BROADCAST_GROUPS = 500_000


def _range_of(bounds: list[Key]):
    """Arrow UDF: the number of boundaries at or below a key of three longs."""
    first = np.array([b[0] for b in bounds], dtype=np.int64)

    @F.pandas_udf(T.IntegerType())
    def range_of(k1: pd.Series, k2: pd.Series, k3: pd.Series) -> pd.Series:
        a = k1.to_numpy()
        low, high = np.searchsorted(first, a, "left"), np.searchsorted(first, a, "right")
        b, c = k2.to_numpy(), k3.to_numpy()
        for i in np.flatnonzero(high > low):  # keys that share their first part with a boundary
            low[i] = bisect_right(bounds, (int(a[i]), int(b[i]), int(c[i])), int(low[i]), int(high[i]))
        return pd.Series(low.astype(np.int32))

    return range_of


def _quantiles(sample: list[tuple[Key, float]], parts: int) -> list[Key]:
    """At most parts - 1 distinct keys that cut the sampled mass into equal parts."""
    sample.sort()
    mass = np.cumsum([m for _, m in sample])
    if not len(mass) or parts < 2:
        return []
    at = np.searchsorted(mass, mass[-1] * np.arange(1, parts) / parts, "right")
    return sorted({sample[min(i, len(sample) - 1)][0] for i in at})


def shard_records(
    df: DataFrame,
    n_shards: int,
    size: Column,
    key: tuple[Column, Column],
    ranges_per_shard: int = 64,
    range_rows: int = 200_000,
    oversample: int = 16,
    whole: bool = False,
    names: tuple[str, str, str] = ("size", "shard", "slot"),
) -> DataFrame:
    """Return df with its size, its shard (0 to n_shards - 1) and its slot (0, 1, ... within the shard).

    Records are ordered by the two long expressions in key, ties by their place in the input. Shard borders fall at
    equal numbers of summed size, so two shards differ by less than the two largest records. Nulls in a key sort first.
    Every row is kept; rows that repeat each get a slot; an empty table gives an empty result. whole: records that are equal in
    the first key go to the shard of their middle together, if they are less than a shard; a larger group is cut where the sizes say, and
    so is every group without `whole`. Columns of df that have one of the names, in any case,
    are replaced. The driver holds ranges_per_shard * n_shards (or one per range_rows rows)
    boundaries and about oversample sampled keys for each.
    """
    spark = df.sparkSession
    rid, k1, k2, k3, size_name, shard_name, chance, b_before, n_before, end, rank, first, size_of, start_of = (free_name(df, f"__{x}", *names) for x in ("range", "k1", "k2", "k3", "size", "shard", "chance", "b", "n", "end", "rank", "first", "sizeof", "startof"))
    kept = kept_columns(df, names)
    least = F.lit(-(2**63)).cast("long")
    keyed = df.withColumns({size_name: size.cast("long"), k1: F.coalesce(key[0].cast("long"), least), k2: F.coalesce(key[1].cast("long"), least), k3: F.monotonically_increasing_id()})
    keyed = staged(keyed, "shard-records")
    rows, total = keyed.agg(F.count(F.lit(1)), F.sum(size_name)).first()
    if not rows:
        return keyed.select(*kept, F.col(size_name).alias(names[0]), F.lit(0).alias(names[1]), F.lit(0).cast("long").alias(names[2]))
    n_ranges = max(n_shards * ranges_per_shard, -(-rows // range_rows))
    # weight of a row: its share of the size and of the rows, so that ranges are bounded in both
    weight = (F.col(size_name) / F.lit(float(total or 1)) + F.lit(1.0 / rows)) / 2
    draw = F.pmod(F.xxhash64(k1, k2, k3, F.lit(17)), F.lit(1 << 52)) / F.lit(float(1 << 52))

    def sample(records: DataFrame, share: float, parts: int) -> list[tuple[Key, float]]:
        wanted = F.least(F.lit(1.0), weight * F.lit(oversample * parts / share))
        drawn = records.withColumn(chance, wanted).where(draw < F.col(chance)).select(k1, k2, k3, (weight / F.col(chance)).alias("m"))
        return [((r[0], r[1], r[2]), r[3]) for r in drawn.collect()]

    bounds = _quantiles(sample(keyed, 1.0, n_ranges), n_ranges)
    for _ in range(4):
        located = keyed.withColumn(rid, _range_of(bounds)(k1, k2, k3))
        stats = located.groupBy(rid).agg(F.sum(size_name).alias("b"), F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w")).collect()
        over = {r[rid]: r["w"] for r in stats if r["w"] > 3 / n_ranges and r["n"] > 2}
        if not over:
            break
        share = sum(over.values())
        drawn = sample(located.where(F.col(rid).isin(list(over))), share, max(8, round(share * n_ranges * 2)))
        within: dict[int, list] = {}
        for k, m in drawn:
            within.setdefault(bisect_right(bounds, k), []).append((k, m))
        new = {b for i, s in within.items() for b in _quantiles(s, int(np.ceil(over.get(i, 0) * n_ranges)) + 1)} - set(bounds)
        if not new:
            break
        bounds = sorted({*bounds, *new})

    stats.sort(key=lambda r: r[rid])
    before_b = np.concatenate([[0], np.cumsum([r["b"] for r in stats])])
    before_n = np.concatenate([[0], np.cumsum([r["n"] for r in stats])])
    starts = spark.createDataFrame([(r[rid], int(b), int(n)) for r, b, n in zip(stats, before_b, before_n)], f"{rid} int, {b_before} long, {n_before} long")
    w = Window.partitionBy(rid).orderBy(k1, k2, k3)
    placed = (
        located.join(F.broadcast(starts), rid)  # one row for each range: bounded above
        .withColumn(end, F.col(b_before) + F.sum(size_name).over(w))
        .withColumn(rank, F.col(n_before) + F.row_number().over(w) - 1)
    )
    if whole:
        groups = placed.groupBy(k1).agg(F.sum(size_name).alias(size_of), F.min(F.col(end) - F.col(size_name)).alias(start_of), F.count(F.lit(1)).alias("c"))
        groups = staged(groups.where((F.col("c") > 1) & (F.col(size_of) * n_shards < (total or 1))).drop("c"), "shard-groups")
        placed = placed.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, k1, "left")
        twice = F.coalesce(2 * F.col(start_of) + F.col(size_of), 2 * F.col(end) - F.col(size_name))
    else:
        twice = 2 * F.col(end) - F.col(size_name)
    placed = placed.withColumn(shard_name, F.least(F.lit(n_shards - 1), F.floor(twice * F.lit(n_shards) / F.lit(2 * (total or 1)))).cast("int"))
    firsts = placed.groupBy(shard_name).agg(F.min(rank).alias(first))  # a row for each shard
    return placed.join(F.broadcast(firsts), shard_name).select(*kept, F.col(size_name).alias(names[0]), F.col(shard_name).alias(names[1]), (F.col(rank) - F.col(first)).alias(names[2]))


def content_key(text: str = "text") -> Column:
    """A long from the text alone: equal texts lie side by side."""
    return F.conv(F.substring(F.md5(text_or_empty(text).cast("binary")), 1, 15), 16, 10).cast("long")


def text_size(text: str = "text") -> Column:
    return F.octet_length(text_or_empty(text)).cast("long") + 1
