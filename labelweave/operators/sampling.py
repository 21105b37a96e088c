"""Deterministic samples, quotas and splits by hash rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.functions.hashing import hex_rank, unit_draw


def bottom_k(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """The k rows of least hash rank: a top-k on every partition, merged."""
    return df.withColumn("rank_hex", hex_rank(seed, F.col(key))).orderBy("rank_hex", key).limit(k)


def per_group(df: DataFrame, group: list[str], key: str, k: Column | int, seed: int) -> DataFrame:
    """At most k rows of each group, by hash rank."""
    w = Window.partitionBy(*group).orderBy("rank_hex", key)
    return df.withColumn("rank_hex", hex_rank(seed, F.col(key))).withColumn("pick", F.row_number().over(w).cast("long")).where(F.col("pick") <= k)


def stratified(df: DataFrame, label: str, key: str, n: int, labels: tuple, seed: int) -> DataFrame:
    """n rows, as evenly over the labels as can be; what is over goes to the first labels."""
    base, over = divmod(n, len(labels))
    place = F.array_position(F.array(*map(F.lit, labels)), F.col(label))
    quota = F.lit(base) + F.when(place <= over, 1).otherwise(0)
    return per_group(df.where(place > 0), [label], key, quota, seed)


def interleaved(df: DataFrame, side: Column, key: str, seed: int) -> DataFrame:
    """Both sides cut to the smaller one and laid in turn: negatives at even places, positives at odd ones."""
    t = df.withColumn("side", side.cast("int")).withColumn("rank_hex", hex_rank(seed, F.col(key)))
    t = t.withColumn("n", F.row_number().over(Window.partitionBy("side").orderBy("rank_hex", key)))
    least = df.select(side.cast("int").alias("s")).groupBy("s").count().agg(F.min("count").alias("least"))
    return t.join(F.broadcast(least), F.col("n") <= F.col("least")).select(key, "side", ((F.col("n") - 1) * 2 + F.col("side")).cast("long").alias("place"))


def quota_match(wanted: DataFrame, pool: DataFrame, by: list[str], key: str, seed: int) -> DataFrame:
    """As many rows of pool for each combination of `by` as wanted has, by hash rank; combinations that wanted lacks get none."""
    quota = wanted.groupBy(*by).agg(F.count(F.lit(1)).alias("quota"))
    ranked = pool.join(quota, by).withColumn("rank_hex", hex_rank(seed, F.col(key)))
    ranked = ranked.withColumn("pick", F.row_number().over(Window.partitionBy(*by).orderBy("rank_hex", key)).cast("long"))
    return ranked.where(F.col("pick") <= F.col("quota"))


def grouped_split(df: DataFrame, group: Column, seed: int, calibration: float = 0.2, validation: float = 0.1) -> DataFrame:
    """Whole groups go to calibration, validation or test by their hash draw."""
    u = unit_draw(F.concat(F.lit(f"{seed}:"), group.cast("string")))
    return df.withColumn("split", F.when(u < calibration, "calibration").when(u < calibration + validation, "validation").otherwise("test"))


def split_overlap(df: DataFrame, group: str) -> DataFrame:
    """Groups that lie in more than one split: none, if all is well."""
    return df.groupBy(group).agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def partition_digest(df: DataFrame, by: str, key: str) -> DataFrame:
    """SHA-256 over the sorted keys of each partition, joined by line feeds. A partition's keys meet in one task."""
    return df.groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("n"))
