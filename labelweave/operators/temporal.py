"""Operators over ordered rows: correlation, adjacency, merge, chunks, caps, persistence, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def correlate(roles: DataFrame, weights: dict[str, float], max_gap_ms: int = 1_800_000) -> DataFrame:
    """(src, dst, weight, reasons, gap_ms): consecutive events of each relation's value are linked if they lie within the gap.

    roles: (relation, value, event_id, ms, role). An event with several roles for one value is one entry; weights decay by
    exp(-gap / max) and add up over relations; pairs are unordered. Rows without a value take no part.
    """
    one = roles.where(F.col("value").isNotNull()).groupBy("relation", "value", "event_id", "ms").agg(F.collect_set("role").alias("roles"))
    w = Window.partitionBy("relation", "value").orderBy("ms", "event_id")
    nxt = one.withColumns({"to": F.lead("event_id").over(w), "to_ms": F.lead("ms").over(w), "to_roles": F.lead("roles").over(w)}).withColumn("gap", F.col("to_ms") - F.col("ms"))
    nxt = nxt.where((F.col("gap") >= 0) & (F.col("gap") <= max_gap_ms) & (F.col("to") != F.col("event_id")))
    known = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    step = known[F.col("relation")] * F.exp(-F.col("gap") / F.lit(float(max_gap_ms)))
    pairs = nxt.select(F.least("event_id", "to").alias("src"), F.greatest("event_id", "to").alias("dst"), step.alias("step"), F.array_union("roles", "to_roles").alias("r"), "gap")
    return pairs.groupBy("src", "dst").agg(F.round(F.sum("step"), 6).alias("weight"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("r")))).alias("reasons"), F.min("gap").alias("gap_ms"))


def chain(df: DataFrame, group: list[str], order: list[str], node: str, at: str, weight: float, span: float) -> DataFrame:
    """(src, dst, weight) of consecutive rows of each group, weight * exp(-distance / span)."""
    w = Window.partitionBy(*group).orderBy(*order)
    t = df.select(F.col(node).alias("src"), F.lead(node).over(w).alias("dst"), (F.lead(at).over(w) - F.col(at)).alias("d"))
    return t.where("dst is not null").select("src", "dst", (F.lit(weight) * F.exp(-F.abs("d") / F.lit(span))).alias("weight"))


def replay_merge(df: DataFrame, seed: int) -> DataFrame:
    """A day's corpora merged by normalised rank: (event_id, day, place), place counting up by 1000 over all days.

    A row's rank is its place within (day, corpus) over the number of rows less one; ties go by hash of the corpus. Days are
    numbered one by one and moved on by the rows of the days before, so no window spans the table.
    """
    w = Window.partitionBy("day", "corpus").orderBy("ms", "event_id")
    t = df.select("event_id", "day", "corpus", F.percent_rank().over(w).alias("r"), F.row_number().over(w).alias("n"))
    tie = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("corpus")), 256)
    t = t.withColumn("in_day", F.row_number().over(Window.partitionBy("day").orderBy(F.round("r", 12), tie, "n", "event_id")))
    days = df.groupBy("day").agg(F.count(F.lit(1)).alias("rows"))
    days = days.select("day", F.coalesce(F.sum("rows").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each day
    return t.join(F.broadcast(days), "day").select("event_id", "day", ((F.col("before") + F.col("in_day")) * 1000).cast("long").alias("place"))


def reversals(df: DataFrame, source: list[str], position: str, ms: str) -> DataFrame:
    """Per source: rows, and those that are earlier than the row before them in the source's order."""
    before = F.lag(ms).over(Window.partitionBy(*source).orderBy(position))
    return df.withColumn("back", (F.col(ms) < before).cast("long")).groupBy(*source).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("back"), F.lit(0).cast("long")).alias("reversals"))


def chunks(df: DataFrame, host: str, ms: str, key: str, minutes: int = 5, size: int = 48) -> DataFrame:
    """Rows of a host's time bucket in chunks of `size`."""
    bucket = F.floor(F.col(ms) / (minutes * 60000)).cast("long")
    t = df.withColumn("bucket", bucket)
    n = F.row_number().over(Window.partitionBy(host, "bucket").orderBy(ms, key))
    return t.select(key, host, "bucket", F.floor((n - 1) / size).cast("long").alias("chunk"))


def capped(adj: DataFrame, node: str, other: str, weight: str, cap: float, most: int | None = None) -> DataFrame:
    """Heaviest neighbours first, their weights cut so that a node's sum is at most cap; then at most `most` of them."""
    order = Window.partitionBy(node).orderBy(F.desc(weight), other)
    prior = F.coalesce(F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    t = adj.withColumns({"left": cap - prior, "n": F.row_number().over(order)})
    t = t.where(F.col("left") > 1e-12)
    t = t.where(F.col("n") <= most) if most else t
    return t.select(node, other, F.round(F.least(F.col(weight), F.col("left")), 6).alias("capped"))


def persistence(df: DataFrame, entity: str, order: str, value: Column, audited: Column, delay: int) -> DataFrame:
    """Of each row the last audited value of its entity that was known `delay` stream positions earlier."""
    w = Window.partitionBy(entity).orderBy(order).rangeBetween(Window.unboundedPreceding, -(delay + 1))
    return df.withColumn("previous", F.last(F.when(audited, value), ignorenulls=True).over(w))


def transitions(df: DataFrame, entity: str, order: list[str], value: str) -> DataFrame:
    """How often a value follows another within an entity, and the smoothed probability."""
    t = df.select(F.lag(value).over(Window.partitionBy(entity).orderBy(*order)).alias("previous"), F.col(value).alias("value")).where("previous is not null")
    n = t.groupBy("previous", "value").agg(F.count(F.lit(1)).alias("n"))
    whole, kinds = F.sum("n").over(Window.partitionBy("previous")), F.count(F.lit(1)).over(Window.partitionBy("previous"))
    return n.select("previous", "value", "n", F.round((F.col("n") + 1) / (whole + kinds), 6).alias("prob"))


def recent(df: DataFrame, group: list[str], order: list[str], value: str, k: int = 2, weight: float = 0.35) -> DataFrame:
    """Of each row the k rows before it in its group, the latest first, with weights weight / 1, weight / 2, ..."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-k, -1)
    latest = F.reverse(F.collect_list(value).over(w))
    sums = F.aggregate(F.transform(latest, lambda _, i: F.lit(weight) / (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return df.withColumns({"recent": F.array_join(F.transform(latest, lambda x: x.cast("string")), ","), "recent_weight": F.round(sums, 6)})


def longest_runs(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """The longest run of equal values in each group and value: gaps and islands."""
    a = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    b = F.row_number().over(Window.partitionBy(group, value).orderBy(*order))
    runs = df.withColumn("island", a - b).groupBy(group, value, "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(group, value).agg(F.max("n").alias("longest"))


def adjacent(df: DataFrame, group: str, order: list[str], key: str, hosts: str) -> DataFrame:
    """Consecutive steps of a group and whether they share a host."""
    w = Window.partitionBy(group).orderBy(*order)
    t = df.select(F.col(group), F.col(key).alias("step"), F.lead(key).over(w).alias("next"), F.arrays_overlap(hosts, F.lead(hosts).over(w)).alias("same")).where("next is not null")
    return t.select(group, "step", "next", F.when(F.col("same"), "same_host").otherwise("cross_host").alias("relation"))
