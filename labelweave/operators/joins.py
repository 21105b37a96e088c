"""Joins beyond plain equality: nearest in time, look-back, interval with keys, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, by: list[str], around: int, most_ms: int) -> DataFrame:
    """For each row of left (id, ms) the step of right (step, step_ms) nearest in time within `by`, of hosts that fit.

    Candidates are the `around` steps before where the row's time falls among the steps of `by` and the `around` + 1 from there on; the host must be
    equal, or the step have none; then the least distance wins, the earlier step on a tie; farther than most_ms: none. Steps and
    rows are put in one order by a union and windows, so the join is by ordinal: no row meets all steps.
    """
    steps = right.withColumn("ordinal", F.row_number().over(Window.partitionBy(*by).orderBy("step_ms", "step")).cast("long"))
    marks = steps.select(*by, F.col("step_ms").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id")).unionByName(left.select(*by, F.col("ms").alias("t"), F.lit(1).alias("kind"), F.col("id").cast("long").alias("id")))
    before = F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).over(Window.partitionBy(*by).orderBy("t").rangeBetween(Window.unboundedPreceding, -1))
    placed = marks.withColumn("at", F.coalesce(before, F.lit(0))).where("kind = 1").select(*by, "id", F.col("t").alias("ms"), F.explode(F.sequence(F.col("at") - around + 1, F.col("at") + around + 1)).alias("ordinal"))
    met = placed.join(left.select("id", "host"), "id").join(steps.select(*by, "ordinal", "step", "step_ms", F.col("host").alias("step_host")), [*by, "ordinal"])
    met = met.where(F.col("step_host").isNull() | (F.col("step_host") == F.col("host"))).withColumn("delta", F.abs(F.col("ms") - F.col("step_ms")))
    best = met.groupBy("id").agg(F.min(F.struct("delta", "step_ms", "step")).alias("b")).where(F.col("b.delta") <= most_ms)
    return best.select("id", F.col("b.step").alias("step"), F.col("b.delta").alias("delta_ms"))


def look_back(anchors: DataFrame, events: DataFrame, back_ms: int, most: int) -> DataFrame:
    """(anchor, event_id, rank): the latest events of an anchor's entity in the time before it, `most` of them at most.

    anchors (anchor, entity, at); events (event_id, entity, ms). Times are cut into cells of back_ms; an anchor meets its own
    cell and the one before, so a busy entity's events spread over many join keys.
    """
    cell = lambda c: F.floor(F.col(c) / back_ms).cast("long")
    a = anchors.select("anchor", "entity", "at", F.explode(F.array(cell("at"), cell("at") - 1)).alias("cell"))
    e = events.select("event_id", "entity", "ms", cell("ms").alias("cell"))
    met = a.join(e, ["entity", "cell"]).where((F.col("ms") <= F.col("at")) & (F.col("ms") >= F.col("at") - back_ms) & (F.col("event_id") != F.col("anchor")))
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("ms"), F.desc("event_id"))).cast("long")
    return met.select("anchor", "event_id", (F.col("at") - F.col("ms")).alias("before_ms"), rank.alias("rank")).where(F.col("rank") <= most)


def within(events: DataFrame, steps: DataFrame, by: list[str], radius_ms: int) -> DataFrame:
    """(event_id, step): events with a step's keys at most radius_ms from it; times are cut into cells of the radius."""
    cell = lambda c: F.floor(F.col(c) / radius_ms).cast("long")
    s = steps.select(*by, "step", "step_ms", F.explode(F.array(cell("step_ms") - 1, cell("step_ms"), cell("step_ms") + 1)).alias("cell"))
    met = events.withColumn("cell", cell("ms")).join(s, [*by, "cell"])
    return met.where(F.abs(F.col("ms") - F.col("step_ms")) <= radius_ms).select("event_id", "step").distinct()


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of edges that are no nodes: none, if all is well."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return ends.join(nodes.select("node"), "node", "left_anti")
