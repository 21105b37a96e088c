"""Ordered replays: many streams and settings side by side, each folded in its own order.

A run's rows are dealt to one partition and sorted there; the fold reads them batch by batch and keeps nothing but its
state, so a long stream is never held in memory. Runs - settings, seeds, delays - are what Spark spreads.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.operators.kernels import Labeller, StateSwitch, WeightedMajority, audited
from labelweave.sources import tables as t
from labelweave.sources.tables import LABELS, MODELS

NAMES = sorted(m[0] for m in MODELS)
QUERIES: dict = {}


def fold(rows: DataFrame, run: list[str], order: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """step(state, row) -> a tuple for schema, over each run's rows in order; start(row) gives a run's first state."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                now = tuple(getattr(row, c) for c in run)
                if now != key:
                    key, state = now, start(row)
                out.append(step(state, row))
            yield pd.DataFrame(out, columns=names, dtype=object)  # long ids beside nulls stay whole numbers

    return rows.repartition(*run).sortWithinPartitions(*run, *order).mapInPandas(go, schema)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each item: votes and costs of all models, and its embedding as context."""
    r = t.responses(t.items(spark, sf_dir), t.models(spark))
    wide = r.groupBy("doc_id").agg(F.max("gold").alias("gold"), F.max("source").alias("source"), *[F.max(F.when(F.col("model_id") == m, F.col(c))).alias(f"{c}_{m}") for m in NAMES for c in ("vote", "cost")])
    v = t.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    context = F.coalesce("embedding", F.array_repeat(F.lit(0.125).cast("float"), 64))
    return wide.join(v, "doc_id", "left").withColumn("context", context)


def _votes(row) -> dict[str, str]:
    return {m: getattr(row, f"vote_{m}") for m in NAMES}


def _costs(row) -> np.ndarray:
    return np.array([getattr(row, f"cost_{m}") for m in NAMES])


def _grid(rows: DataFrame, **settings: list) -> DataFrame:
    for name, values in settings.items():
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return rows


def d9_base_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labeller over all items in order, for three confidence levels and with and without graph smoothing to the item before of its source."""

    def start(row):
        return Labeller(NAMES, 64, need=row.need, graph_weight=row.graph_weight), {}

    def step(state, row):
        labeller, last = state
        near = [(last[row.source], 0.5)] if row.source in last else []
        out = labeller.step(row.doc_id, np.asarray(row.context, float), _costs(row), _votes(row), LABELS, near)
        for k in [k for k in labeller.past if k not in (*last.values(), row.doc_id)]:
            del labeller.past[k]  # only each source's latest item is asked for again
        last[row.source] = row.doc_id
        return (row.need, row.graph_weight, row.doc_id, out["label"], ",".join(out["models"]), round(out["confidence"], 9), round(out["cost"], 9), bool(out["feasible"]), row.gold == out["label"])

    rows = _grid(panel(spark, sf_dir), need=[0.8, 0.9, 0.95], graph_weight=[0.0, 1.0])
    return fold(rows, ["need", "graph_weight"], ["doc_id"], start, step, "need double, graph_weight double, doc_id long, label string, models string, confidence double, cost double, feasible boolean, right boolean")


def d34_online_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Online weighted majority by source: each stream's weights follow how often a model has agreed with its outcomes."""

    def step(state, row):
        label = state.step(_votes(row), LABELS)
        return (row.source, row.doc_id, label, row.gold == label)

    return fold(panel(spark, sf_dir), ["source"], ["doc_id"], lambda row: WeightedMajority(NAMES), step, "source string, doc_id long, label string, right boolean")


def d25_state_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State switching by source, its feedback sparse and late: an item's true label arrives `delay` items on, if it is audited."""

    def start(row):
        return StateSwitch(LABELS), deque()

    def step(state, row):
        switch, waiting = state
        if len(waiting) > row.delay:
            source, pattern, gold, known = waiting.popleft()
            if known:
                switch.audit(source, pattern, gold)
        votes = _votes(row)
        pattern = tuple(votes[m] for m in ("reader", "board"))
        label = switch.step(row.source, pattern, votes["board"])
        waiting.append((row.source, pattern, row.gold, audited(row.doc_id, rate=row.rate)))
        return (row.rate, row.delay, row.doc_id, label, row.gold == label)

    rows = _grid(panel(spark, sf_dir), rate=[1.0, 0.5, 0.25, 0.1, 0.05], delay=[0, 1, 5, 20])
    return fold(rows, ["rate", "delay"], ["doc_id"], start, step, "rate double, delay int, doc_id long, label string, right boolean")


def v6_feedback_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of state switching for each rate and delay of feedback."""
    out = d25_state_switch(spark, sf_dir)
    return out.groupBy("rate", "delay").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("right").cast("double")), 6).alias("accuracy"))


def t5_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision points of a stream of events: triggers with a cooldown for each host and trigger, and a cap for each hour; rejected ones are counted, a periodic one advances its clock even then."""

    def step(state, row):
        last, used = state
        trigger = row.action if row.action in ("ERROR", "SIGNUP") else "PERIODIC"
        why = "accepted"
        clock = last.get((row.host, trigger), -(10**18))
        if trigger == "PERIODIC" and row.ms - clock < 600_000 or trigger != "PERIODIC" and row.ms - clock < 60_000:
            why = "cooldown"
        else:
            slot = (row.host, row.ms // 3_600_000, trigger)
            if used.get(slot, 0) >= 2:
                why = "cap"
            else:
                used[slot] = used.get(slot, 0) + 1
            if why == "accepted" or trigger == "PERIODIC":
                last[row.host, trigger] = row.ms
            for old in [k for k in used if k[1] < row.ms // 3_600_000]:
                del used[old]
        return (row.corpus, row.event_id, trigger, why)

    rows = t.events(spark, sf_dir).select("corpus", "event_id", "ms", "host", "action")
    return fold(rows, ["corpus", "host"], ["ms", "event_id"], lambda row: ({}, {}), step, "corpus string, event_id long, trigger string, verdict string")


QUERIES = {f.__name__: f for f in (d9_base_router, d34_online_majority, d25_state_switch, v6_feedback_grid, t5_checkpoints)}
