"""Structured Streaming: windows over event time, late data, the labeller on a live stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def host_windows(events: DataFrame, late: str = "10 minutes", width: str = "30 minutes") -> DataFrame:
    """Events, errors and values of each host in tumbling windows; rows later than the watermark are dropped."""
    e = events.withWatermark("ts", late).groupBy(F.window("ts", width), "host")
    return e.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("action") == "ERROR").cast("long")).alias("errors"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "host", "n", "errors", "total")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Sessions of a host: events at most `gap` apart."""
    e = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "host")
    return e.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), "host", "n")


def fresh(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, as long as the watermark remembers it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


STATE = "agreed array<long>, n long"
OUT = "stream string, item_id long, label string, right boolean"


def weighted_majority(panel: DataFrame, models: list[str], labels: tuple[str, ...]) -> DataFrame:
    """Online weighted majority by stream: weights follow each model's agreement with the outcome so far and are kept as state.

    panel (stream, item_id, gold, votes array<string>, one for each model). Within a batch a stream's items are taken in order of item_id.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        agreed, n = (list(state.get[0]), state.get[1]) if state.exists else ([0] * len(models), 0)
        rows = pd.concat(list(batches)).sort_values("item_id")
        out = []
        for row in rows.itertuples(index=False):
            totals = dict.fromkeys(labels, 0.0)
            for i, v in enumerate(row.votes):
                totals[v] += (agreed[i] + 1) / (n + 2)
            top = max(totals.values())
            label = next(v for v in labels if np.isclose(totals[v], top, rtol=1e-9, atol=0))
            agreed = [a + (v == label) for a, v in zip(agreed, row.votes)]
            n += 1
            out.append((key[0], row.item_id, label, row.gold == label))
        state.update((agreed, n))
        yield pd.DataFrame(out, columns=["stream", "item_id", "label", "right"])

    return panel.groupBy("stream").applyInPandasWithState(step, T._parse_datatype_string(OUT), T._parse_datatype_string(STATE), "append", GroupStateTimeout.NoTimeout)
