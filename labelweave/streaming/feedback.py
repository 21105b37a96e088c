"""The graph head on a live stream: decisions that wait for labels, a bounded memory and what was learned, each in a state of its own."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from labelweave.operators.graph_head import Decision, GraphHead, Relation, Settings
from labelweave.plans.graph_replay import OUT, apply


class HeadProcessor(StatefulProcessor):
    """A stream's head between batches: the order in which items came (list), what is believed of each and the decisions that wait (maps by item), and relations (value).

    An item that the memory lets go leaves the list and both maps in the same batch, so the state of a stream holds `settings.memory` items at most.
    """

    def __init__(self, labels: tuple[str, ...], settings: Settings) -> None:
        self.labels, self.settings = labels, settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.learned = handle.getValueState("learned", "state string")
        self.order = handle.getListState("order", "node string, entities array<string>")
        self.beliefs = handle.getMapState("beliefs", "node string", "belief array<double>, audited boolean")
        self.waiting = handle.getMapState("waiting", "node string", "decision string")

    def _load(self) -> GraphHead:
        head = GraphHead(self.labels, self.settings)
        if self.learned.exists():
            state = json.loads(self.learned.get()[0])
            head.classes = np.array(state["classes"], float)
            head.relations = {n: Relation(np.array(c, float), np.array(g, float), seen, gated) for n, (c, g, seen, gated) in state["relations"].items()}
        for node, entities in self.order.get() if self.order.exists() else ():
            head.memory.add(node, tuple(entities))
        for (node,), (belief, audited) in self.beliefs.iterator() if self.beliefs.exists() else ():
            head.history[node] = (np.array(belief, float), bool(audited))
        for (node,), (text,) in self.waiting.iterator() if self.waiting.exists() else ():
            base, graph, fused, parents, used, fallback = json.loads(text)
            head.pending[node] = Decision(node, np.array(base), None if graph is None else np.array(graph), np.array(fused), [(p, w, tuple(n)) for p, w, n in parents], tuple(used), fallback)
        return head

    def _save(self, head: GraphHead, history: dict, pending: dict) -> None:
        relations = {n: [r.counts.tolist(), r.gate.tolist(), r.seen, r.gated] for n, r in head.relations.items()}
        self.learned.update((json.dumps({"classes": head.classes.tolist(), "relations": relations}),))
        order = [(n, list(e)) for n, e in head.memory.entities.items()]
        self.order.put(order) if order else self.order.clear()
        for known, now, state, packed in (
            (history, head.history, self.beliefs, lambda x: (x[0].tolist(), x[1])),
            (pending, head.pending, self.waiting, lambda x: (json.dumps([x.base.tolist(), None if x.graph is None else x.graph.tolist(), x.fused.tolist(), x.parents, x.used, x.fallback]),)),
        ):
            for node in known.keys() - now.keys():
                state.removeKey((node,))
            for node, x in now.items():
                if known.get(node) is not x:
                    state.updateValue((node,), packed(x))

    def _run(self, rows: pd.DataFrame) -> list[tuple]:
        head = self._load()
        history, pending = dict(head.history), dict(head.pending)
        out = [apply(head, row) for row in rows.sort_values(["at", "kind", "node"]).itertuples(index=False)]
        self._save(head, history, pending)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(self._run(pd.concat(list(rows))), columns=[c.split()[0] for c in OUT.split(", ")], dtype=object)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """A stream's audited items of earlier splits: learned from before the first batch."""
        self._run(initialState)

    def close(self) -> None:
        pass


def graph_head(events: DataFrame, labels: tuple[str, ...], settings: Settings, warm: DataFrame | None = None) -> DataFrame:
    """Events (plans.graph_replay.EVENT) of many streams, each decided and learned from in the order at, kind, node within a batch.

    warm: `warm` events that every stream starts from. Labels for items that don't wait for one come out as rows with an error.
    """
    initial = warm.groupBy("stream") if warm is not None else None
    out = events.groupBy("stream").transformWithStateInPandas(statefulProcessor=HeadProcessor(labels, settings), outputStructType=T._parse_datatype_string(OUT), outputMode="append", timeMode="none", initialState=initial)
    return out.withColumn("p", F.col("p").cast("double"))
