"""Replays of the graph head over streams of decisions and late true labels, and queries of what relations between items tell."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelweave.functions.hashing import joined, unit_draw
from labelweave.operators.graph_head import Decision, GraphHead, Settings, winner
from labelweave.plans.replay import fold
from labelweave.sources import tables as t
from labelweave.sources.tables import LABELS, MODELS

#: The models that vote: the cheap half of the pool, so that there is something left to tell.
VOTERS = [m[0] for m in MODELS[: len(MODELS) // 2]]
#: Share of items whose true label comes, after one to LATEST items; share of labels that name an item of no decision; share of a stream's items after which a new split begins.
AUDITED, LATEST, ASTRAY, SPLIT = 0.7, 4, 0.02, 0.5
DECIDE, LABEL, RESET, WARM_UP = "decide", "label", "reset", "warm"
EVENT = "stream string, at long, kind string, node string, base array<double>, entities array<string>, before string, gold string"
OUT = "stream string, at long, kind string, node string, base_label string, graph_label string, label string, p double, fallback string, parents long, relations string, right boolean, error string"


def stream_items(spark: SparkSession, d: str) -> DataFrame:
    """(stream, seq, node, gold, base, entities, before): labelled documents by source, numbered by doc_id, what the voters believe, entities, and the item before in the same language."""
    r = t.responses(t.items(spark, d), t.models(spark)).where(F.col("model_id").isin(VOTERS))
    weight = lambda v: F.sum(F.when(F.col("vote") == v, F.col("accuracy")).otherwise(0.0))
    voted = r.groupBy("doc_id").agg(*[F.first(c).alias(c) for c in ("source", "lang", "n_chars", "gold")], *[weight(v).alias(f"w{k}") for k, v in enumerate(LABELS)])
    whole = sum((F.col(f"w{k}") for k in range(len(LABELS))), F.lit(0.0))
    stream, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    voted = voted.select(stream.alias("stream"), lang.alias("lang"), "doc_id", F.col("doc_id").cast("string").alias("node"), "gold", F.array(*[F.col(f"w{k}") / whole for k in range(len(LABELS))]).alias("base"), F.coalesce(F.floor(F.log2("n_chars")), F.lit(0)).cast("string").alias("size"))
    by = Window.partitionBy("stream").orderBy("doc_id")
    same = Window.partitionBy("stream", "lang").orderBy("doc_id")
    entities = F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("size:"), "size"))
    return voted.select("stream", F.row_number().over(by).cast("long").alias("seq"), "node", "gold", "base", entities.alias("entities"), F.lag("node").over(same).alias("before"))


def events(items: DataFrame) -> DataFrame:
    """EVENT rows: every item's decision, the true labels that come, late and some of them astray, and each stream's reset between its splits."""
    u = lambda what: unit_draw(joined(what, F.col("node"), sep="|"))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    at = 4 * F.col("seq")
    decisions = items.select("stream", at.alias("at"), F.lit(DECIDE).alias("kind"), "node", "base", "entities", "before", F.col("gold"))
    late = at + 1 + 4 * F.floor(u("delay") * LATEST).cast("long")
    node = F.when(u("astray") < ASTRAY, F.concat(F.lit("none-"), "node")).otherwise(F.col("node"))
    labels = items.where(u("audit") < AUDITED).select("stream", late.alias("at"), F.lit(LABEL).alias("kind"), node.alias("node"), *none("array<double>", "base"), *none("array<string>", "entities"), *none("string", "before"), "gold")
    resets = items.groupBy("stream").agg(F.max("seq").alias("n")).select("stream", (4 * F.floor(F.col("n") * SPLIT) + 2).cast("long").alias("at"), F.lit(RESET).alias("kind"), F.lit("").alias("node"), *none("array<double>", "base"), *none("array<string>", "entities"), *none("string", "before", "gold"))
    return decisions.unionByName(labels).unionByName(resets)


def apply(head: GraphHead, row) -> tuple:
    """One event: what is decided, what is learned from, or why not."""
    stop = lambda error: (row.stream, row.at, row.kind, row.node, None, None, None, None, None, None, None, None, error)
    if row.kind == RESET:
        head.reset()
        return stop(None)
    if row.kind == LABEL:
        if row.gold not in head.labels:
            return stop("unknown label")
        return stop(None if head.feedback(row.node, row.gold) else "no decision waits for it")
    base = np.asarray(row.base, float)
    edges = {row.before: (1.0, ("sequence",))} if isinstance(row.before, str) else {}
    d = head.warm(row.node, base, row.gold, edges, tuple(row.entities)) if row.kind == WARM_UP else head.decide(row.node, base, edges, tuple(row.entities))
    return (row.stream, row.at, row.kind, row.node, *told(head.labels, d, row.gold), None)


def told(labels: tuple[str, ...], d: Decision, gold: str | None) -> tuple:
    label = winner(labels, d.fused)
    return winner(labels, d.base), None if d.graph is None else winner(labels, d.graph), label, round(float(d.fused.max()), 9), d.fallback, len(d.parents), ",".join(d.used), label == gold


def replayed(rows: DataFrame, settings: Settings) -> DataFrame:
    return fold(rows, ["stream"], ["at", "kind", "node"], lambda row: GraphHead(LABELS, settings), apply, OUT)


def d19_adaptive_head(spark: SparkSession, d: str) -> DataFrame:
    """Every decision of the graph head by source, which step of the cascade settled it, and every label that came, with an error where nothing waited for it."""
    return replayed(events(stream_items(spark, d)), Settings())


def d20_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """How often each step of the cascade decides, and how often the decision is right, once with the whole message and once with the latest parent of each relation."""
    rows = events(stream_items(spark, d))
    runs = [replayed(rows, Settings(latest_only=latest)).withColumn("latest_only", F.lit(latest)) for latest in (False, True)]
    out = runs[0].unionByName(runs[1]).where(F.col("kind") == DECIDE)
    return out.groupBy("latest_only", F.coalesce("fallback", F.lit("blended")).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("right").cast("double")), 6).alias("accuracy"))


def d21_relations(spark: SparkSession, d: str) -> DataFrame:
    """What each stream has learned of each relation by its end: transitions seen, the gate's mean and observations, and how far it is open."""

    def step(state, row):
        head, left = state
        apply(head, row)
        left[0] -= 1
        rows = head.diagnostics() if not left[0] else []
        return (row.stream, [{"relation": n, "seen": round(s, 6), "gate": round(g, 6), "gated": round(o, 6), "utility": round(u, 6)} for n, s, g, o, u in rows])

    rows = events(stream_items(spark, d))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("stream")))
    out = fold(rows, ["stream"], ["at", "kind", "node"], lambda row: (GraphHead(LABELS), [int(row.n)]), step, "stream string, known array<struct<relation:string,seen:double,gate:double,gated:double,utility:double>>")
    return out.select("stream", F.inline("known"))


QUERIES = {f.__name__: f for f in (d19_adaptive_head, d20_fallbacks, d21_relations)}
