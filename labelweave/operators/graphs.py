"""Graphs as tables of nodes and edges."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.functions.mathx import clip, logit, sigmoid


@cache
def _local_folder() -> str:
    """One folder a process; Spark lets no session set spark.checkpoint.dir later on."""
    return tempfile.mkdtemp(prefix="labelweave-")


def _folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _local_folder()
    return root.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder of spark.checkpoint.dir and read again, so that loops keep short lineages."""
    path = f"{_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """kept, but as a table in buckets by the key, so that joins and sums by it shuffle nothing."""
    kept_as = f"{_folder(df.sparkSession)}/bucketed-{uuid.uuid4().hex}"
    name = f"labelweave_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", kept_as).saveAsTable(name)
    table = df.sparkSession.table(name)
    table._name = name
    return table


def drop(table: DataFrame) -> None:
    """A table of bucketed leaves the catalog; its files stay in the shared folder, as those of kept do."""
    table.sparkSession.sql(f"DROP TABLE IF EXISTS {table._name}")


def provenance(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, kind) and edges (src, dst, relation, ms, event_id) of events with an actor, an object and a host.

    Edges: actor -> event, event -> object, host -> event. A node that occurs in several roles is an actor before it is an
    entity before anything else.
    """
    n = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    e = events.select("event_id", "ms", n("event", "event_id").alias("e"), n("entity", "actor").alias("a"), n("entity", "object").alias("o"), n("host", "host").alias("h"))
    ends = F.array(
        F.struct(F.col("a").alias("src"), F.col("e").alias("dst"), F.lit("acts").alias("relation")),
        F.struct(F.col("e").alias("src"), F.col("o").alias("dst"), F.lit("targets").alias("relation")),
        F.struct(F.col("h").alias("src"), F.col("e").alias("dst"), F.lit("hosts").alias("relation")),
    )
    edges = e.select("event_id", "ms", F.inline(ends)).where("src is not null and dst is not null").select("src", "dst", "relation", "ms", "event_id")
    kinds = F.array(F.struct(F.col("a").alias("node"), F.lit("1actor").alias("k")), F.struct(F.col("o").alias("node"), F.lit("2entity").alias("k")), F.struct(F.col("e").alias("node"), F.lit("3event").alias("k")), F.struct(F.col("h").alias("node"), F.lit("4host").alias("k")))
    nodes = e.select(F.inline(kinds)).where("node is not null").groupBy("node").agg(F.substring(F.min("k"), 2, 10).alias("kind"))
    return nodes, edges


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, nbr, weight) in both directions; weights of repeated edges add up, loops are left out."""
    both = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("node"), F.col("src").alias("nbr")))
    return edges.where("src <> dst").select("weight", F.inline(both)).groupBy("node", "nbr").agg(F.round(F.sum("weight"), 6).alias("weight"))


def neighbours(edges: DataFrame, nodes: DataFrame, direction: str = "both") -> DataFrame:
    """Distinct neighbours of some nodes along, against or regardless of the edges' direction."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr"))
    into = edges.select(F.col("dst").alias("node"), F.col("src").alias("nbr"))
    every = {"out": out, "in": into, "both": out.unionByName(into)}[direction]
    return every.join(nodes.select("node"), "node", "left_semi").distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct unordered edges with both ends among the nodes."""
    n = nodes.select("node").distinct()
    e = edges.where("src <> dst").join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def k_hop(adj: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, distance) of all nodes within `hops` steps of the seeds: a join for each step, over the frontier only."""
    seen = seeds.select("node").distinct().withColumn("distance", F.lit(0).cast("long"))
    frontier = seen
    for h in range(1, hops + 1):
        new = adj.join(frontier.select("node"), "node", "left_semi").select(F.col("nbr").alias("node")).distinct()
        frontier = kept(new.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(h).cast("long")))
        seen = seen.unionByName(frontier)
    return seen


def components(adj: DataFrame, nodes: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the least node of each component.

    Rounds contract the graph: a node joins what comes first by the round's hash among itself and its neighbours, and edges
    go between what is left, about half of the nodes at most on average in any order of the numbers. So all rounds together
    shuffle a small multiple of the first one. The rounds' steps, read backwards, lead each node to its root.
    """
    edges = kept(adj.where("node <> nbr").select(F.least("node", "nbr").alias("a"), F.greatest("node", "nbr").alias("b")).distinct())
    steps = []
    while not edges.isEmpty():
        if len(steps) == rounds:
            raise RuntimeError(f"components didn't settle in {rounds} rounds")
        at = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), F.col(c)).alias("h"), F.col(c).alias("p"))
        ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
        first = edges.select(F.inline(ends)).groupBy("u").agg(F.min(at("v")).alias("best"))
        step = kept(first.select("u", F.least("best", at("u"))["p"].alias("p")))
        steps.append(step)
        moved = edges.join(step.toDF("a", "pa"), "a").join(step.toDF("b", "pb"), "b").where("pa <> pb")
        edges = kept(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    every = nodes.select("node").distinct()
    if not steps:
        return every.select("node", F.col("node").alias("component"))
    root = steps[-1]
    for step in steps[-2::-1]:
        root = kept(step.join(root.toDF("p", "root"), "p", "left").select("u", F.coalesce("root", "p").alias("p")))
    least = root.groupBy("p").agg(F.min("u").alias("component"))
    found = root.join(least, "p").select(F.col("u").alias("node"), "component")
    return every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def neighbour_mean(adj: DataFrame, values: DataFrame) -> DataFrame:
    """(node, mean, logit): weighted mean of the neighbours' values, a node's own value where it has none."""
    m = adj.join(values.select(F.col("node").alias("nbr"), F.col("value").alias("v")), "nbr").groupBy("node").agg((F.sum(F.col("weight") * F.col("v")) / F.sum("weight")).alias("m"))
    t = values.join(m, "node", "left").withColumn("m", F.coalesce("m", "value"))
    return t.select("node", F.round("m", 6).alias("mean"), F.round(logit(F.col("m")), 6).alias("logit"))


def belief_propagation(adj: DataFrame, unary: DataFrame, beta: Column | float, rounds: int = 6) -> DataFrame:
    """(node, posterior): every round sets logit(p) = logit(unary) + beta (logit(mean of the neighbours) - logit(1/2)), all at once."""
    state = unary.select("node", F.col("value").alias("p"))
    for _ in range(rounds):
        m = adj.join(state.select(F.col("node").alias("nbr"), F.col("p").alias("q")), "nbr").groupBy("node").agg((F.sum(F.col("weight") * F.col("q")) / F.sum("weight")).alias("m"))
        new = sigmoid(logit(F.col("value")) + F.lit(beta) * logit(F.coalesce("m", F.lit(0.5))))
        state = kept(unary.join(m, "node", "left").select("node", clip(new, 1e-6, 1 - 1e-6).alias("p")))
    return state.select("node", F.round("p", 6).alias("posterior"))
