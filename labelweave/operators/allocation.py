"""Whole groups dealt to splits, or packed into a budget, so that labels keep their shares.

Groups are known by the counts of their labels. What is decided one group after another depends on these counts alone, so
it runs over each stream's groups in order with the counters as its only state, or over the distinct counts and how many groups
have them; which groups those are is found by joins. Streams are independent of one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelweave.functions.hashing import joined, unit_draw
from labelweave.plans.replay import fold

SPLITS = ("calibration", "validation", "test")
# fixed values: how much a split's size weighs against its labels, the price of a missing label or an empty split, rounds of refinement, groups up to which pairs are swapped
SIZE_WEIGHT, MISSING, ROUNDS, SWAPPED = 4.0, 1e6, 100, 200


def group_counts(items: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(stream, group, counts, size): the labels of each group in the order of `labels`. items: stream, group, label; other labels are an error."""
    known = F.when(F.col("label").isin(*labels), F.col("label")).otherwise(F.raise_error(F.lit("an item lacks a valid label")))
    items = items.withColumn("label", known)
    counts = F.array(*[F.sum((F.col("label") == v).cast("long")) for v in labels])
    return items.groupBy("stream", "group").agg(counts.alias("counts"), F.count(F.lit(1)).alias("size"))


def phases(groups: DataFrame, n_labels: int) -> DataFrame:
    """groups with the phase in which they are dealt, its label's place and the group's count of it: always the label that the fewest groups left have, then the rarer, then the first."""
    left = groups.withColumns({"phase": F.lit(None).cast("int"), "label": F.lit(None).cast("int"), "rare": F.lit(None).cast("long")})
    totals = groups.groupBy("stream").agg(*[F.sum(F.col("counts")[k]).alias(f"t{k}") for k in range(n_labels)])
    for turn in range(n_labels):
        many = left.where("phase is null").groupBy("stream").agg(*[F.sum((F.col("counts")[k] > 0).cast("long")).alias(f"g{k}") for k in range(n_labels)]).join(totals, "stream")
        order = F.least(*[F.when(F.col(f"g{k}") > 0, F.struct(F.col(f"g{k}").alias("g"), F.col(f"t{k}").alias("t"), F.lit(k).alias("k"))) for k in range(n_labels)])
        next_ = many.select("stream", order["k"].alias("k")).where("k is not null")  # a row for each stream
        count = F.element_at("counts", F.col("k") + 1)
        mine = F.col("phase").isNull() & (F.coalesce(count, F.lit(0)) > 0)
        left = left.join(next_, "stream", "left").withColumns({"rare": F.when(mine, count).otherwise(F.col("rare")), "label": F.when(mine, F.col("k")).otherwise(F.col("label")), "phase": F.when(mine, turn).otherwise(F.col("phase"))}).drop("k")
    return left


def dealt(groups: DataFrame, labels: tuple[str, ...], shares: tuple[float, float], seed: int) -> DataFrame:
    """(stream, group, counts, size, draw, split): each group goes where the rarest label that it has is missed most, then its labels as a whole, then its size."""
    whole = np.array([shares[0], shares[1], 1 - sum(shares)])
    draw = unit_draw(joined(seed, F.col("group"), sep=":"))
    rows = phases(groups, len(labels)).withColumn("draw", draw)
    totals = groups.groupBy("stream").agg(F.sum("size").alias("all_size"), F.array(*[F.sum(F.col("counts")[k]) for k in range(len(labels))]).alias("all_counts"), F.count(F.lit(1)).alias("n_groups"))
    rows = rows.join(totals, "stream").withColumns({"by_rare": -F.col("rare"), "by_size": -F.col("size")})

    def start(row) -> dict:
        t = np.outer(whole, np.asarray(row.all_counts, float))
        return {"size": whole * row.all_size, "labels": t, "has": np.zeros(3), "has_labels": np.zeros_like(t)}

    def step(s: dict, row) -> tuple:
        c = np.asarray(row.counts, float)
        miss = (s["labels"] - s["has_labels"]) / np.maximum(s["labels"], 1e-9)
        k = row.label
        scores = [(round(float(miss[i, k]), 12), round(float((c * miss[i]).sum() / row.size), 12), round(float((s["size"][i] - s["has"][i]) / max(s["size"][i], 1e-9)), 12), float(s["size"][i]), SPLITS[i]) for i in range(3)]
        best = max(range(3), key=scores.__getitem__)
        s["has"][best] += row.size
        s["has_labels"][best] += c
        return (row.stream, row.group, list(map(int, row.counts)), int(row.size), float(row.draw), SPLITS[best])

    return fold(rows, ["stream"], ["phase", "by_rare", "by_size", "draw", "group"], start, step, "stream string, group string, counts array<long>, size long, draw double, split string")


def badness(size: np.ndarray, labels: np.ndarray, n: np.ndarray, goal: np.ndarray, goal_labels: np.ndarray, spread: np.ndarray) -> float:
    """How far splits are from their goals in size and labels; a label that could be in every split and isn't, or an empty split, costs MISSING. All but the goals may have leading axes."""
    x = SIZE_WEIGHT * ((size - goal) ** 2 / (goal + 1)).sum(-1) + ((labels - goal_labels) ** 2 / (goal_labels + 1)).sum((-1, -2))
    return np.round(x + MISSING * ((spread & (labels == 0)).sum((-1, -2)) + (n == 0).sum(-1)), 9)


def refine(names: list[str], counts: np.ndarray, draws: np.ndarray, split: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Splits of the groups after single moves and, among few groups, swaps of pairs, the best one first, as long as one helps."""
    split = split.copy()
    sizes = counts.sum(1).astype(float)
    goal, goal_labels = shares * sizes.sum(), np.outer(shares, counts.sum(0))
    spread = np.broadcast_to((counts > 0).sum(0) >= len(shares), goal_labels.shape)
    own = np.eye(len(shares))
    by_name = np.argsort(np.array(names, object), kind="stable")
    by_draw = np.array(sorted(range(len(names)), key=lambda i: (draws[i], names[i])))
    target_order = [SPLITS.index(s) for s in sorted(SPLITS)]
    for _ in range(ROUNDS):
        size = own[split].T @ sizes
        labels = own[split].T @ counts.astype(float)
        n = own[split].sum(0)
        now = float(badness(size, labels, n, goal, goal_labels, spread))
        best = None
        for t in target_order:
            i = by_name[split[by_name] != t]
            if len(i):
                d = own[t] - own[split[i]]
                x = badness(size + d * sizes[i, None], labels + d[:, :, None] * counts[i, None, :], n + d, goal, goal_labels, spread)
                j = int(x.argmin())
                move = (float(x[j]), names[i[j]], SPLITS[t], i[j], t)
                best = move if best is None or move[:3] < best[:3] else best
        if best and best[0] < now - 1e-9:
            split[best[3]] = best[4]
            continue
        if len(names) > SWAPPED:
            break
        found = None
        for a, i in enumerate(by_draw[:-1]):
            j = by_draw[a + 1 :]
            j = j[split[j] != split[i]]
            if len(j):
                d = own[split[i]] - own[split[j]]
                x = badness(size + d * (sizes[j] - sizes[i])[:, None], labels + d[:, :, None] * (counts[j] - counts[i])[:, None, :], n + 0 * d, goal, goal_labels, spread)
                for k in np.flatnonzero(x == x.min()):
                    swap = (float(x[k]), names[i], names[j[k]], i, j[k])
                    found = swap if found is None or swap[:3] < found[:3] else found
        if not found or found[0] >= now - 1e-9:
            break
        i, j = found[3:]
        split[i], split[j] = split[j], split[i]
    return split


def stratified_split(groups: DataFrame, labels: tuple[str, ...], shares: tuple[float, float] = (0.2, 0.1), seed: int = 17, most_groups: int = 20_000) -> DataFrame:
    """(stream, group, counts, size, split): groups stay whole, labels keep their shares as far as groups allow it.

    Dealt in order, then refined by moves, and by swaps where a stream has SWAPPED groups at most. Streams of more than most_groups groups are
    dealt only: a move among so many changes next to nothing, and refining looks at all groups of a stream at once.
    """
    if not (0 <= shares[0] < 1 and 0 <= shares[1] < 1 and sum(shares) < 1):
        raise ValueError("shares are numbers from 0 and leave something for the rest")
    whole = np.array([*shares, 1 - sum(shares)])
    out = dealt(groups, labels, shares, seed)
    n = groups.groupBy("stream").agg(F.count(F.lit(1)).alias("n"))
    out = out.join(n, "stream")

    def better(pdf: pd.DataFrame) -> pd.DataFrame:
        split = refine(pdf["group"].tolist(), np.array(pdf["counts"].tolist(), np.int64), pdf["draw"].to_numpy(), pdf["split"].map(SPLITS.index).to_numpy(), whole)
        return pdf.assign(split=[SPLITS[s] for s in split])[["stream", "group", "counts", "size", "split"]]

    schema = "stream string, group string, counts array<long>, size long, split string"
    small = out.where(F.col("n") <= most_groups).groupBy("stream").applyInPandas(better, schema)
    return small.unionByName(out.where(F.col("n") > most_groups).select("stream", "group", "counts", "size", "split"))


def packed(items: DataFrame, labels: tuple[str, ...], share: float, seed: int = 17, bonus: float = 0.35) -> DataFrame:
    """(stream, group, item, block, place, whole): items of whole groups that fill a share of each stream, labels keeping theirs; block is the order in which groups were taken.

    items: stream, group, item, at, label. Always the group that brings the labels nearest to their goal, larger ones preferred
    by `bonus` for each further item. If none fits any more, the first items of one more group fill what is left. Streams
    whose share is less than an item give none.
    """
    groups = group_counts(items, labels).withColumn("turn", F.sha2(F.concat(F.lit(f"{seed}:"), "group"), 256))
    kinds = groups.groupBy("stream", "counts", "size").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"))

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        """Which kind of group is taken at each step. Of kinds that bring as much and are as large the one goes first whose first group has the smaller hash."""
        counts, size, left = np.array(pdf["counts"].tolist(), float), pdf["size"].to_numpy(), pdf["n"].to_numpy().copy()
        total = int((size * left).sum())
        room = int(share * total)
        goal = room * (counts * left[:, None]).sum(0) / max(1, total)
        has, used, out = np.zeros(counts.shape[1]), np.zeros(len(pdf), int), []
        order = pdf["first"].to_numpy()
        while room:
            fits = np.flatnonzero((left > 0) & (size <= room))
            if not len(fits):
                break
            gain = np.abs(has - goal).sum() - np.abs(has + counts[fits] - goal).sum(1) + bonus * np.maximum(0, size[fits] - 1)
            i = min(fits.tolist(), key=lambda k, at=dict(zip(fits.tolist(), np.round(gain, 9).tolist())): (-at[k], -size[k], order[k]))
            used[i] += 1
            left[i] -= 1
            has += counts[i]
            room -= int(size[i])
            out.append((pdf["stream"].iloc[0], pdf["counts"].iloc[i], int(used[i]), len(out) + 1))
        rest = [(pdf["stream"].iloc[0], [int(x) for x in has], -1, room)] if room else []
        return pd.DataFrame(out + rest, columns=["stream", "counts", "rank", "block"])

    steps = kinds.groupBy("stream").applyInPandas(take, "stream string, counts array<long>, rank long, block long")
    ranked = groups.withColumn("rank", F.row_number().over(Window.partitionBy("stream", "counts").orderBy("turn", "group")).cast("long"))
    taken = ranked.join(steps.where("rank > 0"), ["stream", "counts", "rank"]).select("stream", "group", "block")
    place = F.row_number().over(Window.partitionBy("stream", "group").orderBy("at", "item"))
    items = items.withColumn("place", place)
    whole = items.join(taken, ["stream", "group"]).select("stream", "group", "item", "block", "place", F.lit(True).alias("whole"))

    # what is left is filled by the first items of one group: the one whose first items bring most
    room = steps.where("rank = -1").select("stream", F.col("counts").alias("has"), F.col("block").alias("room"))
    goals = items.groupBy("stream").agg(F.count(F.lit(1)).alias("all"), *[F.sum((F.col("label") == v).cast("long")).alias(f"t{k}") for k, v in enumerate(labels)])
    heads = items.join(taken.select("stream", "group"), ["stream", "group"], "left_anti").join(room, "stream").where("place <= room").join(goals, "stream")
    of = heads.groupBy("stream", "group").agg(F.first("has").alias("has"), F.first("all").alias("all"), F.count(F.lit(1)).alias("n"), *[F.sum((F.col("label") == v).cast("long")).alias(f"c{k}") for k, v in enumerate(labels)], *[F.first(f"t{k}").alias(f"t{k}") for k in range(len(labels))])
    goal = lambda k: F.floor(F.lit(share) * F.col("all")) * F.col(f"t{k}") / F.col("all")
    off = lambda more: sum((F.abs(F.col("has")[k] + (F.col(f"c{k}") if more else 0) - goal(k)) for k in range(len(labels))), F.lit(0.0))
    score = F.round(off(False) - off(True) + bonus * F.greatest(F.lit(0), F.col("n") - 1), 9)
    turn = F.sha2(F.concat(F.lit(f"{seed}:"), "group"), 256)
    best = of.groupBy("stream").agg(F.min(F.struct((-score).alias("s"), turn.alias("t"), "group")).alias("b")).select("stream", "b.group")
    last = steps.groupBy("stream").agg((F.coalesce(F.max(F.when(F.col("rank") > 0, F.col("block"))), F.lit(0)) + 1).alias("block"))
    part = heads.join(best, ["stream", "group"]).join(last, "stream").select("stream", "group", "item", "block", "place", F.lit(False).alias("whole"))
    return whole.unionByName(part)
