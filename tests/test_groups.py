"""Grouped splits and packing against plain searches over every group, one decision after another."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from labelweave.operators import allocation as A
from labelweave.plans import groups as G

LABELS = ("x", "y", "z")


def draw(seed, name):
    return int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:16], 16) / 2**64


def split_by_hand(groups, shares=(0.2, 0.1), seed=17, refined=True):
    """groups: name -> Counter of labels. Every choice by looking at all groups that are left."""
    whole = dict(zip(A.SPLITS, (*shares, 1 - sum(shares))))
    total = sum((g for g in groups.values()), Counter())
    size = lambda g: sum(groups[g].values())
    n = sum(total.values())
    at, left = {}, set(groups)

    def have(s, v=None):
        return sum(groups[g][v] if v else size(g) for g in at if at[g] == s)

    while left:
        rare = min((v for v in total if any(groups[g][v] for g in left)), key=lambda v: (sum(groups[g][v] > 0 for g in left), total[v], v))
        g = max((g for g in left if groups[g][rare]), key=lambda g: (groups[g][rare], size(g), -draw(seed, g)))
        miss = lambda s, v: (whole[s] * total[v] - have(s, v)) / max(whole[s] * total[v], 1e-9)
        at[g] = max(A.SPLITS, key=lambda s: (round(miss(s, rare), 12), round(sum(c * miss(s, v) for v, c in groups[g].items()) / size(g), 12), round((whole[s] * n - have(s)) / max(whole[s] * n, 1e-9), 12), whole[s] * n, s))
        left.remove(g)
    in_groups = {v: sum(groups[g][v] > 0 for g in groups) for v in total}

    def cost():
        x = 0.0
        for s in A.SPLITS:
            x += 4 * (have(s) - whole[s] * n) ** 2 / (whole[s] * n + 1) + 1e6 * (s not in at.values())
            for v in total:
                x += (have(s, v) - whole[s] * total[v]) ** 2 / (whole[s] * total[v] + 1) + 1e6 * (in_groups[v] >= 3 and not have(s, v))
        return round(x, 9)

    for _ in range(100 if refined else 0):
        now, found = cost(), []
        for g in groups:
            for s in A.SPLITS:
                if s != at[g]:
                    old, at[g] = at[g], s
                    found.append((cost(), g, s))
                    at[g] = old
        if found and min(found)[0] < now - 1e-9:
            _, g, s = min(found)
            at[g] = s
            continue
        swaps = []
        names = sorted(groups, key=lambda g: (draw(seed, g), g))
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                if at[a] != at[b]:
                    at[a], at[b] = at[b], at[a]
                    swaps.append((cost(), a, b))
                    at[a], at[b] = at[b], at[a]
        if not swaps or min(swaps)[0] >= now - 1e-9:
            break
        _, a, b = min(swaps)
        at[a], at[b] = at[b], at[a]
    return at


def some_groups(seed, n):
    rng = random.Random(seed)
    return {f"g{k:02d}": Counter(rng.choices(LABELS, (8, 3, 1), k=rng.choice([1, 1, 2, 3, 5, 9]))) for k in range(n)}


def test_splits_are_the_greedy_ones_and_refined(spark):
    cases = {f"s{k}": some_groups(k, n) for k, n in enumerate((1, 2, 3, 8, 15, 22))}
    rows = [(s, g, f"{g}-{k}", k, v) for s, gs in cases.items() for g, c in gs.items() for k, v in enumerate(c.elements())]
    items = spark.createDataFrame(rows, "stream string, group string, item string, at long, label string")
    counts = A.group_counts(items, LABELS)
    dealt, refined = defaultdict(dict), defaultdict(dict)
    for r in A.dealt(counts, LABELS, (0.2, 0.1), 17).collect():
        dealt[r["stream"]][r["group"]] = r["split"]
    for r in A.stratified_split(counts, LABELS).collect():
        refined[r["stream"]][r["group"]] = r["split"]
    for s, gs in cases.items():
        assert dealt[s] == split_by_hand(gs, refined=False), s
        assert refined[s] == split_by_hand(gs), s
    with pytest.raises(ValueError):
        A.stratified_split(counts, LABELS, (0.7, 0.3))
    # labels that aren't known are an error, empty tables are not
    with pytest.raises(Exception, match="valid label"):
        A.group_counts(items, ("x", "y")).collect()
    assert A.stratified_split(counts.limit(0), LABELS).count() == 0


def packed_by_hand(items, share, seed=17, bonus=0.35):
    """items: group -> labels in order. The order in which groups are taken, and how many items of the last."""
    total = Counter(v for g in items.values() for v in g)
    n = sum(total.values())
    room = int(share * n)
    goal = {v: room * c / n for v, c in total.items()}
    turn = lambda g: hashlib.sha256(f"{seed}:{g}".encode()).hexdigest()
    kind = lambda g: tuple(sorted(Counter(items[g]).items()))
    first = {}
    for g in items:
        first[kind(g)] = min(first.get(kind(g), "~"), turn(g))
    has, left, out = Counter(), set(items), []
    off = lambda c: sum(abs(c[v] - goal[v]) for v in goal)
    while room:
        fit = [g for g in left if len(items[g]) <= room]
        if not fit:
            break
        gain = {g: round(off(has) - off(has + Counter(items[g])) + bonus * (len(items[g]) - 1), 9) for g in fit}
        g = min(fit, key=lambda g: (-gain[g], -len(items[g]), first[kind(g)], turn(g)))
        out.append((g, len(items[g]), True))
        has += Counter(items[g])
        room -= len(items[g])
        left.remove(g)
    if room and left:
        head = {g: items[g][:room] for g in left}
        g = min(left, key=lambda g: (-round(off(has) - off(has + Counter(head[g])) + bonus * max(0, len(head[g]) - 1), 9), turn(g)))
        out.append((g, len(head[g]), False))
    return out


def test_packing_is_the_greedy_one(spark):
    rng = random.Random(6)
    cases = {f"s{k}": {g: rng.sample(list(c.elements()), sum(c.values())) for g, c in some_groups(30 + k, n).items()} for k, n in enumerate((1, 4, 12, 30))}
    rows = [(s, g, f"{g}-{k}", k, v) for s, gs in cases.items() for g, ls in gs.items() for k, v in enumerate(ls)]
    items = spark.createDataFrame(rows, "stream string, group string, item string, at long, label string")
    for share in (0.3, 0.55):
        got = defaultdict(list)
        for r in A.packed(items, LABELS, share).collect():
            got[r["stream"]].append((r["block"], r["group"], r["whole"], r["place"], r["item"]))
        for s, gs in cases.items():
            blocks = defaultdict(list)
            for b, g, whole, place, item in sorted(got[s]):
                assert item == f"{g}-{place - 1}"
                blocks[b, g, whole].append(place)
            assert [(g, len(p), w) for (b, g, w), p in sorted(blocks.items())] == packed_by_hand(gs, share), (s, share)
            assert len(got[s]) == int(share * sum(map(len, gs.values())))


def test_queries_keep_groups_whole(spark, sf):
    rows = G.v2_stratified_split(spark, sf).collect()
    assert len(rows) == G.grouped_items(spark, sf).count()
    assert all(len({r["split"] for r in rows if (r["stream"], r["group"]) == k}) == 1 for k in {(r["stream"], r["group"]) for r in rows})
    groups, split = defaultdict(lambda: defaultdict(Counter)), defaultdict(dict)
    for r in rows:
        groups[r["stream"]][r["group"]][r["label"]] += 1
        split[r["stream"]][r["group"]] = r["split"]
    for s, gs in groups.items():
        assert split[s] == split_by_hand(gs), s
    packed = G.o8_group_packing(spark, sf).collect()
    n = Counter(r["stream"] for r in rows)
    assert Counter(r["stream"] for r in packed) == {s: int(G.SHARE * k) for s, k in n.items() if int(G.SHARE * k)}


def test_badness_counts_what_is_missing():
    goal, labels = np.array([2.0, 1.0, 7.0]), np.outer([0.2, 0.1, 0.7], [10.0])
    spread = np.full((3, 1), True)
    assert A.badness(goal, labels, np.ones(3), goal, labels, spread) == 0
    assert A.badness(goal, np.array([[2.0], [0.0], [7.0]]), np.array([1, 0, 1]), goal, labels, spread) == pytest.approx(2e6 + 0.5)
