"""The subset head and the transition memory against replays written anew, queries against their SQL."""

import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from labelweave.operators.subset_head import SubsetHead, SubsetSettings
from labelweave.operators.transition_memory import TransitionMemory
from labelweave.plans import subset_replay as S
from labelweave.sources.tables import LABELS
from tests.test_relational import _rows, db  # noqa: F401

THREE = ("a", "b", "c")


@pytest.mark.parametrize("name", list(S.SQL))
def test_query_is_its_sql(spark, sf, db, name):  # noqa: F811
    assert _rows(S.QUERIES[name](spark, sf).toPandas()) == _rows(db.execute(S.SQL[name]).df())


def learned_head(settings, labels=THREE, seed=1, n=120):
    """A head after a stream of items with two parents each, and plain tables of the same counts."""
    rng, models = random.Random(seed), ["m1", "m2", "m3"]
    head = SubsetHead(models, labels, settings)
    T, seen, L, lseen, cls, conf, feats, fseen, hist = defaultdict(lambda: [[1.0, 1.0], [1.0, 1.0]]), defaultdict(float), {}, defaultdict(float), {v: 1.0 for v in labels}, {m: {(t, v): 1.0 for t in labels for v in labels} for m in models}, {}, defaultdict(float), {}
    y = labels[0]
    for k in range(n):
        y = y if rng.random() < 0.7 else rng.choice(labels)
        edges = {f"n{j}": (rng.choice([0.5, 1.0, 3.0]), rng.choice([("r",), ("s",), ("r", "s")])) for j in {k - 1, k - 2, k - 7} if j >= 0}
        parents = head.parents(edges)
        votes = {m: y if rng.random() < 0.6 + 0.1 * i else rng.choice(labels) for i, m in enumerate(models)}
        audited = rng.random() < 0.6
        label = y if audited else votes["m3"]
        rewards = {m: float(v == label) for m, v in votes.items()}
        # by hand
        left, hand = 8.0, []
        for p, (w, rels) in sorted(edges.items(), key=lambda e: (-min(2.0, e[1][0]), e[0])):
            take = min(min(2.0, w), left)
            hand.append((p, take, rels))
            left -= take
        assert [(p, w, tuple(r)) for p, w, r in hand] == parents
        share = 1.0 if audited else 0.25
        if audited:
            cls[y] += 1
            f = defaultdict(float)
            for p, w, rels in hand:
                for r in rels:
                    f["relation:" + r] += w / len(rels)
            f["indegree:%d" % min(3, len(hand))] = 1.0
            f["parent_weight:%d" % min(3, int(sum(w for _, w, _ in hand)))] = 1.0
            for name, w in f.items():
                feats.setdefault(name, {v: 1.0 for v in labels})[y] += w
                fseen[name] += w
            for m in models:
                conf[m][y, votes[m]] += 1
        for p, w, rels in hand:
            for r in rels:
                for m in models:
                    T[m, r][int(hist[p][0][m])][int(rewards[m])] += share * w / len(rels)
                    seen[m, r] += share * w / len(rels)
                L.setdefault(r, {(s, t): 1.0 for s in labels for t in labels})[hist[p][1], label] += share * w / len(rels)
                lseen[r] += share * w / len(rels)
        hist[f"n{k}"] = (rewards, label)
        head.record(f"n{k}", parents, rewards, label, audited, votes if audited else None)
    return head, dict(T=T, seen=seen, L=L, lseen=lseen, cls=cls, conf=conf, feats=feats, fseen=fseen, hist=hist)


def hand_prior(s, hand, labels=THREE):
    base = {v: s["cls"][v] / sum(s["cls"].values()) for v in labels}
    logit, used = {v: math.log(base[v]) for v in labels}, 0
    f = defaultdict(float)
    for p, w, rels in hand:
        for r in rels:
            f["relation:" + r] += w / len(rels)
    f["indegree:%d" % min(3, len(hand))] = f["parent_weight:%d" % min(3, int(sum(w for _, w, _ in hand)))] = 1.0
    said = [(min(w, 2.0), s["fseen"][n] / (s["fseen"][n] + 6), {v: s["feats"][n][v] / sum(s["feats"][n].values()) for v in labels}) for n, w in f.items() if s["fseen"].get(n, 0) >= 6]
    for p, w, rels in hand:
        for r in rels:
            if s["lseen"][r] >= 6:
                row = {v: s["L"][r][s["hist"][p][1], v] for v in labels}
                said.append((w / len(rels), s["lseen"][r] / (s["lseen"][r] + 6), {v: x / sum(row.values()) for v, x in row.items()}))
    for w, m, q in said:
        for v in labels:
            logit[v] += w * (math.log(m * q[v] + (1 - m) * base[v]) - math.log(base[v]))
        used += 1
    z = sum(math.exp(x) for x in logit.values())
    return [math.exp(logit[v]) / z for v in labels], used


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_prior_and_rewards_by_hand(seed):
    head, s = learned_head(SubsetSettings(), seed=seed)
    for edges in ({"n118": (1.0, ("r",))}, {"n119": (3.0, ("r", "s")), "n100": (0.5, ("s",))}, {}, {"n5": (2.0, ("s",)), "n6": (2.0, ("s",)), "n7": (2.0, ("r",)), "n8": (2.0, ("r",))}):
        hand = [(p, min(2.0, w), r) for p, (w, r) in sorted(edges.items(), key=lambda e: (-min(2.0, e[1][0]), e[0]))]
        prior, used = head.label_prior(head.parents(edges))
        want, n = hand_prior(s, hand)
        assert prior.tolist() == pytest.approx(want) and used == n
        bounds = {"m1": 0.6, "m2": 0.7, "m3": 0.8}
        got = head.regularized(bounds, head.parents(edges))
        for m in bounds:
            top, whole = bounds[m], 1.0
            for p, w, rels in hand:
                for r in rels:
                    b, a = s["T"][m, r][int(s["hist"][p][0][m])]
                    low = min(1, max(0, a / (a + b) - 1.28 * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))))
                    told = abs(low - 0.5) * 2
                    if s["seen"][m, r] >= 6 and told >= 0.02:
                        g = 0.5 * w / len(rels) * told * s["seen"][m, r] / (s["seen"][m, r] + 6)
                        top, whole = top + g * low, whole + g
            assert got[m] == pytest.approx(min(1, max(0, top / whole)))


@pytest.mark.parametrize("settings", [SubsetSettings(calibrated=True, prior_power=0.5), SubsetSettings(calibrated=True, blend=0.4, temperature=0.7), SubsetSettings(prior_power=0.8), SubsetSettings()])
@pytest.mark.parametrize("labels", [THREE, ("no", "yes")])
def test_votes_and_confidence_by_enumeration(settings, labels):
    head, s = learned_head(settings, labels, 5)
    weights, bounds = {"m1": 0.5, "m2": 0.9, "m3": 1.3}, {"m1": 0.6, "m2": 0.7, "m3": 0.8}
    prior, used = head.label_prior(head.parents({"n119": (1.0, ("r",))}))

    def vote(said):
        plain = {v: sum(weights[m] for m in said if said[m] == v) for v in labels}
        if not settings.calibrated:
            if used and settings.prior_power:
                sure = 1 + sum(p * math.log(p) for p in prior) / math.log(len(labels))
                for v, p in zip(labels, prior):
                    plain[v] += settings.prior_power * sure * sum(weights[m] for m in said) * p
            score = plain
        else:
            mean = sum(weights[m] for m in said) / len(said)
            x = {t: (settings.prior_power if used else 0) * math.log(p) + sum(settings.temperature * weights[m] / mean * math.log(s["conf"][m][t, said[m]] / sum(s["conf"][m][t, v] for v in labels)) for m in said) for t, p in zip(labels, prior)}
            z = sum(math.exp(v) for v in x.values())
            score = {t: (1 - settings.blend) * plain[t] / sum(weights[m] for m in said) + settings.blend * math.exp(x[t]) / z for t in labels}
        return next(v for v in labels if math.isclose(score[v], max(score.values())))

    for size in (1, 2, 3):
        for subset in itertools.combinations(["m1", "m2", "m3"], size):
            total = 0.0
            for said in itertools.product(labels, repeat=size):
                label = vote(dict(zip(subset, said)))
                got = head.votes(np.array([[labels.index(v) for v in said]]), np.array([weights[m] for m in subset]), list(subset), prior, used)
                assert labels[int(got[0])] == label
                if settings.calibrated:
                    t = labels.index(label)
                    total += prior[t] * math.prod(s["conf"][m][label, v] / sum(s["conf"][m][label, x] for x in labels) for m, v in zip(subset, said))
            if settings.calibrated:
                assert head.confidence(list(subset), bounds, weights, prior, used) == pytest.approx(total)
            elif len(labels) == 2:
                sure = 1 + sum(p * math.log(p) for p in prior) / math.log(2)
                for t in (0, 1):
                    for right in itertools.product((0, 1), repeat=size):
                        score = [settings.prior_power * sure * sum(weights[m] for m in subset) * p for p in prior]
                        for m, r in zip(subset, right):
                            score[t if r else 1 - t] += weights[m]
                        if (0 if score[0] >= score[1] else 1) == t:
                            total += prior[t] * math.prod(bounds[m] if r else 1 - bounds[m] for m, r in zip(subset, right))
                assert head.confidence(list(subset), bounds, weights, prior, used) == pytest.approx(total)
    costs = {"m1": 1.0, "m2": 2.0, "m3": 5.0}
    subset, sure, feasible = head.choose(bounds, weights, costs, prior, used, 0.5)
    cheaper = [x for k in (1, 2, 3) for x in itertools.combinations(costs, k) if sum(costs[m] for m in x) < sum(costs[m] for m in subset)]
    assert feasible and sure >= 0.5 and all(head.confidence(list(x), bounds, weights, prior, used) < 0.5 for x in cheaper)
    assert head.choose(bounds, weights, costs, prior, used, 1.01)[0::2] == (["m1", "m2", "m3"], False)


def test_memory_by_hand():
    rng, m = random.Random(3), TransitionMemory(2, memory=30)
    T, hist, order = {}, {}, []
    h = lambda p: -sum(x * math.log(x) for x in (p, 1 - p) if x > 0)
    spoke = 0
    for k in range(400):
        edges = {f"n{j}": (rng.choice([0.5, 1.0, 4.0]), rng.choice("rs")) for j in {k - 1, k - 2, k - 40} if j >= 0}
        x, used = [0.0, 0.0], 0
        near = [(n, min(2.0, w), r) for n, (w, r) in edges.items() if n in hist]
        for n, w, r in near:
            t = T.get(r, [[1.0, 1.0], [1.0, 1.0]])
            mass = sum(map(sum, t)) - 4
            if mass >= 6:
                q = sum(hist[n][a] * t[a][1] / sum(t[a]) for a in (0, 1))
                told = 1 - h(q) / math.log(2)
                if told >= 0.05:
                    g = 0.8 * w * max(hist[n]) * told * mass / (mass + 6)
                    x, used = [x[0] + g * math.log(1 - q), x[1] + g * math.log(q)], used + 1
        want = 1 / (1 + math.exp(x[0] - x[1]))
        p, n, _ = m.prior(edges)
        assert p[1] == pytest.approx(want) and n == used
        spoke += used
        b = min(0.999, max(0.001, rng.betavariate(0.3, 0.3) if k % 3 else hist.get(f"n{k - 1}", (0, 0.5))[1]))
        for n, w, r in near:
            t = T.setdefault(r, [[1.0, 1.0], [1.0, 1.0]])
            for a in (0, 1):
                for c in (0, 1):
                    t[a][c] += w * min(max(hist[n]), max(b, 1 - b)) * hist[n][a] * (1 - b, b)[c]
        m.update(f"n{k}", edges, np.array([1 - b, b]))
        hist[f"n{k}"] = (1 - b, b)
        order.append(f"n{k}")
        if len(order) > 30:
            del hist[order.pop(0)]
        assert len(m.beliefs) <= 30
    assert spoke > 50


def test_replays_add_up(spark, sf):
    n = S.subset_items(spark, sf).count()
    for name in ("d14_causal_subset", "d16_calibrated_subset", "d29_graph_risk"):
        rows = S.QUERIES[name](spark, sf).collect()
        assert len(rows) == n and all(r["label"] in LABELS for r in rows)
        assert all(0 <= r["prior"] <= 1 for r in rows)
    with pytest.raises(ValueError):
        SubsetSettings(blend=2)


def test_choose_stops_at_the_first_that_is_sure(monkeypatch):
    """Subsets are tried in order of cost, size and name (before: all 63 were, for every item)."""
    from labelweave.operators.subset_head import SubsetHead

    head, calls = SubsetHead(list("abcdef"), ("x", "y")), []
    sure = {("a",): 0.4, ("b",): 0.95, ("a", "b"): 0.99}
    monkeypatch.setattr(head, "confidence", lambda s, *_: calls.append(s) or sure.get(tuple(s), 0.97))
    costs = dict(zip("abcdef", (1.0, 2.0, 3.0, 4.0, 5.0, 6.0)))
    assert head.choose({}, {}, costs, None, 0, 0.9) == (["b"], 0.95, True) and calls == [["a"], ["b"]]
    assert head.choose({}, {}, costs, None, 0, 2.0)[2] is False
