import math
from collections import defaultdict

import numpy as np
import pytest

from labelweave.plans import folds
from labelweave.sources.tables import LABELS
from tests.test_relational import _rows, db  # noqa: F401


@pytest.mark.parametrize("name", list(folds.SQL))
def test_fold_is_its_sql(spark, sf, db, name):  # noqa: F811
    assert _rows(folds.QUERIES[name](spark, sf).toPandas()) == _rows(db.execute(folds.SQL[name]).df())


def test_online_correlation_is_the_recurrence(spark, sf):
    rows = sorted((r.asDict() for r in folds.votes_by_model(spark, sf).collect()), key=lambda r: r["doc_id"])
    got = {r["doc_id"]: r["correlation"] for r in folds.a13_online_correlation(spark, sf).collect()}
    seen = defaultdict(list)
    for r in rows:
        seen[r["source"]].append([float(r[f"vote_{m}"] == r["gold"]) for m in ("reader", "board")])
        x = np.array(seen[r["source"]])
        means = np.array([x[: k + 1].mean(0) for k in range(len(x))])  # after each update
        product = ((x - means).prod(1)).sum()
        sd = x.std(0, ddof=1) if len(x) > 1 else np.zeros(2)
        if min(sd) > 0:
            assert got[r["doc_id"]] == pytest.approx(np.clip(product / (len(x) - 1) / sd.prod(), -1, 1), abs=1e-6)
    assert len(got) == len(rows)


def test_sequential_risk_is_an_independent_replay(spark, sf):
    """The same by plain tables, written anew: two labels, so a belief is one number."""
    rows = sorted((r.asDict() for r in folds.votes_by_model(spark, sf).collect()), key=lambda r: r["doc_id"])
    got = {r["doc_id"]: r for r in folds.d26_sequential_risk(spark, sf).collect()}
    h = lambda p: -sum(x * math.log(x) for x in (p, 1 - p) if x > 0)
    clip = lambda a: min(1 - 1e-6, max(0.5 + 1e-6, a))
    low = lambda a, b: min(1, max(0, a / (a + b) - 1.28 * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))))
    for source in {r["source"] for r in rows}:
        trust = {m: [4.08, 1.92, 0] for m in folds.NAMES}
        bins = defaultdict(lambda: [2.0, 2.0, 0])
        pairs = defaultdict(lambda: [0, 0])
        for turn, r in enumerate(x for x in rows if x["source"] == source):
            acc = {m: clip(low(a, b) if n >= 8 else a / (a + b)) for m, (a, b, n) in trust.items()}
            tolerance = 0.01 if source in folds.CRITICAL else 0.03
            p, asked = 0.5, []  # belief in the second label

            def update(p, second, a):
                good, bad = (a, 1 - a) if second else (1 - a, a)
                return p * good / (p * good + (1 - p) * bad)

            def diverse(m):
                worst = max([(pairs[min(m, o), max(m, o)][0] + 1) / (pairs[min(m, o), max(m, o)][1] + 2) for o in asked if pairs[min(m, o), max(m, o)][1] >= 5], default=0)
                return max(0.05, 1 - 0.45 * worst)

            while len(asked) < len(folds.NAMES):
                left = [m for m in folds.NAMES if m not in asked]

                def rank(m):
                    a = acc[m]
                    yes = p * a + (1 - p) * (1 - a)
                    gain = max(0, h(p) - yes * h(update(p, True, a)) - (1 - yes) * h(update(p, False, a)))
                    return gain * diverse(m) / r[f"cost_{m}"], gain, -r[f"cost_{m}"], m

                m = "board" if "board" in left and len(asked) >= 2 and min(p, 1 - p) > 0.2 else max(left, key=rank)
                a, b, n = bins[m, min(9, int(r[f"confidence_{m}"] * 10))]
                e = clip(low(a, b)) if n >= 5 else acc[m]
                p = update(p, r[f"vote_{m}"] == LABELS[1], clip(0.5 + diverse(m) * (e - 0.5)))
                asked.append(m)
                if turn >= 5 and min(p, 1 - p) <= tolerance:
                    break
            label = LABELS[p > 0.5 + 1e-9]  # equal beliefs: the first
            out = got[r["doc_id"]]
            assert (out["label"], out["models"]) == (label, ",".join(asked)) and out["risk"] == pytest.approx(min(p, 1 - p), abs=1e-8)
            for m in asked:
                right = r[f"vote_{m}"] == label
                for s in (trust[m], bins[m, min(9, int(r[f"confidence_{m}"] * 10))]):
                    s[0] += max(p, 1 - p) * right
                    s[1] += max(p, 1 - p) * (not right)
                    s[2] += 1
            for i, m in enumerate(asked):
                for o in asked[:i]:
                    pair = pairs[min(m, o), max(m, o)]
                    pair[0] += r[f"vote_{m}"] == r[f"vote_{o}"]
                    pair[1] += 1
    assert len(got) == len(rows)
