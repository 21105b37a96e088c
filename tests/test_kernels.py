import math

import numpy as np
import pytest

from labelweave.operators import kernels as K


def test_majority_confidence_by_hand():
    assert K.majority_confidence(np.array([0.8, 0.7, 0.6]), np.ones(3)) == pytest.approx(0.788)
    assert K.majority_confidence(np.array([0.9, 0.9]), np.ones(2)) == pytest.approx(0.81)  # a tie is no majority


def test_beta_cdf():
    assert K.beta_cdf(0.5, 2, 2) == pytest.approx(0.5)
    for a, b in ((0.3, 4.0), (2.5, 1.5), (4.0, 6.0), (1.0, 1.0)):
        for x in (0.02, 0.3, 0.5, 0.9, 0.999):  # against the integral, by the substitution t = x u^(1 / a)
            u = (np.arange(400_000) + 0.5) / 400_000
            front = x**a / a / math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
            assert K.beta_cdf(x, a, b) == pytest.approx(min(1.0, front * np.mean((1 - x * u ** (1 / a)) ** (b - 1))), abs=2e-4)
    assert K.beta_cdf(0, 1, 2) == 0 and K.beta_cdf(1, 1, 2) == 1
    with pytest.raises(ValueError):
        K.beta_cdf(0.5, 0, 1)


def test_cheapest_subset():
    chosen = K.cheapest_subset(np.array([0.9, 0.85, 0.95]), np.ones(3), np.array([0.1, 0.5, 2.0]), 0.8, 1)
    assert chosen[0] == (0,) and chosen[2]
    assert K.cheapest_subset(np.array([0.6, 0.6]), np.ones(2), np.ones(2), 0.99, 1)[0::2] == ((0, 1), False)


def test_calibration_needs_both_classes_and_then_tells_them_apart():
    arm = K.Arm(2)
    assert arm.calibrated(0.7, 0.5) == 0.7
    for q in (0.7, 0.8, 0.9):
        arm.match.add(q)
    for q in (0.1, 0.2, 0.3):
        arm.mismatch.add(q)
    assert arm.calibrated(0.8, 0.5) > 0.5 > arm.calibrated(0.2, 0.5)


def test_arm_is_ridge_regression():
    rng = np.random.default_rng(0)
    arm, x, y = K.Arm(4), rng.normal(size=(30, 4)), rng.integers(0, 2, 30)
    for a, b in zip(x, y):
        arm.learn(a, 0.5, bool(b))
    theta = np.linalg.solve(np.eye(4) + x.T @ x, x.T @ y)
    assert np.allclose(arm.inverse @ arm.b, theta)


def test_smoothing_and_copula():
    assert K.smoothed(0.9, 0, 1) == 0.5
    p = np.full(3, 0.75)
    free = K.copula_confidence(p, np.ones(3), np.eye(3), 20_000, 12)
    tied = K.copula_confidence(p, np.ones(3), np.full((3, 3), 0.8) + 0.2 * np.eye(3), 20_000, 12)
    assert free == pytest.approx(0.84375, abs=0.012) and tied < free


def test_labeller_never_depends_on_what_comes_later():
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4), {m: rng.choice(["a", "b"]) for m in "xyz"}) for i in range(40)]

    def run(rows):
        labeller = K.Labeller(list("xyz"), 4, need=0.6, least=1, warm_up=5, graph_weight=0.5)
        return [labeller.step(i, x, np.array([1.0, 2.0, 3.0]), v, ("a", "b"), [(i - 1, 0.5), (i + 1, 0.5)]) for i, x, v in rows]

    changed = rows[:30] + [(i, -x, v) for i, x, v in rows[30:]]
    assert run(rows)[:30] == run(changed)[:30]
    assert any(len(r["models"]) < 3 for r in run(rows))


def test_state_switch():
    s = K.StateSwitch(("a", "b"), prior=1.0)
    assert s.step("e", ("b",), "b") == "b"  # nothing is known of the entity
    s.audit("e", ("b",), "a")
    assert s.step("e", ("b",), "b") == "a"
    for _ in range(12):
        s.last["e"] = "a"
        s.audit("e", ("b",), "b")
    s.last["e"] = "a"
    assert s.step("e", ("b",), "a") == "b"


def test_embedding_and_audit():
    v = K.embed("Some words, some more", 16)
    assert np.linalg.norm(v) == pytest.approx(1) and not K.embed("", 16).any()
    assert K.audited("x", rate=1.0) and not K.audited("x", rate=0.0)


def test_subsets_of_a_size_are_weighed_together(monkeypatch):
    """cheapest_subset as by trying every subset, to the last bit, without a call for each (before: up to 42)."""
    from itertools import combinations

    from labelweave.operators import kernels as k

    rng, plain, calls = np.random.default_rng(2), k.majority_confidence, []
    for need in (0.5, 0.8, 0.95, 1.1) * 10:
        bounds, weights, costs = rng.random(6), rng.random(6), rng.integers(1, 4, 6) / 7
        rows = [(float(costs[list(m)].sum()), n, m, plain(bounds[list(m)], weights[list(m)])) for n in range(3, 7) for m in combinations(range(6), n)]
        best = min((r for r in rows if r[3] >= need), default=None)
        want = (best[2], best[3], True) if best else (tuple(range(6)), plain(bounds, weights), False)
        with monkeypatch.context() as patch:
            patch.setattr(k, "_outcomes", lambda n, f=k._outcomes: calls.append(n) or f(n))
            assert k.cheapest_subset(bounds, weights, costs, need, 3) == want
    assert len(calls) <= 5 * 40
