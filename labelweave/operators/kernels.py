"""Numeric steps of the online labeller: one small step at a time, on arrays, without Spark.

The order of a stream decides its results, so a stream is folded row by row; plans/replay.py lets Spark run the folds of many
streams and settings side by side, streaming/windows.py runs the same steps on a live stream.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np

TOKEN = re.compile(r"[\w-]+")


def embed(text: str, dimension: int = 64) -> np.ndarray:
    """Signed feature hashing of the words, scaled to length 1; a text without words gives the zero vector."""
    v = np.zeros(dimension)
    for token in TOKEN.findall(text.lower()):
        h = hashlib.blake2b(token.encode(), digest_size=16).digest()
        v[int.from_bytes(h[:8], "big") % dimension] += 1 if h[8] & 1 else -1
    size = np.linalg.norm(v)
    return v / size if size else v


def beta_cdf(x: float, a: float, b: float) -> float:
    """I_x(a, b) by the hypergeometric series x^a (1 - x)^b / (a B(a, b)) * sum (a + b)_n / (a + 1)_n x^n, mirrored where that is shorter."""
    if a <= 0 or b <= 0:
        raise ValueError("shape parameters are positive")
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(1 - x, b, a)
    term = total = 1.0
    n = 0
    while term > 1e-17 * total:
        term *= (a + b + n) / (a + 1 + n) * x
        total += term
        n += 1
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x) - math.log(a)
    return min(1.0, max(0.0, math.exp(log_front) * total))


@lru_cache(maxsize=16)
def _outcomes(n: int) -> np.ndarray:
    return ((np.arange(1 << n)[:, None] >> np.arange(n)) & 1).astype(bool)


def majority_confidence(bounds: np.ndarray, weights: np.ndarray) -> float:
    """Probability that the right votes weigh strictly more than half, votes being right independently with these bounds."""
    right = _outcomes(len(bounds))
    p = np.where(right, bounds, 1 - bounds).prod(1)
    return float(p[(right * weights).sum(1) > weights.sum() / 2].sum())


def beta_confidence(bounds: np.ndarray, weights: np.ndarray) -> float:
    """The same by a Beta distribution over the weight of right votes."""
    right = float(bounds @ weights)
    wrong = float(weights.sum() - right)
    return 1 - beta_cdf(0.5, max(right, 1e-9), max(wrong, 1e-9))


def copula_confidence(bounds: np.ndarray, weights: np.ndarray, correlation: np.ndarray, draws: int = 4096, seed: int = 17) -> float:
    """The same for correlated votes: a Gaussian copula, by Monte Carlo; the matrix is made positive semi-definite first."""
    from statistics import NormalDist

    values, vectors = np.linalg.eigh((correlation + correlation.T) / 2)
    root = vectors * np.sqrt(np.maximum(values, 1e-8))
    root /= np.sqrt((root**2).sum(1, keepdims=True))
    z = np.random.default_rng(seed).standard_normal((draws, len(bounds))) @ root.T
    cut = np.array([NormalDist().inv_cdf(min(1 - 1e-9, max(1e-9, p))) for p in bounds])
    return float((((z <= cut) * weights).sum(1) > weights.sum() / 2).mean())


def majority_confidences(bounds: np.ndarray, weights: np.ndarray, members: np.ndarray) -> list[float]:
    """majority_confidence of many subsets of one size, a row of members' places each."""
    right = _outcomes(members.shape[1])
    b, w = bounds[members][:, None], weights[members][:, None]
    p = np.where(right, b, 1 - b).prod(2)
    return [float(x[y].sum()) for x, y in zip(p, (right * w).sum(2) > w.sum(2) / 2)]


@lru_cache(maxsize=16)
def _subsets(n: int, least: int) -> list[np.ndarray]:
    """The subsets of each size, rows of places."""
    return [np.array(list(combinations(range(n), size))) for size in range(least, n + 1)]


def cheapest_subset(bounds: np.ndarray, weights: np.ndarray, costs: np.ndarray, need: float, least: int, confidence=majority_confidence) -> tuple[tuple[int, ...], float, bool]:
    """Members (by place), confidence, feasible: least (cost, size, members) among subsets that reach `need`; else all."""
    found = []
    for sets in _subsets(len(bounds), least):
        sure = majority_confidences(bounds, weights, sets) if confidence is majority_confidence else [confidence(bounds[i], weights[i]) for i in sets]
        found += [(cost, sets.shape[1], k, c, sets) for k, (cost, c) in enumerate(zip(costs[sets].sum(1).tolist(), sure)) if c >= need]
    if found:
        _, _, k, c, sets = min(found, key=lambda x: x[:3])
        return tuple(sets[k].tolist()), c, True
    return tuple(range(len(bounds))), confidence(bounds, weights), False


@dataclass
class Moments:
    n: int = 0
    mean: float = 0.0
    m2: float = 0.0

    def add(self, x: float) -> None:
        self.n += 1
        d = x - self.mean
        self.mean += d / self.n
        self.m2 += d * (x - self.mean)

    def beta(self, eps: float = 1e-6) -> tuple[float, float]:
        """Shapes of a Beta distribution with this mean and population variance."""
        m = min(1 - eps, max(eps, self.mean))
        c = min(1e6, max(eps, m * (1 - m) / max(self.m2 / self.n if self.n else 0.0, eps * eps) - 1))
        return max(eps, m * c), max(eps, (1 - m) * c)


@dataclass
class Arm:
    """A model's state: ridge regression of agreement on context, scores seen with and without agreement, counts."""

    dimension: int
    ridge: float = 1.0
    inverse: np.ndarray = None
    b: np.ndarray = None
    match: Moments = field(default_factory=Moments)
    mismatch: Moments = field(default_factory=Moments)
    seen: int = 0
    agreed: int = 0

    def __post_init__(self) -> None:
        if self.inverse is None:
            self.inverse = np.eye(self.dimension) / self.ridge
            self.b = np.zeros(self.dimension)

    def score(self, x: np.ndarray, alpha: float = 0.25, eps: float = 1e-6) -> tuple[float, float]:
        """Predicted agreement, and its lower confidence bound."""
        raw = float(x @ (self.inverse @ self.b))
        width = alpha * math.sqrt(max(0.0, float(x @ self.inverse @ x)))
        return min(1.0, max(0.0, raw)), min(1 - eps, max(eps, raw - width))

    def calibrated(self, q: float, prior: float, eps: float = 1e-6, least: int = 3) -> float:
        """P(agreement | score) from the scores' two Beta densities; the score itself until both have a few."""
        q = min(1 - eps, max(eps, q))
        if min(self.match.n, self.mismatch.n) < least:
            return q
        logs = []
        for weight, moments in ((prior, self.match), (1 - prior, self.mismatch)):
            a, b = moments.beta(eps)
            logs.append(math.log(min(1 - eps, max(eps, weight))) + (a - 1) * math.log(q) + (b - 1) * math.log1p(-q) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b))
        return min(1 - eps, max(eps, 1 / (1 + math.exp(min(700.0, logs[1] - logs[0])))))

    def history(self) -> float:
        return (self.agreed + 1) / (self.seen + 2)

    def learn(self, x: np.ndarray, prediction: float, agreed: bool) -> None:
        p = self.inverse @ x
        self.inverse -= np.outer(p, p) / (1 + float(x @ p))  # stays symmetric to the last bit, as the outer product is
        self.b += float(agreed) * x
        (self.match if agreed else self.mismatch).add(min(1 - 1e-6, max(1e-6, prediction)))
        self.seen += 1
        self.agreed += agreed


def smoothed(estimate: float, n: int, t: int, weight: float = 1.0) -> float:
    w = weight * math.log(t + 1)
    return (estimate * n + 0.5 * w) / (n + w) if n + w else 0.5


@dataclass
class Labeller:
    """Scores the pool, picks the cheapest confident subset before any vote is seen, votes, learns from agreement."""

    models: list[str]
    dimension: int
    need: float = 0.95
    least: int = 3
    warm_up: int = 10
    graph_weight: float = 0.0
    arms: dict[str, Arm] = None
    rounds: int = 0
    past: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.arms = self.arms or {m: Arm(self.dimension) for m in self.models}

    def scores(self, x: np.ndarray, neighbours: list[tuple[int, float]] = ()) -> tuple[np.ndarray, np.ndarray, list[float]]:
        """Lower bounds, vote weights and predictions. Bounds are smoothed over neighbours that are in the past already."""
        bounds, weights, predictions = [], [], []
        for m in self.models:
            arm = self.arms[m]
            prediction, low = arm.score(x)
            history = arm.history()
            y = smoothed(arm.calibrated(low, history), arm.seen, self.rounds + 1)
            known = [(w, self.past[n][m]) for n, w in neighbours if n in self.past]
            lam = self.graph_weight
            if lam and known:
                y = (y + lam * sum(w * f for w, f in known)) / (1 + lam * sum(w for w, _ in known))
            bounds.append(min(1.0, max(0.0, y)))
            weights.append(max(1e-6, history * prediction))
            predictions.append(prediction)
        return np.array(bounds), np.array(weights), predictions

    def step(self, key: int, x: np.ndarray, costs: np.ndarray, votes: dict[str, str], labels: tuple[str, ...], neighbours: list[tuple[int, float]] = ()) -> dict:
        bounds, weights, predictions = self.scores(x, neighbours)
        if self.rounds < self.warm_up:
            chosen, confidence, feasible = tuple(range(len(self.models))), majority_confidence(bounds, weights), True
        else:
            chosen, confidence, feasible = cheapest_subset(bounds, weights, costs, self.need, self.least)
        totals = dict.fromkeys(labels, 0.0)
        for i in chosen:
            totals[votes[self.models[i]]] += weights[i]
        top = max(totals.values())
        label = next(v for v in labels if math.isclose(totals[v], top))
        self.past[key] = dict(zip(self.models, bounds))
        if len(chosen) > 1:
            for i in chosen:
                self.arms[self.models[i]].learn(x, predictions[i], votes[self.models[i]] == label)
        self.rounds += 1
        return {"label": label, "models": [self.models[i] for i in chosen], "confidence": confidence, "cost": float(costs[list(chosen)].sum()), "feasible": feasible}


@dataclass
class WeightedMajority:
    """Full vote whose weights follow each model's agreement with the outcome so far."""

    models: list[str]
    agreed: dict[str, int] = None
    n: int = 0

    def __post_init__(self) -> None:
        self.agreed = self.agreed or dict.fromkeys(self.models, 0)

    def step(self, votes: dict[str, str], labels: tuple[str, ...]) -> str:
        totals = dict.fromkeys(labels, 0.0)
        for m in self.models:
            totals[votes[m]] += (self.agreed[m] + 1) / (self.n + 2)
        top = max(totals.values())
        label = next(v for v in labels if math.isclose(totals[v], top))
        for m in self.models:
            self.agreed[m] += votes[m] == label
        self.n += 1
        return label


@dataclass
class StateSwitch:
    """Keeps an entity's last audited state unless the votes' pattern tells of another with enough past support."""

    labels: tuple[str, ...]
    prior: float = 16.0
    threshold: float = 0.75
    support: int = 2
    last: dict = field(default_factory=dict)
    follows: dict = field(default_factory=dict)
    patterns: dict = field(default_factory=dict)

    def posterior(self, entity, pattern: tuple[str, ...]) -> tuple[np.ndarray, float]:
        before = self.last.get(entity)
        base = self.follows.get(before, np.zeros(len(self.labels))) + 1.0
        counts = self.patterns.get((before, pattern), np.zeros(len(self.labels)))
        p = counts + self.prior * base / base.sum()
        return p / p.sum(), float(counts.sum())

    def step(self, entity, pattern: tuple[str, ...], vote: str) -> str:
        before = self.last.get(entity)
        if before is None:
            return vote
        p, seen = self.posterior(entity, pattern)
        best = int(p.argmax())
        return self.labels[best] if seen >= self.support and p[best] >= self.threshold else before

    def audit(self, entity, pattern: tuple[str, ...], gold: str) -> None:
        before = self.last.get(entity)
        i = self.labels.index(gold)
        for table, key in ((self.follows, before), (self.patterns, (before, pattern))):
            table.setdefault(key, np.zeros(len(self.labels)))[i] += 1
        self.last[entity] = gold


def audited(key, seed: int = 991, rate: float = 1.0) -> bool:
    """Whether an item's true label becomes known: by hash, so it doesn't depend on the order."""
    return int.from_bytes(hashlib.sha256(f"{seed}:{key}".encode()).digest()[:8], "big") / 2**64 < rate
