"""State of ordered folds: votes asked for one at a time until the risk is low enough, correlations kept online, beliefs passed forward."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np


def entropy(p: np.ndarray) -> float:
    p = p[p > 0]
    return float(-(p * np.log(p)).sum())


def after_vote(belief: np.ndarray, vote: int, accuracy: float) -> np.ndarray:
    """Belief after a vote of a model that errs alike towards all other labels."""
    n = len(belief)
    a = min(1 - 1e-6, max(1 / n + 1e-6, accuracy))
    p = belief * np.where(np.arange(n) == vote, a, (1 - a) / (n - 1))
    return p / p.sum()


def vote_gain(belief: np.ndarray, accuracy: float) -> float:
    """Entropy that a vote is expected to take away."""
    n = len(belief)
    a = min(1 - 1e-6, max(1 / n + 1e-6, accuracy))
    left = sum((belief[v] * a + (1 - belief[v]) * (1 - a) / (n - 1)) * entropy(after_vote(belief, v, a)) for v in range(n))
    return max(0.0, entropy(belief) - left)


@dataclass
class SoftBeta:
    """A Beta posterior of being right that takes weighted and partial evidence."""

    alpha: float
    beta: float
    n: int = 0

    def bound(self, z: float, least: int, before: float | None = None) -> float:
        """Mean less z deviations; until `least` observations `before`, or else the mean."""
        whole = self.alpha + self.beta
        mean = self.alpha / whole
        if self.n < least:
            return mean if before is None else before
        return min(1.0, max(0.0, mean - z * math.sqrt(self.alpha * self.beta / (whole * whole * (whole + 1)))))

    def add(self, right: float, weight: float = 1.0) -> None:
        self.alpha += weight * right
        self.beta += weight * (1 - right)
        self.n += 1


@dataclass
class RiskSequence:
    """Asks models one at a time - most information for the cost, less for those that repeat one another - until the risk is within the tolerance.

    Reliability starts at a Beta prior and learns from the final label, weighted by the belief in it; reported confidence is
    calibrated in bins. After after_models votes with much risk left the fallback model goes first.
    """

    models: list[str]
    labels: tuple[str, ...]
    least: int = 1
    warm_up: int = 5
    z: float = 1.28
    prior: float = 0.68
    strength: float = 6.0
    seen_least: int = 8
    bins: int = 10
    bin_prior: float = 4.0
    bin_least: int = 5
    penalty: float = 0.45
    pair_least: int = 5
    fallback: str | None = None
    after_models: int = 2
    trigger: float = 0.2
    rounds: int = 0
    trust: dict = None
    told: dict = field(default_factory=dict)
    pairs: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.trust = self.trust or {m: SoftBeta(self.prior * self.strength, (1 - self.prior) * self.strength) for m in self.models}

    def _bin(self, model: str, confidence: float) -> SoftBeta:
        return self.told.setdefault((model, min(self.bins - 1, int(confidence * self.bins))), SoftBeta(self.bin_prior / 2, self.bin_prior / 2))

    def diversity(self, model: str, asked: list[str]) -> float:
        worst = 0.0
        for other in asked:
            same, n = self.pairs.get(frozenset((model, other)), (0, 0))
            if n >= self.pair_least:
                worst = max(worst, (same + 1) / (n + 2))
        return max(0.05, 1 - self.penalty * worst)

    def step(self, votes: dict[str, str], costs: dict[str, float], confidences: dict[str, float | None], tolerance: float, start: np.ndarray | None = None) -> dict:
        """start: what is believed before any vote; flat if nothing is."""
        k = len(self.labels)
        accuracy = {m: min(1 - 1e-6, max(1 / k + 1e-6, self.trust[m].bound(self.z, self.seen_least))) for m in self.models}
        belief, asked, left = np.full(k, 1 / k) if start is None else start, [], set(self.models)
        while left:
            if self.fallback in left and len(asked) >= self.after_models and 1 - belief.max() > self.trigger:
                m = self.fallback
            else:
                gain = {x: vote_gain(belief, accuracy[x]) for x in left}
                m = max(left, key=lambda x: (gain[x] * self.diversity(x, asked) / max(costs[x], 1e-12), gain[x], -costs[x], x))
            left.remove(m)
            a, told = accuracy[m], confidences.get(m)
            if told is not None and 0 <= told <= 1:
                a = min(1 - 1e-6, max(1 / k + 1e-6, self._bin(m, told).bound(self.z, self.bin_least, a)))
            belief = after_vote(belief, self.labels.index(votes[m]), 1 / k + self.diversity(m, asked) * (a - 1 / k))
            asked.append(m)
            if self.rounds >= self.warm_up and len(asked) >= self.least and 1 - belief.max() <= tolerance:
                break
        best = int(np.isclose(belief, belief.max(), rtol=1e-9, atol=0).argmax())  # the first of those that are as likely
        label, sure = self.labels[best], float(belief[best])
        for m in asked:
            right = float(votes[m] == label)
            self.trust[m].add(right, sure)
            if confidences.get(m) is not None and 0 <= confidences[m] <= 1:
                self._bin(m, confidences[m]).add(right, sure)
        for i, m in enumerate(asked):
            for other in asked[:i]:
                same, n = self.pairs.get(frozenset((m, other)), (0, 0))
                self.pairs[frozenset((m, other))] = (same + (votes[m] == votes[other]), n + 1)
        self.rounds += 1
        return {"label": label, "asked": asked, "confidence": sure, "cost": sum(costs[m] for m in asked), "abstained": 1 - sure > tolerance, "belief": belief}


@dataclass
class OnlineCorrelation:
    """Correlation of two rewards from means as they stood at each update; 0 until both have been seen and have varied."""

    n: int = 0
    mean: tuple = (0.0, 0.0)
    m2: tuple = (0.0, 0.0)
    product: float = 0.0
    value: float = 0.0

    def add(self, x: float, y: float) -> float:
        self.n += 1
        old, now = self.mean, (x, y)
        self.mean = tuple(m + (v - m) / self.n for m, v in zip(old, now))
        self.m2 = tuple(s + (v - new) * (v - m) for s, v, new, m in zip(self.m2, now, self.mean, old))
        self.product += (x - self.mean[0]) * (y - self.mean[1])
        if self.n > 1 and min(self.m2) > 0:
            deviation = math.sqrt(self.m2[0] / (self.n - 1)) * math.sqrt(self.m2[1] / (self.n - 1))
            self.value = min(1.0, max(-1.0, self.product / (self.n - 1) / deviation))
        return self.value


def passed_on(own: float, parents: list[tuple[float, float]], beta: float, transition: tuple[float, float], prior: float) -> float:
    """A belief after what its parents (weight, belief) say through the transition, as log odds against the prior."""

    def logit(p: float) -> float:
        p = min(1 - 1e-5, max(1e-5, p))
        return math.log(p / (1 - p))

    whole = sum(w for w, _ in parents)
    if not whole or not beta:
        return own
    message = sum(w * ((1 - p) * transition[0] + p * transition[1]) for w, p in parents) / whole
    x = logit(own) + beta * (logit(message) - logit(prior))
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, x))))
