"""Subset votes whose models and labels are weighed by an item's known parents: reward transitions, a label prior from structure, calibrated votes and their exact confidence."""

from __future__ import annotations

import math
from collections import OrderedDict
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np

#: Outcomes up to which a subset's confidence is summed exactly; beyond it the models are taken to err independently and alike.
MOST_OUTCOMES = 65_536
Edge = tuple[str, float, tuple[str, ...]]


@dataclass(frozen=True)
class SubsetSettings:
    # fixed values: the defaults of the settings
    regularization: float = 0.5
    transition_prior: float = 1.0
    least_transitions: float = 6.0
    lower_z: float = 1.28
    least_informative: float = 0.02
    most_edge: float = 2.0
    most_weight: float = 8.0
    unaudited_weight: float = 0.25
    prior_power: float = 0.0
    calibrated: bool = False
    confusion_prior: float = 1.0
    temperature: float = 1.0
    blend: float = 1.0
    memory: int = 4096

    def __post_init__(self) -> None:
        values = [v for k, v in self.__dict__.items() if k != "calibrated"]
        positive = (self.transition_prior, self.lower_z, self.most_edge, self.most_weight, self.confusion_prior, self.temperature, self.memory)
        if not all(math.isfinite(v) and v >= 0 for v in values) or not all(positive) or self.least_informative > 1 or self.blend > 1:
            raise ValueError("settings out of range")


class Counts:
    """Tables of transitions by name, each with the weight that it has seen."""

    def __init__(self, k: int, prior: float) -> None:
        self.k, self.prior, self.tables, self.seen = k, prior, {}, {}

    def add(self, name, parent: np.ndarray, child: np.ndarray, weight: float) -> None:
        if name not in self.tables:
            self.tables[name], self.seen[name] = np.full((self.k, self.k), self.prior), 0.0
        self.tables[name] += weight * np.outer(parent, child)
        self.seen[name] += weight

    def mature(self, name, least: float) -> float | None:
        """How far the table is to be trusted, or None where too little was seen."""
        n = self.seen.get(name, 0.0)
        return n / (n + least) if n >= least and name in self.tables else None

    def onward(self, name, parent: np.ndarray) -> np.ndarray:
        t = self.tables[name]
        return parent @ (t / t.sum(1, keepdims=True))


@lru_cache(maxsize=64)
def grid(k: int, size: int) -> np.ndarray:
    """Every outcome of `size` votes for k labels, a row each."""
    return np.stack(np.meshgrid(*[np.arange(k)] * size, indexing="ij"), -1).reshape(-1, size)


def likeliest(weights: np.ndarray) -> np.ndarray:
    """Of each row the first place that is as high as the highest, within a relative 1e-9."""
    top = weights.max(-1, keepdims=True)
    return (np.abs(weights - top) <= 1e-9 * np.maximum(np.abs(weights), np.abs(top))).argmax(-1)


@dataclass
class SubsetHead:
    models: list[str]
    labels: tuple[str, ...]
    settings: SubsetSettings = field(default_factory=SubsetSettings)

    def __post_init__(self) -> None:
        s, k = self.settings, len(self.labels)
        self.rewards = Counts(2, s.transition_prior)  # by model and relation
        self.onward = Counts(k, s.transition_prior)  # of labels, by relation
        self.structure: dict[str, np.ndarray] = {}  # labels of audited items by feature
        self.structure_seen: dict[str, float] = {}
        self.classes = np.ones(k)
        self.confusion = {m: np.full((k, k), s.confusion_prior) for m in self.models}
        self.history: OrderedDict[str, tuple[dict[str, float], np.ndarray]] = OrderedDict()  # rewards by model and label of the last items

    def parents(self, edges: dict[str, tuple[float, tuple[str, ...]]]) -> list[Edge]:
        """Heaviest first, until their weight is used up."""
        s = self.settings
        rows = sorted(((p, min(w, s.most_edge), tuple(sorted(r or ("default",)))) for p, (w, r) in edges.items() if w > 0), key=lambda x: (-x[1], x[0], x[2]))
        out, left = [], s.most_weight
        for p, w, names in rows:
            if left <= 0:
                break
            out.append((p, min(w, left), names))
            left -= out[-1][1]
        return out

    @staticmethod
    def features(parents: list[Edge]) -> dict[str, float]:
        """What an item's past shows without any label: its relations by weight, how many parents, how heavy."""
        out: dict[str, float] = {}
        for _, w, names in parents:
            for r in names:
                out[f"relation:{r}"] = out.get(f"relation:{r}", 0.0) + w / len(names)
        out[f"indegree:{min(3, len(parents))}"] = 1.0
        out[f"parent_weight:{min(3, int(sum(w for _, w, _ in parents)))}"] = 1.0
        return out

    def label_prior(self, parents: list[Edge]) -> tuple[np.ndarray, int]:
        """Label rates moved by log odds of what the structure and the parents' labels predict; and how many of these spoke."""
        s = self.settings
        base = self.classes / self.classes.sum()
        said = []
        for f, w in self.features(parents).items():
            n = self.structure_seen.get(f, 0.0)
            if f in self.structure and n >= s.least_transitions:
                said.append((min(w, s.most_edge), n / (n + s.least_transitions), self.structure[f] / self.structure[f].sum()))
        for p, w, names in parents:
            if p in self.history:
                for r in names:
                    m = self.onward.mature(r, s.least_transitions)
                    if m is not None:
                        said.append((w / len(names), m, self.onward.onward(r, self.history[p][1])))
        if not said:
            return base, 0
        low = np.log(np.maximum(base, 1e-12))
        x = low + sum(w * (np.log(np.maximum(m * q + (1 - m) * base, 1e-12)) - low) for w, m, q in said)
        p = np.exp(x - x.max())
        return p / p.sum(), len(said)

    def reward_bound(self, model: str, relation: str, parent: float) -> tuple[float, float] | None:
        """What a parent's reward says of the model's next one, as a lower bound, and its weight; None where it says too little."""
        s, name = self.settings, (model, relation)
        mature = self.rewards.mature(name, s.least_transitions)
        if mature is None:
            return None
        low = []
        for beta, alpha in self.rewards.tables[name].tolist():
            n = alpha + beta
            low.append(min(1.0, max(0.0, alpha / n - s.lower_z * math.sqrt(alpha * beta / (n * n * (n + 1))))))
        said = (1 - parent) * low[0] + parent * low[1]
        informative = abs(said - 0.5) * 2
        return None if informative < s.least_informative else (said, mature * informative)

    def regularized(self, bounds: dict[str, float], parents: list[Edge]) -> dict[str, float]:
        """Bounds of the models drawn towards what their parents' rewards say."""
        out = {}
        for m, own in bounds.items():
            top, whole = own, 1.0
            for p, w, names in parents:
                reward = self.history[p][0].get(m) if p in self.history else None
                if reward is None:
                    continue
                for r in names:
                    said = self.reward_bound(m, r, reward)
                    if said and (g := self.settings.regularization * w / len(names) * said[1]) > 0:
                        top, whole = top + g * said[0], whole + g
            out[m] = min(1.0, max(0.0, top / whole))
        return out

    def votes(self, outcomes: np.ndarray, weights: np.ndarray, subset: list[str], prior: np.ndarray, used: int) -> np.ndarray:
        """The label of each outcome - a row of the subset's votes - as its place."""
        s, k = self.settings, len(self.labels)
        plain, rows = np.zeros((len(outcomes), k)), np.arange(len(outcomes))
        for j in range(len(subset)):
            plain[rows, outcomes[:, j]] += weights[j]
        if not s.calibrated:
            if used and s.prior_power > 0:
                sure = 1 + float((prior * np.log(np.maximum(prior, 1e-12))).sum()) / math.log(k)
                plain = plain + s.prior_power * sure * weights.sum() * prior
            return likeliest(plain)
        x = np.tile((s.prior_power if used else 0.0) * np.log(np.maximum(prior, 1e-12)), (len(outcomes), 1))
        mean = max(1e-12, float(weights.mean()))
        for j, m in enumerate(subset):
            c = self.confusion[m] / self.confusion[m].sum(1, keepdims=True)
            x += (s.temperature * weights[j] / mean * np.log(np.maximum(c.T, 1e-12)))[outcomes[:, j]]
        p = np.exp(x - x.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return likeliest((1 - s.blend) * plain / max(weights.sum(), 1e-12) + s.blend * p)

    def confidence(self, subset: list[str], bounds: dict[str, float], weights: dict[str, float], prior: np.ndarray, used: int) -> float:
        """Probability that the subset's vote is right: the sum over the true label and every outcome of the votes."""
        k, w = len(self.labels), np.array([weights[m] for m in subset])
        if self.settings.calibrated and k ** len(subset) <= MOST_OUTCOMES:
            outcomes = grid(k, len(subset))
            label = self.votes(outcomes, w, subset, prior, used)
            total = 0.0
            for t in range(k):
                p = np.full(len(outcomes), prior[t])
                for j, m in enumerate(subset):
                    p = p * (self.confusion[m][t] / self.confusion[m][t].sum())[outcomes[:, j]]
                total += float(p[label == t].sum())
            return min(1.0, max(0.0, total))
        right = grid(2, len(subset))
        a = np.array([bounds[m] for m in subset])
        p = np.where(right == 1, a, 1 - a).prod(1)
        if k != 2:
            return float(p[(right * w).sum(1) > w.sum() / 2].sum())
        sure = 1 + float((prior * np.log(np.maximum(prior, 1e-12))).sum()) / math.log(2)
        pull = self.settings.prior_power * sure * w.sum()
        total = 0.0
        for t in (0, 1):
            for_t = (np.where(right == 1, 1, 0) * w).sum(1) + pull * prior[t]
            against = (np.where(right == 1, 0, 1) * w).sum(1) + pull * prior[1 - t]
            total += float(prior[t] * p[(for_t >= against) if t == 0 else (for_t > against)].sum())
        return min(1.0, max(0.0, total))

    def choose(self, bounds: dict[str, float], weights: dict[str, float], costs: dict[str, float], prior: np.ndarray, used: int, need: float, least: int = 1) -> tuple[list[str], float, bool]:
        """The cheapest subset (then the smallest, then by name) that is confident enough; all models if none is."""
        names = sorted(self.models)
        every = (m for size in range(least, len(names) + 1) for m in combinations(names, size))
        for _, _, subset in sorted((sum(costs[m] for m in m_), len(m_), m_) for m_ in every):
            c = self.confidence(list(subset), bounds, weights, prior, used)
            if c >= need:  # the first in this order is the least
                return list(subset), c, True
        return names, self.confidence(names, bounds, weights, prior, used), False

    def record(self, node: str, parents: list[Edge], rewards: dict[str, float], label: str, audited: bool, votes: dict[str, str] | None = None) -> None:
        """What an item has taught: from its true label wholly, from the label that was decided by `unaudited_weight`."""
        s, at = self.settings, self.labels.index(label)
        weight = 1.0 if audited else s.unaudited_weight
        own = np.eye(len(self.labels))[at]
        if audited:
            self.classes[at] += 1
            for f, w in self.features(parents).items():
                self.structure.setdefault(f, np.ones(len(self.labels)))[at] += w
                self.structure_seen[f] = self.structure_seen.get(f, 0.0) + w
            for m, v in (votes or {}).items():
                self.confusion[m][at, self.labels.index(v)] += 1
        for p, w, names in parents:
            if p not in self.history:
                continue
            before, belief = self.history[p]
            for r in names:
                share = weight * w / len(names)
                for m, x in rewards.items():
                    if m in before:
                        self.rewards.add((m, r), np.array([1 - before[m], before[m]]), np.array([1 - x, x]), share)
                self.onward.add(r, belief, own, share)
        known = dict(self.history.pop(node, ({}, own))[0])
        self.history[node] = (known | rewards, own)
        while len(self.history) > s.memory:
            self.history.popitem(last=False)
