"""Label transitions learned along the relations of a stream's own decisions: what earlier items' beliefs say of an item before any vote."""

from __future__ import annotations

import math
from collections import OrderedDict

import numpy as np

from labelweave.operators.sequential import entropy
from labelweave.operators.subset_head import Counts


class TransitionMemory:
    """Beliefs of a stream's last items and transitions by relation, weighed by how sure both ends are.

    A relation speaks once it has seen `least`, and where its prediction is informative: 1 less its entropy as a share of the most.
    """

    def __init__(self, k: int, strength: float = 0.8, prior: float = 1.0, least: float = 6.0, most_edge: float = 2.0, most_weight: float = 8.0, informative: float = 0.05, memory: int = 4096) -> None:
        self.k, self.strength, self.least, self.most_edge, self.most_weight, self.informative, self.memory = k, strength, least, most_edge, most_weight, informative, memory
        self.counts = Counts(k, prior)
        self.beliefs: OrderedDict[str, np.ndarray] = OrderedDict()

    def known(self, edges: dict[str, tuple[float, str]]) -> list[tuple[str, float, str]]:
        """Remembered neighbours, heaviest first, until their weight is used up."""
        rows = sorted(((n, min(w, self.most_edge), r) for n, (w, r) in edges.items() if w > 0 and n in self.beliefs), key=lambda x: (-x[1], x[0], x[2]))
        out, left = [], self.most_weight
        for n, w, r in rows:
            if left <= 0:
                break
            out.append((n, min(w, left), r))
            left -= out[-1][1]
        return out

    def prior(self, edges: dict[str, tuple[float, str]]) -> tuple[np.ndarray, int, float]:
        """Belief before any vote; how many neighbours spoke and with what weight."""
        x, spoke, weight = np.full(self.k, -math.log(self.k)), 0, 0.0
        for n, w, r in self.known(edges):
            mature = self.counts.mature(r, self.least)
            if mature is None:
                continue
            p = self.counts.onward(r, self.beliefs[n])
            p = p / p.sum()
            told = 1 - entropy(p) / math.log(self.k)
            if told < self.informative:
                continue
            gate = w * float(self.beliefs[n].max()) * told * mature
            x = x + self.strength * gate * np.log(p)
            spoke, weight = spoke + 1, weight + gate
        p = np.exp(x - x.max())
        return p / p.sum(), spoke, weight

    def update(self, node: str, edges: dict[str, tuple[float, str]], belief: np.ndarray) -> None:
        """An item's belief, now that it is decided; transitions weigh as much as the less sure of the two."""
        belief = belief / belief.sum()
        for n, w, r in self.known(edges):
            before = self.beliefs[n]
            self.counts.add(r, before, belief, w * min(float(before.max()), float(belief.max())))
        self.beliefs.pop(node, None)
        self.beliefs[node] = belief
        while len(self.beliefs) > self.memory:
            self.beliefs.popitem(last=False)
