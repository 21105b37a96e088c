"""One-to-one matching without replacement: each case takes the nearest control that is left."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort


def _tie(case: object, control: object) -> str:
    return hashlib.sha256(f"{case}\0{control}".encode()).hexdigest()


class Controls:
    """The controls that are left, by their traits and, within those, by size.

    The nearest control differs in as few of the traits as can be, those named first counting most, then in size as
    little as can be; a hash of both ids parts ties. Only ids, traits and sizes are held.
    """

    def __init__(self) -> None:
        self._left: dict[tuple, dict[int, list]] = {}  # traits -> size -> ids
        self._sizes: dict[tuple, list[int]] = {}

    def add(self, name: object, traits: tuple, size: int) -> None:
        ids = self._left.setdefault(traits, {}).setdefault(size, [])
        if not ids:
            insort(self._sizes.setdefault(traits, []), size)
        ids.append(name)

    def take(self, case: object, traits: tuple, size: int) -> tuple[object, tuple[int, ...], int] | None:
        """(control, which traits differ, difference in size) of the nearest control, which is then gone; None if none is left."""
        if not self._left:
            return None
        differs = {own: tuple(int(a != b) for a, b in zip(own, traits, strict=True)) for own in self._left}
        least = min(differs.values())
        near = []  # (difference, traits, size) of the sizes next to the case's
        for own in (k for k, v in differs.items() if v == least):
            sizes = self._sizes[own]
            at = bisect_left(sizes, size)
            near += [(abs(x - size), own, x) for x in sizes[max(0, at - 1) : at + 1]]
        gap = min(n[0] for n in near)
        _, own, at, name = min((_tie(case, i), own, x, i) for g, own, x in near if g == gap for i in self._left[own][x])
        self._remove(own, at, name)
        return name, least, gap

    def _remove(self, own: tuple, size: int, name: object) -> None:
        ids = self._left[own][size]
        ids.remove(name)
        if not ids:
            del self._left[own][size]
            self._sizes[own].pop(bisect_left(self._sizes[own], size))
        if not self._left[own]:
            del self._left[own], self._sizes[own]
