"""Periodic runs of words by refinement of classes of equal factors.

Positions whose next l words are equal form a class of level l. From one level to the next a class splits by the
classes of its members' successors; of the parts that a class fell into, all but the largest split others (the smaller halves), so a
position is moved a logarithmic number of times. Members of a class follow one another in a list: neighbours at
distance l are squares of period l, whose root is not itself a repetition, and squares at consecutive positions
are one run. Classes too small to hold a run of the least exponent are dropped with everything that would refine to
them; in ordinary text hardly anything is left after two levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from labelweave.llm.common import kept_columns, text_or_empty

#: Bytes of text that are looked at at once; a longer text is looked at alone.
SLICE_BYTES = 4 << 20
RUN = T.StructType([T.StructField(x, T.LongType(), False) for x in ("start", "length", "period")])


class Classes:
    """The classes of one text from level 2 on.

    least: members that a class needs; at: positions in ascending order, of: their classes, small: the members of the
    classes that split others, dead: positions that are in no class any more and whose predecessors go next.
    """

    def __init__(self, n: int, cap: int, least: int, at: list[int], of: list[int], small: list[list[int]], dead: list[int]) -> None:
        self.level, self.cap, self.least, self.small, self.dead = 2, cap, least, small, dead
        self.of, self.after, self.before = dict(zip(at, of)), [-1] * n, [-1] * n
        self.first: dict[int, int] = {}
        self.last: dict[int, int] = {}
        self.size: dict[int, int] = {}
        self.gaps: dict[int, set[int]] = {}
        for i, c in zip(at, of):
            self._append(i, c)
        self.named = max(of, default=0)

    def _gap(self, i: int, j: int) -> None:
        if self.level <= j - i <= self.cap:
            self.gaps.setdefault(j - i, set()).add(i)

    def _append(self, i: int, c: int) -> None:
        self.of[i] = c
        end = self.last.get(c, -1)
        self.before[i], self.after[i] = end, -1
        if end < 0:
            self.first[c], self.size[c] = i, 1
        else:
            self.after[end] = i
            self.size[c] += 1
            self._gap(end, i)
        self.last[c] = i

    def _remove(self, i: int) -> int:
        c, a, b = self.of.pop(i), self.before[i], self.after[i]
        self.size[c] -= 1
        if b >= 0:
            self.before[b] = a
            if i in (held := self.gaps.get(b - i, ())):
                held.remove(i)
        else:
            self.last[c] = a
        if a >= 0:
            self.after[a] = b
            if a in (held := self.gaps.get(i - a, ())):
                held.remove(a)
            if b >= 0:
                self._gap(a, b)
        else:
            self.first[c] = b
        return c

    def _members(self, c: int) -> list[int]:
        out, i = [], self.first[c]
        while i >= 0:
            out.append(i)
            i = self.after[i]
        return out

    def refine(self) -> None:
        """To the next level."""
        self.level += 1
        parts: dict[int, list[int]] = {}  # of each class that loses members
        gone = []
        for j in self.dead:
            if j - 1 in self.of:
                parts.setdefault(self._remove(j - 1), [])
                gone.append(j - 1)
        for small in self.small:
            groups: dict[int, list[int]] = {}
            for j in small:
                c = self.of.get(j - 1)
                if c is not None:
                    groups.setdefault(c, []).append(j - 1)
            for c, moved in groups.items():
                if len(moved) == self.size[c] and c not in parts:
                    continue  # the whole class: nothing splits
                self.named += 1
                parts.setdefault(c, []).append(self.named)
                for i in moved:
                    self._remove(i)
                    self._append(i, self.named)
        self.small = []
        for c, others in parts.items():
            whole = []
            for k in [c, *others]:
                if self.size[k] < self.least:
                    members = self._members(k)
                    for i in members:
                        self._remove(i)
                    gone += members
                else:
                    whole.append(k)
            if whole:
                whole.remove(max(whole, key=self.size.__getitem__))
                self.small += map(self._members, whole)
        self.dead = gone

    def runs(self) -> Iterator[tuple[int, int, int]]:
        """(start, length, period) of every stretch of squares, level by level."""
        while True:
            yield from stretches(sorted(self.gaps.pop(self.level, ())), self.level)
            if self.level >= self.cap or not self.of:
                return
            if not self.small and not self.dead:  # no class will change: what is left are gaps of longer periods
                for q in sorted(self.gaps):
                    yield from stretches(sorted(self.gaps[q]), q)
                return
            self.refine()


def stretches(starts: list[int], period: int) -> Iterator[tuple[int, int, int]]:
    """Squares at consecutive positions put together."""
    begin = last = None
    for i in starts:
        if last is None or i > last + 1:
            if last is not None:
                yield begin, last - begin + 2 * period, period
            begin = i
        last = i
    if last is not None:
        yield begin, last - begin + 2 * period, period


def _classes(key: np.ndarray, where: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of positions with equal keys, least or more: the positions, class by class and ascending within each, their class's number and its size."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(begin, len(key)))
    held = np.repeat(size >= least, size)
    size = size[size >= least]
    return where[order[held]], np.repeat(np.arange(len(size)), size), size


def _squares(at: np.ndarray, of: np.ndarray, period: int) -> np.ndarray:
    """Positions whose next one in their class is at distance period, ascending."""
    near = (at[1:] - at[:-1] == period) & (of[1:] == of[:-1])
    return np.sort(at[:-1][near])


def runs_of(words: list[list], exponent: int = 4, least_length: int = 6) -> list[list[tuple[int, int, int]]]:
    """For each text's words its runs (start, length, period): stretches of smallest period q, as long as can be, of a length of exponent * q and least_length at least; by start, then period."""
    sizes = np.array([len(w) for w in words], np.int64)
    begin = np.cumsum(sizes) - sizes
    found: list[list] = [[] for _ in words]
    if not sizes.sum():
        return found
    numbers: dict = {}
    word = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in words for w in ws), np.int64, sizes.sum())
    text = np.repeat(np.arange(len(words)), sizes)
    least = max(2, exponent - 1)  # every square of such a run has its root so often
    n = len(word)
    everywhere = np.arange(n)

    def keep(run_starts: np.ndarray, period: int) -> None:
        if len(run_starts):
            cut = np.flatnonzero((np.diff(run_starts) > 1) | (text[run_starts[1:]] != text[run_starts[:-1]])) + 1
            first = run_starts[np.append(0, cut)]
            length = run_starts[np.append(cut, len(run_starts)) - 1] - first + 2 * period
            for i, m in zip(first[good := length >= max(least_length, exponent * period)].tolist(), length[good].tolist()):
                found[text[i]].append((i - int(begin[text[i]]), m, period))

    # words and pairs of words, of all texts at once: here every class splits others
    at, of, _ = _classes(text * len(numbers) + word, everywhere, least)
    keep(_squares(at, of, 1), 1)
    one = np.full(n + 1, -1)
    one[at] = of
    same = np.append(text[1:] == text[:-1], False)
    two_at = everywhere[(one[:n] >= 0) & same & (one[1:] >= 0) & (sizes[text] >= 2 * exponent)]
    at, of, size = _classes(one[two_at] * n + one[two_at + 1], two_at, least)
    keep(_squares(at, of, 2), 2)
    if len(at):
        two = np.full(n, -1)
        two[at] = of
        largest = np.full(int(of[-1]) + 1, True)
        parent = one[at[np.cumsum(size) - size]]
        order = np.lexsort((size, parent))
        largest[order] = np.append(parent[order][1:] != parent[order][:-1], True)  # the last and so largest of each parent
        dying = np.flatnonzero((one[1:n] >= 0) & (two[1:] < 0) & (two[:-1] >= 0)) + 1
        order = np.argsort(at, kind="stable")
        by_place, its = at[order], of[order]
        small_at, small_of = by_place[~largest[its]], its[~largest[its]]
        home = np.unique(text[by_place])
        bounds = np.append(begin, n)
        for d in home.tolist():
            lo, hi, size_d = int(bounds[d]), int(bounds[d + 1]), int(sizes[d])
            cap = size_d // exponent
            if cap < 3:
                continue
            a, b = np.searchsorted(by_place, [lo, hi])
            s, e = np.searchsorted(small_at, [lo, hi])
            x, y = np.searchsorted(dying, [lo, hi])
            small: dict[int, list[int]] = {}
            for i, c in zip((small_at[s:e] - lo).tolist(), small_of[s:e].tolist()):
                small.setdefault(c, []).append(i)
            classes = Classes(size_d, cap, least, (by_place[a:b] - lo).tolist(), its[a:b].tolist(), list(small.values()), (dying[x:y] - lo).tolist())
            classes.gaps.pop(2, None)
            found[d] += [r for r in classes.runs() if r[1] >= max(least_length, exponent * r[2])]
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that stay, joined by one space: a run keeps its first period."""
    if not runs:
        return b" ".join(words)
    out, at = [], 0
    for a, b in sorted((start + period, start + length) for start, length, period in runs):
        out += words[at : max(at, a)]
        at = max(at, b)
    return b" ".join(out + words[at:])


def periodic_runs(df: DataFrame, text: str = "text", exponent: int = 4, least_length: int = 6, names: tuple[str, str, str] = ("n_words", "runs", "collapsed")) -> DataFrame:
    """df with each text's number of words, its runs (start, length, period) by start, then period, and the text without what runs repeat.

    Words are what lies between white space of ASCII. A run is a stretch of words with smallest period q, of least_length and of exponent * q
    words or more, that can be extended to neither side. A word is left out if a run has it after its first q words; the
    rest are joined by one space. exponent: 2 or more. A null text has no words, like an empty one; rows that repeat are
    treated alike. Whole texts count, however long: one text is looked at in one task. An empty table gives an empty
    result. Columns of df that have one of the names, in any case, are replaced. No shuffle.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    kept = df.select(*kept_columns(df, names))
    schema = T.StructType([*kept.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(RUN, False)), T.StructField(names[2], T.StringType())])
    columns, width = [*kept.columns, *names], len(kept.columns)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(width)
            for a, b in _slices(np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))):
                words = [x.encode().split() for x in texts[a:b].to_pylist()]
                runs = runs_of(words, exponent, least_length)
                flat = np.array([r for rs in runs for r in rs], np.int64).reshape(-1, 3)
                offsets = pa.array(np.append(0, np.cumsum([len(r) for r in runs])), pa.int32())
                made = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=[pa.field(f.name, pa.int64(), False) for f in RUN]))
                text_out = pa.array([collapsed(w, r).decode() for w, r in zip(words, runs)], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[a:b] for k in range(width)), pa.array([len(w) for w in words], pa.int64()), made, text_out], names=columns)

    rows = df.select(*[c.alias(f"c{k}") for k, c in enumerate(kept_columns(df, names))], text_or_empty(text).alias("t"))
    return rows.mapInArrow(look, schema)


def _slices(upto: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows of SLICE_BYTES or so, given the bytes up to each row's end."""
    begin = 0
    while begin < len(upto):
        end = int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + SLICE_BYTES, "right"))
        end = max(begin + 1, end)
        yield begin, end
        begin = end
