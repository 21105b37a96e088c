"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment over words scores them.

Every place of a test item gives a seed: the shortest run of words from it that chance would bring about less than once
in a set number of words, going by the counts of the words in the whole corpus. A document passage that holds a seed is
aligned with the item around the place of the seed. The benchmark goes to the tasks in blocks of bounded size, and every
document is matched with every block.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.llm.common import free_name, kept_columns, quoted

WORD = re.compile(r"\w+")
LENGTHS = (3, 4, 5, 6, 8)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_FILTER_BITS = 20


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _codes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n word numbers."""
    m = max(0, len(ids) - n + 1)
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h = (h ^ ids[k : k + m]) * _M1
        h ^= h >> np.uint64(31)
    return h * _M2


def smith_waterman(a: np.ndarray, b: np.ndarray) -> int:
    """Best local alignment score over words: 1 for a match, -1 for a mismatch or a gap; 0 matches nothing."""
    place = np.arange(len(b) + 1)
    row, best = np.zeros(len(b) + 1, np.int64), 0
    for x in a:
        new = np.zeros(len(b) + 1, np.int64)
        new[1:] = np.maximum(row[:-1] + np.where((b == x) & (b != 0), 1, -1), row[1:] - 1)
        row = np.maximum.accumulate(np.maximum(new, 0) + place) - place  # gaps along b
        best = max(best, int(row.max()))
    return best


class Block:
    """A bounded part of the benchmark: its vocabulary, items as word numbers, and the seeds."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        split = [(i, words_of(t)) for i, t in items]
        self.vocabulary: dict[str, int] = {w: k + 1 for k, w in enumerate(dict.fromkeys(chain.from_iterable(w for _, w in split)))}
        self.ids = [i for i, w in split if w]
        self.items = [np.array([self.vocabulary[x] for x in w], np.uint64) for _, w in split if w]
        self.seeds: dict[int, dict[int, list[tuple[int, int]]]] = {}

    def choose_seeds(self, counts: dict[int, int], total: int, chance: float) -> None:
        rate = np.ones(len(self.vocabulary) + 1)
        for w in self.vocabulary.values():
            rate[w] = (counts.get(w, 0) + 1) / (total + 1)
        found: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, ids in enumerate(self.items):
            p = np.log(rate[ids.astype(np.int64)])
            took = False
            for j in range(len(ids)):
                for n in LENGTHS:
                    if j + n <= len(ids) and p[j : j + n].sum() <= np.log(chance):
                        found[n][int(_codes(ids[j : j + n], n)[0])].append((k, j))
                        took = True
                        break
            if not took:  # short or of common words throughout: the longest run there is
                n = min(len(ids), LENGTHS[-1])
                found[n][int(_codes(ids[:n], n)[0])].append((k, 0))
        self.seeds = {n: dict(x) for n, x in found.items()}
        self.filters = {}
        for n, x in self.seeds.items():
            table = np.zeros(1 << _FILTER_BITS, bool)
            table[np.array(list(x), np.uint64) >> np.uint64(64 - _FILTER_BITS)] = True
            self.filters[n] = table

    def windows(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, from, to): the places of a text that seeds point to, those of one item merged where they overlap."""
        spans: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for n, seeds in self.seeds.items():
            h = _codes(ids, n)
            for at in np.flatnonzero(self.filters[n][h >> np.uint64(64 - _FILTER_BITS)]).tolist():
                for k, j in seeds.get(int(h[at]), ()):
                    size = len(self.items[k])
                    pad = size // 4 + 2
                    spans[k].add((max(0, at - j - pad), min(len(ids), at - j + size + pad)))
        for k, found in spans.items():
            begin = end = -1
            for lo, hi in sorted(found):
                if lo > end:
                    if end > 0:
                        yield k, begin, end
                    begin, end = lo, hi
                else:
                    end = max(end, hi)
            yield k, begin, end

    def best(self, text: str | None, least: float) -> tuple[float, int | None, int]:
        """Highest score as a share of the item's length, its item, and how many items reach `least`."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words_of(text)], np.uint64)
        scores: dict[int, float] = {}
        for k, lo, hi in self.windows(ids):
            scores[k] = max(scores.get(k, 0.0), smith_waterman(self.items[k], ids[lo:hi]) / len(self.items[k]))
        if not scores:
            return 0.0, None, 0
        top, item = max((s, -self.ids[k]) for k, s in scores.items())
        return top, -item, sum(s >= least for s in scores.values())


def _word_counts(df: DataFrame, text: str, block: Block) -> tuple[dict[int, int], int]:
    """Occurrences in all texts of the block's words, and of all words together."""
    shared = df.sparkSession.sparkContext.broadcast(block.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        sums = np.zeros(len(shared.value) + 1, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 256):
                ids = [get(w, 0) for t in batch.column(0)[at : at + 256].to_pylist() for w in words_of(t)]
                sums += np.bincount(np.array(ids, np.int64), minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], ["w", "n"])

    table = df.select(quoted(text).cast("string")).mapInArrow(count, "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()  # a row for each word of the block
    counts = {r["w"]: r["n"] for r in table}
    return counts, sum(counts.values())


def _matcher(shared, least: float):
    kind = T.StructType([T.StructField("s", T.DoubleType()), T.StructField("i", T.LongType()), T.StructField("n", T.IntegerType())])

    @F.arrow_udf(kind)
    def match(texts: pa.Array) -> pa.Array:
        rows = []
        for at in range(0, len(texts), 256):
            rows += [shared.value.best(t, least) for t in texts[at : at + 256].to_pylist()]
        s, i, n = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(s, pa.float64()), pa.array(i, pa.int64()), pa.array(n, pa.int32())], ["s", "i", "n"])

    return match


def decontaminate(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: float = 0.5,
    chance: float = 1e-8,
    block_chars: int = 8_000_000,
    names: tuple[str, str, str, str] = ("contaminated", "item_id", "score", "n_items"),
) -> DataFrame:
    """Return df with whether a row's text holds a test item, the item that aligns best, its score and how many items reach `least`.

    The score is that of the best local alignment over words, as a share of the item's words: 1 for a full copy; each word
    changed, put in or left out costs up to two words. Letters and digits count, in lower case. chance: the rate per word
    below which a run of words counts as rare. Ties go to the smallest item_id. Null or empty texts, and items without
    words or id, match nothing. Whole texts count. Every row is kept, repeated rows alike; an empty table on
    either side matches nothing. Columns of df that have one of the names, in any case, are replaced. A block of the benchmark has
    about block_chars characters; each is a pass over the texts.
    """
    flag, item, score, n_items = names
    items = benchmark.select(quoted(item_id).cast("long").alias("i"), quoted(item_text).cast("string").alias("t")).where("i is not null and t is not null")
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-size // block_chars)
    found, top, n = (free_name(df, f"__{x}", *names) for x in ("found", "top", "n"))
    made = []
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).distinct().collect()  # block_chars characters or so
        block = Block([(r["i"], r["t"]) for r in sorted(part)])
        counts, total = _word_counts(df, text, block)
        block.choose_seeds(counts, total, chance)
        shared = df.sparkSession.sparkContext.broadcast(block)

        made.append(_matcher(shared, least)(quoted(text).cast("string")))
    kept = kept_columns(df, names)
    if not made:
        return df.select(*kept, F.lit(False).alias(flag), F.lit(None).cast("long").alias(item), F.lit(0.0).alias(score), F.lit(0).alias(n_items))
    rows = df.select(*kept, F.array(*made).alias(found))
    best = F.array_max(F.transform(F.filter(found, lambda x: x["i"].isNotNull()), lambda x: F.struct(x["s"].alias("s"), (-x["i"]).alias("i"))))
    rows = rows.withColumns({top: best, n: F.aggregate(found, F.lit(0), lambda a, x: a + x["n"])})
    return rows.select(*kept, (F.col(n) > 0).alias(flag), (-F.col(top)["i"]).alias(item), F.round(F.coalesce(F.col(top)["s"], F.lit(0.0)), 6).alias(score), F.col(n).alias(n_items))
