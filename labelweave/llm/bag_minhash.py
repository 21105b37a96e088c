"""BagMinHash near-duplicates: weighted MinHash of bags of word shingles.

For every shingle, levels of its weight - (0, 1], (1, 2], (2, 4], (4, 8], ... - each have a Poisson process whose rate is the
level's width. A point has a time, one of the signature's components and a place in its level; a bag sees the points up to
its weight. A component's value is its earliest point. As bags see the same points where their weights overlap, two
signatures agree in a component with the probability of their weighted Jaccard similarity. Points are made in order of
time, level by level, and only until they can't improve the signature any more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelweave.llm.common import free_name, kept_columns, quoted, staged, text_or_empty
from labelweave.llm.near import near_classes

WORD = re.compile(r"\w+")
_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_WORDS: dict[str, int] = {}
#: Times are whole ticks, so that sums of gaps are the same in whatever company a bag is signed.
TICKS, NEVER = float(1 << 40), np.iinfo(np.int64).max


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Hashes of all runs of `words` words (lower case, letters and digits only), in order; of a shorter text its one run."""
    found = WORD.findall((text or "").lower())
    if not found:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > 400_000:
        _WORDS.clear()
    known = _WORDS
    for w in set(found).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    out = np.full(n, len(h) if len(h) < words else words, np.uint64)
    for k in range(min(words, len(h))):
        out = out * _M3 + h[k : k + n]
        out ^= out >> np.uint64(29)
    return _mixed(out)


def bag(text: str | None, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(text, words), return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0


def similarity(left: list[str], right: list[str]) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle bags of each pair of texts."""
    known: dict[str, tuple] = {}
    out = []
    for a, b in zip(left, right):
        for t in (a, b):
            if t not in known:
                known[t] = bag(t)
        out.append(weighted_jaccard(known[a], known[b]))
    return np.array(out, np.float64)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """A row of m times for each bag; NEVER throughout for an empty bag."""
    sig = np.full(len(bags) * m, NEVER)
    sizes = np.array([len(b[0]) for b in bags])
    if not sizes.sum():
        return sig.reshape(-1, m)
    doc = np.repeat(np.arange(len(bags)), sizes)
    shingle, weight = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]).astype(np.int64)
    # a process for each level that the weight reaches into: level 0 is (0, 1], level l > 0 is (2^(l-1), 2^l]
    levels = np.ceil(np.log2(weight)).astype(np.int64) + 1
    p = np.repeat(np.arange(len(shingle)), levels)
    level = np.arange(len(p)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.where(level > 0, low, 1)
    seed = _mixed(shingle[p] + (level.astype(np.uint64) + np.uint64(1)) * _M3)
    top, doc = weight[p], doc[p]
    total = np.bincount(doc, weights=np.minimum(width, top - low), minlength=len(bags))
    # the first points: as many as a process needs on average, by the size of its bag
    wanted = np.maximum(1, np.ceil(width * (np.log(m) + 1) * m / total[doc] * 0.8)).astype(np.int64)
    made, clock = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    live = np.arange(len(p))
    while len(live):
        n = wanted[live]
        at = np.repeat(live, n)
        begin = np.cumsum(n) - n
        turn = made[at] + np.arange(len(at)) - np.repeat(begin, n)
        h = _mixed(seed[at] + turn.astype(np.uint64) * _M1)
        gap = (-np.log(((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / width[at] * TICKS).astype(np.int64)
        run = np.cumsum(gap)
        time = clock[at] + run - np.repeat(run[begin] - gap[begin], n)
        h = _mixed(h + _M3)
        part = (((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        seen = top[at] >= low[at] + width[at]
        if not seen.all():  # a level that the weight only reaches into: points beyond it are not the bag's
            seen |= (h & np.uint64(0xFFFFFFFF)).astype(np.int64) * width[at] >> 32 < top[at] - low[at]
        np.minimum.at(sig, (doc[at] * m + part)[seen], time[seen])
        made[live] += n
        clock[live] = time[begin + n - 1]
        last = sig.reshape(-1, m).max(1)
        live = live[clock[live] < last[doc[live]]]
        wanted[live] = np.minimum(np.maximum(1, wanted[live] // 2), 64)
    return sig.reshape(-1, m)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A long for each band of `rows` components."""
    bits = sig.view(np.uint64).reshape(len(sig), -1, rows)
    key = np.broadcast_to(np.arange(bits.shape[1], dtype=np.uint64) + np.uint64(1), bits.shape[:2]).copy()
    for k in range(rows):
        key = _mixed(key * _M3 + bits[:, :, k])
    return key.view(np.int64)


def _signed(bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                bags = [bag(t) for t in part.column(1).to_pylist()]
                keys = band_keys(signatures(bags, bands * rows), rows)
                full = np.array([len(b[0]) > 0 for b in bags], bool)
                offsets = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[full].ravel()))], ["id", "bands"])

    return sign


def near_duplicates(df: DataFrame, text: str = "text", order_by: str = "doc_id", least: float = 0.8, bands: int = 20, rows: int = 5, names: tuple[str, str, str] = ("class_id", "class_size", "keep")) -> DataFrame:
    """Return df with the class of each row - the least order_by in it -, the class's number of rows and whether the row is its class's one to keep.

    Rows are linked if their texts are equal or the bags of their five-word shingles have a weighted Jaccard similarity
    of `least` or more; classes are the components of the links. Candidates share one of `bands` bands of `rows`
    components, which finds a pair at 0.8 with a probability of 0.9996; all are verified. Of each class the row with the least
    order_by is kept (nulls last; of repeated rows exactly one). A null text equals an empty one; texts without
    words are linked to equal ones only. Whole texts count. An empty table gives an empty result. Columns of df that
    have one of the names, in any case, are replaced.
    """
    class_id, class_size, keep = names
    uid, digest, root, order = (free_name(df, f"__{x}", *names) for x in ("uid", "digest", "root", "order"))
    base = staged(df.withColumns({uid: F.monotonically_increasing_id(), digest: F.md5(text_or_empty(text).cast("binary"))}), "near-input")
    copies = staged(base.groupBy(digest).agg(F.min(uid).alias("id")), "copies")
    first = base.select(F.col(uid).alias("id"), F.col(digest), text_or_empty(text).alias("text"))
    items = staged(first.select("id", "text").mapInArrow(_signed(bands, rows), "id long, bands array<long>").join(copies.select("id"), "id", "left_semi"), "signatures")
    roots = near_classes(items, lambda ids: first.select("id", "text").join(ids, "id", "left_semi"), similarity, least, bag)
    of = copies.join(roots, "id", "left").select(digest, F.coalesce("root", "id").alias(root))
    of = staged(of, "class-of-text")
    member = staged(base.select(uid, digest, quoted(order_by).alias(order)).join(of, digest).select(uid, root, order), "members-of-class")
    best = member.groupBy(root).agg(F.min(F.struct(F.col(order).isNull().alias("n"), F.col(order).alias("o"), F.col(uid).alias("u"))).alias("best"), F.count(F.lit(1)).alias("n"))
    best = staged(best, "best-of-class")
    verdict = member.join(best, root).select(uid, F.struct(F.col("best.o").alias("o"), "n", (F.col("best.u") == F.col(uid)).alias("k")).alias(order))
    rest, of_row = kept_columns(df, names), F.col(order)
    return base.select(uid, *rest).join(verdict, uid).select(*rest, of_row["o"].alias(class_id), of_row["n"].alias(class_size), of_row["k"].alias(keep))
