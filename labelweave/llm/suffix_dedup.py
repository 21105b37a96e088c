"""Exact substring dedup by prefix doubling over ranks of text positions.

A rank here is a hash of the string that starts at a position: equal ranks, equal strings. Sorting starts with strings of
half the threshold, 25 bytes, and doubles once: the pair of ranks at p and p + 25 ranks the 50 bytes at p. Only positions
that can still matter stay in:

1. Of all positions those are sorted whose 25-byte rank is the least of a 26-position window (every 50 bytes hold one,
   and equal 50 bytes hold the same one). A position whose rank no other document has is out: its 50-byte strings are unique.
2. The whole stretch that a position stands for - all 50-byte strings whose least rank it is - is ranked as one. Where an
   earlier document has the same stretch, all its strings are settled.
3. Of the rest, positions whose 25-byte rank only one document still has are settled too: it is the first to have them.
4. The strings at what remains, mostly the ends of shared passages, get their 50-byte ranks as pairs of 25-byte ranks.

In each step tasks sort their own positions first and send on one document's per rank, ranks meet in partitions by hash,
and only positions and verdicts go back to the documents, which lie in a bucketed table and are never shuffled again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.common import discard, free_name, shared_dir, staged

_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Bytes of a document that are looked at in one go.
SEGMENT = 1 << 18
#: Positions that a task gathers before it sends them on.
FLUSH = 100_000
#: Bytes of texts that are taken out of a batch at once.
SLICE = 1 << 20
#: As many buckets as Spark lets a table have by default.
MOST_BUCKETS = 100_000
_POWERS: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(2 * SEGMENT + 1024, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def _sliding(a: np.ndarray, width: int, least) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        a = least(a[:-n], a[n:])
        n *= 2
    return least(a[: len(a) - (width - n)], a[width - n :]) if n < width else a


class Stretches:
    """Of pieces of texts, one after another: ranks of half-length strings, and the stretches of starts that share their least rank.

    starts and ends: where each piece begins and ends in data; no string runs over an end.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: int) -> None:
        self.t, self.half = threshold, threshold // 2
        up, self.down = _powers()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])
        self.rank = _mixed(self._of(np.arange(len(data) - self.half + 1), self.half))
        w = threshold - self.half + 1
        low = _sliding(self.rank, w, np.minimum)
        edge = np.zeros(len(data) + 1, np.int32)  # starts of whole strings
        edge[starts] += 1
        edge[ends - threshold + 1] -= 1
        low[np.cumsum(edge[: len(low)]) == 0] = 0
        rim = np.zeros(w - 1, np.uint64)
        at = np.flatnonzero(_sliding(np.concatenate([rim, low, rim]), w, np.maximum) == self.rank)
        h = self.rank[at]
        # from the nearest place to the left with no greater rank to the nearest to the right with a lesser one
        left, right = at - w, at + w
        for t in range(1, w):
            near = at[t:] - at[:-t] < w
            if not near.any():
                break
            i = np.flatnonzero(near & (h[:-t] <= h[t:])) + t
            left[i] = np.maximum(left[i], at[i - t])
            i = np.flatnonzero(near & (h[t:] < h[:-t]))
            right[i] = np.minimum(right[i], at[i + t])
        piece = np.searchsorted(starts, at, "right") - 1
        first = np.maximum(np.maximum(left + 1, at - w + 1), starts[piece])
        last = np.minimum(np.minimum(right - w, at), ends[piece] - threshold)
        held = first <= last
        self.at, self.first, self.last, self.piece = at[held], first[held], last[held], piece[held]

    def _of(self, start: np.ndarray, size) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.down[start]

    def half_ranks(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.rank[self.at[i]], np.zeros(len(i), np.uint32)

    def whole_ranks(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, last = self.first[i], self.last[i]
        size = last + self.t - first
        ends = self.rank[first] + self.rank[last + self.t - self.half] * _M2 + size.astype(np.uint64)
        return _mixed(self._of(first, size) + size.astype(np.uint64)), (ends >> np.uint64(32)).astype(np.uint32)

    def pair_ranks(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.rank[start], self.rank[start + self.t - self.half]
        return _mixed(a * _M2 + b), (b >> np.uint64(20)).astype(np.uint32)


def _spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers from first to last of each pair."""
    n = last - first + 1
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about SLICE bytes of that column; a longer text is a slice of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, end - at)
        at = end


def _pieces(texts: list[bytes], threshold: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, begin, bytes) in groups of a segment's size or so; long texts fall into pieces that share all but one byte of a string."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for begin in range(0, max(0, len(text) - threshold + 1), SEGMENT):
            group.append((i, begin, text[begin : begin + SEGMENT + threshold - 1]))
            size += len(group[-1][2])
            if size >= SEGMENT:
                yield group
                group, size = [], 0
    if group:
        yield group


def entries(texts: list[bytes], kind: str, chosen: list[np.ndarray] | None, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, rank, more rank) of texts, group by group. Stretches go by the first start they stand for; chosen: of each text those that are still in."""
    for group in _pieces(texts, threshold):
        sizes = np.array([len(x) for _, _, x in group])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        s = Stretches(np.frombuffer(b"".join(x for _, _, x in group), np.uint8), starts, ends, threshold)
        keep = np.arange(len(s.first))
        text, shift = np.array([i for i, _, _ in group]), np.array([b for _, b, _ in group]) - starts
        if chosen is not None:
            wanted = np.zeros(int(ends[-1]), bool)
            for (i, begin, x), at in zip(group, starts):
                c = chosen[i] - begin
                wanted[at + c[(c >= 0) & (c < len(x))]] = True
            keep = keep[wanted[s.first]]
        piece = s.piece[keep]
        if kind in ("pair", "starts"):
            place = _spread(s.first[keep], s.last[keep])
            piece = np.repeat(piece, s.last[keep] - s.first[keep] + 1)
            ranks = s.pair_ranks(place) if kind == "pair" else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        else:
            place = s.first[keep]
            ranks = s.half_ranks(keep) if kind == "half" else s.whole_ranks(keep)
        yield text[piece], place + shift[piece], *ranks


def _groups(rank: np.ndarray, more: np.ndarray, doc: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether its document is the least with its rank, and whether another document has it; known: entries that are known to be shared."""
    order = np.lexsort((doc, more, rank))
    r, m, d = rank[order], more[order], doc[order]
    new = np.append(True, (r[1:] != r[:-1]) | (m[1:] != m[:-1]))
    start = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    end = np.append(start[1:], len(r)) - 1
    is_first, shared = np.empty(len(r), bool), np.empty(len(r), bool)
    is_first[order] = d == d[start][which]
    shared[order] = ((d[start] != d[end]) | np.logical_or.reduceat(known[order], start))[which] if len(r) else False
    return is_first, shared


SENT = "bucket int, settled boolean, docs binary, counts binary, places binary, ranks binary, mores binary, shared binary"
BACK = "kb int, ks binary, n_first binary, n_later binary, first binary, later binary"


def _send(kind: str, threshold: int, buckets: int, with_more: bool):
    """Map side: entries of a task's documents, packed by bucket of their rank; those that the task itself can settle go along as they are."""

    def pack(k, d, doc, place, rank, more, shared, bucket, settled) -> Iterator[tuple]:
        order = np.lexsort((place, doc, bucket))
        cut = np.flatnonzero(np.diff(bucket[order])) + 1
        for at in np.split(order, cut):
            if not len(at):
                continue
            docs, counts = np.unique(doc[at], return_counts=True)
            yield (int(bucket[at[0]]), settled, np.stack([k[docs], d[docs]], 1).tobytes(), counts.astype("<u4").tobytes(), place[at].astype("<u4").tobytes(), b"" if settled else (rank[at].astype("<u8").tobytes() if with_more else rank[at].astype("<u4").tobytes()), more[at].astype("<u4").tobytes() if with_more and not settled else b"", np.packbits(shared[at]).tobytes())

    def flush(held: list, k: list, d: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        doc, place, rank, more = (np.concatenate(x) for x in zip(*held))
        ks, ds = np.array(k, "<i8"), np.array(d, "<i8")
        if not len(place):
            return
        is_first, shared = _groups(rank, more, ds[doc], np.zeros(len(doc), bool))
        bucket = ((rank >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        # not the least document here: it is known to come later; sent on to any partition, only to be passed back
        rows = list(pack(ks, ds, doc[is_first], place[is_first], rank[is_first], more[is_first], shared[is_first], bucket[is_first], False))
        rest = ~is_first
        if rest.any():
            rows += pack(ks, ds, doc[rest], place[rest], rank[rest], more[rest], shared[rest], ks[doc[rest]] % buckets, True)
        kinds = (pa.int32(), pa.bool_(), *[pa.binary()] * 6)
        for at in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64]), kinds)], ["bucket", "settled", "docs", "counts", "places", "ranks", "mores", "shared"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, k, d, n = [], [], [], 0
        for batch in batches:
            for part in _slices(batch, 2):
                mine = [np.frombuffer(x, "<u4").astype(np.int64) for x in part.column(3).to_pylist()] if part.num_columns > 3 else None
                before = len(k)
                k += part.column(0).to_pylist()
                d += part.column(1).to_pylist()
                for doc, place, rank, more in entries(part.column(2).to_pylist(), kind, mine, threshold):
                    held.append((doc + before, place, rank, more))
                    n += len(doc)
                if n > FLUSH:
                    yield from flush(held, k, d)
                    held, k, d, n = [], [], [], 0
        yield from flush(held, k, d)

    return send


def _meet(buckets: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Reduce side: all entries of a partition's ranks. Back to each document go its places: the first with a rank others have, and the later."""
        parts: list[tuple] = []
        done: list[tuple] = []
        for batch in batches:
            for _, settled, docs, counts, places, ranks, mores, shared in zip(*(c.to_pylist() for c in batch.columns)):
                who = np.frombuffer(docs, "<i8").reshape(-1, 2)
                n = np.frombuffer(counts, "<u4")
                place = np.frombuffer(places, "<u4")
                if settled:
                    done.append((np.repeat(who[:, 0], n), place, np.zeros(len(place), bool)))
                else:
                    rank = np.frombuffer(ranks, "<u8" if len(ranks) == 8 * len(place) else "<u4")
                    parts.append((np.repeat(who[:, 0], n), np.repeat(who[:, 1], n), place, rank, np.frombuffer(mores, "<u4") if mores else np.zeros(len(place), np.uint32), np.unpackbits(np.frombuffer(shared, np.uint8), count=len(place)).astype(bool)))
        if parts:
            k, d, place, rank, more, known = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            is_first, shared = _groups(rank, more, d, known)
            done.append((k[shared], place[shared], is_first[shared]))
        if done:
            yield from _returned(*(np.concatenate(x) for x in zip(*done)), buckets)

    return meet


def _returned(k: np.ndarray, place: np.ndarray, is_first: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Places packed by the partition that their documents' places meet in."""
    kb = k % buckets
    order = np.lexsort((place, k, kb))
    for at in np.split(order, np.flatnonzero(np.diff(kb[order])) + 1):
        if len(at):
            ks, which = np.unique(k[at], return_inverse=True)
            f = is_first[at]
            sides = [(np.bincount(which[m], minlength=len(ks)).astype("<u4").tobytes(), place[at][m].astype("<u4").tobytes()) for m in (f, ~f)]
            row = [[int(kb[at[0]])], [ks.astype("<i8").tobytes()], [sides[0][0]], [sides[1][0]], [sides[0][1]], [sides[1][1]]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *[pa.array(x, pa.binary()) for x in row[1:]]], ["kb", "ks", "n_first", "n_later", "first", "later"])


def _gather(columns: tuple[str, ...]):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ks, places = [], []
        for batch in batches:
            for own, n_first, n_later, first, later in zip(*(c.to_pylist() for c in batch.columns[1:])):
                for name, n, found in (("first", n_first, first), ("later", n_later, later)):
                    if name in columns and found:
                        ks.append(np.repeat(np.frombuffer(own, "<i8"), np.frombuffer(n, "<u4")))
                        places.append(np.frombuffer(found, "<u4"))
        if not ks:
            return
        k, place = np.concatenate(ks), np.concatenate(places)
        order = np.lexsort((place, k))
        k, place = k[order], place[order]
        cut = np.append(0, np.flatnonzero(np.diff(k)) + 1)
        end = np.append(cut[1:], len(k))
        for i in range(0, len(cut), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(k[cut[i : i + 4096]], pa.int64()), pa.array([place[a:b].tobytes() for a, b in zip(cut[i : i + 4096], end[i : i + 4096])], pa.binary())], ["k", "places"])

    return gather


def _places(back: DataFrame, buckets: int, *columns: str) -> DataFrame:
    """(k, places): the places in these columns, put together by document."""
    return back.repartitionById(buckets, F.col("kb")).mapInArrow(_gather(columns), "k long, places binary")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for every, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            out.append(np.setdiff1d(np.frombuffer(every, "<u4"), np.frombuffer(gone or b"", "<u4")).astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["k", "places"])


def _unsettled(half: DataFrame, whole: DataFrame, buckets: int) -> DataFrame:
    """Stretches with a shared half rank, but for those that an earlier document has as a whole."""
    every = _places(half, buckets, "first", "later")
    gone = _places(whole, buckets, "later").withColumnRenamed("places", "gone")
    left = every.join(gone, "k", "left").select("k", "places", "gone").mapInArrow(_without, "k long, places binary")
    return left.where(F.octet_length("places") > 0)


def _removal(threshold: int, with_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, 1)):
            rows = []
            texts, copies = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            whole, single = ([np.frombuffer(x or b"", "<u4").astype(np.int64) for x in batch.column(c).to_pylist()] for c in (3, 4))
            starts: list[list[np.ndarray]] = [[x] for x in single]
            some = [i for i, x in enumerate(whole) if len(x) and not copies[i]]
            for doc, place, _, _ in entries([texts[i] for i in some], "starts", [whole[i] for i in some], threshold):
                cut = np.searchsorted(doc, np.unique(doc), "left")
                for i, at in zip(doc[cut].tolist(), np.split(place, cut[1:])):
                    starts[some[i]].append(at)
            for text, copy, found in zip(texts, copies, starts):
                n = len(text)
                if copy:  # an earlier document has the same text
                    rows.append((n, 1, b"") if n >= threshold else (0, 0, text))
                    continue
                at = np.unique(np.concatenate(found))
                if not len(at):
                    rows.append((0, 0, text))
                    continue
                edge = np.zeros(n + 1, np.int64)
                edge[at] += 1
                edge[at + threshold] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), kept))
            removed, spans, kept = zip(*rows) if rows else ((), (), ())
            made = [pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), *([pa.array(kept, pa.binary())] if with_text else [])]
            names = ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            columns = [batch.column(5), pa.array([len(t) for t in texts], pa.int64()), *made]
            yield pa.RecordBatch.from_arrays(columns[: 5 + with_text], names[: 5 + with_text])

    return remove


def dedup_substrings(df: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: int = 50, bucket_bytes: int = 8 << 20, most_buckets: int = MOST_BUCKETS, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_text kept_text as binary) of each row of df.

    Every byte is removed that lies in a string of `threshold` bytes (even, 16 or more) that also starts in a document with a
    smaller doc_id; strings lie within one text, overlaps count, and all is judged on the input. Texts are UTF-8 bytes, a null
    text is empty. Rows without a doc_id come after all others and take nothing from one another, nor do rows of one
    doc_id. Repeated rows get a result each. Whole texts count; long ones are looked at in segments. An empty
    table gives an empty result. There is a bucket for bucket_bytes of text, most_buckets at most: beyond that a bucket
    holds more, and a task the 33 bytes of each of its ranks, of which a byte of text has a thirteenth. Other columns of df aren't looked at.
    """
    if threshold % 2 or not 16 <= threshold <= 256:
        raise ValueError("threshold: an even number from 16 to 256")
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("b"))
    docs = docs.withColumns({"d": F.coalesce("doc_id", F.lit(2**63 - 1)), "h": F.md5("b")}).withColumn("k", F.xxhash64("d", "h"))
    owners = staged(docs.groupBy("h").agg(F.min("d").alias("least"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("b")).alias("size")), "text-owners")
    size = owners.agg(F.sum("size")).first()[0] or 0
    buckets = min(most_buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes)))
    copies = staged(docs.select("k", "d", "h").join(owners.where("n > 1").select("h", "least"), "h").where("d > least").select("k").distinct(), "copies")

    name = free_name(df, f"suffix_dedup_{uuid.uuid4().hex}")
    table = docs.select("k", "d", "doc_id", "b").repartition(buckets, "k")
    folder = f"{shared_dir(spark)}/stage/{name}"
    table.write.bucketBy(buckets, "k").option("path", folder).option("compression", "zstd").format("parquet").saveAsTable(name)
    table = spark.table(name)
    own = table.join(copies.hint("shuffle_merge"), "k", "left_anti")

    def step(kind: str, places: DataFrame | None, with_more: bool) -> DataFrame:
        rows = own.select("k", "d", "b") if places is None else table.join(places.hint("shuffle_merge"), "k").select("k", "d", "b", "places")
        sent = rows.mapInArrow(_send(kind, threshold, buckets, with_more), SENT)
        return staged(sent.repartitionById(buckets, F.col("bucket")).mapInArrow(_meet(buckets), BACK), f"ranks-{kind}")

    half = step("half", None, False)
    whole = step("whole", _places(half, buckets, "first", "later"), True)
    again = step("half", _unsettled(half, whole, buckets), False)
    pair = step("pair", _places(again, buckets, "first", "later"), True)
    result = (
        table.join(copies.withColumn("copy", F.lit(True)).hint("shuffle_merge"), "k", "left")
        .join(_places(whole, buckets, "later").withColumnRenamed("places", "whole").hint("shuffle_merge"), "k", "left")
        .join(_places(pair, buckets, "later").withColumnRenamed("places", "single").hint("shuffle_merge"), "k", "left")
    )
    out = result.select("k", "b", "copy", "whole", "single", F.struct("doc_id").alias("row")).mapInArrow(_removal(threshold, with_text), "row struct<doc_id:long>, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
    out = staged(out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *([F.col("kept").alias("kept_text")] if with_text else [])), "substrings")
    spark.sql(f"DROP TABLE {name}")
    table.staged_path = folder
    discard(table, owners, copies)
    return out
