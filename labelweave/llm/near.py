"""Near-duplicate classes from signature bands: candidates, exact verification, components.

Items with a band in common are candidates. Within a bucket every item is compared with the bucket's least, which gives
most links; buckets whose items are then in one component are done. In the others, items outside the largest component
try some items of it; those that are still apart are compared with all items of other components that have one of their
rarest features, as every item that is near enough has.
No candidate that could be a link is left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.llm.common import discard, staged
from labelweave.llm.components import components

#: Buckets, and ids of candidates, up to which a table of them is broadcast.
BROADCAST_BUCKETS, BROADCAST_IDS = 150_000, 500_000
#: Rounds in which what is apart tries one item of the largest component of each bucket, before all is compared.
ROUNDS = 2


def sized_ids(ids: DataFrame) -> DataFrame:
    """ids, staged, to be broadcast if they are few."""
    ids = staged(ids, "ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def verified(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], similarity: Callable[[list[str], list[str]], np.ndarray], least: float) -> DataFrame:
    """(a, b, d): 1 - similarity of each pair (a, b), from the texts of both, those of `least` or more marked by ok. texts: ids to (id, text)."""
    pairs = staged(pairs, "pairs")
    texts = staged(texts(sized_ids(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())), "pair-texts")
    met = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                s = similarity(part.column(2).to_pylist(), part.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(1.0 - s, pa.float64()), pa.array(s >= least - 1e-12, pa.bool_())], ["a", "b", "d", "ok"])

    return met.select("a", "b", "ta", "tb").mapInArrow(score, "a long, b long, d double, ok boolean")


def spread_features(ids: DataFrame, texts: Callable[[DataFrame], DataFrame], features: Callable[[str], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(h, id, w): the features of the texts with these ids, and their weights."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = [features(t) for t in part.column(1).to_pylist()]
                own = np.repeat(part.column(0).to_numpy(), [len(f[0]) for f in found])
                h, w = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(own), pa.array(w.astype(np.int64))], ["h", "id", "w"])

    return staged(texts(sized_ids(ids)).select("id", "text").mapInArrow(spread, "h long, id long, w long"), "features")


def lonely_features(each: DataFrame) -> DataFrame:
    """(id, n, lonely): the weight of an item's features, and of those that no other of these items has."""
    alone = each.groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.max("w").alias("w")).where("id = last")
    lonely = alone.groupBy("id").agg(F.sum("w").alias("lonely"))
    sizes = each.groupBy("id").agg(F.sum("w").alias("n"))
    return staged(sizes.join(lonely, "id", "left").select("id", "n", F.coalesce("lonely", F.lit(0)).alias("lonely")), "lonely")


def rare_feature_pairs(open_items: DataFrame, each: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of items with different roots, one of them outside, that can have a similarity of `least` or more.

    open_items: id, root, n, lonely, outside; each: h, id, w. Linked items have at least `least` of either's weight in
    common, so in one order of all features - rarest first - both have a common feature among the first that together
    weigh more than the rest. Those features are joined, not the items' buckets: what is common to many comes last.
    """
    count = each.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    ranked = each.join(open_items, "id").join(count, "h")
    before = F.sum("w").over(Window.partitionBy("id").orderBy("c", "h").rowsBetween(Window.unboundedPreceding, -1))
    first = ranked.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") <= F.col("n") * (1.0 - least) + 1e-6)
    first = staged(first.select("h", "id", "root", "n", (F.col("n") - F.greatest("lonely", "before")).alias("most"), "outside"), "rare-features")
    mixed = staged(first.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("outside").alias("o")).where("lo < hi and o").select("h"), "rare-mixed")
    first = first.join(mixed, "h", "left_semi")
    left = first.where("outside").select("h", F.col("id").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("most").alias("ma"))
    right = first.select("h", F.col("id").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("most").alias("mb"))
    met = left.join(right, "h").where("ra <> rb")
    # of the pair's first common feature on, both must have enough left
    enough = least / (1.0 + least) * (F.col("na") + F.col("nb")) - 1e-6
    met = met.where(F.least("ma", "mb") >= enough)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_classes(items: DataFrame, texts: Callable[[DataFrame], DataFrame], similarity: Callable[[list[str], list[str]], np.ndarray], least: float, features: Callable[[str], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(id, root) of the items that have a near-duplicate, root the least id of the class.

    items: id and bands, an array of longs, equal bands only in equal places, a table that gives the same rows whenever it
    is read; texts: ids to (id, text). Items without bands have no near-duplicates. similarity: weighted Jaccard
    similarity of the features, given as hashes and weights by features.
    """
    bands = items.select("id", F.explode("bands").alias("key"))
    buckets = staged(bands.groupBy("key").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("rep < last"), "buckets")
    larger = buckets.where("n > 2").select("key", "rep")
    few = larger.count() <= BROADCAST_BUCKETS
    members = staged(bands.join(F.broadcast(larger) if few else larger, "key").select("key", "rep", "id"), "members")
    pairs = members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).unionByName(buckets.where("n = 2").select(F.col("rep").alias("a"), F.col("last").alias("b"))).distinct()
    seen = staged(verified(pairs, texts, similarity, least), "verified")
    roots = staged(components(seen.where("ok").select("a", "b")), "roots")
    return _what_is_apart(members, roots, seen, texts, similarity, least, features)


#: Keys that a task gathers before it sends them on, and keys of a partition.
CENSUS_FLUSH, CENSUS_PART = 1 << 21, 1 << 22


def shared_keys(items: DataFrame) -> DataFrame:
    """(key): the keys that items with different tags have. items: tag int, bands array<long>.

    Tasks sort their keys and send each once, or twice if they hold it with different tags, packed by range of keys: 12 bytes
    each, and no more for keys that many items have. Two items with the same tag (by chance, once in 2^32) don't count.
    """
    spark = items.sparkSession
    total = items.agg(F.sum(F.size("bands"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // CENSUS_PART))

    def pack(held: list) -> Iterator[pa.RecordBatch]:
        key, tag = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key, kind="stable")
        key, tag = key[order], tag[order]
        new = np.append(True, key[1:] != key[:-1])
        start = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        other = np.flatnonzero(tag != tag[start][which])
        keep = np.sort(np.concatenate([start, other[np.unique(which[other], return_index=True)[1]]]))
        key, tag = key[keep], tag[keep]
        part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.diff(part)) + 1
        begin, end = np.append(0, cut), np.append(cut, len(key))
        planes = [key[a:b].astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes() for a, b in zip(begin, end)]  # bytes of one weight together: the first ones hardly change
        yield pa.RecordBatch.from_arrays([pa.array(part[begin], pa.int32()), pa.array(planes, pa.binary()), pa.array([tag[a:b].tobytes() for a, b in zip(begin, end)], pa.binary())], ["part", "keys", "tags"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            bands = batch.column(1)
            key = bands.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if not len(key):
                continue
            sizes = np.diff(bands.offsets.to_numpy())
            tag = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32), np.where(bands.is_valid().to_numpy(zero_copy_only=False), sizes, 0))
            held.append((key, tag))
            n += len(key)
            if n >= CENSUS_FLUSH:
                yield from pack(held)
                held, n = [], 0
        if held:
            yield from pack(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, tags = [], []
        for batch in batches:
            for planes, tag in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                keys.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(">u8")[:, 0].astype(np.uint64))
                tags.append(np.frombuffer(tag, np.int32))
        if keys:
            key, tag = np.concatenate(keys), np.concatenate(tags)
            order = np.argsort(key, kind="stable")
            key, tag = key[order], tag[order]
            found = np.unique(key[1:][(key[1:] == key[:-1]) & (tag[1:] != tag[:-1])])
            for at in range(0, len(found), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(found[at : at + (1 << 16)].view(np.int64))], ["key"])

    sent = items.select("tag", "bands").mapInArrow(send, "part int, keys binary, tags binary")
    return sent.repartitionById(parts, F.col("part")).mapInArrow(meet, "key long")


def size_class(n: np.ndarray, least: float) -> np.ndarray:
    """Classes of sizes, as bytes: sizes of which the smaller is at least `least` of the larger differ by a class at most."""
    return np.minimum(np.log(np.maximum(n, 1)) / (-math.log(least) + 1e-9), 255).astype(np.uint8)


def shared_buckets(items: DataFrame, bins: int, least: float) -> DataFrame:
    """(key, id): the items of each bucket that several have, as far as they may be alike, buckets of the same items once.

    items: id, n, sketch, and bands, the first six bytes of each key one after another. Tasks send their keys sorted and packed by range, with ids, size classes
    and 32 bits of the sketches; only what finds company in its range's task comes out: of a bucket of at most CROWDED items
    those that may be alike with another one by size - exact - and sketch, the bound five deviations below what is expected, keyed by what the set holds. Of a key that a task has more often
    than CROWDED, the rest goes on as it is and meets in no task.
    """
    spark = items.sparkSession
    total = (items.agg(F.sum(F.octet_length("bands"))).first()[0] or 0) // 6
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // CENSUS_PART))
    most, flush, at_once = CROWDED, CENSUS_FLUSH, PAIRS_AT_ONCE
    p = least + (1 - least) / 2  # unlike components agree in half of their last bits; items that fill few of them aren't judged
    size = np.exp(np.minimum(np.arange(256) * -math.log(max(least, 1e-9)), 500)) if least < 1 else np.ones(256)
    full = 32 * (1 - np.exp(-size / bins))
    agreeing = np.where(size < 1.5 * bins, 0, np.floor(32 * (p - 5 * np.sqrt(p * (1 - p) / full)))).astype(np.int64)

    def pack(held: list) -> Iterator[pa.RecordBatch]:
        key, own, bits, kind = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key)
        key, own, bits, kind = (x[order] for x in (key, own, bits, kind))
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        rest = []
        if size.max() > most + 1:
            extra = np.arange(len(key)) - np.repeat(start, size) > most
            more = np.flatnonzero(extra)
            rest = [(int(key[x[0]]), own[x]) for x in np.split(more, np.flatnonzero(np.diff(key[more])) + 1)]
            key, own, bits, kind = (x[~extra] for x in (key, own, bits, kind))
        part = ((key >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.diff(part)) + 1
        begin, end = np.append(0, cut), np.append(cut, len(key))
        to, planes, sent = part[begin].tolist(), [], []
        for a, b in zip(begin.tolist(), end.tolist()):
            planes.append(key[a:b].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].T.tobytes())  # bytes of one weight together: the first ones hardly change
            sent.append(own[a:b].tobytes() + bits[a:b].tobytes() + kind[a:b].tobytes())
        for k, more in rest:
            for at in range(0, len(more), 1 << 16):
                to.append(int(more[at]) % parts)
                planes.append(k.to_bytes(8, "big"))  # one key of eight bytes: passed on
                sent.append(more[at : at + (1 << 16)].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(planes, pa.binary()), pa.array(sent, pa.binary())], ["part", "keys", "ids"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            bands = batch.column(3).to_pylist()
            short = np.frombuffer(b"".join(bands), np.uint8).reshape(-1, 6)
            if len(short):
                key = np.zeros((len(short), 8), np.uint8)
                key[:, 2:] = short
                count = [len(b) // 6 for b in bands]
                bits = (batch.column(2).to_numpy() & 0xFFFFFFFF).astype(np.uint32)
                held.append((key.view(">u8")[:, 0].astype(np.uint64), *(np.repeat(x, count) for x in (batch.column(0).to_numpy(), bits, size_class(batch.column(1).to_numpy(), least)))))
                n += len(key)
            if n >= flush:
                yield from pack(held)
                held, n = [], 0
        if held:
            yield from pack(held)

    def may_link(start: np.ndarray, size: np.ndarray, bits: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Which rows of the buckets (start, size) may be alike with another one of theirs."""
        keep = np.zeros(len(bits), bool)
        rows = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        after = np.repeat(start + size, size) - rows - 1
        sums = np.cumsum(after)
        cuts = np.searchsorted(sums, np.arange(at_once, (sums[-1] if len(sums) else 0) + at_once, at_once), side="right")
        begin = 0
        for end in np.unique(np.append(cuts, len(rows))):
            some = after[begin:end]
            x = np.repeat(rows[begin:end], some)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(some) - some, some)
            begin = end
            low, high = np.minimum(kind[x], kind[y]), np.maximum(kind[x], kind[y])
            fits = (high - low <= 1) & (32 - np.bitwise_count(bits[x] ^ bits[y]).astype(np.int64) >= agreeing[low])
            keep[x[fits]] = keep[y[fits]] = True
        return keep

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for planes, sent in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if len(planes) == 8:
                    yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(planes, "big")], pa.int64()), pa.array([sent], pa.binary())], ["key", "ids"])
                    continue
                n = len(sent) // 13
                key = np.zeros((n, 8), np.uint8)
                key[:, 2:] = np.frombuffer(planes, np.uint8).reshape(6, -1).T
                held.append((key.view(">u8")[:, 0].astype(np.int64), np.frombuffer(sent, np.int64, n), np.frombuffer(sent, np.uint32, n, 8 * n), np.frombuffer(sent, np.uint8, n, 12 * n)))
        if not held:
            return
        rows = [np.concatenate(x) for x in zip(*held)]
        held.clear()
        order = np.argsort(rows[0])
        same = rows[0][order[1:]] == rows[0][order[:-1]]
        order = order[np.append(False, same) | np.append(same, False)]
        rows = [x[order] for x in rows]
        order = np.lexsort((rows[1], rows[0]))
        rows = [x[order] for x in rows]
        new = np.append(True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))[: len(order)]
        key, own, bits, kind = (x[new] for x in rows)

        def cut() -> tuple[np.ndarray, np.ndarray]:
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            return start, np.diff(np.append(start, len(key)))

        start, size = cut()
        keep = may_link(start[size <= most], size[size <= most], bits, kind) | np.repeat(size > most, size)
        crowded = set(key[start[size > most]].tolist())
        key, own = key[keep], own[keep]
        start, size = cut()
        raw, sets, crowds = own.tobytes(), set(), []
        for k, a, b in zip(key[start].tolist(), start.tolist(), (start + size).tolist()):
            if k in crowded:
                crowds += ((k, raw[8 * i : 8 * min(b, i + (1 << 16))]) for i in range(a, b, 1 << 16))
            elif b - a > 1:
                sets.add(raw[8 * a : 8 * b])
        found = [*((None, x) for x in sets), *crowds]
        for at in range(0, len(found), 1 << 14):
            k, x = zip(*found[at : at + (1 << 14)])
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(x, pa.binary())], ["key", "ids"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_pylist()
            sizes = [len(x) // 8 for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(np.frombuffer(b"".join(ids), np.int64))], ["key", "id"])

    sent = items.select("id", "n", "sketch.a", "bands").mapInArrow(send, "part int, keys binary, ids binary")
    met = staged(sent.repartitionById(parts, F.col("part")).mapInArrow(meet, "key long, ids binary"), "shared-sets")
    small = met.where("key is null").select("ids").distinct().select(F.xxhash64("ids").alias("key"), "ids")
    return small.unionByName(met.where("key is not null")).mapInArrow(unpack, "key long, id long")


#: Rows of a bucket up to which all of them meet in a task, and pairs that a task looks at at once.
CROWDED, PAIRS_AT_ONCE = 256, 1 << 18
#: Items of a bucket that lie outside its largest component, up to which they are compared with all of it; items and features of a block, pairs whose bitmaps are compared at once, and bytes of text up to which a table is broadcast.
MOST_OUTSIDE, BLOCK_ROWS, BLOCK_SIZE, PAIRS_OF_MAPS, BROADCAST_TEXT = 4096, 256, 1 << 17, 1 << 13, 16 << 20
#: A sketch: three bits of each of 64 components of a signature, those of one weight in one long.
SKETCH = "struct<a:long,b:long,c:long>"


def alike(x: Column, y: Column, bins: int, least: float) -> Column:
    """Whether two items (n, sketch) can have a similarity of `least`, by their sizes - exact - and their sketches.

    Items at similarity s agree in s + (1 - s) / 8 of their components on average, unlike ones in an eighth. The bound lies 4.3
    deviations below that at `least`, as for so many independent components as an item of that size fills of 64.
    """
    size = F.least(x["n"], y["n"])
    differ = F.lit(0).cast("long")
    for k in "abc":
        differ = differ.bitwiseOR(x["sketch"][k].bitwiseXOR(y["sketch"][k]))
    p = least + (1 - least) / 8
    full = 64 * (1 - F.exp(-size / F.lit(float(bins))))
    lowest = F.floor(64 * (p - 4.3 * F.sqrt(p * (1 - p) / full)))
    return (size >= F.greatest(x["n"], y["n"]) * F.lit(least) - 1e-9) & (64 - F.bit_count(differ) >= lowest)


def least_agreeing(size: np.ndarray, bins: int, least: float) -> np.ndarray:
    """The bound of `alike`: how many of the components of two items, the smaller of that size, must agree."""
    p = least + (1 - least) / 8
    full = 64 * (1 - np.exp(-size / float(bins)))
    return np.floor(64 * (p - 4.3 * np.sqrt(p * (1 - p) / full)))


def sketched_classes(members: DataFrame, texts: Callable[[DataFrame], DataFrame], similarity: Callable, bins: int, least: float, features: Callable) -> DataFrame:
    """(id, root) of the items that have a near-duplicate, root the least id of the class.

    members: key, id, n (an item's number of features), sketch (SKETCH, of a signature of `bins` components) - a row for each
    bucket that an item lies in, buckets of one item and repeated rows allowed. A staged table. texts: ids to (id, text).
    Pairs that `alike` rules out are not looked at. Every item meets its bucket's least first. What is then still apart
    meets in its bucket, if that has no more than CROWDED rows. A larger bucket is split by size, so that items that may be alike share a part; in each part all items meet those outside
    its largest component, in blocks with their texts; only links that join what is apart come out. Where more than MOST_OUTSIDE
    items are outside, rounds and rare features settle the part as in near_classes.
    """
    item = F.struct("id", "n", "sketch")
    reps = members.groupBy("key").agg(F.min(item).alias("rep"), F.max("id").alias("last"), F.count(F.lit(1)).alias("c")).where("rep.id < last").select("key", "rep", "c")
    reps = staged(reps, "buckets")
    few = reps.count() <= BROADCAST_BUCKETS
    sized = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    met = members.join(sized(reps), "key").where("id <> rep.id").withColumn("own", item)
    star = met.where(alike(F.col("own"), F.col("rep"), bins, least)).select(F.col("rep.id").alias("a"), F.col("id").alias("b"))
    seen = staged(verified(star.distinct(), texts, similarity, least), "verified")
    roots = staged(components(seen.where("ok").select("a", "b")), "roots")

    # what is apart in a bucket of bounded size meets within it
    crowded = reps.where(F.col("c") > CROWDED).select("key")
    n_crowded = crowded.count()
    named = F.broadcast(crowded) if n_crowded <= BROADCAST_BUCKETS else crowded
    held = members.join(named, "key", "left_anti") if n_crowded else members
    tries = _bucket_pairs(held.join(_broadcast_few(roots), "id", "left").withColumn("root", F.coalesce("root", "id")), bins, least)
    tries = staged(tries.join(seen.select("a", "b"), ["a", "b"], "left_anti"), "tries")
    ids = tries.select(F.explode(F.array("a", "b")).alias("id"))
    big = None
    if n_crowded:
        placed, parts, rows = _crowded_parts(members.join(named, "key", "left_semi"), roots, least)
        ids = ids.unionByName(rows.select("id"))
    # the texts of both are made once
    held = staged(texts(sized_ids(ids.distinct())), "texts")
    found = staged(verified(tries, lambda ids: held.join(ids, "id", "left_semi"), similarity, least), "verified")
    seen, links = seen.unionByName(found), found.where("ok").select("a", "b")
    if n_crowded:
        links = links.unionByName(staged(_block_links(rows, held, similarity, bins, least), "part-links"))
        big = parts.where(F.col("outside") > MOST_OUTSIDE).select("key")
    discard(reps, tries, held)
    roots = _merged(roots, links)
    if big is None:
        return roots
    if not big.limit(1).count():
        discard(placed, parts)
        return roots
    large = placed.join(big, "key", "left_semi").select("key", "id")
    tops = large.groupBy("key").agg(F.min("id").alias("rep"))
    return _what_is_apart(staged(large.join(tops, "key").select("key", "rep", "id"), "members"), roots, seen, texts, similarity, least, features)


def _bucket_pairs(members: DataFrame, bins: int, least: float) -> DataFrame:
    """(a, b): the pairs that share a bucket of at most CROWDED rows, have different roots and are `alike`. members: key, id, n, sketch, root."""

    def pairs(key: np.ndarray, own: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket = np.append(0, np.cumsum(key[1:] != key[:-1])) << 32
        after = np.searchsorted(bucket + n, bucket + np.floor(n / least + 1e-6).astype(np.int64), side="right") - np.arange(1, len(key) + 1)  # rows of the bucket that follow, up to the size that may be alike
        sums = np.cumsum(after)
        cuts = np.searchsorted(sums, np.arange(PAIRS_AT_ONCE, sums[-1] + PAIRS_AT_ONCE, PAIRS_AT_ONCE), side="right")
        begin = 0
        for end in np.unique(np.append(cuts, len(key))):
            some = after[begin:end]
            x = np.repeat(np.arange(begin, end), some)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(some) - some, some)
            begin = end
            small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            keep = (root[x] != root[y]) & (small >= large * least - 1e-9)
            x, y, small = x[keep], y[keep], small[keep]
            differ = ((a[x] ^ a[y]) | (b[x] ^ b[y]) | (c[x] ^ c[y])).view(np.uint64)  # of signed numbers the bits of the absolute value would be counted
            keep = 64 - np.bitwise_count(differ).astype(np.int64) >= least_agreeing(small, bins, least)
            lo, hi = np.minimum(own[x], own[y])[keep], np.maximum(own[x], own[y])[keep]
            order = np.lexsort((hi, lo))
            lo, hi = lo[order], hi[order]
            new = np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))[: len(lo)]
            yield pa.RecordBatch.from_arrays([pa.array(lo[new]), pa.array(hi[new])], ["a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            rows = [c.to_numpy() for c in batch.columns]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            whole = int(np.searchsorted(rows[0], rows[0][-1]))  # the last bucket may go on
            if whole:
                yield from pairs(*(x[:whole] for x in rows))
            held = [x[whole:] for x in rows]
        if held is not None:
            yield from pairs(*held)

    flat = members.select("key", "id", F.col("n").cast("long").alias("n"), "sketch.a", "sketch.b", "sketch.c", "root")
    return flat.repartition("key").sortWithinPartitions("key", "n").mapInArrow(meet, "a long, b long").distinct()


def _crowded_parts(members: DataFrame, roots: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the crowded buckets' members: them by part, the parts that hold several components, and the rows of those parts with at most MOST_OUTSIDE rows outside the largest, with its root and the numbers of blocks."""
    # items that may be alike differ in size by less than a class, so one of the two classes of each is the other's
    size = F.floor(F.log(F.col("n")) / F.lit(-math.log(least) + 1e-9)).cast("long")
    placed = members.join(_broadcast_few(roots), "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = staged(placed.withColumn("class", F.explode(F.array(size, size + 1))).select(F.xxhash64("key", "class").alias("key"), "id", "n", "sketch", "root").distinct(), "bucket-parts")
    by_root = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    parts = by_root.groupBy("key").agg(F.max(F.struct("c", "root", "n")).alias("top"), F.sum("c").alias("c"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    blocks = lambda c, n: F.ceil(F.greatest(c / BLOCK_ROWS, n / BLOCK_SIZE)).cast("long")
    outside, rest = F.col("c") - F.col("top.c"), F.col("n") - F.col("top.n")
    parts = staged(parts.select("key", F.col("top.root").alias("top"), outside.alias("outside"), blocks(outside, rest).alias("xs"), blocks(F.col("c"), F.col("n")).alias("ys")), "parts")
    bounded = parts.where(F.col("outside") <= MOST_OUTSIDE)
    return placed, parts, placed.join(F.broadcast(bounded) if parts.count() <= BROADCAST_BUCKETS else bounded, "key")


def _block_links(rows: DataFrame, texts: DataFrame, similarity: Callable, bins: int, least: float) -> DataFrame:
    """(a, b): links that join what is apart in the parts. rows: of _crowded_parts; texts: id, text, of all of them.

    Both what is outside and the whole part lie in blocks, texts included, so that pairs are verified where blocks meet; only the links of a forest come out, fewer than two blocks have items.
    """
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.join(F.broadcast(texts) if total <= BROADCAST_TEXT else texts, "id")
    item = F.struct("id", "n", "root", "sketch.a", "sketch.b", "sketch.c", "text")
    packed = lambda x, k: x.groupBy("key", F.pmod(F.xxhash64("id"), F.col(k)).alias("block")).agg(F.collect_list(item).alias(k), F.first("top").alias("top")).drop("block")
    left = staged(packed(rows.where("root <> top"), "xs"), "part-outside")
    right = staged(packed(rows, "ys").drop("top"), "part-blocks")
    met = left.join(right, "key").select("top", "xs", "ys")

    def columns(items: pa.StructArray) -> tuple:
        return *(items.field(k).to_numpy(zero_copy_only=False) for k in range(6)), items.field(6).to_pylist()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[int, int]] = []
            for at in range(len(batch)):
                top = batch.column(0)[at].as_py()
                (i, n, r, *x, lines), (j, m, s, *y, more) = (columns(batch.column(k)[at].values) for k in (1, 2))
                small, large = np.minimum(n[:, None], m[None]), np.maximum(n[:, None], m[None])
                keep = (r[:, None] != s[None]) & ((s[None] == top) | (i[:, None] < j[None])) & (small >= large * least - 1e-9)
                u, v = np.nonzero(keep)
                differ = ((x[0][u] ^ y[0][v]) | (x[1][u] ^ y[1][v]) | (x[2][u] ^ y[2][v])).view(np.uint64)
                keep = 64 - np.bitwise_count(differ).astype(np.int64) >= least_agreeing(small[u, v], bins, least)
                u, v = u[keep], v[keep]
                if len(u):
                    own = np.append(i, j)
                    links += ((min(p), max(p)) for p in own[forest(lines + more, np.append(r, s), u, v + len(i), similarity)].tolist())
            if links:
                a, b = np.array(sorted(set(links)), np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return met.mapInArrow(compare, "a long, b long").distinct()


def forest(lines: list[str], roots: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: Callable) -> np.ndarray:
    """Of the pairs of lines (left, right) such links that join all that the links among them join, as rows of two places. The likeliest pairs are verified first; those whose roots a link has joined are not verified."""
    maps = similarity.maps(lines)
    most = np.concatenate([similarity.bounds(maps, left[k : k + PAIRS_OF_MAPS], right[k : k + PAIRS_OF_MAPS]) for k in range(0, len(left), PAIRS_OF_MAPS)])
    order = np.argsort(-most, kind="stable")
    order = order[most[order] >= similarity.least - 1e-9]
    left, right = left[order], right[order]
    group = np.unique(roots, return_inverse=True)[1]
    known: dict[int, frozenset] = {}
    out, begin, step = [], 0, 64
    while begin < len(left):
        a, b = left[begin : begin + step], right[begin : begin + step]
        begin, step = begin + step, 2 * step
        for p, q in np.stack([a, b], 1)[group[a] != group[b]].tolist():
            if group[p] != group[q] and similarity.of_sets(lines, p, q, known) >= similarity.least - 1e-12:
                group[group == group[q]] = group[p]
                out.append((p, q))
    return np.array(out, np.int64).reshape(-1, 2)


def _broadcast_few(roots: DataFrame) -> DataFrame:
    return F.broadcast(roots) if roots.count() <= BROADCAST_IDS else roots


def _what_is_apart(members: DataFrame, roots: DataFrame, seen: DataFrame, texts: Callable[[DataFrame], DataFrame], similarity: Callable, least: float, features: Callable) -> DataFrame:
    """Roots after everything in a bucket (members: key, rep, id) that lies in several components has been compared as far as it can be linked."""
    known = None
    for turn in range(ROUNDS):
        placed, tops, known = _mixed_buckets(members, roots, texts, features, known, turn)
        if tops is None:
            return roots
        # everything outside a bucket's largest component meets an item of it, its most typical one first
        tries = placed.join(tops, "key").where("root <> top").select(F.least("id", "pick").alias("a"), F.greatest("id", "pick").alias("b")).distinct()
        found = staged(verified(tries.join(seen.select("a", "b"), ["a", "b"], "left_anti"), texts, similarity, least), "verified")
        seen = seen.unionByName(found)
        roots = _merged(roots, found.where("ok").select("a", "b"))

    # what is still apart meets everything that it can be linked to, whatever the bucket
    placed, tops, known = _mixed_buckets(members, roots, texts, features, known, ROUNDS)
    if tops is None:
        return roots
    apart = placed.join(tops.select("key", "top", "smallest"), "key")
    # no other item has more in common with this one than its features that aren't its alone: closed if that is too little
    shared = F.col("n") - F.col("lonely")
    most = shared / (F.col("n") + F.greatest("smallest", shared) - shared)
    apart = apart.where(most >= least - 1e-9).groupBy("id", "root", "n", "lonely").agg(F.max(F.col("root") != F.col("top")).alias("outside"))
    rest = rare_feature_pairs(staged(apart, "apart"), known[0], least)
    more = staged(verified(rest.join(seen.select("a", "b"), ["a", "b"], "left_anti"), texts, similarity, least).where("ok").select("a", "b"), "more-links")
    return _merged(roots, more)


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots after more links: only roots that a link joins go through the components again."""
    if not links.limit(1).count():
        return roots
    a = links.join(roots.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b", "left")
    between = components(a.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    between = staged(between.select(F.col("id").alias("root"), F.col("root").alias("new")), "root-moves")
    moved = roots.join(between, "root", "left").select("id", F.coalesce("new", "root").alias("root"))
    fresh = between.select(F.col("root").alias("id"), F.col("new").alias("root")).join(roots.select("id"), "id", "left_anti")
    return staged(moved.unionByName(fresh), "roots")


def _mixed_buckets(members: DataFrame, roots: DataFrame, texts: Callable[[DataFrame], DataFrame], features: Callable, known: tuple[DataFrame, DataFrame] | None, turn: int) -> tuple[DataFrame, DataFrame | None, tuple[DataFrame, DataFrame] | None]:
    """Members with root, n and lonely; of each bucket with several components the largest one (top), an item of it (pick) and its smallest item's n; and all features and the lonely ones, found out once."""
    placed = staged(members.join(roots, "id", "left").select("key", "rep", "id", F.coalesce("root", "id").alias("root")), "placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    mixed = staged(mixed, "mixed")
    few = mixed.count()
    if not few:
        return placed, None, known
    mixed = F.broadcast(mixed) if few <= BROADCAST_BUCKETS else mixed
    placed = placed.join(mixed, "key", "left_semi")
    if known is None:
        each = spread_features(staged(placed.select("id").distinct(), "mixed-ids"), texts, features)
        known = each, lonely_features(each)
    placed = staged(placed.join(known[1], "id"), "placed")
    typical = F.when(F.lit(turn) == 0, F.col("lonely") / F.col("n")).otherwise(0.0)
    parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(typical.alias("t"), F.xxhash64("id", F.lit(turn), "key").alias("h"), "id")).alias("pick"), F.min("n").alias("smallest"))
    tops = parts.groupBy("key").agg(F.max(F.struct("c", "root", F.col("pick.id").alias("pick"))).alias("t"), F.min("smallest").alias("smallest"))
    tops = staged(tops.select("key", F.col("t.root").alias("top"), F.col("t.pick").alias("pick"), "smallest"), "tops")
    return placed, F.broadcast(tops) if few <= BROADCAST_BUCKETS else tops, known
