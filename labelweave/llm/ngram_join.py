"""N-gram Jaccard join: texts whose sets of word n-grams overlap enough, and the components that they form.

A set's n-grams are numbers; its first ones in ascending order hold as many common ones with every set that it may be linked with as
are asked for. What hardly shares any of them is settled at once. What is left meets in tiles: the rarest shared n-grams, each cut into bands of
set size, such that linked sets lie in one tile. Within a tile hashed bitmaps bound the overlap from above by counting bits,
and only pairs that pass are intersected exactly, as sorted arrays. A tile's items first meet its most typical
item; pairs are looked at only as long as they lie in different components, in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.llm.common import discard, quoted, staged, text_or_empty
from labelweave.llm.components import components
from labelweave.llm.near import BROADCAST_IDS, _merged as merged, shared_keys, sized_ids

#: Bytes of text looked at at once; bytes of words whose hashes are remembered.
SLICE_BYTES, WORD_BYTES = 4 << 20, 16 << 20
#: A bitmap has between so many bits; in between eight for each member of a small set, two for each of a large one.
LEAST_BITS, MOST_BITS = 64, 1 << 14
#: Rounds in which what is apart in a tile meets one item of its largest component, before it meets the likeliest of each block, then all; rows of a block; bytes of a block's comparison.
ROUNDS, BLOCK, AT_ONCE = 1, 256, 1 << 24
_MULTIPLIER, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


class WordHashes:
    """Hashes of words, remembered up to so many bytes."""

    def __init__(self, seed: int) -> None:
        self.seed, self.known, self.held = seed, {}, 0

    def __call__(self, words: list[bytes]) -> np.ndarray:
        new = set(words).difference(self.known)
        if self.held > WORD_BYTES:
            self.known, self.held = {}, 0
            new = set(words)
        for w in new:
            self.known[w] = xxhash.xxh64_intdigest(w, self.seed)
            self.held += len(w)
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str, hashes: WordHashes, words: int = 5) -> np.ndarray:
    """The distinct n-grams of a text in ascending order: A-Z in lower case, cut at white space of ASCII; of fewer words the one sequence that they are."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = hashes(found)
    n, width = max(1, len(h) - words + 1), min(words, len(h))
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out * _MULTIPLIER + h[k : k + n]
        out ^= out >> np.uint64(29)
    out = (out ^ (out >> np.uint64(33))) * _MIX
    return np.unique(out ^ (out >> np.uint64(33)))


def common_asked(n, percent: int):
    """How many common first ones a set of n asks for at most, and how many members a link needs."""
    return np.maximum(1, n // 10), -(-percent * n // 100)


def first_ones(n, percent: int):
    """How many of its first n-grams a set sends."""
    asked, needed = common_asked(n, percent)
    return np.minimum(n, n - needed + asked)


def bitmap(members: np.ndarray) -> bytes:
    """A bit for the hash of each member."""
    each = 8 if len(members) <= 512 else 4 if len(members) <= 2048 else 2
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (each * len(members) - 1).bit_length()))
    bits = np.zeros(size, bool)
    bits[members & np.uint64(size - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def unpacked(maps: list[bytes], width: int | None = None) -> np.ndarray:
    """Bitmaps as rows of words, all folded to the narrowest or the width given."""
    width = width or min(map(len, maps))
    out = np.empty((len(maps), width // 8), np.uint64)
    for k, m in enumerate(maps):
        x = np.frombuffer(m, np.uint64)
        while len(x) * 8 > width:
            x = x[: len(x) // 2] | x[len(x) // 2 :]
        out[k] = x
    return out


def bound(n: np.ndarray, own: np.ndarray, m: np.ndarray, other: np.ndarray, both: np.ndarray) -> np.ndarray:
    """The most members two sets can have in common: a bit that only one of them has is a member that only it has. own, other and both count bits."""
    return np.minimum(n - own, m - other) + both


def linked(common: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """100 * intersection >= percent * union, in whole numbers."""
    return (100 + percent) * common >= percent * (n + m)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[str]]]:
    """Stretches of rows of SLICE_BYTES or so, and their texts."""
    texts = batch.column(column)
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(upto):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + SLICE_BYTES, "right")))
        yield begin, end, texts[begin:end].to_pylist()
        begin = end


def _digest(members: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(members.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _signed(rows: DataFrame, width: int, seed: int, words: int, percent: int) -> DataFrame:
    """rows (width columns kept, then the text) with n, id and check - 128 bits of the set - and its first n-grams."""
    schema = T.StructType([*rows.schema.fields[:width], *(T.StructField(x, T.LongType()) for x in ("n", "id", "check")), T.StructField("bands", T.ArrayType(T.LongType()))])
    columns = [f.name for f in schema]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(seed)
        for batch in batches:
            for a, b, texts in _texts(batch, width):
                sets = [shingle_set(t, hashes, words) for t in texts]
                n = np.array([len(s) for s in sets], np.int64)
                full, digests = n > 0, np.array([_digest(s) for s in sets], np.int64).reshape(-1, 2)
                send = first_ones(n, percent)
                keys = np.concatenate([s[:k] for s, k in zip(sets, send.tolist())]).view(np.int64)
                made = [pa.array(n), pa.array(digests[:, 0], mask=~full), pa.array(digests[:, 1], mask=~full), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(send)), pa.int32()), pa.array(keys))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[a:b] for k in range(width)), *made], names=columns)

    return rows.mapInArrow(sign, schema)


def _sets(texts: DataFrame, seed: int, words: int) -> DataFrame:
    """(id, n, bits, members) of the texts given."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(seed)
        for batch in batches:
            for _, _, part in _texts(batch, 0):
                sets = [s for s in (shingle_set(t, hashes, words) for t in part) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s)[0] for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(bitmap, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "n", "bits", "members"])

    return texts.mapInArrow(make, "id long, n long, bits binary, members binary")


def _both(pairs: DataFrame, sets: DataFrame, what: str) -> DataFrame:
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col(what).alias(f"x{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "xa", "xb")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, ok) of distinct pairs, staged: first by their bitmaps, then by their members."""

    def by_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            keep = np.zeros(len(batch), bool)
            for at, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                a, b = unpacked([x, y])
                own, other, both = (int(np.bitwise_count(v).sum()) for v in (a, b, a & b))
                keep[at] = linked(bound(n[at], own, m[at], other, both), n[at], m[at], percent)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], names=["a", "b"])

    def by_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            common = np.zeros(len(batch), np.int64)
            for at in range(len(batch)):
                x, y = (np.frombuffer(batch.column(k)[at].as_buffer(), np.uint64) for k in (4, 5))
                merged_ = np.sort(np.concatenate([x, y]), kind="stable")  # both are sorted: runs are merged
                common[at] = int((merged_[1:] == merged_[:-1]).sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked(common, n, m, percent))], names=["a", "b", "ok"])

    likely = staged(_both(pairs, sets, "bits").mapInArrow(by_bits, "a long, b long"), "ngram-likely")
    return staged(_both(likely, sets, "members").mapInArrow(by_members, "a long, b long, ok boolean"), "ngram-verified")


def _tiles(items: DataFrame, percent: int) -> DataFrame:
    """(tile, id, n, own, typical): where sets that may be linked meet. items: id, n, bands; each set once. Staged."""
    shared = staged(shared_keys(items.select(F.col("id").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("tag"), "bands")), "ngram-shared")
    few = shared.count() <= BROADCAST_IDS // 4
    met = staged(items.select("id", "n", F.explode("bands").alias("key")).join(F.broadcast(shared) if few else shared, "key"), "ngram-met")
    # a set links with nothing if it shares fewer of its first ones than the smallest set it may be linked with asks for
    needed = F.floor((F.lit(percent) * F.col("n") + 99) / 100)
    asked = F.greatest(F.lit(1), F.floor(needed / 10)).cast("long")
    alive = staged(met.groupBy("id").agg(F.count(F.lit(1)).alias("m"), F.first(asked).alias("asked")).where("m >= asked").select("id"), "ngram-alive")
    left = met.join(F.broadcast(alive) if alive.count() <= BROADCAST_IDS else alive, "id")
    count = staged(left.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "ngram-count")
    left = left.join(F.broadcast(count) if count.count() <= BROADCAST_IDS // 4 else count, "key")
    # the rarest of them are enough: all but one less than are asked for
    by = Window.partitionBy("id")
    ranked = left.withColumns({"m": F.count(F.lit(1)).over(by), "rank": F.row_number().over(by.orderBy("c", "key"))})
    ranked = ranked.where((F.col("m") >= asked) & (F.col("rank") <= F.col("m") - asked + 1))
    band = F.floor(F.log(F.col("n")) / F.lit(-math.log(percent / 100) + 1e-9)).cast("long")
    ranked = ranked.withColumn("place", F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band + 1).alias("band"), F.lit(False).alias("own")))))
    # of all that a set sends, what it shares: copies of a text share less than the text they were made from
    rows = staged(ranked.select(F.xxhash64("key", "place.band").alias("tile"), "id", "n", "place.own", (F.col("m") / F.col("n")).alias("typical")), "ngram-placed")
    # n-grams of one passage make tiles of the same sets: one of these is enough
    same = [F.bit_xor(F.xxhash64("id", "own", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    full = rows.groupBy("tile").agg(F.count(F.lit(1)).alias("c"), F.max("own").alias("o"), *same).where("c > 1 and o")
    full = full.groupBy("c", "h1", "h2").agg(F.min("tile").alias("tile")).select("tile")
    out = staged(rows.join(full, "tile"), "ngram-tiles")
    discard(shared, alive, count, met, rows)
    return out


def _rooted(tiles: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return tiles.withColumn("root", F.col("id"))
    few = roots.count() <= BROADCAST_IDS
    return tiles.join(F.broadcast(roots) if few else roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def _mixed(placed: DataFrame, turn: int) -> DataFrame:
    """(tile, top, pick, c, outside) of tiles with several components: the largest, its item to try, the tile's rows and those outside the largest."""
    order = F.struct("typical", "id") if turn == 0 else F.struct(F.xxhash64("id", F.lit(turn)).alias("typical"), "id")
    each = placed.groupBy("tile", "root").agg(F.count(F.lit(1)).alias("c"), F.max(order).alias("pick"))
    top = each.groupBy("tile").agg(F.max(F.struct("c", "root", "pick")).alias("top"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    return staged(top.select("tile", F.col("top.root").alias("top"), F.col("top.pick.id").alias("pick"), "c", (F.col("c") - F.col("top.c")).alias("outside")), "ngram-mixed")


def _near_enough(n: str, m: str, percent: int):
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _block_pairs(placed: DataFrame, mixed: DataFrame, sets: DataFrame, percent: int, best: bool) -> DataFrame:
    """(a, b): pairs of a tile in different components, one of them outside the largest, whose sizes and bitmaps allow a link.

    best: for each item outside only the likeliest of those in a block.
    A tile's rows lie in blocks of BLOCK or so, sorted, so that of equally likely ones the same is taken in every tile; each block of what is outside meets every block of the tile.
    """
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("long")
    rows = placed.join(mixed, "tile").join(sets.select("id", "bits"), "id")
    item = F.struct("id", "n", "root", "own", "bits")
    packed = lambda x, c, k: x.groupBy("tile", F.pmod(F.xxhash64("id"), blocks(c)).alias(k)).agg(F.sort_array(F.collect_list(item)).alias(f"{k}s"), F.first("top").alias("top"))
    left = staged(packed(rows.where("root <> top"), "outside", "x"), "ngram-outside")
    right = staged(packed(rows, "c", "y").drop("top"), "ngram-blocks")
    met = left.join(right, "tile").select("top", "xs", "ys")

    def columns(lists: pa.ListArray) -> tuple:
        """Of all rows' blocks one after another: where each begins, and their items' id, n, root, own and bits."""
        items = lists.flatten()
        return np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy())), *(items.field(k).to_numpy(zero_copy_only=False) for k in range(4)), np.array([*items.field(4).to_pylist(), None], object)[:-1]

    def may_link(n: np.ndarray, p: np.ndarray, m: np.ndarray, w: np.ndarray) -> np.ndarray:
        """For each pair of n and m the share that they have in common at most, by sizes and bitmaps; 0 where that is too little for a link."""
        most = np.minimum(n[:, None], m[None])
        if linked(most, n[:, None], m[None], percent).any():
            width = min(map(len, (*p, *w)))
            x, y = unpacked(p, width), unpacked(w, width)
            own, other = np.bitwise_count(x).sum(1, dtype=np.int64), np.bitwise_count(y).sum(1, dtype=np.int64)
            step = max(1, AT_ONCE // (len(y) * width))
            for a in range(0, len(x), step):
                b = min(len(x), a + step)
                both = np.bitwise_count(x[a:b, None, :] & y[None]).sum(2, dtype=np.int64)
                most[a:b] = np.minimum(most[a:b], bound(n[a:b, None], own[a:b, None], m[None], other[None], both))
        whole = n[:, None] + m[None]
        return np.where(linked(most, n[:, None], m[None], percent), most / (whole - most), 0.0)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops, xs, ys = batch.column(0).to_numpy(), columns(batch.column(1)), columns(batch.column(2))
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for at, top in enumerate(tops):
                (i, n, r, o, p), (j, m, s, q, w) = ([c[x[0][at] : x[0][at + 1]] for c in x[1:]] for x in (xs, ys))
                # pairs of two guests meet in the band below; of two outside, each is seen from either side
                keep = (r[:, None] != s[None]) & (o[:, None] | q[None]) & ((s[None] == top) | (i[:, None] < j[None]))
                if keep.any():
                    share = np.where(keep, may_link(n, p, m, w), 0.0)
                    if best:
                        u = np.flatnonzero(share.any(1))
                        v = share[u].argmax(1)
                    else:
                        u, v = np.nonzero(share)
                    found.append((np.minimum(i[u], j[v]), np.maximum(i[u], j[v])))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
                yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])

    return met.mapInArrow(compare, "a long, b long").distinct()


def set_components(items: DataFrame, texts, percent: int, seed: int, words: int) -> DataFrame | None:
    """(id, root) of the sets that are linked with another, or None. items: id, n, bands, row; texts: of a table (id, row) the texts."""
    tiles = _tiles(items.select("id", "n", "bands"), percent)
    open_ids = staged(tiles.select("id").distinct().join(items.select("id", "row"), "id"), "ngram-open")
    sets = staged(_sets(texts(open_ids), seed, words).dropDuplicates(["id"]), "ngram-sets")
    roots, seen = None, None
    for turn in range(ROUNDS + 2):
        placed = _rooted(tiles, roots)
        mixed = _mixed(placed, turn)
        if not mixed.limit(1).count():
            break
        if turn == 1:  # tiles whose items are all in one component stay so
            settled, tiles = tiles, staged(tiles.join(mixed.select("tile"), "tile"), "ngram-tiles")
            placed = _rooted(tiles, roots)
            discard(settled)
        if turn < ROUNDS:
            # what is outside the largest component meets one item of it; at first the one that it shares most tiles with
            met = placed.join(mixed.select("tile", "top", "pick"), "tile").where("root <> top and id <> pick")
            tries = met.groupBy(F.least("id", "pick").alias("a"), F.greatest("id", "pick").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.first("id").alias("id"))
            if turn == 0:
                tries = tries.groupBy("id").agg(F.max(F.struct("c", "a", "b")).alias("best")).select("best.a", "best.b").distinct()
            else:
                tries = tries.select("a", "b")
        else:
            tries = _block_pairs(placed, mixed, sets, percent, turn == ROUNDS)
        if seen is not None:
            tries = tries.join(seen.select("a", "b"), ["a", "b"], "left_anti")
        found = _verified(staged(tries, "ngram-tries"), sets, percent)
        links = found.where("ok").select("a", "b")
        if roots is None:
            roots = staged(components(links), "ngram-roots") if links.limit(1).count() else None
        else:
            roots = merged(roots, links)
        seen = found if seen is None else seen.unionByName(found)
    discard(tiles, open_ids, sets)
    return roots


def ngram_components(df: DataFrame, text: str = "text", order_by: str = "doc_id", words: int = 5, percent: int = 80, seed: int = 0, names: tuple[str, str] = ("n_shingles", "component_id")) -> DataFrame:
    """The columns of df but for the text, with the number of the text's distinct n-grams and the component that the row lies in: its least order_by, a long.

    Two rows are linked if 100 * intersection >= percent * union of their sets. Every link between components is found:
    sets of `percent` or more in common share enough of their first n-grams, and no candidate is left out but by bounds.
    Sets are equal if their 64-bit n-grams are. A null text is empty; rows without words are linked with nothing, not even one
    another. A row of fewer words than an n-gram has is one n-gram of all of them. A null order_by counts only if a component has no other; rows
    that repeat are in one component. Whole texts count. An empty table gives an empty result. Columns of df that have one of the
    names, in any case, are replaced.
    """
    kept = [c for c in df.columns if c != text and c.lower() not in {n.lower() for n in names}]
    row = F.xxhash64(text_or_empty(text), quoted(order_by).cast("string"))
    rows = df.select(*[quoted(c).alias(f"c{k}") for k, c in enumerate(kept)], quoted(order_by).cast("long").alias("key"), F.monotonically_increasing_id().alias("uid"), row.alias("row"), text_or_empty(text).alias("text"))
    while True:
        signed = staged(_signed(rows, len(kept) + 3, seed, words, percent), "ngram-signed")
        of_set = signed.where("n > 0").groupBy("id").agg(F.min("key").alias("least"), F.min("uid").alias("uid"), F.count(F.lit(1)).alias("c"), (F.min("check") < F.max("check")).alias("clash"))
        several = staged(of_set.where("c > 1"), "ngram-copies")
        if not several.where("clash").limit(1).count():
            break
        seed += 1  # two sets with the same 64 bits: other hashes for all
    copies = several.select("id", F.col("uid").alias("first"))
    few = several.count() <= BROADCAST_IDS
    items = signed.where("n > 0").join(F.broadcast(copies) if few else copies, "id", "left").where("first is null or first = uid")

    def texts(ids: DataFrame) -> DataFrame:
        return df.select(row.alias("row"), text_or_empty(text).alias("text")).join(sized_ids(ids.select(F.col("row")).distinct()), "row", "left_semi").select("text")

    roots = set_components(items.select("id", "n", "bands", "row"), texts, percent, seed, words)
    # a component's least key; sets that are alone and there once are their own
    least = several.select("id", "least")
    if roots is not None:
        sized = F.broadcast(roots) if roots.count() <= BROADCAST_IDS else roots
        own = signed.where("n > 0").select("id", "key").join(sized, "id").groupBy("root").agg(F.min("key").alias("least"))
        in_one = roots.join(own, "root").select("id", "least")
        least = in_one.unionByName(least.join(roots.select("id"), "id", "left_anti"))
    least = staged(least, "ngram-least")
    out = signed.join(F.broadcast(least) if least.count() <= BROADCAST_IDS else least, "id", "left")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(kept)], F.col("n").alias(names[0]), F.coalesce("least", "key").alias(names[1]))
