"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

The records of each source are cut into blocks. In an ideal mixture that could divide blocks, source s has received
F_s(t) = min(w_s x(t), b_s) blocks after t slots: its weight times a common time x, until its b_s blocks have run out.
Block k is released at the last whole slot before F_s reaches k and due at the first one after F_s reaches k + 1, both
from the weight as it is, not from a rounded one; each slot goes to the released block with the earliest deadline. As
the ideal never gives out more than a slot a slot, all deadlines hold, so a source is always less than one block from
its share.

The slots are cut into stretches that Spark schedules side by side. A stretch is so long that every source receives a
block in it, so no block's window reaches across a whole stretch and each border can be settled by itself: of every
source floor(F_s) or one more of its blocks lie before the border. Which sources have one more: those with the earliest
deadlines, as long as the blocks released from any slot on fit between that slot and the border. These sets are the
independent sets of a matroid, so the greedy choice leaves the later stretch the most it can, and both sides keep all
deadlines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.llm.common import free_name, kept_columns, quoted

#: Sources up to which the table of sources is broadcast.
BROADCAST_SOURCES = 500
#: How near to a whole number a time or share counts as whole. Deadlines hold as long as the sources times this are below 1.
NEAR = 1e-6


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _whole_before(x: Column) -> Column:
    return F.floor(x + NEAR).cast("long")


def _whole_after(x: Column) -> Column:
    return F.ceil(x - NEAR).cast("long")


def _slot_at(sources: Column, x: Column) -> Column:
    """The slots that are given out by the common time x."""
    return F.aggregate(sources, F.lit(0.0), lambda acc, s: acc + F.least(s["w"] * x, s["b"].cast("double")))


def _time_at(turns: Column, slot: Column) -> Column:
    """The common time x at which so many slots are given out."""
    last = F.element_at(F.filter(turns, lambda q: q["t"] <= slot + NEAR), -1)
    return _once(last, lambda q: q["x"] + F.when(q["a"] > 0, (slot - q["t"]) / q["a"]).otherwise(0.0))


def _received(source: Column, x: Column) -> Column:
    return F.least(source["w"] * x, source["b"].cast("double"))


def source_plan(counts: DataFrame, weights: dict[str, float] | None, block_rows: int, stretch: int, power: float) -> DataFrame:
    """One row: the sources (i, s, n, w, b), the turns (x, t, a) at which the active weight a changes, slots in all, slots a stretch.

    Without weights a source weighs its number of rows to the given power.
    """
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        positive = {k: float(v) for k, v in weights.items() if v > 0}
        named = F.create_map(*[x for k, v in positive.items() for x in (F.lit("s" + k), F.lit(v))]) if positive else F.lit(None).cast("map<string,double>")
        weight = F.coalesce(named[F.col("s")], F.lit(min([*positive.values(), 1.0])))
    one = counts.agg(F.array_sort(F.collect_list(F.struct("s", "n", weight.alias("w")))).alias("all"))  # one entry for each source
    blocks = lambda x: F.ceil(x["n"] / F.lit(block_rows)).cast("long")
    one = one.select(F.transform("all", lambda x, i: F.struct(i.cast("long").alias("i"), x["s"].alias("s"), x["n"].alias("n"), x["w"].alias("w"), blocks(x).alias("b"))).alias("all"))
    ends = F.array_distinct(F.concat(F.array(F.lit(0.0)), F.array_sort(F.transform("all", lambda x: x["b"] / x["w"]))))
    active = lambda x: F.aggregate("all", F.lit(0.0), lambda acc, s: acc + F.when(s["b"] / s["w"] > x, s["w"]).otherwise(0.0))
    turns = F.transform(ends, lambda x: F.struct(x.alias("x"), _slot_at(F.col("all"), x).alias("t"), active(x).alias("a")))
    total = F.aggregate("all", F.lit(0).cast("long"), lambda acc, x: acc + x["b"])
    least = F.array_min(F.transform("all", lambda x: x["w"]))
    longest = F.ceil(active(F.lit(0.0)) / least).cast("long") + 1  # a source of the least weight receives a block in so many slots
    return one.select("all", turns.alias("turns"), total.alias("total"), F.least(total, F.greatest(F.lit(stretch).cast("long"), longest)).alias("span")).where("total > 0")


def _before_border(sources: Column, turns: Column, border: Column, span: Column) -> Column:
    """For each source, in the order of its number, how many of its blocks lie before the border."""
    at = lambda x: F.transform(
        sources,
        lambda s: _once(_whole_before(_received(s, x)), lambda low: F.struct(s["i"].alias("i"), s["w"].alias("w"), s["b"].alias("b"), low.alias("low"), (_received(s, x) - low > NEAR).alias("open"))),
    )

    def settle(each: Column) -> Column:
        more = border - F.aggregate(each, F.lit(0).cast("long"), lambda acc, s: acc + s["low"])
        wanting = F.transform(
            F.filter(each, lambda s: s["open"]),
            lambda s: F.struct(_whole_after(_slot_at(sources, (s["low"] + 1) / s["w"])).alias("due"), s["i"].alias("i"), _whole_before(_slot_at(sources, s["low"] / s["w"])).alias("r")),
        )
        needed = lambda x: F.aggregate(each, F.lit(0).cast("long"), lambda acc, s: acc + F.greatest(F.lit(0).cast("long"), s["low"] - _whole_after(_received(s, x))))
        rooms = F.transform(
            F.sequence(F.greatest(F.lit(0).cast("long"), border - span), border - 1),
            lambda a: F.struct(a.alias("a"), (border - a - _once(_time_at(turns, a.cast("double")), needed)).alias("room")),
        )

        def take(acc: Column, s: Column) -> Column:
            fits = (F.size(acc["taken"]) < more) & ~F.exists(acc["rooms"], lambda q: (q["a"] <= s["r"]) & (q["room"] <= 0))
            fewer = F.transform(acc["rooms"], lambda q: F.struct(q["a"].alias("a"), (q["room"] - F.when(q["a"] <= s["r"], 1).otherwise(0)).alias("room")))
            return F.when(fits, F.struct(fewer.alias("rooms"), F.concat(acc["taken"], F.array(s["i"])).alias("taken"))).otherwise(acc)

        taken = F.aggregate(F.array_sort(wanting), F.struct(rooms.alias("rooms"), F.array().cast("array<long>").alias("taken")), take, lambda acc: acc["taken"])
        return _once(taken, lambda got: F.transform(each, lambda s: s["low"] + F.when(F.array_contains(got, s["i"]), 1).otherwise(0)))

    inside = _once(_time_at(turns, border.cast("double")), lambda x: _once(at(x), settle))
    return F.when(border == 0, F.transform(sources, lambda s: F.lit(0).cast("long"))).otherwise(inside)


def _earliest_deadline_first(sources: Column, start: Column, first: Column, until: Column) -> Column:
    """The blocks (i, k) of the slots from start on, by slot: those of source i from first[i] to before until[i]."""

    def block(s: Column, k: Column, end: Column) -> Column:
        release, due = _whole_before(_slot_at(sources, k / s["w"])), _whole_after(_slot_at(sources, (k + 1) / s["w"]))
        return F.struct(s["i"].alias("i"), s["w"].alias("w"), k.alias("k"), end.alias("end"), release.alias("r"), due.alias("due"))

    at = lambda values, s: F.element_at(values, (s["i"] + 1).cast("int"))
    state = F.filter(F.transform(sources, lambda s: block(s, at(first, s), at(until, s))), lambda x: x["k"] < x["end"])
    slots = F.aggregate(state, F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["k"])

    def step(acc: Column, t: Column) -> Column:
        # a block that isn't released yet comes after all that are
        best = F.array_min(F.transform(acc["state"], lambda x: F.struct(F.greatest(x["r"] - t, F.lit(0).cast("long")).alias("wait"), x["due"].alias("due"), x["i"].alias("i"), x["k"].alias("k"))))
        moved = lambda i: F.filter(F.transform(acc["state"], lambda x: F.when(x["i"] == i, block(x, x["k"] + 1, x["end"])).otherwise(x)), lambda x: x["k"] < x["end"])
        return _once(best, lambda one: F.struct(moved(one["i"]).alias("state"), F.concat(acc["picks"], F.array(F.struct(one["i"].alias("i"), one["k"].alias("k")))).alias("picks")))

    zero = F.struct(state.alias("state"), F.array().cast("array<struct<i:bigint,k:bigint>>").alias("picks"))
    return F.aggregate(F.sequence(start, start + slots - 1), zero, step, lambda acc: acc["picks"])


def schedule(plan: DataFrame) -> DataFrame:
    """(i, k, slot): the slot of block k of source i, one row a block."""
    borders = F.ceil(F.col("total") / F.col("span")).cast("long")
    lots = plan.select("*", borders.alias("borders")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("borders"), F.lit(1000).cast("long"))).alias("lot")).repartition("lot")
    each = lots.select("all", "turns", "total", "span", F.explode(F.sequence(F.col("lot"), F.least(F.col("borders"), F.col("lot") + 999))).alias("g")).repartition("g")
    border = F.least(F.col("total"), F.col("g") * F.col("span"))
    each = each.select("all", "g", border.alias("start"), _before_border(F.col("all"), F.col("turns"), border, F.col("span")).alias("done"))
    # a border ends one stretch and begins the next
    nothing = F.lit(None).cast("array<long>")
    sides = each.select("all", F.explode(F.array(
        F.struct(F.col("g").alias("g"), F.col("start").alias("start"), F.col("done").alias("first"), nothing.alias("until")),
        F.struct((F.col("g") - 1).alias("g"), F.lit(None).cast("long").alias("start"), nothing.alias("first"), F.col("done").alias("until")),
    )).alias("side")).select("all", "side.*")
    stretches = sides.groupBy("g").agg(F.max("all").alias("all"), F.max("start").alias("start"), F.max("first").alias("first"), F.max("until").alias("until"))
    stretches = stretches.where("first is not null and until is not null")
    laid = stretches.select("start", F.posexplode(_earliest_deadline_first(F.col("all"), F.col("start"), F.col("first"), F.col("until"))).alias("at", "block"))
    return laid.select("block.i", "block.k", (F.col("start") + F.col("at")).alias("slot"))


def mix_sources(
    df: DataFrame,
    source: str = "source",
    order_by: tuple[str, ...] = ("doc_id",),
    weights: dict[str, float] | None = None,
    block_rows: int = 16,
    stretch: int = 500,
    power: float = 0.5,
    names: tuple[str, str, str] = ("mix_block", "mix_slot", "mix_pos"),
) -> DataFrame:
    """Return df with its block within its source, the block's slot in the mixed order and the row's position.

    While every source has blocks, in the first n slots a source has n times its weight, give or take less than one
    block; once a source has run out the others go on in their proportions. Sources missing from weights, or with a
    weight that isn't positive, get the smallest weight. A null source is a source of its own. Within a source, rows lie
    in the order of a hash of order_by, ties in any order. Every row is kept; mix_pos is unique, with gaps only where a
    source's last block isn't full. An empty table gives an empty result. Columns of df that have one of the names, in
    any case, are replaced. stretch is the least number of slots that are scheduled as one; a source of the share p
    raises it to 1 / p. The sources are held in one array of a row: meant for some hundreds of sources.
    """
    s, u, bucket, i, nb, inside, before_it, rank_in, block, slots = (free_name(df, f"__{x}", *names) for x in ("source", "hash", "bucket", "i", "nb", "in", "before", "rank", "block", "slots"))
    keep, by = kept_columns(df, names), [quoted(x) for x in order_by]
    rows = df.withColumns({s: F.coalesce(F.concat(F.lit("s"), quoted(source).cast("string")), F.lit("null")), u: F.xxhash64(*by, F.lit(3))})
    counts = rows.groupBy(F.col(s).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    plan = source_plan(counts, weights, block_rows, stretch, power)
    few = counts.count() <= BROADCAST_SOURCES
    sized = (lambda x: F.broadcast(x)) if few else (lambda x: x)

    # the rank of a row in its source: buckets of some hundred rows (4096 buckets at most), their sums, and the rank in the bucket
    each = plan.select(F.inline("all")).select(F.col("s").alias(s), F.col("i").alias(i), F.least(F.lit(4096), F.ceil(F.col("n") / 512)).cast("long").alias(nb))
    rows = rows.join(sized(each), s).withColumn(bucket, F.pmod(F.col(u), F.col(nb)))
    sums = rows.groupBy(s, i, bucket).agg(F.count(F.lit(1)).alias(inside))
    before = Window.partitionBy(s).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(before_it, F.coalesce(F.sum(inside).over(before), F.lit(0).cast("long")))

    # the slots of a bucket's blocks meet the bucket's sums, so that the rows themselves need no join by block
    first, last = F.floor(F.col(before_it) / block_rows), F.floor((F.col(before_it) + F.col(inside) - 1) / block_rows)
    spread = sums.select(s, F.col(i).alias("i"), bucket, before_it, F.explode(F.sequence(first, last)).alias("k"))
    spread = spread.join(schedule(plan), ["i", "k"]).groupBy(s, bucket).agg(F.first(before_it).alias(before_it), F.map_from_entries(F.collect_list(F.struct("k", "slot"))).alias(slots))
    rank = F.row_number().over(Window.partitionBy(s, bucket).orderBy(u, *by))
    rows = rows.withColumn(rank_in, rank).join(spread, [s, bucket]).withColumn(rank_in, F.col(before_it) + F.col(rank_in) - 1)
    rows = rows.withColumn(block, F.floor(F.col(rank_in) / block_rows))
    slot = F.element_at(slots, F.col(block))
    return rows.select(*keep, F.col(block).alias(names[0]), slot.alias(names[1]), (slot * block_rows + F.pmod(F.col(rank_in), F.lit(block_rows))).alias(names[2]))
