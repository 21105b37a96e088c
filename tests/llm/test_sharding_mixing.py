import zlib
from collections import Counter
from fractions import Fraction
from math import ceil, floor

from pyspark.sql import functions as F

from labelweave.llm import queries as Q
from labelweave.llm.mixing import mix_sources
from labelweave.llm.sharding import content_key, shard_records, text_size
from tests.llm.data import empty, frame


def _sharded(df, n=4):
    return shard_records(df, n, text_size(), (content_key(), F.col("doc_id")))


def test_shards_are_gapless_equal_and_whole(spark):
    df = frame(spark, 400)
    got = _sharded(df).collect()
    assert len(got) == df.count()
    total = sum(r["size"] for r in got)
    most = max(r["size"] for r in got)
    for s in range(4):
        own = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 4) <= most
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in got)
    assert {"__range", "Class_Id"} <= set(got[0].asDict())


def test_shards_of_one_hot_key_are_subdivided(spark):
    df = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = Counter(r["shard"] for r in _sharded(df).collect())
    assert max(got.values()) - min(got.values()) <= 1 and sum(got.values()) == 3000


def test_sharding_an_empty_table(spark):
    assert _sharded(empty(spark)).count() == 0


def test_shard_query_matches_the_contract(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in Q.documents(spark, sf).collect()}
    for r in Q.op2_sampled_splitters(spark, sf).collect():
        assert r["text_crc32"] == zlib.crc32((docs[r["doc_id"]] or "").encode()) and r["law"] == "bytes" and r["grown_shard"] is None


def windows(blocks: dict[str, int], weights: dict[str, Fraction]) -> dict[tuple[str, int], tuple[int, int]]:
    """Release and deadline of every block, in exact fractions."""
    slot = lambda x: sum(min(weights[s] * x, blocks[s]) for s in blocks)
    return {(s, k): (floor(slot(k / weights[s])), ceil(slot((k + 1) / weights[s]))) for s, n in blocks.items() for k in range(n)}


def earliest_deadline_first(blocks: dict[str, int], weights: dict[str, Fraction]) -> list[str]:
    """Brute force, a slot at a time, over all slots as one stretch."""
    window, k, out = windows(blocks, weights), dict.fromkeys(sorted(blocks), 0), []
    for t in range(sum(blocks.values())):
        s = min((s for s in k if k[s] < blocks[s] and window[s, k[s]][0] <= t), key=lambda s: (window[s, k[s]][1], s))
        k[s] += 1
        out.append(s)
    return out


def _mixed(spark, counts, weights, stretch):
    df = spark.createDataFrame([(i, s) for s, n in counts.items() for i in range(n)], "doc_id long, source string")
    got = mix_sources(df, weights={s: float(w) for s, w in weights.items()}, block_rows=1, stretch=stretch).orderBy("mix_pos").collect()
    assert [r["mix_slot"] for r in got] == list(range(sum(counts.values())))
    return got


def test_mixture_is_the_brute_force_schedule(spark):
    counts, weights = {"a": 97, "b": 31, "c": 12}, {"a": Fraction(1, 2), "b": Fraction(3, 10), "c": Fraction(1, 5)}
    assert [r["source"] for r in _mixed(spark, counts, weights, 10**6)] == earliest_deadline_first(counts, weights)


def test_every_block_lies_in_its_window_over_many_stretches(spark):
    """Weights that no short cycle holds: no source is ever a whole block from its share, also once others have run out."""
    cases = (
        ({"a": 900, "b": 311, "c": 120, "d": 95, "e": 77}, {"a": Fraction(1000, 1), "b": Fraction(577, 1), "c": Fraction(311, 1), "d": Fraction(97, 1), "e": Fraction(89, 1)}),
        ({c: 60 + 7 * i for i, c in enumerate("abcdefghijklm")} | {"z": 700}, {c: Fraction(100 + i, 3) for i, c in enumerate("abcdefghijklm")} | {"z": Fraction(700, 3)}),
        ({"a": 400, "b": 400, "c": 400}, {"a": Fraction(1), "b": Fraction(1), "c": Fraction(1)}),
    )
    for counts, weights in cases:
        window = windows(counts, weights)
        total, seen = sum(weights.values()), Counter()
        fewest = min(n / weights[s] for s, n in counts.items()) * total  # until then every source has blocks
        for t, r in enumerate(_mixed(spark, counts, weights, 20)):
            release, due = window[r["source"], r["mix_block"]]
            assert release <= t < due
            seen[r["source"]] += 1
            if t + 1 <= fewest:
                assert all(abs(seen[s] - (t + 1) * w / total) < 1 for s, w in weights.items())


def test_mixture_keeps_all_rows_and_odd_sources(spark):
    df = frame(spark, 200)
    got = mix_sources(df, block_rows=4).collect()
    key = lambda r: (str(r["doc_id"]), str(r["text"]), str(r["source"]))
    assert sorted(map(key, got)) == sorted(map(key, df.collect()))
    assert len({r["mix_pos"] for r in got}) == len(got)
    assert mix_sources(empty(spark)).count() == 0


def test_shards_may_part_equal_texts_at_a_border(spark):
    """Groups of equal texts lie side by side in the order, but a border falls where the sizes say."""
    df = spark.range(64).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    got = _sharded(df).collect()
    assert {r["shard"] for r in got} == {0, 1, 2, 3} and len({r["size"] for r in got}) == 1
