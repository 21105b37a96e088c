"""What mustn't grow: groups cut by shard borders, pre-tokens on the driver, buckets of a table."""

import random
from collections import defaultdict

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from labelweave.llm import token_counts as C
from labelweave.llm.sharding import content_key, shard_records, text_size
from labelweave.llm.suffix_dedup import dedup_substrings
from tests.llm.test_search_dedup import _brute

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_groups_smaller_than_a_shard_stay_whole(spark):
    rng = random.Random(3)
    texts = [f"text {k} " * rng.randrange(1, 30) for k in range(150)]
    rows = [(k, rng.choice(texts)) for k in range(900)] + [(1000 + k, "very common") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shard_records(df, 8, text_size(), (content_key(), F.col("doc_id")), whole=True, range_rows=50).collect()
    assert len(got) == len(rows)
    whole = sum(r["size"] for r in got)
    groups, sizes, slots = defaultdict(list), defaultdict(int), defaultdict(list)
    for r in got:
        groups[r["text"]].append(r)
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(len({r["shard"] for r in g}) == 1 for g in groups.values() if 8 * sum(r["size"] for r in g) < whole)
    largest = max((sum(r["size"] for r in g) for g in groups.values() if 8 * sum(r["size"] for r in g) < whole))
    assert all(abs(n - whole / 8) <= largest + 300 for n in sizes.values()) and set(sizes) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # a group of a shard or more is cut where the sizes say
    big = [(k, "same") for k in range(64)]
    cut = shard_records(spark.createDataFrame(big, df.schema), 4, text_size(), (content_key(), F.col("doc_id")), whole=True)
    assert {r["shard"] for r in cut.collect()} == {0, 1, 2, 3}


def test_long_pre_tokens_stay_off_the_driver(spark, monkeypatch):
    """Forty texts of 200,000 characters without a space: no more than the stated bytes are fetched, and the counts are right."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(1000)) * 200 for _ in range(40)] + ["plain words and words again " * 50, "日本語の文章です" * 400, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fetched = []
    real = C.frequent
    monkeypatch.setattr(C, "frequent", lambda *a: fetched.append(real(*a)) or fetched[-1])
    got = {r["doc_id"]: r["n_tokens"] for r in C.token_counts(df, PIECES).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert got == {i: len(model.encode(t or "")) for i, t in enumerate(texts)}
    assert sum(len(k.encode()) for k in fetched[0][1]) < 1000 and all(len(k.encode()) <= C.LONGEST for k in fetched[0][1])
    # a bound of bytes that only some of the words fit into
    pieces = C.piece_table(df, "text", PIECES)
    words = [f"w{k:05d}" for k in range(3000)]
    pieces = C.piece_table(spark.createDataFrame([(" ".join(w for k, w in enumerate(words) for _ in range(1 + 3000 // (k + 1))),)], "text string"), "text", PIECES)
    is_common, common = real(pieces, 1 << 18, 5000)
    assert 0 < sum(len(k.encode()) for k in common) <= 5000 and pieces.where(is_common).count() == len(common)
    assert min(pieces.where(is_common).select("n").toPandas()["n"]) >= max(pieces.where(~is_common).select("n").toPandas()["n"])


def test_more_bundles_than_buckets(spark):
    """As many bytes as would take some hundred buckets, in three."""
    rng = random.Random(9)
    base = ["".join(rng.choice("abc ") for _ in range(90)) for _ in range(8)]
    rows = [(i, "".join(rng.choice(base)[rng.randrange(30) :] for _ in range(rng.randrange(5)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = {t.name for t in spark.catalog.listTables()}
    got = dedup_substrings(df, bucket_bytes=64, most_buckets=3)
    assert sorted(map(tuple, got.collect())) == sorted(_brute([(d, t.encode()) for d, t in rows]))
    assert {t.name for t in spark.catalog.listTables()} == before
