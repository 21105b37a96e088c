import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.llm import ngram_join
from labelweave.llm.ngram_join import bitmap, bound, common_asked, first_ones, linked, ngram_components, unpacked
from labelweave.llm.queries import op13_ngram_jaccard
from tests.llm.data import empty, frame


def shingles(text):
    w = [bytes(x).decode() for x in (text or "").encode().lower().split()]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent=80):
    """{row: (n, component)} by every pair."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in groups.items()}
    return [(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def key(r):
    return tuple(-1 if x is None else x for x in r)


def edited(rng, words, share):
    return [rng.choice("uvw") + str(rng.randrange(99)) if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def corpus():
    """Families of texts around the threshold, chains, passages that many share, short and empty texts."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = [None, "", " \t ", "one", "ONE", "one two", "É a b c d", "é a b c d", "a b c d e", "a b c d e f"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 12, 40, 200]))]
        texts += [" ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.05, 0.1]))) for _ in range(8)]
        chain = base
        for _ in range(4):
            chain = edited(rng, chain, 0.02)
            texts.append(" ".join(chain))
        own = [rng.choice(words) for _ in range(rng.choice([10, 60, 300]))]
        texts.append(" ".join(own[:5] + passage + own[5:]))
        texts.append(" ".join(base[: int(len(base) * rng.uniform(0.7, 1))]))
    rows = [(3 * k + 1, t) for k, t in enumerate(texts)]
    rows += [(None, texts[20]), (None, "alone with no key"), (2, texts[21]), (2, texts[21]), rows[30]]
    rng.shuffle(rows)
    return rows


def test_every_pair(spark, corpus):
    got = ngram_components(spark.createDataFrame(corpus, "doc_id long, text string"))
    want = sorted(brute(corpus), key=key)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=key) == want
    assert 20 < len({r[2] for r in want}) < len(corpus) - 40


def test_blocks_find_what_rounds_leave(spark, corpus, monkeypatch):
    """Without rounds and with blocks of three rows all comes from the blocks."""
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 4)
    got = ngram_components(spark.createDataFrame(corpus, "doc_id long, text string"), percent=70)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=key) == sorted(brute(corpus, 70), key=key)


def test_query_is_every_pair(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op13_ngram_jaccard(spark, sf)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=key) == sorted(brute(rows), key=key)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n, m = rng.integers(1, 900, 2)
        pool = rng.integers(0, 1 << 63, 1200, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, k, False)) for k in (n, m))
        x, y = (v[0] for v in (unpacked([bitmap(a)], 8), unpacked([bitmap(b)], 8)))
        width = min(len(bitmap(a)), len(bitmap(b)))
        for w in (8, width):
            x, y = unpacked([bitmap(a)], w)[0], unpacked([bitmap(b)], w)[0]
            own, other, both = (int(np.bitwise_count(v).sum()) for v in (x, y, x & y))
            assert bound(np.int64(len(a)), own, np.int64(len(b)), other, both) >= len(np.intersect1d(a, b))


def test_linked_sets_share_as_many_first_ones_as_are_asked_for():
    rng = np.random.default_rng(3)
    for _ in range(500):
        n = int(rng.integers(1, 120))
        both = rng.integers(0, 1 << 62, n, dtype=np.uint64)
        a, b = (np.unique(np.append(both, rng.integers(0, 1 << 62, int(rng.integers(0, n // 6 + 2)), dtype=np.uint64))) for _ in range(2))
        common = len(np.intersect1d(a, b))
        if linked(common, len(a), len(b), 80):
            first = [x[: int(first_ones(len(x), 80))] for x in (a, b)]
            for x in (a, b):
                least = int(common_asked(common_asked(len(x), 80)[1], 80)[0])
                assert len(np.intersect1d(*first)) >= least


def test_odd_tables(spark):
    df = frame(spark).withColumn("Component_ID", F.lit("mine"))
    got = ngram_components(df)
    assert got.columns == [c for c in df.columns if c not in ("text", "Component_ID")] + ["n_shingles", "component_id"]
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=key) == sorted(brute(rows), key=key)
    assert ngram_components(empty(spark)).count() == 0
    assert ngram_components(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).select("n_shingles", "component_id").collect() == [(0, 1), (0, 2)]
