import hashlib
import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from labelweave.llm import bag_minhash as B
from labelweave.llm.components import components
from labelweave.llm.line_dedup import Jaccard, dedup_lines
from labelweave.llm.suffix_dedup import dedup_substrings
from labelweave.llm.vector_search import top_k
from tests.llm.data import empty, frame


def test_top_k_is_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(300)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(80)] + [rows[5], (None, rows[0][1], 0), (50, None, 0), (2000, [1.0, None], 0), (2001, [float("nan")] * 8, 0), (2002, [0.5] * 3, 0), (2050, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k(df, F.col("vec_id") % 50 == 0, n_pivots=7, ring_rows=16, first_rings=2).collect()}
    q = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q[i] = np.floor(np.array([*v, *[0.0] * (8 - len(v))], np.float32).astype(float) * 256).astype(int)
    want = {}
    for i in q:
        if i % 50 == 0:
            best = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:5]
            want |= {(i, k + 1): (j, -s) for k, (s, j) in enumerate(best)}
    assert got == want
    assert top_k(df.limit(0), F.lit(True)).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    a = (np.arange(1, 40, dtype=np.uint64), rng.integers(1, 9, 39))
    b = (np.arange(5, 44, dtype=np.uint64), rng.integers(1, 9, 39))
    s = B.signatures([a, b, (np.zeros(0, np.uint64), np.zeros(0, int))], 4096)
    assert abs((s[0] == s[1]).mean() - B.weighted_jaccard(a, b)) < 0.03 and (s[2] == B.NEVER).all()
    assert (B.signatures([b], 4096)[0] == s[1]).all()  # whatever company it is in


def _union(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(60)] + [(5, 5)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    want = _union(400, links)
    assert got == {i: want[i] for a, b in links if a != b for i in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_are_brute_force_classes(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = [" ".join(base)]
    for _ in range(60):  # a group of near copies, some near only to one another
        t = list(base)
        for _ in range(rng.randrange(1, 6)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) for _ in range(30)] + ["", None, "...", "...", "one two", "One, two!"]
    texts += texts[:3]
    df = spark.createDataFrame([(i if i % 17 else None, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, class_id int, keep int")
    got = B.near_duplicates(df).collect()
    assert len(got) == len(texts)
    bags = [B.bag(t) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (texts[i] or "") == (texts[j] or "") or B.weighted_jaccard(bags[i], bags[j]) >= 0.8]
    root = _union(len(texts), links)
    classes = {}
    for i, r in enumerate(root):
        classes.setdefault(r, []).append(i)
    by_text = {}
    for g in got:
        by_text.setdefault((g["doc_id"], g["text"]), []).append(g)
    for members in classes.values():
        ids = [df_id for i in members if (df_id := i if i % 17 else None) is not None]
        least = min(ids) if ids else None
        rows = [g for i in set((i if i % 17 else None, texts[i]) for i in members) for g in by_text[i]]
        assert {g["class_id"] for g in rows} == {least} and sum(g["keep"] for g in rows) == 1 and {g["class_size"] for g in rows} == {len(members)}
    assert B.near_duplicates(empty(spark)).count() == 0


def test_lines_are_brute_force(spark):
    rng = random.Random(4)
    words = ["river", "stone", "light", "winter", "garden", "silver", "morning", "the", "of"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 25))) for _ in range(40)]
    lines += [x[: len(x) // 2] + "Q" + x[len(x) // 2 :] for x in lines] + ["", "  ", "a", "A"]
    docs = [(i if i % 7 else None, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12))) if i % 5 else rng.choice([None, ""])) for i in range(50)]
    df = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, n_lines int")
    got = {(r["doc_id"], r["text"]): (r["n_lines"], r["dropped_lines"], r["kept_text"]) for r in dedup_lines(df).collect()}
    places = [(d, t, k, x.strip(" ").lower()) for d, t in dict.fromkeys(docs) if t is not None for k, x in enumerate(t.split("\n"))]
    names = sorted({p[3] for p in places} - {""})
    sim = Jaccard(5)
    root = _union(len(names), [(i, j) for i, j in itertools.combinations(range(len(names)), 2) if sim([names[i]], [names[j]])[0] >= 0.8])
    group = {x: root[i] for i, x in enumerate(names)}
    first = {}
    for d, t, k, x in places:
        if x:
            first.setdefault(group[x], []).append((d is None, d or 0, d, t, k))
    # documents without an id tie by a hash: any of them may keep the line, all others drop it
    for d, t in set(docs):
        n, dropped, kept = got[(d, t)]
        assert n == (len(t.split("\n")) if t is not None else 0)
        if t is not None:
            assert kept == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in dropped)
            if d is not None:
                want = [k for dd, tt, k, x in places if (dd, tt) == (d, t) and x and min(p[:2] + (p[4],) for p in first[group[x]] if not p[0]) != (False, d, k)]
                assert dropped == want
    assert dedup_lines(empty(spark)).count() == 0


def _brute(rows, n=50):
    first = {}
    for d, t in rows:
        for i in range(len(t) - n + 1):
            first[t[i : i + n]] = min(first.get(t[i : i + n], 1 << 62), d)
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if first[t[i : i + n]] < d:
                gone[i : i + n] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        yield (d, len(t), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest())


def test_substrings_are_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("ab") for _ in range(60)) for _ in range(6)] + ["a" * 300, "ab" * 150, "", "é" * 80]
    rows = [(i % 37 if i % 11 else None, None if i % 29 == 0 else "".join(rng.choice(base)[rng.randrange(20) :][: rng.randrange(30, 300)] for _ in range(rng.randrange(4)))) for i in range(120)]
    got = [tuple(r) for r in dedup_substrings(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, k string")).collect()]
    want = [(None if w[0] == 1 << 61 else w[0], *w[1:]) for w in _brute([((1 << 61) if d is None else d, (t or "").encode()) for d, t in rows])]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert dedup_substrings(empty(spark)).count() == 0


def test_odd_rows_pass(spark):
    df = frame(spark)
    assert dedup_lines(df).count() == df.count() == B.near_duplicates(df).count() == dedup_substrings(df).count()
