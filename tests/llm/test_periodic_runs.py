import hashlib
import random
import re
import zlib

import pytest

from labelweave.llm.periodic_runs import periodic_runs, runs_of
from labelweave.llm.queries import op11_periodic_runs
from tests.llm.data import empty, frame


def brute(words, exponent=4, least=6):
    """Every period by itself: stretches in which words that far apart are equal."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            m = j + q - i
            if j > i and m >= max(least, exponent * q) and not any(all(words[i + x] == words[i + x + r] for x in range(m - r)) for r in range(1, q)):
                out.append((i, m, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("exponent", [2, 3, 4, 5])
def test_runs_are_those_of_every_period(exponent):
    rng = random.Random(exponent)
    for _ in range(600):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            w = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(70))]
            if w and rng.random() < 0.5:
                a = rng.randrange(len(w))
                p = 1 + (len(w) - a) // rng.randrange(2, 11)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            texts.append(w)
        assert runs_of(texts, exponent) == [brute(w, exponent) for w in texts]


def test_long_runs_of_any_period():
    rng = random.Random(8)
    for q in (1, 2, 3, 7, 400, 2500):
        head, root = [("h", k) for k in range(50)], list(range(q))
        rng.shuffle(root)
        text = head + [root[i % q] for i in range(4 * q + 5)] + [("t", k) for k in range(9)]
        assert runs_of([[0], text, []]) == [[], [(50, 4 * q + 5, q)], []]
    word = ["a", "ab"]
    while len(word[-1]) < 5000:
        word.append(word[-1] + word[-2])
    text = list(word[-1][:600])  # runs within runs
    assert runs_of([text], 2, 2) == [brute(text, 2, 2)] and len(brute(text, 2, 2)) > 100


def by_hand(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    first = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (len(runs), *first, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_is_brute_force(spark, sf):
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r["doc_id"]: tuple(r[x] for x in names) for r in op11_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 6000 or text is null").collect()
    for doc_id, text in docs:
        assert got[doc_id] == by_hand(doc_id, text), doc_id
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and sum(r[0] for r in got.values()) > 5


def test_contract_on_odd_texts(spark, tmp_path):
    texts = [None, "", " \t\r\n", "a", "x " * 6, "x " * 5, "a b\x0ba\x0cb a b\na b c", "no break no break " * 3, "z\x1fz z\x1fz z\x1fz z\x1fz z\x1fz z\x1fz", "é   é é é é é é é", "a b c d " * 4 + "a b c", "one two three " * 40]
    rows = [(k, texts[k % len(texts)]) for k in range(400)] + [(None, "q " * 9), (7, "repeated " * 8), (7, "repeated " * 8)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    got = sorted((tuple(r[x] for x in ["doc_id", *names]) for r in op11_periodic_runs(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted(((d, *by_hand(d, t)) for d, t in rows), key=key)


def test_odd_tables(spark):
    got = periodic_runs(frame(spark))
    assert got.count() == frame(spark).count() and "a.b" in got.columns
    for r in got.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        assert r["n_words"] == len(words) and [tuple(x) for x in r["runs"]] == brute(words[:400]) if len(words) < 400 else True
    assert periodic_runs(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(empty(spark), exponent=1)
