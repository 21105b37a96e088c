import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from labelweave.llm import queries as Q
from labelweave.llm.decontamination import decontaminate, smith_waterman, words_of
from labelweave.llm.language_id import identify
from tests.llm.data import empty, frame


def test_languages_of_held_out_documents(spark, sf):
    """The model is fitted without a third of the documents, whose language it then tells without being told."""
    docs = Q.documents(spark, sf).select("doc_id", "text", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("said"), "lang", "source")
    got = identify(docs, label=F.col("said"), host=F.col("source")).where("doc_id % 3 = 0").collect()
    assert np.mean([r["lang"] == r["lang_id"] for r in got]) > 0.97


def test_evidence_and_odd_rows(spark):
    df = frame(spark)
    got = identify(df, declared=F.col("lang"), host=F.col("source"))
    assert got.count() == df.count()
    assert got.where("text is null or text = ''").where("lang_ok").count() == 0
    assert identify(empty(spark), declared=F.col("lang"), host=F.col("source")).count() == 0
    pages = Q.llm_page_language(spark, "/root/testdata/sf0.001").collect()
    assert pages and all(0 <= r["lang_p"] <= 1.0001 for r in pages)


def test_declared_language_decides_where_the_text_says_nothing(spark, sf):
    docs = Q.documents(spark, sf).select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame([(10**6 + i, "12 34", x, "nowhere") for i, x in enumerate(("de", "fr"))], "doc_id long, text string, lang string, source string"))
    got = {r["doc_id"]: r for r in identify(docs, declared=F.col("lang"), host=F.col("source")).where("doc_id >= 1000000").collect()}
    assert [got[10**6 + i]["lang_id"] for i in (0, 1)] == ["de", "fr"] and not got[10**6]["lang_ok"]


def _slow_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(1, 6, rng.integers(1, 15)).astype(np.uint64), rng.integers(1, 6, rng.integers(1, 30)).astype(np.uint64)
        assert smith_waterman(a, b) == _slow_alignment(a, b)


def test_contamination_is_brute_force(spark, sf):
    docs, bench = Q.documents(spark, sf).limit(400), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r["item_id"], words_of(r["text"])) for r in bench.collect()]
    edited = " ".join(w if k % 9 else "changed" for k, w in enumerate(items[0][1]))
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, "before it " + edited + " after it"), (10**6 + 1, None), (10**6 + 2, ""), (10**6 + 2, "")], "doc_id long, text string"))
    rows = decontaminate(docs, bench).collect()
    assert len(rows) == docs.count()
    number = {}
    code = lambda ws: np.array([number.setdefault(w, len(number) + 1) for w in ws], np.uint64)
    for r in rows:
        b = code(words_of(r["text"]))
        best = max((smith_waterman(code(w), b) / len(w) for _, w in items), default=0) if len(b) else 0
        assert r["contaminated"] == (best >= 0.5)
    assert next(r for r in rows if r["doc_id"] == 10**6)["item_id"] == items[0][0]


def test_benchmark_in_blocks_and_odd_tables(spark):
    df, bench = frame(spark), spark.createDataFrame([(1, "alpha beta gamma delta river stone"), (None, "x"), (2, None), (3, ""), (4, "never seen words stand here now")], "item_id long, text string")
    one = decontaminate(df, bench).select("doc_id", "contaminated", "score").collect()
    many = decontaminate(df, bench, block_chars=10).select("doc_id", "contaminated", "score").collect()
    assert sorted(map(str, one)) == sorted(map(str, many)) and len(one) == df.count()
    assert decontaminate(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate(empty(spark), bench).count() == 0


def test_pipeline(spark, sf):
    names = Q.documents(spark, sf).columns
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == [*names, "size", "shard", "slot"] and got.count() > 100
    docs = frame(spark).select(*names)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < 4:
            assert docs.columns == names
    nothing = empty(spark).select(*names)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, sf).select(*names)
    assert nothing.count() == 0
