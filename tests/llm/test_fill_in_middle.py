import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from labelweave.llm.fill_in_middle import GRAMMARS, Neighbours, Runs, check_marks, fill_in_middle, pieces, restored
from labelweave.llm.queries import op12_fill_in_middle
from tests.llm.data import HELPERS, empty, frame

MARKS = ("<P>", "<S>", "<M>")
TEXTS = ["", " ", "a", "ab", "The cat sat. It slept!  Then\n\nnothing.\n", "x1 22 été año 中文。好 \U0001f600\U0001f600áb", "\n\n\na b", "a <S> b", "tail <", "\t x", "tab\tand\r\nline\r\nends", "P>a<P", "<M"]


def units_by_hand(text, name):
    """The units of each grammar, written as what a unit is instead of where one ends."""
    if name == "code_points":
        return list(text)
    if name == "lines":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    if name == "words":
        return re.findall(r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+", text)
    if name == "sentences":
        return re.findall(r"(?:(?![.!?。][ \t\n\x0b\f\r]).)*(?:[.!?。](?=[ \t\n\x0b\f\r])|$)|.+", text, re.S)
    import regex

    return regex.findall(r"[\p{L}\p{M}]+|\p{N}+|[ \t\n\x0b\f\r]+|(?s:.)", text)


@pytest.mark.parametrize("name", list(GRAMMARS))
def test_units_are_those_of_the_grammar(spark, name):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab1. \n\U0001f600é!") for _ in range(rng.randrange(60))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for t, got in df.select("text", pieces(F.col("text"), GRAMMARS[name])).collect():
        assert "".join(got) == t and all(got) or not t
        assert got == [x for x in units_by_hand(t, name) if x], (name, t)


def by_hand(doc_id, text, name="code_points"):
    text = text or ""
    units = [x for x in units_by_hand(text, name) if x]
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < 20 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_query_is_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in op12_fill_in_middle(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    forms = set()
    for doc_id, text in docs:
        n, form, p, m, out = by_hand(doc_id, text)
        r = got[doc_id]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, p, m)
        assert r["output_sha256"] == hashlib.sha256(out.encode()).hexdigest() and r["restored_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


@pytest.mark.parametrize("name", list(GRAMMARS))
def test_texts_come_back_whatever_is_in_them(spark, name):
    rows = [(k, t) for k in range(40) for t in [*TEXTS, None]]
    made = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), name)
    forms = set()
    for r in made.withColumn("back", restored(F.col("fim_text"), F.col("form"), MARKS)).collect():
        assert r["back"] == (r["text"] or "")
        if r["form"] != "plain":
            assert r["prefix"] + r["middle"] + r["suffix"] == r["text"]
        assert r["fim_text"] == by_hand(r["doc_id"], r["text"], name)[4]
        forms.add(r["form"])
    assert forms == {"plain", "psm", "spm"}


def test_odd_tables(spark):
    df = frame(spark).withColumn("form", F.lit("mine")).withColumn("__units", F.lit(1)).withColumn("__plain", F.lit(1))
    got = fill_in_middle(df, "words")
    assert {"a.b", "__units", "__plain"} <= set(got.columns) and got.count() == df.count()
    assert set(HELPERS) <= set(got.columns)
    for r in got.collect():
        assert (r["n_units"], r["form"], r["fim_text"]) == tuple(by_hand(r["doc_id"], r["text"], "words")[k] for k in (0, 1, 4))
        assert r["__units"] == 1
    assert fill_in_middle(empty(spark)).count() == 0


def test_marks_that_overlap_are_refused():
    for bad in (("<a", "a<", "<M>"), ("<P>", "<P>x", "<M>"), ("aa", "<S>", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            check_marks(bad)
    check_marks(MARKS)


def test_boundaries_look_both_ways():
    assert Runs(("a-z",)).boundary() == "(?<=(?s:.))(?!(?<=[a-z])[a-z])(?=(?s:.))"
    assert Neighbours("\\n", None).boundary() == "(?<=[\\n])(?=(?s:.))"
