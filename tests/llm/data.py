"""Small tables with everything that goes wrong: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

#: Columns that have an operator's helper name, the name of a result in another case, or a dot.
HELPERS = ["a.b", *(f"__{x}" for x in "range k1 size end rank b n p k at d t t1 gone top post best found uid digest root order o source hash bucket hp evidence host".split())]
RESULTS = ["Shard", "Slot", "Size", "Class_Id", "Keep", "Mix_Slot", "Mix_Pos", "Score", "N_Items", "Lang_Id", "N_Lines", "N_Tokens", "N_Bytes"]
EXTRA = HELPERS + RESULTS
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{x}` string" for x in EXTRA)


def rows(n: int = 60, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "river", "stone", "Zürich", "año", "maison", "Straße"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 80))) + rng.choice(["", ".", "\nA second line of it.", "\n\n", " \t "]) for _ in range(n // 2)]
    out = []
    for i in range(n):
        t = rng.choice(texts)
        if i % 9 == 0:
            t = None
        elif i % 11 == 0:
            t = ""
        elif i % 5 == 0:
            t = t.replace("river", "lake", 1)
        elif i == 7:
            t = " ".join(rng.choice(words) + str(k) for k in range(6000))
        out.append((None if i % 13 == 0 else i, t, rng.choice(["en", "de", None]), "hot" if i % 3 else rng.choice(["a", None]), 1, *[f"{x} {i}" for x in EXTRA]))
    return out + out[5:8]


def frame(spark, n: int = 60, seed: int = 1):
    return spark.createDataFrame(rows(n, seed), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
