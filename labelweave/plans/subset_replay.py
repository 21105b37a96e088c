"""Subset votes drawn by an item's parents: the online replay by source, and its parts as aggregates over whole tables with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelweave.functions.hashing import joined, unit_draw
from labelweave.operators.sequential import RiskSequence
from labelweave.operators.subset_head import SubsetHead, SubsetSettings
from labelweave.operators.transition_memory import TransitionMemory
from labelweave.plans.folds import CRITICAL, TOLERANCES
from labelweave.plans.relational import _ORDER, ITEMS, RESPONSES, u
from labelweave.plans.replay import fold
from labelweave.sources import tables as t
from labelweave.sources.tables import LABELS

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Share of items that are audited at once; confidence that a subset must have; models' observations that a prior accuracy counts for.
AUDITED, NEED, PRIOR_N = 0.5, 0.9, 4.0
#: Observations from which a transition is used, deviations below its mean, and how much rewards of parents weigh.
LEAST, Z, UNAUDITED = 6.0, 1.28, 0.25


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def subset_items(spark: SparkSession, d: str) -> DataFrame:
    """A row for each labelled document: votes and costs of all models, whether it is audited, and the documents before it of its language and of its size."""
    r = t.responses(t.items(spark, d), t.models(spark))
    wide = [F.max(F.when(F.col("model_id") == m, F.col(c))).alias(f"{c}_{m}") for m in _ORDER for c in ("vote", "cost", "confidence")]
    rows = r.groupBy("doc_id").agg(*[F.first(c).alias(c) for c in ("source", "lang", "n_chars", "gold")], *wide)
    rows = rows.withColumns({"stream": F.coalesce("source", F.lit("")), "node": F.col("doc_id").cast("string"), "size": F.floor(F.log2("n_chars"))})
    before = lambda *by: F.lag("node").over(Window.partitionBy("stream", *by).orderBy("doc_id"))
    audit = unit_draw(joined("audit", F.col("node"), sep="|")) < AUDITED
    arrays = [F.array(*[F.col(f"{c}_{m}") for m in _ORDER]).alias(f"{c}s") for c in ("vote", "cost", "confidence")]
    return rows.select("stream", "doc_id", "node", "gold", audit.alias("audited"), before("lang").alias("by_lang"), before("size").alias("by_size"), *arrays)


def step(head: SubsetHead, trust: dict, row, need: float) -> tuple:
    """One item: bounds drawn by its parents, the cheapest subset that is sure enough, its vote, and what that and the audit teach."""
    edges: dict = {}
    for name, weight in (("lang", 1.0), ("size", 0.6)):
        parent = getattr(row, f"by_{name}")
        if isinstance(parent, str):
            w, names = edges.get(parent, (0.0, ()))
            edges[parent] = (w + weight, (*names, name))
    parents = head.parents(edges)
    said = dict(zip(_ORDER, row.votes))
    costs = dict(zip(_ORDER, map(float, row.costs)))
    bounds = {m: a / (a + b) for m, (a, b) in trust.items()}
    prior, used = head.label_prior(parents)
    drawn = head.regularized(bounds, parents)
    subset, sure, feasible = head.choose(drawn, bounds, costs, prior, used, need)
    outcome = np.array([[LABELS.index(said[m]) for m in subset]])
    label = LABELS[int(head.votes(outcome, np.array([bounds[m] for m in subset]), subset, prior, used)[0])]
    head.record(row.node, parents, {m: float(said[m] == label) for m in subset}, label, False)
    if row.audited:
        head.record(row.node, parents, {m: float(said[m] == row.gold) for m in _ORDER}, row.gold, True, said)
        for m in _ORDER:
            trust[m][0 if said[m] == row.gold else 1] += 1
    return (row.stream, row.doc_id, label, ",".join(subset), round(sure, 9), feasible, used, round(float(prior[1]), 9), round(sum(costs[m] for m in subset), 12), label == row.gold)


OUT = "stream string, doc_id long, label string, models string, confidence double, feasible boolean, spoke long, prior double, cost double, right boolean"


def _trust() -> dict:
    return {m: [0.75 * PRIOR_N, 0.25 * PRIOR_N] for m in _ORDER}


@_query()
def d14_causal_subset(spark, d):
    """Subset votes by source with the additive vote: models' bounds drawn by their parents' rewards, the prior by labels and structure."""
    settings = SubsetSettings(prior_power=0.5)
    return fold(subset_items(spark, d), ["stream"], ["doc_id"], lambda row: (SubsetHead(list(_ORDER), LABELS, settings), _trust()), lambda state, row: step(*state, row, NEED), OUT)


@_query()
def d16_calibrated_subset(spark, d):
    """The same with votes weighed by what each model answers to each true label, as far as audits have shown."""
    settings = SubsetSettings(prior_power=0.5, calibrated=True, blend=0.8)
    return fold(subset_items(spark, d), ["stream"], ["doc_id"], lambda row: (SubsetHead(list(_ORDER), LABELS, settings), _trust()), lambda state, row: step(*state, row, NEED), OUT)


def edges_of(row) -> dict[str, tuple[float, str]]:
    """The items before one of its size and its language; one that is both counts by language."""
    return {getattr(row, f"by_{r}"): (w, r) for r, w in (("size", 0.6), ("lang", 1.0)) if isinstance(getattr(row, f"by_{r}"), str)}


@_query()
def d29_graph_risk(spark, d):
    """Models asked one at a time by source, from a belief that the transition memory has of the item; what is decided goes into the memory."""

    def go(state, row):
        ask, memory = state
        edges = edges_of(row)
        start, spoke, weight = memory.prior(edges)
        told = dict(zip(_ORDER, row.confidences))
        out = ask.step(dict(zip(_ORDER, row.votes)), dict(zip(_ORDER, map(float, row.costs))), told, TOLERANCES[row.stream not in CRITICAL], start)
        memory.update(row.node, edges, out["belief"])
        return (row.stream, row.doc_id, round(float(start[1]), 9), spoke, round(weight, 9), out["label"], ",".join(out["asked"]), round(1 - out["confidence"], 9), out["abstained"], row.gold == out["label"])

    schema = "stream string, doc_id long, prior double, spoke long, weight double, label string, models string, risk double, abstained boolean, right boolean"
    start = lambda row: (RiskSequence(list(_ORDER), LABELS, fallback=_ORDER[0]), TransitionMemory(len(LABELS)))
    return fold(subset_items(spark, d), ["stream"], ["doc_id"], start, go, schema)


# the parts, over whole tables

def related():
    """A row for each relation of a document, with the part of the source that it shares."""
    pair = lambda rel, part: F.struct(F.lit(rel).alias("rel"), part.alias("part"))
    return F.explode(F.array(pair("lang", F.col("lang")), pair("size", F.floor(F.log2("n_chars")).cast("string"))))


CHAIN = f"""{RESPONSES},
chain AS (SELECT source, model_id, doc_id, rel, CAST(vote=gold AS INT) AS x, CAST({u("'audit|'||doc_id")} < {AUDITED}::DOUBLE AS INT) AS audited,
  lag(CAST(vote=gold AS INT)) OVER (PARTITION BY source, model_id, rel, part ORDER BY doc_id) AS before
  FROM (SELECT *, 'lang' AS rel, lang AS part FROM responses UNION ALL SELECT *, 'size', CAST(floor(log2(n_chars)) AS VARCHAR) FROM responses))"""


@_query(
    f"""WITH {CHAIN}, n AS (SELECT source, model_id, rel, before, sum(CASE WHEN audited=1 THEN 1 ELSE {UNAUDITED}::DOUBLE END) FILTER (x=1) AS good, sum(CASE WHEN audited=1 THEN 1 ELSE {UNAUDITED}::DOUBLE END) FILTER (x=0) AS bad
  FROM chain WHERE before IS NOT NULL GROUP BY ALL),
c AS (SELECT source, model_id, rel, before, 1+coalesce(good,0) AS a, 1+coalesce(bad,0) AS b, sum(coalesce(good,0)+coalesce(bad,0)) OVER (PARTITION BY source, model_id, rel) AS seen FROM n)
SELECT source, model_id, rel, before, round(seen,6) AS seen, round(a/(a+b),6) AS mean, round(least(1, greatest(0, a/(a+b) - {Z}::DOUBLE*sqrt(a*b/((a+b)*(a+b)*(a+b+1))))),6) AS lower, round(CASE WHEN seen < {LEAST} THEN 0 ELSE seen/(seen+{LEAST}) END,6) AS maturity FROM c"""
)
def d14_reward_transitions(spark, d):
    """For each source, model and relation how often a model that was right (or wrong) on an item's parent is right on the item: mean, lower bound and how mature that is. Audited items weigh 1, others a quarter."""
    r = t.responses(t.items(spark, d), t.models(spark))
    r = r.select("source", "model_id", "doc_id", (F.col("vote") == F.col("gold")).cast("int").alias("x"), (unit_draw(joined("audit", F.col("doc_id"), sep="|")) < AUDITED).alias("audited"), related().alias("rp")).select("*", "rp.rel", "rp.part")
    r = r.withColumn("before", F.lag("x").over(Window.partitionBy("source", "model_id", "rel", "part").orderBy("doc_id"))).where("before is not null")
    share = F.when(F.col("audited"), 1.0).otherwise(UNAUDITED)
    n = r.groupBy("source", "model_id", "rel", "before").agg(*[F.sum(F.when(F.col("x") == v, share).otherwise(0.0)).alias(k) for k, v in (("good", 1), ("bad", 0))])
    n = n.withColumns({"a": 1 + F.col("good"), "b": 1 + F.col("bad"), "seen": F.sum(F.col("good") + F.col("bad")).over(Window.partitionBy("source", "model_id", "rel"))})
    a, b, s = F.col("a"), F.col("b"), F.col("seen")
    lower = a / (a + b) - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return n.select("source", "model_id", "rel", "before", F.round(s, 6).alias("seen"), F.round(a / (a + b), 6).alias("mean"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), lower)), 6).alias("lower"), F.round(F.when(s < LEAST, 0.0).otherwise(s / (s + LEAST)), 6).alias("maturity"))


RATES = """confusion AS (SELECT source, model_id, gold, sum((vote='toxic')::INT) AS v1, count(*) AS n FROM responses GROUP BY 1,2,3),
table_of AS (SELECT s.source, m.model_id, g.gold, (coalesce(v1,0)+1)/(coalesce(n,0)+2)::DOUBLE AS says_toxic FROM (SELECT DISTINCT source FROM items) s, models m, (SELECT unnest(['clean','toxic']) AS gold) g LEFT JOIN confusion c ON c.source=s.source AND c.model_id=m.model_id AND c.gold=g.gold),
rate AS (SELECT source, (sum((gold='toxic')::INT)+1)/(count(*)+2)::DOUBLE AS toxic FROM items GROUP BY 1)"""


@_query(
    f"""WITH {RESPONSES}, {RATES},
w AS (SELECT r.item_id, r.source, r.vote, r.accuracy/avg(r.accuracy) OVER (PARTITION BY r.item_id) AS w, c.says_toxic AS c0, t.says_toxic AS c1 FROM responses r JOIN table_of c ON c.source=r.source AND c.model_id=r.model_id AND c.gold='clean' JOIN table_of t ON t.source=r.source AND t.model_id=r.model_id AND t.gold='toxic'),
x AS (SELECT item_id, any_value(source) AS source, sum(w*ln(CASE WHEN vote='toxic' THEN c1/c0 ELSE (1-c1)/(1-c0) END)) AS odds FROM w GROUP BY item_id)
SELECT item_id, round(1/(1+exp(-(odds + 0.5::DOUBLE*ln(toxic/(1-toxic))))),6) AS toxic, CASE WHEN odds + 0.5::DOUBLE*ln(toxic/(1-toxic)) > 0 THEN 'toxic' ELSE 'clean' END AS label FROM x JOIN rate USING (source)"""
)
def d16_calibrated_vote(spark, d):
    """Each item's vote of the whole pool, weighed by what a model answers to each true label in the item's source, with half the label rates' log odds."""
    r = t.responses(t.items(spark, d), t.models(spark))
    toxic = lambda c: (F.col(c) == LABELS[1]).cast("int")
    of = lambda g: F.coalesce(F.sum(F.when(F.col("gold") == g, toxic("vote"))) + 1, F.lit(1)) / (F.sum((F.col("gold") == g).cast("int")) + 2)
    tables = r.groupBy("source", "model_id").agg(of(LABELS[0]).alias("c0"), of(LABELS[1]).alias("c1"))
    rates = t.items(spark, d).groupBy("source").agg(((F.sum(toxic("gold")) + 1) / (F.count(F.lit(1)) + 2)).alias("rate"))
    a, b = F.col("c1"), F.col("c0")
    weight = F.col("accuracy") / (sum(m[1] for m in t.MODELS) / len(t.MODELS))
    said = weight * F.log(F.when(F.col("vote") == LABELS[1], a / b).otherwise((1 - a) / (1 - b)))
    x = r.join(tables, ["source", "model_id"]).join(rates, "source").groupBy("item_id").agg((F.sum(said) + 0.5 * F.log(F.first("rate") / (1 - F.first("rate")))).alias("x"))
    return x.select("item_id", F.round(1 / (1 + F.exp(-F.col("x"))), 6).alias("toxic"), F.when(F.col("x") > 0, LABELS[1]).otherwise(LABELS[0]).alias("label"))


_FULL = (1 << len(_ORDER)) - 1
_C = ", ".join(f"max(says_toxic) FILTER (model_id='{m}' AND gold='{g}') AS c{k}_{j}" for k, m in enumerate(_ORDER) for j, g in enumerate(LABELS))
_P = ["*".join(f"(CASE WHEN (code>>{k})&1=0 THEN 1::DOUBLE WHEN (o>>{k})&1=1 THEN c{k}_{j} ELSE 1-c{k}_{j} END)" for k in range(len(_ORDER))) for j in (0, 1)]


@_query(
    f"""WITH {RESPONSES}, {RATES}, wide AS (SELECT source, {_C} FROM table_of GROUP BY source),
o AS (SELECT s.range AS code, x.range AS o FROM range(1,{_FULL + 1}) s, range(0,{_FULL + 1}) x WHERE x.range & s.range = x.range),
p AS (SELECT source, code, toxic*({_P[1]}) AS p1, (1-toxic)*({_P[0]}) AS p0 FROM o, wide JOIN rate USING (source))
SELECT source, code, round(sum(greatest(p0, p1)),6) AS confidence FROM p GROUP BY source, code"""
)
def d17_joint_confidence(spark, d):
    """For each source and subset of the pool the exact probability that the likeliest label given the subset's votes is the true one: the sum over all outcomes."""
    r = t.responses(t.items(spark, d), t.models(spark))
    toxic = lambda c: (F.col(c) == LABELS[1]).cast("int")
    of = lambda m, g: F.coalesce(F.sum(F.when((F.col("model_id") == m) & (F.col("gold") == g), toxic("vote"))), F.lit(0))
    n = lambda m, g: F.sum(((F.col("model_id") == m) & (F.col("gold") == g)).cast("int"))
    wide = r.groupBy("source").agg(F.array(*[F.array(*[(of(m, g) + 1) / (n(m, g) + 2) for g in LABELS]) for m in _ORDER]).alias("c"), ((F.sum(toxic("gold")) / len(_ORDER) + 1) / (F.count(F.lit(1)) / len(_ORDER) + 2)).alias("rate"))
    o = spark.range(1, _FULL + 1).select(F.col("id").alias("code"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_FULL).cast("long"))).alias("o")).where(F.col("o").bitwiseAND(F.col("code")) == F.col("o"))
    met = wide.crossJoin(F.broadcast(o))  # 3^6 outcomes, whatever the data

    def chance(j: int):
        p = F.lit(1.0)
        for k in range(len(_ORDER)):
            c = F.col("c")[k][j]
            p = p * F.when(F.getbit("code", F.lit(k)) == 0, 1.0).when(F.getbit("o", F.lit(k)) == 1, c).otherwise(1 - c)
        return p

    each = F.greatest((1 - F.col("rate")) * chance(0), F.col("rate") * chance(1))
    return met.groupBy("source", "code").agg(F.round(F.sum(each), 6).alias("confidence"))


#: Audits by which the latest parents are known; weights of the relations; transitions and gate observations from which they count; how much the label rates are balanced and how far a message moves them.
SEEN, WEIGHTS, LEAST_SEEN, LEAST_GATED, BALANCE, BLEND, MOST = 0.7, {"lang": 1.0, "size": 0.6}, 8.0, 12.0, 0.75, 0.30, 6.0
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_WEIGHT = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS.items())


@_query(
    f"""WITH {ITEMS},
i AS (SELECT source, doc_id, gold='toxic' AS y, {u("'audit|'||doc_id")} < {SEEN}::DOUBLE AS a, rel, part FROM (SELECT *, 'lang' AS rel, lang AS part FROM items UNION ALL SELECT *, 'size', CAST(floor(log2(n_chars)) AS VARCHAR) FROM items)),
p AS (SELECT *, last_value(CASE WHEN a THEN y END IGNORE NULLS) OVER (PARTITION BY source, rel, part ORDER BY doc_id {_BEFORE}) AS q FROM i),
n AS (SELECT *, {", ".join(f"coalesce(sum((a AND q IS NOT NULL AND {'q' if x else 'NOT q'} AND {'y' if z else 'NOT y'})::INT) OVER w, 0)::DOUBLE AS n{x}{z}" for x in (0, 1) for z in (0, 1))},
  coalesce(sum((a AND y)::INT) OVER w, 0)::DOUBLE AS c1, coalesce(sum(a::INT) OVER w, 0)::DOUBLE AS c FROM p WINDOW w AS (PARTITION BY source, rel ORDER BY doc_id {_BEFORE})),
m AS (SELECT *, (c1+1)/(c+2) AS rate, n00+n01+n10+n11 AS seen, CASE WHEN q THEN (n11+1)/(n10+n11+2) ELSE (n01+1)/(n00+n01+2) END AS row_ FROM n),
s AS (SELECT *, CASE WHEN q IS NOT NULL THEN seen/(seen+{LEAST_SEEN}::DOUBLE)*row_ + (1-seen/(seen+{LEAST_SEEN}::DOUBLE))*rate END AS pred FROM m),
h AS (SELECT *, a AND q IS NOT NULL AND seen >= {LEAST_SEEN} AS tried, CASE WHEN y THEN pred > rate + 1e-12::DOUBLE ELSE 1-pred > 1-rate + 1e-12::DOUBLE END AS good FROM s),
g AS (SELECT *, coalesce(sum((tried AND good)::INT) OVER w, 0)::DOUBLE + 2 AS ga, coalesce(sum((tried AND NOT good)::INT) OVER w, 0)::DOUBLE + 2 AS gb FROM h WINDOW w AS (PARTITION BY source, rel ORDER BY doc_id {_BEFORE})),
o AS (SELECT *, CASE WHEN pred IS NULL OR ga+gb-4 < {LEAST_GATED} THEN 0 ELSE greatest(0, least(1, (ga/(ga+gb) - sqrt(ga*gb/((ga+gb)*(ga+gb)*(ga+gb+1))) - 0.5::DOUBLE)/0.5::DOUBLE)) END * CASE rel {_WEIGHT} END AS w FROM g),
z AS (SELECT doc_id, max(rate) AS rate, count(*) FILTER (w > 0) AS relations, sum(w) AS w, sum(w*pred) FILTER (w > 0) AS x FROM o GROUP BY doc_id),
b AS (SELECT *, {1 - BALANCE}::DOUBLE*rate + {BALANCE / 2}::DOUBLE AS base, {BLEND}::DOUBLE*least(1, w/{MOST}::DOUBLE) AS k FROM z)
SELECT doc_id, relations, round(w, 6) AS weight, round(CASE WHEN w > 0 THEN x/w END, 6) AS message, round(CASE WHEN w > 0 THEN (1-k)*base + k*x/w ELSE base END, 6) AS prior FROM b"""
)
def d24_latest_parents(spark, d):
    """What the latest audited parent of every relation says of an item, and the balanced label rates that it moves: an as-of join by relation, with transitions and gates as they stood before the item."""
    i = t.items(spark, d)
    i = i.select("source", "doc_id", (F.col("gold") == LABELS[1]).alias("y"), (unit_draw(joined("audit", F.col("doc_id"), sep="|")) < SEEN).alias("a"), related().alias("rp")).select("source", "doc_id", "y", "a", "rp.rel", "rp.part")
    earlier = lambda *by: Window.partitionBy("source", *by).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    i = i.withColumn("q", F.last(F.when(F.col("a"), F.col("y")), ignorenulls=True).over(earlier("rel", "part")))
    w = earlier("rel")
    many = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("int")).over(w), F.lit(0)).cast("double")
    a, q, y = F.col("a"), F.col("q"), F.col("y")
    i = i.withColumns({f"n{x}{z}": many(a & (q if x else ~q) & (y if z else ~y)) for x in (0, 1) for z in (0, 1)} | {"c1": many(a & y), "c": many(a)})
    i = i.withColumns({"rate": (F.col("c1") + 1) / (F.col("c") + 2), "seen": F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")})
    row = F.when(q, (F.col("n11") + 1) / (F.col("n10") + F.col("n11") + 2)).otherwise((F.col("n01") + 1) / (F.col("n00") + F.col("n01") + 2))
    mature = F.col("seen") / (F.col("seen") + LEAST_SEEN)
    i = i.withColumn("pred", F.when(q.isNotNull(), mature * row + (1 - mature) * F.col("rate")))
    good = F.when(y, F.col("pred") > F.col("rate") + 1e-12).otherwise(1 - F.col("pred") > 1 - F.col("rate") + 1e-12)
    tried = a & q.isNotNull() & (F.col("seen") >= LEAST_SEEN)
    i = i.withColumns({"ga": many(tried & good) + 2, "gb": many(tried & ~good) + 2})
    ga, gb, n = F.col("ga"), F.col("gb"), F.col("ga") + F.col("gb")
    lower = ga / n - F.sqrt(ga * gb / (n * n * (n + 1)))
    open_ = F.when(F.col("pred").isNull() | (n - 4 < LEAST_GATED), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (lower - 0.5) / 0.5)))
    i = i.withColumn("w", open_ * F.when(F.col("rel") == "lang", WEIGHTS["lang"]).otherwise(WEIGHTS["size"]))
    z = i.groupBy("doc_id").agg(F.max("rate").alias("rate"), F.sum((F.col("w") > 0).cast("long")).alias("relations"), F.sum("w").alias("w"), F.sum(F.when(F.col("w") > 0, F.col("w") * F.col("pred"))).alias("x"))
    base, k = (1 - BALANCE) * F.col("rate") + BALANCE / 2, BLEND * F.least(F.lit(1.0), F.col("w") / MOST)
    message = F.when(F.col("w") > 0, F.col("x") / F.col("w"))
    return z.select("doc_id", "relations", F.round("w", 6).alias("weight"), F.round(message, 6).alias("message"), F.round(F.coalesce((1 - k) * base + k * message, base), 6).alias("prior"))
