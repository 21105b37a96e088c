"""Votes over a response table (item, model, vote, cost, latency): aggregation, metrics, statistics, subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.functions.mathx import clip, logit, ratio, sigmoid, total, wilson


def weighted_vote(r: DataFrame, weight: Column, labels: tuple[str, ...], item: str = "item_id") -> DataFrame:
    """(item, label, weight, tied): the label with the largest summed weight; weights equal to nine digits tie, the earlier label wins."""
    sums = r.groupBy(item, F.col("vote").alias("label")).agg(F.round(F.sum(weight), 9).alias("weight"))
    order = F.array_position(F.array(*map(F.lit, labels)), F.col("label"))
    best = sums.withColumn("rank", F.struct((-F.col("weight")).alias("w"), order.alias("o")))
    top = best.groupBy(item).agg(F.min_by("label", "rank").alias("label"), F.max("weight").alias("weight"), F.collect_list("weight").alias("all"))
    return top.select(item, "label", "weight", (F.size(F.filter("all", lambda w: w == F.col("weight"))) > 1).alias("tied"))


def class_metrics(p: DataFrame, labels: tuple[str, ...], gold: str = "gold", label: str = "label", digits: int = 6) -> DataFrame:
    """Precision, recall, F1 and support of each declared label, 0 where a denominator is 0; one pass over the predictions."""
    counts = p.groupBy(gold, label).agg(F.count(F.lit(1)).alias("n"))
    each = counts.select(F.explode(F.array(*map(F.lit, labels))).alias("class"), F.col(gold).alias("g"), F.col(label).alias("p"), "n")
    s = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    k, g, q = F.col("class"), F.col("g"), F.col("p")
    m = each.groupBy("class").agg(s((g == k) & (q == k)).alias("tp"), s((g != k) & (q == k)).alias("fp"), s((g == k) & (q != k)).alias("fn"))
    m = m.withColumns({"precision": ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return m.select("class", *[F.round(c, digits).alias(c) for c in ("precision", "recall")], F.round(f1, digits).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def macro_summary(p: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    m = class_metrics(p, labels, digits=12).agg(*[F.round(F.avg(c), 6).alias("macro_" + c) for c in ("precision", "recall", "f1")])
    accuracy = p.agg(F.round(F.avg((F.col("gold") == F.col("label")).cast("double")), 6).alias("accuracy"))
    return accuracy.join(m)


def policy_summary(r: DataFrame, by: str = "policy") -> DataFrame:
    """Per policy: items, cost, models an item, mean and 95th percentile of parallel latency, mean serial latency."""
    per = r.groupBy(by, "item_id").agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("models"), F.max("latency_ms").alias("parallel"), F.sum("latency_ms").alias("serial"))
    return per.groupBy(by).agg(
        F.count(F.lit(1)).alias("items"),
        F.round(F.sum("cost"), 6).alias("total_cost"),
        F.round(F.avg("models"), 6).alias("mean_models"),
        F.round(F.avg("parallel"), 6).alias("mean_parallel_ms"),
        F.round(F.percentile("parallel", F.lit(0.95)), 6).alias("p95_parallel_ms"),
        F.round(F.avg("serial"), 6).alias("mean_serial_ms"),
    )


def model_accuracy(r: DataFrame) -> DataFrame:
    """Per model: smoothed accuracy (c + 1) / (n + 2), price, and its rank by (accuracy, lower price, name)."""
    m = r.groupBy("model_id").agg(((F.sum((F.col("vote") == F.col("gold")).cast("long")) + 1) / (F.count(F.lit(1)) + 2)).alias("a"), F.max("in_price").alias("price"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.round("a", 9)), "price", "model_id"))  # a row for each model
    return m.select("model_id", F.round("a", 6).alias("smoothed_accuracy"), "price", rank.cast("long").alias("rank"))


def confusion(r: DataFrame, labels: tuple[str, ...], prior: float = 1.0) -> DataFrame:
    """Per model and pair of labels: count, and P(vote | gold) with a symmetric prior; pairs that don't occur count 0."""
    n = r.groupBy("model_id", "gold", "vote").agg(F.count(F.lit(1)).alias("n"))
    grid = n.select("model_id").distinct().select("model_id", F.explode(F.array(*map(F.lit, labels))).alias("gold")).select("model_id", "gold", F.explode(F.array(*map(F.lit, labels))).alias("vote"))
    full = grid.join(n, ["model_id", "gold", "vote"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    whole = F.sum("n").over(Window.partitionBy("model_id", "gold"))
    return full.select("model_id", "gold", "vote", "n", F.round((F.col("n") + prior) / (whole + prior * len(labels)), 6).alias("prob"))


def pivoted(r: DataFrame, model_ids: list[str], value: Column, item: str = "item_id") -> DataFrame:
    """An item's responses side by side, so that pairs of models need no self-join."""
    return r.groupBy(item).agg(F.max("gold").alias("gold"), *[F.max(F.when(F.col("model_id") == m, value)).alias(m) for m in model_ids])


def model_pairs(wide: DataFrame, model_ids: list[str]) -> DataFrame:
    """(item, gold, m1, m2, a, b) for every pair of models."""
    names = sorted(model_ids)
    pairs = F.array(*[F.struct(F.lit(a).alias("m1"), F.lit(b).alias("m2"), F.col(a).alias("a"), F.col(b).alias("b")) for i, a in enumerate(names) for b in names[i + 1 :]])
    return wide.select("item_id", "gold", F.inline(pairs))


def error_phi(pairs: DataFrame) -> DataFrame:
    """Phi correlation of two models' errors, clamped to [-1, 1], 0 where a margin is empty. a, b: whether each is wrong."""
    c = lambda x, y: F.sum(((F.col("a") == x) & (F.col("b") == y)).cast("long"))
    t = pairs.groupBy("m1", "m2").agg(c(True, True).alias("n11"), c(False, False).alias("n00"), c(True, False).alias("n10"), c(False, True).alias("n01"))
    d = lambda x: F.col(x).cast("double")
    under = (d("n11") + d("n10")) * (d("n01") + d("n00")) * (d("n11") + d("n01")) * (d("n10") + d("n00"))
    phi = F.when(under > 0, (d("n11") * d("n00") - d("n10") * d("n01")) / F.sqrt(under)).otherwise(0.0)
    return t.select("m1", "m2", "n11", "n10", "n01", "n00", F.round(clip(phi, -1, 1), 6).alias("phi"))


def mutual_information(r: DataFrame) -> DataFrame:
    """I(gold; vote) in nats of each model, from its counts."""
    n = r.groupBy("model_id", "gold", "vote").agg(F.count(F.lit(1)).cast("double").alias("n"))
    whole, g, v = (F.sum("n").over(Window.partitionBy("model_id", *by)) for by in ((), ("gold",), ("vote",)))
    cells = n.select("model_id", ((F.col("n") / whole) * F.log(F.col("n") * whole / (g * v))).alias("x"))
    return cells.groupBy("model_id").agg(F.round(F.greatest(F.lit(0.0), F.sum("x")), 6).alias("mi"))


def agreement(pairs: DataFrame) -> DataFrame:
    """Per pair of models: share of items with the same vote, and redundancy (same + 1) / (n + 2)."""
    same = F.sum((F.col("a") == F.col("b")).cast("long"))
    n = F.count(F.lit(1))
    return pairs.groupBy("m1", "m2").agg(n.alias("n"), F.round(same / n, 6).alias("agreement"), F.round((same + 1) / (n + 2), 6).alias("redundancy"))


def distinct_votes(r: DataFrame) -> DataFrame:
    """How many items have 1, 2, ... different votes."""
    per = r.groupBy("item_id").agg(F.count_distinct("vote").alias("distinct_votes"))
    return per.groupBy("distinct_votes").agg(F.count(F.lit(1)).alias("items"))


def subsets(models: DataFrame, least: int = 1) -> DataFrame:
    """Every subset of the pool of `least` models or more: (code, size, models, price), a bit for each model by name. The pool is at most 12."""
    pool = models.orderBy("model_id").limit(13).collect()
    if len(pool) > 12:
        raise ValueError("a pool for exhaustive search has 12 models at most")
    names, prices = [m["model_id"] for m in pool], [m["in_price"] for m in pool]
    spark = models.sparkSession
    codes = spark.range(1, 1 << len(pool)).select(F.col("id").alias("code"), F.bit_count("id").cast("long").alias("size")).where(F.col("size") >= least)
    has = lambda k: F.col("code").bitwiseAND(F.lit(1 << k)) != 0
    members = F.filter(F.array(*[F.when(has(k), F.lit(n)) for k, n in enumerate(names)]), lambda x: x.isNotNull())
    price = sum((F.when(has(k), F.lit(p)).otherwise(0.0) for k, p in enumerate(prices)), F.lit(0.0))
    return codes.select("code", "size", members.alias("models"), F.round(price, 6).alias("price"))


def majority_confidence(sets: DataFrame, accuracies: DataFrame, by: list[str]) -> DataFrame:
    """Probability that more than half of a subset is right, its members being independent: the sum over all 2^n outcomes.

    accuracies: the columns by and known, a map from model to accuracy; each row of it meets every subset, which are bounded by the pool.
    """
    outcome = sets.select("code", "size", "models", "price", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, cast(size as int))") - 1)).alias("o"))
    met = accuracies.crossJoin(F.broadcast(outcome))  # 3^12 rows at most, whatever the data
    known = F.col("known")
    p = F.aggregate(
        F.transform("models", lambda m, i: F.when(F.getbit(F.col("o"), i) == 1, F.element_at(known, m)).otherwise(1 - F.element_at(known, m))),
        F.lit(1.0),
        lambda a, x: a * x,
    )
    win = F.when(F.bit_count("o") * 2 > F.col("size"), p).otherwise(0.0)
    return met.groupBy(*by, "code", "size", "price").agg(F.round(F.sum(win), 6).alias("confidence"))


def cheapest_subset(sets: DataFrame, needs: tuple[float, ...], by: list[str]) -> DataFrame:
    """For each need the subset of least (price, size, code) whose confidence reaches it; if none does, the whole pool, marked as infeasible."""
    each = sets.withColumn("need", F.explode(F.array(*map(F.lit, needs))))
    best = each.groupBy(*by, "need").agg(F.min(F.when(F.col("confidence") >= F.col("need"), F.struct("price", "size", "code", "confidence"))).alias("f"), F.max(F.struct("size", "code", "price", "confidence")).alias("w"))
    pick = lambda c: F.coalesce(F.col(f"f.{c}"), F.col(f"w.{c}")).alias(c)
    return best.select(*by, "need", pick("code"), pick("size"), pick("price"), pick("confidence"), F.col("f").isNotNull().alias("feasible"))


def vote_posterior(r: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """P(labels[1] | an item's votes) with a flat prior and models that err alike on every label."""
    step = logit(F.col("accuracy"), 1e-9) * F.when(F.col("vote") == labels[1], 1.0).otherwise(-1.0)
    return r.groupBy("item_id").agg(F.round(sigmoid(F.sum(step)), 6).alias("posterior"))


def selective_risk(p: DataFrame, cuts: list[float]) -> DataFrame:
    """At each cut: how many items are as confident, their share, their errors and the upper Wilson bound of the error rate."""
    n_all = F.count(F.lit(1))
    each = p.select("confidence", "wrong", F.explode(F.array(*map(F.lit, cuts))).alias("cut"))
    taken = F.col("confidence") >= F.col("cut")
    g = each.groupBy("cut").agg(n_all.alias("n"), F.sum(taken.cast("long")).alias("accepted"), F.sum((taken & F.col("wrong")).cast("long")).alias("errors"))
    return g.select("cut", "accepted", F.round(F.col("accepted") / F.col("n"), 6).alias("coverage"), "errors", F.round(wilson(F.col("errors"), F.col("accepted"))[1], 6).alias("upper"))


def oracle_ceiling(r: DataFrame) -> DataFrame:
    """One row: share of items that any model gets right, that all get wrong alike, and on which they disagree."""
    per = r.groupBy("item_id").agg(F.bool_or(F.col("vote") == F.col("gold")).alias("any"), F.count_distinct("vote").alias("k"))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return per.agg(share(F.col("any")).alias("any_right"), share(~F.col("any") & (F.col("k") == 1)).alias("unanimous_wrong"), share(F.col("k") > 1).alias("disagreement"))


def soft_pool(r: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Mean over an item's models of the probability of labels[1], a vote counting as its confidence kept within [0.51, 0.99]."""
    c = clip(F.coalesce("confidence", F.lit(0.75)), 0.51, 0.99)
    p = F.when(F.col("vote") == labels[1], c).otherwise(1 - c)
    return r.groupBy("item_id").agg(F.round(F.avg(p), 6).alias("p"), F.round(F.stddev_pop(p), 6).alias("sd"), F.round(F.avg((F.col("vote") == labels[1]).cast("double")), 6).alias("vote_share"))


def brier(p: DataFrame) -> DataFrame:
    return p.agg(F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 6).alias("brier"), F.round(total(F.array(F.min("p"))), 6).alias("least"), F.round(F.max("p"), 6).alias("most"))
