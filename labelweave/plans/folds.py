"""Ordered folds by source, host or day, so that Spark spreads the streams: sequential questions, online correlation, forward chains, matched controls."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from labelweave.functions.hashing import unit_draw
from labelweave.operators.matching import Controls
from labelweave.operators.sequential import OnlineCorrelation, RiskSequence, passed_on
from labelweave.plans.relational import EVENTS, u
from labelweave.plans.replay import NAMES, fold
from labelweave.sources import tables as t
from labelweave.sources.tables import LABELS

#: Risk that may be left: of items of a critical source, and of others.
CRITICAL, TOLERANCES = ("news", "web"), (0.01, 0.03)
#: Time in which an event of a host or object speaks for the next, their weights, and what a belief becomes.
GAP_MS, HOST_WEIGHT, OBJECT_WEIGHT, TRANSITION, PRIOR = 1_800_000, 0.08, 1.0, (0.1, 0.7), 0.3

#: An attack's events of at least this value are the cases that controls are matched to.
CASE_VALUE = 100


def votes_by_model(spark, d):
    """One row for each item: votes, costs and confidences of all models."""
    r = t.responses(t.items(spark, d), t.models(spark))
    wide = [F.max(F.when(F.col("model_id") == m, F.col(c))).alias(f"{c}_{m}") for m in NAMES for c in ("vote", "cost", "confidence")]
    return r.groupBy("doc_id").agg(F.max("gold").alias("gold"), F.max("source").alias("source"), *wide)


def d26_sequential_risk(spark, d):
    """Models asked one at a time, by source: label, models in order, risk, and whether it abstains."""

    def step(state, row):
        take = lambda what: {m: getattr(row, f"{what}_{m}") for m in NAMES}
        out = state.step(take("vote"), take("cost"), take("confidence"), TOLERANCES[row.source not in CRITICAL])
        return (row.source, row.doc_id, out["label"], ",".join(out["asked"]), round(1 - out["confidence"], 9), round(out["cost"], 9), out["abstained"], row.gold == out["label"])

    return fold(votes_by_model(spark, d), ["source"], ["doc_id"], lambda row: RiskSequence(NAMES, LABELS, fallback="board"), step, "source string, doc_id long, label string, models string, risk double, cost double, abstained boolean, right boolean")


def a13_online_correlation(spark, d):
    """Correlation of the reader's and the board's being right, as it stands after each item of a source."""

    def step(state, row):
        return (row.source, row.doc_id, round(state.add(float(row.vote_reader == row.gold), float(row.vote_board == row.gold)), 9))

    rows = votes_by_model(spark, d).select("source", "doc_id", "gold", "vote_reader", "vote_board")
    return fold(rows, ["source"], ["doc_id"], lambda row: OnlineCorrelation(), step, "source string, doc_id long, correlation double")


def g9_forward_chain(spark, d):
    """Beliefs passed on in time order along a host's events: from the one before, and the one before on the same object, within half an hour."""

    def step(state, row):
        parents = [(w * math.exp(-(row.ms - at) / GAP_MS), p) for w, (at, p) in ((HOST_WEIGHT, state.get("host", (-math.inf, 0))), (OBJECT_WEIGHT, state.get(row.object, (-math.inf, 0)))) if row.ms - at <= GAP_MS]
        p = passed_on(row.own, parents, 1.0, TRANSITION, PRIOR)
        for k in [k for k, (at, _) in state.items() if row.ms - at > GAP_MS]:
            del state[k]
        state["host"] = state[row.object] = (row.ms, p)
        return (row.event_id, round(p, 9))

    rows = t.events(spark, d).select("host", "event_id", "ms", "object", unit_draw(F.concat(F.lit("own|"), F.col("event_id"))).alias("own"))
    return fold(rows, ["host"], ["ms", "event_id"], lambda row: {}, step, "event_id long, belief double")


def matching_rows(spark, d):
    """Cases, which are attack events of a high value, and controls, which are benign events, with what they are matched by."""
    e = t.events(spark, d)
    case = (F.col("corpus") == "attack") & (F.col("value") >= CASE_VALUE)
    e = e.where(case | (F.col("corpus") == "benign")).withColumn("case", F.coalesce(case, F.lit(False)))
    return e.select("day", "case", "event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("turn"), F.coalesce("action", F.lit("")).alias("action"), F.coalesce(F.pmod("object", F.lit(10)), F.lit(-1)).cast("long").alias("kind"), F.coalesce(F.floor("value"), F.lit(0)).cast("long").alias("size"))


def j14_matched_controls(spark, d):
    """For each case the nearest control of its day by action, kind of object and size, each control used once, cases in the order of a hash.

    A null action or object is a kind of its own, a null value counts as 0. What one case takes is gone for the next, so a day is one stream; its controls are held as ids by traits and size. A
    case for which none is left has a null control.
    """

    def step(state, row):
        traits, size = (row.action, row.kind), row.size
        if not row.case:
            state.add(row.event_id, traits, size)
            return (row.day, row.event_id, False, None, None, None, None)
        found = state.take(row.event_id, traits, size)
        return (row.day, row.event_id, True, *((found[0], *found[1], found[2]) if found else (None,) * 4))

    schema = "day long, event_id long, case boolean, control long, other_action long, other_kind long, gap long"
    out = fold(matching_rows(spark, d), ["day"], ["case", "turn", "event_id"], lambda row: Controls(), step, schema)
    return out.where("case").drop("case")


QUERIES = {f.__name__: f for f in (d26_sequential_risk, a13_online_correlation, g9_forward_chain, j14_matched_controls)}
SQL = {
    "g9_forward_chain": f"""WITH RECURSIVE {EVENTS}, o AS (SELECT host, event_id, ms, object, {u("'own|'||event_id")} AS own, row_number() OVER (PARTITION BY host ORDER BY ms, event_id) AS i FROM ev),
q AS (SELECT *, lag(i) OVER (PARTITION BY host, object ORDER BY i) AS oi, lag(ms) OVER (PARTITION BY host ORDER BY i) AS hm, lag(ms) OVER (PARTITION BY host, object ORDER BY i) AS om FROM o),
w AS (SELECT *, CASE WHEN ms-hm<={GAP_MS} THEN {HOST_WEIGHT}::DOUBLE*exp(-(ms-hm)/{GAP_MS}.0::DOUBLE) ELSE 0::DOUBLE END AS wh, CASE WHEN ms-om<={GAP_MS} THEN {OBJECT_WEIGHT}::DOUBLE*exp(-(ms-om)/{GAP_MS}.0::DOUBLE) ELSE 0::DOUBLE END AS wo FROM q),
r(host, i, event_id, past) AS (SELECT host, 0::BIGINT, NULL::BIGINT, []::DOUBLE[] FROM (SELECT DISTINCT host FROM o)
UNION ALL SELECT r.host, w.i, w.event_id, list_append(past, CASE WHEN wh+wo=0 THEN own ELSE 1/(1+exp(-least(30, greatest(-30, lg(own) + lg((CASE WHEN wh>0 THEN wh*step(past[w.i-1]) ELSE 0 END + CASE WHEN wo>0 THEN wo*step(past[oi]) ELSE 0 END)/(wh+wo)) - lg({PRIOR}::DOUBLE))))) END)
FROM r JOIN w ON w.host=r.host AND w.i=r.i+1) SELECT event_id, round(past[i], 9) AS belief FROM r WHERE i>0""",
}
_LOGIT = "ln(least(1-1e-5::DOUBLE, greatest(1e-5::DOUBLE, {0}))/(1-least(1-1e-5::DOUBLE, greatest(1e-5::DOUBLE, {0}))))"


def _inlined(sql: str) -> str:
    """lg() and step() written out, as SQL without macros needs it."""
    for name, body in (("step", "((1-{0})*" + f"{TRANSITION[0]}::DOUBLE" + "+{0}*" + f"{TRANSITION[1]}::DOUBLE)"), ("lg", _LOGIT)):
        while (at := sql.find(name + "(")) >= 0:
            depth, end = 1, at + len(name) + 1
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[end], 0)
                end += 1
            sql = sql[:at] + body.format("(" + sql[at + len(name) + 1 : end - 1] + ")") + sql[end:]
    return sql


SQL = {k: _inlined(v) for k, v in SQL.items()}
