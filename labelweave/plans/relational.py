"""Queries over the driver's tables, each with the SQL that any engine gets the same rows from."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.functions import mathx, text
from labelweave.functions.hashing import hex_rank, scoped_id, stable_id, unit_draw
from labelweave.operators import graphs, joins, sampling, temporal, votes
from labelweave.sources import tables as t
from labelweave.sources.tables import LABELS, MODELS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def u(expression: str) -> str:
    return f"(CAST(('0x'||substr(sha256({expression}),1,16))::UBIGINT AS DOUBLE)/18446744073709551616.0::DOUBLE)"


def hx(seed, expression: str) -> str:
    return f"substr(sha256('{seed}:'||{expression}),1,16)"


#: The weight of all models together; the accuracy of the one that is asked last.
WHOLE, BOARD = round(sum(m[1] for m in MODELS), 9), MODELS[-1][1]
POOL = ", ".join(f"('{m}', {a}::DOUBLE, {i}::DOUBLE, {o}::DOUBLE, {lat}::DOUBLE, {s}::DOUBLE, {math.log(a / (1 - a))!r}::DOUBLE)" for m, a, i, o, lat, s in MODELS)
ITEMS = f"""models(model_id, accuracy, in_price, out_price, latency_ms, sensitivity, ability) AS (VALUES {POOL}),
items AS (SELECT d.doc_id, 'doc-'||d.doc_id AS item_id, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'clean' END AS gold, d.source, d.lang, d.n_chars,
  {u("'difficulty|doc-'||d.doc_id")} * 1.6::DOUBLE - 0.8::DOUBLE AS difficulty FROM documents d JOIN labels l USING (doc_id))"""
RESPONSES = ITEMS + f""",
r0 AS (SELECT *, least(1-1e-6::DOUBLE, greatest(1e-6::DOUBLE, 1/(1+exp(-(ability - sensitivity*difficulty))))) AS p FROM items, models),
responses AS (SELECT *, CASE WHEN {u("'17|'||model_id||'|'||item_id||'|correct'")} < p THEN gold WHEN gold = 'clean' THEN 'toxic' ELSE 'clean' END AS vote,
  CAST(greatest(1, (n_chars+3)//4) + 24 AS BIGINT) AS in_tokens, CAST(1 AS BIGINT) AS out_tokens, round(0.5::DOUBLE + 0.49::DOUBLE*{u("'17|'||model_id||'|'||item_id||'|confidence'")}, 6) AS confidence,
  ((greatest(1, (n_chars+3)//4) + 24) * in_price + out_price) / 1e6::DOUBLE AS cost FROM r0)"""
VOTED = RESPONSES + """,
sums AS (SELECT item_id, any_value(gold) AS gold, vote AS label, round(sum(accuracy), 9) AS weight FROM responses GROUP BY item_id, vote),
voted AS (SELECT item_id, gold, label, weight, count(*) OVER (PARTITION BY item_id, weight) > 1 AS tied,
  row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, label) AS rn FROM sums),
p AS (SELECT item_id, gold, label, weight, tied FROM voted WHERE rn = 1)"""
EVENTS = """ev AS (SELECT event_id, epoch_us(ts)//1000 AS ms, user_id AS host, upper(event_type) AS action, CAST(props->>'k' AS BIGINT) AS object, value,
  CAST(epoch_us(ts)//86400000000 AS BIGINT) AS day, CASE WHEN user_id % 3 = 0 THEN 'attack' ELSE 'benign' END AS corpus FROM events)"""


def _responses(spark: SparkSession, d: str) -> DataFrame:
    return t.responses(t.items(spark, d), t.models(spark))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    r = _responses(spark, d)
    voted = votes.weighted_vote(r, F.col("accuracy"), LABELS)
    return t.items(spark, d).select("item_id", "gold").join(voted, "item_id")


# votes and metrics


@query(f"WITH {RESPONSES} SELECT doc_id, model_id, vote, in_tokens, round(cost, 9) AS cost, confidence FROM responses")
def d33_sim_matrix(spark, d):
    return _responses(spark, d).select("doc_id", "model_id", "vote", "in_tokens", F.round("cost", 9).alias("cost"), "confidence")


@query(f"WITH {VOTED} SELECT item_id, label, weight, tied FROM p")
def a1_weighted_vote(spark, d):
    return votes.weighted_vote(_responses(spark, d), F.col("accuracy"), LABELS)


CLASS_SQL = """c AS (SELECT unnest(['clean','toxic']) AS class),
n AS (SELECT class, count(*) FILTER (gold=class AND label=class) AS tp, count(*) FILTER (gold<>class AND label=class) AS fp, count(*) FILTER (gold=class AND label<>class) AS fn FROM c, p GROUP BY class),
m AS (SELECT class, CASE WHEN tp+fp>0 THEN tp::DOUBLE/(tp+fp) ELSE 0 END AS pr, CASE WHEN tp+fn>0 THEN tp::DOUBLE/(tp+fn) ELSE 0 END AS re, tp+fn AS support FROM n),
metrics AS (SELECT class, round(pr,6) AS precision, round(re,6) AS recall, round(CASE WHEN pr+re>0 THEN 2*pr*re/(pr+re) ELSE 0 END,6) AS f1, CAST(support AS BIGINT) AS support FROM m)"""


@query(f"WITH {VOTED}, {CLASS_SQL} SELECT * FROM metrics")
def a2_class_metrics(spark, d):
    return votes.class_metrics(_predictions(spark, d), LABELS)


@query(f"WITH {VOTED}, {CLASS_SQL} SELECT (SELECT round(avg((gold=label)::INT::DOUBLE),6) FROM p) AS accuracy, round(avg(pr),6) AS macro_precision, round(avg(re),6) AS macro_recall, round(avg(CASE WHEN pr+re>0 THEN 2*pr*re/(pr+re) ELSE 0 END),6) AS macro_f1 FROM m")
def a2_macro_summary(spark, d):
    return votes.macro_summary(_predictions(spark, d), LABELS)


POLICY_SQL = """pol AS (SELECT *, 'full' AS policy FROM responses UNION ALL SELECT *, 'cheapest' FROM responses WHERE model_id='page'
  UNION ALL SELECT *, 'strongest' FROM responses WHERE model_id='board' UNION ALL SELECT *, 'three_cheapest' FROM responses WHERE model_id IN ('page','clerk','reader')),
per AS (SELECT policy, item_id, sum(cost) AS cost, count(*) AS models, max(latency_ms) AS parallel, sum(latency_ms) AS serial FROM pol GROUP BY 1,2)"""


@query(f"""WITH {RESPONSES}, {POLICY_SQL} SELECT policy, count(*) AS items, round(sum(cost),6) AS total_cost, round(avg(models),6) AS mean_models, round(avg(parallel),6) AS mean_parallel_ms,
round(quantile_cont(parallel,0.95),6) AS p95_parallel_ms, round(avg(serial),6) AS mean_serial_ms FROM per GROUP BY policy""")
def a3_policy_summary(spark, d):
    r = _responses(spark, d)
    names = F.filter(
        F.array(F.lit("full"), F.when(F.col("model_id") == "page", F.lit("cheapest")), F.when(F.col("model_id") == "board", F.lit("strongest")), F.when(F.col("model_id").isin("page", "clerk", "reader"), F.lit("three_cheapest"))),
        lambda x: x.isNotNull(),
    )
    return votes.policy_summary(r.withColumn("policy", F.explode(names)))


@query(f"""WITH {RESPONSES}, m AS (SELECT model_id, (sum((vote=gold)::INT)+1)/(count(*)+2)::DOUBLE AS a, max(in_price) AS price FROM responses GROUP BY 1)
SELECT model_id, round(a,6) AS smoothed_accuracy, price, row_number() OVER (ORDER BY round(a,9) DESC, price, model_id) AS rank FROM m""")
def a24_best_single(spark, d):
    return votes.model_accuracy(_responses(spark, d))


@query(f"""WITH {RESPONSES}, g AS (SELECT m.model_id, a.gold, b.vote FROM models m, (SELECT unnest(['clean','toxic']) AS gold) a, (SELECT unnest(['clean','toxic']) AS vote) b),
n AS (SELECT g.*, count(r.vote) AS n FROM g LEFT JOIN responses r ON r.model_id=g.model_id AND r.gold=g.gold AND r.vote=g.vote GROUP BY ALL)
SELECT model_id, gold, vote, n, round((n+1)/(sum(n) OVER (PARTITION BY model_id, gold)+2)::DOUBLE,6) AS prob FROM n""")
def a6_confusion(spark, d):
    return votes.confusion(_responses(spark, d), LABELS)


@query(f"""WITH {RESPONSES}, x AS (SELECT a.model_id AS m1, b.model_id AS m2, a.vote<>a.gold AS e1, b.vote<>b.gold AS e2 FROM responses a JOIN responses b ON a.item_id=b.item_id AND a.model_id<b.model_id),
n AS (SELECT m1, m2, count(*) FILTER (e1 AND e2) AS n11, count(*) FILTER (e1 AND NOT e2) AS n10, count(*) FILTER (NOT e1 AND e2) AS n01, count(*) FILTER (NOT e1 AND NOT e2) AS n00 FROM x GROUP BY 1,2)
SELECT m1, m2, n11, n10, n01, n00, round(CASE WHEN (n11+n10)::DOUBLE*(n01+n00)*(n11+n01)*(n10+n00)>0 THEN least(1,greatest(-1,(n11::DOUBLE*n00-n10::DOUBLE*n01)/sqrt((n11+n10)::DOUBLE*(n01+n00)*(n11+n01)*(n10+n00)))) ELSE 0 END,6) AS phi FROM n""")
def a7_error_phi(spark, d):
    names = [m[0] for m in MODELS]
    wide = votes.pivoted(_responses(spark, d), names, F.col("vote") != F.col("gold"))
    return votes.error_phi(votes.model_pairs(wide, names))


@query(f"""WITH {RESPONSES}, n AS (SELECT model_id, gold, vote, count(*)::DOUBLE AS n FROM responses GROUP BY ALL),
c AS (SELECT model_id, n, sum(n) OVER (PARTITION BY model_id) AS w, sum(n) OVER (PARTITION BY model_id, gold) AS g, sum(n) OVER (PARTITION BY model_id, vote) AS v FROM n)
SELECT model_id, round(greatest(0, sum(n/w*ln(n*w/(g*v)))),6) AS mi FROM c GROUP BY 1""")
def a8_mutual_info(spark, d):
    return votes.mutual_information(_responses(spark, d))


PAIR_SQL = "x AS (SELECT a.model_id AS m1, b.model_id AS m2, count(*) AS n, sum((a.vote=b.vote)::INT) AS same FROM responses a JOIN responses b ON a.item_id=b.item_id AND a.model_id<b.model_id GROUP BY 1,2)"


@query(f"WITH {RESPONSES}, {PAIR_SQL} SELECT m1, m2, n, round(same/n::DOUBLE,6) AS agreement, round((same+1)/(n+2)::DOUBLE,6) AS redundancy FROM x")
def a10_agreement(spark, d):
    names = [m[0] for m in MODELS]
    return votes.agreement(votes.model_pairs(votes.pivoted(_responses(spark, d), names, F.col("vote")), names))


@query(f"WITH {RESPONSES}, x AS (SELECT item_id, count(DISTINCT vote) AS distinct_votes FROM responses GROUP BY 1) SELECT distinct_votes, count(*) AS items FROM x GROUP BY 1")
def a10_distinct_votes(spark, d):
    return votes.distinct_votes(_responses(spark, d))


@query(f"WITH {RESPONSES}, {PAIR_SQL} SELECT m1, m2, round((same+1)/(n+2)::DOUBLE,6) AS redundancy FROM x WHERE n >= 8 AND (same+1)/(n+2)::DOUBLE >= 0.6")
def a11_redundancy(spark, d):
    names = [m[0] for m in MODELS]
    a = votes.agreement(votes.model_pairs(votes.pivoted(_responses(spark, d), names, F.col("vote")), names))
    return a.where("n >= 8 and redundancy >= 0.6").select("m1", "m2", "redundancy")


# subsets of the pool: bits in the order of the models' names; each source has its own accuracies

_ORDER = sorted(m[0] for m in MODELS)
_PRICES = {m[0]: m[2] for m in MODELS}
_FULL = (1 << len(_ORDER)) - 1
_PRICE = "+".join(f"(CASE WHEN (code>>{k})&1=1 THEN {_PRICES[m]}::DOUBLE ELSE 0 END)" for k, m in enumerate(_ORDER))
_PROB = "*".join(f"(CASE WHEN (code>>{k})&1=0 THEN 1::DOUBLE WHEN (o>>{k})&1=1 THEN a{k} ELSE 1-a{k} END)" for k in range(len(_ORDER)))
_ACCURACIES = ", ".join(f"max(a) FILTER (model_id='{m}') AS a{k}" for k, m in enumerate(_ORDER))
SUBSETS_SQL = f"""acc AS (SELECT source, {_ACCURACIES} FROM (SELECT source, model_id, (sum((vote=gold)::INT)+1)/(count(*)+2)::DOUBLE AS a FROM responses GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT range AS code, bit_count(range)::BIGINT AS size FROM range(1,{_FULL + 1})),
o AS (SELECT s.code, s.size, x.range AS o FROM s, range(0,{_FULL + 1}) x WHERE x.range & s.code = x.range),
q AS (SELECT source, code, size, round({_PRICE},6) AS price, round(sum(CASE WHEN bit_count(o)*2 > size THEN {_PROB} ELSE 0 END),6) AS confidence FROM o, acc GROUP BY source, code, size)"""
NEEDS = (0.80, 0.90, 0.93, 0.999)


def source_accuracies(spark, d):
    """(source, known): each model's smoothed accuracy on a source's items, as a map of the pool's size."""
    right = (F.col("vote") == F.col("gold")).cast("long")
    each = _responses(spark, d).groupBy("source", "model_id").agg(((F.sum(right) + 1) / (F.count(F.lit(1)) + 2)).alias("a"))
    return each.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("model_id", "a"))).alias("known"))


@query(f"WITH {RESPONSES}, {SUBSETS_SQL} SELECT source, code, size, price, confidence FROM q")
def d6_majority_conf(spark, d):
    return votes.majority_confidence(votes.subsets(t.models(spark)), source_accuracies(spark, d), ["source"])


@query(f"""WITH {RESPONSES}, {SUBSETS_SQL}, need AS (SELECT source, unnest([{", ".join(map(str, NEEDS))}])::DOUBLE AS need FROM acc),
f AS (SELECT q.source, need, code, size, price, confidence, row_number() OVER (PARTITION BY q.source, need ORDER BY price, size, code) AS rn FROM need JOIN q ON q.source=need.source AND confidence >= need AND size >= 2),
w AS (SELECT source, price, confidence FROM q WHERE code={_FULL})
SELECT need.source, need.need, coalesce(f.code, {_FULL}) AS code, coalesce(f.size, {len(_ORDER)}) AS size, coalesce(f.price, w.price) AS price, coalesce(f.confidence, w.confidence) AS confidence, f.code IS NOT NULL AS feasible
FROM need JOIN w ON w.source=need.source LEFT JOIN f ON f.source=need.source AND f.need=need.need AND rn=1""")
def d8_cheapest_subset(spark, d):
    sets = votes.majority_confidence(votes.subsets(t.models(spark), least=2), source_accuracies(spark, d), ["source"])
    return votes.cheapest_subset(sets, NEEDS, ["source"])


@query(f"WITH {RESPONSES} SELECT item_id, round(1/(1+exp(-sum(ability * CASE WHEN vote='toxic' THEN 1 ELSE -1 END))),6) AS posterior FROM responses GROUP BY 1")
def d27_posterior(spark, d):
    return votes.vote_posterior(_responses(spark, d), LABELS)


@query(f"""WITH {RESPONSES}, x AS (SELECT item_id, 1/(1+exp(-sum(ability * CASE WHEN vote='toxic' THEN 1 ELSE -1 END))) AS q FROM responses WHERE model_id<>'board' GROUP BY 1),
y AS (SELECT item_id, q, {BOARD}::DOUBLE*q+(1-{BOARD}::DOUBLE)*(1-q) AS pv FROM x),
z AS (SELECT item_id, q, pv, {BOARD}::DOUBLE*q/pv AS q1, (1-{BOARD}::DOUBLE)*q/(1-pv) AS q0 FROM y)
SELECT item_id, round(-q*ln(q)-(1-q)*ln(1-q) - pv*(-q1*ln(q1)-(1-q1)*ln(1-q1)) - (1-pv)*(-q0*ln(q0)-(1-q0)*ln(1-q0)),6) AS eig FROM z""")
def d27_eig(spark, d):
    """What the board's vote is expected to tell, in nats, after the others' votes."""
    r = _responses(spark, d).where("model_id <> 'board'")
    step = F.col("ability") * F.when(F.col("vote") == "toxic", 1).otherwise(-1)
    x = r.groupBy("item_id").agg(mathx.sigmoid(F.sum(step)).alias("q")).withColumn("pv", BOARD * F.col("q") + (1 - BOARD) * (1 - F.col("q")))
    q, pv = F.col("q"), F.col("pv")
    h = lambda p: mathx.entropy(F.array(p, 1 - p))
    return x.select("item_id", F.round(h(q) - pv * h(BOARD * q / pv) - (1 - pv) * h((1 - BOARD) * q / (1 - pv)), 6).alias("eig"))


@query(f"""WITH {VOTED}, c AS (SELECT p.item_id, p.label<>p.gold AS wrong, round(p.weight/{WHOLE!r}::DOUBLE,6) AS confidence FROM p), k AS (SELECT unnest([0.5,0.6,0.7,0.8,0.9])::DOUBLE AS cut),
g AS (SELECT cut, count(*) AS n, count(*) FILTER (confidence>=cut) AS accepted, count(*) FILTER (confidence>=cut AND wrong) AS errors FROM c, k GROUP BY cut),
w AS (SELECT *, 1.959963984540054::DOUBLE AS z, CASE WHEN accepted=0 THEN 0 ELSE errors/accepted::DOUBLE END AS e FROM g)
SELECT cut, accepted, round(accepted/n::DOUBLE,6) AS coverage, errors, round(CASE WHEN accepted=0 THEN 1 ELSE least(1,(e+z*z/(2*accepted)+z*sqrt(e*(1-e)/accepted+z*z/(4*accepted*accepted)))/(1+z*z/accepted)) END,6) AS upper FROM w""")
def d37_selective_risk(spark, d):
    p = _predictions(spark, d).select((F.col("label") != F.col("gold")).alias("wrong"), F.round(F.col("weight") / WHOLE, 6).alias("confidence"))
    return votes.selective_risk(p, [0.5, 0.6, 0.7, 0.8, 0.9])


@query(f"""WITH {RESPONSES}, x AS (SELECT item_id, bool_or(vote=gold) AS a, count(DISTINCT vote) AS k FROM responses GROUP BY 1)
SELECT round(avg(a::INT::DOUBLE),6) AS any_right, round(avg((NOT a AND k=1)::INT::DOUBLE),6) AS unanimous_wrong, round(avg((k>1)::INT::DOUBLE),6) AS disagreement FROM x""")
def d38_oracle_ceiling(spark, d):
    return votes.oracle_ceiling(_responses(spark, d))


@query(f"""WITH {RESPONSES}, x AS (SELECT item_id, vote, CASE WHEN vote='toxic' THEN least(0.99::DOUBLE,greatest(0.51::DOUBLE,confidence)) ELSE 1-least(0.99::DOUBLE,greatest(0.51::DOUBLE,confidence)) END AS p FROM responses)
SELECT item_id, round(avg(p),6) AS p, round(stddev_pop(p),6) AS sd, round(avg((vote='toxic')::INT::DOUBLE),6) AS vote_share FROM x GROUP BY 1""")
def d30_soft_pool(spark, d):
    return votes.soft_pool(_responses(spark, d), LABELS)


# sampling and splits


@query(f"WITH {EVENTS} SELECT event_id, {hx(5, 'event_id')} AS rank_hex FROM ev ORDER BY rank_hex, event_id LIMIT 50")
def o1_bottom_k(spark, d):
    return sampling.bottom_k(t.events(spark, d).select("event_id"), "event_id", 50, 5)


@query(f"""WITH {EVENTS}, r AS (SELECT event_id, action, row_number() OVER (PARTITION BY action ORDER BY {hx(7, 'event_id')}, event_id) AS pick, list_position(['CLICK','ERROR','PURCHASE','SIGNUP','VIEW'], action) AS pl FROM ev)
SELECT event_id, action, pick FROM r WHERE pick <= 20 + CASE WHEN pl <= 3 THEN 1 ELSE 0 END""")
def o7_stratified(spark, d):
    return sampling.stratified(t.events(spark, d), "action", "event_id", 103, ("CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW"), 7).select("event_id", "action", "pick")


@query(f"""WITH r AS (SELECT doc_id, toxic AS side, row_number() OVER (PARTITION BY toxic ORDER BY {hx(3, 'doc_id')}, doc_id) AS n FROM labels),
k AS (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM labels GROUP BY toxic)) SELECT doc_id, side, CAST((n-1)*2+side AS BIGINT) AS place FROM r, k WHERE n <= c""")
def o9_interleave(spark, d):
    return sampling.interleaved(t.read(spark, d, "labels").select("doc_id", "toxic"), F.col("toxic"), "doc_id", 3)


@query(f"""WITH {EVENTS}, w AS (SELECT action, object%10 AS k, count(*) AS quota FROM ev WHERE corpus='attack' GROUP BY ALL),
p AS (SELECT event_id, action, object%10 AS k FROM ev WHERE corpus='benign'),
r AS (SELECT p.*, quota, row_number() OVER (PARTITION BY action, k ORDER BY {hx(11, 'event_id')}, event_id) AS pick FROM p JOIN w USING (action, k)) SELECT event_id, action, k, pick FROM r WHERE pick <= quota""")
def j15_quota_match(spark, d):
    e = t.events(spark, d).withColumn("k", F.col("object") % 10)
    m = sampling.quota_match(e.where("corpus = 'attack'"), e.where("corpus = 'benign'").select("event_id", "action", "k"), ["action", "k"], "event_id", 11)
    return m.select("event_id", "action", "k", "pick")


@query(f"""WITH {EVENTS}, w AS (SELECT action, count(*) AS quota FROM ev WHERE corpus='attack' GROUP BY 1),
r AS (SELECT event_id, action, quota, row_number() OVER (PARTITION BY action ORDER BY {hx(13, 'event_id')}, event_id) AS pick FROM ev JOIN w USING (action) WHERE corpus='benign') SELECT event_id, action, pick FROM r WHERE pick <= quota""")
def j16_quota_by_key(spark, d):
    e = t.events(spark, d)
    return sampling.quota_match(e.where("corpus = 'attack'"), e.where("corpus = 'benign'").select("event_id", "action"), ["action"], "event_id", 13).select("event_id", "action", "pick")


SPLIT_SQL = f"sp AS (SELECT doc_id, source, CASE WHEN {u('$$17:$$||source')} < 0.2 THEN 'calibration' WHEN {u('$$17:$$||source')} < 0.2::DOUBLE+0.1::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM documents)".replace("$$", "'")


def _split(spark, d):
    return sampling.grouped_split(t.read(spark, d, "documents").select("doc_id", "source"), F.col("source"), 17)


@query(f"WITH {SPLIT_SQL} SELECT doc_id, source, split FROM sp")
def v1_grouped_split(spark, d):
    return _split(spark, d)


@query(f"WITH {SPLIT_SQL} SELECT source, count(DISTINCT split) AS splits FROM sp GROUP BY 1 HAVING count(DISTINCT split) > 1")
def u7_split_overlap(spark, d):
    return sampling.split_overlap(_split(spark, d), "source")


@query(f"WITH {SPLIT_SQL} SELECT split, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)) AS digest, count(*) AS n FROM sp GROUP BY 1")
def a27_digest(spark, d):
    return sampling.partition_digest(_split(spark, d), "split", "doc_id")


@query(f"""WITH {VOTED}, s AS (SELECT i.source, p.gold, p.label FROM p JOIN items i USING (item_id))
SELECT source, count(*) AS n, count(*) FILTER (gold='toxic' AND label='toxic') AS tp, count(*) FILTER (gold='clean' AND label='toxic') AS fp, count(*) FILTER (gold='toxic' AND label='clean') AS fn FROM s GROUP BY 1""")
def v4_cluster_stats(spark, d):
    p = _predictions(spark, d).join(t.items(spark, d).select("item_id", "source"), "item_id")
    c = lambda g, q: F.sum(((F.col("gold") == g) & (F.col("label") == q)).cast("long"))
    return p.groupBy("source").agg(F.count(F.lit(1)).alias("n"), c("toxic", "toxic").alias("tp"), c("clean", "toxic").alias("fp"), c("toxic", "clean").alias("fn"))


# joins


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j2_semi(spark, d):
    return t.read(spark, d, "customer").select("c_custkey").join(t.read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j4_anti(spark, d):
    return t.read(spark, d, "customer").select("c_custkey").join(t.read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query(f"""WITH {EVENTS}, a AS (SELECT event_id AS anchor, host, ms AS t0 FROM ev WHERE action='ERROR'),
m AS (SELECT anchor, event_id, t0-ms AS before_ms, row_number() OVER (PARTITION BY anchor ORDER BY ms DESC, event_id DESC) AS rank FROM a JOIN ev ON ev.host=a.host AND ms BETWEEN t0-86400000 AND t0 AND event_id<>anchor)
SELECT anchor, event_id, before_ms, rank FROM m WHERE rank <= 5""")
def j7_lookback_hop(spark, d):
    e = t.events(spark, d)
    a = e.where("action = 'ERROR'").select(F.col("event_id").alias("anchor"), F.col("host").alias("entity"), F.col("ms").alias("at"))
    return joins.look_back(a, e.select("event_id", F.col("host").alias("entity"), "ms"), 86_400_000, 5)


# ordered rows

W1_SQL = """one AS (SELECT 'host' AS rel, host::VARCHAR AS val, event_id, ms, 0.08::DOUBLE AS w FROM ev UNION ALL SELECT 'entity', object::VARCHAR, event_id, ms, 1.0::DOUBLE FROM ev),
nx AS (SELECT rel, w, event_id, ms, lead(event_id) OVER g AS nxt, lead(ms) OVER g AS nms FROM one WINDOW g AS (PARTITION BY rel, val ORDER BY ms, event_id)),
pr AS (SELECT least(event_id,nxt) AS src, greatest(event_id,nxt) AS dst, w*exp(-(nms-ms)/1800000.0::DOUBLE) AS step, CASE rel WHEN 'host' THEN 'host' ELSE 'object' END AS role, nms-ms AS gap FROM nx WHERE nms-ms <= 1800000),
edges AS (SELECT src, dst, round(sum(step),6) AS weight, list_sort(list_distinct(list(role))) AS reasons, min(gap) AS gap_ms FROM pr GROUP BY 1,2)"""


def _edges(spark, d):
    e = t.events(spark, d)
    roles = F.array(
        F.struct(F.lit("host").alias("relation"), F.col("host").cast("string").alias("value"), F.lit("host").alias("role")),
        F.struct(F.lit("entity").alias("relation"), F.col("object").cast("string").alias("value"), F.lit("object").alias("role")),
    )
    return temporal.correlate(e.select("event_id", "ms", F.inline(roles)), {"entity": 1.0, "principal": 0.35, "host": 0.08})


@query(f"WITH {EVENTS}, {W1_SQL} SELECT src, dst, weight, array_to_string(reasons, ',') AS reasons, gap_ms FROM edges")
def w1_correlate(spark, d):
    return _edges(spark, d).withColumn("reasons", F.array_join("reasons", ","))


@query("""WITH c AS (SELECT conv_id*1000+turn AS node, role, conv_id, turn FROM conversations),
a AS (SELECT node AS src, lead(node) OVER (PARTITION BY conv_id, role ORDER BY turn) AS dst, exp(-(lead(turn) OVER (PARTITION BY conv_id, role ORDER BY turn)-turn)/8.0::DOUBLE) AS weight FROM c),
b AS (SELECT node AS src, lead(node) OVER (PARTITION BY conv_id ORDER BY turn) AS dst, 0.15::DOUBLE*exp(-(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn)-turn)/8.0::DOUBLE) AS weight FROM c)
SELECT src, dst, round(sum(weight),6) AS weight FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE dst IS NOT NULL GROUP BY 1,2""")
def w3_doc_adjacency(spark, d):
    c = t.read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node"), "role", "conv_id", "turn")
    inside = temporal.chain(c, ["conv_id", "role"], ["turn"], "node", "turn", 1.0, 8.0)
    across = temporal.chain(c, ["conv_id"], ["turn"], "node", "turn", 0.15, 8.0)
    return inside.unionByName(across).groupBy("src", "dst").agg(F.round(F.sum("weight"), 6).alias("weight"))


@query(f"""WITH {EVENTS}, r AS (SELECT event_id, day, corpus, percent_rank() OVER g AS r, row_number() OVER g AS n FROM ev WINDOW g AS (PARTITION BY day, corpus ORDER BY ms, event_id))
SELECT event_id, day, CAST(row_number() OVER (ORDER BY day, round(r,12), sha256('17:'||corpus), n, event_id)*1000 AS BIGINT) AS place FROM r""")
def w5_replay_merge(spark, d):
    return temporal.replay_merge(t.events(spark, d), 17)


@query("WITH o AS (SELECT o_orderpriority, epoch_us(o_orderdate::TIMESTAMP)//1000 AS ms, lag(epoch_us(o_orderdate::TIMESTAMP)//1000) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS b FROM orders) SELECT o_orderpriority, count(*) AS rows, coalesce(sum((ms<b)::INT),0)::BIGINT AS reversals FROM o GROUP BY 1")
def w6_reversals(spark, d):
    o = t.read(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms"))
    return temporal.reversals(o, ["o_orderpriority"], "o_orderkey", "ms")


@query(f"WITH {EVENTS} SELECT event_id, corpus, ms//86400000 AS bucket, CAST((row_number() OVER (PARTITION BY corpus, ms//86400000 ORDER BY ms, event_id)-1)//48 AS BIGINT) AS chunk FROM ev")
def w7_chunks(spark, d):
    return temporal.chunks(t.events(spark, d), "corpus", "ms", "event_id", minutes=1440)


ADJ_SQL = "adj AS (SELECT node, nbr, round(sum(weight),6) AS weight FROM (SELECT src AS node, dst AS nbr, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges) GROUP BY 1,2)"


@query(f"""WITH {EVENTS}, {W1_SQL}, {ADJ_SQL}, c AS (SELECT node, nbr, weight, 1.0::DOUBLE - coalesce(sum(weight) OVER (PARTITION BY node ORDER BY weight DESC, nbr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS lf FROM adj)
SELECT node, nbr, round(least(weight,lf),6) AS capped FROM c WHERE lf > 1e-12""")
def w8_capped_neighbors(spark, d):
    return temporal.capped(graphs.adjacency(_edges(spark, d)), "node", "nbr", "weight", 1.0)


def _persistence_sql(delay: int) -> str:
    return f"""WITH {EVENTS}, a AS (SELECT event_id, host, action, {u("'991:'||event_id")} < 0.5 AS audited FROM ev)
SELECT event_id, last_value(CASE WHEN audited THEN action END IGNORE NULLS) OVER (PARTITION BY host ORDER BY event_id RANGE BETWEEN UNBOUNDED PRECEDING AND {delay + 1} PRECEDING) AS previous FROM a"""


def _persistence(delay: int):
    def run(spark, d):
        audited = unit_draw(F.concat(F.lit("991:"), F.col("event_id"))) < 0.5
        return temporal.persistence(t.events(spark, d), "host", "event_id", F.col("action"), audited, delay).select("event_id", "previous")

    run.__name__ = f"w9_persistence_d{delay}"
    return query(_persistence_sql(delay))(run)


for _delay in (0, 1, 5, 20):
    _persistence(_delay)


@query(f"""WITH {EVENTS}, l AS (SELECT lag(action) OVER (PARTITION BY host ORDER BY ms, event_id) AS previous, action AS value FROM ev), n AS (SELECT previous, value, count(*) AS n FROM l WHERE previous IS NOT NULL GROUP BY ALL)
SELECT previous, value, n, round((n+1)/(sum(n) OVER (PARTITION BY previous)+count(*) OVER (PARTITION BY previous))::DOUBLE,6) AS prob FROM n""")
def w10_transitions(spark, d):
    return temporal.transitions(t.events(spark, d), "host", ["ms", "event_id"], "action")


@query(f"""WITH {EVENTS}, w AS (SELECT event_id, lag(event_id,1) OVER g AS a, lag(event_id,2) OVER g AS b FROM ev WINDOW g AS (PARTITION BY host, action ORDER BY ms, event_id))
SELECT event_id, concat_ws(',', a, b) AS recent, round(CASE WHEN a IS NULL THEN 0 ELSE 0.35::DOUBLE END + CASE WHEN b IS NULL THEN 0 ELSE 0.35::DOUBLE/2 END,6) AS recent_weight FROM w""")
def w11_recent_k(spark, d):
    return temporal.recent(t.events(spark, d), ["host", "action"], ["ms", "event_id"], "event_id").select("event_id", "recent", "recent_weight")


@query(f"""WITH {EVENTS}, i AS (SELECT day, corpus, row_number() OVER (PARTITION BY day ORDER BY ms, event_id) - row_number() OVER (PARTITION BY day, corpus ORDER BY ms, event_id) AS island FROM ev)
SELECT day, corpus, max(n) AS longest FROM (SELECT day, corpus, island, count(*) AS n FROM i GROUP BY ALL) GROUP BY ALL""")
def w12_runs(spark, d):
    return temporal.longest_runs(t.events(spark, d), "day", ["ms", "event_id"], "corpus")


# graphs


@query(f"""WITH {EVENTS}, n AS (SELECT 'entity:'||host AS node, '1actor' AS k FROM ev UNION ALL SELECT 'entity:'||object, '2entity' FROM ev UNION ALL SELECT 'event:'||event_id, '3event' FROM ev UNION ALL SELECT 'host:'||corpus, '4host' FROM ev)
SELECT node, substr(min(k),2) AS kind FROM n GROUP BY 1""")
def g1_provenance_nodes(spark, d):
    return _provenance(spark, d)[0]


@query(f"""WITH {EVENTS} SELECT 'entity:'||host AS src, 'event:'||event_id AS dst, 'acts' AS relation, ms, event_id FROM ev UNION ALL SELECT 'event:'||event_id, 'entity:'||object, 'targets', ms, event_id FROM ev UNION ALL SELECT 'host:'||corpus, 'event:'||event_id, 'hosts', ms, event_id FROM ev""")
def g1_provenance_edges(spark, d):
    return _provenance(spark, d)[1]


def _provenance(spark, d):
    return graphs.provenance(t.events(spark, d).select("event_id", "ms", F.col("host").alias("actor"), "object", F.col("corpus").alias("host")))


@query(f"WITH {EVENTS}, {W1_SQL}, {ADJ_SQL} SELECT node, nbr, weight FROM adj")
def g4_adjacency(spark, d):
    return graphs.adjacency(_edges(spark, d))


@query(f"WITH {EVENTS}, {W1_SQL}, n AS (SELECT event_id FROM ev WHERE action IN ('ERROR','VIEW')) SELECT src, dst FROM edges WHERE src IN (SELECT event_id FROM n) AND dst IN (SELECT event_id FROM n)")
def g5_induced_edges(spark, d):
    return graphs.induced(_edges(spark, d), t.events(spark, d).where("action in ('ERROR', 'VIEW')").select(F.col("event_id").alias("node")))


STRONG = "weight > 0.9"


@query(f"""WITH RECURSIVE {EVENTS}, {W1_SQL}, st AS (SELECT src, dst FROM edges WHERE {STRONG}), a AS (SELECT src AS node, dst AS nbr FROM st UNION SELECT dst, src FROM st),
w(node, c) AS (SELECT DISTINCT node, node FROM a UNION SELECT a.nbr, w.c FROM w JOIN a ON a.node=w.node) SELECT node, min(c) AS component FROM w GROUP BY 1""")
def g6_components(spark, d):
    adj = graphs.kept(graphs.adjacency(_edges(spark, d).where(STRONG)))
    return graphs.components(adj, adj.select("node").distinct())


VALUE_SQL = "va AS (SELECT event_id AS node, least(0.999::DOUBLE, greatest(0.001::DOUBLE, round(value/50.0::DOUBLE,6))) AS value FROM ev)"


def _values(spark, d):
    return t.events(spark, d).select(F.col("event_id").alias("node"), mathx.clip(F.round(F.col("value") / 50.0, 6), 0.001, 0.999).alias("value"))


@query(f"""WITH {EVENTS}, {W1_SQL}, {ADJ_SQL}, {VALUE_SQL}, m AS (SELECT adj.node, sum(weight*value)/sum(weight) AS m FROM adj JOIN va ON va.node=adj.nbr GROUP BY 1), x AS (SELECT va.node, coalesce(m, value) AS m FROM va LEFT JOIN m USING (node))
SELECT node, round(m,6) AS mean, round(ln(m/(1-m)),6) AS logit FROM x""")
def g7_neighbor_mean(spark, d):
    return graphs.neighbour_mean(graphs.adjacency(_edges(spark, d)), _values(spark, d))


def _bp_sql(rounds: int = 6) -> str:
    parts = ["b0 AS (SELECT node, value AS p FROM va)"]
    for k in range(rounds):
        parts.append(f"""b{k + 1} AS (SELECT va.node, least(1-1e-6::DOUBLE, greatest(1e-6::DOUBLE, 1/(1+exp(-(ln(value/(1-value)) + 0.4::DOUBLE*ln(q/(1-q))))))) AS p FROM
(SELECT va.node, va.value, least(1-1e-6::DOUBLE, greatest(1e-6::DOUBLE, coalesce(m, 0.5::DOUBLE))) AS q FROM va LEFT JOIN (SELECT adj.node, sum(weight*b{k}.p)/sum(weight) AS m FROM adj JOIN b{k} ON b{k}.node=adj.nbr GROUP BY 1) USING (node)) va)""")
    return f"WITH {EVENTS}, {W1_SQL}, {ADJ_SQL}, {VALUE_SQL}, {', '.join(parts)} SELECT node, round(p,6) AS posterior FROM b{rounds}"


@query(_bp_sql())
def g10_belief_prop(spark, d):
    return graphs.belief_propagation(graphs.kept(graphs.adjacency(_edges(spark, d))), _values(spark, d), 0.4)


# operational metrics

PRED_SQL = f"pe AS (SELECT *, corpus='attack' AS gold, {u('$$pred|$$||event_id')} < CASE WHEN corpus='attack' THEN 0.4 ELSE 0.1 END AS pred FROM ev)".replace("$$", "'")


@query(f"""WITH {EVENTS}, {PRED_SQL}, h AS (SELECT host, min(ms) FILTER (gold) AS first_gold, min(ms) FILTER (gold AND pred) AS first_tp FROM pe GROUP BY 1 HAVING count(*) FILTER (gold) > 0),
b AS (SELECT count(*)*0.5::DOUBLE AS hours FROM (SELECT DISTINCT host, ms//1800000 FROM pe WHERE NOT gold)), f AS (SELECT count(*) AS n FROM pe WHERE NOT gold AND pred)
SELECT count(*) AS hosts, count(first_tp) AS detected, round(count(first_tp)/count(*)::DOUBLE,6) AS detection_rate, round(avg((first_tp-first_gold)/1000.0::DOUBLE),6) AS mean_delay_s, round(quantile_cont((first_tp-first_gold)/1000.0::DOUBLE,0.5),6) AS median_delay_s, (SELECT n FROM f) AS false_alerts, (SELECT hours FROM b) AS benign_hours, round((SELECT n FROM f)/(SELECT hours FROM b),6) AS false_alerts_per_hour FROM h""")
def a5_host_detection(spark, d):
    draw = unit_draw(F.concat(F.lit("pred|"), F.col("event_id")))
    p = t.events(spark, d).withColumns({"gold": F.col("corpus") == "attack", "pred": draw < F.when(F.col("corpus") == "attack", 0.4).otherwise(0.1)})
    first = lambda c: F.min(F.when(c, F.col("ms")))
    h = p.groupBy("host").agg(first(F.col("gold")).alias("g"), first(F.col("gold") & F.col("pred")).alias("tp")).where("g is not null")
    delay = (F.col("tp") - F.col("g")) / 1000.0
    n, k = F.count(F.lit(1)), F.count("tp")
    a = h.agg(n.alias("hosts"), k.alias("detected"), F.round(k / n, 6).alias("detection_rate"), F.round(F.avg(delay), 6).alias("mean_delay_s"), F.round(F.percentile(delay, F.lit(0.5)), 6).alias("median_delay_s"))
    b = p.where("not gold").groupBy("host", F.floor(F.col("ms") / 1800000).alias("w")).agg(F.sum(F.col("pred").cast("long")).alias("f")).agg(F.sum("f").alias("false_alerts"), (F.count(F.lit(1)) * 0.5).alias("benign_hours"))
    return a.join(b).withColumn("false_alerts_per_hour", F.round(F.col("false_alerts") / F.col("benign_hours"), 6))


# rows


@query(f"WITH {EVENTS} SELECT event_id, regexp_replace(upper(regexp_replace(' Host '||host||'.systemia.com', '\\s+', '', 'g')), '\\.SYSTEMIA\\.COM$', '') AS hostname FROM ev")
def p1_normalize(spark, d):
    return t.events(spark, d).select("event_id", text.hostname(F.concat(F.lit(" Host "), F.col("host"), F.lit(".systemia.com"))).alias("hostname"))


@query(r"""SELECT doc_id, CASE WHEN trim(y)<>'' THEN y END AS redacted FROM (SELECT doc_id, regexp_replace(regexp_replace(substr(x,1,300), '(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b', '<GUID>', 'g'), '\b\d{4}-\d{2}-\d{2}\b', '<DATE>', 'g') AS y FROM
(SELECT doc_id, '2019-09-23 '||substr(md5(doc_id::VARCHAR),1,8)||'-'||substr(md5(doc_id::VARCHAR),9,4)||'-'||substr(md5(doc_id::VARCHAR),13,4)||'-'||substr(md5(doc_id::VARCHAR),17,4)||'-'||substr(md5(doc_id::VARCHAR),21,12)||' '||text AS x FROM documents))""")
def p6_redact(spark, d):
    h = F.md5(F.col("doc_id").cast("string"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return t.read(spark, d, "documents").select("doc_id", text.redacted(F.concat(F.lit("2019-09-23 "), uuid, F.lit(" "), F.col("text"))).alias("redacted"))


@query(f"WITH {ITEMS} SELECT item_id, CASE WHEN difficulty < -0.25 THEN 'easy' WHEN difficulty < 0.3 THEN 'medium' ELSE 'hard' END AS bucket FROM items")
def p9_bucket(spark, d):
    x = F.col("difficulty")
    return t.items(spark, d).select("item_id", F.when(x < -0.25, "easy").when(x < 0.3, "medium").otherwise("hard").alias("bucket"))


@query(f"WITH {EVENTS} SELECT event_id, CASE WHEN event_id%2=0 THEN 'document:'||object ELSE 'incident-window:'||corpus||':'||host||':'||(ms//1800000) END AS group_id FROM ev")
def p12_group_id(spark, d):
    document = F.when(F.col("event_id") % 2 == 0, F.col("object").cast("string"))
    return t.events(spark, d).select("event_id", text.group_id(document, F.col("corpus"), F.col("host").cast("string"), F.col("ms")).alias("group_id"))


@query(f"WITH {EVENTS} SELECT event_id, 'cp-'||substr(sha256(corpus||chr(31)||host||chr(31)||ms),1,20) AS id, sha256(host||chr(0)||object) AS scoped, {hx(17, 'event_id')} AS rank_hex FROM ev")
def f6_stable_ids(spark, d):
    s = lambda c: F.col(c).cast("string")
    return t.events(spark, d).select("event_id", stable_id("cp", s("corpus"), s("host"), s("ms")).alias("id"), scoped_id(s("host"), s("object")).alias("scoped"), hex_rank(17, s("event_id")).alias("rank_hex"))


@query(f"WITH {EVENTS} SELECT event_id, round((value/50*object + ln(event_id+2)*0.5)/(object+ln(event_id+2)),6) AS smoothed FROM ev")
def f17_laplace(spark, d):
    return t.events(spark, d).select("event_id", F.round(mathx.laplace_smooth(F.col("value") / 50, F.col("object"), F.col("event_id") + 1), 6).alias("smoothed"))


@query(f"""WITH {EVENTS}, g AS (SELECT host, count(*) AS n, count(*) FILTER (action='ERROR') AS k FROM ev GROUP BY 1), w AS (SELECT host, n, k, k/n::DOUBLE AS p, 1.959963984540054::DOUBLE AS z FROM g)
SELECT host, n, k, round(greatest(0,(p+z*z/(2*n)-z*sqrt(p*(1-p)/n+z*z/(4*n*n)))/(1+z*z/n)),6) AS low, round(least(1,(p+z*z/(2*n)+z*sqrt(p*(1-p)/n+z*z/(4*n*n)))/(1+z*z/n)),6) AS high FROM w""")
def f18_wilson(spark, d):
    g = t.events(spark, d).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("action") == "ERROR").cast("long")).alias("k"))
    low, high = mathx.wilson(F.col("k"), F.col("n"))
    return g.select("host", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""WITH {EVENTS}, p AS (SELECT event_id, (object+1)/102.0::DOUBLE AS a, (value+1)/(value+60) AS b FROM ev)
SELECT event_id, round(-a*ln(a)-(1-a)*ln(1-a),6) AS entropy, round(0.5*(a*ln(2*a/(a+b))+(1-a)*ln(2*(1-a)/(2-a-b))+b*ln(2*b/(a+b))+(1-b)*ln(2*(1-b)/(2-a-b))),6)+0.0 AS js, round(abs(2*a-1),6) AS margin FROM p""")
def f15_entropy_js(spark, d):
    a, b = (F.col("object") + 1) / 102.0, (F.col("value") + 1) / (F.col("value") + 60)
    p, q = F.array(a, 1 - a), F.array(b, 1 - b)
    return t.events(spark, d).select("event_id", F.round(mathx.entropy(p), 6).alias("entropy"), (F.round(mathx.js_divergence(p, q), 6) + 0.0).alias("js"), F.round(mathx.margin(p), 6).alias("margin"))


@query("SELECT doc_id, greatest(1, (strlen(text)+3)//4)::BIGINT AS tokens, CASE WHEN length(text)>200 THEN substr(text,1,197)||'...' ELSE text END AS cut FROM documents")
def f21_tokens(spark, d):
    return t.read(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"), text.truncated(F.col("text"), 200).alias("cut"))


@query(f"WITH {EVENTS} SELECT day, corpus, action, count(*) AS n, round(sum(value),6) AS total FROM ev GROUP BY ALL")
def a17_day_counts(spark, d):
    return t.events(spark, d).groupBy("day", "corpus", "action").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(f"WITH {EVENTS} SELECT object FROM ev GROUP BY 1 HAVING count(DISTINCT corpus) > 1")
def a15_shared_ids(spark, d):
    return t.events(spark, d).groupBy("object").agg(F.count_distinct("corpus").alias("k")).where("k > 1").select("object")


@query(f"""WITH {EVENTS}, {W1_SQL}, {ADJ_SQL}, g AS (SELECT node, count(*) AS deg FROM adj GROUP BY 1), n AS (SELECT count(*) AS n FROM ev), e AS (SELECT count(*) AS m FROM edges)
SELECT n, m AS edges, (SELECT n-count(*) FROM g) AS isolates, round(2.0*m/n,6) AS mean_degree, (SELECT max(deg) FROM g) AS max_degree, round(2.0*m/(n::DOUBLE*(n-1)),9) AS density FROM n, e""")
def a21_graph_diagnostics(spark, d):
    adj = graphs.adjacency(_edges(spark, d)).groupBy("node").agg(F.count(F.lit(1)).alias("deg"))
    deg = t.events(spark, d).select(F.col("event_id").alias("node")).join(adj, "node", "left").agg(F.count(F.lit(1)).alias("n"), (F.sum("deg") / 2).cast("long").alias("edges"), F.sum(F.col("deg").isNull().cast("long")).alias("isolates"), F.max("deg").alias("max_degree"))
    n, m = F.col("n").cast("double"), F.col("edges").cast("double")
    return deg.select("n", "edges", "isolates", F.round(2 * m / n, 6).alias("mean_degree"), "max_degree", F.round(2 * m / (n * (n - 1)), 9).alias("density"))


@query(f"""WITH {EVENTS}, {W1_SQL} SELECT a.corpus AS parent, b.corpus AS child, count(*) AS n, round(sum(weight),6) AS weight FROM edges JOIN ev a ON a.event_id=src JOIN ev b ON b.event_id=dst GROUP BY 1,2""")
def a22_edge_labels(spark, d):
    e = t.events(spark, d)
    j = _edges(spark, d).join(e.select(F.col("event_id").alias("src"), F.col("corpus").alias("parent")), "src").join(e.select(F.col("event_id").alias("dst"), F.col("corpus").alias("child")), "dst")
    return j.groupBy("parent", "child").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight"))
