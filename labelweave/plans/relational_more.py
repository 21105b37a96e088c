"""More queries over the driver's tables with their SQL: evidence, audits, calibration tables, prompts, star joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from labelweave.functions import mathx, text
from labelweave.functions.hashing import unit_draw
from labelweave.operators import graphs, joins
from labelweave.plans import relational as r
from labelweave.plans.relational import ADJ_SQL, EVENTS, ITEMS, PRED_SQL, RESPONSES, VALUE_SQL, VOTED, W1_SQL, hx, u
from labelweave.sources import tables as t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"WITH {EVENTS}, {W1_SQL} SELECT CASE WHEN (a.ms,a.event_id)<=(b.ms,b.event_id) THEN src ELSE dst END AS parent, CASE WHEN (a.ms,a.event_id)<=(b.ms,b.event_id) THEN dst ELSE src END AS child, weight FROM edges JOIN ev a ON a.event_id=src JOIN ev b ON b.event_id=dst")
def j17_edge_direction(spark, d):
    e = t.events(spark, d)
    m = r._edges(spark, d).join(e.select(F.col("event_id").alias("src"), F.col("ms").alias("a")), "src").join(e.select(F.col("event_id").alias("dst"), F.col("ms").alias("b")), "dst")
    first = F.struct("a", "src") <= F.struct("b", "dst")
    return m.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("parent"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("child"), "weight")


@query(f"WITH {EVENTS}, {PRED_SQL}, {W1_SQL}, g AS (SELECT event_id FROM pe WHERE gold), p AS (SELECT event_id FROM pe WHERE pred), ge AS (SELECT src,dst FROM edges WHERE src IN (SELECT * FROM g) AND dst IN (SELECT * FROM g)), qe AS (SELECT src,dst FROM edges WHERE src IN (SELECT * FROM p) AND dst IN (SELECT * FROM p)), c AS (SELECT count(*) AS k FROM (SELECT * FROM ge INTERSECT SELECT * FROM qe)) SELECT (SELECT count(*) FROM ge) AS gold, (SELECT count(*) FROM qe) AS predicted, k AS correct, round(CASE WHEN (SELECT count(*) FROM qe)>0 THEN k/(SELECT count(*) FROM qe)::DOUBLE ELSE 0 END,6) AS precision, round(CASE WHEN (SELECT count(*) FROM ge)>0 THEN k/(SELECT count(*) FROM ge)::DOUBLE ELSE 0 END,6) AS recall FROM c")
def u3_edge_overlap(spark, d):
    """Edges induced by the predicted nodes against those induced by the true ones."""
    draw = unit_draw(F.concat(F.lit("pred|"), F.col("event_id")))
    p = t.events(spark, d).withColumns({"gold": F.col("corpus") == "attack", "pred": draw < F.when(F.col("corpus") == "attack", 0.4).otherwise(0.1)})
    e = r._edges(spark, d)
    side = lambda c: graphs.induced(e, p.where(c).select(F.col("event_id").alias("node")))
    both = side("gold").withColumn("g", F.lit(1)).join(side("pred").withColumn("p", F.lit(1)), ["src", "dst"], "full_outer")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    k = both.agg(n(F.col("g")).alias("gold"), n(F.col("p")).alias("predicted"), n(F.col("g") * F.col("p")).alias("correct"))
    share = lambda a, b: F.round(mathx.ratio(F.col(a).cast("double"), F.col(b)), 6)
    return k.select("gold", "predicted", "correct", share("correct", "predicted").alias("precision"), share("correct", "gold").alias("recall"))


@query("SELECT o_custkey AS custkey FROM orders WHERE o_orderpriority LIKE '1%' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '5%'")
def u4_difference(spark, d):
    o = t.read(spark, d, "orders")
    side = lambda x: o.where(F.col("o_orderpriority").startswith(x)).select(F.col("o_custkey").alias("custkey"))
    return side("1").subtract(side("5"))


@query(f"""WITH {RESPONSES}, w AS (SELECT item_id, any_value(doc_id) AS doc_id, any_value(gold) AS gold, any_value(source) AS source, max(vote) FILTER (model_id='reader')||'|'||max(vote) FILTER (model_id='board') AS pattern FROM responses GROUP BY 1),
x AS (SELECT lag(gold) OVER (PARTITION BY source ORDER BY doc_id) AS previous, pattern, gold FROM w), n AS (SELECT previous, pattern, gold, count(*)::DOUBLE AS n FROM x WHERE previous IS NOT NULL GROUP BY ALL),
c AS (SELECT previous, n, sum(n) OVER (PARTITION BY previous) AS w, sum(n) OVER (PARTITION BY previous, gold) AS g, sum(n) OVER (PARTITION BY previous, pattern) AS v FROM n) SELECT previous, round(greatest(0,sum(n/w*ln(n*w/(g*v)))),6) AS mi FROM c GROUP BY 1""")
def a9_pattern_mi(spark, d):
    """What a vote pattern tells of the label, by the label before in the source."""
    wide = r._responses(spark, d).groupBy("doc_id").agg(F.max("gold").alias("gold"), F.max("source").alias("source"), F.concat_ws("|", F.max(F.when(F.col("model_id") == "reader", F.col("vote"))), F.max(F.when(F.col("model_id") == "board", F.col("vote")))).alias("pattern"))
    x = wide.select(F.lag("gold").over(Window.partitionBy("source").orderBy("doc_id")).alias("previous"), "pattern", "gold").where("previous is not null")
    n = x.groupBy("previous", "pattern", "gold").agg(F.count(F.lit(1)).cast("double").alias("n"))
    w, g, v = (F.sum("n").over(Window.partitionBy("previous", *by)) for by in ((), ("gold",), ("pattern",)))
    c = n.select("previous", (F.col("n") / w * F.log(F.col("n") * w / (g * v))).alias("x"))
    return c.groupBy("previous").agg(F.round(F.greatest(F.lit(0.0), F.sum("x")), 6).alias("mi"))


@query(f"WITH {EVENTS}, {W1_SQL} SELECT round((1+coalesce(sum(weight*(a.corpus=b.corpus)::INT),0))/(2+coalesce(sum(weight),0)),6) AS potential FROM edges JOIN ev a ON a.event_id=src JOIN ev b ON b.event_id=dst")
def a23_same_label(spark, d):
    e = t.events(spark, d)
    m = r._edges(spark, d).join(e.select(F.col("event_id").alias("src"), F.col("corpus").alias("a")), "src").join(e.select(F.col("event_id").alias("dst"), F.col("corpus").alias("b")), "dst")
    z = F.lit(0.0)
    return m.agg(F.round((1 + F.coalesce(F.sum(F.col("weight") * (F.col("a") == F.col("b")).cast("int")), z)) / (2 + F.coalesce(F.sum("weight"), z)), 6).alias("potential"))


@query(f"WITH {RESPONSES} SELECT model_id, round(sum(cost),6) AS spent, count(*) AS calls, sum((confidence<0.6)::INT)::BIGINT AS failed FROM responses GROUP BY 1")
def a26_budget(spark, d):
    return r._responses(spark, d).groupBy("model_id").agg(F.round(F.sum("cost"), 6).alias("spent"), F.count(F.lit(1)).alias("calls"), F.sum((F.col("confidence") < 0.6).cast("long")).alias("failed"))


@query(f"WITH {RESPONSES} SELECT source, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS sd FROM (SELECT source, doc_id%5 AS seed, avg((vote=gold)::INT::DOUBLE) AS v FROM responses GROUP BY ALL) GROUP BY 1")
def a25_sensitivity(spark, d):
    per = r._responses(spark, d).groupBy("source", (F.col("doc_id") % 5).alias("seed")).agg(F.avg((F.col("vote") == F.col("gold")).cast("double")).alias("v"))
    return per.groupBy("source").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("sd"))


@query(f"""WITH {EVENTS}, {W1_SQL}, {VALUE_SQL}, pc AS (SELECT CASE WHEN (a.ms,a.event_id)<=(b.ms,b.event_id) THEN src ELSE dst END AS parent, CASE WHEN (a.ms,a.event_id)<=(b.ms,b.event_id) THEN dst ELSE src END AS node, weight FROM edges JOIN ev a ON a.event_id=src JOIN ev b ON b.event_id=dst),
m AS (SELECT pc.node, sum(weight*value)/sum(weight) AS m FROM pc JOIN va ON va.node=parent GROUP BY 1) SELECT va.node, round(ln(value/(1-value))+0.5::DOUBLE*coalesce(ln(m/(1-m)),0),6) AS score FROM va LEFT JOIN m USING (node)""")
def g8_parent_logit(spark, d):
    """A node's own logit and half that of its parents' weighted mean: only earlier nodes count."""
    pc = j17_edge_direction(spark, d)
    v = r._values(spark, d)
    m = pc.join(v.select(F.col("node").alias("parent"), F.col("value").alias("q")), "parent").groupBy(F.col("child").alias("node")).agg((F.sum(F.col("weight") * F.col("q")) / F.sum("weight")).alias("m"))
    j = v.join(m, "node", "left")
    return j.select("node", F.round(mathx.logit(F.col("value")) + 0.5 * F.when(F.col("m").isNotNull(), mathx.logit(F.col("m"))).otherwise(0.0), 6).alias("score"))


@query(r"""WITH x AS (SELECT doc_id, source, text FROM documents) SELECT source, count(*) AS n, sum(regexp_matches(text,'(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b')::INT)::BIGINT AS uuids, sum(regexp_matches(text,'\b\d{4}-\d{2}-\d{2}\b')::INT)::BIGINT AS dates, sum(regexp_matches(text,'[a-z0-9.]+@[a-z0-9.]+\.[a-z]+')::INT)::BIGINT AS addresses FROM x GROUP BY 1""")
def v15_leakage_audit(spark, d):
    x = t.read(spark, d, "documents")
    hit = lambda p: F.sum(F.col("text").rlike(p).cast("long"))
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("n"), hit(text.UUID).alias("uuids"), hit(text.DATE).alias("dates"), hit(r"[a-z0-9.]+@[a-z0-9.]+\.[a-z]+").alias("addresses"))


@query(f"""WITH {EVENTS}, {W1_SQL}, {ADJ_SQL}, {VALUE_SQL}, f AS (SELECT va.node, value AS y, round(coalesce((SELECT sum(weight*v2.value)/sum(weight) FROM adj JOIN va v2 ON v2.node=adj.nbr WHERE adj.node=va.node), value),6) AS f FROM va)
SELECT round((SELECT sum((f-y)*(f-y)) FROM f) + 0.8::DOUBLE*(SELECT coalesce(sum(weight*(a.f-b.f)*(a.f-b.f)),0) FROM edges JOIN f a ON a.node=src JOIN f b ON b.node=dst),4) AS objective""")
def y18_objective(spark, d):
    """Sum of squared changes and of weighted squared differences along edges, for the neighbours' mean as a smooth."""
    e = r._edges(spark, d)
    f = graphs.neighbour_mean(graphs.adjacency(e), r._values(spark, d)).join(r._values(spark, d), "node")
    own = f.agg(F.sum(F.pow(F.col("mean") - F.col("value"), 2)).alias("own"))
    m = e.join(f.select(F.col("node").alias("src"), F.col("mean").alias("a")), "src").join(f.select(F.col("node").alias("dst"), F.col("mean").alias("b")), "dst")
    return own.join(m.agg(F.coalesce(F.sum(F.col("weight") * F.pow(F.col("a") - F.col("b"), 2)), F.lit(0.0)).alias("edge"))).select(F.round(F.col("own") + 0.8 * F.col("edge"), 4).alias("objective"))


@query(f"WITH {VOTED}, s AS (SELECT item_id, label, weight, sum(weight) OVER (PARTITION BY item_id) AS w FROM sums) SELECT item_id, label, round(weight/w,6) AS share FROM s")
def y3_base_posterior(spark, d):
    x = r._responses(spark, d).groupBy("item_id", F.col("vote").alias("label")).agg(F.round(F.sum("accuracy"), 9).alias("weight"))
    return x.select("item_id", "label", F.round(F.col("weight") / F.sum("weight").over(Window.partitionBy("item_id")), 6).alias("share"))


@query(f"""WITH {RESPONSES}, tr AS (SELECT model_id, (sum((vote=gold)::INT)+1)/(count(*)+2)::DOUBLE AS a FROM responses WHERE doc_id%2=0 GROUP BY 1), te AS (SELECT r.*, a FROM responses r JOIN tr USING (model_id) WHERE doc_id%2=1),
v AS (SELECT item_id, any_value(gold) AS gold, vote, round(sum(ln(a/(1-a))),9) AS w FROM te GROUP BY item_id, vote), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY w DESC, vote) AS rn FROM v), b AS (SELECT model_id FROM tr ORDER BY round(a,9) DESC, model_id LIMIT 1)
SELECT (SELECT round(avg((vote=gold)::INT::DOUBLE),6) FROM te WHERE model_id=(SELECT model_id FROM b)) AS best_single, (SELECT round(avg((vote=gold)::INT::DOUBLE),6) FROM k WHERE rn=1) AS calibrated_vote""")
def d36_static_panel(spark, d):
    """Best single model and calibration-weighted vote, fitted on even documents, scored on odd ones."""
    x = r._responses(spark, d)
    fit = x.where("doc_id % 2 = 0").groupBy("model_id").agg(((F.sum((F.col("vote") == F.col("gold")).cast("long")) + 1) / (F.count(F.lit(1)) + 2)).alias("a"))
    te = x.where("doc_id % 2 = 1").join(F.broadcast(fit), "model_id")  # a row for each model
    best = te.groupBy("model_id").agg(F.max(F.round("a", 9)).alias("a"), F.round(F.avg((F.col("vote") == F.col("gold")).cast("double")), 6).alias("right")).agg(F.min_by("right", F.struct(-F.col("a"), "model_id")).alias("best_single"))
    v = te.groupBy("item_id", "gold", "vote").agg(F.round(F.sum(F.log(F.col("a") / (1 - F.col("a")))), 9).alias("w"))
    top = v.groupBy("item_id", "gold").agg(F.min_by("vote", F.struct(-F.col("w"), "vote")).alias("label"))
    return best.join(top.agg(F.round(F.avg((F.col("label") == F.col("gold")).cast("double")), 6).alias("calibrated_vote")))


@query(f"WITH {EVENTS}, e AS (SELECT event_id, [exp(value/20 - greatest(value/20, object/50.0::DOUBLE, 1)), exp(object/50.0::DOUBLE - greatest(value/20, object/50.0::DOUBLE, 1)), exp(1 - greatest(value/20, object/50.0::DOUBLE, 1))] AS x FROM ev) SELECT event_id, round(x[1]/(x[1]+x[2]+x[3]),6) AS a, round(x[2]/(x[1]+x[2]+x[3]),6) AS b FROM e")
def f16_softmax(spark, d):
    p = mathx.softmax(F.array(F.col("value") / 20, F.col("object") / 50.0, F.lit(1.0)))
    return t.events(spark, d).select("event_id", F.round(p[0], 6).alias("a"), F.round(p[1], 6).alias("b"))


@query(f"WITH {EVENTS} SELECT event_id, 'Event ' || event_id || chr(10) || 'Time: ' || ms || chr(10) || 'Host: ' || host || chr(10) || 'Action: ' || action || chr(10) || 'Object: ' || object || chr(10) || 'Properties: ' || CASE WHEN length('{{\"k\":\"'||object||'\",\"value\":\"'||CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)||'\"}}')>20 THEN substr('{{\"k\":\"'||object||'\",\"value\":\"'||CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)||'\"}}',1,17)||'...' ELSE '{{\"k\":\"'||object||'\",\"value\":\"'||CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)||'\"}}' END AS prompt FROM ev")
def p2_prompt(spark, d):
    props = text.canonical_json(F.create_map(F.lit("value"), F.floor("value").cast("string"), F.lit("k"), F.col("object").cast("string")))
    line = lambda name, c: F.concat(F.lit(name), c.cast("string"))
    p = F.concat_ws("\n", line("Event ", F.col("event_id")), line("Time: ", F.col("ms")), line("Host: ", F.col("host")), line("Action: ", F.col("action")), line("Object: ", F.col("object")), line("Properties: ", text.truncated(props, 20)))
    return t.events(spark, d).select("event_id", p.alias("prompt"))


@query(f"WITH {EVENTS}, f AS (SELECT event_id, CASE event_id%4 WHEN 0 THEN '10.0.'||host%250||'.7' WHEN 1 THEN '192.168.1.'||host%250 WHEN 2 THEN '172.'||(10+host%30)||'.0.1' ELSE '8.8.8.8' END AS ip, CASE WHEN object%2=0 THEN 445 ELSE 8080 END AS port FROM ev) SELECT event_id FROM f WHERE (ip LIKE '10.%' OR ip LIKE '192.168.%' OR (ip LIKE '172.%' AND CAST(split_part(ip,'.',2) AS INT) BETWEEN 16 AND 31)) AND port IN (22,135,139,445,3389,5985,5986)")
def p7_cross_host_flow(spark, d):
    """Flows between private hosts on a port that remote sessions use."""
    k = F.col("event_id") % 4
    s = lambda c: c.cast("string")
    ip = F.when(k == 0, F.concat(F.lit("10.0."), s(F.col("host") % 250), F.lit(".7"))).when(k == 1, F.concat(F.lit("192.168.1."), s(F.col("host") % 250))).when(k == 2, F.concat(F.lit("172."), s(10 + F.col("host") % 30), F.lit(".0.1"))).otherwise("8.8.8.8")
    port = F.when(F.col("object") % 2 == 0, 445).otherwise(8080)
    return t.events(spark, d).where(text.private_ipv4(ip) & port.isin(22, 135, 139, 445, 3389, 5985, 5986)).select("event_id")


@query(f"WITH {ITEMS} SELECT item_id, round(least(0.9::DOUBLE,greatest(-0.8::DOUBLE,difficulty - CASE WHEN lang='en' THEN 0.3 ELSE 0 END + CASE WHEN n_chars<500 THEN 0.15 WHEN n_chars>5000 THEN -0.10 ELSE 0 END)),6) AS score FROM items")
def p10_difficulty(spark, d):
    x = F.col("difficulty") - F.when(F.col("lang") == "en", 0.3).otherwise(0.0) + F.when(F.col("n_chars") < 500, 0.15).when(F.col("n_chars") > 5000, -0.10).otherwise(0.0)
    return t.items(spark, d).select("item_id", F.round(mathx.clip(x, -0.8, 0.9), 6).alias("score"))


@query(f"WITH {EVENTS}, q AS (SELECT event_id, {hx(5, 'event_id')} AS h FROM ev WHERE action='ERROR' AND ms BETWEEN 1704067200000 AND 1705276800000) SELECT event_id FROM q ORDER BY h, event_id LIMIT 20")
def p4_filtered_sample(spark, d):
    from labelweave.operators import sampling

    return sampling.bottom_k(t.events(spark, d).where("action = 'ERROR' and ms between 1704067200000 and 1705276800000").select("event_id"), "event_id", 20, 5).select("event_id")


@query(f"WITH {EVENTS} SELECT event_id, round(CASE WHEN {u(chr(39) + '9:' + chr(39) + '||event_id')} < 0.2 THEN 0.15::DOUBLE+0.25::DOUBLE*{u(chr(39) + '10:' + chr(39) + '||event_id')} ELSE 0.68::DOUBLE+0.27::DOUBLE*{u(chr(39) + '10:' + chr(39) + '||event_id')} END,6) AS score FROM ev")
def y24_synthetic_scores(spark, d):
    draw = lambda s: unit_draw(F.concat(F.lit(f"{s}:"), F.col("event_id")))
    return t.events(spark, d).select("event_id", F.round(F.when(draw(9) < 0.2, 0.15 + 0.25 * draw(10)).otherwise(0.68 + 0.27 * draw(10)), 6).alias("score"))


@query("""SELECT n_name, count(*) AS orders, round(sum(l_extendedprice*(1-l_discount)),2) AS revenue FROM customer JOIN orders ON o_custkey=c_custkey JOIN lineitem ON l_orderkey=o_orderkey JOIN nation ON n_nationkey=c_nationkey GROUP BY 1""")
def t1_revenue_by_nation(spark, d):
    c, o, li, n = (t.read(spark, d, x) for x in ("customer", "orders", "lineitem", "nation"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
