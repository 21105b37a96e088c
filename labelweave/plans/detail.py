"""Queries over whole tables for projections, answers, audits, bootstraps and calibration, each with its SQL where SQL has it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.functions import responses as answers
from labelweave.functions import text
from labelweave.functions.hashing import unit_draw
from labelweave.operators import resampling
from labelweave.plans import relational as r
from labelweave.plans.relational import EVENTS, RESPONSES, VOTED, u
from labelweave.sources import tables as t
from labelweave.sources.tables import LABELS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# projections and functions of a row


@query(f"WITH {EVENTS} SELECT event_id, ms, 'host-'||host AS host, action, NULL::VARCHAR AS actor, NULL::VARCHAR AS object, '{{}}' AS properties FROM ev")
def p3_minimal_event(spark, d):
    """What a label alone says of an event: id, time, host and action, no actor, object or properties."""
    none = F.lit(None).cast("string")
    return t.events(spark, d).select("event_id", "ms", F.concat(F.lit("host-"), F.col("host")).alias("host"), "action", none.alias("actor"), none.alias("object"), F.lit("{}").alias("properties"))


@query(f"""WITH {EVENTS} SELECT event_id, '{{"command_line":"'||substr(repeat('run '||object||' ', 200), 1, 500)||'","file_path":"/data/'||object||'"}}' AS shown FROM ev""")
def p5_safe_properties(spark, d):
    o = F.col("object").cast("string")
    m = F.create_map(F.lit("file_path"), F.concat(F.lit("/data/"), o), F.lit("secret"), F.lit("x"), F.lit("command_line"), F.repeat(F.concat(F.lit("run "), o, F.lit(" ")), 200))
    return t.events(spark, d).select("event_id", text.allowed_properties(m, ("command_line", "file_path", "image_path")).alias("shown"))


KIND_SQL = "k AS (SELECT event_id, CASE WHEN host%2=0 THEN 'REGISTRY' ELSE 'FILE' END AS kind, CASE action WHEN 'ERROR' THEN 'EDIT' WHEN 'PURCHASE' THEN 'WRITE' ELSE action END AS act, CASE WHEN object%3=0 THEN 'C:\\Windows\\System32\\'||object ELSE 'C:\\Users\\'||object END AS path, object%5 AS acuity FROM ev)"


@query(f"WITH {EVENTS}, {KIND_SQL} SELECT event_id, (kind='REGISTRY' AND act IN ('ADD','EDIT','REMOVE')) OR (kind='FILE' AND act IN ('CREATE','WRITE','MODIFY','RENAME','DELETE') AND acuity>=3 AND contains(lower(path), '\\system32\\')) AS sensitive FROM k")
def p8_sensitive_change(spark, d):
    kind = F.when(F.col("host") % 2 == 0, "REGISTRY").otherwise("FILE")
    action = F.when(F.col("action") == "ERROR", "EDIT").when(F.col("action") == "PURCHASE", "WRITE").otherwise(F.col("action"))
    path = F.concat(F.when(F.col("object") % 3 == 0, F.lit("C:\\Windows\\System32\\")).otherwise(F.lit("C:\\Users\\")), F.col("object"))
    return t.events(spark, d).select("event_id", text.sensitive_change(kind, action, path, F.col("object") % 5).alias("sensitive"))


@query(f"""WITH {EVENTS}, g AS (SELECT host, ms//3600000 AS hour, event_id, CASE WHEN action='ERROR' THEN 1 ELSE 0 END + CASE WHEN object>50 THEN 1 ELSE 0 END AS informative, '{{"action":"'||action||'","object":"'||object||'"}}' AS j FROM ev),
k AS (SELECT *, row_number() OVER (PARTITION BY host, hour ORDER BY informative DESC, j, event_id) AS rn, count(*) OVER (PARTITION BY host, hour) AS n FROM g)
SELECT host, hour, 'host: '||host||chr(10)||'rows: '||max(n)||chr(10)||string_agg('log_'||rn||': '||substr(j,1,1200), chr(10) ORDER BY rn)||CASE WHEN max(n)>6 THEN chr(10)||'omitted_rows: '||(max(n)-6) ELSE '' END AS prompt FROM k WHERE rn<=6 GROUP BY host, hour""")
def p13_group_prompt(spark, d):
    """A prompt for each host and hour: its six most informative rows, cut to 1,200 characters, and how many are left out."""
    e = t.events(spark, d).withColumn("hour", F.floor(F.col("ms") / 3600000).cast("long"))
    informative = (F.col("action") == "ERROR").cast("int") + (F.col("object") > 50).cast("int")
    row = text.canonical_json(F.create_map(F.lit("action"), F.col("action"), F.lit("object"), F.col("object").cast("string")))
    e = e.select("host", "hour", "event_id", informative.alias("informative"), row.alias("j"))
    sizes = e.groupBy("host", "hour").agg(F.count(F.lit(1)).alias("n"))
    rn = F.row_number().over(Window.partitionBy("host", "hour").orderBy(F.desc("informative"), "j", "event_id"))
    best = e.withColumn("rn", rn).where("rn <= 6").groupBy("host", "hour").agg(F.array_sort(F.collect_list(F.struct("rn", F.concat(F.lit("log_"), F.col("rn"), F.lit(": "), F.substring("j", 1, 1200)).alias("line")))).alias("rows"))
    out = best.join(sizes, ["host", "hour"])
    lines = F.concat(F.array(F.concat(F.lit("host: "), F.col("host")), F.concat(F.lit("rows: "), F.col("n"))), F.col("rows.line"), F.when(F.col("n") > 6, F.array(F.concat(F.lit("omitted_rows: "), F.col("n") - 6))).otherwise(F.array().cast("array<string>")))
    return out.select("host", "hour", F.array_join(lines, "\n").alias("prompt"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def p16_without_development(spark, d):
    return t.read(spark, d, "documents").select("doc_id").join(t.read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query(f"WITH {EVENTS} SELECT event_id, lpad(host::VARCHAR, 4, '0')||','||lpad(object::VARCHAR, 4, '0') AS codes FROM ev")
def f5_host_codes(spark, d):
    said = F.concat(F.lit("from SysClient"), F.col("host"), F.lit(" to SYSCLIENT"), F.col("object"), F.lit("."))
    return t.events(spark, d).select("event_id", F.array_join(text.host_codes(said), ",").alias("codes"))


@query(f"WITH {EVENTS} SELECT event_id, CASE WHEN event_id%3=0 THEN 'n'||event_id WHEN event_id%3=1 THEN 'e'||event_id ELSE 'item-'||event_id END AS node FROM ev")
def f24_node_key(spark, d):
    """An item's node: graph_node_id, else event_id, else its own id."""
    k = F.col("event_id") % 3
    m = F.when(k == 0, F.create_map(F.lit("graph_node_id"), F.concat(F.lit("n"), F.col("event_id")), F.lit("event_id"), F.lit("no"))).when(k == 1, F.create_map(F.lit("event_id"), F.concat(F.lit("e"), F.col("event_id")))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    e = t.events(spark, d).select("event_id", m.alias("m"))
    return e.select("event_id", F.coalesce(F.try_element_at("m", F.lit("graph_node_id")), F.try_element_at("m", F.lit("event_id")), F.concat(F.lit("item-"), F.col("event_id"))).alias("node"))


@query(f"""WITH {EVENTS} SELECT event_id, CASE WHEN event_id%4=3 THEN NULL ELSE value END AS weight, CASE event_id%4 WHEN 0 THEN 'default' WHEN 1 THEN 'host,object' WHEN 2 THEN lower(action) END AS relations FROM ev""")
def y1_edge_decode(spark, d):
    """Edges written as a number, with relations, with one relation, and with a negative weight."""
    v, k = F.col("value").cast("string"), F.col("event_id") % 4
    raw = F.when(k == 0, v).when(k == 1, F.concat(F.lit('{"weight":'), v, F.lit(',"relations":["object","host","object",""]}'))).when(k == 2, F.concat(F.lit('{"weight":'), v, F.lit(',"relation":"'), F.lower("action"), F.lit('"}'))).otherwise(F.concat(F.lit('{"weight":-'), (F.col("value") + 1).cast("string"), F.lit("}")))
    e = t.events(spark, d).select("event_id", text.edge_weight(raw).alias("e"))
    return e.select("event_id", "e.weight", F.array_join("e.relations", ",").alias("relations"))


@query(f"WITH {EVENTS} SELECT event_id, sig, 'learned_'||split_part(sig, ':', 1) AS relation FROM (SELECT event_id, unnest(list_distinct(CASE WHEN event_id%2=0 THEN ['document:'||object] ELSE []::VARCHAR[] END || ['host:h'||host, 'process:'||lower(action)])) AS sig FROM ev)")
def y2_signatures(spark, d):
    document = F.when(F.col("event_id") % 2 == 0, F.col("object"))
    s = text.signatures(document, {"host": F.concat(F.lit(" H"), F.col("host")), "process": F.col("action"), "user": F.lit("  ")})
    return t.events(spark, d).select("event_id", F.explode(s).alias("sig")).withColumn("relation", F.concat(F.lit("learned_"), F.split_part("sig", F.lit(":"), F.lit(1))))


@query(f"WITH {EVENTS} SELECT event_id, CASE WHEN action='ERROR' THEN 0.01::DOUBLE ELSE 0.05::DOUBLE END AS tolerance FROM ev")
def y15_tolerance(spark, d):
    """The risk that may be left: less for items of a critical severity, in whatever case it is written."""
    return t.events(spark, d).select("event_id", F.when(F.lower(F.initcap("action")).isin("error", "critical"), 0.01).otherwise(0.05).alias("tolerance"))


# answers

ANSWER_SQL = f"a AS (SELECT doc_id, doc_id%5 AS k, round({u("'answer|'||doc_id")}, 6) AS c FROM documents)"


def _answers(spark, d) -> DataFrame:
    k, c = F.col("doc_id") % 5, F.round(unit_draw(F.concat(F.lit("answer|"), F.col("doc_id"))), 6)
    label = F.when(k == 1, F.lit(" Toxic ")).when(k == 2, F.lit("spam")).otherwise(F.lit("CLEAN"))
    confidence = F.when(k == 3, F.lit("1.5")).otherwise(c.cast("decimal(8,6)").cast("string"))
    body = F.concat(F.lit('{"label":"'), label, F.lit('","confidence":'), confidence, F.lit(',"rationale":" seen {twice} ","more":{"evidence_ids":["e2","e1"],"steps":[{"evidence_edges":["x'), F.col("doc_id"), F.lit('"]}]}}'))
    said = F.when(k == 4, F.lit("no answer { here")).otherwise(F.concat(F.lit("I {think} so: "), body, F.lit(" and {}")))
    return t.read(spark, d, "documents").select("doc_id", said.alias("said"))


@query(f"WITH {ANSWER_SQL} SELECT doc_id, CASE k WHEN 0 THEN 'clean' WHEN 1 THEN 'toxic' END AS label, CASE WHEN k<2 THEN c END AS confidence, CASE WHEN k<2 THEN 'seen {{twice}}' END AS rationale, CASE k WHEN 2 THEN 'unknown label' WHEN 3 THEN 'confidence' WHEN 4 THEN 'no object' END AS error FROM a")
def f27_parse_answers(spark, d):
    return _answers(spark, d).select("doc_id", answers.parsed(LABELS)("said").alias("p")).select("doc_id", "p.*")


@query("SELECT doc_id, unnest(CASE WHEN doc_id%5=4 THEN []::VARCHAR[] ELSE ['e1','e2','x'||doc_id] END) AS evidence FROM documents")
def f28_cited_evidence(spark, d):
    return _answers(spark, d).select("doc_id", F.explode(answers.cited("said")).alias("evidence"))


@query("SELECT doc_id, unnest(['missing stage', 'verdict', 'stage', 'review', 'list timeline'] || CASE WHEN doc_id%5=4 THEN ['missing confidence', 'confidence'] WHEN doc_id%5=3 THEN ['confidence', 'evidence x'||doc_id] ELSE ['evidence x'||doc_id] END) AS problem FROM documents")
def f29_answer_problems(spark, d):
    check = answers.problems(("malicious", "benign"), ("entry", "spread"), ("confidence", "stage"), ("timeline",))
    return _answers(spark, d).select("doc_id", F.explode(check("said", F.array(F.lit("e1"), F.lit("e2")))).alias("problem"))


# joins, windows and audits


@query(f"WITH {VOTED}, e AS (SELECT item_id, vote FROM responses WHERE model_id='board') SELECT p.label=p.gold AS pool_right, e.vote=p.gold AS board_right, count(*) AS n FROM p JOIN e USING (item_id) GROUP BY 1, 2")
def j19_paired(spark, d):
    """Two policies on the same items: the pool's vote and the expert alone."""
    expert = r._responses(spark, d).where("model_id = 'board'").select("item_id", F.col("vote").alias("single"))
    both = r._predictions(spark, d).join(expert, "item_id")
    return both.groupBy((F.col("label") == F.col("gold")).alias("pool_right"), (F.col("single") == F.col("gold")).alias("board_right")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EVENTS}, s AS (SELECT event_id AS step, day, object FROM ev WHERE action='ERROR') SELECT step, (SELECT count(*) FROM ev WHERE ev.day=s.day AND ev.object=s.object AND corpus='attack') AS events, EXISTS (SELECT 1 FROM ev WHERE ev.day=s.day AND ev.object=s.object AND corpus='attack' AND action='PURCHASE') AS observable FROM s")
def a16_step_update(spark, d):
    """For each step the attack's events on its object that day, and whether one of them is a purchase: one aggregate, joined."""
    e = t.events(spark, d)
    sums = e.where("corpus = 'attack'").groupBy("day", "object").agg(F.count(F.lit(1)).alias("events"), F.max((F.col("action") == "PURCHASE").cast("int")).alias("seen"))
    s = e.where("action = 'ERROR'").select(F.col("event_id").alias("step"), "day", "object")
    return s.join(sums, ["day", "object"], "left").select("step", F.coalesce("events", F.lit(0).cast("long")).alias("events"), (F.coalesce("seen", F.lit(0)) > 0).alias("observable"))


@query("""WITH o AS (SELECT conv_id, turn, role, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations),
l AS (SELECT *, lag(turn) OVER g AS parent, lag(role) OVER g AS parent_role, lag(start) OVER g AS parent_start FROM o WINDOW g AS (PARTITION BY conv_id ORDER BY start, turn))
SELECT conv_id, turn, parent, CASE WHEN role=parent_role THEN 'same_role' ELSE 'sequence' END AS relation, round((CASE WHEN role=parent_role THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END)*pow(2.718281828::DOUBLE, -(start-parent_start)/800.0::DOUBLE), 9) AS weight FROM l WHERE parent IS NOT NULL""")
def w4_causal_parent(spark, d):
    """Each mention's parent is the one before it in its document, the weight falling with the distance; turns are the mentions here."""
    c = t.read(spark, d, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    o = c.select("conv_id", "turn", "role", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).alias("start"))
    g = Window.partitionBy("conv_id").orderBy("start", "turn")
    o = o.withColumns({"parent": F.lag("turn").over(g), "parent_role": F.lag("role").over(g), "gap": F.col("start") - F.lag("start").over(g)}).where("parent is not null")
    same = F.col("role") == F.col("parent_role")
    return o.select("conv_id", "turn", "parent", F.when(same, "same_role").otherwise("sequence").alias("relation"), F.round(F.when(same, 1.0).otherwise(0.2) * F.pow(F.lit(2.718281828), -F.col("gap") / 800.0), 9).alias("weight"))


@query(f"WITH {EVENTS}, s AS (SELECT host, sha256('20:'||host) AS h, count(*) AS n FROM ev GROUP BY host), b AS (SELECT host, coalesce(sum(n) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM s) SELECT event_id, base + row_number() OVER (PARTITION BY ev.host ORDER BY ms, event_id) - 1 AS position FROM ev JOIN b ON b.host = ev.host")
def w15_permuted_replay(spark, d):
    """Places in a replay whose hosts' blocks are shuffled by a seeded hash: sums of the blocks before, and the rank within."""
    e = t.events(spark, d).select("event_id", "ms", "host")
    blocks = e.groupBy("host").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.sha2(F.concat(F.lit("20:"), F.col("host")), 256))
    before = F.sum("n").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1))  # a row for each block
    blocks = blocks.select("host", F.coalesce(before, F.lit(0).cast("long")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy("ms", "event_id"))
    return e.withColumn("rank", rank).join(blocks, "host").select("event_id", (F.col("base") + F.col("rank") - 1).alias("position"))


@query("SELECT sha256(string_agg(doc_id||':'||md5(text), ',' ORDER BY doc_id)) AS signature, count(*) AS n, source FROM documents GROUP BY source")
def y44_stage_signatures(spark, d):
    """A signature for each source: SHA-256 over its documents' ids and digests in order. The list is held in one row: for manifests."""
    x = t.read(spark, d, "documents").where("text is not null").select("source", "doc_id", F.md5(F.col("text").cast("binary")).alias("m"))
    rows = x.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), "m").alias("s")))).alias("all"), F.count(F.lit(1)).alias("n"))
    return rows.select("source", "n", F.sha2(F.array_join("all.s", ","), 256).alias("signature"))


# calibration


@query(f"WITH {RESPONSES}, s AS (SELECT model_id, count(*) AS n, round(sum(CASE WHEN vote=gold THEN confidence ELSE 1-confidence END), 6) AS soft FROM responses GROUP BY 1), b AS (SELECT model_id, n, 4.08::DOUBLE+soft AS alpha, 1.92::DOUBLE+n-soft AS beta FROM s) SELECT model_id, n, round(alpha/(alpha+beta), 6) AS mean, round(CASE WHEN n<8 THEN alpha/(alpha+beta) ELSE least(1, greatest(0, alpha/(alpha+beta)-1.28::DOUBLE*sqrt(alpha*beta/(pow(alpha+beta,2)*(alpha+beta+1))))) END, 6) AS lower FROM b")
def d28_soft_reliability(spark, d):
    """Each model's Beta posterior from soft correctness, prior 4.08 and 1.92, and its lower bound from eight observations on."""
    soft = F.when(F.col("vote") == F.col("gold"), F.col("confidence")).otherwise(1 - F.col("confidence"))
    s = r._responses(spark, d).groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(soft), 6).alias("soft"))
    return s.select("model_id", "n", *resampling.beta_bounds(4.08 + F.col("soft"), 1.92 + F.col("n") - F.col("soft"), F.col("n"), 8, 1.28))


@query(f"WITH {RESPONSES}, s AS (SELECT model_id, CAST(least(9, floor(confidence*10)) AS INTEGER) AS bin, count(*) AS n, sum((vote=gold)::INT) AS k FROM responses GROUP BY 1, 2), b AS (SELECT model_id, bin, n, 2.0::DOUBLE+k AS alpha, 2.0::DOUBLE+n-k AS beta FROM s) SELECT model_id, bin, n, round(alpha/(alpha+beta), 6) AS mean, round(CASE WHEN n<5 THEN alpha/(alpha+beta) ELSE least(1, greatest(0, alpha/(alpha+beta)-1.28::DOUBLE*sqrt(alpha*beta/(pow(alpha+beta,2)*(alpha+beta+1))))) END, 6) AS lower FROM b")
def d28_confidence_bins(spark, d):
    """Ten bins of reported confidence for each model: how often it was right, prior 2 and 2, and the lower bound."""
    b = r._responses(spark, d).groupBy("model_id", F.least(F.lit(9), F.floor(F.col("confidence") * 10)).cast("int").alias("bin"))
    s = b.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("vote") == F.col("gold")).cast("int")).alias("k"))
    return s.select("model_id", "bin", "n", *resampling.beta_bounds(2.0 + F.col("k"), 2.0 + F.col("n") - F.col("k"), F.col("n"), 5, 1.28))


GRID_SQL = "g AS (SELECT unnest(range(1, 20)) * 0.05::DOUBLE AS threshold)"


@query(f"""WITH {RESPONSES}, s AS (SELECT item_id, any_value(gold) AS gold, round(avg(CASE WHEN vote='toxic' THEN confidence ELSE 1-confidence END), 6) AS score FROM responses GROUP BY 1), {GRID_SQL},
c AS (SELECT round(threshold, 2) AS threshold, sum((score>=threshold AND gold='toxic')::INT) AS tp, sum((score>=threshold AND gold<>'toxic')::INT) AS fp, sum((score<threshold AND gold='toxic')::INT) AS fn FROM s, g GROUP BY 1)
SELECT threshold, round(CASE WHEN tp>0 THEN 2.0::DOUBLE*tp/(2*tp+fp+fn) ELSE 0 END, 6) AS f1, round(CASE WHEN tp>0 THEN tp::DOUBLE/(tp+fn) ELSE 0 END, 6) AS recall FROM c ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1""")
def y38_threshold(spark, d):
    """The threshold of a grid that is best by F1, then recall, then lowness. The grid's counts come from one pass: items fall into its cells, whose suffix sums are the counts."""
    score = F.round(F.avg(F.when(F.col("vote") == "toxic", F.col("confidence")).otherwise(1 - F.col("confidence"))), 6)
    s = r._responses(spark, d).groupBy("item_id").agg(F.max("gold").alias("gold"), score.alias("score"))
    steps = F.array(*[F.lit(0.05 * k) for k in range(1, 20)])
    cells = s.groupBy(F.size(F.filter(steps, lambda x: x <= F.col("score"))).alias("cell")).agg(F.sum((F.col("gold") == "toxic").cast("long")).alias("bad"), F.count(F.lit(1)).alias("n"))
    cells = spark.range(0, 20).select(F.col("id").cast("int").alias("cell")).join(cells, "cell", "left").fillna(0)
    above = Window.orderBy(F.desc("cell"))  # twenty rows
    c = cells.select("cell", F.sum("bad").over(above).alias("tp"), (F.sum("n").over(above) - F.sum("bad").over(above)).alias("fp"), F.sum("bad").over(Window.partitionBy()).alias("all"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("all") - F.col("tp")
    f1, recall = F.round(F.when(tp > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(0.0), 6), F.round(F.when(tp > 0, tp / (tp + fn)).otherwise(0.0), 6)
    return c.where("cell > 0").select(F.round(F.col("cell") * 0.05, 2).alias("threshold"), f1.alias("f1"), recall.alias("recall")).orderBy(F.desc("f1"), F.desc("recall"), "threshold").limit(1)


@query(f"""WITH {RESPONSES}, m AS (SELECT lang, model_id, avg((vote=gold)::INT::DOUBLE) AS acc FROM responses GROUP BY 1, 2), x AS (SELECT a.model_id, round(a.acc - b.acc, 9) AS delta, a.lang FROM m a JOIN m b ON a.lang=b.lang AND b.model_id='reader'),
s AS (SELECT model_id, round(avg(delta) + sum(least(delta, 0)), 6) AS value, round(min(delta), 6) AS worst FROM x GROUP BY 1) SELECT model_id, value, worst FROM s ORDER BY value DESC, worst DESC, model_id LIMIT 1""")
def y41_config_choice(spark, d):
    """The setting with the best mean gain over several data sets less its losses; ties by the smallest loss, then by name. Models stand for settings, languages for data sets."""
    m = r._responses(spark, d).groupBy("lang", "model_id").agg(F.avg((F.col("vote") == F.col("gold")).cast("double")).alias("acc"))
    base = m.where("model_id = 'reader'").select("lang", F.col("acc").alias("base"))
    x = m.join(base, "lang").select("model_id", F.round(F.col("acc") - F.col("base"), 9).alias("delta"))
    s = x.groupBy("model_id").agg(F.round(F.avg("delta") + F.sum(F.least(F.col("delta"), F.lit(0.0))), 6).alias("value"), F.round(F.min("delta"), 6).alias("worst"))
    return s.orderBy(F.desc("value"), F.desc("worst"), "model_id").limit(1)


# bootstraps

CLUSTER_SQL = f"""WITH {RESPONSES}, c AS (SELECT STRATUM AS stratum, source, sum(CASE WHEN vote=gold THEN CASE model_id WHEN 'board' THEN 1 ELSE -1 END ELSE 0 END)::BIGINT AS gain, count(DISTINCT doc_id) AS n FROM responses WHERE model_id IN ('board','reader') GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY source) AS i, count(*) OVER (PARTITION BY stratum) AS of FROM c), d AS (SELECT unnest(range(1, 201)) AS draw),
x AS (SELECT draw, stratum, 1 + CAST(floor({u("'boot|'||draw||'|'||stratum||'|'||i")} * of) AS BIGINT) AS i FROM k, d),
y AS (SELECT draw, sum(gain)::DOUBLE / sum(n) AS delta FROM x JOIN k USING (stratum, i) GROUP BY 1)
SELECT round(quantile_cont(delta, 0.025), 6) AS low, round(quantile_cont(delta, 0.5), 6) AS median, round(quantile_cont(delta, 0.975), 6) AS high, round(avg((delta>0)::INT::DOUBLE), 6) AS p_better FROM y"""


def _gains(spark, d, stratum: Column) -> DataFrame:
    x = r._responses(spark, d).where(F.col("model_id").isin("board", "reader"))
    right = (F.col("vote") == F.col("gold")).cast("long") * F.when(F.col("model_id") == "board", 1).otherwise(-1)
    return x.groupBy(stratum.alias("stratum"), "source").agg(F.sum(right).alias("gain"), F.count_distinct("doc_id").alias("n"))


def _interval(drawn: DataFrame) -> DataFrame:
    each = drawn.groupBy("draw").agg((F.sum("gain") / F.sum("n")).alias("delta"))
    q = lambda p: F.round(F.percentile("delta", F.lit(p)), 6)
    return each.agg(q(0.025).alias("low"), q(0.5).alias("median"), q(0.975).alias("high"), F.round(F.avg((F.col("delta") > 0).cast("double")), 6).alias("p_better"))


@query(CLUSTER_SQL.replace("STRATUM AS", "'all' AS"))
def v4_bootstrap(spark, d):
    """Paired cluster bootstrap of the board's gain over the reader: in each of 200 draws as many sources are drawn, with replacement, as there are."""
    return _interval(resampling.cluster_draws(_gains(spark, d, F.lit("all")), "stratum", "source", 200, "boot"))


@query(CLUSTER_SQL.replace("STRATUM AS", "lang AS"))
def v5_stratified_bootstrap(spark, d):
    """The same within strata: of each language as many sources are drawn as it has."""
    return _interval(resampling.cluster_draws(_gains(spark, d, F.col("lang")), "stratum", "source", 200, "boot"))
