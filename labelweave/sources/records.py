"""Readers of raw records: telemetry events, label files, annotated documents, log groups, manifests. Schemas are explicit throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelweave.functions.text import hostname, iso_millis, non_negative

#: Keys that mean the same, in the order in which they are looked for.
ALIASES = {
    "event_id": ("id", "event_id"),
    "hostname": ("hostname", "host"),
    "object_id": ("objectID", "object_id"),
    "object_type": ("object", "object_type"),
    "action": ("action",),
    "actor_id": ("actorID", "actor_id"),
    "time": ("timestamp_ms", "timestamp"),
}
WRAPPERS = ("event", "_source")


def lines(spark: SparkSession, path: str, glob: str = "*.{json,jsonl,ndjson,json.gz,jsonl.gz,ndjson.gz}") -> DataFrame:
    """(path, line, raw) of all line-delimited files below path, blank lines left out; line grows along the file, by no fixed step."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    t = t.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("raw"))
    return t.where(F.trim("raw") != "")


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, raw) of files that each hold one JSON array of records: a file is parsed as a whole."""
    t = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    items = F.from_json("value", "array<string>")
    return t.select("path", F.posexplode(items).alias("line", "raw")).select("path", F.col("line").cast("long").alias("line"), "raw")


def _pick(raw: Column, names: tuple[str, ...]) -> Column:
    """The first of these keys that a record has, at its top or, if its time isn't there, inside a wrapper."""
    top = F.coalesce(*[F.get_json_object(raw, f"$.{n}") for n in names])
    inner = F.coalesce(*[F.get_json_object(raw, f"$.{w}.{n}") for w in WRAPPERS for n in names])
    timed = F.coalesce(*[F.get_json_object(raw, f"$.{n}") for n in ALIASES["time"]]).isNotNull()
    return F.when(timed, top).otherwise(inner)


def normalised_events(records: DataFrame) -> DataFrame:
    """Typed events with an error column: null for good rows, else what is wrong. Negative process ids count as none."""
    raw = F.col("raw")
    parsed = {k: _pick(raw, v) for k, v in ALIASES.items()}
    ms = F.coalesce(F.expr("try_cast(time as bigint)"), iso_millis(F.col("time")))
    number = lambda name: non_negative(F.expr(f"try_cast({name} as bigint)"))
    e = records.withColumns(parsed | {n: _pick(raw, (n,)) for n in ("pid", "ppid", "tid", "principal", "properties")})
    e = e.withColumns({"ms": ms, "hostname": hostname(F.col("hostname")), "object_type": F.upper("object_type"), "action": F.upper("action"), **{n: number(n) for n in ("pid", "ppid", "tid")}})
    need = ("event_id", "hostname", "object_id", "object_type", "action", "actor_id")
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull() | (F.trim(F.col(n)) == ""), F.lit(n)) for n in need], F.when(F.col("ms").isNull(), F.lit("time"))))
    error = F.when(~F.col("raw").rlike(r"^\s*\{"), "no record").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ",")))
    return e.withColumn("error", error).select("path", "line", "event_id", "ms", "hostname", "object_id", "object_type", "action", "actor_id", "pid", "ppid", "tid", "principal", F.from_json("properties", "map<string,string>").alias("properties"), "error")


def load_events(records: DataFrame, hosts: list[str] | None = None, start_ms: int | None = None, end_ms: int | None = None, most: int | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, counters). An id's first record in file order counts, also when a filter then drops it; events are ordered by (ms, id).

    counters: one row with records read, skipped, repeated, filtered and kept. strict: a bad record is an error.
    """
    e = normalised_events(records)
    if strict:
        e = e.where(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("bad record in"), "path", F.lit("line"), F.col("line").cast("string"), "error")).cast("boolean")))
    first = F.row_number().over(Window.partitionBy("event_id").orderBy("path", "line")) == 1
    wanted = F.lit(True)
    if hosts is not None:
        wanted &= F.col("hostname").isin([h.upper() for h in hosts])
    if start_ms is not None:
        wanted &= F.col("ms") >= start_ms
    if end_ms is not None:
        wanted &= F.col("ms") <= end_ms
    good = e.where("error is null").withColumns({"first": first, "wanted": wanted})
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    bad = e.agg(F.count(F.lit(1)).alias("read"), n(F.col("error").isNotNull()).alias("skipped"))
    counters = bad.join(good.agg(n(~F.col("first")).alias("repeated"), n(F.col("first") & ~F.col("wanted")).alias("filtered"), n(F.col("first") & F.col("wanted")).alias("kept")))
    out = good.where("first and wanted").drop("first", "wanted", "error")
    if most is not None:
        out = out.orderBy("path", "line").limit(most)
    return out.orderBy("ms", "event_id"), counters


LABEL_SCHEMA = "hostname string, id string, objectID string, actorID string, timestamp string, object string, action string"


def _labels(spark: SparkSession, path: str, hosts: list[str] | None, start_ms: int | None, end_ms: int | None) -> DataFrame:
    """All rows of label files with what becomes of each: kept, filtered, repeated, or the reason why it is none."""
    t = spark.read.option("header", "true").csv(path)
    missing = sorted({c.split()[0] for c in LABEL_SCHEMA.split(", ")} - set(t.columns))
    if missing:
        raise ValueError(f"label files lack the columns {missing}")
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    t = t.select(text("id").alias("event_id"), iso_millis(F.col("timestamp")).alias("ms"), hostname(F.col("hostname")).alias("hostname"), F.col("objectID").alias("object_id"), F.col("actorID").alias("actor_id"), F.upper("object").alias("object_type"), F.upper("action").alias("action"))
    wanted = F.lit(True)
    if hosts is not None:
        wanted &= F.col("hostname").isin([h.upper() for h in hosts])
    if start_ms is not None:
        wanted &= F.col("ms") >= start_ms
    if end_ms is not None:
        wanted &= F.col("ms") <= end_ms
    no_host = F.coalesce(F.col("hostname"), F.lit("")) == ""
    t = t.withColumn("state", F.when((F.col("event_id") == "") | no_host, "empty_key").when(F.col("ms").isNull(), "bad_time").when(~wanted, "filtered").otherwise("kept"))
    order = F.row_number().over(Window.partitionBy("event_id", "state").orderBy("ms", "hostname", "object_id", "actor_id", "object_type", "action"))
    return t.withColumn("state", F.when((F.col("state") == "kept") & (order > 1), "repeated").otherwise(F.col("state")))


def load_labels(spark: SparkSession, path: str, hosts: list[str] | None = None, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Attack labels from CSV with a header, columns by their names in any order: filtered first, then one row for each id, the earliest (ties: by host, object, actor, kind, action); ordered by (ms, id).

    Rows without an id or host, or with a time that can't be read, are none; label_counters tells how many. No label means unknown, not benign.
    """
    return _labels(spark, path, hosts, start_ms, end_ms).where("state = 'kept'").drop("state").orderBy("ms", "event_id")


def label_counters(spark: SparkSession, path: str, hosts: list[str] | None = None, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """One row: label rows read, and how many have an empty key or a bad time, are filtered, repeat an id, or are kept."""
    n = lambda s: F.coalesce(F.sum((F.col("state") == s).cast("long")), F.lit(0).cast("long")).alias(s)
    return _labels(spark, path, hosts, start_ms, end_ms).agg(F.count(F.lit(1)).alias("read"), *[n(s) for s in ("empty_key", "bad_time", "filtered", "repeated", "kept")])


SCENARIO_SCHEMA = "scenario_id string, utc_offset_minutes int, padding_minutes int, hosts array<string>, activities array<struct<name:string,start:string,end:string,hosts:array<string>>>"


def load_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """One row for each activity of a scenario manifest, its local clock turned into an epoch window with padding."""
    t = spark.read.schema(SCENARIO_SCHEMA).option("multiLine", "true").json(path)
    a = t.select("scenario_id", "utc_offset_minutes", F.coalesce("padding_minutes", F.lit(0)).alias("pad"), F.posexplode("activities").alias("ordinal", "a"), F.col("hosts").alias("all_hosts"))
    at = lambda c: F.unix_millis(F.to_timestamp(c)) - F.col("utc_offset_minutes") * 60000
    return a.select("scenario_id", "ordinal", "a.name", (at(F.col("a.start")) - F.col("pad") * 60000).alias("start_ms"), (at(F.col("a.end")) + F.col("pad") * 60000).alias("end_ms"), F.transform(F.coalesce("a.hosts", "all_hosts"), lambda x: hostname(x)).alias("hosts"))


ANNOTATION_SCHEMA = "content string, info struct<title:string>, cyberevent struct<hopper:array<struct<events:array<struct<index:string,type:string,subtype:string,realis:string,nugget:struct<startOffset:int,endOffset:int,text:string>,argument:array<struct<text:string>>>>>>>"


def load_annotations(spark: SparkSession, path: str, labels: tuple[str, ...]) -> DataFrame:
    """Annotated mentions of documents: (document, hopper, mention, label, realis, start, end, text, arguments, content).

    A mention's span is its declared one if the text stands there; else the nearest place where it does; mentions without either, or
    with a label that isn't wanted, are left out.
    """
    t = spark.read.schema(ANNOTATION_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true").json(path).withColumn("document", F.regexp_extract("_metadata.file_name", r"^(.*?)\.[^.]*$", 1))
    h = t.select("document", "content", F.posexplode("cyberevent.hopper").alias("hopper", "h"))
    m = h.select("document", "content", "hopper", F.posexplode("h.events").alias("mention", "e")).select("document", "hopper", "mention", F.col("e.subtype").alias("label"), F.lower("e.realis").alias("realis"), F.col("e.nugget").alias("n"), F.size("e.argument").alias("arguments"), "content")
    word, size = F.col("n.text"), F.length("n.text")
    start = F.col("n.startOffset")
    exact = F.substr(F.col("content"), start + 1, size) == word
    # every place of the text: lengths of what lies between its occurrences, summed up
    between = F.transform(F.split(F.col("content"), F.regexp_replace(word, r"([\\\[\](){}.*+?^$|])", r"\\$1"), -1), lambda x: F.length(x))
    places = F.transform(F.sequence(F.lit(1), F.size(between) - 1), lambda k: F.aggregate(F.slice(between, 1, k), F.lit(0), lambda a, x: a + x) + (k - 1) * size)
    nearest = F.array_min(F.transform(F.when(F.size(between) > 1, places), lambda p: F.struct(F.abs(p - start).alias("d"), p.alias("p"))))["p"]
    m = m.where(F.col("label").isin(*labels) & (F.coalesce(size, F.lit(0)) > 0)).withColumn("start", F.when(exact, start).otherwise(nearest)).where("start is not null")
    return m.select("document", "hopper", "mention", "label", "realis", "start", (F.col("start") + size).alias("end"), word.alias("text"), "arguments", "content")


def marked_context(content: Column, start: Column, end: Column, around: int = 240) -> Column:
    """The text around a mention, the mention between [EVENT] marks, white space squeezed, three dots where it is cut."""
    low = F.greatest(F.lit(0), start - around)
    left, word = F.substr(content, low + 1, start - low), F.substr(content, start + 1, end - start)
    right = F.substr(content, end + 1, F.lit(around))
    text = F.concat(F.when(low > 0, "... ").otherwise(""), left, F.lit(" [EVENT] "), word, F.lit(" [/EVENT] "), right, F.when(F.length(content) > end + around, " ...").otherwise(""))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


LOG_SCHEMA = "logs array<map<string,string>>, flags array<struct<value:string,chain_idx:int,step_idx:int>>, chains array<struct<chain_idx:int,steps:array<struct<step_idx:int,tactics:array<string>>>>>"


def load_log_groups(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(groups, unjoined): log rows grouped by exact time, with the tactics of the flags of that time; flags that meet no group."""
    t = spark.read.schema(LOG_SCHEMA).option("multiLine", "true").json(path)
    groups = t.select(F.explode("logs").alias("row")).groupBy(F.col("row")["TimeCreated"].alias("at")).agg(F.collect_list("row").alias("rows"))
    steps = t.select(F.explode("chains").alias("c")).select("c.chain_idx", F.explode("c.steps").alias("s")).select("chain_idx", "s.step_idx", "s.tactics")
    flags = t.select(F.inline("flags")).join(steps, ["chain_idx", "step_idx"], "left").groupBy(F.col("value").alias("at")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tactics", F.array().cast("array<string>")))))).alias("tactics"))
    joined = groups.join(flags, "at", "left").withColumn("malicious", F.col("tactics").isNotNull())
    return joined, flags.join(groups, "at", "left_anti")


def newest_responses(spark: SparkSession, path: str) -> DataFrame:
    """A directory of cached responses: the newest for each (model, item)."""
    t = spark.read.schema("model_id string, item_id string, label string, input_tokens long, output_tokens long, created_at_unix double").option("recursiveFileLookup", "true").json(path)
    return t.groupBy("model_id", "item_id").agg(F.max_by(F.struct("label", "input_tokens", "output_tokens"), "created_at_unix").alias("r")).select("model_id", "item_id", "r.*")


def complete_cases(responses: DataFrame, pool: int) -> DataFrame:
    """Items that every model of the pool has answered."""
    full = responses.groupBy("item_id").agg(F.count_distinct("model_id").alias("k")).where(F.col("k") == pool)
    return responses.join(full.select("item_id"), "item_id", "left_semi")


def audit_logs(records: DataFrame) -> DataFrame:
    """(kind, value, n) over raw log records: hosts, channels, event ids, and how many have two process or two network links or a label."""
    get = lambda n: F.get_json_object("raw", f"$.{n}")
    links = lambda *names: sum(F.when(F.coalesce(F.get_json_object("raw", f"$.{n}"), F.lit("")) != "", 1).otherwise(0) for n in names)
    found = F.array_compact(
        F.array(
            F.struct(F.lit("host").alias("kind"), F.coalesce(get("Hostname"), F.lit("")).alias("value")),
            F.struct(F.lit("channel").alias("kind"), F.coalesce(get("Channel"), F.lit("")).alias("value")),
            F.struct(F.lit("event_id").alias("kind"), F.coalesce(get("EventID"), F.lit("")).alias("value")),
            F.when(links("ProcessGuid", "ParentProcessGuid") >= 2, F.struct(F.lit("process_links").alias("kind"), F.lit("").alias("value"))),
            F.when(links("SourceAddress", "DestAddress") >= 2, F.struct(F.lit("network_links").alias("kind"), F.lit("").alias("value"))),
            F.when(F.coalesce(get("is_malicious"), get("label")).isNotNull(), F.struct(F.lit("labels").alias("kind"), F.lit("").alias("value"))),
        )
    )
    return records.select(F.inline(found)).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
