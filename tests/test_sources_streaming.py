import gzip
import json

import pytest
from pyspark.sql import functions as F

from labelweave.functions.text import iso_millis, private_ipv4
from labelweave.plans import replay
from labelweave.sources import records, sinks
from labelweave.sources import tables as t
from labelweave.streaming import windows


def _event(i, host="ws17.systemia.com", **more):
    return {"timestamp": 1700000000981 + i, "id": f"e{i}", "hostname": host, "objectID": "o", "object": "process", "action": "create", "actorID": "a", "pid": -1, "properties": {"image_path": "x"}} | more


def test_dirty_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join([json.dumps(_event(1)), "not-json", json.dumps(_event(1)), json.dumps(_event(2, host="other"))]))
    events, counters = records.load_events(records.lines(spark, str(tmp_path)), hosts=["WS17"])
    assert counters.first().asDict() == {"read": 4, "skipped": 1, "repeated": 1, "filtered": 1, "kept": 1}
    (e,) = events.collect()
    assert (e["event_id"], e["hostname"], e["object_type"], e["pid"], e["properties"]) == ("e1", "WS17", "PROCESS", None, {"image_path": "x"})


def test_compressed_arrays_and_wrapped_records(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        json.dump([_event(1), {"_source": _event(2)}], f)
    events, _ = records.load_events(records.array_records(spark, str(tmp_path)))
    assert [e["event_id"] for e in events.collect()] == ["e1", "e2"]


def test_times_and_addresses(spark):
    rows = [("2023-11-15T06:13:20.981+08:00", 1700000000981), ("2023-11-14T22:13:20.981Z", 1700000000981), ("2023-11-14T22:13:20.59Z", 1700000000590), ("2023-11-14T22:13:20.981", None), ("x", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, want long").withColumn("got", iso_millis(F.col("t")))
    assert all(r["want"] == r["got"] for r in df.collect())
    ips = spark.createDataFrame([("10.1.2.3", True), ("172.31.0.1", True), ("172.32.0.1", False), ("127.0.0.1", False), ("8.8.8.8", False), (None, False)], "ip string, want boolean")
    assert ips.where(private_ipv4(F.col("ip")) != F.col("want")).count() == 0


def test_labels(spark, tmp_path):
    (tmp_path / "l.csv").write_text("hostname,id,objectID,actorID,timestamp,object,action\nh1.systemia.com,e1,o,a,2023-11-14T22:13:20.981Z,FILE,read\nh1,e1,o,a,2023-11-14T22:13:22Z,FILE,read\nh2,e2,o,a,2023-11-14T22:13:20.59Z,FILE,read\n")
    got = records.load_labels(spark, str(tmp_path / "l.csv"))
    assert [(r["event_id"], r["hostname"]) for r in got.collect()] == [("e2", "H2"), ("e1", "H1")]


def test_annotations(spark, tmp_path):
    text = "An attack (phishing) hit. Later the attack stopped."
    events = [{"index": "E1", "subtype": "Phishing", "realis": "Actual", "nugget": {"startOffset": 11, "endOffset": 19, "text": "phishing"}, "argument": []}, {"index": "E2", "subtype": "Phishing", "realis": "Other", "nugget": {"startOffset": 34, "endOffset": 40, "text": "attack"}, "argument": []}, {"index": "E3", "subtype": "Phishing", "realis": "Other", "nugget": {"startOffset": 0, "endOffset": 3, "text": "zzz"}, "argument": []}]
    (tmp_path / "doc1.json").write_text(json.dumps({"content": text, "info": {"title": "t"}, "cyberevent": {"hopper": [{"events": events}]}}))
    got = records.load_annotations(spark, str(tmp_path), ("Phishing",)).orderBy("start").withColumn("ctx", records.marked_context(F.col("content"), F.col("start"), F.col("end"), 10)).collect()
    assert [(r["document"], r["text"], r["start"], text[r["start"] : r["end"]]) for r in got] == [("doc1", "phishing", 11, "phishing"), ("doc1", "attack", 36, "attack")]
    assert got[0]["ctx"] == "... n attack ( [EVENT] phishing [/EVENT] ) hit. Lat ..."


def test_log_groups(spark, tmp_path):
    doc = {"logs": [{"TimeCreated": "1", "Hostname": "h"}, {"TimeCreated": "1", "Hostname": "h"}, {"TimeCreated": "2", "Hostname": "h"}], "flags": [{"value": "1", "chain_idx": 0, "step_idx": 1}, {"value": "9", "chain_idx": 0, "step_idx": 1}], "chains": [{"chain_idx": 0, "steps": [{"step_idx": 1, "tactics": ["b", "a"]}]}]}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    groups, unjoined = records.load_log_groups(spark, str(tmp_path / "x.json"))
    assert {r["at"]: (len(r["rows"]), r["tactics"]) for r in groups.collect()} == {"1": (2, ["a", "b"]), "2": (1, None)}
    assert [r["at"] for r in unjoined.collect()] == ["9"]
    (tmp_path / "n").mkdir()
    (tmp_path / "n/r.json").write_text('{"Hostname": "h", "ProcessGuid": "1", "ParentProcessGuid": "2", "is_malicious": true}\n')
    assert {r["kind"]: r["n"] for r in records.audit_logs(records.lines(spark, str(tmp_path / "n"))).collect()} == {"host": 1, "channel": 1, "event_id": 1, "process_links": 1, "labels": 1}


def test_stage_resumes(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "f1", 0, 5), ("a", 1, "f1", 1, 6), ("b", 1, "f1", 2, 7)], "corpus string, event_id long, path string, line long, day int")
    sinks.stage(df, str(tmp_path / "s"))
    sinks.stage(df.unionByName(spark.createDataFrame([("a", 1, "f2", 0, 5), ("a", 3, "f2", 1, 6)], df.schema)), str(tmp_path / "s"))
    assert sorted((r["corpus"], r["event_id"], r["line"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [("a", 1, 0), ("a", 3, 1), ("b", 1, 2)]


def test_cache_and_ledger(spark, tmp_path):
    want = spark.createDataFrame([("m", "v1", "text", ["a", "b"]), ("m", "v1", "other", ["a", "b"])], "model_id string, prompt_version string, text string, labels array<string>")
    cells = sinks.cache_key(want)
    sinks.put(cells.where("text = 'text'").withColumn("raw", F.create_map(F.lit("usage"), F.lit("1"), F.lit("secret"), F.lit("k"))), str(tmp_path / "c"))
    cache = spark.read.parquet(str(tmp_path / "c"))
    assert cache.first()["raw"] == {"usage": "1"} and [r["text"] for r in sinks.missing(want, cache).collect()] == ["other"]
    entries = spark.createDataFrame([("1", "reserve", 2.0), ("1", "commit", 1.5), ("2", "reserve", 2.0), ("3", "reserve", 1.0), ("3", "release", 1.0)], "call_id string, event string, usd double")
    assert sinks.ledger(entries, 4.0, 10).first().asDict() == {"spent": 1.5, "held": 2.0, "calls": 3, "open": True}


def test_streaming_equals_batch(spark, sf, tmp_path):
    e = t.read(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("host"), F.upper("event_type").alias("action"), "value")
    e.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    got = run(windows.host_windows(stream), "w", "complete")
    want = windows.host_windows(e)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert run(windows.fresh(stream), "f").count() == e.count()
    p = replay.panel(spark, sf)
    flat = p.select(F.col("source").alias("stream"), F.col("doc_id").alias("item_id"), "gold", F.array(*[f"vote_{m}" for m in replay.NAMES]).alias("votes"))
    flat.coalesce(1).write.parquet(str(tmp_path / "panel"))
    labels = run(windows.weighted_majority(spark.readStream.schema(flat.schema).parquet(str(tmp_path / "panel")), replay.NAMES, t.LABELS), "m")
    batch = replay.d34_online_majority(spark, sf)
    assert sorted((r["item_id"], r["label"]) for r in labels.collect()) == sorted((r["doc_id"], r["label"]) for r in batch.collect())


def test_replays(spark, sf):
    for name, f in replay.QUERIES.items():
        assert f(spark, sf).count() > 0, name


def test_labels_that_are_none(spark, tmp_path):
    head = "action,timestamp,id,hostname,object,actorID,objectID\n"  # any order
    rows = ["read,2023-11-14T22:13:20.981Z,e1,ws1.systemia.com,file,a,o", "read,2023-11-14T22:13:20.981Z,e1,ws0.systemia.com,file,a,o", "read,yesterday,e2,ws1,file,a,o", "read,,e3,ws1,file,a,o", "read,2023-11-14T22:13:21Z,,ws1,file,a,o", "read,2023-11-14T22:13:21Z,e4,,file,a,o", "read,2023-11-14T22:13:22Z,e5,other,file,a,o", "read,2023-11-14T22:13:30Z,e6,ws1,file,a,o"]
    (tmp_path / "l.csv").write_text(head + "\n".join(rows) + "\n")
    want = dict(hosts=["WS0", "WS1"], end_ms=1700000005000)
    assert [(r["event_id"], r["hostname"]) for r in records.load_labels(spark, str(tmp_path / "l.csv"), **want).collect()] == [("e1", "WS0")]
    assert records.label_counters(spark, str(tmp_path / "l.csv"), **want).first().asDict() == {"read": 8, "empty_key": 2, "bad_time": 2, "filtered": 2, "repeated": 1, "kept": 1}
    (tmp_path / "m.csv").write_text("id,hostname\ne1,h\n")
    with pytest.raises(ValueError, match="timestamp"):
        records.load_labels(spark, str(tmp_path / "m.csv"))


def test_scenarios_and_caches(spark, tmp_path):
    manifest = {"scenario_id": "s", "utc_offset_minutes": 60, "padding_minutes": 5, "hosts": ["ws1.systemia.com"], "activities": [{"name": "a", "start": "2023-11-14T23:00:00", "end": "2023-11-14T23:30:00", "hosts": None}]}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    (r,) = records.load_scenarios(spark, str(tmp_path / "m.json")).collect()
    assert (r["start_ms"], r["end_ms"], r["hosts"]) == (1700000000000 - 800_000 - 300_000, 1700000000000 + 1_000_000 + 300_000, ["WS1"])


def test_answers_that_are_nested_too_deep():
    from labelweave.functions import responses as A

    assert A.first_object('x {"a": [1, {"b": 2}]} y') == {"a": [1, {"b": 2}]} and A.depth({"a": [1, {"b": 2}]}) == 3
    assert A.first_object('{"a":' * 100_000) is None and A.first_object('{"a":' * 100_000 + "1" + "}" * 100_000) is None
    assert A.first_object('{"a":' * 65 + "1" + "}" * 65) is None and A.depth(A.first_object('{"a":' * 64 + "1" + "}" * 64)) == 64
    assert A.first_object('{bad} {"label": 1}') == {"label": 1} and A.first_object(None) is None
    assert A.classification('{"label":' * 5000, ("a",))[3] == "no object"
