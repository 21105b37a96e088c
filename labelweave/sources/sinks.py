"""Writers: staged tables that can be resumed, unions of uneven tables, a response cache, a budget ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stage(events: DataFrame, path: str) -> None:
    """Append events of files that the stage doesn't have yet, one for each (corpus, event_id), partitioned by corpus and day."""
    spark = events.sparkSession
    new = events
    try:
        done = spark.read.parquet(path)
    except Exception as e:  # the stage isn't there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        new = new.join(done.select("path").distinct(), "path", "left_anti").join(done.select("corpus", "event_id"), ["corpus", "event_id"], "left_anti")
    rest = [c for c in new.columns if c not in ("corpus", "event_id")]
    first = new.groupBy("corpus", "event_id").agg(F.min_by(F.struct(*rest), F.struct("path", "line")).alias("r")).select("corpus", "event_id", "r.*")
    first.repartition("corpus", "day").write.mode("append").partitionBy("corpus", "day").parquet(path)


def write_csv(tables: list[DataFrame], path: str) -> None:
    """Rows of several tables under the union of their columns."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    out.write.mode("overwrite").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; Spark's commit makes the directory appear as a whole or not at all."""
    df.write.mode("overwrite").json(path)


#: What is kept of a provider's raw answer.
SAFE_METADATA = ("finish_reason", "model", "usage")


def cache_key(df: DataFrame) -> DataFrame:
    """A digest of all that an answer depends on: model, prompt version, text, labels."""
    return df.withColumn("digest", F.sha2(F.concat_ws("\u001f", "model_id", "prompt_version", "text", F.array_join("labels", ",")), 256))


def missing(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Cells that have to be asked for."""
    return cache_key(wanted).join(cache.select("digest"), "digest", "left_anti")


def put(answers: DataFrame, path: str) -> None:
    """Append answers to the cache, their raw metadata cut to what is safe to keep."""
    safe = F.map_filter("raw", lambda k, _: k.isin(*SAFE_METADATA))
    answers.withColumn("raw", safe).write.mode("append").parquet(path)


def ledger(entries: DataFrame, limit: float, calls: int) -> DataFrame:
    """One row: what a ledger of reservations, commits, failures and releases has spent and holds back, and whether more may be asked.

    entries (call_id, event, usd): a call counts by its last event; a reservation without an end still holds its money back.
    """
    order = F.when(F.col("event") == "reserve", 0).otherwise(1)
    last = entries.groupBy("call_id").agg(F.max(F.struct(order.alias("o"), F.col("event").alias("event"), F.col("usd").alias("usd"))).alias("l"))
    s = lambda e: F.coalesce(F.sum(F.when(F.col("l.event") == e, F.col("l.usd"))), F.lit(0.0))
    out = last.agg(s("commit").alias("spent"), s("reserve").alias("held"), F.count(F.lit(1)).alias("calls"))
    return out.withColumn("open", (F.col("spent") + F.col("held") < limit) & (F.col("calls") < calls))


def save_state(spark: SparkSession, path: str, run: str, state_json: str) -> None:
    """A labeller's checkpoint as a row."""
    spark.createDataFrame([(run, state_json)], "run string, state string").write.mode("append").parquet(path)
