"""The driver's tables in the shapes that the operators work on."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.functions.hashing import joined, unit_draw
from labelweave.functions.mathx import clip, sigmoid

#: The pool by a rule: step k leaves 0.72 of the errors of the step before, costs 2.6 times as much, takes 1.7 times as long and minds difficulty a little less.
STEPS = ("page", "clerk", "reader", "editor", "referee", "board")
#: name, accuracy, input and output price per million tokens, latency in ms, difficulty sensitivity.
MODELS = [(name, round(1 - 0.38 * 0.72**k, 4), round(0.05 * 2.6**k, 4), round(0.175 * 2.6**k, 4), round(75 * 1.7**k, 1), round(1.2 - 0.09 * k, 2)) for k, name in enumerate(STEPS)]
LABELS = ("clean", "toxic")
SEED = 17
PROMPT_TOKENS = 24


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def models(spark: SparkSession) -> DataFrame:
    """The dimension of models: a row for each step."""
    rows = [(m, a, i, o, lat, s, math.log(a / (1 - a))) for m, a, i, o, lat, s in MODELS]
    return spark.createDataFrame(rows, "model_id string, accuracy double, in_price double, out_price double, latency_ms double, sensitivity double, ability double")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: (doc_id, item_id, gold, source, lang, n_chars, difficulty)."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    labelled = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, LABELS[1]).otherwise(LABELS[0]).alias("gold"))
    return d.join(labelled, "doc_id").withColumn("item_id", F.concat(F.lit("doc-"), F.col("doc_id"))).withColumn("difficulty", unit_draw(joined("difficulty", F.col("item_id"), sep="|")) * 1.6 - 0.8)


def responses(items: DataFrame, models: DataFrame, seed: int = SEED) -> DataFrame:
    """Simulated votes of every model on every item.

    P(correct) = sigmoid(logit(accuracy) - sensitivity * difficulty); the draws are hashes of seed, model and item.
    """
    r = items.crossJoin(F.broadcast(models))  # six rows: the pool
    p = clip(sigmoid(F.col("ability") - F.col("sensitivity") * F.col("difficulty")), 1e-6, 1 - 1e-6)
    draw = lambda what: unit_draw(joined(seed, F.col("model_id"), F.col("item_id"), what, sep="|"))
    other = F.when(F.col("gold") == LABELS[0], LABELS[1]).otherwise(LABELS[0])
    r = r.withColumn("vote", F.when(draw("correct") < p, F.col("gold")).otherwise(other))
    r = r.withColumns({"in_tokens": F.greatest(F.lit(1), F.floor((F.col("n_chars") + 3) / 4)).cast("long") + PROMPT_TOKENS, "out_tokens": F.lit(1).cast("long"), "confidence": F.round(0.5 + 0.49 * draw("confidence"), 6)})
    return r.withColumn("cost", (F.col("in_tokens") * F.col("in_price") + F.col("out_tokens") * F.col("out_price")) / 1e6)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry events: (event_id, ms, host, action, object, value, day, corpus); a third of the days count as another corpus."""
    e = read(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = e.select("event_id", ms.alias("ms"), F.col("user_id").alias("host"), F.upper("event_type").alias("action"), F.get_json_object("props", "$.k").cast("long").alias("object"), "value")
    return e.withColumns({"day": F.floor(F.col("ms") / 86400000).cast("long"), "corpus": F.when(F.col("host") % 3 == 0, "attack").otherwise("benign")})
