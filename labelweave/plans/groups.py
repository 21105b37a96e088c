"""Splits and samples of labelled documents that keep groups whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.operators import allocation
from labelweave.sources import tables as t

LABELS = ("clean-0", "clean-1", "toxic-0", "toxic-1")
SHARE = 0.3


def grouped_items(spark: SparkSession, d: str) -> DataFrame:
    """(stream, group, item, at, label): labelled documents; those of one source, language and size are a group, their label is toxicity and quality."""
    quality = t.read(spark, d, "labels").select("doc_id", F.coalesce(F.col("quality").cast("int"), F.lit(0)).cast("string").alias("quality"))
    i = t.items(spark, d).join(quality, "doc_id")
    group = F.concat_ws("-", F.coalesce("lang", F.lit("")), F.coalesce(F.floor(F.log2("n_chars") * 2), F.lit(0)).cast("string"))
    return i.select(F.coalesce("source", F.lit("")).alias("stream"), group.alias("group"), F.col("doc_id").alias("item"), F.col("doc_id").alias("at"), F.concat_ws("-", "gold", "quality").alias("label"))


def v2_stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """Every labelled document's split, groups kept whole and labels in their shares within each source."""
    items = grouped_items(spark, d)
    split = allocation.stratified_split(allocation.group_counts(items, LABELS), LABELS)
    return items.join(split.select("stream", "group", "split"), ["stream", "group"]).select(F.col("item").alias("doc_id"), "stream", "group", "label", "split")


def o8_group_packing(spark: SparkSession, d: str) -> DataFrame:
    """Three tenths of each source in whole groups, in the order in which they are taken, filled with the beginning of one more."""
    out = allocation.packed(grouped_items(spark, d), LABELS, SHARE)
    return out.select(F.col("item").alias("doc_id"), "stream", "group", "block", "place", "whole")


QUERIES = {f.__name__: f for f in (v2_stratified_split, o8_group_packing)}
