"""A training-data pipeline over the documents table: each stage is one corpus operator.

Language identification rejects rows without a confident language; of each near-duplicate class one row stays;
documents that hold benchmark items go; what is left is put in the order of a source mixture; the mixed stream is cut
into shards. A stage's rows are written as Parquet and read again by the next. Every stage keeps the columns of
documents; the last adds size, shard and slot. Nulls, empty texts and repeated rows are treated as the operators say; an
empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm.bag_minhash import near_duplicates
from labelweave.llm.common import shared_dir
from labelweave.llm.decontamination import decontaminate
from labelweave.llm.language_id import identify
from labelweave.llm.mixing import mix_sources
from labelweave.llm.sharding import content_key, shard_records, text_size

N_SHARDS = 16
#: Some of the stages need decisions in SQL that it can't express: shingle signatures, alignment, trained likelihoods.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known with confidence, from their text, declared language and source."""
    return identify(docs, declared=F.col("lang"), host=F.col("source"), names=("__lang", "__p", "__ok")).where("__ok").select(*_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: that of the smallest doc_id."""
    return near_duplicates(docs, names=("__class", "__size", "__keep")).where("__keep").select(*_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark, names=("__flag", "__item", "__score", "__n")).where("not __flag").select(*_columns(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order of a mixture of their sources, each weighing the square root of its rows."""
    mixed = mix_sources(docs, names=("__block", "__slot", "__pos"))
    # positions are known and dense, so a row's partition is too: nothing has to be sampled, or made twice for it
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.least(F.lit(parts - 1), F.floor(F.col("__pos") * parts / F.lit(docs.count() + 1))).cast("int")
    return mixed.repartitionById(parts, part).sortWithinPartitions("__pos").select(*_columns(docs))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of equal bytes: consecutive stretches of the mixed stream, as it lies in the files that docs was read from.

    Rows that don't come from files are ordered by their text and doc_id instead.
    """
    try:
        part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
        placed = docs.withColumns({"__part": part, "__at": F.col("_metadata.row_index")})
        key = (F.col("__part"), F.col("__at"))
    except AnalysisException:
        placed, key = docs, (content_key(), F.col("doc_id"))
    out = shard_records(placed, N_SHARDS, text_size(), key)
    return out.select(*_columns(docs), "size", "shard", "slot")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{shared_dir(spark)}/pipeline/{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
