"""Helpers that several corpus operators share: staged tables, free column names and null-safe text columns."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: While a table is staged: a query's shuffle files go once it has ended; batches that go to Python are bounded in bytes, not in rows alone.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@cache
def _local_folder() -> str:
    """One folder a process; Spark lets no session set spark.checkpoint.dir later on."""
    return tempfile.mkdtemp(prefix="labelweave-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one, on a local master only (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _local_folder()
    return root.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it again: cuts lineage, and a lost executor costs nothing.

    The shuffle files of the query that writes go when it has ended; discard() removes the table itself.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "staged_path", None)
        if path:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def quoted(name: str) -> Column:
    """The column of exactly that name, dots, spaces and backticks in it or not."""
    return F.col("`" + name.replace("`", "``") + "`")


def kept_columns(df: DataFrame, names: tuple[str, ...]) -> list[Column]:
    """The columns of df but for those that one of the names replaces, in any case."""
    gone = {n.lower() for n in names}
    return [quoted(c) for c in df.columns if c.lower() not in gone]


def free_name(df: DataFrame, stem: str, *others: str) -> str:
    """stem, or stem with underscores before it, such that no column of df and no other name is the same in any case."""
    taken = {c.lower() for c in (*df.columns, *others)}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem
