"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm.bag_minhash import near_duplicates
from labelweave.llm.decontamination import decontaminate
from labelweave.llm.fill_in_middle import fill_in_middle, restored
from labelweave.llm.language_id import identify, page_evidence, page_text
from labelweave.llm.line_dedup import dedup_lines
from labelweave.llm.mixing import mix_sources
from labelweave.llm.ngram_join import ngram_components
from labelweave.llm.periodic_runs import periodic_runs
from labelweave.llm.record_files import read_records, write_records
from labelweave.llm.sharding import content_key, shard_records, text_size
from labelweave.llm.suffix_dedup import dedup_substrings
from labelweave.llm.token_counts import token_counts
from labelweave.llm.vector_search import top_k

SHARDS = 16


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", "dropped_lines")


def op2_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    docs = docs.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), text_size().alias("n"), content_key().alias("content"))
    out = shard_records(docs, SHARDS, F.col("n"), (F.col("content"), F.col("doc_id")), whole=True)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source")
    return mix_sources(docs)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "contaminated", "item_id", "score", "n_items")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumn("over_limit", F.col("n_tokens") > 4096)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))


def op8_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_records(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_records(spark, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: a document's source counts as its host; they have no address."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    out = identify(docs, declared=F.col("lang"), host=F.col("source"))
    return out.select("doc_id", "lang", "lang_id", "lang_p", "lang_ok")


def llm_page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with all its evidence: pages, with the language in their markup, their address and host."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("text", page_text())
    return identify(pages, **page_evidence()).select("page_id", "lang_id", "lang_p", "lang_ok")


def op10_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "class_id", "class_size", "keep")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """Of a tenth of the documents the words from a certain one on repeat, as the contract of op11 says; words are joined by one space."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = docs.withColumns({"g": F.floor(h / 10).cast("long"), "words": F.when(h % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))})
    docs = docs.withColumn("n", F.size("words").cast("long"))
    a = F.col("g") % F.col("n")
    docs = docs.withColumns({"a": F.when(F.col("n") > 0, a), "p": F.when(F.col("n") > 0, 1 + F.floor((F.col("n") - a) / (3 + F.col("g") % 8)))})
    word = lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    tail = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), word), " ")
    return docs.select("doc_id", F.when(F.col("n") > 0, tail).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periodic_tails(documents(spark, sf_dir).select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("top", longest)
    length, period = F.col("top.length"), -F.col("top.q")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.s")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"), "code_points")
    digest = lambda c: F.sha2(c, 256)
    return made.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        digest(F.col("fim_text")).alias("output_sha256"),
        digest(restored(F.col("fim_text"), F.col("form"), ("<P>", "<S>", "<M>"))).alias("restored_sha256"),
    )


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir).select("doc_id", "text"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_fuzzy_lines, op2_sampled_splitters, op3_pfair_mixing, op4_decontamination, op5_token_counts, op6_exact_top_k, op7_suffix_dedup, op8_binary_records, op9_language_id, op10_bag_minhash, op11_periodic_runs, op12_fill_in_middle, op13_ngram_jaccard, llm_page_language)}


def _nibble_table() -> list[int]:
    """CRC-32 of four bits at a time."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        out.append(c)
    return out


OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (
  SELECT doc_id, t, strlen(t) + 1 AS size, ('0x' || substr(md5(t), 1, 15))::BIGINT AS k,
    list_transform(string_split(hex(encode(t)), ''), lambda c: CAST(strpos('0123456789ABCDEF', c) - 1 AS BIGINT)) AS x
  FROM d
), c AS (
  SELECT doc_id, CAST(size AS BIGINT) AS size, k, CASE WHEN t = '' THEN 0 ELSE xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(len(x)), lambda i: x[xor(i, 1) + 1])),
    lambda a, b: xor(a >> 4, ({_nibble_table()}::BIGINT[])[(xor(a, b) & 15) + 1])), 4294967295::BIGINT) END AS text_crc32
  FROM n
), s AS (
  SELECT *, sum(size) OVER (ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total, row_number() OVER (ORDER BY k, doc_id) AS r FROM c
), g AS (SELECT *, sum(size) OVER (PARTITION BY k) AS whole, min(upto - size) OVER (PARTITION BY k) AS start FROM s
), p AS (SELECT *, CAST(least(15, (CASE WHEN whole * 16 < total THEN 2 * start + whole ELSE 2 * upto - size END * 16) // (2 * total)) AS INTEGER) AS shard FROM g)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, r - min(r) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
"""

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (
  SELECT doc_id, t, length(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM n
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END AS made
  FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars, sha256(made) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_fill_in_middle": OP12_SQL, "op2_sampled_splitters": OP2_SQL, "op6_exact_top_k": OP6_SQL}
