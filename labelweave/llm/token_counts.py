"""Token counts without token ids: pieces are counted once for each distinct pre-token and summed by document.

The tokenizer's pieces never hold a space after another character, nor a line break beside anything, so a text falls
into pre-tokens - runs of spaces with what follows, or one line break with what follows - that are encoded one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.llm.common import quoted, staged

#: A pre-token: starts with a line break or with spaces; the marker character counts as a space.
PRE_TOKEN = re.compile("\n[^ \n]*| +[^ \n]*")
SPACE_MARK = "▁"
#: Bytes of all pre-tokens that go to every task, bytes of the longest of them, and characters of pre-tokens that a task gathers.
COMMON_BYTES, LONGEST, SEEN_CHARS = 16 << 20, 256, 32 << 20
_MODELS: dict = {}


def pre_tokens(text: str) -> list[str]:
    """All pre-tokens of a text, with the space that the model puts before it."""
    return PRE_TOKEN.findall(" " + text.replace(SPACE_MARK, " ")) if text else []


def _model(path: str):
    if path not in _MODELS:
        import sentencepiece

        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def count_pieces(model, keys: list[str]) -> list[int]:
    """Pieces of each pre-token. The model itself puts one space before what it encodes."""
    counts = [len(x) for x in model.encode([k[1:] if k[0] == " " else k for k in keys], num_threads=1)]
    return [(c if k != " " else 1) if k[0] == " " else c - 1 for k, c in zip(keys, counts)]


def _slices(texts: pa.Array, step: int = 256) -> Iterator[tuple[int, list[str | None]]]:
    for at in range(0, len(texts), step):
        yield at, texts[at : at + step].to_pylist()


def _distinct(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """(piece, n): sums over what a task has read, sent on whenever `most` pre-tokens or SEEN_CHARS characters have gathered."""
    seen: Counter = Counter()
    chars = 0

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["piece", "n"])
        seen.clear()
        return batch

    for batch in batches:
        for _, texts in _slices(batch.column(0)):
            for text in texts:
                if text:
                    seen.update(pre_tokens(text))
                    chars += len(text)  # no less than what new pre-tokens hold
                    if chars > SEEN_CHARS:
                        if sum(map(len, seen)) > SEEN_CHARS // 2:
                            yield out()
                        chars = 0
            if len(seen) > most:
                yield out()
    if seen:
        yield out()


def piece_table(docs: DataFrame, text: str, model_path: str) -> DataFrame:
    """(piece, n, pieces): every distinct pre-token of the corpus, its occurrences and its pieces."""
    found = docs.select(quoted(text).cast("string")).mapInArrow(_distinct, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(count_pieces(model, batch.column(0).to_pylist()), pa.int32())], ["piece", "n", "pieces"])

    return staged(found.mapInArrow(encode, "piece string, n long, pieces int"), "piece-counts")


def frequent(pieces: DataFrame, most: int, most_bytes: int = COMMON_BYTES) -> tuple[Column, dict[str, int]]:
    """Which pre-tokens go to every task, and these with their pieces: the commonest, `most` at most and of most_bytes at most, none of more than LONGEST bytes."""
    power, size = F.floor(F.log2("n") * 8).cast("int"), F.octet_length("piece")
    by_power = {r["p"]: (r["c"], r["b"]) for r in pieces.where(size <= LONGEST).groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("c"), F.sum(size).alias("b")).collect()}
    count, held, cut = 0, 0, max(by_power, default=0) + 1
    for p in sorted(by_power, reverse=True):
        count, held = count + by_power[p][0], held + by_power[p][1]
        if count > most or held > most_bytes:
            break
        cut = p
    common = (size <= LONGEST) & (power >= cut)
    chosen = pieces.where(common).select("piece", "pieces").toPandas()
    return common, dict(zip(chosen["piece"], chosen["pieces"].tolist()))


def token_counts(docs: DataFrame, model_path: str, text: str = "text", most_frequent: int = 1 << 18, name: str = "n_tokens") -> DataFrame:
    """Return docs, without its text, with the number of tokens of each whole text.

    The `most_frequent` commonest pre-tokens at most, of COMMON_BYTES at most, go to every task in a table; the others, and
    all of more than LONGEST bytes, are joined with their counts by key, so no key of the join is common but a long one. A null text counts as empty and has no tokens. Every row is kept
    and counted by itself, also one that repeats; an empty table gives an empty result. A column of docs that has the
    result's name is replaced.
    """
    spark = docs.sparkSession
    pieces = piece_table(docs, text, model_path)
    is_common, common = frequent(pieces, most_frequent)
    shared = spark.sparkContext.broadcast(common)  # most_frequent entries and COMMON_BYTES at most
    row, key, add, carried, total = "row", "piece", "add", "carried", "total"  # the columns of docs are fields of carried
    kept = [c for c in docs.columns if c.lower() not in (text.lower(), name.lower())]
    rows = docs.select(F.monotonically_increasing_id().alias(row), quoted(text).cast("string").alias("text"), F.struct(*[quoted(c).alias(f"c{n}") for n, c in enumerate(kept)]).alias(carried) if kept else F.lit(None).cast("struct<none:int>").alias(carried))
    schema = rows.schema
    out_type = f"{row} long, {key} string, {add} long, {carried} {schema[carried].dataType.simpleString()}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            own, ids = batch.column(2), batch.column(0).to_pylist()
            for at, texts in _slices(batch.column(1)):
                rest_row, rest_key, rest_n, sums = [], [], [], []
                for r, t in zip(ids[at:], texts):
                    total = 0
                    for k, n in Counter(pre_tokens(t or "")).items():
                        c = known.get(k)
                        if c is None:
                            rest_row.append(r)
                            rest_key.append(k)
                            rest_n.append(n)
                        else:
                            total += c * n
                    sums.append(total)
                n = len(texts)
                mark = [f"\0{r}" for r in ids[at : at + n]]  # no pre-token: meets no count in the join
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[at : at + n] + rest_row, pa.int64()),
                        pa.array(mark + rest_key, pa.string()),
                        pa.array(sums + rest_n, pa.int64()),
                        pa.concat_arrays([own[at : at + n], pa.nulls(len(rest_row), own.type)]),
                    ],
                    [row, key, add, carried],
                )

    parts = rows.mapInArrow(count, out_type)
    rare = pieces.where(~is_common).select(F.col("piece").alias(key), "pieces")
    summed = parts.join(rare, key, "left").groupBy(row).agg(F.sum(F.col(add) * F.coalesce("pieces", F.lit(1))).alias(total), F.first(carried, ignorenulls=True).alias(carried))
    return summed.select(*[F.col(carried)[f"c{n}"].alias(c) for n, c in enumerate(kept)], F.col(total).alias(name))
