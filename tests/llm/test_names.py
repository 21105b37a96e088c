import public_tokenizers
import pytest
from pyspark.sql import functions as F

from labelweave.llm.bag_minhash import near_duplicates
from labelweave.llm.decontamination import decontaminate
from labelweave.llm.language_id import identify
from labelweave.llm.line_dedup import dedup_lines
from labelweave.llm.mixing import mix_sources
from labelweave.llm.sharding import content_key, shard_records, text_size
from labelweave.llm.token_counts import token_counts
from tests.llm.data import EXTRA, frame

OPERATORS = {
    "lines": (dedup_lines, ("n_lines", "n_dropped", "dropped_lines", "kept_text")),
    "shards": (lambda df: shard_records(df, 4, text_size(), (content_key(), F.col("doc_id"))), ("size", "shard", "slot")),
    "mixture": (mix_sources, ("mix_block", "mix_slot", "mix_pos")),
    "benchmark": (lambda df: decontaminate(df, df.sparkSession.createDataFrame([(1, "alpha beta gamma delta river stone")], "item_id long, text string")), ("contaminated", "item_id", "score", "n_items")),
    "tokens": (lambda df: token_counts(df, public_tokenizers.path("piece_bpe_32k.model")), ("n_tokens",)),
    "language": (lambda df: identify(df, declared=F.col("lang"), host=F.col("source")), ("lang_id", "lang_p", "lang_ok")),
    "near": (near_duplicates, ("class_id", "class_size", "keep")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_any_name_pass_unchanged(spark, name):
    operator, results = OPERATORS[name]
    df = frame(spark)
    got = operator(df)
    lower = [c.lower() for c in got.columns]
    assert len(set(lower)) == len(lower) and set(results) <= set(got.columns)
    kept = [c for c in ["doc_id", *EXTRA] if c.lower() not in results]
    assert set(kept) <= set(got.columns)
    rows = lambda x: sorted(map(str, x.select(*[F.col(f"`{c}`") for c in kept]).collect()))
    assert rows(got) == rows(df)
