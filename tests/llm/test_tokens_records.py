import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from labelweave.llm import record_files as R
from labelweave.llm.token_counts import token_counts
from tests.llm.data import empty, frame

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  ", "a ", "a  ", "\n", "\n\n a\n", "a \n b", "▁", "a▁▁b ▁", "日本\nx\r\n\ty", "\x00a b", "a" * 3000, "</s> <s>", "It's A.B. İstanbul ŞIŞ! Σίσυφος <|endoftext|> b", "a\x1cb c", "é. Å, '!s", None]


def test_counts_are_the_library_s(spark):
    df = frame(spark, 80).select("doc_id", "text", "size").unionByName(spark.createDataFrame([(1000 + i, t, "q") for i, t in enumerate(ODD)], "doc_id long, text string, size string"))
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted((str(r["doc_id"]), len(model.encode(r["text"] or ""))) for r in df.collect())
    for most in (5, 1 << 18):  # with and without a join of rare pre-tokens
        assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts(df, PIECES, most_frequent=most).collect()) == want
    assert token_counts(empty(spark), PIECES).count() == 0


def test_records_round_trip(spark):
    df = frame(spark, 80).select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    manifest = R.write_records(df, WORDS, end_id=2, file_bytes=20_000)
    got = R.read_records(spark, manifest).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    rows = df.collect()
    ids = {i: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2] for i, r in enumerate(rows)}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((str(r["doc_id"]), len(ids[i]), crc(ids[i])) for i, r in enumerate(rows)) == sorted((str(g["doc_id"]), g["n_tokens"], g["ids_crc32"]) for g in got)
    start = 0
    last = None
    for g in sorted(got, key=lambda g: g["start"]):
        assert g["start"] == start and (last is None or g["doc_id"] >= last)
        start += g["n_tokens"]
        last = g["doc_id"] if g["doc_id"] is not None else last
    file = max(manifest.collect(), key=lambda m: m["records"])
    whole = R.read_at(file["path"], list(range(file["records"])))
    assert [d for d, _ in R.read_at(file["path"], [file["records"] - 1, 0])] == [whole[-1][0], whole[0][0]]
    assert R.read_records(spark, R.write_records(empty(spark), WORDS, end_id=2)).count() == 0


def test_damage_is_found():
    assert R.crc32c([b"123456789"])[0] == 0xE3069283
    data = b"".join(R.frames([R.payload(5, b"\1\0\2\0", "<u2"), R.payload(None, b"", "<u2")]))
    assert [R.unpack(p)[0] for p in R.parse_frames(data)] == [5, None]
    for at in (3, 20, len(data) - 1):
        with pytest.raises((ValueError, MemoryError)):
            R.parse_frames(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])


def _differences(texts):
    encode, tokenizer = R.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    whole = [np.array(e.ids, encode.kind).tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    return [t for t, a, b in zip(texts, encode(texts), whole) if a != b]


def test_words_of_every_letter_before_closing_marks():
    letters = [c for c in map(chr, range(0x30000)) if unicodedata.category(c)[0] == "L"]
    words = [w for c in letters for w in (f"{c},", f"ab{c}.", f"{c}a!")]
    assert len(letters) > 100_000 and not _differences([" ".join(words[i : i + 60]) for i in range(0, len(words), 60)])


def test_words_of_fuzzed_texts():
    rng = random.Random(8)
    odd = "İIıßſŉǰΣςσ\u0301\u0307\u09df\u095c\ufb2a\u0915\u093f\u1e9eÅÅﬁ½²_'’.,;:!?-– \t\u00a0\u3000\x1c\n日본กุ𝒜😀"
    alphabet = odd * 3 + "abcdefgstXYZ0189"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(20_000)]
    assert not _differences(texts)
