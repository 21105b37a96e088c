"""Token ids in length-delimited binary records, with an offset index beside each file.

A file is a row of frames: length (8 bytes), masked CRC-32C of those 8 bytes (4), payload, masked CRC-32C of the
payload (4); all numbers little-endian. A payload is the document's id (8 bytes), flags (1: no id, 2: ids of 4 bytes),
three zero bytes, the number of ids (4) and the ids, 2 bytes each for vocabularies up to 65,536. The index has for
each record the offset of its frame (8), its document's id (8), its number of ids (4) and 1 if it has no id (4), so a reader
can fetch records in any order. A manifest table lists the files of the tasks that succeeded, in order; files that a
lost task left behind are in no manifest and never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelweave.llm.common import shared_dir, staged

HEAD = struct.Struct("<qB3xI")
INDEX = np.dtype([("offset", "<u8"), ("doc_id", "<i8"), ("n", "<u4"), ("flags", "<u4")])
NO_ID, WIDE = 1, 2
MANIFEST = "part int, seq int, path string, records long, tokens long, bytes long"
#: The CRC-32C polynomial, bits reversed, and the constant that masks a checksum stored beside its data.
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1))
    return t


def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """For 8-byte blocks: a table for each of the 8 places; and tables that move a checksum on by 8, 16, 32, ... zero bytes."""
    one = _byte_table()
    places = [one]
    for _ in range(7):
        places.append((places[-1] >> np.uint32(8)) ^ one[places[-1] & 255])
    zero = np.stack([one, *[(np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(3)]])  # by one zero byte: low byte looked up, others moved down

    def apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return tables[0][crc & 255] ^ tables[1][(crc >> np.uint32(8)) & 255] ^ tables[2][(crc >> np.uint32(16)) & 255] ^ tables[3][crc >> np.uint32(24)]

    move, out = zero, []
    for k in range(30):
        if k >= 3:
            out.append(move)
        move = np.stack([apply(move, row) for row in move])
    return np.stack(places[::-1]), out


_PLACES, _MOVES = _tables()


def crc32c(messages: list[bytes]) -> np.ndarray:
    """CRC-32C of each message of at least 4 bytes, all in one go."""
    sizes = np.array([len(m) for m in messages], dtype=np.int64)
    blocks = (sizes + 7) // 8
    ends = np.cumsum(blocks)
    data = np.frombuffer(b"".join(b"\0" * (-len(m) % 8) + m for m in messages), dtype=np.uint8).copy()
    first = ends * 8 - sizes
    for k in range(4):  # the register starts with all bits set
        data[first + k] ^= 255
    grid = data.reshape(-1, 8)
    crc = _PLACES[0][grid[:, 0]]
    for k in range(1, 8):
        crc = crc ^ _PLACES[k][grid[:, k]]
    left = np.repeat(ends, blocks) - 1 - np.arange(len(grid))  # blocks that follow in the message
    for k in range(int(left.max(initial=0)).bit_length()):
        at = np.flatnonzero((left >> k) & 1)
        x, t = crc[at], _MOVES[k]
        crc[at] = t[0][x & 255] ^ t[1][(x >> np.uint32(8)) & 255] ^ t[2][(x >> np.uint32(16)) & 255] ^ t[3][x >> np.uint32(24)]
    return np.bitwise_xor.reduceat(crc, ends - blocks) ^ np.uint32(0xFFFFFFFF) if len(messages) else crc


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def payload(doc_id: int | None, ids: bytes, kind: str) -> bytes:
    width = np.dtype(kind).itemsize
    return HEAD.pack(doc_id or 0, NO_ID * (doc_id is None) | WIDE * (width == 4), len(ids) // width) + ids


def unpack(record: bytes) -> tuple[int | None, np.ndarray]:
    """The document's id and its token ids."""
    d, flags, n = HEAD.unpack_from(record)
    ids = np.frombuffer(record, "<u4" if flags & WIDE else "<u2", offset=HEAD.size)
    if len(ids) != n:
        raise ValueError(f"a record of {n} ids holds {len(ids)}")
    return None if flags & NO_ID else d, ids


def frames(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    head_sums, sums = masked(crc32c(heads)).tolist(), masked(crc32c(payloads)).tolist()
    return [h + struct.pack("<I", a) + p + struct.pack("<I", b) for h, a, p, b in zip(heads, head_sums, payloads, sums)]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Memo:
    """Remembers bytes by string: what was asked for lately, in two generations of `most` entries or so."""

    def __init__(self, most: int) -> None:
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys: set[str]) -> list[str]:
        """Keys that aren't remembered; the others are in self.new from now on."""
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        new, old, out = self.new, self.old, []
        for k in keys:
            if k not in new:
                if k in old:
                    new[k] = old[k]
                else:
                    out.append(k)
        return out


#: Closing marks that the tokenizer always cuts off after a letter of ASCII. Other letters may end in a combining mark once normalised, which it doesn't part from punctuation.
MARKS = ".,;:!?"


class WordEncoder:
    """Encodes whole texts word by word, each distinct word once as long as it is remembered.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids one after another.
    Marks at a word's end are encoded apart from it, and Latin words in lower case, as the tokenizer does by itself.
    Texts in which a special token's string occurs are encoded whole.
    """

    def __init__(self, path: str, most: int = 250_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.words, self.cores = Memo(most), Memo(3 * most)

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        """Words of lower-case letters alone in one call; the encoding tells which word an id belongs to."""
        e = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids, word = np.array(e.ids, self.kind), np.array(e.word_ids, np.int64)
        cut = np.flatnonzero(np.diff(word)) + 1
        if len(cut) + 1 != len(words):
            return self._bytes(words)
        raw, cut = ids.tobytes(), (cut * ids.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *cut], [*cut, len(raw)])]

    def _learn(self, words: list[str]) -> None:
        cores, marks, simple = [], [], lambda x: max(x) < "\u0130"  # up to there lower case is a matter of one character for one
        for w in words:
            core = w.rstrip(MARKS)
            if core is not w and len(core) < len(w) and not ("a" <= core[-1:] <= "z" or "A" <= core[-1:] <= "Z"):
                core = w
            marks.append(w[len(core) :])
            cores.append(core.lower() if core and (core.isascii() or simple(core)) else core)
        new = self.cores.missing({*cores, *marks})
        plain = [x for x in new if x.isalpha() and x.islower() and (x.isascii() or simple(x))]
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            self.cores.new.update(zip(part, self._together(part)))
        new = [x for x in new if x not in self.cores.new]
        for at in range(0, len(new), 4096):
            self.cores.new.update(zip(new[at : at + 4096], self._bytes(new[at : at + 4096])))
        known = self.cores.new
        self.words.new.update(zip(words, [known[a] + known[b] if b else known[a] for a, b in zip(cores, marks)]))

    def __call__(self, texts: list[str]) -> list[bytes]:
        whole = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        split = [[] if i in whole else t.replace("\n", " ").split(" ") for i, t in enumerate(texts)]
        self._learn(self.words.missing(set().union(*split)))
        known = self.words.new
        out = [b"".join([known[w] for w in ws]) for ws in split]
        for i in whole:
            out[i] = self._bytes([texts[i]])[0]
        return out


_ENCODERS: dict = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, text: str = "text", doc_id: str = "doc_id", file_bytes: int = 512 << 20) -> DataFrame:
    """Encode every whole text, append end_id, write records in ascending order of doc_id; return the manifest.

    A null text counts as empty: its record holds end_id alone. Rows without a doc_id come first; rows that repeat
    each get a record, ties in the order of a hash of the text. Very long texts make long records; files are closed
    once they pass file_bytes. An empty table gives an empty manifest. Other columns are not written.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    rows = rows.repartitionByRange(F.col("d").asc_nulls_first(), "h").sortWithinPartitions(F.col("d").asc_nulls_first(), "h").select("d", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], encode.kind).tobytes()
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        out, index, at, done = None, [], 0, []

        def close() -> None:
            nonlocal out, index, at, seq
            out.close()
            table = np.array(index, INDEX)
            with store.open_output_stream(f"{base}/{name}.idx") as f:
                f.write(table.tobytes())
            done.append((part, seq, f"{folder}/{name}", len(table), int(table["n"].sum()), at))
            out, index, at, seq = None, [], 0, seq + 1

        for batch in batches:
            for i in range(0, len(batch), 512):
                ids, texts = (batch.column(k)[i : i + 512].to_pylist() for k in (0, 1))
                payloads = [payload(d, x + end, encode.kind) for d, x in zip(ids, encode(texts))]
                for d, p, frame in zip(ids, payloads, frames(payloads)):
                    if out is None:
                        name = f"part-{part:05d}-{seq:03d}-{uuid.uuid4().hex}"
                        out = store.open_output_stream(f"{base}/{name}.rec")
                    index.append((at, d or 0, len(unpack(p)[1]), d is None))
                    out.write(frame)
                    at += len(frame)
                if at > file_bytes:
                    close()
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["part", "seq", "path", "records", "tokens", "bytes"])

    return staged(rows.mapInArrow(write, MANIFEST), "manifest")


def parse_frames(data: bytes, where: str = "") -> list[bytes]:
    """The payloads of whole frames, their checksums verified."""
    heads, payloads, said, at = [], [], [], 0
    while at < len(data):
        heads.append(data[at : at + 8])
        n = int.from_bytes(heads[-1], "little")
        payloads.append(data[at + 12 : at + 12 + n])
        said += [data[at + 8 : at + 12], data[at + 12 + n : at + 16 + n]]
        if len(said[-1]) < 4:
            raise ValueError(f"{where}: a record is cut off at byte {at}")
        at += 16 + n
    stored = np.frombuffer(b"".join(said), "<u4").reshape(-1, 2)
    if heads and ((stored[:, 0] != masked(crc32c(heads))) | (stored[:, 1] != masked(crc32c(payloads)))).any():
        raise ValueError(f"{where}: a checksum doesn't match")
    return payloads


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_bytes): what the files of a manifest hold, read with their indexes.

    start counts the ids of all records before, over all files; ids_crc32 is over the ids as 4-byte little-endian
    numbers. A damaged file raises an error. An empty manifest gives an empty result.
    """
    files = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))  # a row for each file
    n_files = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, file = _store(path)
                with store.open_input_stream(f"{file}.idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                with store.open_input_file(f"{file}.rec") as f:
                    size = f.size()
                    offsets = np.append(index["offset"].astype(np.int64), size)
                    i = 0
                    while i < len(index):
                        j = min(len(index), max(i + 1, int(np.searchsorted(offsets, offsets[i] + (4 << 20), "right")) - 1))
                        out = []
                        for p, entry in zip(parse_frames(f.read_at(int(offsets[j] - offsets[i]), int(offsets[i])), path), index[i:j]):
                            d, ids = unpack(p)
                            if len(ids) != entry["n"] or (d or 0) != entry["doc_id"]:
                                raise ValueError(f"{path}: record and index differ")
                            out.append((d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(p)))
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["doc_id", "start", "n_tokens", "ids_crc32", "n_bytes"])
                        i = j

    return files.select("path", "base").repartition(n_files).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, n_bytes long")


def read_at(path: str, positions: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Shuffled read: the records at these places of one file, by its index."""
    store, file = _store(path)
    with store.open_input_stream(f"{file}.idx") as f:
        index = np.frombuffer(f.read(), INDEX)
    out = []
    with store.open_input_file(f"{file}.rec") as f:
        ends = np.append(index["offset"].astype(np.int64), f.size())
        for i in positions:
            (p,) = parse_frames(f.read_at(int(ends[i + 1] - ends[i]), int(ends[i])), path)
            out.append(unpack(p))
    return out
