"""Token-id files: each document compressed separately under one shared zstandard dictionary.

The dictionary is trained on serialised id arrays of a bounded, deterministic
sample of documents (DICTIONARY_DOCS documents, DICTIONARY_CLIP bytes of each);
every document of the table is encoded and written. Layout of a file:

    "LMTK" | version u32 | SHA-256 of the dictionary (32 bytes)
    frames, one for each document, in ascending document id
    index: n x (document id i64, offset u64, ids u32, crc32 u32, id known u8)
    n u64 | offset of the index u64 | "LMTK"

Ids are little-endian unsigned 32-bit integers. A reader finds a document by
binary search in the index and decompresses its frame alone.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import _common as c

VOCABULARY, END_ID = "word_bpe_49k.json", 2
#: The bounded sample that the dictionary is trained on, and the dictionary's size.
DICTIONARY_DOCS, DICTIONARY_CLIP, DICTIONARY_BYTES = 1000, 4096, 65536
#: Documents aimed at for each file, so that a file stays some 10 to 100 MB.
DOCS_PER_FILE = 10_000
#: Words kept in the cache of one Python worker; it is emptied when full.
CACHE_WORDS = 1_000_000
MAGIC, HEAD, FOOT = b"LMTK", "<4sI32s", "<QQ4s"
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("ids", "<u4"), ("crc", "<u4"), ("known", "u1")])


class Encoder:
    """Whole texts to serialised ids by the tokenizers library.

    The vocabulary drops white space, and neither its normaliser nor its
    pattern joins text across ASCII white space, so a text's ids are those of
    its words in a row. It also lower-cases, and starts a token where a comma or
    full stop follows a letter, so words are looked up in lower case and
    apart from that sign. New words go to the library in one batch. A text that may hold a special token goes to the library whole.
    """

    def __init__(self, path: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.end = b"" if end_id is None else struct.pack("<I", end_id)
        self.cache: dict[bytes, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.word_ends = None
        if suffix:  # the last id of a word shows that the word ends
            self.word_ends = np.zeros(max(vocab.values()) + 1, bool)
            self.word_ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True

    def batch(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[bytes]) -> None:
        plain = [w for w in new if PLAIN.fullmatch(w)] if self.word_ends is not None else []
        for start in range(0, len(plain), 1000):
            part = plain[start : start + 1000]
            ids = np.frombuffer(self.batch([b" ".join(part).decode()])[0], "<u4")
            ends = [0, *(4 * (np.flatnonzero(self.word_ends[ids]) + 1)).tolist()]
            raw = ids.tobytes()
            self.cache.update(zip(part, [raw[a:b] for a, b in pairwise(ends)], strict=True))
        rest = [w for w in new if w not in self.cache]
        for start in range(0, len(rest), 10_000):
            part = rest[start : start + 10_000]
            self.cache.update(zip(part, self.batch([w.decode("utf-8", "surrogatepass") for w in part]), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        split = [[] if b"<|" in x else AFTER_LETTER.sub(rb"\1 \2", x.lower()).split() for x in raw]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        get = self.cache.get
        found = [[*map(get, ws)] for ws in split]
        lacking = [i for i, ids in enumerate(found) if None in ids]
        if lacking:
            new = [*{w for i in lacking for w, ids in zip(split[i], found[i], strict=True) if ids is None}]
            self.learn(new)
            for i in lacking:
                found[i] = [get(w) if ids is None else ids for w, ids in zip(split[i], found[i], strict=True)]
        out = [b"".join(ids) + self.end for ids in found]
        for i, x in enumerate(raw):
            if b"<|" in x:
                out[i] = self.batch([texts[i]])[0] + self.end
        if any(len(t or "") > 100_000 for t in texts):  # long words do not stay
            self.cache = {w: ids for w, ids in self.cache.items() if len(w) <= 256}
        return out


#: A letter (ASCII or Latin-1) and a sign after it; the apostrophe of a contraction belongs to a token with letters.
LETTER = rb"[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
AFTER_LETTER = re.compile(rb"(" + LETTER + rb")([!-&(-/:-@\[-`{-~])")
#: Words that are one token to the pattern.
PLAIN = re.compile(rb"(?:" + LETTER + rb")+")
_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None) -> Encoder:
    key = (path, end_id)
    if key not in _encoders:
        _encoders[key] = Encoder(path, end_id)
    return _encoders[key]


def train(docs: DataFrame, vocabulary: str, end_id: int | None) -> bytes:
    """A dictionary from a sample by hash of the id; raw content where the sample is too small to train on."""
    n = docs.count()
    rows = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // DICTIONARY_DOCS))) == 0).select(F.substring("text", 1, DICTIONARY_CLIP).alias("text")).limit(2 * DICTIONARY_DOCS)
    samples = [x[:DICTIONARY_CLIP] for x in Encoder(vocabulary, end_id).encode(sorted(r.text or "" for r in rows.collect()))]  # in an order of their own, so that equal rows give equal files
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES].ljust(8, b"\0")


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> DataFrame:
    """Writes docs as token files below path and returns their manifest: file, docs, ids, first_doc_id, start.

    Rows are range-partitioned by id; each partition writes one file under a
    temporary name, renamed when whole, so a lost executor's task repeats
    without harm. The driver then commits dictionary and manifest. A null text
    is empty and has the end id alone; rows with a null id come first, and are
    found by reading in turn only; repeated ids are written in turn, as they
    stand. One shuffle, of the rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dictionary = train(docs, vocabulary, end_id)
    mark = hashlib.sha256(dictionary).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, end_id)
        shrink = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        index: list[tuple] = []
        at = struct.calcsize(HEAD)
        name = ""

        def chunks() -> Iterator[bytes]:
            nonlocal at
            yield struct.pack(HEAD, MAGIC, 1, mark)
            for batch in rows:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    frames = []
                    for doc_id, ids in zip(part.column(0).to_pylist(), coder.encode(part.column(1).to_pylist()), strict=True):
                        frames.append(frame := shrink.compress(ids))
                        index.append((doc_id or 0, at, len(ids) // 4, zlib.crc32(ids), doc_id is not None))
                        at += len(frame)
                    yield b"".join(frames)
            yield np.array(index, INDEX).tobytes()
            yield struct.pack(FOOT, len(index), at, MAGIC)

        rows = (b for b in batches if b.num_rows)
        first = next(rows, None)
        if first is None:
            return
        rest = rows
        rows = (b for part in ([first], rest) for b in part)
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}.tok"
        size = c.write_file(path, name, chunks())
        yield pa.RecordBatch.from_pylist([{"file": name, "docs": len(index), "ids": sum(x[2] for x in index), "first_doc_id": index[0][0] if index[0][4] else None, "bytes": size}], schema=pa.schema([("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("first_doc_id", pa.int64()), ("bytes", pa.int64())]))

    parts = files or max(spark.sparkContext.defaultParallelism, docs.count() // DOCS_PER_FILE + 1)
    written = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, "file string, docs long, ids long, first_doc_id long, bytes long").collect()
    start, manifest = 0, []
    for row in sorted(written, key=lambda r: r.file):  # one row for each file, not for each document
        manifest.append(row.asDict() | {"start": start})
        start += row.ids
    c.write_file(path, "dictionary.zdict", iter([dictionary]))
    c.write_file(path, "manifest.json", iter([json.dumps({"vocabulary": os.path.basename(vocabulary), "dictionary_sha256": mark.hex(), "files": manifest}).encode()]))
    return manifest_of(spark, path)


def manifest_of(spark: SparkSession, path: str) -> DataFrame:
    files, folder = c.filesystem(path)
    with files.open_input_stream(f"{folder}/manifest.json") as f:
        found = json.loads(f.read())
    rows = [(x["file"], x["docs"], x["ids"], x["first_doc_id"], x["start"]) for x in found["files"]]
    return spark.createDataFrame(rows, "file string, docs long, ids long, first_doc_id long, start long")


class Reader:
    """One token file, read by document."""

    def __init__(self, path: str, name: str, dictionary: bytes | None = None):
        files, folder = c.filesystem(path)
        if dictionary is None:
            with files.open_input_stream(f"{folder}/dictionary.zdict") as f:
                dictionary = f.read()
        self.file = files.open_input_file(f"{folder}/{name}")
        magic, _, mark = struct.unpack(HEAD, self.file.read_at(struct.calcsize(HEAD), 0))
        n, at, foot = struct.unpack(FOOT, self.file.read_at(struct.calcsize(FOOT), self.file.size() - struct.calcsize(FOOT)))
        if magic != MAGIC or foot != MAGIC or mark != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} is not a token file, or was written with another dictionary")
        self.index = np.frombuffer(self.file.read_at(n * INDEX.itemsize, at), INDEX)
        self.ends = np.append(self.index["offset"][1:], at)
        self.unknown = int((self.index["known"] == 0).sum())
        self.expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def at(self, i: int) -> bytes:
        """The serialised ids of the file's i-th document."""
        start = int(self.index["offset"][i])
        ids = self.expand.decompress(self.file.read_at(int(self.ends[i]) - start, start))
        if zlib.crc32(ids) != self.index["crc"][i]:
            raise ValueError(f"document {self.index['doc_id'][i]} is damaged")
        return ids

    def document(self, doc_id: int) -> np.ndarray | None:
        i = self.unknown + int(np.searchsorted(self.index["doc_id"][self.unknown :], doc_id))
        return np.frombuffer(self.at(i), "<u4") if i < len(self.index) and self.index["doc_id"][i] == doc_id else None


def read(manifest: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32, and with keep_ids the ids. A task for each file, a frame in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = Reader(path, row["file"])
                start = row["start"]
                for low in range(0, len(reader.index), 256):
                    rows = []
                    for i in range(low, min(low + 256, len(reader.index))):
                        ids = reader.at(i)
                        rows.append((int(reader.index["doc_id"][i]) if i >= reader.unknown else None, start, len(ids) // 4, zlib.crc32(ids), np.frombuffer(ids, "<u4") if keep_ids else None))
                        start += len(ids) // 4
                    columns = [pa.array(x, k) for x, k in zip(list(zip(*rows, strict=True))[: 4 + keep_ids], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())], strict=False)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + keep_ids])

    n = max(1, manifest.count())
    return manifest.select("file", "start").repartition(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else ""))
