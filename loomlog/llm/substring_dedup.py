"""Substring dedup by prefix-partitioned suffix trees, cut at WINDOW words.

A word is removed when a window of WINDOW consecutive words that covers it
also starts earlier. In the suffix tree of all documents, such windows are the
nodes at depth WINDOW that more than one suffix reaches: every deeper internal
node lies below one of them, so trees are cut there, and runs of such nodes
along a document are its maximal repeats.

Texts are packed into chunks of bounded size, a row each. A suffix belongs to
the tree of a prefix: PREFIX words at the anchor of its window (the run of that
many words whose hash is least), which equal windows share. The prefixes are
counted first: each chunk sends the names of its own once, and is told how many
suffixes each one has. A suffix whose prefix no other chunk has is a leaf and
stays; a prefix with more suffixes than a tree may hold is lengthened to the
whole window. So trees are of bounded size, and are dealt to groups that fit
into memory. Consecutive suffixes of one tree travel as one row of word codes.

A group sorts its suffixes by rolling names of their first WINDOW words and
compares equal ones word by word (48 bits each); where names collide it sorts
the words themselves. Each chunk merges its own trees first (the first place of
a window goes on, later ones are repeats already), so a passage that a third of
all documents share reaches its group once from each chunk. Of a group that
comes in more rows than are read at once, one place of each node is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomlog.llm import _common as c

WINDOW, PREFIX = 20, 8
#: Bytes of text in a chunk (a longer text is a chunk of its own); each row counts ROW_BYTES more.
CHUNK_BYTES, ROW_BYTES = 1_500_000, 100
#: Suffixes that a group is planned for and reads at once, and suffixes beyond which a prefix is lengthened.
GROUP_WINDOWS, TREE_WINDOWS = 60_000, 30_000
#: Bytes of text whose prefixes are counted in one group.
COUNTED_BYTES = 1 << 27
#: Bytes of a word's code.
CODE = 6
#: Rows with a null id are one document after all others.
LAST = (1 << 63) - 1


def anchors(prefixes: np.ndarray, span: int) -> np.ndarray:
    """For each window the place of the least of its `span` prefix hashes, the leftmost of equals."""
    n = len(prefixes) - span + 1
    least = prefixes[:n].copy()
    for k in range(1, span):
        np.minimum(least, prefixes[k : k + n], out=least)
    offset = np.zeros(n, np.int8)
    for k in range(span - 1, -1, -1):
        offset[prefixes[k : k + n] == least] = k
    return np.arange(n) + offset


def runs(flags: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of set flags along which all of `same` stay equal."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    cut = np.diff(at) > 1
    for x in same:
        cut |= x[at[1:]] != x[at[:-1]]
    first = np.concatenate([[True], cut])
    last = np.concatenate([cut, [True]])
    return at[first], at[last] + 1


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + length), one after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of the names."""
    return ((names >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def pieces(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Of ascending buckets: each one, where it begins, and where it ends."""
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(buckets)], strict=True) if len(buckets) else ():
        yield int(buckets[a]), int(a), int(b)


def low_bytes(x: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :n]


def from_bytes(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(raw) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()


# Chunks


def _pack(size: int):
    """Consecutive rows as chunks: a name, the bytes of text, and the rows as a compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, weight = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            nonlocal name, held, weight
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                for part in held:
                    to.write_batch(part)
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([weight]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "bytes", "data"])
            name, held, weight = name + 1, [], 0
            return row

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_BYTES
            start = 0
            while start < batch.num_rows:
                upto = np.cumsum(sizes[start:])
                n = int(np.searchsorted(upto, size - weight)) + 1  # the row that fills the chunk is its last
                n = min(n, batch.num_rows - start)
                held.append(batch.slice(start, n))
                weight += int(upto[n - 1])
                start += n
                if weight >= size:
                    yield out()
        if held:
            yield out()

    return run


def opened(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def chunk_words(rows: pa.Table) -> list[list[bytes]]:
    return [x.split() if x else [] for x in rows.column(1).cast(pa.binary()).to_pylist()]


class Windows:
    """The windows of a chunk: each word's code and place, each window's tree, and which windows come first in the chunk."""

    def __init__(self, data: bytes, window: int, prefix: int):
        rows = opened(data)
        words = chunk_words(rows)
        self.window = window
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.codes = np.concatenate([*map(c.hash_words, words), np.zeros(0, np.uint64)])
        self.ids = rows.column(0).to_numpy().astype(np.int64)
        self.doc = np.repeat(np.arange(len(words)), self.lengths)
        self.start = np.arange(len(self.codes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        n = max(0, len(self.codes) - window + 1)
        whole = self.doc[:n] == self.doc[len(self.doc) - n :]
        self.places = np.flatnonzero(whole)
        self.paths = c.rolling(self.codes, window)
        prefixes = c.rolling(self.codes, prefix)
        self.at = anchors(prefixes, window - prefix + 1) if n else self.places
        self.repeat = np.zeros(n, bool)
        if len(self.places):
            _, head = nodes(self.codes, self.places, self.paths[self.places], self.ids[self.doc[self.places]], self.start[self.places], window)
            self.repeat[self.places] = ~same_place(self.ids[self.doc[self.places]], self.start[self.places], head)
        self.first = whole & ~self.repeat
        self.trees, self.tree_of, self.sizes = np.unique(prefixes[self.at[self.first]], return_inverse=True, return_counts=True)


def same_place(doc: np.ndarray, start: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Whether each is at the place of its node's head."""
    return (doc == doc[head]) & (start == start[head])


def nodes(codes: np.ndarray, at: np.ndarray, names: np.ndarray, doc: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at some places by their first words and place, and for each suffix the first one of its node.

    Suffixes are sorted by name; neighbours of one name are compared word by
    word, and if any differ (a collision of names) all are sorted by words.
    """
    order = np.lexsort((start, doc, names))
    equal = names[order[1:]] == names[order[:-1]]
    a, b = at[order[1:][equal]], at[order[:-1][equal]]
    if any((codes[a + k] != codes[b + k]).any() for k in range(window)):
        columns = [codes[at + k] for k in range(window)]
        order = np.lexsort((start, doc, *columns))
        equal = np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in columns])
    fresh = np.concatenate([[True], ~equal])
    head = np.empty(len(order), np.int64)
    head[order] = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    return order, head


# Counting prefixes


def _ask(window: int, prefix: int, buckets: int):
    """For each chunk and bucket the names of the chunk's trees: 40 bits of each, and the logarithm of its suffixes there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Windows(data.as_py(), window, prefix)
                sizes = np.ceil(np.log2(found.sizes)).astype(np.uint8)
                rows = [(bucket, chunk, low_bytes(found.trees[a:b], 5).tobytes(), sizes[a:b].tobytes()) for bucket, a, b in pieces(bucket_of(found.trees, buckets))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "chunk", "names", "sizes"])
                del found, rows
                c.release()

    return run


def _answer(rows: pa.Table) -> pa.Table:
    """For each chunk's names in one bucket the logarithm of the suffixes of all chunks, plus one; 0 where no other chunk has the prefix."""
    blobs = rows.column("names").to_pylist()
    names = np.concatenate([from_bytes(x, 5) for x in blobs])
    sizes = np.frombuffer(b"".join(rows.column("sizes").to_pylist()), np.uint8)
    _, inverse, chunks = np.unique(names, return_inverse=True, return_counts=True)
    total = np.bincount(inverse, weights=2.0**sizes)
    level = np.where(chunks > 1, 1 + np.ceil(np.log2(total)), 0).astype(np.uint8)[inverse]
    ends = np.cumsum([len(x) // 5 for x in blobs])
    starts = np.concatenate([[0], ends[:-1]])
    going = np.where(level > 0, 2.0**sizes, 0)
    out = [[level[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], [int(going[a:b].sum()) for a, b in zip(starts, ends, strict=True)]]
    c.release()
    return pa.table([rows.column("bucket"), rows.column("chunk"), pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64())], ["bucket", "chunk", "levels", "going"])


# Suffixes to groups

#: kind 0: intervals of words that repeat within the chunk. Kind 1: suffixes that go to a group.
SHIPPED = "kind int, bucket long, chunk long, runs binary, codes binary"


def _ship(window: int, prefix: int, buckets: int, tree_windows: int):
    """Over chunks with their answers."""
    limit = 1 + np.log2(tree_windows)

    def rows_of(chunk: int, data: bytes, answers: list | None) -> Iterator[tuple]:
        found = Windows(data, window, prefix)
        low, high = runs(found.repeat, found.doc[: len(found.repeat)])
        if len(low):
            yield 0, chunk % buckets, chunk, np.stack([low, high - 1 + window], 1).astype("<i8").tobytes(), None
        if not answers:
            return
        level = np.frombuffer(b"".join(x["levels"] for x in sorted(answers, key=lambda x: x["bucket"])), np.uint8)[found.tree_of]
        first = np.flatnonzero(found.first)
        going = np.zeros(len(found.first), bool)
        going[first] = level > 0
        key = np.zeros(len(going), np.uint64)
        key[first] = found.trees[found.tree_of]
        large = np.zeros(len(going), bool)
        large[first] = level > limit
        key[large] = c.mix(found.paths[large])  # the prefix is lengthened to the whole window
        low, high = runs(going, found.doc[: len(going)], found.at, key)
        bucket = bucket_of(key[low], buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, low, count = bucket[order], low[order], (high - low)[order]
        table = np.stack([low, count, found.ids[found.doc[low]], found.start[low]], 1).astype("<i8")
        words = low_bytes(found.codes, CODE)[spread(low, count + window - 1)]
        ends = np.concatenate([[0], np.cumsum(count + window - 1)])
        for b, i, j in pieces(bucket):
            yield 1, b, chunk, table[i:j].tobytes(), words[ends[i] : ends[j]].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(rows_of(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()))
                for a in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[a : a + 64], strict=True), kinds, strict=True)], ["kind", "bucket", "chunk", "runs", "codes"])
                del rows
                c.release()

    return run


class Group:
    """The trees of one bucket, read part by part; of earlier parts one suffix of each node is held."""

    def __init__(self, window: int, size: int, names: Callable = c.rolling):
        self.window, self.size, self.names = window, size, names
        self.clear()

    def clear(self) -> None:
        self.chunks, self.tables, self.codes, self.waiting = [], [], [], 0

    def add(self, chunk: int, table: bytes, codes: bytes) -> Iterator[tuple[int, bytes]]:
        rows = np.frombuffer(table, "<i8").reshape(-1, 4)
        self.chunks.append(np.full(len(rows), chunk))
        self.tables.append(rows)
        self.codes.append(from_bytes(codes, CODE))
        self.waiting += int(rows[:, 1].sum())
        if self.waiting >= self.size:
            yield from self.fold()

    def fold(self) -> Iterator[tuple[int, bytes]]:
        """Repeats among what is held, as intervals by chunk; one suffix of each node stays."""
        if not self.tables:
            return
        chunk, table, codes = np.concatenate(self.chunks), np.concatenate(self.tables), np.concatenate(self.codes)
        count, row = table[:, 1], np.repeat(np.arange(len(table)), table[:, 1])
        begin = np.cumsum(count + self.window - 1) - count - self.window + 1
        at = spread(begin, count)
        step = at - begin[row]
        word, doc, start = table[row, 0] + step, table[row, 2], table[row, 3] + step
        _, head = nodes(codes, at, self.names(codes, self.window)[at], doc, start, self.window)
        stays = same_place(doc, start, head)
        order = np.flatnonzero(~stays)
        order = order[np.lexsort((word[order], chunk[row[order]]))]
        if len(order):
            a, b = word[order], chunk[row[order]]
            cut = np.concatenate([[True], (np.diff(a) > 1) | (b[1:] != b[:-1])])
            low, high, owner = a[cut], a[np.concatenate([cut[1:], [True]])] + self.window, b[cut]
            spans = np.stack([low, high], 1).astype("<i8")
            for name, i, j in pieces(owner):
                yield name, spans[i:j].tobytes()
        keep = np.flatnonzero(stays)
        self.chunks = [chunk[row[keep]]]
        self.tables = [np.stack([word[keep], np.ones(len(keep), np.int64), doc[keep], start[keep]], 1)]
        self.codes = [codes[(at[keep][:, None] + np.arange(self.window)).ravel()]]
        self.waiting = 0


def _groups(window: int, size: int):
    """Over rows of SHIPPED sorted by kind and bucket: intervals of words that repeat, by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, now = Group(window, size), None

        def out(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary())], ["chunk", "spans"])

        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                kind, bucket, chunk, table, codes = (batch.column(k)[i].as_py() for k in range(5))
                if kind == 0:
                    found.append((chunk, table))
                    continue
                if bucket != now:
                    found += group.fold()
                    group.clear()
                    now = bucket
                found += group.add(chunk, table, codes)
            yield from out(found)
        yield from out(list(group.fold()))
        group.clear()
        c.release()

    return run


# Cutting


def _keep(columns: list[str]):
    """Over chunks with the intervals of their words that go: the rows, without these words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = opened(batch.column(0)[i].as_py())
                words = chunk_words(rows)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
                spans = np.frombuffer(b"".join(batch.column(1)[i].as_py() or ()), "<i8").reshape(-1, 2)
                change = np.zeros(int(ends[-1]) + 1, np.int64)
                np.add.at(change, spans[:, 0], 1)
                np.add.at(change, spans[:, 1], -1)
                keep = np.cumsum(change)[:-1] == 0
                left, digests, texts = [], [], []
                for own, end, text in zip(words, ends.tolist(), rows.column(1), strict=True):
                    mine = keep[end - len(own) : end]
                    kept = own if mine.all() else [w for w, k in zip(own, mine.tolist(), strict=True) if k]
                    joined = b" ".join(kept)
                    left.append(len(kept))
                    digests.append(hashlib.sha256(joined).hexdigest())
                    texts.append(joined.decode("utf-8", "surrogatepass") if len(kept) < len(own) else text.as_py())
                n_words = np.diff(ends, prepend=0)
                made = [pa.array(n_words), pa.array(n_words - np.array(left, np.int64)), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
                others = [x.combine_chunks() for x in rows.columns]
                yield from pa.table([others[2], *made, *others[3:]], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", *columns]).combine_chunks().to_batches()
            c.release()

    return run


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, kept, and the column to keep, if one is given, as `row`.

    kept is the text itself where nothing goes, else the words that stay,
    joined by a space. A null or blank text has no words; a text of fewer words
    than a window loses none. Rows that share an id are places of one document:
    at equal starts none is earlier. Rows with a null id are one document after
    all others. Further columns are not read. The chunks are stored in the
    scratch folder and shuffled, compressed, to meet the counts of their
    prefixes and again to meet their intervals; of the words, those of suffixes
    whose prefix another chunk has too are shuffled.
    """
    spark, folder, prefix = docs.sparkSession, c.scratch(docs.sparkSession, "substrings"), min(PREFIX, window)
    more = [] if keep is None else [keep.alias("row")]
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(doc_id, F.lit(LAST)).alias("doc"), F.col(text_col).cast("string").alias("text"), doc_id.alias("doc_id"), *more)
    schema = StructType([*StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string, kept string").fields, *rows.schema.fields[3:]])
    chunks = c.stored(rows.mapInArrow(_pack(CHUNK_BYTES), "chunk long, bytes long, data binary"), f"{folder}/chunks")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    asked = chunks.select("chunk", "data").mapInArrow(_ask(window, prefix, max(n, -(-total // COUNTED_BYTES))), "bucket long, chunk long, names binary, sizes binary")
    answers = c.stored(asked.groupBy("bucket").applyInArrow(_answer, "bucket long, chunk long, levels binary, going long"), f"{folder}/answers")
    buckets = max(n, -(-(answers.agg(F.sum("going")).first()[0] or 0) // GROUP_WINDOWS))
    told = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "levels")).alias("answers"))
    shipped = chunks.join(told, "chunk", "left").select("chunk", "data", "answers").mapInArrow(_ship(window, prefix, buckets, TREE_WINDOWS), SHIPPED)
    spans = shipped.repartition(n, "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(_groups(window, GROUP_WINDOWS), "chunk long, spans binary")
    gone = spans.groupBy("chunk").agg(F.collect_list("spans").alias("spans"))
    return chunks.join(gone, "chunk", "left").select("data", "spans").mapInArrow(_keep(["row"] * len(more)), schema)
