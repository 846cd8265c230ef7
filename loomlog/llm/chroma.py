"""Chroma audio fingerprints: packed integers from filters over pitch-class frames, and their alignment.

A recording becomes frames of 12 pitch-class energies. Over the integral image
of the frames, sixteen rectangle filters compare the energy of neighbouring
areas; each answer is two bits in Gray code, and a place in time is one 32-bit
integer. Two recordings align at the offset that most of their equal integers
vote for (the offset histogram), and match when few bits differ there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm import _common as c

PITCHES, WIDTH = 12, 8
#: Filters by rule: which areas they compare, first pitch, pitches, frames.
FILTERS = tuple((i % 5, (i * 5) % 7, 4 + 2 * (i % 2), (4, 6, 8)[i % 3]) for i in range(16))
#: Log ratio beyond which an answer counts as strong, and what is added to areas before they are compared.
STRONG, FLOOR = 0.2, 0.05
#: Votes at one offset that make a candidate, places that must overlap, and the share of bits that may differ.
MIN_VOTES, MIN_OVERLAP, MAX_ERROR = 1, 16, 0.08
#: A vote needs an equal integer, and equal signs of the first SIGNS filters WIDTH places later: without these, chance meetings outnumber matches.
SIGNS = 8
#: Query classes in a block (some 0.8 kB each in a worker), classes that a worker holds while it reads the blocks, and equal keys that it counts at a time. None of them leaves any out.
BLOCK, HELD, MEETINGS = 200_000, 500_000, 100_000
LINK_COLUMNS = ["query_class", "match_class", "offset", "votes", "overlap", "bit_errors"]
#: Samples in an analysis window of audio, their step, and the range of pitches in Hz.
FFT, STEP, LOW_HZ, HIGH_HZ = 4096, 1365, 28.0, 3520.0


def audio_frames(samples: np.ndarray, rate: int) -> np.ndarray:
    """Pitch-class frames of mono audio: the energy of a windowed spectrum, folded into the twelve pitch classes."""
    n = 1 + (len(samples) - FFT) // STEP if len(samples) >= FFT else 0
    if not n:
        return np.zeros((0, PITCHES))
    cut = np.lib.stride_tricks.sliding_window_view(samples.astype(float), FFT)[::STEP][:n]
    power = np.abs(np.fft.rfft(cut * np.hanning(FFT), axis=1)) ** 2
    hz = np.fft.rfftfreq(FFT, 1 / rate)
    used = (hz >= LOW_HZ) & (hz <= HIGH_HZ)
    pitch = np.round(12 * np.log2(hz[used] / 440.0)).astype(int) % PITCHES
    fold = np.zeros((int(used.sum()), PITCHES))
    fold[np.arange(len(pitch)), pitch] = 1
    return power[:, used] @ fold


def vector_frames(vectors: np.ndarray) -> np.ndarray:
    """Frames of a recording that is given as a row of amplitudes: twelve neighbouring ones for each frame."""
    return np.abs(np.lib.stride_tricks.sliding_window_view(np.nan_to_num(vectors, posinf=0, neginf=0), PITCHES, axis=1))


def fingerprints(frames: np.ndarray) -> np.ndarray:
    """Packed integers (recordings x places) of equally long recordings (recordings x frames x pitches)."""
    n, t, _ = frames.shape
    places = max(0, t - WIDTH + 1)
    out = np.zeros((n, places), np.uint32)
    if not places:
        return out
    level = frames / np.maximum(frames.sum(2, keepdims=True), 1e-12)
    image = np.zeros((n, t + 1, PITCHES + 1))
    image[:, 1:, 1:] = level.cumsum(1).cumsum(2)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        at = lambda a, b: image[:, a : a + places, b]
        return at(t1, p1) - at(t0, p1) - at(t1, p0) + at(t0, p0)

    for i, (kind, p, h, w) in enumerate(FILTERS):
        whole = area(0, w, p, p + h)
        if kind == 0:
            a = area(0, w, p, p + h // 2)
        elif kind == 1:
            a = area(0, w // 2, p, p + h)
        elif kind == 2:
            a = area(0, w // 2, p, p + h // 2) + area(w // 2, w, p + h // 2, p + h)
        elif kind == 3:
            a = area(0, w, p + h // 4, p + h - h // 4)
        else:
            a = area(w // 4, w - w // 4, p, p + h)
        ratio = np.log((a + FLOOR) / (whole - a + FLOOR))
        step = (ratio > -STRONG).astype(np.uint32) + (ratio > 0) + (ratio > STRONG)
        out |= (step ^ (step >> np.uint32(1))) << np.uint32(2 * i)
    return out


def fingerprint_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and fingerprint (array of int) of each row. A null or short vector has an empty fingerprint; null and NaN elements are silence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list = [[]] * batch.num_rows
            rows = [np.array([0.0 if v is None else v for v in x], float) if x else np.zeros(0) for x in batch.column(1).to_pylist()]
            for length in {len(x) for x in rows if len(x) >= PITCHES}:
                at = [i for i, x in enumerate(rows) if len(x) == length]
                for i, print_ in zip(at, fingerprints(vector_frames(np.stack([rows[i] for i in at]))).view(np.int32).tolist(), strict=True):
                    found[i] = print_
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["id", "fingerprint"])

    return table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>")).mapInArrow(run, "id long, fingerprint array<int>")


class Prints:
    """Fingerprints laid end to end, with the votes' keys: a place's integer, and signs from WIDTH places later."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
        prints = table.column("fingerprint").combine_chunks()
        prints = prints if isinstance(prints, pa.Array) else pa.concat_arrays(prints.chunks)
        self.names = table.column("class").to_numpy()
        self.size = prints.value_lengths().to_numpy().astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = prints.flatten().to_numpy().view(np.uint32)
        whole = np.repeat(np.arange(len(self.size)), self.size)
        place = np.arange(len(self.flat)) - self.start[whole]
        at = np.flatnonzero(place < self.size[whole] - WIDTH)
        later = np.uint64(sum(2 << (2 * i) for i in range(SIGNS)))
        self.keys = self.flat[at].astype(np.uint64) | ((self.flat[at + WIDTH].astype(np.uint64) & later) << np.uint64(32))
        self.row, self.place = whole[at].astype(np.int32), place[at].astype(np.int32)

    def sort(self) -> Prints:
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.row, self.place = self.keys[order], self.row[order], self.place[order]
        return self


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def best_offsets(asked: Prints, rows: Prints, low: np.ndarray, size: np.ndarray, keys: slice) -> tuple[np.ndarray, ...]:
    """Of some keys of rows (all those of a row): asked row, row, offset and votes where most equal keys vote for it, of equals the smallest shift."""
    met = spread(low[keys], size[keys])
    query, row = asked.row[met], np.repeat(rows.row[keys], size[keys])
    offset = asked.place[met] - np.repeat(rows.place[keys], size[keys])
    order = np.lexsort((offset, row, query))
    query, row, offset = query[order], row[order], offset[order]
    first = np.flatnonzero(np.r_[True, (query[1:] != query[:-1]) | (row[1:] != row[:-1]) | (offset[1:] != offset[:-1])]) if len(query) else np.zeros(0, np.int64)
    votes = np.diff(np.r_[first, len(query)])
    query, row, offset = query[first], row[first], offset[first]
    enough = votes >= MIN_VOTES
    query, row, offset, votes = query[enough], row[enough], offset[enough], votes[enough]
    order = np.lexsort((offset, -np.abs(offset), votes, row, query))
    query, row, offset, votes = query[order], row[order], offset[order], votes[order]
    last = np.r_[(query[1:] != query[:-1]) | (row[1:] != row[:-1]), True] if len(query) else np.zeros(0, bool)
    return query[last], row[last], offset[last].astype(np.int64), votes[last]


def matches(asked: Prints, rows: Prints, max_error: float) -> Iterator[pa.RecordBatch]:
    """The links of rows to the sorted asked ones, some MEETINGS equal keys at a time."""
    low = np.searchsorted(asked.keys, rows.keys, "left")
    size = np.searchsorted(asked.keys, rows.keys, "right") - low
    total = np.cumsum(size)
    ends = np.flatnonzero(np.r_[rows.row[1:] != rows.row[:-1], True]) + 1
    met, at = total[ends - 1], 0
    while at < len(rows.keys):
        done = total[at - 1] if at else 0
        to = ends[max(np.searchsorted(met, done + MEETINGS, "right") - 1, np.searchsorted(ends, at, "right"))]
        query, row, offset, votes = best_offsets(asked, rows, low, size, slice(at, to))
        at = to
        a, b = np.maximum(offset, 0), np.maximum(-offset, 0)
        overlap = np.minimum(asked.size[query] - a, rows.size[row] - b)
        good = (overlap >= MIN_OVERLAP) & (asked.names[query] != rows.names[row])
        query, row, offset, votes, a, b, overlap = (x[good] for x in (query, row, offset, votes, a, b, overlap))
        if not len(query):
            continue
        bits = np.bitwise_count(asked.flat[spread(asked.start[query] + a, overlap)] ^ rows.flat[spread(rows.start[row] + b, overlap)])
        bits = np.add.reduceat(bits.astype(np.int64), np.cumsum(overlap) - overlap)
        good = bits <= max_error * 32 * overlap
        found = (asked.names[query], rows.names[row], offset.astype(np.int32), votes.astype(np.int64), overlap.astype(np.int32), bits.astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in found], LINK_COLUMNS)


def align(prints: DataFrame, queries: Column, max_error: float = MAX_ERROR, block: int = BLOCK) -> DataFrame:
    """Classes of recordings that match a query's class: query_class, match_class, offset, votes, overlap, bit_errors.

    prints: (id, fingerprint); queries: a condition on id. Recordings of equal
    fingerprints are one class, named by its least id (`members` lists
    them), so copies are compared once; a class matches itself. Fingerprints
    shorter than MIN_OVERLAP, and null ids, match nothing. Of offsets with equally many votes the smallest shift counts.

    The queries' keys are sorted in blocks, and every class is looked up in
    each block. Equal keys are counted where they meet: only links leave a task.
    """
    spark, folder = prints.sparkSession, c.scratch(prints.sparkSession, "align")
    rows = prints.where((F.size("fingerprint") >= MIN_OVERLAP) & F.col("id").isNotNull())
    classes = c.stored(rows.groupBy("fingerprint").agg(F.min("id").alias("class"), F.max(queries.cast("int")).alias("asked")), f"{folder}/classes")
    asked = classes.where("asked = 1")
    blocks = -(-asked.count() // block)
    c.stored(asked.select("class", "fingerprint", F.pmod(F.xxhash64("class"), F.lit(max(blocks, 1))).cast("int").alias("block")).repartition(max(blocks, 1), "block"), f"{folder}/asked", "block")

    def load(number: int) -> Prints | None:
        files, path = c.filesystem(f"{folder}/asked/block={number}")
        if files.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        return Prints(pq.read_table(path, filesystem=files, columns=["class", "fingerprint"], partitioning=None)).sort()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, held, n, index = None, [], 0, None

        def look() -> Iterator[pa.RecordBatch]:
            nonlocal have, index
            for number in range(blocks):
                if have != number:
                    index = None
                    index, have = load(number), number
                for some in held if index is not None else ():
                    yield from matches(index, Prints(some), max_error)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                yield from look()
                held, n = [], 0
        if n:
            yield from look()

    found = classes.select("class", "fingerprint").mapInArrow(run, "query_class long, match_class long, offset int, votes long, overlap int, bit_errors int")
    # with itself a class agrees in every place, so it need not meet itself there
    own = asked.select(F.col("class").alias("query_class"), F.col("class").alias("match_class"), F.lit(0).alias("offset"), (F.size("fingerprint") - WIDTH).cast("long").alias("votes"), F.size("fingerprint").alias("overlap"), F.lit(0).alias("bit_errors"))
    return found.unionByName(own)


def members(prints: DataFrame) -> DataFrame:
    """id and class (the least id with its fingerprint) of each recording; the class is null where it cannot match."""
    rows = prints.where((F.size("fingerprint") >= MIN_OVERLAP) & F.col("id").isNotNull())
    classes = rows.groupBy("fingerprint").agg(F.min("id").alias("class"))
    return prints.join(classes, "fingerprint", "left").select("id", F.when(F.col("id").isNotNull(), F.col("class")).alias("class"))
