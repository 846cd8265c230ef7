"""A count sketch of hashes, of one size whatever the input: it tells frequent items from rare ones.

A hash counts in the cell that its leading bits name. Counts are only used to
order items, so cells that items share cost work and never a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: Cells, and the parts in which they are added up. 2^24 cells of a byte are broadcast: 16 MB whatever the input.
SKETCH_BITS, SKETCH_PARTS = 24, 64
STEP = (1 << SKETCH_BITS) // SKETCH_PARTS


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


class Tally:
    """The sketch of one task."""

    def __init__(self):
        self.counts, self.waiting, self.size = np.zeros(1 << SKETCH_BITS, np.uint32), [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(hashes >> np.uint64(64 - SKETCH_BITS))
        self.size += len(hashes)
        if self.size > 1_000_000:
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            found, times = np.unique(np.concatenate(self.waiting), return_counts=True)
            self.counts[found.astype(np.int64)] += times.astype(np.uint32)
            self.waiting, self.size = [], 0

    def parts(self) -> Iterator[tuple[int, bytes]]:
        self.settle()
        shrink = zstandard.ZstdCompressor(level=3)
        for part, counts in enumerate(self.counts.reshape(SKETCH_PARTS, -1)):
            if counts.any():  # a byte a cell where that holds the counts
                yield part, shrink.compress(counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes())


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the parts of all tasks, and rounds counts to a byte, four steps for each doubling."""
    sums: dict[int, np.ndarray] = {}
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = expand.decompress(blob)
            counts = np.frombuffer(raw, np.uint8 if len(raw) == STEP else np.uint32)
            sums[part] = sums[part] + counts if part in sums else counts.astype(np.uint64)
    for part, counts in sums.items():
        levels = np.minimum(255, 4 * np.log2(1.0 + counts)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([levels.tobytes()], pa.binary())], ["part", "blob"])


def levels(parts: DataFrame) -> bytes:
    """The level of each cell, from all tasks' (part, blob) rows: 64 rows of 256 KB come to the driver."""
    out = bytearray(1 << SKETCH_BITS)
    for row in parts.repartition(SKETCH_PARTS, "part").mapInArrow(add_up, "part int, blob binary").collect():
        out[row.part * STEP : (row.part + 1) * STEP] = row.blob
    return bytes(out)
