"""Quality classifier: similarity-weighted votes of labelled neighbours in a latent semantic space.

A text is counted as hashed features: the shapes of its words (case, digits and
signs kept, letters alike), their last three shapes, word repeats, and how varied
its words are. Counts are damped, weighted by inverse document frequency and
projected on the leading singular directions of a bounded sample of labelled
texts. The sample's unit vectors are broadcast (at most REFERENCES x DIMENSIONS
floats); every document is compared exactly with all of them, block by block,
and its NEIGHBOURS nearest vote with their similarity as weight.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomlog.llm import _common as c

#: The bounded sample of labelled rows that the space and the votes are learned from, balanced between the labels as far as they go.
REFERENCES = 4000
FEATURES, DIMENSIONS, NEIGHBOURS, SHARPNESS = 2048, 48, 25, 4
#: Documents in a block of exact products.
BLOCK = 512
#: Letters to one upper and one lower shape, digits to one, bytes beyond ASCII to one.
SHAPES = bytes(65 if 65 <= i <= 90 else 97 if 97 <= i <= 122 else 48 if 48 <= i <= 57 else 98 if i >= 128 else i for i in range(256))

LETTERS = frozenset(b"Aab0")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their damped counts. Word lengths beyond 12 and repeats of a sign count alike."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    counts: Counter = Counter()
    for shape, n in Counter(raw.translate(SHAPES).split()).items():
        for key in (shape[:1] + shape[-1:], b"s" + shape[:12], b"e" + shape[-3:], *(b"c" + bytes([x]) for x in set(shape) - LETTERS)):
            counts[key] += n
    n = len(words)
    distinct = len(set(words))
    again = sum(map(eq, words, words[1:])) / n
    lines = raw.split(b"\n")
    extra = {b"#distinct%d" % int(8 * distinct / n): n, b"#again%d" % min(8, int(20 * again)): n, b"#length%d" % min(12, n.bit_length()): n / 4, b"#line%d" % min(8, (n // len(lines)).bit_length()): n / 4, b"#lines%d" % int(4 * len(set(lines)) / len(lines)): n / 4}
    names = [*counts, *extra]
    at = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names)) % np.uint64(FEATURES)
    values = np.sqrt(np.fromiter([*counts.values(), *extra.values()], float, len(names)) / n)
    got, inverse = np.unique(at.astype(np.int64), return_inverse=True)
    return got, np.bincount(inverse, weights=values)


class Space:
    """The latent space and the labelled vectors in it."""

    def __init__(self, texts: list[str | None], labels: list[int]):
        rows = np.zeros((len(texts), FEATURES), np.float32)
        for i, text in enumerate(texts):
            at, values = features(text)
            rows[i, at] = values
        self.labels = np.array(labels, np.float32)
        self.prior = float(self.labels.mean()) if labels else 0.5
        seen = (rows > 0).sum(0)
        self.idf = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32) + 0.1
        rows *= self.idf
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
        values, vectors = np.linalg.eigh((rows.T @ rows).astype(np.float64)) if len(rows) else (np.zeros(FEATURES), np.eye(FEATURES))
        self.axes = np.ascontiguousarray(vectors[:, ::-1][:, :DIMENSIONS], np.float32)  # right singular vectors, leading first
        self.vectors = self.unit(rows @ self.axes)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def place(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        for i, text in enumerate(texts):
            at, values = features(text)
            if len(at):
                row = values.astype(np.float32) * self.idf[at]
                out[i] = (row / max(float(np.linalg.norm(row)), 1e-9)) @ self.axes[at]
        return self.unit(out)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The weighted share of label 1 among the neighbours; the sample's share where no neighbour is similar."""
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        likeness = self.place(texts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-likeness, k - 1, axis=1)[:, :k]
        near.sort(axis=1)
        weight = np.maximum(np.take_along_axis(likeness, near, 1), 0).astype(float) ** SHARPNESS
        total = weight.sum(1)
        return np.where(total > 1e-9, (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-9), self.prior)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", references: int = REFERENCES) -> Space:
    """The space of a bounded sample: of each label the references / 2 rows that come first by hash of their id.

    Rows with a null id or label, and labels without a document, are not learned
    from. A label that repeats counts once, and of rows that share an id the
    least text. Only the sample's texts come to the driver, at most `references`:
    ids are chosen first, then met with their texts by a broadcast of as many ids.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("label = 0").orderBy(*order).limit(references // 2).unionAll(known.where("label = 1").orderBy(*order).limit(references // 2))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, r.text or ""))
    return Space([r.text for r in rows], [r.label for r in rows])


def score(docs: DataFrame, space: Space, id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1), and the column to keep, if one is given, as `row`.

    Empty, blank and null texts have no features and get the sample's share of
    label 1. Repeated rows and null ids stay as they are. No shuffle; labels and
    other columns are never read for a score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(space)
    names = [] if keep is None else ["row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                values = shared.value.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values), *(part.column(i) for i in range(2, part.num_columns))], ["doc_id", "score", *names])
        c.release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([] if keep is None else [keep.alias("row")]))
    return rows.mapInArrow(run, StructType([*StructType.fromDDL("doc_id long, score double").fields, *rows.schema.fields[2:]]))
