"""N-gram Jaccard join by multiple-global-order filtering.

Documents are sets of hashed word shingles. Documents of equal sets form a
class, and only classes are compared. Under a global order of the shingles, two
sets of similarity t or more share a shingle among the first
|x| - ceil(t |x|) + 1 of each. The first order puts rare shingles first, by a
count sketch of all documents (fixed size; it only orders, so its collisions
cost work and never a link), and the place of the first common shingle bounds
what can be common. Pairs that pass must also share a prefix shingle under
each of the hash orders: prefixes meet first, and only the texts of pairs that
pass every order move and are compared exactly.

Groups of copies never become all their pairs. In the sorted lists of a
shingle, neighbours are compared first, and every class with the list's most
central one, and joined to components; a class speaks up in LISTS of its lists,
those that a hash order puts first, which copies agree on. Then only pairs whose
classes lie in different components come out of all the lists. Every pair of
similarity t or more is thus compared or already connected, so components
are exact, and the links returned suffice to make them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.llm import _common as c
from loomlog.llm.components import components
from loomlog.llm.sketch import SKETCH_BITS, Tally, cells, levels

WORDS, PERCENT = 5, 80
#: Seeds of the hash orders that follow the first.
ORDERS = (0x51ED270B, 0x2545F491)
#: Lists of a class in which the first round looks for neighbours, how many of these it compares, and lists they must share (a fifth of a short prefix does).
#: The second round covers all lists and every pair that is not connected yet, so these bound the first round's rows and never a result.
LISTS, NEIGHBOURS, SHARED = 12, 3, 3
#: Classes in candidate pairs, at most, that are broadcast (two longs each) to pick their texts where they are scanned.
BROADCAST_CLASSES = 500_000
#: Parts that the rows of one class are spread over when they meet its component.
SALT = 8


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending; a text of fewer words is one shingle."""
    found = c.lower_words_of(text)
    if not found:
        return np.zeros(0, np.uint64)
    hashes = c.hash_words(found)
    if len(found) < words:
        return c.mix(c.rolling(hashes, len(found)) ^ np.uint64(len(found)))
    return np.unique(c.rolling(hashes, words))


def least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return -(-n * percent // 100)


def order_prefix(tokens: np.ndarray, seed: int, percent: int) -> np.ndarray:
    """The prefix of a set under the hash order of a seed."""
    k = len(tokens) - least_overlap(len(tokens), percent) + 1
    keys = c.mix(tokens ^ np.uint64(seed))
    return np.partition(keys, k - 1)[:k] if k < len(keys) else keys


def similar(x: np.ndarray, y: np.ndarray, px: list, py: list, percent: int) -> bool:
    """px, py: the prefixes under the hash orders, each of which must share a shingle first."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    if not all(np.isin(a, b).any() for a, b in zip(px, py, strict=True)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def fingerprint(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens))).astype(np.int64))


def _profile(words: int):
    """Kind 0: doc_id, size and class of each row. Kind 1: this task's part of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "n", "cls", "part", "blob"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        tally = Tally()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = shingles(text.as_py(), words)
                rows.append((0, doc_id, len(tokens), fingerprint(tokens) if len(tokens) else None, None, None))
                tally.add(tokens)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for part, blob in tally.parts():
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((1, None, None, None, part, blob), kinds, strict=True)], names)
        del tally
        c.release()

    return run


def rare_prefix(tokens: np.ndarray, level_of: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens in the order of (sketched count, hash), as many as one common token needs."""
    n = len(tokens)
    need = least_overlap(n, percent)
    k = n - need + 1
    level = level_of[cells(tokens)]
    return tokens[np.lexsort((c.mix(tokens), level))[:k]]


def _postings(shared, words: int, percent: int):
    """(token, n, cls, pos) of the prefix of each class that occurs in this task, once; pos is the token's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of = np.frombuffer(shared.value, np.uint8)
        seen: set[int] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                found, sizes, classes, lengths = [], [], [], []
                for text in batch.column(0).slice(start, 512).to_pylist():
                    tokens = shingles(text, words)
                    if len(tokens) and (cls := fingerprint(tokens)) not in seen:
                        seen.add(cls)
                        found.append(prefix := rare_prefix(tokens, level_of, percent))
                        sizes.append(len(tokens))
                        classes.append(cls)
                        lengths.append(len(prefix))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int64)), pa.array(np.repeat(np.array(sizes, np.int32), lengths)), pa.array(np.repeat(np.array(classes, np.int64), lengths)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in lengths]))], ["token", "n", "cls", "pos"])

    return run


def whole_lists(columns: int):
    """Batches of rows sorted by their first column, cut so that no list of equal first values is split."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        kept: list[list[np.ndarray]] = []  # parts of the last list, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy().astype(np.int64) for i in range(columns)]
            goes_on = bool(kept) and kept[0][0][0] == rows[0][0]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if goes_on and not last:
                kept.append(rows)
                continue
            done = [*kept, [x[:last] for x in rows]] if last else kept
            if done:
                yield [np.concatenate(x) for x in zip(*done, strict=True)]
            kept = [[x[last:] for x in rows]]
        if kept:
            yield [np.concatenate(x) for x in zip(*kept, strict=True)]

    return cut


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (token, n, cls) those of tokens with two classes or more, each class once."""
    for token, n, cls, pos in whole_lists(4)(batches):
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        token, n, cls, pos = token[fresh], n[fresh], cls[fresh], pos[fresh]
        same = token[1:] == token[:-1]
        many = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (token, n, cls, pos)], ["token", "n", "cls", "pos"])


def _neighbours(percent: int):
    """Over lists sorted by (token, n, cls), with how central each class is: pairs of neighbours, and of each class with the list's most central one; and the lists they share so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, n, cls, central in whole_lists(4)(batches):
            start = np.concatenate([[True], token[1:] != token[:-1]])
            here = np.flatnonzero(~start)
            heads = np.flatnonzero(start)
            top = np.repeat(np.maximum.reduceat(central, heads), np.diff(np.append(heads, len(token))))
            at = np.where(central == top, np.arange(len(token)), len(token))
            hub = np.repeat(np.minimum.reduceat(at, heads), np.diff(np.append(heads, len(token))))
            pairs = []
            for one, other in ((here, here - 1), (np.arange(len(token)), hub)):
                a, b = np.minimum(n[one], n[other]), np.maximum(n[one], n[other])
                near = (one != other) & (100 * a >= percent * b)
                pairs.append(np.stack([cls[other[near]], cls[one[near]], n[one[near]]], 1))
            pairs, counts = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(counts), pa.array(pairs[:, 2])], ["a", "b", "lists", "n"])

    return run


def _marked(words: int, percent: int):
    """Rows (cls, doc, text) whose text is of the class, with its prefixes under the hash orders, as 32-bit integers; other rows of the same id go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cls", "doc", "text", *(f"order{i}" for i in range(len(ORDERS)))]
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                own, marks = np.zeros(part.num_rows, bool), [[] for _ in ORDERS]
                for i, (cls, text) in enumerate(zip(part.column(0).to_pylist(), part.column(2), strict=True)):
                    tokens = shingles(text.as_py(), words)
                    if len(tokens) and fingerprint(tokens) == cls:
                        own[i] = True
                        for mark, seed in zip(marks, ORDERS, strict=True):
                            mark.append((order_prefix(tokens, seed, percent) >> np.uint64(32)).astype(np.uint32).view(np.int32))
                columns = [x.filter(pa.array(own)) for x in part.columns]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(mark, pa.list_(pa.int32())) for mark in marks)], names)

    return run


def _verify(words: int, percent: int):
    """Keeps the pairs that pass the hash orders and the exact comparison."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}

        def prepared(cls: int, text: str | None) -> tuple:
            if cls not in held:
                if len(held) > 64:
                    held.clear()
                tokens = shingles(text, words)
                own = len(tokens) and fingerprint(tokens) == cls  # else another row of the same id
                held[cls] = (tokens, [order_prefix(tokens, s, percent) for s in ORDERS]) if own else (tokens[:0], [])
            return held[cls] if len(held[cls][0]) else held.pop(cls)

        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, px = prepared(batch.column(0)[i].as_py(), batch.column(4)[i].as_py())
                y, py = prepared(batch.column(1)[i].as_py(), batch.column(5)[i].as_py())
                good[i] = len(x) and len(y) and similar(x, y, px, py, percent)
            yield pa.RecordBatch.from_arrays([batch.column(2).filter(pa.array(good)), batch.column(3).filter(pa.array(good))], ["a", "b"])

    return run


class JaccardJoin:
    """The join over one table; profile, links and components are stored in the scratch folder as they are made."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT):
        self.spark: SparkSession = docs.sparkSession
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.words, self.percent, self.folder = words, percent, c.scratch(self.spark, "jaccard")

    def profile(self) -> DataFrame:
        """doc_id, n and cls of every row; keeps the sketch and the classes."""
        found = c.stored(self.docs.mapInArrow(_profile(self.words), "kind int, doc_id long, n long, cls long, part int, blob binary"), f"{self.folder}/profile", "kind")
        self.levels = self.spark.sparkContext.broadcast(levels(found.where("kind = 1").select("part", "blob")))
        rows = found.where("kind = 0").select("doc_id", "n", "cls")
        self.classes = c.stored(rows.where("cls IS NOT NULL AND doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies")), f"{self.folder}/classes")
        return rows

    def check(self, pairs: DataFrame, name: str) -> DataFrame:
        """The links among candidate pairs of classes, as pairs of the classes' least documents."""
        pairs = c.stored(pairs, f"{self.folder}/{name}-pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(self.classes.select("cls", F.col("doc").alias("doc_id")), "cls")
        wanted = c.stored(wanted, f"{self.folder}/{name}-wanted")
        if wanted.count() <= BROADCAST_CLASSES:  # else texts are shuffled to meet their ids
            wanted = F.broadcast(wanted)
        texts = self.docs.join(wanted, "doc_id").select("cls", F.col("doc_id").alias("doc"), "text")
        orders = [f"order{i}" for i in range(len(ORDERS))]
        texts = texts.mapInArrow(_marked(self.words, self.percent), "cls long, doc long, text string, " + ", ".join(f"{x} array<int>" for x in orders))
        texts = c.stored(texts.dropDuplicates(["cls"]), f"{self.folder}/{name}-texts")
        marks = [texts.select(F.col("cls").alias(side), *(F.col(x).alias(f"{x}_{side}") for x in orders)) for side in "ab"]
        passed = pairs.join(marks[0], "a").join(marks[1], "b")
        for x in orders:
            passed = passed.where(F.arrays_overlap(f"{x}_a", f"{x}_b"))
        pairs = c.stored(passed.select("a", "b"), f"{self.folder}/{name}-passed")
        left = texts.select(F.col("cls").alias("a"), F.col("doc").alias("doc_a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("cls").alias("b"), F.col("doc").alias("doc_b"), F.col("text").alias("text_b"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "doc_a", "doc_b", "text_a", "text_b")
        return c.stored(both.mapInArrow(_verify(self.words, self.percent), "a long, b long"), f"{self.folder}/{name}-links")

    def links(self) -> DataFrame:
        """Links that connect every component: (a, b), least documents of their classes."""
        postings = self.docs.where("doc_id IS NOT NULL").select("text").mapInArrow(_postings(self.levels, self.words, self.percent), "token long, n int, cls long, pos int")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        lists = postings.repartition(n, "token").sortWithinPartitions("token", "n", "cls").mapInArrow(_lists, "token long, n long, cls long, pos long")
        # a class most of whose prefix others share is the middle of its group: copies of it differ from each other more than from it
        length = F.col("n") - F.ceil(F.col("n") * self.percent / 100) + 1
        own = Window.partitionBy("cls")
        ranked = lists.withColumn("central", (1_000_000 * F.count(F.lit(1)).over(own) / length).cast("long")).withColumn("turn", F.row_number().over(own.orderBy(F.xxhash64("token"), "token")))
        ranked = c.stored(ranked, f"{self.folder}/lists")
        near = ranked.where(F.col("turn") <= LISTS).select("token", "n", "cls", "central").repartition(n, "token").sortWithinPartitions("token", "n", "cls").mapInArrow(_neighbours(self.percent), "a long, b long, lists long, n long")
        near = near.groupBy("a", "b").agg(F.sum("lists").alias("lists"), F.first("n").alias("n"))
        near = near.where((F.col("lists") >= SHARED) | (5 * F.col("lists") >= F.col("n") / 5)).withColumn("place", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("lists"), "a"))).where(F.col("place") <= NEIGHBOURS)
        near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        first = self.check(near.select("a", "b"), "near")
        labels = components(first)
        label_of = self.classes.select("cls", F.col("doc").alias("node")).join(labels, "node").join(self.classes.select(F.col("doc").alias("component"), F.col("cls").alias("label")), "component").select("cls", "label")
        rows = ranked.drop("central", "turn").join(label_of, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        rows = c.stored(rows, f"{self.folder}/labelled")
        mixed = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("token")
        rows = rows.join(mixed, "token")
        both = F.ceil((F.col("n_a") + F.col("n_b")) * self.percent / (100 + self.percent))
        left, right = (rows.select("token", *(F.col(x).alias(f"{x}_{side}") for x in ("cls", "n", "label", "pos"))) for side in "ab")
        smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("cls_a") < F.col("cls_b")))
        # if this is the first common shingle, no more than the shorter rest can be common
        most = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
        crossing = left.join(right, "token").where((F.col("label_a") != F.col("label_b")) & smaller & (100 * F.col("n_a") >= self.percent * F.col("n_b")) & (most >= both))
        crossing = crossing.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct()
        return first.unionAll(self.check(crossing.select("a", "b"), "crossing"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    A null or blank text has no shingles and links with nothing. A row with a
    null id has its size and a null component, and links with nothing. Rows
    that share an id are one document: the texts of one id are linked. Further
    columns are not read.
    """
    task = JaccardJoin(docs, id_col, text_col, words, percent)
    rows = task.profile()
    known = rows.where("cls IS NOT NULL AND doc_id IS NOT NULL")
    several = known.groupBy("doc_id").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low != high")
    ends = task.classes.select("cls", "doc")
    one = known.join(several, "doc_id").join(ends.withColumnRenamed("doc", "a"), "cls").join(ends.select(F.col("cls").alias("low"), F.col("doc").alias("b")), "low")
    found = components(task.links().unionByName(one.select("a", "b")))
    merged = task.classes.join(found, F.col("doc") == F.col("node"), "left").where("copies > 1 OR component IS NOT NULL")
    merged = merged.select("cls", F.coalesce("component", "doc").alias("component"), F.explode(F.array(*map(F.lit, range(SALT)))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    out = salted.join(merged, ["cls", "salt"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


__all__ = ["ORDERS", "SKETCH_BITS", "JaccardJoin", "join", "order_prefix", "rare_prefix", "shingles", "similar"]
