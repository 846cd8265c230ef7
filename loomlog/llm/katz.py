"""LM scoring by a Katz backoff model of words, order 2.

Counts are discounted by Good-Turing up to CUTOFF; the mass that this frees
goes to the lower order, by backoff weights that normalise exactly:

    p(w | h) = d(c(h w)) c(h w) / D(h)                     if h w was seen
             = (1 - seen(h)) / (1 - sum p(w'), h w' seen) p(w)  if h was seen
             = p(w)                                          else
    p(w)     = d(c(w)) c(w) / N, and the rest of the mass for any word not seen

D(h) is c(h), or c(h) + 1 where discounting frees no mass. The vocabulary is
the V training tokens and one unknown token, as in the base score.

Texts never move. Each task keeps the tokens of its documents as chunks in the
shared scratch folder, and sends only the distinct words, then the distinct
pairs of a chunk, as packed sorted hashes to buckets of the hash space. Buckets
add up the training counts and answer each chunk in the order of its request.
A frequent word is one entry of each chunk, so no bucket is hot; pairs of a
frequent first word are spread over parts in proportion to its count. A first
word that only one chunk has needs no bucket.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm import _common as c

CUTOFF = 5
#: Tokens of a chunk, chunks' worth of distinct words in a bucket, and parts of all training tokens above which a first word is spread.
CHUNK_TOKENS, DOCS_PER_BUCKET, HOT_PARTS = 2_200_000, 2_000, 2_000
END, START = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" end", b" start"))


#: Arrays that are ascending wherever they are packed; their differences are kept.
ASCENDING = ("words", "h")


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob: byte by byte of all items, so that the high bytes of small numbers compress away."""
    head, parts = [], []
    for name, x in arrays.items():
        x = np.diff(x, prepend=x.dtype.type(0)) if name in ASCENDING else x
        head.append((name, x.dtype.str, x.shape))
        parts.append(np.ascontiguousarray(x.reshape(-1)).view(np.uint8).reshape(x.size, x.itemsize).T.tobytes() if x.size else b"")
    told = json.dumps(head).encode()
    return zstandard.ZstdCompressor(level=3).compress(len(told).to_bytes(4, "little") + told + b"".join(parts))


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = {}
    for name, kind, shape in json.loads(raw[4:at]):
        kind, n = np.dtype(kind), int(np.prod(shape))
        x = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T
        at += n * kind.itemsize
        x = np.ascontiguousarray(x).view(kind).reshape(shape)
        out[name] = np.cumsum(x, dtype=kind) if name in ASCENDING else x
    return out


def load(folder: str, name: str) -> dict[str, np.ndarray]:
    files, path = c.filesystem(folder)
    with files.open_input_stream(f"{path}/{name}", compression=None) as f:
        return unpack(f.read())


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def histogram(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, ... CUTOFF + 1."""
    return np.bincount(counts[(counts > 0) & (counts <= CUTOFF + 1)], minlength=CUTOFF + 2)[1:].astype(np.int64)


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0), d(1), ... d(CUTOFF) from the counts of counts; (r - 1/2) / r where Good-Turing gives none between 0 and 1."""
    d = np.ones(CUTOFF + 1)
    common = (CUTOFF + 1) * n[CUTOFF] / n[0] if n[0] else 1.0
    for r in range(1, CUTOFF + 1):
        got = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) if n[r - 1] and common < 1 else 0.0
        d[r] = got if 0 < got < 1 else (r - 0.5) / r
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * d[np.where(counts <= CUTOFF, counts, 0)]


class Unigrams:
    """p(w) by count, and the probability of the unknown token."""

    def __init__(self, total: int, types: int, n: np.ndarray, docs: int):
        self.total, self.types, self.docs, self.d = total, types, docs, discounts(n)
        low = np.arange(1, CUTOFF + 1)
        freed = float(((1 - self.d[low]) * low * n[:CUTOFF]).sum())
        self.norm = total if freed > 0 else total + 1
        self.unknown = (freed or 1.0) / self.norm

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.d) / self.norm, self.unknown)


def _chunks(folder: str, buckets: int):
    """Stores chunks and sends (chunk, bucket, distinct words and their training counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0

        def out(docs: list) -> Iterator[pa.RecordBatch]:
            nonlocal number
            name = f"{part:06d}-{number:05d}"
            number += 1
            lengths = np.array([len(h) for *_, h in docs])
            held = np.array([h for _, h, _ in docs])
            words, tokens = np.unique(np.concatenate([h for *_, h in docs]), return_inverse=True)
            train = np.repeat(~held, lengths)
            counts = np.bincount(tokens[train], minlength=len(words))
            ids = np.array([0 if i is None else i for i, *_ in docs], np.int64)
            known = np.array([i is not None for i, *_ in docs])
            c.write_file(folder, name, iter([pack(ids=ids, known=known, held=held, lengths=lengths.astype(np.uint32), words=words, tokens=tokens.astype(np.uint32), counts=counts.astype(np.uint32))]))
            docs.clear()
            del tokens, train, lengths, held, ids, known
            yield from requests(name, bucket_of(words, buckets), lambda a, b: pack(words=words[a:b], counts=counts[a:b].astype(np.uint32)))
            c.release()

        docs, size = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                for doc_id, held, text in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
                    docs.append((doc_id, held, np.append(c.hash_words(c.lower_words_of(text)), END)))
                    size += len(docs[-1][2])
                    if size >= CHUNK_TOKENS:
                        yield from out(docs)
                        docs, size = [], 0
        if docs:
            yield from out(docs)

    return run


REQUEST = "chunk string, bucket int, blob binary"


def requests(chunk: str, bucket: np.ndarray, blob) -> Iterator[pa.RecordBatch]:
    """A row for each bucket that the ascending array names; an empty request where it names none."""
    if not len(bucket):
        yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([0], pa.int32()), pa.array([blob(0, 0)], pa.binary())], ["chunk", "bucket", "blob"])
        return
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(starts[1:], len(bucket))
    for low in range(0, len(starts), 32):
        rows = [(chunk, int(bucket[a]), blob(a, b)) for a, b in zip(starts[low : low + 32], ends[low : low + 32], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), [pa.string(), pa.int32(), pa.binary()], strict=True)], ["chunk", "bucket", "blob"])


ANSWER = "chunk string, bucket int, blob binary, stats array<long>"
KINDS = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("blob", pa.binary()), ("stats", pa.list_(pa.int64()))])


def released(run):
    """The function, with what it freed given back after each group."""

    def group(key: tuple, table: pa.Table) -> pa.Table:
        try:
            return run(key, table)
        finally:
            c.release()

    return group


def _count(key: tuple, table: pa.Table) -> pa.Table:
    """One bucket of words: each chunk's answer (training count, and whether no other chunk has the word), and the bucket's sums in the row without a chunk."""
    asked = [unpack(x.as_py()) for x in table.column("blob")]
    words, inverse = np.unique(np.concatenate([x["words"] for x in asked]), return_inverse=True)
    totals = np.bincount(inverse, weights=np.concatenate([x["counts"] for x in asked]), minlength=len(words)).astype(np.int64)
    alone = np.bincount(inverse, minlength=len(words)) == 1
    rows, at = [], 0
    for chunk, x in zip(table.column("chunk").to_pylist(), asked, strict=True):
        mine = inverse[at : at + len(x["words"])]
        rows.append((chunk, key[0].as_py(), pack(totals=totals[mine].astype(np.uint64), alone=alone[mine]), None))
        at += len(mine)
    rows.append((None, key[0].as_py(), None, [int(totals.sum()), int((totals > 0).sum()), *histogram(totals).tolist()]))
    return pa.Table.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows, strict=True), KINDS, strict=True)], schema=KINDS)


class Pairs:
    """The distinct (first word, word) pairs of a chunk. First word len(words) is the start of a text."""

    def __init__(self, chunk: dict[str, np.ndarray], totals: np.ndarray, alone: np.ndarray, model: Unigrams):
        self.lengths, self.tokens = chunk["lengths"].astype(np.int64), chunk["tokens"].astype(np.int64)
        size = len(chunk["words"]) + 1
        first = np.empty(len(self.tokens), np.int64)
        first[1:] = self.tokens[:-1]
        first[np.cumsum(self.lengths) - self.lengths] = size - 1
        first *= size
        first += self.tokens
        pairs, inverse = np.unique(first, return_inverse=True)
        self.inverse = inverse.astype(np.int32)
        self.h, self.w = (pairs // size).astype(np.int32), (pairs % size).astype(np.int32)
        del first, pairs, inverse
        train = np.repeat(~chunk["held"], self.lengths)
        self.counts = np.bincount(self.inverse[train], minlength=len(self.h))
        self.hashes = np.append(chunk["words"], START)
        self.totals = np.append(totals.astype(np.int64), model.docs)
        self.hot = self.totals > max(1, model.total // HOT_PARTS)
        self.own = np.append(alone, False) & ~self.hot  # nobody else knows or needs the pairs of this first word
        wanted = ~self.own[self.h] & (self.totals[self.h] > 0)
        self.asked = wanted & (self.totals[self.w] > 0)
        unheard = np.bincount(self.h[self.asked], minlength=size) == 0
        head = np.concatenate([[True], self.h[1:] != self.h[:-1]])
        self.asked |= wanted & unheard[self.h] & head  # a pair at least, for the sums of its first word

    def sent(self, model: Unigrams, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs asked for in the order they are sent, and the bucket of each."""
        at = np.flatnonzero(self.asked)
        parts = 1 + self.totals[self.h[at]] // max(1, model.total // HOT_PARTS)
        parts = np.where(self.hot[self.h[at]], parts, 1).astype(np.uint64)
        with np.errstate(over="ignore"):
            sub = c.mix(self.hashes[self.w[at]]) % parts
            bucket = bucket_of(c.mix(self.hashes[self.h[at]] + sub * c.MULT), buckets)
        order = np.lexsort((self.hashes[self.w[at]], self.hashes[self.h[at]], bucket))
        return at[order], bucket[order]


def sums_by(h: np.ndarray, counts: np.ndarray, p: np.ndarray, size: int) -> np.ndarray:
    """For each first word: pairs seen 1, ... CUTOFF times, the counts above, and the sum of p(w) of pairs seen."""
    out = np.zeros((size, CUTOFF + 2))
    for r in range(1, CUTOFF + 1):
        out[:, r - 1] = np.bincount(h[counts == r], minlength=size)
    big = counts > CUTOFF
    out[:, CUTOFF] = np.bincount(h[big], weights=counts[big], minlength=size)
    seen = counts > 0
    out[:, CUTOFF + 1] = np.bincount(h[seen], weights=p[seen], minlength=size)
    return out


def _ask_pairs(folder: str, buckets: int, model: Unigrams):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        name = key[0].as_py()
        answers = sorted(zip(table.column("bucket").to_pylist(), table.column("blob").to_pylist(), strict=True))
        answers = [unpack(x) for _, x in answers]
        totals, alone = (np.concatenate([x[k] for x in answers]) for k in ("totals", "alone"))
        c.write_file(folder, f"{name}.counts", iter([pack(totals=totals, alone=alone)]))
        pairs = Pairs(load(folder, name), totals, alone, model)
        at, bucket = pairs.sent(model, buckets)

        def blob(a: int, b: int) -> bytes:
            part = at[a:b]
            h = pairs.h[part]
            head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            w = (pairs.hashes[pairs.w[part]] >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            return pack(h=pairs.hashes[h[head]], hot=pairs.hot[h[head]], runs=np.diff(np.append(head, len(h))).astype(np.uint32), w=w, counts=pairs.counts[part].astype(np.uint32), totals=np.where(pairs.counts[part] > 0, pairs.totals[pairs.w[part]], 0).astype(np.uint64))

        own = histogram(pairs.counts[pairs.own[pairs.h]])
        rows = [x.to_pylist() for x in requests(name, bucket, blob)]
        rows = [(r["chunk"], r["bucket"], r["blob"], own.tolist() if i == 0 else None) for i, r in enumerate(x for part in rows for x in part)]
        return pa.Table.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows, strict=True), KINDS, strict=True)], schema=KINDS)

    return run


def _count_pairs(model: Unigrams):
    """One bucket of pairs: answers, the bucket's counts of counts with those that chunks have told, and the sums of spread first words."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        asked = [unpack(x.as_py()) for x in table.column("blob")]
        h = np.concatenate([np.repeat(x["h"], x["runs"]) for x in asked])
        raw = np.zeros((len(h), 8), np.uint8)
        raw[:, :6] = np.concatenate([x["w"] for x in asked])
        w = raw.view("<u8").ravel()
        order = np.lexsort((w, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])
        pair = np.empty(len(h), np.int64)
        pair[order] = np.cumsum(new) - 1
        counts = np.bincount(pair, weights=np.concatenate([x["counts"] for x in asked]), minlength=int(new.sum())).astype(np.int64)
        totals = np.concatenate([x["totals"] for x in asked]).astype(np.int64)[order]  # of the second word; told by chunks that train on the pair
        totals = np.maximum.reduceat(totals, np.flatnonzero(new)) if len(h) else totals
        firsts, of_pair = np.unique(h[order][new], return_inverse=True)
        sums = sums_by(of_pair, counts, model.p(totals), len(firsts))
        rows, at, hot = [], 0, np.zeros(len(firsts), bool)
        for chunk, x in zip(table.column("chunk").to_pylist(), asked, strict=True):
            n = int(x["runs"].sum())
            mine = np.searchsorted(firsts, x["h"])
            hot[mine[x["hot"]]] = True
            got = sums[mine]
            blob = pack(counts=counts[pair[at : at + n]].astype(np.uint64), low=np.ascontiguousarray(got[:, : CUTOFF + 1].T).astype(np.uint64), p=got[:, -1])
            rows.append((chunk, key[0].as_py(), blob, None))
            at += n
        own = [s for s in table.column("stats").to_pylist() if s]
        rows.append((None, key[0].as_py(), pack(h=firsts[hot], sums=sums[hot]) if hot.any() else None, (histogram(counts) + np.sum(own, 0, dtype=np.int64) if own else histogram(counts)).tolist()))
        return pa.Table.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows, strict=True), KINDS, strict=True)], schema=KINDS)

    return run


SCORES = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def _score(folder: str, buckets: int, model: Unigrams, d: np.ndarray, shared):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        name = key[0].as_py()
        chunk, counted = load(folder, name), load(folder, f"{name}.counts")
        pairs = Pairs(chunk, counted["totals"], counted["alone"], model)
        at, bucket = pairs.sent(model, buckets)
        answers = [unpack(x) for _, x in sorted(zip(table.column("bucket").to_pylist(), table.column("blob").to_pylist(), strict=True))]
        p = model.p(pairs.totals)
        counts = np.where(pairs.own[pairs.h], pairs.counts, 0)
        own = pairs.own[pairs.h]
        sums = sums_by(pairs.h[own], counts[own], p[pairs.w[own]], len(pairs.hashes))
        if len(at):
            counts[at] = np.concatenate([x["counts"] for x in answers]).astype(np.int64)
            head = np.concatenate([[True], (pairs.h[at][1:] != pairs.h[at][:-1]) | (bucket[1:] != bucket[:-1])])
            firsts = pairs.h[at][head]
            got = np.column_stack([np.concatenate([x["low"] for x in answers], 1).T.astype(float), np.concatenate([x["p"] for x in answers])])
            whole = ~pairs.hot[firsts]
            sums[firsts[whole]] = got[whole]
        hot_h, hot_sums = shared.value
        if len(hot_h):
            place = np.minimum(np.searchsorted(hot_h, pairs.hashes), len(hot_h) - 1)
            mine = pairs.hot & (hot_h[place] == pairs.hashes)
            sums[mine] = hot_sums[place[mine]]
        seen = sums[:, : CUTOFF] @ (d[1:] * np.arange(1, CUTOFF + 1)) + sums[:, CUTOFF]
        all_counts = sums[:, : CUTOFF] @ np.arange(1, CUTOFF + 1) + sums[:, CUTOFF]
        norm = np.where(all_counts - seen > 1e-9 * np.maximum(1, all_counts), all_counts, all_counts + 1)
        rest = np.where(all_counts > 0, (norm - seen) / norm / np.maximum(1 - sums[:, -1], 1e-300), 1.0)
        lower = p[pairs.w]
        value = np.where(counts > 0, discounted(counts, d) / norm[pairs.h], rest[pairs.h] * lower)
        logs = np.log10(value)[pairs.inverse]
        doc = np.repeat(np.arange(len(pairs.lengths)), pairs.lengths)
        n = len(pairs.lengths)
        of_token = pairs.totals[pairs.tokens]
        base = np.log10((of_token + 0.5) / (model.total + 0.5 * (model.types + 1)))
        columns = [pa.array(chunk["ids"], mask=~chunk["known"]), pa.array(chunk["held"]), pa.array(pairs.lengths), pa.array(np.bincount(doc, weights=of_token > 0, minlength=n).astype(np.int64)), pa.array(np.full(n, model.total, np.int64)), pa.array(np.bincount(doc, weights=base, minlength=n)), pa.array(np.bincount(doc, weights=logs, minlength=n))]
        return pa.Table.from_arrays(columns, names=[k for k, _ in SCORES])

    return run


def added_up(rows: DataFrame, places: int) -> np.ndarray:
    """The sums of the rows' stats, place by place; one row comes to the driver."""
    sums = rows.agg(*(F.sum(F.col("stats")[i]) for i in range(places))).first()
    return np.array([x or 0 for x in sums], np.int64)


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    held_out: a boolean column over docs; rows where it is true (not null) are
    scored and not learned from. A null or blank text is its end token alone.
    Repeated rows are learned from and scored as they stand, null ids stay
    null. Without training rows every token is the unknown one, of probability
    1 in the model. Further columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("held")).alias("train")).first()
    buckets = max(16, size.n // DOCS_PER_BUCKET)
    folder = c.scratch(spark, "katz")
    words = c.stored(rows.mapInArrow(_chunks(f"{folder}/chunks", buckets), REQUEST).groupBy("bucket").applyInArrow(released(_count), ANSWER), f"{folder}/words")
    stats = added_up(words.where("chunk IS NULL"), CUTOFF + 3)
    model = Unigrams(int(stats[0]), int(stats[1]), stats[2:], int(size.train))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # told, so that small answers to large chunks are not coalesced into few tasks
    known = words.where("chunk IS NOT NULL").repartition(tasks, "chunk").groupBy("chunk")
    pairs = c.stored(known.applyInArrow(released(_ask_pairs(f"{folder}/chunks", buckets, model)), ANSWER).groupBy("bucket").applyInArrow(released(_count_pairs(model)), ANSWER), f"{folder}/pairs")
    c.drop_path(spark, f"{folder}/words")
    told = pairs.where("chunk IS NULL")
    d = discounts(added_up(told, CUTOFF + 1))
    hot = [unpack(bytes(r.blob)) for r in told.where("blob IS NOT NULL").select("blob").collect()]  # at most 2 HOT_PARTS first words in all
    hashes, inverse = np.unique(np.concatenate([x["h"] for x in hot]) if hot else np.zeros(0, np.uint64), return_inverse=True)
    sums = np.zeros((len(hashes), CUTOFF + 2))
    if hot:
        np.add.at(sums, inverse, np.concatenate([x["sums"] for x in hot]))
    shared = spark.sparkContext.broadcast((hashes, sums))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return pairs.where("chunk IS NOT NULL").repartition(tasks, "chunk").groupBy("chunk").applyInArrow(released(_score(f"{folder}/chunks", buckets, model, d, shared)), schema)
