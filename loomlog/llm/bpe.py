"""BPE encoding and decoding.

Encoding keeps a priority queue of (merge rank, position) over a doubly linked
list of symbols; an entry is stale, and skipped, when either of its symbols has
been merged since. Decoding concatenates vocabulary strings.

Texts are cut into pieces at each change from a visible character to white
space. No token of the vocabulary's pattern spans such a place, so pieces are
encoded independently and a bounded cache holds the ids of frequent ones.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm import _common as c

#: The vocabulary file whose ids the query returns; its folder is the parameter.
VOCABULARY = "byte_bpe_50k.json"
#: Pieces kept in the cache of one Python worker; it is emptied when full.
CACHE_PIECES = 600_000
#: White space beyond ASCII, and controls that only some definitions call white space: such texts are cut by the whole pattern.
RARE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
PIECES = re.compile(r"\s*\S+|\s+")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(extra)) for b in range(256)]


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizers file."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            self.merges.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self.symbols = byte_symbols()
        self.byte_ids = [self.vocab[s] for s in self.symbols]
        back = {s: b for b, s in enumerate(self.symbols)}
        self.strings: list[bytes] = [b""] * (max(chain(self.vocab.values(), (x["id"] for x in spec["added_tokens"]))) + 1)
        for s, i in self.vocab.items():
            self.strings[i] = bytes(map(back.__getitem__, s)) if all(c in back for c in s) else s.encode()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for s, i in self.special.items():
            self.strings[i] = s.encode()
        longest = sorted(self.special, key=len, reverse=True)
        self.special_re = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.cache: dict[str, list[int]] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Applies the merges to one pre-token, lowest rank first, leftmost first among equals."""
        n = len(symbols)
        if n < 2:
            return symbols
        merges = self.merges
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        queue = [(m[0], i, symbols[i], symbols[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, made = heapq.heappop(queue)
            j = after[i] if alive[i] else -1
            if j < 0 or symbols[i] != left or symbols[j] != right:
                continue  # stale
            symbols[i], alive[j] = made, False
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((made, symbols[k])):
                    heapq.heappush(queue, (m[0], i, made, symbols[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((symbols[h], made))):
                heapq.heappush(queue, (m[0], h, symbols[h], made, m[1]))
        return [s for s, live in zip(symbols, alive, strict=True) if live]

    def token(self, text: str) -> list[int]:
        """The ids of one pre-token, from the cache if it holds them."""
        ids = self.cache.get(text)
        if ids is None:
            ids = self.merge(list(map(self.byte_ids.__getitem__, text.encode("utf-8", "surrogatepass"))))
            self.keep(text, ids)
        return ids

    def keep(self, text: str, ids: list[int]) -> None:
        if len(text) <= 64:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            self.cache[text] = ids

    def piece(self, text: str) -> list[int]:
        tokens = self.pattern.findall(text)
        return self.token(tokens[0]) if len(tokens) == 1 else list(chain.from_iterable(map(self.token, tokens)))

    def plain(self, text: str) -> list[list[int]]:
        """The ids of a text without special tokens, piece by piece."""
        pieces = [text] if RARE_SPACE.search(text) else PIECES.findall(text)
        cache = self.cache
        try:
            return [cache[p] for p in pieces]
        except KeyError:
            pass
        out = []
        for p in pieces:
            ids = cache.get(p)
            if ids is None:
                ids = self.piece(p)
                self.keep(p, ids)
            out.append(ids)
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.special_re is None or not self.special_re.search(text):
            return list(chain.from_iterable(self.plain(text)))
        out: list[int] = []
        for part in self.special_re.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out.extend(chain.from_iterable(self.plain(part)))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """The vocabulary, read once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep_cache: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids and the decoded text.

    A null or empty text has no ids and decodes to the empty text. A null id
    stays null, repeated rows stay repeated, further columns are not read. No
    shuffle: each text is encoded where it is scanned. With keep_cache a Python
    worker keeps its cache of pieces for later tasks, which take less time then;
    without, its memory is free for other stages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(vocabulary)
        numbers = list(map(str, range(len(coder.strings))))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                counts, id_sums, text_sums, all_ids, texts = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    ids = coder.encode(text)
                    decoded = coder.decode(ids)
                    counts.append(len(ids))
                    id_sums.append(hashlib.sha256(",".join(map(numbers.__getitem__, ids)).encode()).hexdigest())
                    text_sums.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                    if keep_ids:
                        all_ids.append(ids)
                        texts.append(decoded)
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(id_sums), pa.array(text_sums)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)
        if not keep_cache:
            coder.cache = {}
        c.release()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
