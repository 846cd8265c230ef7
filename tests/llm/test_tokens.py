import hashlib
import random
import struct
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomlog.llm import _common as c
from loomlog.llm import bpe, token_files

BYTE, WORD = (public_tokenizers.path(x) for x in (bpe.VOCABULARY, token_files.VOCABULARY))


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


HARD = ["", " ", "  a", "a   b", "a\n\n b", "\n\n x", "x  \n", "a\u00a0 b", "a \u00a0b", "\u2003x", "a\x1c!\x1cb", "it's we'll I'M 'S", "<|endoftext|>x <|endoftext|> y", "<|ENDOFTEXT|>", "日本語 テスト", "👍🏽 ok", "aaaa" * 300, "\x00\x01 x", "123 4a!!", "1.5,é.É, ç; É", "#$%^ &*( )", "İstanbul ΑΣ. ß. Å", "e\u0301 a\u0301.", "x" * 5000]


def test_bpe_equals_the_library(byte):
    coder, chance = bpe.Bpe(BYTE), random.Random(3)
    alphabet = "abcdefé ñ'\n\t 12.,!  日\u00a0"
    texts = HARD + ["".join(chance.choices(alphabet, k=chance.randint(0, 80))) for _ in range(500)]
    for text in texts:
        want = byte.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == want, text
        assert coder.decode(want) == byte.decode(want, skip_special_tokens=False)


def test_bpe_cache_may_be_emptied(monkeypatch, byte):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    coder = bpe.Bpe(BYTE)
    text = "many different words run through a small cache again and again"
    assert coder.encode(text) == byte.encode(text, add_special_tokens=False).ids


def test_encode_decode_rows(docs, docs_rows, byte):
    got = {r.doc_id: r for r in bpe.encode_decode(docs, BYTE).collect()}
    assert len(got) == len(docs_rows)
    for doc_id, text, *_ in docs_rows:
        ids = byte.encode(text or "", add_special_tokens=False).ids
        assert got[doc_id].ids == ids and got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded == byte.decode(ids, skip_special_tokens=False)
        assert got[doc_id].decoded_sha256 == hashlib.sha256(got[doc_id].decoded.encode()).hexdigest()


def test_word_encoder_equals_the_library(word):
    coder, chance = token_files.Encoder(WORD, 2), random.Random(4)
    alphabet = "abcdefÀé ñ'\n\t 12.,!#  日\u00a0A"
    texts = HARD + ["<|startoftext|> A", "<|STARTOFTEXT|>"] + ["".join(chance.choices(alphabet, k=chance.randint(0, 80))) for _ in range(500)] + ["w" * 150_000]
    for part in (texts[:100], texts[100:], texts):
        for text, ids in zip(part, coder.encode(part), strict=True):
            want = [*word.encode(text, add_special_tokens=False).ids, 2]
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want, text


def written(spark, docs, **options):
    path = c.scratch(spark, "tokens")
    return path, token_files.write(docs, path, WORD, **options)


def test_files_round_trip(spark, docs, docs_rows, word):
    path, manifest = written(spark, docs, files=3)
    assert manifest.count() == 3
    got = sorted(token_files.read(manifest, path).collect(), key=lambda r: r.doc_id)
    start = 0
    for row, (doc_id, text, *_) in zip(got, sorted(docs_rows), strict=True):
        ids = [*word.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids) == (doc_id, start, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)


def test_one_document_is_read_alone(spark, docs, docs_rows, word):
    path, manifest = written(spark, docs, files=2)
    found = [token_files.Reader(path, r.file).document(17) for r in manifest.collect()]
    ids = next(x for x in found if x is not None)
    assert ids.tolist() == [*word.encode(dict(r[:2] for r in docs_rows)[17] or "", add_special_tokens=False).ids, 2]
    assert sum(x is not None for x in found) == 1


def test_wrong_dictionary_and_damage_are_seen(spark, docs):
    path, manifest = written(spark, docs, files=1)
    name = manifest.first().file
    with pytest.raises(ValueError):
        token_files.Reader(path, name, b"another dictionary")
    local = path.removeprefix("file://")
    raw = bytearray(open(f"{local}/{name}", "rb").read())
    reader = token_files.Reader(path, name)
    raw[int(reader.index["offset"][20]) + 9] ^= 0xFF
    with open(f"{local}/{name}", "wb") as f:
        f.write(raw)
    with pytest.raises(Exception):  # noqa: B017
        token_files.Reader(path, name).at(20)


def test_files_are_deterministic(spark, docs):
    read = lambda path, name: open(f"{path.removeprefix('file://')}/{name}", "rb").read()
    one, two = written(spark, docs, files=2), written(spark, docs.repartition(3), files=2)
    names = sorted(r.file for r in one[1].collect())
    assert [read(one[0], n) for n in names] == [read(two[0], n) for n in names]


def test_odd_and_empty_tables(spark, odd, empty):
    table, rows = odd
    path, manifest = written(spark, table)
    got = token_files.read(manifest, path).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 2
    assert sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)
    path, manifest = written(spark, empty)
    assert token_files.read(manifest, path).isEmpty()
    assert bpe.encode_decode(table, BYTE).count() == len(rows) and bpe.encode_decode(empty, BYTE).isEmpty()
