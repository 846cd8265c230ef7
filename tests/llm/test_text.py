import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlog.llm import _common as c
from loomlog.llm import decontaminate, katz, quality, queries
from tests.llm.conftest import prose

# Decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits(text, items):
    have, covered, found = words(text), set(), set()
    for item, told in items:
        w = words(told)
        for i in range(max(1, len(w) - 9) if w else 0):
            part = w[i : i + 10]
            for s in range(len(have) - len(part) + 1):
                if have[s : s + len(part)] == part:
                    covered |= set(range(s, s + len(part)))
                    found.add(str(item) if item is not None else "")
    return len(have), len(covered), sorted(found)


@pytest.fixture(scope="module")
def items(docs_rows):
    long = [t for _, t, *_ in docs_rows if t and 150 < len(words(t)) < 2000]
    return [(1, " ".join(words(long[0])[5:40])), (2, long[1].upper()), (10, "b c"), (3, "b c"), (4, None), (5, "!!"), (6, " ".join(words(long[2])[-12:])), (None, "語"), (1, "ünïcode")]


@pytest.mark.parametrize("block", [10**6, 1])
def test_decontamination_equals_every_window(spark, docs, docs_rows, items, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    found = decontaminate.find(docs, spark.createDataFrame(items, "item_id long, text string").coalesce(1)).collect()
    assert len(found) == len(docs_rows)
    texts = dict(r[:2] for r in docs_rows)
    for row in found:
        want = hits(texts[row.doc_id], items)
        assert (row.n_words, row.n_hit, row.items) == want and row.n_items == len(want[2]) and row.contaminated == (want[1] > 0)
        covered = {i for a, b in row.char_spans or () for i in range(a, b)}
        low = "".join(x.lower() if "A" <= x <= "Z" else x for x in texts[row.doc_id] or "")
        assert sum(m.start() in covered for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)) == row.n_hit
    assert any(r.contaminated for r in found) and not all(r.contaminated for r in found)


def test_spans_are_offsets_of_the_original(spark):
    text = "Zero; ONE two-three\tfour Five six 7 eight nine ten, éleven! twelve"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one TWO three four five six 7 eight nine ten éleven")], "item_id long, text string")
    row = decontaminate.find(docs, bench).first()
    assert [text[a:b] for a, b in row.char_spans] == ["ONE two-three\tfour Five six 7 eight nine ten, éleven"] and row.n_hit == 11


@pytest.mark.parametrize("block", [10**6, 1])
def test_decontamination_of_odd_rows(spark, odd, empty, items, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    table, rows = odd
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("kind", F.lit(1))
    assert decontaminate.find(table, bench).count() == len(rows)
    assert decontaminate.find(empty, bench).isEmpty()
    none = decontaminate.find(table, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)


# Katz


def katz_brute(rows):
    counts, after, told = collections.Counter(), collections.defaultdict(collections.Counter), []
    for i, text in rows:
        w, held = [*(text or "").encode().lower().split(), "END"], i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        told.append((i, held, w))
        if not held:
            counts.update(w)
            for a, b in zip(["START", *w], w, strict=False):
                after[a][b] += 1
    total, types = sum(counts.values()), len(counts)

    def discount(values):
        n = collections.Counter(values)
        return katz.discounts(np.array([n[r] for r in range(1, 7)]))

    d1, d2 = discount(counts.values()), discount(x for b in after.values() for x in b.values())
    cut = lambda x, d: x * d[x] if x <= 5 else x
    freed = total - sum(cut(x, d1) for x in counts.values())
    norm = total if freed > 1e-9 else total + 1
    one = lambda w: cut(counts[w], d1) / norm if w in counts else (freed if freed > 1e-9 else 1) / norm
    rest = {}
    for h, b in after.items():
        have = sum(b.values())
        seen = sum(cut(x, d2) for x in b.values())
        whole = have if have - seen > 1e-9 * have else have + 1
        rest[h] = whole, (whole - seen) / whole / (1 - sum(map(one, b)))
    for h in list(after)[:20]:
        p = [cut(after[h][w], d2) / rest[h][0] if w in after[h] else rest[h][1] * one(w) for w in [*counts, "unknown"]]
        assert math.isclose(sum(p), 1, rel_tol=1e-9)
    out = []
    for i, held, w in told:
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (types + 1))) for x in w)
        model = sum(math.log10(one(b) if a not in after else cut(after[a][b], d2) / rest[a][0] if b in after[a] else rest[a][1] * one(b)) for a, b in zip(["START", *w], w, strict=False))
        out.append((i, held, len(w), sum(x in counts for x in w), total, base, model))
    return out


def katz_rows(table):
    return sorted((tuple(r) for r in katz.score(table, c.remainder("doc_id", 5) == 1).collect()), key=repr)


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("size, hot", [(10**6, 2000), (700, 2000), (700, 10)])
def test_katz_equals_the_plain_model(docs, docs_rows, monkeypatch, size, hot):
    monkeypatch.setattr(katz, "CHUNK_TOKENS", size)
    same(katz_rows(docs), katz_brute([r[:2] for r in docs_rows]))


def test_katz_of_odd_rows(spark, odd, empty):
    table, rows = odd
    got = katz_rows(table)
    assert len(got) == len(rows)
    known = lambda found: [r for r in found if r[0] is not None]
    same(known(got), known(katz_brute([r[:2] for r in rows])))
    assert katz_rows(empty) == []
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    alone = katz_rows(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string"))
    assert [r[1:5] for r in alone] == [(True, 3, 0, 0)] * 3 and all(r[6] == 0 for r in alone)


def test_good_turing_falls_back():
    assert katz.discounts(np.zeros(6, int))[1:] == pytest.approx([(r - 0.5) / r for r in range(1, 6)])
    d = katz.discounts(np.array([1000, 300, 150, 90, 60, 40]))
    assert all(0 < x < 1 for x in d[1:])


# Quality


def labelled(n=400, seed=2):
    chance = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text, good = prose(chance, chance.randint(30, 90)), chance.random() < 0.7
        if not good:
            text = chance.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: " ".join(w + "###" for w in t.split()), lambda t: " | ".join(t.split())])(text)
        docs.append((i, text))
        labels.append((i, int(good), 0))
    return docs, labels


def test_quality_is_learned_and_repeatable(spark):
    docs, labels = labelled()
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    space = quality.fit(docs, labels.where(c.remainder("doc_id", 5) != 0))
    got = quality.score(docs, space).join(labels, "doc_id").where(c.remainder("doc_id", 5) == 0).collect()
    assert sum((r.score >= queries.ACCEPT) == r.quality for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    again = quality.score(docs.repartition(7), quality.fit(docs.repartition(3), labels.where(c.remainder("doc_id", 5) != 0)))
    assert {r.doc_id: r.score for r in again.collect()} == pytest.approx({r.doc_id: r.score for r in quality.score(docs, space).collect()})


def test_votes_equal_brute_force():
    docs, labels = labelled(200)
    texts = [t for _, t in docs]
    space = quality.Space(texts[:120], [x for _, x, _ in labels[:120]])
    place = space.place(texts)
    for i in range(120, 200):
        near = sorted(((float(place[i] @ v), float(x)) for v, x in zip(space.vectors, space.labels, strict=True)), reverse=True)[: quality.NEIGHBOURS]
        weight = [max(s, 0) ** quality.SHARPNESS for s, _ in near]
        assert space.score([texts[i]])[0] == pytest.approx(sum(w * x for w, (_, x) in zip(weight, near, strict=True)) / sum(weight), abs=0.02)


def test_quality_of_odd_rows(spark, odd, empty):
    table, rows = odd
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (4, 7), (1, 1), (99, 1)], "doc_id long, quality int")
    space = quality.fit(table, labels)
    got = quality.score(table, space, keep=F.struct("kind", "row")).collect()
    assert len(got) == len(rows) and got[0].row.kind == "kind"
    assert quality.score(empty, space).isEmpty()
    blank = quality.fit(empty, labels.limit(0))
    assert {r.score for r in quality.score(table, blank).collect()} == {0.5}


def test_held_out_rows_are_not_learned_from(spark, sf):
    got = queries.op3_quality(spark, sf).join(c.table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.9 * len(got)


def test_digest_of_items(spark, sf):
    for row in queries.op4_decontaminate(spark, sf).where("n_items = 0").limit(1).collect():
        assert row.items_sha256 == hashlib.sha256(b"").hexdigest()


def test_the_sample_is_bounded_where_ids_repeat(spark):
    docs = spark.range(300).selectExpr("id % 2 AS doc_id", "concat('text ', id) AS text").unionAll(spark.createDataFrame([(5, None), (None, "a")], "doc_id long, text string"))
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (5, 1), (None, 1), (9, 0)], "doc_id long, quality int")
    space = quality.fit(docs, labels, references=4)
    assert sorted(space.labels.tolist()) == [0, 1, 1]
    again = quality.fit(docs.repartition(5), labels.repartition(2), references=4)
    assert (space.vectors == again.vectors).all()
