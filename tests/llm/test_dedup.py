import hashlib
import random

import numpy as np
import pytest

from loomlog.llm import jaccard_join, substring_dedup
from loomlog.llm.components import components


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def linked(rows):
    """Size and component of each (id, text) by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, x) in enumerate(sets):
        for j, y in sets[:n]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(((i, len(x), None if i is None else find(i)) for i, x in sets), key=repr)


def joined(table, **options):
    return sorted((tuple(r) for r in jaccard_join.join(table, **options).collect()), key=repr)


def test_join_equals_all_pairs(docs, docs_rows):
    assert joined(docs) == linked([r[:2] for r in docs_rows])


def near_group(seed, n=40):
    """Copies of one text that differ from it, and more from each other."""
    chance = random.Random(seed)
    base = [f"w{chance.randrange(10_000)}" for _ in range(90)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        words = list(base)
        for _ in range(chance.choice([1, 1, 2, 2, 3, 5])):
            words[chance.randrange(len(words))] = f"v{i}x{chance.randrange(100)}"
        rows.append((i, " ".join(words[: chance.choice([90, 90, 85, 78])])))
    return rows + [(n + i, rows[i % 7][1]) for i in range(10)]


@pytest.mark.parametrize("seed", range(3))
def test_near_copies_equal_all_pairs(spark, seed):
    rows = near_group(seed)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == linked(rows)


@pytest.mark.parametrize("bounds", [{"LISTS": 0}, {"LISTS": 1, "SHARED": 1}, {"NEIGHBOURS": 0}, {"NEIGHBOURS": 1}, {"SHARED": 10_000}])
def test_bounds_of_the_first_round_lose_no_link(spark, monkeypatch, bounds):
    """However little the first round finds, the second finds the rest."""
    rows = near_group(3) + [(1000 + i, t) for i, t in near_group(4, 25)]
    for name, value in bounds.items():
        monkeypatch.setattr(jaccard_join, name, value)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == linked(rows)


def test_join_of_odd_rows(spark, odd, empty):
    table, rows = odd
    got = joined(table)
    assert len(got) == len(rows)
    assert sorted((n for _, n, _ in got)) == sorted(len(shingles(r[1])) for r in rows)
    assert all(i is None and k is None or k <= i for i, _, k in got)
    assert joined(empty) == []
    assert joined(spark.createDataFrame([(1, None), (2, ""), (3, None)], "doc_id long, text string")) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    # texts of one id are linked
    assert joined(spark.createDataFrame([(5, "a b c"), (5, "d e f"), (9, "d e f"), (7, "a b c")], "doc_id long, text string")) == [(5, 1, 5), (5, 1, 5), (7, 1, 5), (9, 1, 5)]


def test_the_prefix_filter_misses_nothing():
    chance = np.random.default_rng(5)
    levels = chance.integers(0, 20, 1 << jaccard_join.SKETCH_BITS).astype(np.uint8)
    for _ in range(300):
        common = chance.integers(1, 1 << 63, chance.integers(1, 60), dtype=np.uint64)
        x, y = (np.unique(np.append(common, chance.integers(1, 1 << 63, chance.integers(0, 8), dtype=np.uint64))) for _ in range(2))
        both = len(np.intersect1d(x, y))
        similar = 100 * both >= 80 * (len(x) + len(y) - both)
        orders = [[jaccard_join.order_prefix(t, s, 80) for s in jaccard_join.ORDERS] for t in (x, y)]
        assert jaccard_join.similar(x, y, *orders, 80) == similar
        if similar:
            a, b = (jaccard_join.rare_prefix(t, levels, 80).tolist() for t in (x, y))
            first = next(t for t in a if t in b)
            assert min(len(x) - a.index(first), len(y) - b.index(first)) >= -(-(len(x) + len(y)) * 80 // 180)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(3, i) for i in range(4, 30)] + [(50, 51), (51, 50), (7, 7), (None, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 3 for i in range(3, 30)} | {50: 50, 51: 50}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


# Substring dedup


def cut(rows, window=20):
    """What stays of each (id, text), by looking at every window of every document."""
    last = 1 << 63
    words = [(last if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for (i, _), (known, w) in zip(rows, words, strict=True):
        keep = [True] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (known, s):
                keep[s : s + window] = [False] * window
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def deduped(table, **options):
    return sorted((tuple(r) for r in substring_dedup.dedup(table, **options).drop("kept").collect()), key=repr)


def test_dedup_equals_every_window(docs, docs_rows):
    assert deduped(docs) == cut([r[:2] for r in docs_rows])


@pytest.mark.parametrize("window", [20, 9, 8, 3])
def test_dedup_of_small_alphabets(spark, window):
    chance = random.Random(window)
    rows = [(chance.randrange(1000), " ".join(chance.choices("ab", k=chance.randint(0, 120)))) for _ in range(30)]
    rows = list({i: (i, t) for i, t in rows}.values())
    assert deduped(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), window=window) == cut(rows, window)


def test_dedup_in_small_pieces(spark, docs, docs_rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(substring_dedup, "GROUP_WINDOWS", 50)
    assert deduped(docs) == cut([r[:2] for r in docs_rows])


def test_dedup_of_oversized_trees(spark, monkeypatch):
    """One prefix with most suffixes, which differ: it is lengthened, and its group is read part by part."""
    chance = random.Random(3)
    line = [f"l{i}" for i in range(9)]
    tails = [[f"t{chance.randrange(40)}" for _ in range(16)] for _ in range(25)]
    rows = [(i, " ".join([*chance.choice(tails), *line, *chance.choice(tails)])) for i in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = cut(rows)
    assert sum(r[2] for r in want) > 1000
    for tree in (1, 20, 10**6):
        monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 1500)
        monkeypatch.setattr(substring_dedup, "GROUP_WINDOWS", 40)
        monkeypatch.setattr(substring_dedup, "TREE_WINDOWS", tree)
        assert deduped(table) == want


def test_names_that_collide_are_told_apart_by_words():
    """Windows whose names agree in all bits but one, and in all bits, are repeats only where their words are equal."""
    chance = np.random.default_rng(2)
    words = chance.integers(0, 1 << 48, 30, dtype=np.uint64)
    tables, codes, want = [], [], set()
    seen = {}
    for i in range(200):
        text = chance.choice(words[:3], 8)
        tables.append(np.array([[10 * i, 4, i, 0]], "<i8").tobytes())
        codes.append(substring_dedup.low_bytes(text, substring_dedup.CODE).tobytes())
        for k in range(4):
            if seen.setdefault(tuple(text[k : k + 5]), (i, k)) != (i, k):
                want.add(10 * i + k)
    for names in (lambda x, k: np.zeros(len(x) - k + 1, np.uint64), lambda x, k: substring_dedup.c.rolling(x, k) & np.uint64(1), substring_dedup.c.rolling):
        group = substring_dedup.Group(5, 60, names)
        spans = [s for i in range(200) for s in group.add(7, tables[i], codes[i])] + list(group.fold())
        got = {w for _, blob in spans for low, high in np.frombuffer(blob, "<i8").reshape(-1, 2) for w in range(low, high - 4)}
        assert got == want


def test_dedup_of_odd_rows(odd, empty):
    table, rows = odd
    assert deduped(table) == cut([r[:2] for r in rows])
    assert deduped(empty) == []


def test_kept_text_is_untouched_or_joined(docs, docs_rows):
    texts = dict(r[:2] for r in docs_rows)
    for row in substring_dedup.dedup(docs).collect():
        if row.n_removed == 0:
            assert row.kept == texts[row.doc_id]
        else:
            assert hashlib.sha256(row.kept.encode()).hexdigest() == row.kept_sha256
