import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomlog.llm import _common as c
from loomlog.llm import chroma, queries, url_filter, warc

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages_rows():
    chance = random.Random(6)
    bodies = ["<p>" + "".join(chance.choices("abé \r\n", k=n)) for n in (0, 5, 990, 1500, 1500, 4000)] + [None, "", "x" * 999, "x" * 1000, "\r\n\r\n" * 400]
    return [(i, f"http://h{i % 4}.example.com/{i}", chance.choice(bodies)) for i in range(80)]


@pytest.fixture(scope="module")
def pages(spark, pages_rows):
    return spark.createDataFrame(pages_rows, PAGES).repartition(4)


def written(spark, pages, **options):
    path = c.scratch(spark, "warc")
    return path, warc.write(pages, path, **options)


def test_warc_round_trip(spark, pages, pages_rows):
    path, manifest = written(spark, pages, ranges=3, roll_bytes=3000)
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == 80
    got = {r.page_id: r for r in warc.read(spark, manifest, path).collect()}
    last = {}
    for i, _, html in pages_rows:
        last[html or ""] = i
    for i, url, html in pages_rows:
        body, row = (html or "").encode(), got[i]
        revisit = len(body) >= 1000 and last[html or ""] != i
        assert (row.url, row.payload_bytes, row.payload_digest) == (url, len(body), hashlib.sha1(body).hexdigest())
        assert (row.record_type, row.refers_to) == (("revisit", last[html]) if revisit else ("response", None))
        assert row.payload == (None if revisit else body)


def test_warc_record_ids_are_unique(spark):
    rows = [(1, "http://a", "x" * 1200), (1, "http://a", "x" * 1200), (1, "http://b", "y"), (None, None, "y"), (None, None, "y"), (7, "http://c", "x" * 1200), (7, "http://c", "z")]
    path, manifest = written(spark, spark.createDataFrame(rows, PAGES).repartition(3), ranges=2)
    heads = []
    for r in manifest.collect():
        with gzip.open(f"{path.removeprefix('file://')}/{r.file}") as f:
            heads += [x for x in f.read().split(b"\r\n") if x.startswith((b"WARC-Record-ID", b"WARC-Refers-To"))]
    ids = [x.split(b": ")[1] for x in heads if x.startswith(b"WARC-Record-ID")]
    assert len(ids) == len(set(ids)) == len(rows)
    refers = [x.split(b": ")[1] for x in heads if x.startswith(b"WARC-Refers-To")]
    assert len(refers) == 2 and set(refers) <= set(ids)


def test_warc_files_are_deterministic_gzip_members(spark, pages):
    one, two = written(spark, pages, ranges=2), written(spark, pages.repartition(7), ranges=2)
    for name in sorted(r.file for r in one[1].collect()):
        raw = [open(f"{p.removeprefix('file://')}/{name}", "rb").read() for p, _ in (one, two)]
        assert raw[0] == raw[1]
        text = gzip.decompress(raw[0])
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and b"WARC-Block-Digest: sha1:" in text


def test_warc_of_odd_rows(spark):
    rows = [(None, None, None), (None, "u\nv", "y" * 2000), (3, "http://a", "z" * 2000), (3, "http://a", "z" * 2000), (4, "http://b", "z" * 2000), (4, "http://c", None), (9, "é", "z" * 2000), (9, "é", "z" * 2000)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], f"{PAGES}, digest string, part string")
    path, manifest = written(spark, table)
    got = warc.read(spark, manifest, path).collect()
    assert len(got) == len(rows)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes == 2000 and r.page_id) == [(3, "revisit", 9), (3, "revisit", 9), (4, "revisit", 9), (9, "response", None), (9, "response", None)]
    path, manifest = written(spark, table.limit(0))
    assert warc.read(spark, manifest, path).isEmpty()


# URL filters


def split_brute(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for sign in "#?":
        rest = rest.split(sign, 1)[0]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in host), slash + path


URLS = ["http://a.example.net/en/1?x=/#y", "https://EXAMPLE.net/de/", "http://example.net", "http://example.net?/en/", "http://b.example.com/de/x", "http://b.example.com/deutsch", "http://x.org/fr/1", "http://x.org/en", "http://planet/", "http://net/", "http://notnet/", None, "", "no scheme", "://", "a://b://c/d", "HTTP://É.Org/fr/é", "http://u.co.uk/#", "mailto:x"]


def rule_brute(host, path):
    fits = [(r, v) for r, v in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=lambda x: len(x[0])) if fits else (None, None)


def test_hosts_paths_and_rules(spark):
    table = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("says", F.lit(1))
    none = spark.createDataFrame([], "host string, good int")
    got = {r.page_id: r for r in url_filter.judge(table, none).collect()}
    for i, url in enumerate(URLS):
        host, path = split_brute(url)
        rule, verdict = rule_brute(host, path)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), url
    assert url_filter.judge(table.limit(0), none).isEmpty()


def test_domains(spark):
    hosts = spark.createDataFrame([("a.b.example.com",), ("example.com",), ("com",), ("x.y.co.uk",), ("co.uk",), ("",)], "h string")
    assert [tuple(r) for r in hosts.select(url_filter.domain_of(F.col("h")), url_filter.suffix_of(F.col("h"))).collect()] == [("example.com", "com"), ("example.com", "com"), ("com", "com"), ("y.co.uk", "co.uk"), ("co.uk", "co.uk"), ("", "")]


def test_reputation_shrinks_and_blocks(spark):
    chance = random.Random(1)
    outcomes = [(f"h{d}{k}.{name}.com", int(chance.random() < rate)) for d, (name, rate) in enumerate([("good", 0.95), ("bad", 0.05), ("mixed", 0.6)]) for k in range(20) for _ in range(chance.randint(1, 30))]
    outcomes += [("one.good.com", 0), ("many.good.com", 0), *[("many.good.com", 0)] * 60, ("null.com", None)]
    suffixes, domains, hosts, rate = url_filter.reputation(spark.createDataFrame(outcomes, "host string, good int"))
    mean = {r.host: r.mean for r in hosts.collect()}
    assert mean["many.good.com"] < mean["one.good.com"] < 0.95 and mean["one.good.com"] > 0.4
    assert 0 < rate < 1 and suffixes.count() == 1 and {r.domain for r in domains.collect()} == {"good.com", "bad.com", "mixed.com"}
    urls = ["http://many.good.com/x", "http://one.good.com/x", "http://new.bad.com/", "http://new.good.com/", "http://other.dev/"]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(outcomes, "host string, good int"))
    assert {r.page_id: r.verdict for r in got.collect()} == {0: "block", 1: "allow", 2: "block", 3: "allow", 4: "allow"}


def test_url_query_covers_every_page(spark, sf):
    got = sorted((r.page_id, r.host, r.path, r.rule) for r in queries.op10_url_filter(spark, sf).collect())
    pages = [(r.page_id, *split_brute(r.url)) for r in c.table(spark, sf, "pages").select("page_id", "url").collect()]
    assert [x[:3] for x in got] == sorted(pages)
    assert all(rule == rule_brute(host, path)[0] for _, host, path, rule in got)


def test_urls_of_odd_rows(spark):
    """Null ids, null and blank urls, repeated rows and clashing columns: a row for each, and one verdict for each host without a rule."""
    urls = [(1, "http://many.bad.dev/a"), (1, "http://many.bad.dev/a"), (None, "http://many.bad.dev/b"), (2, None), (2, ""), (None, None), (3, "http://"), (4, "no scheme"), (5, "http://good.dev/")]
    pages = spark.createDataFrame([(i, u, "x", 0.5, 1) for i, u in urls], "page_id long, url string, host string, mean double, salt int")
    outcomes = spark.createDataFrame([("many.bad.dev", 0)] * 50 + [("good.dev", 1)] * 50 + [(None, 0), ("", None)], "host string, good int")
    got = url_filter.judge(pages, outcomes).collect()
    shape = lambda found: sorted(found, key=repr)
    want = [(i, *split_brute(u), None, "block" if "bad" in (u or "") else "allow") for i, u in urls]
    assert shape((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == shape(want)


# Chroma


def tone(notes, rate=8000, seconds=0.6):
    t = np.arange(int(rate * seconds)) / rate
    return np.concatenate([sum(np.sin(2 * np.pi * 440 * 2 ** ((n + 12 * o) / 12) * t) for o in (-1, 0)) for n in notes])


def test_audio_aligns_at_its_offset(spark):
    chance = np.random.default_rng(1)
    notes = chance.integers(0, 12, 60)
    whole = tone(notes)
    shift = 20 * chroma.STEP
    sounds = [whole, 0.3 * whole[shift:] + 0.01 * chance.normal(size=len(whole) - shift), tone(chance.integers(0, 12, 60))]
    prints = [chroma.fingerprints(chroma.audio_frames(s, 8000)[None])[0].view(np.int32).tolist() for s in sounds]
    table = spark.createDataFrame(list(enumerate(prints)), "id long, fingerprint array<int>")
    got = {(r.query_class, r.match_class): r.offset for r in chroma.align(table, F.col("id") == 0).collect()}
    assert got == {(0, 0): 0, (0, 1): 20}


def test_integral_image_equals_sums():
    frames = np.random.default_rng(2).random((1, 12, 12))
    got = chroma.fingerprints(frames)[0]
    level = frames[0] / frames[0].sum(1, keepdims=True)
    kind, p, h, w = chroma.FILTERS[0]
    a, whole = level[:w, p : p + h // 2].sum(), level[:w, p : p + h].sum()
    ratio = np.log((a + chroma.FLOOR) / (whole - a + chroma.FLOOR))
    step = sum(ratio > x for x in (-chroma.STRONG, 0, chroma.STRONG))
    assert kind == 0 and got[0] & 3 == step ^ (step >> 1)


def test_recall_against_all_alignments(spark):
    chance = np.random.default_rng(3)
    base = chance.normal(size=(150, 64)) * 0.2
    vectors = np.concatenate([base, base[:75] + chance.normal(size=(75, 64)) * 0.004, base[:5]])
    prints = chroma.fingerprints(chroma.vector_frames(vectors.astype(np.float32)))
    want = set()
    for i in range(0, len(vectors), 5):
        for j in range(len(vectors)):
            for offset in range(-30, 31):
                x, y = prints[i][max(offset, 0) :], prints[j][max(-offset, 0) :]
                n = min(len(x), len(y))
                if n >= chroma.MIN_OVERLAP and np.bitwise_count(x[:n] ^ y[:n]).sum() <= chroma.MAX_ERROR * 32 * n:
                    want.add((i, j))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors.astype(np.float32))], "vec_id long, embedding array<float>")
    stored = chroma.fingerprint_vectors(table)
    found, members = chroma.align(stored, F.col("id") % 5 == 0).collect(), chroma.members(stored).collect()
    class_of = {r.id: r["class"] for r in members}
    pairs = {(r.query_class, r.match_class) for r in found}
    hit = {(i, j) for i, j in want if (class_of[i], class_of[j]) in pairs}
    assert len(hit) >= 0.9 * len(want) and len(want) > 60
    assert pairs <= {(class_of[i], class_of[j]) for i, j in want}


def test_chroma_of_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [1.0] * 64), (3, [1.0] * 64), (20, [1.0] * 64), (None, [0.5] * 64), (40, [float("nan")] * 64), (60, [0.0] * 10), (80, [None] * 64)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, class string")
    prints = chroma.fingerprint_vectors(table)
    assert prints.count() == len(rows)
    members = {r.id: r["class"] for r in chroma.members(prints).collect()}
    assert chroma.members(prints).count() == len(rows)
    assert members[3] == members[20] == 3 and members[40] == members[80] == 40
    assert [members[i] for i in (1, 2, None, 60)] == [None] * 4
    found = {(r.query_class, r.match_class, r.offset, r.bit_errors) for r in chroma.align(prints, F.col("id") % 20 == 0).collect()}
    assert {(3, 3, 0, 0), (40, 40, 0, 0)} <= found and all(q in (3, 40) and m in (3, 40) for q, m, *_ in found)
    assert chroma.align(prints.limit(0), F.lit(True)).isEmpty()


def test_op8_returns_every_match(spark, tmp_path):
    chance = np.random.default_rng(8)
    base = chance.normal(size=(12, 64)) * 0.2
    vectors = np.concatenate([base, *(base[:6] + chance.normal(size=(6, 64)) * 0.002 for _ in range(4)), base[:4]]).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    prints = chroma.fingerprint_vectors(table)
    class_of = {r.id: r["class"] for r in chroma.members(prints).collect()}
    want = {(i, j, *r[2:]) for r in chroma.align(prints, F.col("id") % 20 == 0).collect() for i in class_of if i % 20 == 0 and class_of[i] == r.query_class for j in class_of if class_of[j] == r.match_class}
    got = queries.op8_chroma(spark, str(tmp_path)).collect()
    members = [(r.id, r.class_id) for r in got if r.kind == "member"]
    links = [(r.id, r.class_id, r.offset, r.votes, r.overlap, r.bit_errors) for r in got if r.kind == "link"]
    assert len(set(members)) == len(members) and len(links) + len(members) == len(got)
    assert {(i, j, *x[2:]) for x in links for i, a in members if a == x[0] and i % 20 == 0 for j, b in members if b == x[1]} == want
    assert max(Counter(i for i, *_ in want).values()) > 2


def plain_links(prints, asked):
    """What align returns of distinct fingerprints, in plain Python."""
    later, found = sum(2 << (2 * i) for i in range(chroma.SIGNS)), []
    keys = {i: [(x[t], x[t + chroma.WIDTH] & later) for t in range(len(x) - chroma.WIDTH)] for i, x in prints.items()}
    for i in asked:
        for j in prints:
            votes = Counter(s - t for s, x in enumerate(keys[i]) for t, y in enumerate(keys[j]) if x == y)
            if votes:
                n, _, offset = max((n, -abs(o), o) for o, n in votes.items())
                x, y = prints[i][max(offset, 0) :], prints[j][max(-offset, 0) :]
                overlap = min(len(x), len(y))
                bits = sum((a ^ b).bit_count() for a, b in zip(x, y, strict=False))
                if overlap >= chroma.MIN_OVERLAP and bits <= chroma.MAX_ERROR * 32 * overlap:
                    found.append((i, j, offset, n, overlap, bits))
    return sorted(found)


@pytest.mark.parametrize(("block", "meetings", "held"), [(200_000, 100_000, 500_000), (7, 1, 10), (1, 60, 1)])
def test_near_copies_of_any_length_in_blocks(spark, monkeypatch, block, meetings, held):
    monkeypatch.setattr(chroma, "MEETINGS", meetings)  # of this process: workers have their own
    monkeypatch.setattr(chroma, "HELD", held)
    chance = np.random.default_rng(9)
    base, same, prints = [int(x) for x in chance.integers(0, 2**32, 50)], int(chance.integers(0, 2**32)), {}
    for i in range(40):
        start, size = (int(x) for x in (chance.integers(0, 12), chance.integers(15, 39)))
        prints[i] = [x ^ (1 << int(chance.integers(0, 32)) if chance.random() < 0.4 else 0) for x in base[start : start + size]]
    prints |= {40 + i: [same] * (16 + i) for i in range(4)} | {50: base[:30] + [same] * 9}
    kept = {i: x for i, x in prints.items() if len(x) >= chroma.MIN_OVERLAP}
    table = spark.createDataFrame([(i, np.array(x, np.uint32).view(np.int32).tolist()) for i, x in prints.items()], "id long, fingerprint array<int>")
    want = plain_links(kept, [i for i in kept if i % 2 == 0])
    assert sum(a != b for a, b, *_ in want) > 100
    assert sorted(tuple(r) for r in chroma.align(table, F.col("id") % 2 == 0, block=block).collect()) == want
    laid = [chroma.Prints(pa.table({"class": ids, "fingerprint": pa.array([np.array(kept[i], np.uint32).view(np.int32) for i in ids], pa.list_(pa.int32()))})) for ids in ([i for i in kept if i % 2 == 0], list(kept))]
    assert sorted(tuple(r.values()) for b in chroma.matches(laid[0].sort(), laid[1], chroma.MAX_ERROR) for r in b.to_pylist()) == [r for r in want if r[0] != r[1]]


def test_meetings_of_near_copies_are_no_rows(spark):
    table = spark.createDataFrame([(i, [i, *range(30)]) for i in range(40)], "id long, fingerprint array<int>")
    found = chroma.align(table, F.lit(True))
    assert found.count() == 40 * 40
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
