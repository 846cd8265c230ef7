"""Queries over whole tables, against plain Python on tables larger than the old filters let through."""

from collections import defaultdict

import pyarrow.parquet as pq

from loomlog import queries as q
from tests.conftest import rows

LARGER = "/root/testdata/sf0.01"


def test_cycle_links_every_supplier(spark):
    of = defaultdict(list)
    for r in pq.read_table(f"{LARGER}/supplier.parquet").to_pylist():
        of[r["s_nationkey"]].append(r["s_suppkey"])
    want = sorted((a, b) for group in of.values() if len(group) > 1 for a in group for b in group)
    assert max(a for a, _ in want) >= 40
    assert rows(q.QUERIES["recursive_cycle"](spark, LARGER)) == want


def test_tree_closures_reach_orders(spark):
    read = lambda t: pq.read_table(f"{LARGER}/{t}.parquet").to_pylist()
    up = {f"nation/{r['n_nationkey']}": f"region/{r['n_regionkey']}" for r in read("nation")}
    up |= {f"customer/{r['c_custkey']}": f"nation/{r['c_nationkey']}" for r in read("customer")}
    up |= {f"order/{r['o_orderkey']}": f"customer/{r['o_custkey']}" for r in read("orders")}
    want = set()
    for node in up:
        at = node
        while at in up:
            at = up[at]
            want.add((at, node))
    assert any(b.startswith("order/") and a.startswith("region/") for a, b in want)
    assert rows(q.QUERIES["closure_reachable_all"](spark, LARGER)) == sorted(want)
    assert rows(q.QUERIES["recursive_path_count_sql"](spark, LARGER)) == [(sum(a == "region/1" for a, _ in want),)]


def test_compounds_of_every_line(spark):
    lines = pq.read_table(f"{LARGER}/lineitem.parquet", columns=["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"]).to_pylist()
    facts = {(f"part/{r['l_partkey']}", f"a,b:{r['l_orderkey']}", "returned" if r["l_returnflag"] == "R" else "kept") for r in lines}
    ids = {x: f"Review:by={x[1].replace(',', '%2C').replace(':', '%3A')},item={x[0]},note={x[2]}" for x in facts}
    assert len(facts) > 2 * sum(r["l_linenumber"] == 1 for r in lines)
    assert rows(q.QUERIES["compound_identity"](spark, LARGER)) == sorted((i,) for i in ids.values())
    assert rows(q.QUERIES["compound_assertion_rows"](spark, LARGER)) == sorted((i, p, v) for x, i in ids.items() for p, v in zip(("item", "by", "note"), x, strict=True))
    assert rows(q.QUERIES["compound_roundtrip"](spark, LARGER).select("item", "by")) == sorted(x[:2] for x in facts if x[2] == "returned")


def test_changes_show_large_predicates(spark, sf):
    placed = pq.read_table(f"{sf}/orders.parquet").num_rows
    for name in ("insert_facts_idempotent", "delete_facts_no_cascade"):
        assert q.QUERIES[name](spark, sf).where("predicate_id = 'placed_by'").count() == placed
    for name in ("insert_vertices_idempotent", "delete_vertices", "vertex_closure_on_load"):
        assert q.QUERIES[name](spark, sf).where("id LIKE 'order/%'").count() == placed
