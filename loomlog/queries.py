"""The registered queries of the engine, one for each operator, each with the SQL that says the same.

The graph of the queries is a view of the tables: customers, nations, regions,
orders, parts and suppliers are vertices; `in_nation`, `in_region`,
`placed_by`, `supplies` and `label` are predicates.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomlog.operators import closure, graph, retrieval
from loomlog.plans import conjunction, external, logical, rules
from loomlog.plans import syntax as s
from loomlog.plans.logical import Col, Context, Lit, Op, Param
from loomlog.sources import migrations, text
from loomlog.sources.catalog import Catalog, select_edges, select_vertex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Edges by predicate: the subject's and the object's id, and the table.
EDGES = {
    "in_region": ("concat('nation/', n_nationkey)", "concat('region/', n_regionkey)", "nation"),
    "in_nation": ("concat('customer/', c_custkey)", "concat('nation/', c_nationkey)", "customer"),
    "based_in": ("concat('supplier/', s_suppkey)", "concat('nation/', s_nationkey)", "supplier"),
    "placed_by": ("concat('order/', o_orderkey)", "concat('customer/', o_custkey)", "orders"),
    "status": ("concat('order/', o_orderkey)", "o_orderstatus", "orders"),
    "segment": ("concat('customer/', c_custkey)", "c_mktsegment", "customer"),
    "nation_label": ("concat('nation/', n_nationkey)", "n_name", "nation"),
    "region_label": ("concat('region/', r_regionkey)", "r_name", "region"),
    "supplies": ("concat('supplier/', l_suppkey)", "concat('part/', l_partkey)", "lineitem"),
    "bought_from": ("concat('part/', l_partkey)", "concat('supplier/', l_suppkey)", "lineitem"),
}
NODES = {"region": "concat('region/', r_regionkey)", "nation": "concat('nation/', n_nationkey)", "customer": "concat('customer/', c_custkey)", "supplier": "concat('supplier/', s_suppkey)", "orders": "concat('order/', o_orderkey)"}
SCHEMAS = [s.PredicateSchema(name, "1", "node", "*", "text" if name in ("status", "segment", "nation_label", "region_label") else "node") for name in EDGES]
EDGES_SQL = "edges AS (" + " UNION ".join(f"SELECT {a} AS subject_id, '{p}' AS predicate_id, {b} AS object_id FROM {t}" for p, (a, b, t) in EDGES.items()) + ")"
VERTICES_SQL = "vertices AS (" + " UNION ".join(f"SELECT {e} AS id FROM {t}" for t, e in NODES.items()) + ")"
WITH = f"WITH {VERTICES_SQL}, {EDGES_SQL} "
WITH_RECURSIVE = f"WITH RECURSIVE {VERTICES_SQL}, {EDGES_SQL}, "


_schemas: dict[str, StructType] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Its schema is read from the files once, and then told: the view of the graph names tables many times."""
    path = f"{sf_dir}/{name}.parquet"
    if name not in _schemas:
        _schemas[name] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[name]).parquet(path)


def edge_rows(spark: SparkSession, sf_dir: str, names=tuple(EDGES)) -> DataFrame:
    """The view's edges. Each predicate is its own branch, so a constant predicate reads one table's columns."""
    parts = [load(spark, sf_dir, t).select(F.expr(a).alias("subject_id"), F.lit(p).alias("predicate_id"), F.expr(b).alias("object_id")) for p, (a, b, t) in EDGES.items() if p in names]
    parts = [p.distinct() if n in ("supplies", "bought_from") else p for n, p in zip([n for n in EDGES if n in names], parts, strict=True)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def the_graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    parts = [load(spark, sf_dir, t).select(F.expr(e).alias("id")) for t, e in NODES.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return graph.Graph(out, edge_rows(spark, sf_dir))


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The graph and its declared predicates, and every table as a predicate of its columns."""
    found = the_graph(spark, sf_dir).catalog(SCHEMAS)
    for name in TABLES:
        found.table(name, load(spark, sf_dir, name))
    return found


def ask(query: str, strict: bool = False):
    return lambda spark, sf_dir: conjunction.run_query(catalog(spark, sf_dir), text.parse_query(query), strict)


def program(source: str, name: str, columns: list[str]):
    return lambda spark, sf_dir: rules.Program(catalog(spark, sf_dir), text.parse_program(source)).rows(name, len(columns), columns)


def plan(node, parameters: tuple = ()):
    return lambda spark, sf_dir: logical.run(node, Context(catalog(spark, sf_dir), parameters))


def register(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


# Scans and bindings
register("vertex_scan", ask("vertex(id)"), WITH + "SELECT id FROM vertices")
register("edge_scan", ask("edge(subject, predicate, object)"), WITH + "SELECT subject_id AS subject, predicate_id AS predicate, object_id AS object FROM edges")
register("declared_predicate_scan", ask("in_nation(customer, nation)"), "SELECT DISTINCT concat('customer/', c_custkey) AS customer, concat('nation/', c_nationkey) AS nation FROM customer")
register("table_binding", ask("nation(k, n, r)"), "SELECT DISTINCT n_nationkey AS k, n_name AS n, n_regionkey AS r FROM nation")
register("alias_resolution", ask('Node(id), Vertex(id), Edge(id, "in_region", region)'), WITH + "SELECT DISTINCT v.id, e.object_id AS region FROM vertices v JOIN edges e ON e.subject_id = v.id AND e.predicate_id = 'in_region'")
# Values of different types meet as text, and a constant that a column's type cannot hold matches nothing
register("mixed_constant", ask('nation("x", n, r)'), "SELECT n_name AS n, n_regionkey AS r FROM nation WHERE CAST(n_nationkey AS VARCHAR) = 'x'")
register("mixed_comparison", ask('nation(k, n, r), k = "x"'), "SELECT n_nationkey AS k, n_name AS n, n_regionkey AS r FROM nation WHERE CAST(n_nationkey AS VARCHAR) = 'x'")
register("mixed_unequal", ask('nation(k, n, r), k != "x", k != "3"'), "SELECT n_nationkey AS k, n_name AS n, n_regionkey AS r FROM nation WHERE n_nationkey != 3")
register("mixed_join", ask("nation(k, n, r), region(n, z)"), "SELECT n_nationkey AS k, n_name AS n, n_regionkey AS r, r_name AS z FROM nation JOIN region ON n_name = CAST(r_regionkey AS VARCHAR)")
register("mixed_edge_join", ask('edge(a, "in_region", r), nation(a, _, _)'), WITH + "SELECT DISTINCT subject_id AS a, object_id AS r FROM edges JOIN nation ON subject_id = CAST(n_nationkey AS VARCHAR) WHERE predicate_id = 'in_region'")


def _table_where(spark, sf_dir):
    found = Catalog(spark)
    found.table("building", load(spark, sf_dir, "customer"), ["c_custkey", "c_nationkey"], where="c_mktsegment = 'BUILDING'")
    found.table("nation", load(spark, sf_dir, "nation"))
    return conjunction.run_query(found, text.parse_query("building(c, n), nation(n, name, _)"))


register("table_binding_where", _table_where, "SELECT DISTINCT c_custkey AS c, n_nationkey AS n, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")


def _view(spark, sf_dir):
    found = catalog(spark, sf_dir)
    load(spark, sf_dir, "orders").createOrReplaceTempView("loomlog_orders")
    found.view("spender", "SELECT o_custkey, count(*) AS n FROM loomlog_orders GROUP BY o_custkey HAVING count(*) > 10", columns=["customer", "orders"])
    return conjunction.run_query(found, text.parse_query("spender(c, n), customer(c, name, _, _, _)"))


register("view_binding", _view, "SELECT DISTINCT o_custkey AS c, count(*) AS n, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey, c_name HAVING count(*) > 10")


def _work(spark, sf_dir):
    found = catalog(spark, sf_dir)
    found.work("big_order", load(spark, sf_dir, "orders").where("o_totalprice > 300000").select("o_orderkey", "o_custkey"))
    return conjunction.run_query(found, text.parse_query("big_order(o, c), customer(c, name, _, _, _)"))


register("work_table_binding", _work, "SELECT DISTINCT o_orderkey AS o, o_custkey AS c, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000")


def _memory(spark, sf_dir):
    found = catalog(spark, sf_dir)
    found.memory("wanted", [("nation/3",), ("nation/1",)], ["id"], ordered_by=["id"])
    return conjunction.run_query(found, text.parse_query("wanted(n), in_region(n, r)"))


register("memory_relation", _memory, "SELECT DISTINCT concat('nation/', n_nationkey) AS n, concat('region/', n_regionkey) AS r FROM nation WHERE n_nationkey IN (1, 3)")
register("values_rows", plan(logical.Values(("k", "v"), ((1, "a"), (2, None)), ("int8", "text"))), "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a'), (2, NULL)) t(k, v)")
register("select_vertex_by_id", lambda spark, d: select_vertex(the_graph(spark, d).vertices, "nation/7"), WITH + "SELECT id FROM vertices WHERE id = 'nation/7'")
register("select_edges", lambda spark, d: select_edges(the_graph(spark, d).edges, predicate="in_region", object="region/2"), WITH + "SELECT * FROM edges WHERE predicate_id = 'in_region' AND object_id = 'region/2'")
register("builtin_graph_schema", lambda spark, d: conjunction.run_query(the_graph(spark, d).catalog([s.PredicateSchema("NODE", "1", "node", "1", "node"), s.PredicateSchema("EDGE", "1", "node", "1", "node")]), text.parse_query('NODE(n), EDGE(n, "region_label", l)')), "SELECT concat('region/', r_regionkey) AS n, r_name AS l FROM region")

# Filters and projection
register("const_filter", ask('edge(nation, "in_region", "region/1")', True), "SELECT DISTINCT concat('nation/', n_nationkey) AS nation FROM nation WHERE n_regionkey = 1")
register("repeated_var_filter", ask("nation(k, _, k)"), "SELECT DISTINCT n_nationkey AS k FROM nation WHERE n_nationkey = n_regionkey")
register("wildcard", ask('edge(_, "in_nation", nation), edge(_, "based_in", nation)'), "SELECT DISTINCT concat('nation/', c_nationkey) AS nation FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
register("boolean_query", ask('edge("nation/1", "in_region", _)'), "SELECT 1 AS \"?column?\" FROM nation WHERE n_nationkey = 1")
register("boolean_query_false", ask('edge("nation/1", "in_region", "region/none")'), "SELECT 1 AS \"?column?\" WHERE false")
register("case_sensitive_variables", lambda spark, d: ask('edge(X, "in_region", x)')(spark, d).toDF("upper_x", "lower_x"), "SELECT DISTINCT concat('nation/', n_nationkey) AS upper_x, concat('region/', n_regionkey) AS lower_x FROM nation")
for _op, _name in (("=", "eq"), ("!=", "ne"), ("<", "lt"), ("<=", "le"), (">", "gt"), (">=", "ge")):
    register(f"comparison_{_name}", ask(f"nation(k, name, r), k {_op} 7"), f"SELECT DISTINCT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation WHERE n_nationkey {_op} 7")
register("comparison_assignment", ask('region(k, name), tag = "checked", other = k'), "SELECT r_regionkey AS k, r_name AS name, 'checked' AS tag, r_regionkey AS other FROM region")
_nation = logical.Scan("nation", 3, "n")
_key, _region, _label = Col("n.n_nationkey"), Col("n.n_regionkey"), Col("n.n_name")
register("bool_and_or_not", plan(logical.Project(logical.Filter(_nation, (Op("or", (Op("and", (Op(">", (_key, Lit(3))), Op("<", (_key, Lit(9))))), Op("not", (Op("!=", (_region, Lit(4))),)))),)), (("k", _key), ("r", _region)))), "SELECT n_nationkey AS k, n_regionkey AS r FROM nation WHERE (n_nationkey > 3 AND n_nationkey < 9) OR NOT (n_regionkey != 4)")
register("parameter_reference", plan(logical.Project(logical.Filter(_nation, (Op("=", (_label, Param(1))),)), (("k", _key), ("given", Param(0)))), ("told", "NATION_6")), "SELECT n_nationkey AS k, 'told' AS given FROM nation WHERE n_name = 'NATION_6'")
register("function_expression", plan(logical.Project(_nation, (("name", logical.Apply("lower", (_label,))), ("size", logical.Apply("length", (_label,), "int8"))))), "SELECT lower(n_name) AS name, CAST(length(n_name) AS BIGINT) AS size FROM nation")


def _call(spark, sf_dir):
    body = text.parse_query("region(k, name)").body
    return conjunction.run_query(catalog(spark, sf_dir), s.Query((*body, s.Call("lower", (s.Variable("name"),), "text", s.Variable("low")), s.Call("starts_with", (s.Variable("name"), s.Constant("A")), "bool"))))


register("function_call_literal", _call, "SELECT r_regionkey AS k, r_name AS name, lower(r_name) AS low FROM region WHERE r_name LIKE 'A%'")
def _builtin(spark, sf_dir):
    found = catalog(spark, sf_dir)
    found.builtin("lower", 2, returns="text")
    found.builtin("startsWith", 2, "starts_with", test=True)
    return conjunction.run_query(found, text.parse_query('nation(k, name, _), lower(name, low), startsWith(low, "nation_1")'))


register("builtin_predicate", _builtin, r"SELECT n_nationkey AS k, n_name AS name, lower(n_name) AS low FROM nation WHERE lower(n_name) LIKE 'nation\_1%' ESCAPE '\'")
register("prefix_match", lambda spark, d: the_graph(spark, d).vertices.where(F.startswith("id", F.lit("nation/"))).distinct(), WITH + "SELECT id FROM vertices WHERE id LIKE 'nation/%'")
register("query_project_limit_offset", lambda spark, d: conjunction.run_query(catalog(spark, d), s.Query(text.parse_query("nation(k, name, r)").body, ("r",), 2, 1)), "SELECT DISTINCT n_regionkey AS r FROM nation ORDER BY r LIMIT 2 OFFSET 1")

# Joins
register("equi_join_2", ask('edge(c, "in_nation", n), edge(n, "in_region", r)'), "SELECT DISTINCT concat('customer/', c_custkey) AS c, concat('nation/', n_nationkey) AS n, concat('region/', n_regionkey) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey")
register("multi_key_join", ask("lineitem(o, p, su, line, _, _, _, _, f, st, _), lineitem(o, p2, su, line2, _, _, _, _, f, st, _), line < line2"), "SELECT DISTINCT a.l_orderkey AS o, a.l_partkey AS p, a.l_suppkey AS su, a.l_linenumber AS line, a.l_returnflag AS f, a.l_linestatus AS st, b.l_partkey AS p2, b.l_linenumber AS line2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus AND a.l_linenumber < b.l_linenumber")
register("cross_join", ask("region(a, x), region(b, y)"), "SELECT a.r_regionkey AS a, a.r_name AS x, b.r_regionkey AS b, b.r_name AS y FROM region a, region b")
register("theta_join", plan(logical.Project(logical.Join(logical.Scan("region", 2, "a"), logical.Scan("region", 2, "b"), (Op("<", (Col("a.r_regionkey"), Col("b.r_regionkey"))),)), (("low", Col("a.r_name")), ("high", Col("b.r_name"))))), "SELECT a.r_name AS low, b.r_name AS high FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
_customers, _orders = logical.Scan("customer", 5, "c"), logical.Scan("orders", 6, "o")
_same = (Op("=", (Col("c.c_custkey"), Col("o.o_custkey"))),)
register("left_join", plan(logical.Project(logical.Join(_customers, _orders, _same, "left"), (("c", Col("c.c_custkey")), ("o", Col("o.o_orderkey"))))), "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
register("semi_join", plan(logical.Project(logical.Join(_customers, _orders, _same, "semi"), (("c", Col("c.c_custkey")),))), "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
register("anti_join", plan(logical.Project(logical.Join(_customers, logical.Filter(_orders, (Op("=", (Col("o.o_orderstatus"), Lit("P"))),)), _same, "anti"), (("c", Col("c.c_custkey")),))), "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
register("anti_join_negation", ask('customer(c, name, _, _, _), not orders(_, c, "P", _, _, _)'), "SELECT DISTINCT c_custkey AS c, c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
register("self_join_edges", ask('edge(a, "in_region", r), edge(b, "in_region", r), edge(a, "nation_label", "NATION_6")'), "SELECT DISTINCT concat('nation/', x.n_nationkey) AS a, concat('region/', x.n_regionkey) AS r, concat('nation/', y.n_nationkey) AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey WHERE x.n_name = 'NATION_6'")
FLAGSHIP = 'edge(o, "placed_by", c), edge(o, "status", "O"), edge(c, "in_nation", n), edge(c, "segment", seg), edge(n, "nation_label", nation), edge(n, "in_region", r), edge(r, "region_label", region)'
register("star_join_wide", ask(FLAGSHIP), "SELECT DISTINCT concat('order/', o_orderkey) AS o, concat('customer/', c_custkey) AS c, concat('nation/', n_nationkey) AS n, c_mktsegment AS seg, n_name AS nation, concat('region/', r_regionkey) AS r, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'O'")
_WIDE = ", ".join(f'edge(n{i}, "in_region", r), edge(n{i}, "nation_label", "{name}")' for i, name in enumerate(["NATION_6", "NATION_11", "NATION_1", "NATION_16", "NATION_21", "NATION_6", "NATION_11", "NATION_1"])) + ', edge(r, "region_label", region)'
register("wide_conjunction_17", ask(_WIDE), "SELECT " + ", ".join(f"concat('nation/', n{i}.n_nationkey) AS n{i}" for i in range(8)) + ", concat('region/', r_regionkey) AS r, r_name AS region FROM region " + " ".join(f"JOIN nation n{i} ON n{i}.n_regionkey = r_regionkey AND n{i}.n_name = '{name}'" for i, name in enumerate(["NATION_6", "NATION_11", "NATION_1", "NATION_16", "NATION_21", "NATION_6", "NATION_11", "NATION_1"])))

# Compounds
PROFILE = s.CompoundSchema("profile", (s.Field("in_nation", "1", "node"), s.Field("segment", "?", "text")))
_hub = lambda schema: F.startswith("id", F.lit("customer/"))


def _compound(schema):
    return lambda spark, d: conjunction.run_query(the_graph(spark, d).catalog([schema], hub_filter=_hub), s.Query((s.Atom(schema.name, tuple(s.Variable(f"f{i}") for i in range(len(schema.fields)))),)))


register("compound_view_optional", _compound(PROFILE), "SELECT DISTINCT concat('nation/', c_nationkey) AS f0, c_mktsegment AS f1 FROM customer")
register("compound_view_required", _compound(s.CompoundSchema("settled", (s.Field("in_nation", "+", "node"), s.Field("segment", "1", "text")))), "SELECT DISTINCT concat('nation/', c_nationkey) AS f0, c_mktsegment AS f1 FROM customer")
register("compound_view_missing_field", _compound(s.CompoundSchema("placed", (s.Field("in_nation", "1", "node"), s.Field("placed_by", "1", "node")))), "SELECT 'a' AS f0, 'b' AS f1 WHERE false")
REVIEW = s.CompoundSchema("Review", (s.Field("item", "1", "node"), s.Field("by", "1", "node"), s.Field("note", "?", "text")))


def _asserted(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(F.concat(F.lit("part/"), "l_partkey").alias("item"), F.concat(F.lit("a,b:"), F.col("l_orderkey").cast("string")).alias("by"), F.when(F.col("l_returnflag") == "R", F.lit("returned")).otherwise("kept").alias("note"))


_REVIEWS = "reviews AS (SELECT concat('part/', l_partkey) AS item, concat('a,b:', l_orderkey) AS by_, concat('a%2Cb%3A', l_orderkey) AS coded, CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'kept' END AS note FROM lineitem), hubs AS (SELECT DISTINCT *, concat('Review:by=', coded, ',item=', item, ',note=', note) AS id FROM reviews)"
register("compound_identity", lambda spark, d: graph.assert_compounds(_asserted(spark, d), REVIEW)[0], f"WITH {_REVIEWS} SELECT DISTINCT id FROM hubs")
register("compound_assertion_rows", lambda spark, d: graph.assert_compounds(_asserted(spark, d), REVIEW)[1], f"WITH {_REVIEWS} SELECT DISTINCT id AS subject_id, 'item' AS predicate_id, item AS object_id FROM hubs UNION SELECT id, 'by', by_ FROM hubs UNION SELECT id, 'note', note FROM hubs")


def _roundtrip(spark, sf_dir):
    made = graph.Graph(*graph.assert_compounds(_asserted(spark, sf_dir), REVIEW))
    return conjunction.run_query(made.catalog([REVIEW]), text.parse_query('Review(item, by, "returned")'))


register("compound_roundtrip", _roundtrip, f"WITH {_REVIEWS} SELECT DISTINCT item, by_ AS by FROM hubs WHERE note = 'returned'")

# Changes
NEW = [s.Vertex("nation/1"), s.Vertex("nation/new"), s.Edge("nation/new", "in_region", "region/1"), s.Edge("nation/1", "in_region", "region/1"), s.Edge("nation/new", "in_region", "region/1")]
register("insert_facts_idempotent", lambda spark, d: the_graph(spark, d).insert(NEW).insert(NEW).edges, WITH + "SELECT * FROM edges UNION SELECT 'nation/new', 'in_region', 'region/1'")
register("insert_vertices_idempotent", lambda spark, d: the_graph(spark, d).insert(NEW).vertices, WITH + "SELECT id FROM vertices UNION SELECT 'nation/new'")
register("delete_facts_no_cascade", lambda spark, d: the_graph(spark, d).delete([s.Vertex("nation/1"), s.Edge("nation/2", "in_region", "region/1"), s.Edge("nation/2", "in_region", "none")]).edges, WITH + "SELECT * FROM edges EXCEPT SELECT 'nation/2', 'in_region', 'region/1'")
register("delete_vertices", lambda spark, d: the_graph(spark, d).delete([s.Vertex("nation/1")]).vertices, WITH + "SELECT id FROM vertices WHERE id != 'nation/1'")
register("vertex_closure_on_load", lambda spark, d: graph.Graph(spark.createDataFrame([("extra",)], "id string"), edge_rows(spark, d)).close_vertices().vertices, WITH + "SELECT subject_id AS id FROM edges UNION SELECT object_id FROM edges UNION SELECT 'extra'")
#: More facts than one statement's parameters hold, many of them known already.
MANY = [s.Edge(f"customer/{i % 100}", "tagged", f"tag/{i}") for i in range(45_000)] + [s.Edge("nation/1", "in_region", "region/1")] * 3
register("apply_batches", lambda spark, d: the_graph(spark, d).apply(MANY).edges, WITH + "SELECT * FROM edges UNION SELECT concat('customer/', i % 100), 'tagged', concat('tag/', i) FROM range(45000) t(i) UNION SELECT 'nation/1', 'in_region', 'region/1'")
register("insert_many_times", lambda spark, d: reduce(lambda g, i: g.insert([s.Edge("nation/new", "in_region", f"region/{i % 6}")]), range(12), the_graph(spark, d)).edges, WITH + "SELECT * FROM edges UNION SELECT 'nation/new', 'in_region', concat('region/', i) FROM range(6) t(i)")
#: Committed files, as they are read: declarations, and facts of which one is repeated and one is known.
COMMITTED = [
    migrations.Migration("20260101.0001.schema.dl", Path("20260101.0001.schema.dl"), None, "", 'DefPred("in_region", "1", "node", "*", "node").\nDefPred("nation_label", "1", "node", "1", "text").'),
    migrations.Migration("20260102.0001.facts.dl", Path("20260102.0001.facts.dl"), "", "", 'Edge("nation/new", "in_region", "region/1").\nEdge("nation/new", "nation_label", "NEW").\nEdge("nation/new", "in_region", "region/1").\nEdge("nation/1", "in_region", "region/1").'),
]
_COMMITTED_SQL = "SELECT 'nation/new' AS subject_id, 'in_region' AS predicate_id, 'region/1' AS object_id UNION SELECT 'nation/new', 'nation_label', 'NEW' UNION SELECT 'nation/1', 'in_region', 'region/1'"
register("migration_apply", lambda spark, d: migrations.apply(the_graph(spark, d), COMMITTED).graph.edges, WITH + f"SELECT * FROM edges UNION {_COMMITTED_SQL}")
register("migration_apply_vertices", lambda spark, d: migrations.apply(the_graph(spark, d), COMMITTED).graph.vertices, WITH + f"SELECT id FROM vertices UNION SELECT subject_id FROM ({_COMMITTED_SQL}) UNION SELECT object_id FROM ({_COMMITTED_SQL})")


def _ledger(spark, sf_dir):
    """Names that are recorded twice keep their first time."""
    first = migrations.apply(the_graph(spark, sf_dir), COMMITTED[:1], now=datetime(2026, 1, 1, tzinfo=UTC))
    then = migrations.apply(first.graph, COMMITTED, first.ledger, now=datetime(2026, 1, 2, tzinfo=UTC))
    return then.ledger.select("migration_file_name", F.dayofmonth("applied_at").alias("day"))


register("migration_ledger", _ledger, "SELECT * FROM (VALUES ('20260101.0001.schema.dl', CAST(1 AS INTEGER)), ('20260102.0001.facts.dl', CAST(2 AS INTEGER))) t(migration_file_name, day)")
register("empty_graph_insert", lambda spark, d: graph.Graph.empty(spark).insert_rows(edges=edge_rows(spark, d)).edges, WITH + "SELECT * FROM edges")
register("what_if_overlay", lambda spark, d: conjunction.run_query(the_graph(spark, d).overlay([s.Edge("nation/new", "in_region", "region/0")]).catalog(SCHEMAS), text.parse_query('in_region(n, "region/0")')), "SELECT concat('nation/', n_nationkey) AS n FROM nation WHERE n_regionkey = 0 UNION SELECT 'nation/new'")

# External predicates


def _pushdown(spark, sf_dir):
    found = catalog(spark, sf_dir)
    found.external("balance", ("name", "amount"), external.Resolver("sql_pushdown", "bank", ("name",)), found.table("accounts", load(spark, sf_dir, "supplier"), ["s_name", "s_acctbal"]))
    found.relations["balance", 2] = type(found.relations["balance", 2])("balance", ("s_name", "s_acctbal"), found.relations["accounts", 2].read, "table", resolver=found.relations["balance", 2].resolver)
    return external.Prepared(found, text.parse_query("supplier(k, name, _, _), balance(name, amount), amount > 5000")).run()


register("pushdown_external", _pushdown, "SELECT DISTINCT s_suppkey AS k, s_name AS name, s_acctbal AS amount FROM supplier WHERE s_acctbal > 5000")


def _rate(request):
    return [{"n": k["n"], "rate": len(k["n"])} for k in request.keys]


def _materialize(spark, sf_dir):
    found = catalog(spark, sf_dir)
    found.external("rate", ("n", "rate"), external.Resolver("materialize_before_sql", "rates", ("n",), materialize_rows=_rate, column_types={"rate": "int8"}))
    return external.Prepared(found, text.parse_query('edge(c, "in_nation", n), edge(n, "nation_label", "NATION_6"), rate(n, rate)')).run()


register("materialize_external", _materialize, "SELECT DISTINCT concat('customer/', c_custkey) AS c, concat('nation/', n_nationkey) AS n, CAST(length(concat('nation/', n_nationkey)) AS BIGINT) AS rate FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_6'")


def _batch_rate(keys: pa.Table) -> pa.Table:
    return pa.table({"c": keys["c"], "size": pc.cast(pc.utf8_length(keys["c"]), pa.int64())})


def _materialize_batches(spark, sf_dir):
    found = catalog(spark, sf_dir)
    found.external("size", ("c", "size"), external.Resolver("materialize_before_sql", "sizes", ("c",), batch_rows=_batch_rate, column_types={"size": "int8"}))
    return external.Prepared(found, text.parse_query('edge(o, "placed_by", c), size(c, size)')).run()


register("materialize_external_batches", _materialize_batches, "SELECT DISTINCT concat('order/', o_orderkey) AS o, concat('customer/', o_custkey) AS c, CAST(length(concat('customer/', o_custkey)) AS BIGINT) AS size FROM orders")


def _hydrate(spark, sf_dir):
    found = catalog(spark, sf_dir)
    found.external("profile", ("r", "text"), external.Resolver("post_query_hydrate", "profiles", ("r",), hydrate_rows=lambda q: [{"r": k["r"], "text": f"profile:{k['r']}"} for k in q.keys], hydrated_field="story"))
    return external.Prepared(found, text.parse_query('edge(n, "in_region", r), profile(r, _)')).run()


register("hydrate_external", _hydrate, "SELECT DISTINCT concat('nation/', n_nationkey) AS n, concat('region/', n_regionkey) AS r, concat('profile:region/', n_regionkey) AS story FROM nation")

# Aggregates, order, sets
for _fn, _sql in (("count", "count(o_totalprice)"), ("count-distinct", "count(DISTINCT o_totalprice)"), ("sum", "round(sum(o_totalprice), 2)"), ("min", "min(o_totalprice)"), ("max", "max(o_totalprice)"), ("avg", "round(avg(o_totalprice), 4)")):
    _value = logical.Aggregate(_orders, ("o.o_orderstatus",), (("v", _fn, Col("o.o_totalprice")),))
    _shown = logical.Apply("round", (Col("v"), Lit(2 if _fn == "sum" else 4))) if _fn in ("sum", "avg") else Col("v")
    register(f"aggregate_{_fn.replace('-', '_')}", plan(logical.Project(_value, (("status", Col("o.o_orderstatus")), ("v", _shown)))), f"SELECT o_orderstatus AS status, {_sql} AS v FROM orders GROUP BY o_orderstatus")
register("aggregate_global", plan(logical.Aggregate(_orders, (), (("n", "count", None),))), "SELECT count(*) AS n FROM orders")
register("aggregate_named_function", plan(logical.Aggregate(logical.Project(_orders, (("status", Col("o.o_orderstatus")), ("f", Op("=", (Col("o.o_orderpriority"), Lit("1-URGENT")))))), ("status",), (("any_urgent", "bool_or", Col("f")),))), "SELECT o_orderstatus AS status, bool_or(o_orderpriority = '1-URGENT') AS any_urgent FROM orders GROUP BY o_orderstatus")
register("rule_aggregate", program("spent(n, count(o), max(o)) :- orders(o, c, _, _, _, _), customer(c, _, n, _, _).", "spent", ["n", "orders", "last"]), "SELECT c_nationkey AS n, count(o_orderkey) AS orders, max(o_orderkey) AS last FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey")
register("distinct_on_keys", plan(logical.Distinct(logical.Project(_nation, (("r", _region),)), ("r",))), "SELECT DISTINCT n_regionkey AS r FROM nation")
register("sort_limit_offset", plan(logical.Limit(logical.Sort(logical.Project(_customers, (("k", Col("c.c_custkey")), ("b", Col("c.c_acctbal")))), ((Col("b"), "desc", "last"), (Col("k"), "asc", "last"))), 10, 5)), "SELECT c_custkey AS k, c_acctbal AS b FROM customer ORDER BY b DESC NULLS LAST, k ASC NULLS LAST LIMIT 10 OFFSET 5")
_names = (logical.Project(logical.Scan("region", 2, "r"), (("name", Col("r.r_name")),)), logical.Project(_nation, (("name", _label),)), logical.Project(logical.Scan("region", 2, "r"), (("name", Col("r.r_name")),)))
register("union_all", plan(logical.Union(_names)), "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region")
register("union_distinct", plan(logical.Union(_names, True)), "SELECT r_name AS name FROM region UNION SELECT n_name FROM nation")
register("materialize_shared", plan(logical.Union((logical.Materialize(_names[0], "temp", "shared-subplan", "names"), logical.Materialize(_names[0], "temp", "shared-subplan", "names")))), "SELECT r_name AS name FROM region UNION ALL SELECT r_name FROM region")

# Rules and recursion
register("rule_union", program("place(n) :- nation(_, n, _).\nplace(n) :- region(_, n).", "place", ["name"]), "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
register("rule_chain", program('home(c, r) :- in_nation(c, n), in_region(n, r).\nshipped(o, r) :- placed_by(o, c), home(c, r).', "shipped", ["o", "r"]), "SELECT DISTINCT concat('order/', o_orderkey) AS o, concat('region/', n_regionkey) AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
_STEP = "step(a, b) :- placed_by(a, b).\nstep(a, b) :- in_nation(a, b).\nstep(a, b) :- in_region(a, b).\n"
_STEPS_SQL = "step AS (SELECT subject_id AS a, object_id AS b FROM edges WHERE predicate_id IN ('placed_by', 'in_nation', 'in_region'))"
register("recursive_reachability", program(_STEP + "reach(a, b) :- step(a, b).\nreach(a, c) :- reach(a, b), step(b, c).", "reach", ["a", "b"]), WITH_RECURSIVE + _STEPS_SQL + ", reach(a, b) AS (SELECT a, b FROM step UNION SELECT r.a, s.b FROM reach r JOIN step s ON r.b = s.a) SELECT a, b FROM reach")
register("recursive_cycle", program("hop(a, b) :- supplier(a, _, n, _), supplier(b, _, n, _), a < b.\nnear(a, b) :- hop(a, b).\nnear(a, b) :- hop(b, a).\nlinked(a, b) :- near(a, b).\nlinked(a, c) :- linked(a, b), linked(b, c).", "linked", ["a", "b"]), "WITH RECURSIVE near AS (SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey != y.s_suppkey), linked(a, b) AS (SELECT a, b FROM near UNION SELECT l.a, n.b FROM linked l JOIN near n ON l.b = n.a) SELECT a, b FROM linked")
register("mutual_recursion", program(_STEP + 'odd(x) :- step(x, "region/1").\nodd(x) :- step(x, y), even(y).\neven(x) :- step(x, y), odd(y).', "odd", ["x"]), WITH_RECURSIVE + _STEPS_SQL + ", walk(x, n) AS (SELECT a, 1 FROM step WHERE b = 'region/1' UNION SELECT s.a, w.n + 1 FROM walk w JOIN step s ON s.b = w.x) SELECT DISTINCT x FROM walk WHERE n % 2 = 1")
register("stratified_negation", program('served(n) :- based_in(_, n).\nidle(n, l) :- nation_label(n, l), not served(n).\nopen(r) :- in_region(n, r), not idle(n, _).', "open", ["r"]), "SELECT DISTINCT concat('region/', n_regionkey) AS r FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")


def _tree(spark, sf_dir):
    up = edge_rows(spark, sf_dir, ("in_region", "in_nation", "placed_by"))
    return up.select(F.col("object_id").alias("subject_id"), F.lit("holds").alias("predicate_id"), F.col("subject_id").alias("object_id"))


_PATHS = WITH_RECURSIVE + "walk(node) AS (SELECT subject_id FROM edges WHERE object_id = 'region/1' AND predicate_id = 'in_region' UNION ALL SELECT e.subject_id FROM walk w JOIN edges e ON e.object_id = w.node AND e.predicate_id IN ('in_region', 'in_nation', 'placed_by')) "
register("recursive_path_count", lambda spark, d: closure.path_count(_tree(spark, d), "region/1", "holds"), _PATHS + "SELECT count(*) AS count FROM walk")
register("recursive_path_count_distributed", lambda spark, d: closure.path_count(_tree(spark, d), "region/1", "holds", small=0), _PATHS + "SELECT count(*) AS count FROM walk")
register("recursive_path_count_sql", lambda spark, d: closure.path_count_sql(_tree(spark, d), "region/1", "holds"), _PATHS + "SELECT count(*) AS count FROM walk")
register("closure_reachable_root", lambda spark, d: closure.reachable(_tree(spark, d), "holds", "region/2"), _PATHS.replace("region/1", "region/2") + "SELECT DISTINCT 'region/2' AS source, node AS target FROM walk")
register("closure_reachable_all", lambda spark, d: closure.reachable(_tree(spark, d), "holds"), WITH_RECURSIVE + "tree AS (SELECT object_id AS a, subject_id AS b FROM edges WHERE predicate_id IN ('in_region', 'in_nation', 'placed_by')), reach(source, target) AS (SELECT a, b FROM tree UNION SELECT r.source, t.b FROM reach r JOIN tree t ON t.a = r.target) SELECT source, target FROM reach")

# Summaries and evidence
register("node_summary", lambda spark, d: graph.node_summary(edge_rows(spark, d, ("nation_label", "in_region", "in_nation", "segment")), "nation_label", ("in_region", "segment")).select("id", "label", F.array_join("classes", "|").alias("classes")), "SELECT concat('nation/', n_nationkey) AS id, n_name AS label, concat('region/', n_regionkey) AS classes FROM nation UNION ALL SELECT concat('customer/', c_custkey), NULL, string_agg(DISTINCT c_mktsegment, '|') FROM customer GROUP BY c_custkey")
SOURCES = [
    retrieval.Source('edge(n, "in_region", r)', {"evidence_id": "ev/+?n/last", "kind": "place", "subject": "?n", "predicate": "in_region", "object": "?r"}),
    retrieval.Source('edge(n, "nation_label", l), edge(n, "in_region", "region/1")', {"evidence_id": "ev/+?n/last", "kind": "label", "subject": "?n", "predicate": "label", "object": "?l"}),
]
_EVIDENCE = "evidence AS (SELECT concat('ev/', n_nationkey) AS evidence_id, CASE WHEN n_regionkey = 1 THEN 'label' ELSE 'place' END AS kind, concat('nation/', n_nationkey) AS subject, CASE WHEN n_regionkey = 1 THEN 'label' ELSE 'in_region' END AS predicate, CASE WHEN n_regionkey = 1 THEN n_name ELSE concat('region/', n_regionkey) END AS object FROM nation)"
register("evidence_retrieval", lambda spark, d: retrieval.retrieve(catalog(spark, d), SOURCES, ("label", "place")), f"WITH {_EVIDENCE} SELECT * FROM evidence")
register("evidence_required", lambda spark, d: retrieval.missing_evidence(retrieval.retrieve(catalog(spark, d), SOURCES), ["ev/1", "ev/99"]), f"WITH {_EVIDENCE} SELECT id FROM (VALUES ('ev/1'), ('ev/99')) t(id) WHERE id NOT IN (SELECT evidence_id FROM evidence)")
register("evidence_entities", lambda spark, d: retrieval.missing_entities(retrieval.retrieve(catalog(spark, d), SOURCES), ["nation/1", "region/0", "region/9"]), "SELECT 'region/9' AS id")
register("evidence_citations", lambda spark, d: retrieval.check_citations(retrieval.retrieve(catalog(spark, d), SOURCES).where("kind = 'label'"), ["ev/1", "ev/77"], ["ev/2"]), f"WITH {_EVIDENCE}, have AS (SELECT evidence_id AS id FROM evidence WHERE kind = 'label'), named AS (SELECT * FROM (VALUES ('ev/1'), ('ev/77')) t(id)) SELECT id, 'hallucinated' AS problem FROM named WHERE id NOT IN (SELECT id FROM have) UNION ALL SELECT id, 'uncited' FROM have WHERE id NOT IN (SELECT id FROM named) UNION ALL SELECT 'ev/2', 'missing'")
