import random

import pytest
from pyspark.sql import functions as F

from loomlog import storage
from loomlog.errors import LoomError
from loomlog.functions import values
from loomlog.operators import closure, graph, retrieval
from loomlog.operators.graph import Graph
from loomlog.plans import conjunction, logical, rules
from loomlog.plans import syntax as s
from loomlog.sources import text
from loomlog.sources.catalog import Catalog
from tests.conftest import rows

ALICE = [s.Vertex("vertex/alice"), s.Vertex("vertex/bob"), s.Edge("vertex/alice", "graph/likes", "vertex/bob")]


def ask(catalog, source, **options):
    return conjunction.run_query(catalog, text.parse_query(source), **options)


def code(call, *args, **named):
    with pytest.raises(LoomError) as caught:
        call(*args, **named)
    return caught.value.code


@pytest.fixture(scope="module")
def likes(spark):
    return Graph.empty(spark).insert(ALICE)


def test_likes_query_insert_and_delete(likes):
    found = ask(likes.catalog(), 'vertex(person), edge(person, "graph/likes", "vertex/bob")')
    assert [r.asDict() for r in found.collect()] == [{"person": "vertex/alice"}]
    assert rows(likes.insert(ALICE).edges) == rows(likes.edges)
    gone = likes.delete([s.Edge("vertex/alice", "graph/likes", "vertex/bob")])
    assert gone.edges.isEmpty() and gone.vertices.count() == 2
    assert likes.delete([s.Vertex("vertex/alice")]).edges.count() == 1


def test_errors_of_queries(spark, likes):
    catalog = likes.catalog()
    assert code(conjunction.run_query, catalog, s.Query(())) == "query.empty-body"
    assert code(ask, catalog, "vertex(x), x != 3", strict=True) == "query.unsupported-literal"
    assert code(ask, catalog, "vertex()") == "query.invalid-atom-arity"
    assert code(ask, catalog, "vertex@(id=x)") == "query.unsupported-term"
    assert code(ask, catalog, "vertex(3)", strict=True) == "query.invalid-term"
    assert code(ask, catalog, "nothing(x)") == "UNSUPPORTED_GRAPH_PREDICATE"
    assert code(ask, catalog, "vertex(x), y < 3") == "query.unsafe-variable"
    assert code(ask, catalog, 'vertex(x), not edge(x, "p", z)') == "query.unsafe-variable"
    assert code(logical.run, object(), logical.Context(catalog)) == "UNSUPPORTED_LOGICAL_PLAN_NODE"
    assert code(logical.expression, logical.Op("not", ()), logical.Context(catalog)) == "UNSUPPORTED_LOGICAL_PLAN_NODE"
    assert code(graph.check_facts, [], "insert") == "insert.invalid-fact"
    assert code(graph.check_facts, [s.Vertex(" ")], "delete") == "delete.invalid-fact"
    assert code(closure.path_count, likes.edges, " ", "p") == "operation.invalid-shape"
    assert code(Catalog(spark).declare, s.PredicateSchema("p", "1", "money", "1", "text")) == "schema.unsupported-scalar-domain"


def test_boolean_query(likes):
    assert [tuple(r) for r in ask(likes.catalog(), 'vertex("vertex/bob")').collect()] == [(1,)]
    assert ask(likes.catalog(), 'vertex("vertex/eve")').isEmpty()


def test_nulls_never_match(spark):
    catalog = Catalog(spark)
    catalog.table("t", spark.createDataFrame([(1, None), (2, None), (3, "a")], "k int, v string"))
    assert rows(ask(catalog, "t(a, v), t(b, v)")) == [(3, "a", 3)]
    assert ask(catalog, "t(k, null)").isEmpty()
    assert ask(catalog, "t(_, v)").count() == 2


def test_written_order_gives_the_same_rows(spark):
    catalog = Catalog(spark)
    catalog.table("t", spark.range(20).selectExpr("id AS a", "id % 5 AS b"))
    query = text.parse_query("t(a, b), t(c, d), t(b, d), c < a")
    assert rows(conjunction.run_query(catalog, query, reorder=False)) == rows(conjunction.run_query(catalog, query))


def test_builtin_predicates(spark):
    catalog = Catalog(spark)
    catalog.table("t", spark.createDataFrame([("Ab",), ("cD",)], "v string"))
    catalog.builtin("lower", 2, returns="text")
    assert rows(ask(catalog, "t(v), lower(v, x)")) == [("Ab", "ab"), ("cD", "cd")]
    assert rows(ask(catalog, 't(v), lower(v, "cd")')) == [("cD",)]
    assert ask(catalog, "t(v), lower(v, _)").count() == 2
    assert rows(ask(catalog, "t(v), t(w), lower(v, x), lower(w, x), v = w")) == [("Ab", "Ab", "ab"), ("cD", "cD", "cd")]


def test_batches_keep_to_the_parameter_limit():
    edges = [s.Edge("a", "p", str(i)) for i in range(20_001)]
    assert [len(b) for b in graph.batches(edges)] == [20_000, 1]


def test_many_batches_and_insertions_meet_the_old_rows_once(spark, likes, monkeypatch):
    monkeypatch.setattr(graph, "batches", lambda facts: ([f] for f in facts))
    facts = [s.Edge("a", "p", str(i % 40)) for i in range(50)] + [s.Vertex("vertex/bob")]
    after = likes.apply(facts)
    assert after.edges.count() == 41 and after.vertices.count() == likes.vertices.count()
    chained = likes
    for i in range(12):
        chained = chained.insert([s.Edge("a", "p", str(i % 5))])
    assert chained.edges.count() == 6
    for made in (after, chained):
        plan = made.edges._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("Aggregate") == 1


def test_values_of_different_types(spark):
    catalog = Catalog(spark)
    catalog.table("t", spark.createDataFrame([(1, "1", 0.5), (2, "x", 1.0), (None, None, None)], "k long, s string, d double"))
    assert rows(ask(catalog, 't("1", s, _)')) == [("1",)]
    assert rows(ask(catalog, 't("x", s, _)')) == rows(ask(catalog, 't(k, _, _), k < "x"')) == []
    assert rows(ask(catalog, "t(k, k, _)")) == [(1,)]
    assert rows(ask(catalog, "t(k, _, _), t(_, k, _)")) == [(1,)]
    assert {tuple(r) for r in ask(catalog, "t(k, _, _), not t(_, k, _)").collect()} == {(2,), (None,)}
    assert rows(ask(catalog, "t(k, s, _), k = s")) == [(1, "1")]
    assert rows(ask(catalog, "t(k, s, _), k != s")) == [(2, "x")]
    assert rows(ask(catalog, "t(k, s, _), k <= s")) == [(1, "1")]
    assert rows(ask(catalog, 't(k, _, _), k != "x"')) == [(1,), (2,)]


def test_save_and_load(spark, likes, tmp_path):
    path = f"file://{tmp_path}/graph"
    likes.save(path)
    more = Graph.load(spark, path).insert([s.Edge("vertex/bob", "graph/likes", "vertex/alice")])
    more.save(path)
    again = Graph.load(spark, path)
    assert again.edges.count() == 2 and again.vertices.count() == 2
    plan = again.edges.where("predicate_id = 'graph/likes'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(predicate_id" in plan


# Compounds

SCHEMA = s.CompoundSchema("Indication", (s.Field("clinical/medication", "1", "node"), s.Field("clinical/code", "?", "text")))


def lower(source, schema=SCHEMA):
    return graph.lower_compound(text.parse_program(source).statements[0], schema)


def test_identity_golden():
    facts = lower('Indication@(cid=c, clinical/medication="medication/metformin", clinical/code="6809").')
    assert facts[0] == s.Vertex("Indication:clinical/code=6809,clinical/medication=medication/metformin")
    mapping = s.CompoundSchema("ExternalMapping", (s.Field("mapping/source", "1", "text"), s.Field("mapping/code", "1", "text")))
    assert values.identity(mapping, {"mapping/source": "rxnorm:2026", "mapping/code": "alpha,beta"}) == "ExternalMapping:mapping/code=alpha%2Cbeta,mapping/source=rxnorm%3A2026"


def test_identity_column_equals_identity(spark):
    odd = ["a:b", "x,y", "plain", "é:ü", "a b:c+d*~!'()", "50%", ":%2C", ""]
    made = spark.createDataFrame([(x,) for x in odd], "v string").select(values.identity_column(s.CompoundSchema("T", (s.Field("f", "1", "text"),)), {"f": F.col("v")}).alias("id"))
    assert [r.id for r in made.collect()] == [values.identity(s.CompoundSchema("T", (s.Field("f", "1", "text"),)), {"f": x}) for x in odd]


def test_compound_errors():
    assert code(lower, 'Other@(cid="x").') == "compound-assertion.schema-mismatch"
    assert code(lower, 'Indication@("x").') == "compound-assertion.invalid-term"
    assert code(lower, 'Indication@(cid="x", cid="y").') == "compound-assertion.duplicate-field"
    assert code(lower, 'Indication@(clinical/code="1").') == "compound-assertion.missing-cid"
    assert code(lower, "Indication@(cid=_).") == "compound-assertion.invalid-cid"
    assert code(lower, 'Indication@(cid="x", other="1").') == "compound-assertion.unknown-field"
    assert code(lower, 'Indication@(cid="x", clinical/code=y).') == "compound-assertion.invalid-term"
    assert code(lower, 'Indication@(cid=x, clinical/code="1").') == "compound.missing-field"


def test_compound_view_optional_and_repeated(spark):
    facts = [s.Vertex("Indication:1"), s.Vertex("Indication:2"), s.Vertex("indication/3"), s.Edge("Indication:1", "clinical/medication", "m1"), s.Edge("Indication:2", "clinical/medication", "m2"), s.Edge("Indication:2", "clinical/code", "a"), s.Edge("Indication:2", "clinical/code", "b"), s.Edge("indication/3", "clinical/medication", "m3")]
    catalog = Graph.empty(spark).insert(facts).catalog([SCHEMA])
    assert sorted(rows(ask(catalog, "Indication(m, c)")), key=str) == [("m1", None), ("m2", "a"), ("m2", "b")]


@pytest.mark.parametrize("value, shown", [(True, "true"), (None, "null"), (5.0, "5"), (1.5, "1.5"), (7, "7"), (1e21, "1e+21"), (1e-7, "1e-7"), (0.00001, "0.00001"), ("x", "x")])
def test_scalar_text(value, shown):
    assert values.as_text(value) == shown


# Closures


def tree(spark, depth=7, branch=4):
    sizes = [branch**level for level in range(depth + 1)]
    parts = [(f"vertex/{level}-{n}" if level else "vertex/root", f"vertex/{level + 1}-{n * branch + k}") for level in range(depth) for n in range(sizes[level]) for k in range(branch)]
    return spark.createDataFrame([(a, "graph/reachable", b) for a, b in parts], "subject_id string, predicate_id string, object_id string")


def edges(spark, pairs):
    return spark.createDataFrame([(a, "p", b) for a, b in pairs], "subject_id string, predicate_id string, object_id string")


def test_tree_has_21844_paths(spark):
    made = tree(spark)
    assert closure.path_count(made, "vertex/root", "graph/reachable").first()[0] == 21_844
    assert closure.reachable(made, "graph/reachable", "vertex/root").count() == 21_844


@pytest.mark.parametrize("small", [0, 1000])
def test_diamond_cycle_and_empty_root(spark, small):
    diamond = edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    assert closure.path_count(diamond, "a", "p", small=small).first()[0] == 4
    assert closure.reachable(diamond, "p", "a", small=small).count() == 3
    assert closure.path_count(diamond, "nowhere", "p", small=small).first()[0] == 0
    cycle = edges(spark, [("a", "b"), ("b", "a"), ("c", "c")])
    assert rows(closure.reachable(cycle, "p", "a", small=small)) == [("a", "a"), ("a", "b")]
    with pytest.raises(Exception, match="rules.iteration-limit"):
        closure.path_count(cycle, "a", "p", max_depth=20, small=small).collect()


def test_recursive_sql_counts_more_paths_than_the_row_limit(spark):
    made = edges(spark, [(f"{i}", f"{2 * i + j}") for i in range(1, 64) for j in (0, 1)])
    limit = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(limit, "50")
    try:
        assert closure.path_count_sql(made, "1", "p").first()[0] == 126
        with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT_EXCEEDED"):
            closure.path_count_sql(edges(spark, [("a", "b"), ("b", "a")]), "a", "p", max_depth=5).collect()
    finally:
        spark.conf.unset(limit)


# Rules


def answer(program, pairs):
    """All derived (name, row) by naive iteration in Python."""
    known = {("e", p) for p in pairs}
    while True:
        new = set()
        for rule in program.of(s.Rule):
            found = [{}]
            for literal in rule.body:
                if isinstance(literal, s.Atom):
                    found = [f | b for f in found for n, row in known if n == literal.predicate for b in [dict(zip([t.name for t in literal.terms], row, strict=True))] if all(f.get(k, v) == v for k, v in b.items()) and len({t.name for t in literal.terms}) == len(set(zip([t.name for t in literal.terms], row, strict=True)))]
            for literal in rule.body:
                if isinstance(literal, s.Comparison):
                    found = [f for f in found if f[literal.left.name] != f[literal.right.name]]
            new |= {(rule.head.predicate, tuple(f[t.name] for t in rule.head.terms)) for f in found}
        if new <= known:
            return known
        known |= new


PROGRAMS = [
    "path(x, y) :- e(x, y).\npath(x, z) :- path(x, y), path(y, z).",
    "odd(x, y) :- e(x, y).\nodd(x, z) :- even(x, y), e(y, z).\neven(x, z) :- odd(x, y), e(y, z).",
    "same(x, y) :- e(z, x), e(z, y), x != y.\nsame(x, y) :- e(a, x), same(a, b), e(b, y).",
]


@pytest.mark.parametrize("source", PROGRAMS)
def test_fixpoints_equal_naive_evaluation(spark, source):
    chance = random.Random(source)
    pairs = {(chance.randrange(8), chance.randrange(8)) for _ in range(12)}
    program = text.parse_program(source)
    catalog = Catalog(spark)
    catalog.table("e", spark.createDataFrame(sorted(pairs), "a long, b long"))
    engine = rules.Program(catalog, program).evaluate()
    want = answer(program, pairs)
    for name in {r.head.predicate for r in program.of(s.Rule)}:
        assert rows(engine.rows(name, 2)) == sorted(row for n, row in want if n == name)


SYMMETRIC = "near(x, y) :- e(x, y).\nnear(u, v) :- e(v, u).\nlinked(x, y) :- near(x, y).\n"


@pytest.mark.parametrize("last", ["linked(x, z) :- linked(x, y), linked(y, z).", "linked(x, z) :- near(y, z), linked(x, y).", "linked(x, z) :- linked(x, y), linked(y, z).\nlinked(x, z) :- near(x, y), linked(y, z).", "linked(x, z) :- linked(x, y), e(y, z).", "linked(x, z) :- linked(x, y), linked(y, z).\nnear(x, y) :- e(x, w), e(w, y).", "linked(x, z) :- linked(x, y), linked(z, y)."])
def test_closures_of_symmetric_pairs_equal_naive_evaluation(spark, last):
    chance, program = random.Random(last), text.parse_program(SYMMETRIC + last)
    pairs = {(chance.randrange(16), chance.randrange(16)) for _ in range(11)} | {(20, 20), (30, 31)}
    catalog = Catalog(spark)
    catalog.table("e", spark.createDataFrame(sorted(pairs), "a long, b long"))
    assert rows(rules.Program(catalog, program).rows("linked", 2)) == sorted(row for n, row in answer(program, pairs) if n == "linked")


def test_closure_of_cliques_stores_rows_of_nodes(spark, monkeypatch):
    kept, stored = [], storage.stored

    def counted(df, path):
        kept.append((out := stored(df, path)).count())
        return out

    monkeypatch.setattr(storage, "stored", counted)
    catalog = Catalog(spark)
    catalog.table("s", spark.createDataFrame([(i, i % 2) for i in range(80)], "id long, n long"))
    source = "e(x, y) :- s(x, n), s(y, n), x < y.\n" + SYMMETRIC + "linked(x, z) :- linked(x, y), linked(y, z)."
    assert rows(rules.Program(catalog, text.parse_program(source)).rows("linked", 2)) == [(a, b) for a in range(80) for b in range(80) if a % 2 == b % 2]
    assert max(kept) <= 80


def test_closure_of_symmetric_pairs_with_facts_and_nulls(spark):
    source = SYMMETRIC + "linked(x, z) :- linked(x, y), linked(y, z)."
    catalog = Catalog(spark)
    catalog.table("e", spark.createDataFrame([(1, 2)], "a long, b long"))
    assert rows(rules.Program(catalog, text.parse_program(source + "\nnear(2, 3).")).rows("linked", 2)) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)]
    catalog.table("e", spark.createDataFrame([(1, 2), (None, 2), (5, None), (7, 8)], "a long, b long"))
    got = {tuple(r) for r in rules.Program(catalog, text.parse_program(source)).rows("linked", 2).collect()}
    assert got == {(a, b) for a in (1, 2) for b in (1, 2)} | {(a, b) for a in (7, 8) for b in (7, 8)} | {p for a in (1, 2, 5, None) for p in ((a, None), (None, a))}
    assert rules.Program(catalog, text.parse_program(source)).rows("linked", 2).count() == len(got)


@pytest.mark.parametrize("nodes", [0, 1000])
@pytest.mark.parametrize("kind", ["path", "star", "trees"])
def test_components_of_hard_shapes(spark, monkeypatch, kind, nodes):
    monkeypatch.setattr(closure, "SMALL_NODES", nodes)
    chance = random.Random(kind)
    name = chance.sample(range(1000), 200)
    links = {"path": [(name[i], name[i + 1]) for i in range(150)], "star": [(1000, i) for i in name], "trees": [(name[i], name[chance.randrange(i // 20 * 20, i)]) for i in range(200) if i % 20]}[kind]
    least = {x: x for p in links for x in p}
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert rows(closure.components(spark.createDataFrame(links, "a long, b long"))) == sorted(least.items())


def test_strata_groups_and_errors(spark):
    program = text.parse_program("a(x) :- e(x, _).\nb(x) :- e(_, x), not a(x).\nc(x) :- b(x).\nc(x) :- c(y), e(y, x).")
    found = rules.groups(program.of(s.Rule))
    assert [(g.predicates[0][0], g.recursive, g.stratum) for g in found] == [("a", False, 0), ("b", False, 1), ("c", True, 1)]
    assert code(rules.groups, text.parse_program("a(x) :- e(x, _), not b(x).\nb(x) :- e(x, _), not a(x).").of(s.Rule)) == "rules.unstratified"
    catalog = Catalog(spark)
    catalog.table("e", spark.createDataFrame([(1, 2)], "a long, b long"))
    assert code(lambda: rules.Program(catalog, text.parse_program("a(x) :- a(x).")).evaluate()) == "rules.no-exit"


def test_round_limit(spark):
    catalog = Catalog(spark)
    catalog.table("e", spark.createDataFrame([(i, i + 1) for i in range(6)], "a long, b long"))
    program = text.parse_program("r(x, y) :- e(x, y).\nr(x, z) :- r(x, y), e(y, z).")
    assert rules.Program(catalog, program).rows("r", 2).count() == 21
    assert code(lambda: rules.Program(catalog, program, max_rounds=2).evaluate()) == "rules.iteration-limit"


def test_program_facts_and_queries(spark):
    program = text.parse_program('parent("a", "b").\nparent("b", "c").\nold(x, y) :- parent(x, y).\nold(x, z) :- old(x, y), parent(y, z).\n?- old("a", z).')
    assert [rows(a) for a in rules.Program(Catalog(spark), program).answers()] == [[("b",), ("c",)]]


# Evidence


def test_evidence_last_source_wins_and_is_ordered(spark, likes):
    sources = [retrieval.Source('edge(a, "graph/likes", b)', {"evidence_id": "e/+?a/last", "kind": "like", "subject": "?a", "object": "?b"}), retrieval.Source("vertex(v)", {"evidence_id": "e/+?v/last", "kind": "node", "subject": "?v"})]
    found = retrieval.retrieve(likes.catalog(), sources, ("node", "like")).collect()
    assert [(r.evidence_id, r.kind) for r in found] == [("e/alice", "node"), ("e/bob", "node")]
