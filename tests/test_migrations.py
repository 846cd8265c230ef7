from datetime import UTC, datetime

import pytest

from loomlog.errors import LoomError
from loomlog.operators.graph import Graph
from loomlog.plans import conjunction
from loomlog.plans import syntax as s
from loomlog.sources import analysis, migrations, schema, text
from loomlog.sources.migrations import Workspace
from loomlog.streaming.watch import watch
from tests.conftest import rows
from tests.test_engine import code

DAY = datetime(2026, 4, 22, 12, tzinfo=UTC)
DECLARED = """DefPred("onto/preferred_label", "1", "node", "1", "text").
DefPred("med/has_mapping", "1", "node", "*", "graph/node").
DefPred("map/code", "1", "node", "1", "text").
DefPred("map/source", "1", "node", "1", "text").
DefCompound@("ExternalMapping", "map/of", "1", "node").
DefCompound@("ExternalMapping", "map/code", "1", "text").
DefCompound@("ExternalMapping", "map/source", "?", "text").
"""
FACTS = """Edge("medication/metformin", "onto/preferred_label", "Metformin").
Edge("mapping/metformin-rxnorm", "map/code", "6809").
Edge("mapping/metformin-rxnorm", "map/source", "RxNorm").
ExternalMapping@(cid="mapping/metformin-rxnorm", map/of="medication/metformin", map/code="6809", map/source="RxNorm").
"""


@pytest.fixture
def space(tmp_path):
    made = Workspace(tmp_path)
    assert made.init() is False and made.init() is True
    return made


def put(space, body):
    space.current.write_text(body, encoding="utf-8")


def back_link(fact, compound, schemas):
    terms = {t.name: t.term.value for t in fact.atom.terms}
    return s.Edge(terms["map/of"], "med/has_mapping", terms["cid"])


def test_lifecycle(space):
    assert space.status().code == "clean" and space.status().pending is False
    put(space, DECLARED)
    assert space.status().code == "current-uncommitted"
    made = space.commit(now=DAY)
    assert made.name == "20260422.0001.current.dl" and made.previous is None
    assert space.status().code == "committed-pending-unknown" and space.status().pending is None
    assert space.status([]).code == "committed-pending" and space.status([made.name]).code == "committed-applied"
    put(space, FACTS)
    assert space.status().code == "committed-and-current"
    second = space.commit("Add Metformin!", DAY)
    assert second.name == "20260422.0002.add-metformin.dl" and second.previous == made.name
    assert migrations.reconcile([made.name, second.name], ["other", made.name]) == [second.name]
    space.committed(check_chain=True)
    assert space.uncommit().name == second.name
    assert space.current.read_text(encoding="utf-8") == FACTS
    assert code(space.uncommit) == "migrate.current-not-empty"


def test_files_are_verified(space):
    put(space, DECLARED)
    made = space.commit(now=DAY)
    lines = made.path.read_text(encoding="utf-8").split("\n")
    assert lines[0] == "% migration.previous: none" and lines[2] == ""
    made.path.write_text(made.path.read_text(encoding="utf-8") + "more", encoding="utf-8")
    assert code(space.committed) == "migrate.hash-mismatch"
    made.path.write_text("no metadata", encoding="utf-8")
    assert code(space.committed) == "migrate.missing-metadata"


def test_what_cannot_be_committed(space):
    assert code(space.commit) == "migrate.empty"
    put(space, "% migration.sha256: 1\nVertex(\"a\").\n")
    assert code(space.commit) == "migrate.embedded-metadata"
    put(space, "%\n")
    assert code(space.uncommit) == "migrate.nothing-committed"
    put(space, DECLARED)
    space.commit(now=DAY)
    space.current.unlink()
    assert code(space.init) == "migrate.init"


def test_apply_to_a_graph(spark, space, tmp_path):
    put(space, DECLARED)
    space.commit(now=DAY)
    put(space, FACTS)
    space.commit(now=DAY)
    done = migrations.apply(Graph.empty(spark), space.committed(), expander=back_link, now=DAY)
    assert done.graph.edges.count() == 4
    assert rows(done.graph.vertices) == [("6809",), ("Metformin",), ("RxNorm",), ("mapping/metformin-rxnorm",), ("medication/metformin",)]
    again = migrations.apply(done.graph, space.committed(), done.ledger, back_link)
    assert again.graph.edges.count() == 4 and again.ledger.count() == 2
    catalog = done.graph.catalog(done.schemas)
    found = conjunction.run_query(catalog, text.parse_query('Edge(m, "onto/preferred_label", label), Edge(m, "med/has_mapping", x), Edge(x, "map/source", "RxNorm"), Edge(x, "map/code", code)'))
    assert [r.asDict() for r in found.collect()] == [{"m": "medication/metformin", "label": "Metformin", "x": "mapping/metformin-rxnorm", "code": "6809"}]
    expanded = migrations.apply(Graph.empty(spark), space.committed(), expand_compounds=True)
    assert expanded.graph.edges.where("predicate_id = 'map/of'").count() == 1
    ledger = f"file://{tmp_path}/{migrations.LEDGER}"
    assert migrations.applied_names(spark, ledger) == []
    again.ledger.write.parquet(ledger)
    assert migrations.applied_names(spark, ledger) == space.names()


@pytest.mark.parametrize(
    "body, want",
    [
        ('Edge("a", "unknown", "b").', "migrate.missing-schema"),
        ('Other@(cid="x").', "migrate.missing-schema"),
        ('Edge("a", "onto/preferred_label", 5).', "migrate.invalid-fact"),
        ('Edge(x, "onto/preferred_label", "b").', "migrate.invalid-fact"),
        ('ExternalMapping@(cid="x", map/code="1").', "migrate.invalid-fact"),
        ('ExternalMapping@(cid="x", map/of="a", map/code="1", map/source="a", map/source="b").', "migrate.invalid-fact"),
        ('ExternalMapping@(cid="x", map/of="a", map/code="1", other="b").', "migrate.invalid-fact"),
        ('ExternalMapping@(cid=5, map/of="a", map/code="1").', "migrate.invalid-fact"),
        ('DefPred("p", "1", "node", "2", "text").', "migrate.invalid-schema-declaration"),
        ('DefPred("p", "1", "node", "1").', "migrate.invalid-schema-declaration"),
        ('DefCompound@("C", "f", "1", "money").', "migrate.invalid-schema-declaration"),
    ],
)
def test_validation(body, want):
    assert code(migrations.facts_of, {"one": text.parse_program(DECLARED), "two": text.parse_program(body)}) == want


def test_inline_queries_do_not_shift_validation():
    body = '?- Edge(x, "p", y).\nEdge("a", "onto/preferred_label", "b").\nr(x) :- Vertex(x).\n'
    _, facts = migrations.facts_of({"one": text.parse_program(DECLARED + body)})
    assert facts == [s.Edge("a", "onto/preferred_label", "b")]


def test_declarations_merge_and_order():
    found = schema.declarations([text.parse_program(DECLARED + 'DefCompound@("ExternalMapping", "map/code", "*", "int8").\nDefPred("bad", "9", "node", "1", "text").')])
    assert [type(x).__name__ for x in found] == ["PredicateSchema"] * 4 + ["CompoundSchema"]
    assert [(f.name, f.cardinality) for f in found[-1].fields] == [("map/of", "1"), ("map/code", "*"), ("map/source", "?")]
    assert schema.compounds_with_field(found, "map/code") == [found[-1]]


def test_document_analysis():
    document = analysis.parse_document('DefPred("food/preferred_label", "1", "node", "1", "text").\nEdge("food/a", "food/preferred_label", "Apple").\nEdge("food/a", "food/instance_of", "class/fruit").\nsweet(x) :- Edge(x, "food/taste", "sweet").')
    assert document.summaries["food/a"].label == "Apple" and document.summaries["food/a"].classes == ["class/fruit"]
    assert document.predicate_ids == ["food/instance_of", "food/preferred_label", "food/taste"]
    assert "food/a" in document.node_ids and list(document.derived) == ["sweet"]
    found = analysis.symbols(document)
    assert len(found["nodes"]["graph-node:food/a"]) == 2 and "builtin-predicate:Edge/3" in found["predicates"]
    clinical = analysis.parse_document('Edge("a/1", "onto/label", "A").', label="onto/label")
    assert clinical.summaries["a/1"].label == "A"


def test_lint():
    codes = lambda source: [d.code for d in analysis.lint(source)]
    assert codes(DECLARED + FACTS) == []
    assert codes('Edge("a", "p").') == ["arity"]
    assert "unterminated-string" in codes('Edge("a, "p", "b").')
    assert codes('Vertex("a")') == ["missing-period"]
    assert codes('DefPred("p", "1", "node", "1", "text").\nDefPred("p", "1", "node", "1", "text").') == ["duplicate-schema"]
    assert codes(DECLARED + 'ExternalMapping@(cid="x", map/of="a", map/code=5, other="1").') == ["domain", "unknown-field"]


def test_watch(space):
    seen = []
    for snapshot in watch(space.root, interval=0, max_snapshots=3, sleep=lambda _: put(space, f'Vertex("{len(seen)}").\n')):
        seen.append(snapshot)
    assert [x.meaningful for x in seen] == [False, True, True] and seen[2].number == 3
    times = iter([0, 1, 2, 3])
    assert len(list(watch(space.root, interval=0, timeout=2, clock=lambda: next(times), sleep=lambda _: None))) == 1


def test_errors_are_value_errors():
    with pytest.raises(ValueError):
        raise LoomError("a.b", "c")
