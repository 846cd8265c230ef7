import pytest

from loomlog.errors import LoomError
from loomlog.plans import syntax as s
from loomlog.sources import text

V, C = s.Variable, s.Constant


def test_program_with_every_statement():
    program = text.parse_program("""% comment
Edge("a", "p", "b").
Review@(cid=r, item="x/1", n=5).
near(x, y) :-
  Edge(x, "p", y),
  not Edge(y, "p", x), x != y.
?- near(x, _).
""")
    fact, compound, rule, query = program.statements
    assert fact.atom == s.Atom("Edge", (C("a"), C("p"), C("b")))
    assert compound.atom == s.Atom("Review", (s.Named("cid", V("r")), s.Named("item", C("x/1")), s.Named("n", C(5))), True)
    assert rule.head == s.Atom("near", (V("x"), V("y")))
    assert rule.body[1] == s.Negation(s.Atom("Edge", (V("y"), C("p"), V("x"))))
    assert rule.body[2] == s.Comparison(V("x"), "!=", V("y"))
    assert query.body == (s.Atom("near", (V("x"), s.Wildcard())),)


@pytest.mark.parametrize("source, value", [('"a b"', C("a b")), ("_", s.Wildcard()), ("-12", C(-12)), ("true", C(True)), ("false", C(False)), ("null", C(None)), ("x", V("x")), ("Upper", V("Upper")), ("1.5", V("1.5"))])
def test_terms(source, value):
    assert text.parse_query(f"p({source})").body[0].terms == (value,)


def test_decimals_are_opt_in():
    assert text.parse_query("p(1.5)", decimals=True).body[0].terms == (C(1.5),)


def test_escapes_in_one_pass():
    assert text.parse_query(r'p("a\"b\n\\n")').body[0].terms == (C('a"b\n\\n'),)


def test_strings_hide_structure():
    atom = text.parse_query('p("a, b) :- c", "x = y")').body[0]
    assert [t.value for t in atom.terms] == ["a, b) :- c", "x = y"]


@pytest.mark.parametrize("operator", s.OPERATORS)
def test_comparisons(operator):
    assert text.parse_query(f"p(x), x {operator} 3").body[1] == s.Comparison(V("x"), operator, C(3))


def test_query_prefix_and_stop_are_optional():
    assert text.parse_query("?- p(x), q(x).") == text.parse_query("  p(x), q(x)")


def test_statements_end_with_lines_only():
    assert [p.text for p in text.Source('a(x). b(y).\nc(z). % note\nd(w).\n').statements()] == ["a(x). b(y).", "c(z). % note\nd(w)."]


def test_spans_count_characters():
    program = text.parse_program('% 🍎\nEdge("🍎", "p",\n  "b").\n')
    assert (program.statements[0].span.line, program.statements[0].span.column) == (2, 1)
    third = program.statements[0].atom.terms[2].span
    assert (third.line, third.column) == (3, 3)


def test_empty_arguments_and_bad_atoms():
    assert text.parse_query("p()").body[0].terms == ()
    for bad in ("p(", "3(x)", "", "p x"):
        with pytest.raises(LoomError):
            text.parse_query(bad)


def test_strict_and_lenient_facts():
    assert text.parse_facts('Vertex("a").\nNode("b").\nEdge("a", "p", "b").') == [s.Vertex("a"), s.Vertex("b"), s.Edge("a", "p", "b")]
    with pytest.raises(LoomError):
        text.parse_facts('Edge("a", p, "b").')
    with pytest.raises(LoomError):
        text.parse_facts("% nothing\n")
    mixed = text.parse_program('Edge("a", p, "b").\nVertex("c").\nr(x) :- Vertex(x).')
    assert text.extract_facts(mixed) == [s.Vertex("c")]


def test_several_sources_in_order():
    whole, each = text.parse_sources({"one": 'Vertex("a").', "two": 'Vertex("b").'})
    assert [f.atom.terms[0].value for f in whole.statements] == ["a", "b"]
    assert len(each["two"].statements) == 1


def test_walk_and_plain():
    query = text.parse_query('p(x, "a"), not q(y)')
    assert s.variables(query) == ["x", "y"]
    assert s.as_plain(query)["body"][0]["terms"][1] == {"kind": "Constant", "value": "a"}
