"""The abstract syntax: terms, literals, statements, schemas, facts, and how to walk them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields, is_dataclass

#: Fixed values of the language: scalar types, domains, cardinalities, comparison operators.
TYPES = ("text", "int8", "numeric", "bool", "jsonb", "date", "timestamp", "unknown")
DOMAINS = ("node", "text", "int8", "numeric", "bool", "jsonb", "date", "timestamp")
CARDINALITIES = ("0", "1", "?", "+", "*")
OPERATORS = ("=", "!=", "<", "<=", ">", ">=")

Scalar = str | int | float | bool | None


@dataclass(frozen=True)
class Span:
    """Where a node stands in its source: offsets, and one-based line and column of the start."""

    start: int
    end: int
    line: int = 1
    column: int = 1


def _span():
    return field(default=None, compare=False, repr=False, kw_only=True)


@dataclass(frozen=True)
class Variable:
    name: str
    span: Span | None = _span()


@dataclass(frozen=True)
class Constant:
    value: Scalar
    span: Span | None = _span()


@dataclass(frozen=True)
class Wildcard:
    span: Span | None = _span()


@dataclass(frozen=True)
class Named:
    """`field=term`, in the arguments of a compound atom."""

    name: str
    term: Variable | Constant | Wildcard
    span: Span | None = _span()


Term = Variable | Constant | Wildcard


@dataclass(frozen=True)
class Atom:
    predicate: str
    terms: tuple[Term | Named, ...]
    compound: bool = False
    span: Span | None = _span()

    @property
    def arity(self) -> int:
        return len(self.terms)


@dataclass(frozen=True)
class Negation:
    atom: Atom
    span: Span | None = _span()


@dataclass(frozen=True)
class Comparison:
    left: Term
    operator: str
    right: Term
    span: Span | None = _span()

    def __post_init__(self):
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator}")


@dataclass(frozen=True)
class Call:
    """A function call that yields a value of a type; as a literal it binds `result` or must be true."""

    name: str
    args: tuple[Term, ...]
    returns: str = "unknown"
    result: Variable | Constant | None = None
    span: Span | None = _span()


Literal = Atom | Negation | Comparison | Call


@dataclass(frozen=True)
class Fact:
    atom: Atom
    span: Span | None = _span()


@dataclass(frozen=True)
class Aggregate:
    """In the head of a rule or a query's projection: function of a variable, under an output name."""

    function: str
    argument: str | None
    name: str


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Literal, ...]
    span: Span | None = _span()


@dataclass(frozen=True)
class Query:
    body: tuple[Literal, ...]
    project: tuple[str, ...] | None = None
    limit: int | None = None
    offset: int | None = None
    span: Span | None = _span()


@dataclass(frozen=True)
class Directive:
    name: str
    args: tuple[Scalar, ...] = ()
    span: Span | None = _span()


@dataclass(frozen=True)
class Program:
    statements: tuple[Fact | Rule | Query | Directive, ...]

    def of(self, kind: type) -> list:
        return [s for s in self.statements if isinstance(s, kind)]


@dataclass(frozen=True)
class PredicateSchema:
    name: str
    subject_cardinality: str
    subject_domain: str
    object_cardinality: str
    object_domain: str


@dataclass(frozen=True)
class Field:
    name: str
    cardinality: str
    domain: str

    @property
    def required(self) -> bool:
        return self.cardinality in ("1", "+")

    @property
    def repeatable(self) -> bool:
        return self.cardinality in ("0", "+", "*")


@dataclass(frozen=True)
class CompoundSchema:
    name: str
    fields: tuple[Field, ...]
    mutable: bool = False


@dataclass(frozen=True)
class Vertex:
    id: str


@dataclass(frozen=True)
class Edge:
    subject: str
    predicate: str
    object: str


@dataclass(frozen=True)
class VertexPattern:
    id: Term


@dataclass(frozen=True)
class EdgePattern:
    subject: Term
    predicate: Term
    object: Term


#: The fields of each kind of node that hold nodes, in reading order.
CHILDREN = {Named: ("term",), Atom: ("terms",), Negation: ("atom",), Comparison: ("left", "right"), Call: ("args", "result"), Fact: ("atom",), Rule: ("head", "body"), Query: ("body",), Program: ("statements",), VertexPattern: ("id",), EdgePattern: ("subject", "predicate", "object")}


def walk(node) -> Iterator:
    """The node and all nodes below it, in reading order."""
    yield node
    for name in CHILDREN.get(type(node), ()):
        below = getattr(node, name)
        for child in below if isinstance(below, tuple) else (below,):
            if child is not None:
                yield from walk(child)


def variables(node) -> list[str]:
    """The names of a node's variables, in order of first appearance."""
    return list(dict.fromkeys(n.name for n in walk(node) if isinstance(n, Variable)))


def ground(atom: Atom) -> bool:
    return all(isinstance(t.term if isinstance(t, Named) else t, Constant) for t in atom.terms)


def as_plain(node):
    """A node as dictionaries and lists, without spans."""
    if is_dataclass(node):
        return {"kind": type(node).__name__} | {f.name: as_plain(getattr(node, f.name)) for f in fields(node) if f.name != "span"}
    return [as_plain(x) for x in node] if isinstance(node, tuple) else node
