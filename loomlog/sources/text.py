"""Program text to syntax.

Statements end where a line ends in a full stop; lines that begin with `%`
between statements are comments. Offsets are those of the source, so every
node has its place.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

from loomlog.errors import LoomError
from loomlog.plans import syntax as s

NAME = re.compile(r"[A-Za-z_]\w*", re.ASCII)
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\"}
ASK, IF = "?-", ":-"


@dataclass(frozen=True)
class Piece:
    """A stretch of the source."""

    source: Source
    start: int
    end: int

    @property
    def text(self) -> str:
        return self.source.text[self.start : self.end]

    def strip(self) -> Piece:
        text = self.text
        return Piece(self.source, self.start + len(text) - len(text.lstrip()), self.end - len(text) + len(text.rstrip()))

    def part(self, low: int, high: int | None = None) -> Piece:
        return Piece(self.source, self.start + low, self.end if high is None else self.start + high)

    def span(self) -> s.Span:
        return self.source.span(self.start, self.end)


class Source:
    def __init__(self, text: str, decimals: bool = False):
        self.text, self.decimals = text, decimals
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]

    def span(self, start: int, end: int) -> s.Span:
        line = bisect.bisect_right(self.lines, start)
        return s.Span(start, end, line, start - self.lines[line - 1] + 1)

    def statements(self) -> Iterator[Piece]:
        """Statements without the white space around them, with their full stop."""
        begin = at = None
        at = 0
        for line in self.text.split("\n"):
            bare = line.strip()
            if begin is None and bare and not bare.startswith("%"):
                begin = at
            at += len(line) + 1
            if begin is not None and bare.endswith("."):
                yield Piece(self, begin, min(at, len(self.text))).strip()
                begin = None
        if begin is not None and (rest := Piece(self, begin, len(self.text)).strip()).text:
            yield rest


def surface(text: str) -> Iterator[tuple[int, str]]:
    """The characters of a text that stand outside quotes and parentheses."""
    quoted, depth, before = False, 0, ""
    for i, ch in enumerate(text):
        if ch == '"' and before != "\\":
            quoted = not quoted
        elif not quoted:
            depth += (ch == "(") - (ch == ")")
            if depth == 0 and ch != ")":
                yield i, ch
        before = ch


def commas(piece: Piece) -> list[Piece]:
    cuts = [-1, *(i for i, ch in surface(piece.text) if ch == ","), len(piece.text)]
    parts = [piece.part(a + 1, b).strip() for a, b in zip(cuts, cuts[1:], strict=False)]
    return [p for p in parts if p.text]


def unescape(text: str) -> str:
    return re.sub(r'\\([nrt"\\])', lambda m: ESCAPES[m[1]], text)


def term(piece: Piece) -> s.Term:
    piece = piece.strip()
    text, span = piece.text, piece.span()
    if not text:
        raise LoomError("parse.term", "a term is missing", start=piece.start)
    if len(text) > 1 and text[0] == text[-1] == '"':
        return s.Constant(unescape(text[1:-1]), span=span)
    if text == "_":
        return s.Wildcard(span=span)
    if re.fullmatch(r"-?\d+", text, re.ASCII):
        return s.Constant(int(text), span=span)
    if piece.source.decimals and re.fullmatch(r"-?\d+\.\d+", text, re.ASCII):
        return s.Constant(float(text), span=span)
    if text in ("true", "false", "null"):
        return s.Constant({"true": True, "false": False, "null": None}[text], span=span)
    return s.Variable(text, span=span)


def atom(piece: Piece) -> s.Atom:
    piece = piece.strip()
    text = piece.text
    name = NAME.match(text)
    rest = text[name.end() :] if name else ""
    compound = rest.startswith("@")
    inner = rest[compound:].lstrip()
    if not name or not inner.startswith("(") or not text.endswith(")"):
        raise LoomError("parse.atom", f"an atom is expected: {text}", start=piece.start)
    args = commas(piece.part(len(text) - len(inner) + 1, len(text) - 1))
    return s.Atom(name[0], tuple(argument(a) if compound else term(a) for a in args), compound, span=piece.span())


def argument(piece: Piece) -> s.Term | s.Named:
    cut = next((i for i, ch in surface(piece.text) if ch == "="), None)
    if cut is None:
        return term(piece)
    return s.Named(piece.text[:cut].strip(), term(piece.part(cut + 1)), span=piece.span())


def literal(piece: Piece) -> s.Literal:
    piece = piece.strip()
    text = piece.text
    if text.startswith("not "):
        return s.Negation(atom(piece.part(4)), span=piece.span())
    for i, ch in surface(text):
        two = text[i : i + 2]
        sign = two if two in ("!=", "<=", ">=") else ch if ch in "=<>" else None
        if sign:
            return s.Comparison(term(piece.part(0, i)), sign, term(piece.part(i + len(sign))), span=piece.span())
    return atom(piece)


def body(piece: Piece) -> tuple[s.Literal, ...]:
    found = tuple(literal(p) for p in commas(piece))
    if not found:
        raise LoomError("parse.body", "a body needs a literal", start=piece.start)
    return found


def without_stop(piece: Piece) -> Piece:
    piece = piece.strip()
    return piece.part(0, len(piece.text) - 1) if piece.text.endswith(".") else piece


def statement(piece: Piece) -> s.Fact | s.Rule | s.Query:
    inner = without_stop(piece)
    text = inner.text
    if text.startswith(ASK):
        return s.Query(body(inner.part(len(ASK))), span=inner.span())
    cut = next((i for i, ch in surface(text) if ch == ":" and text[i : i + 2] == IF), None)
    if cut is None:
        return s.Fact(atom(inner), span=piece.span())
    return s.Rule(atom(inner.part(0, cut)), body(inner.part(cut + len(IF))), span=piece.span())


def parse_program(text: str, decimals: bool = False) -> s.Program:
    """Facts, compound facts, rules and `?-` queries, in order."""
    return s.Program(tuple(statement(p) for p in Source(text, decimals).statements()))


def parse_query(text: str, decimals: bool = False) -> s.Query:
    """One query; `?-` in front and the full stop at the end may be left out."""
    source = Source(text, decimals)
    inner = without_stop(Piece(source, 0, len(text)))
    start = len(ASK) if inner.text.startswith(ASK) else 0
    return s.Query(body(inner.part(start)), span=inner.span())


def parse_sources(texts: dict[str, str]) -> tuple[s.Program, dict[str, s.Program]]:
    """The program of several named texts in order, and the program of each."""
    each = {name: parse_program(text) for name, text in texts.items()}
    return s.Program(tuple(x for p in each.values() for x in p.statements)), each


GRAPH_FACTS = {("Edge", 3): s.Edge, ("Vertex", 1): s.Vertex, ("Node", 1): s.Vertex}


def graph_fact(node) -> s.Edge | s.Vertex | None:
    """The fact that a statement such as Edge("a", "p", "b") states; None for all others."""
    made = isinstance(node, s.Fact) and not node.atom.compound and GRAPH_FACTS.get((node.atom.predicate, node.atom.arity))
    if not made or not all(isinstance(t, s.Constant) and isinstance(t.value, str) for t in node.atom.terms):
        return None
    return made(*(t.value for t in node.atom.terms))


def parse_facts(text: str) -> list[s.Edge | s.Vertex]:
    """Strict: every statement must be a vertex or edge fact of quoted constants, and there must be one."""
    found = []
    for node in parse_program(text).statements:
        fact = graph_fact(node)
        if fact is None:
            raise LoomError("facts.unsupported", f"not a vertex or edge fact at {node.span.line}:{node.span.column}")
        found.append(fact)
    if not found:
        raise LoomError("facts.empty", "the text states no facts")
    return found


def extract_facts(program: s.Program) -> list[s.Edge | s.Vertex]:
    """Lenient: the vertex and edge facts among a program's statements."""
    return [f for f in map(graph_fact, program.statements) if f is not None]
