"""A conjunction of literals to one DataFrame.

Each atom is a scan with its columns renamed apart, its constants and repeated
variables as filters; shared variables are equi-joins; comparisons, calls and
negation follow once what they need is bound. Atoms are joined in an order
that keeps the plan connected (the written order otherwise), which changes no
result; join strategies are left to Catalyst and adaptive execution.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.errors import LoomError
from loomlog.functions.values import call
from loomlog.plans import syntax as s
from loomlog.sources.catalog import Catalog, Relation

#: The one column of the result of a query without variables.
TRUTH = "?column?"


@dataclass
class Bound:
    """Rows, and the column of each variable."""

    rows: DataFrame
    columns: dict[str, str]


def check_terms(atom: s.Atom, strict: bool) -> None:
    if not atom.terms:
        raise LoomError("query.invalid-atom-arity", f"{atom.predicate} has no terms")
    for term in atom.terms:
        if isinstance(term, s.Named):
            raise LoomError("query.unsupported-term", f"{atom.predicate} names the term {term.name}")
        if strict and isinstance(term, s.Constant) and not isinstance(term.value, str):
            raise LoomError("query.invalid-term", f"{atom.predicate} has the constant {term.value!r}, which is no string")


def scan(relation: Relation, atom: s.Atom, number: int, rows: DataFrame | None = None) -> Bound:
    """One atom: columns s<number>_<place>, filtered, and only those that variables need."""
    rows = relation.read() if rows is None else rows
    names = [f"s{number}_{i}" for i in range(len(atom.terms))]
    types = dict(rows.dtypes)
    kinds = [types[c] for c in relation.columns] if len(types) == len(rows.columns) else [k for _, k in rows.dtypes]
    rows = rows.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(relation.columns, names, strict=True)))
    columns: dict[str, str] = {}
    for term, name, kind in zip(atom.terms, names, kinds, strict=True):
        if isinstance(term, s.Constant):
            rows = rows.where(F.col(name) == constant(term, kind)) if term.value is not None else rows.where(F.lit(None).cast("boolean"))
        elif isinstance(term, s.Variable):
            if term.name in columns:
                rows = rows.where(equal(rows, name, rows, columns[term.name]))
            else:
                columns[term.name] = name
    return Bound(rows.select(*columns.values()), columns)


def constant(term: s.Constant, kind: str) -> Column:
    """A constant that meets a column of some type: null, which matches nothing, where the type cannot hold it."""
    number = isinstance(term.value, int | float) and not isinstance(term.value, bool)
    return F.lit(term.value) if number and kind != "string" else F.lit(term.value).try_cast(kind)


def equal(left: DataFrame, one: str, right: DataFrame, other: str) -> Column:
    """Equality of two columns; text against another type compares as text."""
    a, b = F.col(one), F.col(other)
    if (dict(left.dtypes)[one] == "string") != (dict(right.dtypes)[other] == "string"):
        a, b = a.cast("string"), b.cast("string")
    return a == b


def join(left: Bound, right: Bound) -> Bound:
    """Equi-join on the variables that both bind; the product where they share none."""
    shared = [v for v in right.columns if v in left.columns]
    if shared:
        on = [equal(left.rows, left.columns[v], right.rows, right.columns[v]) for v in shared]
        rows = left.rows.join(right.rows, on, "inner").drop(*(right.columns[v] for v in shared))
    else:
        rows = left.rows.crossJoin(right.rows)
    return Bound(rows, right.columns | left.columns)


def value(term: s.Term, bound: Bound) -> Column:
    if isinstance(term, s.Constant):
        return F.lit(term.value)
    return F.col(bound.columns[term.name])


OPERATIONS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def compare(node: s.Comparison, bound: Bound) -> Column:
    """Numbers against text columns compare as numbers, and so do columns of different types in an order; nulls never match.

    A text that is no value of the column's type equals none of its values, differs from all, and stands in no order to them.
    """
    kinds = dict(bound.rows.dtypes)
    left, right = value(node.left, bound), value(node.right, bound)
    if isinstance(node.left, s.Variable) and isinstance(node.right, s.Variable):
        ends = [bound.columns[x.name] for x in (node.left, node.right)]
        texts = [kinds[x] == "string" for x in ends]
        if texts[0] != texts[1]:
            as_one = (lambda x, _: x.cast("string")) if node.operator in ("=", "!=") else (lambda x, is_text: x.try_cast("double") if is_text else x)
            left, right = as_one(left, texts[0]), as_one(right, texts[1])
    for one, other in ((node.left, node.right), (node.right, node.left)):
        number = isinstance(one, s.Constant) and isinstance(one.value, int | float) and not isinstance(one.value, bool)
        if number and isinstance(other, s.Variable) and kinds[bound.columns[other.name]] == "string":
            cast = F.col(bound.columns[other.name]).try_cast("double")
            left, right = (left, cast) if one is node.left else (cast, right)
        text = isinstance(one, s.Constant) and isinstance(one.value, str)
        if text and isinstance(other, s.Variable) and kinds[bound.columns[other.name]] != "string":
            column = F.col(bound.columns[other.name])
            cast = F.lit(one.value).try_cast(kinds[bound.columns[other.name]])
            if node.operator == "!=":
                return column.isNotNull() & F.coalesce(column != cast, F.lit(True))
            left, right = (cast, right) if one is node.left else (left, cast)
    return OPERATIONS[node.operator](left, right)


def needs(node) -> set[str]:
    return set(s.variables(node))


def order(atoms: list[s.Atom]) -> list[int]:
    """Places of the atoms, each connected to those before where one can be, more constants first among these."""
    left, done, bound = list(range(len(atoms))), [], set()
    weight = [sum(isinstance(t, s.Constant) for t in a.terms) for a in atoms]
    while left:
        best = max(left, key=lambda i: (bool(needs(atoms[i]) & bound) or not done, weight[i], -i))
        if done and not needs(atoms[best]) & bound:
            best = left[0]
        left.remove(best)
        done.append(best)
        bound |= needs(atoms[best])
    return done


def compile_body(catalog: Catalog, body: tuple[s.Literal, ...], strict: bool = False, reorder: bool = True, scans: dict[int, DataFrame] | None = None) -> Bound:
    """The rows of a body with all its variables bound.

    scans: rows to read instead of an atom's relation, by the atom's place in
    the body. Comparisons may assign (`X = 3`), calls bind their result. A
    variable that only a comparison, call or negation mentions is an error.
    """
    body = tuple(builtin(catalog, x) for x in body)
    atoms = [(i, x) for i, x in enumerate(body) if isinstance(x, s.Atom)]
    for _, atom in atoms:
        check_terms(atom, strict)
    bound: Bound | None = None
    for at in order([a for _, a in atoms]) if reorder else range(len(atoms)):
        place, atom = atoms[at]
        one = scan(catalog.resolve(atom.predicate, atom.arity), atom, place, (scans or {}).get(place))
        bound = one if bound is None else join(bound, one)
    bound = bound or Bound(catalog.spark.range(1).select(), {})
    waiting = [(i, x) for i, x in enumerate(body) if not isinstance(x, s.Atom)]
    while waiting:
        for place, node in waiting:
            after = apply(catalog, node, place, bound, strict, (scans or {}).get(place))
            if after is not None:
                bound = after
                waiting.remove((place, node))
                break
        else:
            raise LoomError("query.unsafe-variable", f"nothing binds {sorted(set().union(*(needs(n) for _, n in waiting)) - set(bound.columns))}")
    return bound


def builtin(catalog: Catalog, node: s.Literal) -> s.Literal:
    """An atom of a built-in predicate as the call or comparison it stands for."""
    if not isinstance(node, s.Atom) or (node.predicate, node.arity) not in catalog.builtins:
        return node
    name, returns, test = catalog.builtins[node.predicate, node.arity]
    if test:
        return s.Call(name, node.terms, returns)
    result = node.terms[-1]
    if isinstance(result, s.Variable):
        return s.Call(name, node.terms[:-1], returns, result)
    return s.Call(name, node.terms[:-1], returns, s.Variable("_") if isinstance(result, s.Wildcard) else result)


def apply(catalog: Catalog, node: s.Literal, place: int, bound: Bound, strict: bool, rows: DataFrame | None) -> Bound | None:
    """A literal that is not an atom; None while variables are missing that it needs."""
    have = set(bound.columns)
    if isinstance(node, s.Comparison):
        if isinstance(node.left, s.Wildcard) or isinstance(node.right, s.Wildcard):
            raise LoomError("query.unsupported-term", "a wildcard cannot be compared")
        if needs(node) <= have:
            return Bound(bound.rows.where(compare(node, bound)), bound.columns)
        for target, source in ((node.left, node.right), (node.right, node.left)):
            if node.operator == "=" and isinstance(target, s.Variable) and target.name not in have and needs(source) <= have:
                name = f"s{place}_v"
                return Bound(bound.rows.withColumn(name, value(source, bound)), bound.columns | {target.name: name})
        return None
    if isinstance(node, s.Call):
        if not set().union(*(needs(a) for a in node.args), set()) <= have:
            return None
        made = call(node.name, [value(a, bound) for a in node.args], node.returns)
        if node.result is None:
            return Bound(bound.rows.where(made), bound.columns)
        if isinstance(node.result, s.Constant):
            return Bound(bound.rows.where(made == F.lit(node.result.value)), bound.columns)
        if node.result.name == "_":
            return bound
        if node.result.name in have:
            return Bound(bound.rows.where(made == F.col(bound.columns[node.result.name])), bound.columns)
        return Bound(bound.rows.withColumn(f"s{place}_v", made), bound.columns | {node.result.name: f"s{place}_v"})
    check_terms(node.atom, strict)
    if not needs(node.atom) <= have:
        return None
    denied = scan(catalog.resolve(node.atom.predicate, node.atom.arity), node.atom, place, rows)
    if not denied.columns:
        truth = denied.rows.select(F.lit(1).alias(f"s{place}_t")).limit(1)
        return Bound(bound.rows.join(truth, F.lit(True), "left_anti"), bound.columns)
    on = [equal(bound.rows, bound.columns[v], denied.rows, c) for v, c in denied.columns.items()]
    return Bound(bound.rows.join(denied.rows, on, "left_anti"), bound.columns)


def output(body: tuple[s.Literal, ...]) -> list[str]:
    """The variables of the positive literals, in order of first appearance."""
    return list(dict.fromkeys(v for x in body if not isinstance(x, s.Negation) for v in s.variables(x)))


def run_query(catalog: Catalog, query: s.Query, strict: bool = False, reorder: bool = True) -> DataFrame:
    """The distinct values of a query's variables, in order of first appearance; a constant row for a query without any.

    project, limit and offset of the query are honoured; without an order of its own, limit takes rows in the order of their values.
    """
    if not query.body:
        raise LoomError("query.empty-body", "the query has no literal")
    if strict and (odd := [x for x in query.body if not isinstance(x, s.Atom)]):
        raise LoomError("query.unsupported-literal", f"only positive atoms may stand here, not {type(odd[0]).__name__}")
    bound = compile_body(catalog, query.body, strict, reorder)
    names = list(query.project) if query.project is not None else output(query.body)
    if missing := [n for n in names if n not in bound.columns]:
        raise LoomError("query.unsafe-variable", f"nothing binds {missing}")
    if not names:
        return bound.rows.select(F.lit(1).alias(TRUTH)).limit(1)
    rows = bound.rows.select(*(F.col(bound.columns[n]) for n in dict.fromkeys(names))).distinct()
    if query.limit is not None or query.offset is not None:
        rows = rows.orderBy(*(F.col(c).asc_nulls_last() for c in rows.columns)).offset(query.offset or 0)
        rows = rows.limit(query.limit) if query.limit is not None else rows
    return rows.select(*(F.col(bound.columns[n]).alias(n) for n in names))
