"""Rules: dependencies, strata, and fixpoints.

Predicates are grouped by mutual recursion and evaluated in dependency order.
A recursive group runs semi-naively: each round joins the rows that are new
with all others, once for each recursive atom, and keeps what no earlier round
has. Rows of each round are stored, so plans stay short and a lost executor
costs one task; a round's new rows are only as large as what it found. A
predicate that only closes symmetric pairs transitively needs no rounds over
pairs: its rows are those of components, joined with themselves.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, is_dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog import storage
from loomlog.errors import LoomError
from loomlog.functions import values
from loomlog.operators import closure
from loomlog.plans import conjunction
from loomlog.plans import syntax as s
from loomlog.sources.catalog import Catalog, Relation

Key = tuple[str, int]
MAX_ROUNDS = 1000


def key_of(atom: s.Atom) -> Key:
    return atom.predicate, atom.arity


@dataclass(frozen=True)
class Group:
    """Predicates that depend on each other, their stratum, and whether they are recursive."""

    predicates: tuple[Key, ...]
    recursive: bool
    stratum: int


def dependencies(rules: list[s.Rule]) -> dict[Key, dict[Key, bool]]:
    """What each derived predicate reads; the value tells whether some rule reads it through a negation."""
    found: dict[Key, dict[Key, bool]] = {}
    for rule in rules:
        reads = found.setdefault(key_of(rule.head), {})
        for literal in rule.body:
            if isinstance(literal, s.Atom):
                reads.setdefault(key_of(literal), False)
            elif isinstance(literal, s.Negation):
                reads[key_of(literal.atom)] = True
    return found


def groups(rules: list[s.Rule]) -> list[Group]:
    """The groups of derived predicates in an order in which they can be evaluated. A negation within a group is an error."""
    reads = dependencies(rules)
    number: dict[Key, int] = {}
    low: dict[Key, int] = {}
    stack: list[Key] = []
    out: list[Group] = []
    home: dict[Key, Group] = {}

    def close(root: Key) -> None:
        members = []
        while True:
            members.append(stack.pop())
            if members[-1] == root:
                break
        inside = set(members)
        recursive = any(d in inside for m in members for d in reads[m])
        if any(through and d in inside for m in members for d, through in reads[m].items()):
            raise LoomError("rules.unstratified", f"{sorted(inside)} negate themselves")
        stratum = max((home[d].stratum + through for m in members for d, through in reads[m].items() if d in home), default=0)
        group = Group(tuple(sorted(members)), recursive, stratum)
        out.append(group)
        home.update(dict.fromkeys(members, group))

    for start in reads:
        if start in number:
            continue
        path = [(start, iter(reads[start]))]
        number[start] = low[start] = len(number)
        stack.append(start)
        while path:
            node, rest = path[-1]
            after = next((d for d in rest if d in reads), None)
            if after is None:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == number[node]:
                    close(node)
            elif after not in number:
                number[after] = low[after] = len(number)
                stack.append(after)
                path.append((after, iter(reads[after])))
            elif after in stack:
                low[node] = min(low[node], number[after])
    return out


def head_rows(catalog: Catalog, rule: s.Rule, scans: dict[int, DataFrame] | None = None) -> DataFrame:
    """What one rule derives, in columns c0, c1, ...; a head's wildcard is an error, its constants are constants.

    A head term `sum(X)` (a variable by its text) aggregates over the head's plain variables.
    """
    bound = conjunction.compile_body(catalog, rule.body, scans=scans)
    plain, folded = [], []
    for i, term in enumerate(rule.head.terms):
        if isinstance(term, s.Constant):
            plain.append((i, F.lit(term.value)))
        elif isinstance(term, s.Variable) and term.name in bound.columns:
            plain.append((i, F.col(bound.columns[term.name])))
        elif isinstance(term, s.Variable) and (made := folding(term.name, bound)) is not None:
            folded.append((i, made))
        else:
            raise LoomError("query.unsafe-variable", f"nothing binds a term of the head {rule.head.predicate}")
    if not folded:
        return bound.rows.select(*(c.alias(f"c{i}") for i, c in plain))
    rows = bound.rows.distinct().groupBy(*(c.alias(f"c{i}") for i, c in plain)).agg(*(c.alias(f"c{i}") for i, c in folded))
    return rows.select(*(f"c{i}" for i in range(len(rule.head.terms))))


def folding(text: str, bound: conjunction.Bound):
    name, open_, rest = text.partition("(")
    if not open_ or not rest.endswith(")"):
        return None
    arg = rest[:-1].strip()
    if arg not in ("", "*") and arg not in bound.columns:
        return None
    return values.aggregate(name.strip().replace("_", "-") if name.strip() == "count_distinct" else name.strip(), None if arg in ("", "*") else F.col(bound.columns[arg]))


def folds(rule: s.Rule) -> bool:
    return any(isinstance(t, s.Variable) and t.name.endswith(")") for t in rule.head.terms)


def swapped(rule: s.Rule, other: s.Rule) -> bool:
    """Whether the rules have one body, up to the names of variables, and heads of two variables in opposite order."""
    if not (len(rule.body) == len(other.body) and rule.head.arity == other.head.arity == 2 and all(isinstance(t, s.Variable) for r in (rule, other) for t in r.head.terms)):
        return False

    def named(r: s.Rule, terms: tuple) -> str:
        """The rule's text with its variables numbered as they appear."""
        number: dict[str, int] = {}

        def of(x):
            if isinstance(x, s.Variable):
                return s.Variable(f"v{number.setdefault(x.name, len(number))}")
            if isinstance(x, tuple):
                return tuple(map(of, x))
            return replace(x, **{f.name: of(getattr(x, f.name)) for f in fields(x) if f.name != "span"}) if is_dataclass(x) else x

        return repr((of(r.body), of(terms)))

    return named(rule, rule.head.terms) == named(other, other.head.terms[::-1])


def copies(rule: s.Rule) -> Key | None:
    """The predicate that a rule `p(x, y) :- e(x, y).` copies."""
    if len(rule.body) != 1 or not isinstance(rule.body[0], s.Atom):
        return None
    terms = rule.head.terms
    plain = rule.head.arity == 2 and all(isinstance(t, s.Variable) for t in terms) and terms[0] != terms[1]
    return key_of(rule.body[0]) if plain and rule.body[0].terms == terms else None


def closes(rule: s.Rule, key: Key, base: Key | None) -> bool:
    """Whether a rule is `p(x, z) :- q(x, y), r(y, z).` in either order, with p for one of q and r at least and the base for the other."""
    if not (len(rule.body) == 2 and all(isinstance(x, s.Atom) and x.arity == 2 and all(isinstance(t, s.Variable) for t in x.terms) for x in (rule.head, *rule.body))):
        return False
    if not {key_of(x) for x in rule.body} <= {key, base} or key not in map(key_of, rule.body):
        return False
    x, z = rule.head.terms
    return x != z and any(one.terms[0] == x and two.terms[1] == z and one.terms[1] == two.terms[0] not in (x, z) for one, two in (rule.body, rule.body[::-1]))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out.distinct()


def same_types(parts: list[DataFrame]) -> list[DataFrame]:
    """Column types of rules with one head, brought to those of the first."""
    kinds = [k for _, k in parts[0].dtypes]
    return [parts[0]] + [p.select(*(F.col(c).cast(k).alias(c) for c, k in zip(p.columns, kinds, strict=True))) for p in parts[1:]]


class Program:
    """A program over a catalog: its rules define predicates, its queries can be asked."""

    def __init__(self, catalog: Catalog, program: s.Program, max_rounds: int = MAX_ROUNDS):
        self.base, self.program, self.max_rounds = catalog, program, max_rounds
        self.catalog = catalog.copy()
        self.rules = program.of(s.Rule)
        self.rounds: dict[Key, int] = {}
        self.kept: set[Key] = set()
        #: Rows of derived predicates before repeated ones are removed, for readers to whom these make no difference.
        self.repeated: dict[Key, DataFrame] = {}
        self.groups = groups(self.rules)
        self._facts()
        self.given = {k for k in dependencies(self.rules) if k in self.catalog.relations}
        for group in self.groups:
            if group.recursive and any(folds(r) for r in self.rules if key_of(r.head) in group.predicates):
                raise LoomError("rules.unstratified", f"{group.predicates} aggregate over themselves")
        self._check_external()

    def _check_external(self) -> None:
        """Resolvers answer positive, plain bodies only."""

        def external(key: Key) -> bool:
            relation = self.catalog.relations.get(key) or self.catalog.relations.get((self.catalog.aliases.get(key[0], ""), key[1]))
            return relation is not None and relation.resolver is not None

        recursive = {k for g in self.groups if g.recursive for k in g.predicates}
        for rule in self.rules:
            reads = [key_of(x.atom if isinstance(x, s.Negation) else x) for x in rule.body if isinstance(x, s.Atom | s.Negation)]
            if not any(map(external, reads)):
                continue
            if any(isinstance(x, s.Negation) for x in rule.body):
                raise LoomError("EXTERNAL_SELECT_FACTS_UNSUPPORTED_NEGATION", f"{rule.head.predicate} negates beside an external predicate")
            if folds(rule):
                raise LoomError("EXTERNAL_SELECT_FACTS_UNSUPPORTED_AGGREGATE", f"{rule.head.predicate} aggregates an external predicate")
            if key_of(rule.head) in recursive:
                raise LoomError("EXTERNAL_SELECT_FACTS_UNSUPPORTED_RECURSION", f"{rule.head.predicate} recurs over an external predicate")

    def _facts(self) -> None:
        """Ground facts of predicates that the catalog does not have are relations of their own."""
        rows: dict[Key, list[tuple]] = {}
        for fact in self.program.of(s.Fact):
            key = key_of(fact.atom)
            if not fact.atom.compound and key not in self.catalog.relations and key[0] not in self.catalog.aliases and s.ground(fact.atom) and key[1]:
                rows.setdefault(key, []).append(tuple(t.value for t in fact.atom.terms))
        for (name, arity), found in rows.items():
            kinds = ["bigint" if all(isinstance(r[i], int) and not isinstance(r[i], bool) for r in found) else "boolean" if all(isinstance(r[i], bool) for r in found) else "string" for i in range(arity)]
            made = self.catalog.spark.createDataFrame([tuple(values.as_text(v) if k == "string" and v is not None else v for v, k in zip(r, kinds, strict=True)) for r in found], ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))).distinct()
            self.catalog.add(Relation(name, tuple(f"c{i}" for i in range(arity)), lambda made=made: made, "memory"))

    def _define(self, key: Key, rows: DataFrame) -> None:
        self.kept.discard(key)
        self.catalog.add(Relation(key[0], tuple(f"c{i}" for i in range(key[1])), lambda: rows, "derived"))

    def evaluate(self, wanted: set[Key] | None = None) -> Program:
        """Defines the derived predicates, those that the wanted ones need if these are named."""
        reads = dependencies(self.rules)
        need = set(reads) if wanted is None else set()
        todo = list(wanted or ())
        while todo:
            key = todo.pop()
            if key in reads and key not in need:
                need.add(key)
                todo += reads[key]
        for group in self.groups:
            if need & set(group.predicates):
                if not group.recursive:
                    self._once(group.predicates[0])
                elif not self._symmetric(group):
                    self._fixpoint(group)
        return self

    def _known(self, key: Key) -> list[DataFrame]:
        """Facts that the program or the catalog already has of a derived predicate."""
        relation = self.catalog.relations.get(key)
        return [relation.read().toDF(*(f"c{i}" for i in range(key[1])))] if relation is not None and relation.kind != "derived" else []

    def _once(self, key: Key) -> None:
        parts = [head_rows(self.catalog, r) for r in self.rules if key_of(r.head) == key]
        parts = same_types(self._known(key) + parts)
        self._define(key, union(parts))
        self.repeated[key] = _all(parts)

    def _halves(self, key: Key) -> list[s.Rule] | None:
        """One rule of each pair that define a symmetric predicate by swapping their heads' ends; none if it is not defined so."""
        left, found = [r for r in self.rules if key_of(r.head) == key], []
        if key in self.given or any(folds(r) for r in left):
            return None
        while left:
            rule = left.pop(0)
            other = next((r for r in left if swapped(rule, r)), None)
            if other is None:
                return None
            left.remove(other)
            found.append(rule)
        return found or None

    def _symmetric(self, group: Group) -> bool:
        """Defines a predicate that is nothing but the transitive closure of a symmetric one; False if it is something else."""
        key = group.predicates[0]
        rules = [r for r in self.rules if key_of(r.head) == key]
        exits = [r for r in rules if all(key_of(x) != key for x in r.body if isinstance(x, s.Atom))]
        base = copies(exits[0]) if len(exits) == 1 else None
        if len(group.predicates) > 1 or key in self.given or base not in self.repeated or not all(closes(r, key, base) for r in rules if r not in exits):
            return False
        halves = self._halves(base)
        if halves is None:
            return False
        parts = [head_rows(self.catalog, r, {i: self.repeated[key_of(x)] for i, x in enumerate(r.body) if isinstance(x, s.Atom) and key_of(x) in self.repeated}) for r in halves]
        if len({k for p in parts for _, k in p.dtypes}) > 1:
            return False
        self._define(key, closure.linked(_all(parts).toDF("a", "b")).toDF("c0", "c1"))
        self.rounds[key] = 0
        return True

    def _store_inputs(self, keys: set[Key], folder: str) -> None:
        """Writes the derived predicates that a fixpoint reads, so that no round computes them again."""
        for key in keys:
            relation = self.catalog.relations.get(key)
            if relation is not None and relation.kind == "derived" and key not in self.rounds and key not in self.kept:
                self._define(key, storage.stored(relation.read(), f"{folder}/input/{key[0]}-{key[1]}"))
                self.kept.add(key)

    def _fixpoint(self, group: Group) -> None:
        inside = set(group.predicates)
        rules = [r for r in self.rules if key_of(r.head) in inside]
        places = {id(r): [i for i, x in enumerate(r.body) if isinstance(x, s.Atom) and key_of(x) in inside] for r in rules}
        folder = storage.scratch(self.catalog.spark, "fixpoint")
        self._store_inputs({key_of(x.atom if isinstance(x, s.Negation) else x) for r in rules for x in r.body if isinstance(x, s.Atom | s.Negation)} - inside, folder)
        total, delta = {}, {}
        starts = {k: same_types(self._known(k) + [head_rows(self.catalog, r) for r in rules if key_of(r.head) == k and not places[id(r)]]) for k in group.predicates if self._known(k) or any(key_of(r.head) == k and not places[id(r)] for r in rules)}
        while lacking := inside - set(starts):
            # a predicate without rows of its own begins empty, with the types that its rules give it
            for key, rows in starts.items():
                self._define(key, rows[0])
            ready = next((r for r in rules if key_of(r.head) in lacking and all(key_of(r.body[at]) in starts for at in places[id(r)])), None)
            if ready is None:
                raise LoomError("rules.no-exit", f"{sorted(lacking)} have neither facts nor a rule that ends their recursion")
            starts[key_of(ready.head)] = [head_rows(self.catalog, ready).limit(0)]
        for key, parts in starts.items():
            delta[key] = storage.stored(union(parts), f"{folder}/0/{key[0]}-{key[1]}")
            total[key] = [delta[key]]
        number = 0
        while True:
            number += 1
            if number > self.max_rounds:
                raise LoomError("rules.iteration-limit", f"{sorted(inside)} found new rows in each of {self.max_rounds} rounds")
            whole = {k: _all(v) for k, v in total.items()}
            for key, rows in whole.items():
                self._define(key, rows)
            fresh = {}
            for key in group.predicates:
                parts = [head_rows(self.catalog, r, {at: delta[key_of(r.body[at])]}) for r in rules if key_of(r.head) == key for at in places[id(r)] if key_of(r.body[at]) in delta]
                if parts:
                    parts = same_types([whole[key].limit(0), *parts])[1:]
                    on = [F.col(f"n.c{i}").eqNullSafe(F.col(f"o.c{i}")) for i in range(key[1])]
                    rows = union(parts).alias("n").join(whole[key].alias("o"), on, "left_anti")
                    rows = storage.stored(rows, f"{folder}/{number}/{key[0]}-{key[1]}")
                    if not rows.isEmpty():
                        fresh[key] = rows
            if not fresh:
                break
            delta = fresh
            for key, rows in fresh.items():
                total[key].append(rows)
                if len(total[key]) > 16:
                    total[key] = [storage.stored(_all(total[key]), f"{folder}/all-{number}/{key[0]}-{key[1]}")]
        for key in group.predicates:
            self.rounds[key] = number - 1
            self._define(key, _all(total[key]))

    def ask(self, query: s.Query) -> DataFrame:
        self.evaluate({key_of(x.atom if isinstance(x, s.Negation) else x) for x in query.body if isinstance(x, s.Atom | s.Negation)})
        return conjunction.run_query(self.catalog, query)

    def answers(self) -> list[DataFrame]:
        """The rows of each query of the program."""
        return [self.ask(q) for q in self.program.of(s.Query)]

    def rows(self, name: str, arity: int, columns: list[str] | None = None) -> DataFrame:
        self.evaluate({(name, arity)})
        rows = self.catalog.resolve(name, arity).read()
        return rows.toDF(*columns) if columns else rows


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out
