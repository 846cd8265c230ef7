"""Schema declarations in programs: DefPred and DefCompound facts."""

from __future__ import annotations

from collections.abc import Iterable

from loomlog.errors import LoomError
from loomlog.functions.values import domain
from loomlog.plans import syntax as s

DECLARATIONS = {"DefPred": 5, "DefCompound": 4}


def quoted(atom: s.Atom) -> list[str]:
    """The atom's string constants, named or not, in order."""
    terms = (t.term if isinstance(t, s.Named) else t for t in atom.terms)
    return [t.value for t in terms if isinstance(t, s.Constant) and isinstance(t.value, str)]


def predicate_schema(values: list[str]) -> s.PredicateSchema | None:
    if len(values) < 5:
        return None
    name, subject, subject_domain, object_, object_domain = values[:5]
    kinds = domain(subject_domain), domain(object_domain)
    if subject not in s.CARDINALITIES or object_ not in s.CARDINALITIES or None in kinds:
        return None
    return s.PredicateSchema(name, subject, kinds[0], object_, kinds[1])


def compound_field(values: list[str]) -> tuple[str, s.Field] | None:
    if len(values) < 4 or values[2] not in s.CARDINALITIES or domain(values[3]) is None:
        return None
    return values[0], s.Field(values[1], values[2], domain(values[3]))


def declarations(programs: Iterable[s.Program]) -> list[s.PredicateSchema | s.CompoundSchema]:
    """Predicate schemas in order, then compounds. A repeated field replaces the earlier one in its place; malformed declarations are left out."""
    predicates, compounds = [], {}
    for program in programs:
        for fact in program.of(s.Fact):
            if fact.atom.predicate == "DefPred" and (made := predicate_schema(quoted(fact.atom))):
                predicates.append(made)
            elif fact.atom.predicate == "DefCompound" and (found := compound_field(quoted(fact.atom))):
                compounds.setdefault(found[0], {})[found[1].name] = found[1]
    return predicates + [s.CompoundSchema(name, tuple(f.values())) for name, f in compounds.items()]


def checked_declarations(programs: dict[str, s.Program]) -> list[s.PredicateSchema | s.CompoundSchema]:
    """As `declarations`, but a malformed one is an error that names its migration."""
    for number, (name, program) in enumerate(programs.items()):
        for fact in program.of(s.Fact):
            kind = fact.atom.predicate
            if kind in DECLARATIONS:
                values = quoted(fact.atom)
                good = len(values) == DECLARATIONS[kind] and (predicate_schema(values) if kind == "DefPred" else compound_field(values))
                if not good:
                    raise LoomError("migrate.invalid-schema-declaration", f"{name} holds an invalid {kind}", migration=name, index=number, predicate=kind)
    return declarations(programs.values())


def by_name(schemas: Iterable, kind: type) -> dict:
    """Schemas of a kind by name; the last of a name counts."""
    return {x.name: x for x in schemas if isinstance(x, kind)}


def predicates_by_domain(schemas: Iterable, which: str) -> list[s.PredicateSchema]:
    return [x for x in schemas if isinstance(x, s.PredicateSchema) and which in (x.subject_domain, x.object_domain)]


def compounds_with_field(schemas: Iterable, name: str) -> list[s.CompoundSchema]:
    return [x for x in schemas if isinstance(x, s.CompoundSchema) and any(f.name == name for f in x.fields)]
