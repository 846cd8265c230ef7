"""Migrations: committed, hash-checked program files, the working file, the ledger, and their application to a graph.

These files are small and belong to the driver; what they state goes to the
graph as DataFrames.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.errors import LoomError
from loomlog.functions import values
from loomlog.operators.graph import Expander, Graph, lower_compound
from loomlog.plans import syntax as s
from loomlog.sources import schema as schemas
from loomlog.sources import text

#: Fixed values of the workspace: names, metadata lines, and what a fresh working file says.
FOLDER, CURRENT, LEDGER = "migrations", "current.dl", "_applied_migrations"
PREVIOUS, DIGEST = "% migration.previous:", "% migration.sha256:"
FRESH = "% Current mutable ontology working area.\n"
FILE_NAME = re.compile(r"(\d{8})\.(\d{4})\.[a-z0-9-]+\.dl")
LEDGER_SCHEMA = "migration_file_name string, applied_at timestamp"


def meaningful(body: str) -> bool:
    return any(line.strip() and not line.strip().startswith("%") for line in body.split("\n"))


def sha256(body: str) -> str:
    return hashlib.sha256(body.encode("utf-8")).hexdigest()


@dataclass(frozen=True)
class Migration:
    name: str
    path: Path
    previous: str | None
    sha256: str
    body: str


def read_migration(path: Path) -> Migration:
    """A committed file, once its metadata and hash are checked."""
    lines = path.read_text(encoding="utf-8").split("\n")
    found = []
    for line, mark in zip([*lines[:2], "", ""], (PREVIOUS, DIGEST), strict=False):
        if not line.startswith(mark):
            raise LoomError("migrate.missing-metadata", f"{path.name} has no line {mark}")
        found.append(line[len(mark) :].strip())
    rest = lines[2:]
    body = "\n".join(rest[1:] if rest[:1] == [""] else rest)
    body = body if body.endswith("\n") else body + "\n"
    if sha256(body) != found[1]:
        raise LoomError("migrate.hash-mismatch", f"{path.name} is not what was committed")
    return Migration(path.name, path, None if found[0] == "none" else found[0], found[1], body)


@dataclass(frozen=True)
class Status:
    code: str
    committed: int
    current_changes: bool
    latest: str | None
    pending: bool | None


class Workspace:
    def __init__(self, root: str | Path):
        self.root = Path(root)
        self.folder, self.current = self.root / FOLDER, self.root / CURRENT

    def names(self) -> list[str]:
        found = self.folder.iterdir() if self.folder.is_dir() else ()
        return sorted(p.name for p in found if p.is_file() and FILE_NAME.fullmatch(p.name))

    def committed(self, check_chain: bool = False) -> list[Migration]:
        found = [read_migration(self.folder / n) for n in self.names()]
        if check_chain:
            for before, one in zip([None, *found], found, strict=False):
                if one.previous != (before.name if before else None):
                    raise LoomError("migrate.broken-chain", f"{one.name} follows {one.previous}, not {before.name if before else None}")
        return found

    def init(self) -> bool:
        """Makes the folder and the working file; tells whether both were there."""
        there = self.folder.is_dir() and self.current.exists()
        if self.names() and not self.current.exists():
            raise LoomError("migrate.init", f"{FOLDER}/ holds committed files, but {CURRENT} is missing")
        self.folder.mkdir(parents=True, exist_ok=True)
        if not self.current.exists():
            self.current.write_text(FRESH, encoding="utf-8")
        return there

    def commit(self, slug: str = "current", now: datetime | None = None) -> Migration:
        """Moves the working file's text into a new committed file."""
        before = self.committed()
        body = self.current.read_text(encoding="utf-8")
        body = body if body.endswith("\n") else body + "\n"
        if any(line.startswith((PREVIOUS, DIGEST)) for line in body.split("\n")):
            raise LoomError("migrate.embedded-metadata", f"{CURRENT} has metadata lines of a committed file")
        if not meaningful(body):
            raise LoomError("migrate.empty", f"{CURRENT} states nothing")
        name = self.next_name([m.name for m in before], slug, now)
        self.folder.mkdir(parents=True, exist_ok=True)
        (self.folder / name).write_text(f"{PREVIOUS} {before[-1].name if before else 'none'}\n{DIGEST} {sha256(body)}\n\n{body}", encoding="utf-8")
        self.current.write_text(FRESH, encoding="utf-8")
        return read_migration(self.folder / name)

    @staticmethod
    def next_name(names: Iterable[str], slug: str = "current", now: datetime | None = None) -> str:
        day = (now or datetime.now(UTC)).astimezone(UTC).strftime("%Y%m%d")
        last = max((int(m[2]) for n in names if (m := FILE_NAME.fullmatch(n)) and m[1] == day), default=0)
        plain = re.sub(r"[^a-z0-9]+", "-", slug.lower()).strip("-") or "current"
        return f"{day}.{last + 1:04d}.{plain}.dl"

    def uncommit(self) -> Migration:
        """Moves the newest committed file back into the working file, which must state nothing."""
        if meaningful(self.current.read_text(encoding="utf-8")):
            raise LoomError("migrate.current-not-empty", f"{CURRENT} holds work; commit or clear it first")
        found = self.committed()
        if not found:
            raise LoomError("migrate.nothing-committed", "there is no committed file")
        newest = found[-1]
        if newest.previous != (found[-2].name if len(found) > 1 else None):
            raise LoomError("migrate.broken-chain", f"{newest.name} does not follow the file before it")
        self.current.write_text(newest.body, encoding="utf-8")
        newest.path.unlink()
        return newest

    def status(self, applied: Iterable[str] | None = None) -> Status:
        found = self.committed()
        changed = self.current.exists() and meaningful(self.current.read_text(encoding="utf-8"))
        waiting = None if applied is None else reconcile([m.name for m in found], applied)
        if changed:
            code = "committed-and-current" if found else "current-uncommitted"
        elif not found:
            code = "clean"
        elif waiting is None:
            code = "committed-pending-unknown"
        else:
            code = "committed-pending" if waiting else "committed-applied"
        pending = bool(waiting) if waiting is not None else None if found else False
        return Status(code, len(found), changed, found[-1].name if found else None, pending)


def reconcile(committed: Iterable[str], applied: Iterable[str]) -> list[str]:
    """Committed files that were not applied, in order."""
    done = set(applied)
    return [n for n in committed if n not in done]


def validate(program: s.Program, declared: Iterable) -> None:
    """Edge facts of declared predicates and domains; compound facts of declared fields, as often as these allow."""
    predicates, compounds = schemas.by_name(declared, s.PredicateSchema), schemas.by_name(declared, s.CompoundSchema)
    for fact in program.of(s.Fact):
        atom = fact.atom
        if atom.predicate == "Edge" and atom.arity == 3 and not atom.compound:
            name = atom.terms[1]
            if isinstance(name, s.Constant) and isinstance(name.value, str):
                if name.value not in predicates:
                    raise LoomError("migrate.missing-schema", f"no DefPred declares {name.value}", predicate=name.value)
                schema = predicates[name.value]
                _domain(atom.terms[0], schema.subject_domain, f"the subject of {name.value}")
                _domain(atom.terms[2], schema.object_domain, f"the object of {name.value}")
        elif atom.compound and atom.predicate != "DefCompound":
            if atom.predicate not in compounds:
                raise LoomError("migrate.missing-schema", f"no DefCompound declares {atom.predicate}", predicate=atom.predicate)
            _compound(atom, compounds[atom.predicate])


def _compound(atom: s.Atom, schema: s.CompoundSchema) -> None:
    fields, counts = {f.name: f for f in schema.fields}, {}
    for term in atom.terms:
        if not isinstance(term, s.Named):
            continue
        if term.name == "cid":
            _domain(term.term, "node", f"the cid of {schema.name}")
        elif term.name not in fields:
            raise LoomError("migrate.invalid-fact", f"{schema.name} declares no field {term.name}")
        else:
            counts[term.name] = counts.get(term.name, 0) + 1
            _domain(term.term, fields[term.name].domain, f"{term.name} of {schema.name}")
    for field in schema.fields:
        n = counts.get(field.name, 0)
        if field.required and not n:
            raise LoomError("migrate.invalid-fact", f"{schema.name} lacks its field {field.name}")
        if not field.repeatable and n > 1:
            raise LoomError("migrate.invalid-fact", f"{schema.name} repeats its field {field.name}")


def _domain(term, kind: str, what: str) -> None:
    if not isinstance(term, s.Constant):
        raise LoomError("migrate.invalid-fact", f"{what} is no constant")
    if not values.fits(term.value, kind):
        raise LoomError("migrate.invalid-fact", f"{what} is not in the domain {kind}")


def facts_of(programs: dict[str, s.Program], expander: Expander | None = None, expand_compounds: bool = False) -> tuple[list, list]:
    """Schemas, and the facts of all programs: explicit ones, back links of compounds, and with expand_compounds their own hubs and fields."""
    declared = schemas.checked_declarations(programs)
    compounds = schemas.by_name(declared, s.CompoundSchema)
    facts: list = []
    for program in programs.values():
        validate(program, declared)
        facts += text.extract_facts(program)
        for fact in program.of(s.Fact):
            if fact.atom.compound and fact.atom.predicate != "DefCompound":
                if expand_compounds:
                    facts += lower_compound(fact, compounds[fact.atom.predicate])
                if expander is not None and (edge := expander(fact, compounds[fact.atom.predicate], declared)) is not None:
                    facts.append(edge)
    return declared, list(dict.fromkeys(facts))


@dataclass(frozen=True)
class Applied:
    graph: Graph
    ledger: DataFrame
    schemas: list
    applied: list[str]


def apply(graph: Graph, migrations: Iterable[Migration], ledger: DataFrame | None = None, expander: Expander | None = None, expand_compounds: bool = False, now: datetime | None = None) -> Applied:
    """Applies all committed files (again; facts are sets): a graph that holds their facts and the ends of their edges, and the ledger with their names."""
    migrations = list(migrations)
    declared, facts = facts_of({m.name: text.parse_program(m.body) for m in migrations}, expander, expand_compounds)
    ends = [s.Vertex(i) for f in facts if isinstance(f, s.Edge) for i in (f.subject, f.object)]
    every = list(dict.fromkeys([f for f in facts if isinstance(f, s.Vertex)] + ends + [f for f in facts if isinstance(f, s.Edge)]))
    after = graph.apply(every) if every else graph
    names = [m.name for m in migrations]
    return Applied(after, record(graph.spark, ledger, names, now), declared, names)


def record(spark: SparkSession, ledger: DataFrame | None, names: Iterable[str], now: datetime | None = None) -> DataFrame:
    """The ledger with further names; those it has keep their time."""
    when = (now or datetime.now(UTC)).astimezone(UTC).replace(tzinfo=None)
    new = spark.createDataFrame([(n, when) for n in dict.fromkeys(names)], LEDGER_SCHEMA)
    return new if ledger is None else ledger.unionByName(new.join(ledger, "migration_file_name", "left_anti"))


def applied_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a stored ledger, in order; none where it does not exist."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return []
    rows = spark.read.schema(LEDGER_SCHEMA).parquet(path)
    return [r[0] for r in rows.orderBy(F.col("migration_file_name")).select("migration_file_name").collect()]
