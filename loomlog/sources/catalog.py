"""The catalog: what each predicate name and arity reads.

A relation is a function that yields a DataFrame with the predicate's columns
in order; nothing is read before a query asks, so Catalyst sees one plan from
scan to result and prunes and pushes down through it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.errors import LoomError
from loomlog.functions.values import SPARK_TYPES
from loomlog.plans import syntax as s

VERTEX_COLUMNS, EDGE_COLUMNS = ("id",), ("subject_id", "predicate_id", "object_id")
#: Other names of the graph's own predicates.
GRAPH_ALIASES = {"Vertex": "vertex", "Node": "vertex", "Edge": "edge"}


@dataclass(frozen=True)
class Relation:
    """What a predicate reads. kind: table, view, work, memory, external or derived."""

    name: str
    columns: tuple[str, ...]
    read: Callable[[], DataFrame]
    kind: str = "table"
    nullable: tuple[bool, ...] = ()
    resolver: object = None

    @property
    def arity(self) -> int:
        return len(self.columns)


class Catalog:
    def __init__(self, spark: SparkSession, vertices: DataFrame | None = None, edges: DataFrame | None = None, schemas: Iterable = (), hub_filter: Callable[[s.CompoundSchema], object] | None = None):
        self.spark, self.vertices, self.edges = spark, vertices, edges
        self.relations: dict[tuple[str, int], Relation] = {}
        self.aliases = dict(GRAPH_ALIASES)
        self.builtins: dict[tuple[str, int], tuple[str, str, bool]] = {}
        self.hub_filter = hub_filter
        if vertices is not None:
            self.add(Relation("vertex", VERTEX_COLUMNS, lambda: self.vertices.select(*VERTEX_COLUMNS)))
        if edges is not None:
            self.add(Relation("edge", EDGE_COLUMNS, lambda: self.edges.select(*EDGE_COLUMNS)))
        for schema in schemas:
            self.declare(schema)

    def add(self, relation: Relation) -> Relation:
        self.relations[relation.name, relation.arity] = relation
        return relation

    def copy(self) -> Catalog:
        other = Catalog(self.spark)
        other.__dict__ |= self.__dict__ | {"relations": dict(self.relations), "aliases": dict(self.aliases), "builtins": dict(self.builtins)}
        return other

    def builtin(self, name: str, arity: int, function: str | None = None, returns: str = "unknown", test: bool = False) -> None:
        """Binds an atom to a function: its last term is the result, or with test all terms are arguments of a condition."""
        self.builtins[name, arity] = (function or name, returns, test)

    def resolve(self, name: str, arity: int) -> Relation:
        """The relation of a predicate, by its name or an alias."""
        for known in (name, self.aliases.get(name)):
            if (known, arity) in self.relations:
                return self.relations[known, arity]
        raise LoomError("UNSUPPORTED_GRAPH_PREDICATE", f"no predicate {name}/{arity}", name=name, arity=arity)

    def declare(self, schema: s.PredicateSchema | s.CompoundSchema) -> Relation:
        if isinstance(schema, s.CompoundSchema):
            return self.add(self._compound(schema))
        lower = schema.name.lower()
        if lower in ("vertex", "node"):
            return self.add(Relation(schema.name, VERTEX_COLUMNS, lambda: self.vertices.select(*VERTEX_COLUMNS)))
        if lower == "edge":
            return self.add(Relation(schema.name, EDGE_COLUMNS, lambda: self.edges.select(*EDGE_COLUMNS)))
        for kind in (schema.subject_domain, schema.object_domain):
            _known(kind)
        return self.add(Relation(schema.name, ("subject_id", "object_id"), lambda: self.edges.where(F.col("predicate_id") == schema.name).select("subject_id", "object_id")))

    def _compound(self, schema: s.CompoundSchema) -> Relation:
        """One row per hub and combination of field values; a hub without a required field has none."""
        for field in schema.fields:
            _known(field.domain)

        def read() -> DataFrame:
            hub = self.hub_filter(schema) if self.hub_filter else F.startswith("id", F.lit(f"{schema.name}:"))
            rows = self.vertices.where(hub).select(F.col("id").alias("__hub"))
            for i, field in enumerate(schema.fields):
                values = self.edges.where(F.col("predicate_id") == field.name).select(F.col("subject_id").alias("__hub"), F.col("object_id").alias(f"__f{i}"))
                rows = rows.join(values, "__hub", "inner" if field.required else "left")
            return rows.select(*(F.col(f"__f{i}").alias(f.name) for i, f in enumerate(schema.fields)))

        return Relation(schema.name, tuple(f.name for f in schema.fields), read, "view", tuple(not f.required for f in schema.fields))

    def table(self, name: str, source: DataFrame | str, columns: Iterable[str] | None = None, where: str | None = None, schema_name: str | None = None) -> Relation:
        """A table (a DataFrame, or a table's name in a schema), with a condition that holds for this scan alone."""

        def read() -> DataFrame:
            rows = source
            if isinstance(source, str):
                quoted = ".".join(f"`{x}`" for x in ([schema_name] if schema_name else []) + [source])
                rows = self.spark.table(quoted)
            return (rows.where(where) if where else rows).select(*(f"`{x}`" for x in found))

        found = tuple(columns) if columns else tuple(source.columns if isinstance(source, DataFrame) else self.spark.table(source).columns)
        return self.add(Relation(name, found, read))

    def view(self, name: str, sql: str | None = None, relation: str | None = None, columns: Iterable[str] | None = None, args: dict | None = None) -> Relation:
        """A view: its definition in SQL, or the name of one that exists."""

        def rows() -> DataFrame:
            return self.spark.sql(sql, args=args) if sql else self.spark.table(relation)

        found = tuple(columns) if columns else tuple(rows().columns)
        return self.add(Relation(name, found, lambda: rows().toDF(*found) if sql else rows().select(*found), "view"))

    def work(self, name: str, rows: DataFrame, columns: Iterable[str] | None = None, scope: str = "statement") -> Relation:
        """A work table: rows that exist for a statement, a transaction or the session; for the session it is a temporary view too."""
        if scope == "session":
            rows.createOrReplaceTempView(name)
        found = tuple(columns or rows.columns)
        return self.add(Relation(name, found, lambda: rows.select(*found), "work"))

    def memory(self, name: str, rows: list[tuple], columns: Iterable[str], types: Iterable[str] | None = None, ordered_by: Iterable[str] = ()) -> Relation:
        """Rows of the program itself. The order is that of the rows, or of the columns named; scans do not promise it further."""
        columns = tuple(columns)
        place = [columns.index(x) for x in ordered_by]
        kept = sorted(rows, key=lambda r: [r[i] for i in place]) if place else list(rows)
        kinds = [SPARK_TYPES[t] for t in types] if types else None
        schema = ", ".join(f"`{c}` {k}" for c, k in zip(columns, kinds or ["string"] * len(columns), strict=True))
        return self.add(Relation(name, columns, lambda: self.spark.createDataFrame(kept, schema), "memory"))

    def external(self, name: str, columns: Iterable[str], resolver, pushdown: Relation | None = None) -> Relation:
        """A predicate that a resolver answers; in pushdown mode a table or view that reads like any other."""
        if resolver.mode == "sql_pushdown":
            if pushdown is None or pushdown.kind not in ("table", "view"):
                raise LoomError("UNSUPPORTED_GRAPH_PREDICATE", f"{name} is pushed down, so it needs a table or view")
            return self.add(Relation(name, tuple(columns), pushdown.read, pushdown.kind, resolver=resolver))
        columns = tuple(columns)
        if unknown := [k for k in resolver.key_columns if k not in columns]:
            raise LoomError("EXTERNAL_SELECT_FACTS_INVALID_KEY_COLUMN", f"{name} has no key column {unknown[0]}")

        def read() -> DataFrame:
            raise LoomError("UNSUPPORTED_GRAPH_PREDICATE", f"{name} is read by its resolver only")

        return self.add(Relation(name, columns, read, "external", resolver=resolver))


def _known(kind: str) -> None:
    if kind not in s.DOMAINS:
        raise LoomError("schema.unsupported-scalar-domain", f"no domain {kind}")


def select_vertex(vertices: DataFrame, id: str) -> DataFrame:
    """The vertex of an id: no row or one."""
    return vertices.where(F.col("id") == id).select("id")


def select_edges(edges: DataFrame, subject: str | None = None, predicate: str | None = None, object: str | None = None) -> DataFrame:
    """Edges with the given ends; what is not given is not asked for."""
    for column, value in zip(EDGE_COLUMNS, (subject, predicate, object), strict=True):
        if value is not None:
            edges = edges.where(F.col(column) == value)
    return edges.select(*EDGE_COLUMNS)
