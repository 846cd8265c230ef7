"""The graph: two sets, vertices and edges, as immutable snapshots.

Every change yields a new snapshot; nothing is collected, and a change is one
plan over the old snapshot. `save` writes a snapshot and then swaps the pointer
that names the current one, so readers see the old or the new graph, whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog import storage
from loomlog.errors import LoomError
from loomlog.functions import values
from loomlog.plans import syntax as s
from loomlog.sources.catalog import EDGE_COLUMNS, Catalog

VERTEX_SCHEMA, EDGE_SCHEMA = "id string not null", "subject_id string not null, predicate_id string not null, object_id string not null"
#: Bind parameters that one statement takes, and those of a vertex and an edge.
BATCH_PARAMETERS, VERTEX_PARAMETERS, EDGE_PARAMETERS = 60_000, 1, 3
#: Rows of a deletion that are broadcast; a larger one is shuffled.
BROADCAST_ROWS = 100_000


def check_facts(facts: Iterable, verb: str) -> list:
    facts = list(facts)
    if not facts:
        raise LoomError(f"{verb}.invalid-fact", "there are no facts")
    for fact in facts:
        parts = (fact.id,) if isinstance(fact, s.Vertex) else (fact.subject, fact.predicate, fact.object)
        if any(not isinstance(p, str) or not p.strip() for p in parts):
            raise LoomError(f"{verb}.invalid-fact", f"{fact} has a blank identifier")
    return facts


def batches(facts: Iterable, limit: int = BATCH_PARAMETERS) -> Iterator[list]:
    """Facts in order, cut where a statement's parameters would be exceeded."""
    part, size = [], 0
    for fact in facts:
        cost = VERTEX_PARAMETERS if isinstance(fact, s.Vertex) else EDGE_PARAMETERS
        if part and size + cost > limit:
            yield part
            part, size = [], 0
        part.append(fact)
        size += cost
    if part:
        yield part


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    @classmethod
    def empty(cls, spark: SparkSession) -> Graph:
        return cls(spark.createDataFrame([], VERTEX_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA))

    @classmethod
    def of(cls, vertices: DataFrame, edges: DataFrame) -> Graph:
        """From any rows: sets, with what is null or doubled left out."""
        return cls(vertices.select(F.col("id").cast("string").alias("id")).where("id IS NOT NULL").distinct(), edges.select(*(F.col(c).cast("string").alias(c) for c in EDGE_COLUMNS)).dropna().distinct())

    @classmethod
    def from_edges(cls, edges: DataFrame) -> Graph:
        return cls.of(endpoints(edges), edges)

    def catalog(self, schemas: Iterable = (), **options) -> Catalog:
        return Catalog(self.spark, self.vertices, self.edges, schemas, **options)

    def tables(self, facts: Iterable) -> tuple[DataFrame, DataFrame]:
        facts = list(facts)
        vertices = [(f.id,) for f in facts if isinstance(f, s.Vertex)]
        edges = [(f.subject, f.predicate, f.object) for f in facts if isinstance(f, s.Edge)]
        return self.spark.createDataFrame(vertices, VERTEX_SCHEMA), self.spark.createDataFrame(edges, EDGE_SCHEMA)

    def insert(self, facts: Iterable) -> Graph:
        """Adds facts that are not there yet. The ends of edges do not become vertices."""
        return self.insert_rows(*self.tables(check_facts(facts, "insert")))

    def insert_rows(self, vertices: DataFrame | None = None, edges: DataFrame | None = None) -> Graph:
        """The same from DataFrames: one union made distinct. The old rows are named once, and Catalyst flattens a chain of insertions to one union and one shuffle."""
        return Graph(_add(self.vertices, vertices, ("id",)), _add(self.edges, edges, EDGE_COLUMNS))

    def delete(self, facts: Iterable) -> Graph:
        """Removes exactly these facts; edges of a removed vertex stay."""
        facts = check_facts(facts, "delete")
        vertices, edges = self.tables(facts)
        return self.delete_rows(vertices if any(isinstance(f, s.Vertex) for f in facts) else None, edges if any(isinstance(f, s.Edge) for f in facts) else None, len(facts) <= BROADCAST_ROWS)

    def delete_rows(self, vertices: DataFrame | None = None, edges: DataFrame | None = None, small: bool = False) -> Graph:
        hint = F.broadcast if small else lambda x: x
        left = self.vertices if vertices is None else self.vertices.join(hint(vertices), "id", "left_anti")
        rest = self.edges if edges is None else self.edges.join(hint(edges), list(EDGE_COLUMNS), "left_anti")
        return Graph(left, rest)

    def close_vertices(self) -> Graph:
        """Adds the ends of all edges to the vertices."""
        return self.insert_rows(endpoints(self.edges))

    def overlay(self, facts: Iterable) -> Graph:
        """A what-if graph with further facts; this one stays as it is."""
        return self.insert(facts)

    def apply(self, facts: Iterable) -> Graph:
        """Inserts facts, which come in batches: however many these are, the old rows are met once."""
        made = [self.tables(part) for part in batches(check_facts(facts, "insert"))]
        return self.insert_rows(*(reduce(DataFrame.unionAll, kind) for kind in zip(*made, strict=True)))

    def checkpoint(self) -> Graph:
        folder = storage.scratch(self.spark, "graph")
        return Graph(storage.stored(self.vertices, f"{folder}/vertices"), storage.stored(self.edges, f"{folder}/edges"))

    def save(self, path: str) -> str:
        """Writes a snapshot below path, edges by predicate, and makes it the current one."""
        name = f"snapshot-{uuid.uuid4().hex}"
        self.vertices.write.parquet(f"{path}/{name}/vertices")
        self.edges.write.partitionBy("predicate_id").parquet(f"{path}/{name}/edges")
        _point(self.spark, path, name)
        return name

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        """The current snapshot. A constant predicate reads that predicate's files only."""
        name = json.loads(spark.read.text(f"{path}/current.json", wholetext=True).first()[0])["snapshot"]
        edges = spark.read.schema("subject_id string, object_id string, predicate_id string").parquet(f"{path}/{name}/edges")
        return cls(spark.read.schema("id string").parquet(f"{path}/{name}/vertices"), edges.select(*EDGE_COLUMNS))


def _add(old: DataFrame, new: DataFrame | None, keys: tuple[str, ...]) -> DataFrame:
    if new is None:
        return old
    return old.select(*keys).unionAll(new.select(*keys).dropna()).distinct()


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("subject_id", "object_id")).alias("id")).distinct()


def _point(spark: SparkSession, path: str, name: str) -> None:
    """Replaces the pointer by a rename, through Hadoop's file system."""
    jvm = spark._jvm
    target, hidden = (jvm.org.apache.hadoop.fs.Path(f"{path}/{x}") for x in ("current.json", f"_current-{uuid.uuid4().hex}"))
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(hidden, True)
    out.write(bytearray(json.dumps({"snapshot": name}).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(hidden), context.makeQualified(target), options)


# Compound assertions


def named_terms(atom: s.Atom) -> dict[str, s.Term]:
    found: dict[str, s.Term] = {}
    for term in atom.terms:
        if not isinstance(term, s.Named):
            raise LoomError("compound-assertion.invalid-term", f"{atom.predicate} has a term without a name")
        if term.name in found:
            raise LoomError("compound-assertion.duplicate-field", f"{atom.predicate} repeats {term.name}")
        found[term.name] = term.term
    return found


def lower_compound(fact: s.Fact, schema: s.CompoundSchema) -> list[s.Vertex | s.Edge]:
    """A compound fact as its hub vertex and an edge for each field, in the schema's order."""
    atom = fact.atom
    if atom.predicate != schema.name:
        raise LoomError("compound-assertion.schema-mismatch", f"{atom.predicate} is not {schema.name}")
    terms = named_terms(atom)
    known = {f.name for f in schema.fields} | {"cid"}
    if odd := [n for n in terms if n not in known]:
        raise LoomError("compound-assertion.unknown-field", f"{schema.name} declares no {odd[0]}")
    if "cid" not in terms:
        raise LoomError("compound-assertion.missing-cid", f"{schema.name} needs a cid")
    texts = {}
    cid = terms["cid"]
    if isinstance(cid, s.Wildcard):
        raise LoomError("compound-assertion.invalid-cid", f"the cid of {schema.name} is neither constant nor variable")
    for field in schema.fields:
        if field.name in terms:
            if not isinstance(terms[field.name], s.Constant):
                raise LoomError("compound-assertion.invalid-term", f"{field.name} of {schema.name} is no constant")
            texts[field.name] = values.as_text(terms[field.name].value)
    hub = values.as_text(cid.value) if isinstance(cid, s.Constant) else values.identity(schema, texts)
    return [s.Vertex(hub), *(s.Edge(hub, name, text) for name, text in texts.items())]


def assert_compounds(rows: DataFrame, schema: s.CompoundSchema, cid: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Compound facts from a table with a column for each field: vertices and edges. Nulls state nothing; without a cid column identities are generated, and then every field must have a value."""
    hub = F.col(f"`{cid}`").cast("string") if cid else values.identity_column(schema, {f.name: F.col(f"`{f.name}`") for f in schema.fields})
    fields = F.array(*(F.struct(F.lit(f.name).alias("predicate_id"), F.col(f"`{f.name}`").cast("string").alias("object_id")) for f in schema.fields))
    lowered = rows.select(hub.alias("subject_id"), fields.alias("fields")).where("subject_id IS NOT NULL")
    edges = lowered.select("subject_id", F.explode("fields").alias("f")).select("subject_id", "f.predicate_id", "f.object_id").dropna()
    return lowered.select(F.col("subject_id").alias("id")).distinct(), edges.distinct()


def node_summary(edges: DataFrame, label: str, classes: Iterable[str]) -> DataFrame:
    """label (the greatest where several are stated) and classes of each node that has either."""
    classes = list(classes)
    told = edges.where((F.col("predicate_id") == label) | F.col("predicate_id").isin(classes))
    is_label = F.col("predicate_id") == label
    return told.groupBy(F.col("subject_id").alias("id")).agg(F.max(F.when(is_label, F.col("object_id"))).alias("label"), F.array_sort(F.collect_set(F.when(~is_label, F.col("object_id")))).alias("classes"))


Expander = Callable[[s.Fact, s.CompoundSchema, list], "s.Edge | None"]
