"""External predicates: resolvers that a query pushes down, materialises before it runs, or hydrates its result from.

Providers are asked on the driver, once for a request, with distinct keys:
key tuples are made distinct by Spark, and at most KEY_LIMIT of them may come
to the driver. Beyond that a provider must be a table (push it down) or answer
in batches on the executors (`batch_rows`, which gets one Arrow batch of keys
at a time and has no limit).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from loomlog import storage
from loomlog.errors import LoomError
from loomlog.functions.values import SPARK_TYPES
from loomlog.plans import conjunction
from loomlog.plans import syntax as s
from loomlog.sources.catalog import Catalog, Relation

#: What each mode can do: push down, materialise before the query, hydrate after it.
MODES = {"sql_pushdown": (True, False, False), "materialize_before_sql": (False, True, False), "post_query_hydrate": (False, False, True)}
RUNTIME_CODES = ("EXTERNAL_PROVIDER_TIMEOUT", "EXTERNAL_PROVIDER_FAILURE", "EXTERNAL_DUPLICATE_KEY", "EXTERNAL_ROW_SHAPE_MISMATCH")
REQUEST_ID, DEDUPE_SCOPE = "prepared-select-facts", "request"
KEY_LIMIT = 1_000_000


@dataclass(frozen=True)
class Request:
    """What a provider is asked: key tuples for a lookup, rows of keys for hydration."""

    predicate: str
    columns: tuple[str, ...]
    key_columns: tuple[str, ...]
    keys: tuple[dict, ...]
    hydrated_field: str | None = None
    request_id: str = REQUEST_ID
    dedupe_scope: str = DEDUPE_SCOPE


@dataclass(frozen=True)
class Failure:
    """A provider's way to say that it failed, with one of RUNTIME_CODES."""

    code: str
    message: str


Provider = Callable[[Request], "list[dict] | Failure"]


@dataclass(frozen=True)
class Resolver:
    mode: str
    provider: str
    key_columns: tuple[str, ...]
    materialize_rows: Provider | None = None
    hydrate_rows: Provider | None = None
    hydrated_field: str | None = None
    column_types: dict[str, str] | None = None
    batch_rows: Callable[[pa.Table], pa.Table] | None = None

    def __post_init__(self):
        if self.mode not in MODES:
            raise LoomError("EXTERNAL_RESOLVER_INVALID_HANDLER_COMBINATION", f"no mode {self.mode}")
        if not self.key_columns or len(set(self.key_columns)) < len(self.key_columns):
            raise LoomError("EXTERNAL_RESOLVER_INVALID_KEY_COLUMNS", f"key columns must be unique: {self.key_columns}")
        hydrates = self.mode == "post_query_hydrate"
        if hydrates != bool(self.hydrated_field and self.hydrated_field.strip()) or not hydrates and self.hydrated_field is not None:
            raise LoomError("EXTERNAL_RESOLVER_INVALID_HYDRATED_FIELD_NAME", "a hydrated field belongs to post_query_hydrate, which needs one")
        materializes = self.mode == "materialize_before_sql"
        if materializes != bool(self.materialize_rows or self.batch_rows) or hydrates != bool(self.hydrate_rows):
            raise LoomError("EXTERNAL_RESOLVER_INVALID_HANDLER_COMBINATION", f"the handlers do not fit {self.mode}")

    def type_of(self, column: str) -> str:
        return SPARK_TYPES[(self.column_types or {}).get(column, "text")]


def distinct_keys(rows: DataFrame, what: str) -> list[dict]:
    found = rows.distinct().limit(KEY_LIMIT + 1).collect()
    if len(found) > KEY_LIMIT:
        raise LoomError("EXTERNAL_PROVIDER_FAILURE", f"{what} is asked for more than {KEY_LIMIT} keys; push it down or give batch_rows")
    return [r.asDict() for r in found]


def check_rows(rows: list[dict], keys: list[dict], key_columns: tuple[str, ...], columns: tuple[str, ...] | None, what: str) -> None:
    asked = {tuple(k[c] for c in key_columns) for k in keys}
    seen = set()
    for row in rows:
        if columns is not None and set(row) != set(columns) or not set(key_columns) <= set(row):
            raise LoomError("EXTERNAL_ROW_SHAPE_MISMATCH", f"{what} gave the columns {sorted(row)}")
        key = tuple(row[c] for c in key_columns)
        if key not in asked:
            raise LoomError("EXTERNAL_PROVIDER_FAILURE", f"{what} gave a row for {key}, which was not asked for")
        if key in seen:
            raise LoomError("EXTERNAL_DUPLICATE_KEY", f"{what} gave two rows for {key}")
        seen.add(key)


def answered(made: list[dict] | Failure, what: str) -> list[dict]:
    if isinstance(made, Failure):
        code = made.code if made.code in RUNTIME_CODES else "EXTERNAL_PROVIDER_FAILURE"
        raise LoomError(code, f"{what}: {made.message}")
    return made


class Prepared:
    """A query with its external atoms told apart: those to materialise, and those to hydrate from."""

    def __init__(self, catalog: Catalog, query: s.Query):
        self.catalog, self.query = catalog, query
        if not query.body:
            raise LoomError("query.empty-body", "the query has no literal")
        relations = [catalog.resolve(x.predicate, x.arity) if isinstance(x, s.Atom) else catalog.resolve(x.atom.predicate, x.atom.arity) if isinstance(x, s.Negation) else None for x in query.body]
        if any(r is not None and r.resolver is not None for r in relations) and any(isinstance(x, s.Negation) for x in query.body):
            raise LoomError("EXTERNAL_SELECT_FACTS_UNSUPPORTED_NEGATION", "an external predicate stands only among positive literals")
        mode = lambda r: r.resolver.mode if r is not None and r.resolver is not None else None
        self.materialized = [(i, query.body[i], r) for i, r in enumerate(relations) if mode(r) == "materialize_before_sql"]
        self.hydrated = [(query.body[i], r) for i, r in enumerate(relations) if mode(r) == "post_query_hydrate"]
        self.body = tuple(x for x, r in zip(query.body, relations, strict=True) if mode(r) != "post_query_hydrate")
        if not any(isinstance(x, s.Atom) for x in self.body):
            raise LoomError("UNSUPPORTED_GRAPH_PREDICATE", "nothing is left for the engine to read")
        for x in self.body:
            if isinstance(x, s.Atom):
                conjunction.check_terms(x, False)
        self._check_keys()

    def _check_keys(self) -> None:
        for place, atom, relation in self.materialized:
            earlier = {v for x in self.query.body[:place] if isinstance(x, s.Atom) and (x, self.catalog.resolve(x.predicate, x.arity)) not in self.hydrated for v in s.variables(x)}
            for key in relation.resolver.key_columns:
                term = atom.terms[relation.columns.index(key)]
                if not isinstance(term, s.Constant) and not (isinstance(term, s.Variable) and term.name in earlier):
                    raise LoomError("EXTERNAL_SELECT_FACTS_UNBOUND_MATERIALIZATION_KEY", f"nothing before {atom.predicate} binds its key {key}")
        projected = set(self.query.project or conjunction.output(self.body))
        for atom, relation in self.hydrated:
            for key in relation.resolver.key_columns:
                term = atom.terms[relation.columns.index(key)]
                if not isinstance(term, s.Variable) or term.name not in projected:
                    raise LoomError("EXTERNAL_SELECT_FACTS_UNPROJECTED_HYDRATION_KEY", f"{atom.predicate} needs its key {key} among the query's variables")

    def run(self, load_rows: Provider | None = None, hydrate_rows: Provider | None = None) -> DataFrame:
        """The result. Handlers given here take the place of the resolvers' for this run."""
        catalog = self.catalog.copy()
        scans: dict[int, DataFrame] = {}
        kept = {id(x): i for i, x in enumerate(self.body)}
        for place, atom, relation in self.materialized:
            before = tuple(x for x in self.query.body[:place] if id(x) in kept)
            rows = self._materialize(catalog, atom, relation, before, scans, kept, load_rows)
            at = kept[id(atom)]
            catalog.work(f"prepared_{atom.predicate}_{place + 1}", rows, relation.columns)
            scans[at] = rows
        query = s.Query(self.body, self.query.project, self.query.limit, self.query.offset)
        readable = catalog.copy()
        for _, atom, relation in self.materialized:
            readable.add(Relation(relation.name, relation.columns, relation.read, "work"))
        bound = conjunction.compile_body(readable, self.body, scans=scans)
        rows = project(bound, query)
        for atom, relation in self.hydrated:
            rows = hydrate(rows, atom, relation, hydrate_rows)
        return rows

    def _materialize(self, catalog: Catalog, atom: s.Atom, relation: Relation, before: tuple, scans: dict, kept: dict, load_rows: Provider | None) -> DataFrame:
        resolver, what = relation.resolver, f"{atom.predicate}/{atom.arity}"
        terms = {k: atom.terms[relation.columns.index(k)] for k in resolver.key_columns}
        if any(isinstance(t, s.Variable) for t in terms.values()):
            prefix = conjunction.compile_body(catalog, before, scans={i: scans[kept[id(x)]] for i, x in enumerate(before) if kept[id(x)] in scans})
            asked = prefix.rows.select(*(conjunction.value(t, prefix).cast(resolver.type_of(k)).alias(k) for k, t in terms.items()))
        else:
            asked = catalog.spark.createDataFrame([tuple(t.value for t in terms.values())], ", ".join(f"`{k}` {resolver.type_of(k)}" for k in terms))
        schema = StructType([StructField(c, _parse_datatype_string(resolver.type_of(c))) for c in relation.columns])
        if resolver.batch_rows is not None and load_rows is None:
            return self._in_batches(asked.distinct(), resolver, relation, schema, what)
        keys = distinct_keys(asked, what)
        if not keys:
            return catalog.spark.createDataFrame([], schema)
        request = Request(atom.predicate, relation.columns, resolver.key_columns, tuple(keys))
        rows = answered((load_rows or resolver.materialize_rows)(request), what)
        if not rows:
            raise LoomError("EXTERNAL_PROVIDER_FAILURE", f"{what} gave no rows for {len(keys)} keys")
        check_rows(rows, keys, resolver.key_columns, relation.columns, what)
        return catalog.spark.createDataFrame([tuple(r[c] for c in relation.columns) for r in rows], schema)

    def _in_batches(self, asked: DataFrame, resolver: Resolver, relation: Relation, schema: StructType, what: str) -> DataFrame:
        """Rows from a provider that runs on the executors; stored, so it is asked once."""
        ask, names = resolver.batch_rows, list(relation.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield from ask(pa.Table.from_batches([batch])).select(names).to_batches()

        rows = storage.stored(asked.mapInArrow(run, schema), storage.scratch(asked.sparkSession, "provider"))
        if not rows.groupBy(*resolver.key_columns).count().where("count > 1").isEmpty():
            raise LoomError("EXTERNAL_DUPLICATE_KEY", f"{what} gave two rows for a key")
        on = [F.col(f"r.`{k}`").eqNullSafe(F.col(f"a.`{k}`")) for k in resolver.key_columns]
        if not rows.alias("r").join(asked.alias("a"), on, "left_anti").isEmpty():
            raise LoomError("EXTERNAL_PROVIDER_FAILURE", f"{what} gave a row for a key that was not asked for")
        return rows


def project(bound: conjunction.Bound, query: s.Query) -> DataFrame:
    names = list(query.project or conjunction.output(query.body))
    if not names:
        return bound.rows.select(F.lit(1).alias(conjunction.TRUTH)).limit(1)
    rows = bound.rows.select(*(F.col(bound.columns[n]) for n in names)).distinct()
    if query.limit is not None or query.offset is not None:
        rows = rows.orderBy(*(F.col(c).asc_nulls_last() for c in rows.columns)).offset(query.offset or 0)
        rows = rows.limit(query.limit) if query.limit is not None else rows
    return rows.select(*(F.col(bound.columns[n]).alias(n) for n in names))


def hydrate(rows: DataFrame, atom: s.Atom, relation: Relation, override: Provider | None = None) -> DataFrame:
    """rows with one more column, the provider's payload for each row's key: a value, or a struct of several.

    Every key must have one payload; a null key is a key like others. Rows are neither dropped nor doubled.
    """
    resolver, what = relation.resolver, f"{atom.predicate}/{atom.arity}"
    names = {k: atom.terms[relation.columns.index(k)].name for k in resolver.key_columns}
    keys = distinct_keys(rows.select(*(F.col(f"`{n}`").alias(k) for k, n in names.items())), what)
    payload = [c for c in relation.columns if c not in names]
    if keys:
        request = Request(atom.predicate, relation.columns, resolver.key_columns, tuple(keys), resolver.hydrated_field)
        made = answered((override or resolver.hydrate_rows)(request), what)
        check_rows(made, keys, resolver.key_columns, None, what)
        have = {tuple(r[k] for k in names) for r in made}
        if missing := [k for k in keys if tuple(k.values()) not in have]:
            raise LoomError("EXTERNAL_PROVIDER_FAILURE", f"{what} has no payload for {missing[0]}")
        found = sorted({c for r in made for c in r} - set(names))
        if not found or any(set(r) != set(names) | set(found) for r in made):
            raise LoomError("EXTERNAL_ROW_SHAPE_MISMATCH", f"{what} gave rows without payload, or of several shapes")
        payload = [c for c in payload if c in found] + [c for c in found if c not in payload]
    else:
        made = []
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`__k_{k}` {kinds[n]}" for k, n in names.items()] + [f"`{c}` {resolver.type_of(c)}" for c in payload])
    table = rows.sparkSession.createDataFrame([tuple(r[k] for k in names) + tuple(r[c] for c in payload) for r in made], schema)
    value = F.col(f"`{payload[0]}`") if len(payload) == 1 else F.struct(*(F.col(f"`{c}`") for c in payload))
    table = table.select(*(f"`__k_{k}`" for k in names), value.alias("__payload"))
    on = [F.col(f"`{n}`").eqNullSafe(F.col(f"`__k_{k}`")) for k, n in names.items()]
    small = F.broadcast(table) if len(made) <= 100_000 else table
    return rows.join(small, on, "left").select(*(F.col(f"`{c}`") for c in rows.columns), F.col("__payload").alias(resolver.hydrated_field))
