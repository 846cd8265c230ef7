"""Logical plans built by hand: nodes and expressions, and the DataFrame each stands for.

Catalyst plans and optimises; these nodes only say what is meant. A shared
node (Materialize with a key) becomes one DataFrame that all its readers share.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog import storage
from loomlog.errors import LoomError
from loomlog.functions import values
from loomlog.plans.syntax import Scalar
from loomlog.sources.catalog import Catalog


@dataclass(frozen=True)
class Col:
    name: str


@dataclass(frozen=True)
class Lit:
    value: Scalar


@dataclass(frozen=True)
class Param:
    """The value at a place of the plan's parameters."""

    index: int


@dataclass(frozen=True)
class Op:
    """A comparison, or `and`, `or` and `not` over arguments."""

    operator: str
    args: tuple


@dataclass(frozen=True)
class Apply:
    name: str
    args: tuple = ()
    returns: str = "unknown"


@dataclass(frozen=True)
class Scan:
    predicate: str
    arity: int
    alias: str


@dataclass(frozen=True)
class Values:
    columns: tuple[str, ...]
    rows: tuple[tuple, ...]
    types: tuple[str, ...] = ()


@dataclass(frozen=True)
class WorkScan:
    """A relation of a fixpoint in progress; role seed, all, delta or next."""

    name: str
    role: str = "all"


@dataclass(frozen=True)
class Filter:
    child: object
    conditions: tuple


@dataclass(frozen=True)
class Join:
    """kind inner, left, semi or anti; on a list of conditions, none for a product."""

    left: object
    right: object
    conditions: tuple = ()
    kind: str = "inner"


@dataclass(frozen=True)
class Project:
    child: object
    columns: tuple[tuple[str, object], ...]


@dataclass(frozen=True)
class Distinct:
    child: object
    keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class Union:
    children: tuple
    distinct: bool = False


@dataclass(frozen=True)
class Aggregate:
    """groups may be empty; aggregates are (name, function, expression or None)."""

    child: object
    groups: tuple[str, ...]
    aggregates: tuple[tuple[str, str, object], ...]

    def __post_init__(self):
        if not self.aggregates:
            raise LoomError("plan.aggregate", "an aggregate node needs an aggregate")


@dataclass(frozen=True)
class Sort:
    """keys are (expression, "asc" or "desc", "first" or "last")."""

    child: object
    keys: tuple[tuple[object, str, str], ...]


@dataclass(frozen=True)
class Limit:
    child: object
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class Materialize:
    """strategy cte (left to Spark), temp (a stored table) or memory (cached); reason as told; key shared by equal subplans."""

    child: object
    strategy: str = "cte"
    reason: str = "shared-subplan"
    key: str = ""


JOINS = {"inner": "inner", "left": "left", "semi": "left_semi", "anti": "left_anti"}
COMPARE = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


@dataclass
class Context:
    """What a plan runs against."""

    catalog: Catalog
    parameters: tuple = ()
    work: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    shared: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.catalog.spark


def expression(node, context: Context) -> Column:
    if isinstance(node, Col):
        return F.col(f"`{node.name}`")
    if isinstance(node, Lit):
        return F.lit(node.value)
    if isinstance(node, Param):
        if node.index >= len(context.parameters):
            raise LoomError("plan.parameter", f"no parameter {node.index}")
        return F.lit(context.parameters[node.index])
    if isinstance(node, Apply):
        return values.call(node.name, [expression(a, context) for a in node.args], node.returns)
    if isinstance(node, Op):
        args = [expression(a, context) for a in node.args]
        if node.operator == "not":
            if not args:
                raise LoomError("UNSUPPORTED_LOGICAL_PLAN_NODE", "not has no argument")
            return ~args[0]
        if node.operator in ("and", "or"):
            if not args:
                return F.lit(node.operator == "and")
            out = args[0]
            for a in args[1:]:
                out = out & a if node.operator == "and" else out | a
            return out
        if node.operator in COMPARE and len(args) == 2:
            return getattr(args[0], COMPARE[node.operator])(args[1])
    raise LoomError("UNSUPPORTED_LOGICAL_PLAN_NODE", f"no expression {node!r}")


def run(node, context: Context) -> DataFrame:
    if isinstance(node, Scan):
        relation = context.catalog.resolve(node.predicate, node.arity)
        return relation.read().select(*(F.col(f"`{c}`").alias(f"{node.alias}.{c}") for c in relation.columns))
    if isinstance(node, Values):
        kinds = [values.SPARK_TYPES[t] for t in node.types] or ["string"] * len(node.columns)
        return context.spark.createDataFrame(list(node.rows), ", ".join(f"`{c}` {k}" for c, k in zip(node.columns, kinds, strict=True)))
    if isinstance(node, WorkScan):
        if (node.name, node.role) not in context.work:
            raise LoomError("plan.work", f"no work relation {node.name} in the role {node.role}")
        return context.work[node.name, node.role]
    if isinstance(node, Materialize):
        if node.key and node.key in context.shared:
            return context.shared[node.key]
        rows = run(node.child, context)
        if node.strategy == "temp":
            rows = storage.stored(rows, storage.scratch(context.spark, "materialize"))
        elif node.strategy == "memory":
            rows = rows.cache()
        if node.key:
            context.shared[node.key] = rows
        return rows
    if isinstance(node, Join):
        left, right = run(node.left, context), run(node.right, context)
        if node.kind not in JOINS:
            raise LoomError("UNSUPPORTED_LOGICAL_PLAN_NODE", f"no join {node.kind}")
        if not node.conditions:
            return left.crossJoin(right) if node.kind == "inner" else left.join(right, F.lit(True), JOINS[node.kind])
        return left.join(right, expression(Op("and", node.conditions), context), JOINS[node.kind])
    if isinstance(node, Union):
        parts = [run(c, context) for c in node.children]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionAll(part)
        return out.distinct() if node.distinct else out
    if not hasattr(node, "child"):
        raise LoomError("UNSUPPORTED_LOGICAL_PLAN_NODE", f"no node {type(node).__name__}")
    rows = run(node.child, context)
    if isinstance(node, Filter):
        return rows.where(expression(Op("and", node.conditions), context))
    if isinstance(node, Project):
        return rows.select(*(expression(e, context).alias(n) for n, e in node.columns))
    if isinstance(node, Distinct):
        return rows.dropDuplicates(list(node.keys)) if node.keys else rows.distinct()
    if isinstance(node, Aggregate):
        made = [values.aggregate(f, None if e is None else expression(e, context)).alias(n) for n, f, e in node.aggregates]
        return rows.groupBy(*(f"`{g}`" for g in node.groups)).agg(*made)
    if isinstance(node, Sort):
        return rows.orderBy(*(getattr(expression(e, context), f"{way}_nulls_{nulls}")() for e, way, nulls in node.keys))
    if isinstance(node, Limit):
        rows = rows.offset(node.offset) if node.offset else rows
        return rows if node.limit is None else rows.limit(node.limit)
    raise LoomError("UNSUPPORTED_LOGICAL_PLAN_NODE", f"no node {type(node).__name__}")


def nodes(node):
    """The node and all below it."""
    yield node
    for name in ("child", "left", "right"):
        if hasattr(node, name):
            yield from nodes(getattr(node, name))
    for child in getattr(node, "children", ()):
        yield from nodes(child)


def check_external(node, catalog: Catalog, mutation: bool = False) -> None:
    """External predicates stand only in plain queries: no mutation, aggregate or recursion."""
    found = list(nodes(node))
    external = any(isinstance(n, Scan) and catalog.resolve(n.predicate, n.arity).resolver is not None for n in found)
    if not external:
        return
    if mutation:
        raise LoomError("EXTERNAL_SELECT_FACTS_UNSUPPORTED_MUTATION", "a mutation reads an external predicate")
    if any(isinstance(n, Aggregate) for n in found):
        raise LoomError("EXTERNAL_SELECT_FACTS_UNSUPPORTED_AGGREGATE", "an aggregate reads an external predicate")
    if any(isinstance(n, WorkScan) or isinstance(n, Materialize) and n.reason == "recursive-frontier" for n in found):
        raise LoomError("EXTERNAL_SELECT_FACTS_UNSUPPORTED_RECURSION", "a recursion reads an external predicate")
