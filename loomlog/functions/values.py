"""Scalar values: their text, identities of compounds, domains, and functions that queries may call."""

from __future__ import annotations

from collections.abc import Mapping
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomlog.errors import LoomError
from loomlog.plans import syntax as s

#: Spark's type for each scalar type of the language.
SPARK_TYPES = {"node": "string", "text": "string", "int8": "bigint", "numeric": "decimal(38,18)", "bool": "boolean", "jsonb": "string", "date": "date", "timestamp": "timestamp_ntz", "unknown": "string"}
#: Domain names that declarations may use besides the domains themselves.
ALIASES = {"graph/node": "node", "liquid/node": "node", "graph/string": "text", "liquid/string": "text", "graph/int": "int8", "liquid/int": "int8"} | {f"{p}/{d}": d for p in ("graph", "liquid") for d in ("numeric", "bool", "jsonb", "date", "timestamp")}
#: Characters besides letters and digits that percent-encoding leaves as they are.
UNRESERVED = "-_.!~*'()"


def domain(name: str) -> str | None:
    return name if name in s.DOMAINS else ALIASES.get(name)


def as_text(value: s.Scalar) -> str:
    """The text of a scalar: true, false, null, and numbers in their shortest form."""
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            return "NaN" if value != value else "Infinity" if value > 0 else "-Infinity"
        if value == int(value) and abs(value) < 1e21:
            return str(int(value))
        digits = repr(value)
        if "e" in digits:
            mantissa, _, power = digits.partition("e")
            return f"{float(value):f}".rstrip("0") if -7 < int(power) < 0 else f"{mantissa.removesuffix('.0')}e{int(power):+d}"
        return digits
    return str(value)


def identity(schema: s.CompoundSchema, values: Mapping[str, str]) -> str:
    """`Name:f1=v1,f2=v2`, fields by code point; values that hold `:` or `,` are percent-encoded."""
    parts = []
    for name in sorted((f.name for f in schema.fields), key=lambda n: n.encode("utf-16-be", "surrogatepass")):
        if name not in values:
            raise LoomError("compound.missing-field", f"{schema.name} has no value for {name}")
        value = values[name]
        parts.append(f"{name}={quote(value, safe=UNRESERVED) if ':' in value or ',' in value else value}")
    return f"{schema.name}:{','.join(parts)}"


def identity_column(schema: s.CompoundSchema, values: Mapping[str, Column]) -> Column:
    """The same identity over columns, for facts that are made by the million."""
    parts = []
    for name in sorted((f.name for f in schema.fields), key=lambda n: n.encode("utf-16-be", "surrogatepass")):
        if name not in values:
            raise LoomError("compound.missing-field", f"{schema.name} has no value for {name}")
        text = values[name].cast("string")
        coded = F.url_encode(text)
        for made, kept in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
            coded = F.replace(coded, F.lit(made), F.lit(kept))
        parts.append(F.concat(F.lit(f"{name}="), F.when(text.rlike("[:,]"), coded).otherwise(text)))
    return F.concat(F.lit(f"{schema.name}:"), F.concat_ws(",", *parts))


def fits(value: s.Scalar, kind: str, strict: bool = False) -> bool:
    """Whether a constant may stand in a domain. Strict: int8 must be integral, and null fits nowhere."""
    if kind in ("int8", "numeric"):
        number = isinstance(value, int | float) and not isinstance(value, bool)
        return number and not (strict and kind == "int8" and value != int(value))
    if kind == "bool":
        return isinstance(value, bool)
    return isinstance(value, str)


#: Built-in functions that literals may call, by name; more can be registered.
FUNCTIONS = {
    "lower": F.lower, "upper": F.upper, "trim": F.trim, "length": F.length, "concat": F.concat, "replace": F.replace, "substring": F.substr, "split": F.split, "regexp_matches": F.rlike,
    "abs": F.abs, "round": F.round, "floor": F.floor, "ceil": F.ceil, "sqrt": F.sqrt, "power": F.pow, "mod": lambda a, b: a % b, "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": lambda a, b: a / b,
    "year": F.year, "month": F.month, "day": F.dayofmonth, "date_add": F.date_add, "date_diff": F.datediff, "coalesce": F.coalesce, "greatest": F.greatest, "least": F.least, "starts_with": F.startswith, "ends_with": F.endswith, "contains": F.contains,
}
AGGREGATES = {"count": F.count, "count-distinct": F.count_distinct, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}


def call(name: str, args: list[Column], returns: str = "unknown") -> Column:
    """A registered function, else any function that Spark knows by the name."""
    made = FUNCTIONS[name](*args) if name in FUNCTIONS else F.call_function(name, *args)
    return made if returns == "unknown" else made.cast(SPARK_TYPES[returns])


def aggregate(name: str, arg: Column | None) -> Column:
    if name == "count" and arg is None:
        return F.count(F.lit(1))
    if arg is None:
        raise LoomError("aggregate.argument", f"{name} needs an argument")
    return AGGREGATES[name](arg) if name in AGGREGATES else F.call_function(name, arg)
