"""Evidence retrieval: small queries whose rows become evidence, merged, ordered and checked."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.plans import conjunction
from loomlog.sources import text
from loomlog.sources.catalog import Catalog

COLUMNS = ("evidence_id", "kind", "subject", "predicate", "object")


@dataclass(frozen=True)
class Source:
    """A query, and for each evidence column a constant, or a variable as `?name`, or `?name/last` for its last `/` part; `+` joins parts."""

    query: str
    columns: dict[str, str] = field(default_factory=dict)


def last_segment(column: Column) -> Column:
    return F.element_at(F.split(column, "/"), -1)


def _value(spec: str) -> Column:
    parts = []
    for piece in spec.split("+"):
        if piece.startswith("?"):
            name, _, how = piece[1:].partition("/")
            parts.append(last_segment(F.col(f"`{name}`")) if how == "last" else F.col(f"`{name}`").cast("string"))
        else:
            parts.append(F.lit(piece))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def retrieve(catalog: Catalog, sources: Iterable[Source], ranks: Iterable[str] = ()) -> DataFrame:
    """All sources' rows as evidence; of an id the last source's row stays (the least of its rows); in order of kind rank, then id."""
    parts = []
    for number, source in enumerate(sources):
        rows = conjunction.run_query(catalog, text.parse_query(source.query))
        parts.append(rows.select(*(_value(source.columns[c]).alias(c) if c in source.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS), F.lit(number).alias("__source")))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    place = Window.partitionBy("evidence_id").orderBy(F.desc("__source"), *(F.col(c).asc_nulls_last() for c in COLUMNS[1:]))
    kept = merged.withColumn("__place", F.row_number().over(place)).where("__place = 1").select(*COLUMNS)
    return ordered(kept, ranks)


def ordered(evidence: DataFrame, ranks: Iterable[str] = ()) -> DataFrame:
    ranks = list(ranks)
    rank = F.lit(len(ranks))
    for i, kind in reversed(list(enumerate(ranks))):
        rank = F.when(F.col("kind") == kind, i).otherwise(rank)
    return evidence.orderBy(*([rank] if ranks else []), F.lower("evidence_id"), "evidence_id")


def _ids(evidence: DataFrame, ids: Iterable[str]) -> DataFrame:
    return evidence.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")


def missing_evidence(evidence: DataFrame, required: Iterable[str]) -> DataFrame:
    """Required ids that were not retrieved."""
    return _ids(evidence, required).join(evidence.select(F.col("evidence_id").alias("id")), "id", "left_anti")


def missing_entities(evidence: DataFrame, required: Iterable[str]) -> DataFrame:
    """Required entities that are neither subject nor object of any evidence."""
    return _ids(evidence, required).join(evidence.select(F.explode(F.array("subject", "object")).alias("id")).dropna(), "id", "left_anti")


def check_citations(evidence: DataFrame, cited: Iterable[str], required: Iterable[str] = ()) -> DataFrame:
    """(id, problem): hallucinated (cited, not retrieved), uncited (retrieved, not cited), missing (required, not cited)."""
    named, needed = _ids(evidence, cited), _ids(evidence, required)
    have = evidence.select(F.col("evidence_id").alias("id")).distinct()
    parts = [(named.join(have, "id", "left_anti"), "hallucinated"), (have.join(named, "id", "left_anti"), "uncited"), (needed.join(named, "id", "left_anti"), "missing")]
    out = [rows.withColumn("problem", F.lit(what)) for rows, what in parts]
    return out[0].unionAll(out[1]).unionAll(out[2])
