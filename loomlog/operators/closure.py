"""Closures along one predicate: how many paths leave a root, and what it reaches.

Path counting keeps one row for each node of the frontier with the number of
paths that end there, so a round moves as many rows as there are nodes, however
many paths meet. Graphs whose edges of the predicate are few (checked by a
count) run in one task, without a round trip for each level.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog import storage
from loomlog.errors import LoomError

#: Edges of the predicate (some 100 bytes each) up to which one task takes all of them.
SMALL_EDGES, MAX_DEPTH = 1_000_000, 1000
#: Nodes of symmetric links whose roots are broadcast; more are joined by shuffles.
SMALL_NODES = 500_000


def _steps(edges: DataFrame, predicate: str) -> DataFrame:
    return edges.where(F.col("predicate_id") == predicate).select("subject_id", "object_id")


def _is_small(steps: DataFrame, limit: int) -> bool:
    return steps.limit(limit + 1).count() <= limit


def _check(root: str, predicate: str) -> None:
    if not root.strip() or not predicate.strip():
        raise LoomError("operation.invalid-shape", "root and predicate must not be blank")


def path_count(edges: DataFrame, root: str, predicate: str, max_depth: int = MAX_DEPTH, small: int = SMALL_EDGES) -> DataFrame:
    """One row, `count`: the paths of one step or more from the root. Paths without end, on a cycle, are an error at max_depth."""
    _check(root, predicate)
    steps = _steps(edges, predicate)
    if _is_small(steps, small):
        return steps.repartition(1).mapInArrow(_count_paths(root, max_depth), "count bigint").agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("count"))
    spark, folder = edges.sparkSession, storage.scratch(edges.sparkSession, "paths")
    steps = storage.stored(steps.repartition("subject_id"), f"{folder}/steps")
    frontier = spark.createDataFrame([(root, Decimal(1))], "node string, paths decimal(38,0)")
    total = 0
    for depth in range(max_depth + 1):
        after = steps.join(frontier, F.col("subject_id") == F.col("node")).groupBy(F.col("object_id").alias("node")).agg(F.sum("paths").cast("decimal(38,0)").alias("paths"))
        frontier = storage.stored(after, f"{folder}/{depth}")
        got = frontier.agg(F.sum("paths").alias("n")).first().n
        if got is None:
            return spark.createDataFrame([(int(total),)], "count bigint")
        total += got
    raise LoomError("rules.iteration-limit", f"paths from {root} go on beyond {max_depth} steps; the graph has a cycle or is deeper")


def _gather(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """Edges as numbers, sorted by their first end."""
    parts = [pa.Table.from_batches([b]) for b in batches]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), {}
    table = pa.concat_tables(parts).combine_chunks()
    both = pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks]).combine_chunks().dictionary_encode()
    both = both if isinstance(both, pa.DictionaryArray) else both.combine_chunks()
    codes = both.indices.to_numpy().astype(np.int64)
    a, b = codes[: table.num_rows], codes[table.num_rows :]
    order = np.argsort(a, kind="stable")
    return a[order], b[order], {x: i for i, x in enumerate(both.dictionary.to_pylist())}


def _targets(a: np.ndarray, b: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each edge out of the nodes: which of them, and where it leads."""
    low, high = np.searchsorted(a, nodes, "left"), np.searchsorted(a, nodes, "right")
    size = high - low
    which = np.repeat(np.arange(len(nodes)), size)
    return which, b[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())]


def _count_paths(root: str, max_depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, number = _gather(batches)
        total = 0
        if root in number:
            nodes, paths = np.array([number[root]]), np.array([1], object)
            for _ in range(max_depth + 1):
                which, to = _targets(a, b, nodes)
                if not len(to):
                    break
                nodes, inverse = np.unique(to, return_inverse=True)
                found = np.zeros(len(nodes), object)
                np.add.at(found, inverse, paths[which])
                paths = found
                total += int(paths.sum())
            else:
                raise LoomError("rules.iteration-limit", f"paths from {root} go on beyond {max_depth} steps; the graph has a cycle or is deeper")
        yield pa.RecordBatch.from_pydict({"count": pa.array([total], pa.int64())})

    return run


def reachable(edges: DataFrame, predicate: str, root: str | None = None, small: int = SMALL_EDGES) -> DataFrame:
    """(source, target) for all targets that a path of one step or more leads to; of one root, or of every node. Cycles end."""
    steps = _steps(edges, predicate).toDF("source", "target").distinct()
    if root is not None:
        _check(root, predicate)
        if _is_small(steps, small):
            return steps.repartition(1).mapInArrow(_reach(root), "source string, target string")
        seed = steps.where(F.col("source") == root)
    else:
        seed = steps
    folder = storage.scratch(edges.sparkSession, "reach")
    steps = storage.stored(steps.repartition("source"), f"{folder}/steps")
    total = [delta := storage.stored(seed, f"{folder}/0")]
    number = 0
    while True:
        number += 1
        known = _union(total)
        after = delta.select("source", F.col("target").alias("via")).join(steps.select(F.col("source").alias("via"), "target"), "via").select("source", "target").distinct()
        delta = storage.stored(after.join(known, ["source", "target"], "left_anti"), f"{folder}/{number}")
        if delta.isEmpty():
            return known
        total.append(delta)
        if len(total) > 16:
            total = [storage.stored(_union(total), f"{folder}/all-{number}")]


def _reach(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, number = _gather(batches)
        names = list(number)
        seen = np.zeros(len(names), bool)
        front = np.array([number[root]]) if root in number else np.zeros(0, np.int64)
        while len(front):
            _, to = _targets(a, b, front)
            front = np.unique(to[~seen[to]])
            seen[front] = True
        found = [names[i] for i in np.flatnonzero(seen)]
        yield pa.RecordBatch.from_pydict({"source": pa.array([root] * len(found), pa.string()), "target": pa.array(found, pa.string())})

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of a link (a, b) without nulls; the component is the least node that links lead to.

    Every node hooks to its least neighbour, chains of hooks are shortened, and
    links between different trees go to the next level, named by their roots.
    Two levels at least halve the nodes. The links are read twice and not
    stored; what is stored has a row for each node, or link between trees.
    """
    return _components(links, storage.scratch(links.sparkSession, "components"))


def _components(links: DataFrame, folder: str) -> DataFrame:
    ends = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    hooks, number = storage.stored(ends.groupBy("node").agg(F.min("root").alias("root")), f"{folder}/0"), 0
    while True:
        number += 1
        further = hooks.select(F.col("node").alias("root"), F.col("root").alias("__after"))
        longer = hooks.join(further, "root", "left").select("node", F.coalesce("__after", "root").alias("root"), (F.col("__after") < F.col("root")).alias("moved"))
        longer = storage.stored(longer, f"{folder}/{number}")
        hooks = longer.select("node", "root")
        if longer.where("moved").isEmpty():
            break
    few = _is_small(hooks, SMALL_NODES)  # links can outnumber their nodes by far, and then should not move to meet them

    def named(rows: DataFrame, end: str) -> DataFrame:
        of = hooks.select(F.col("node").alias(end), F.col("root").alias("__root"))
        return rows.join(F.broadcast(of) if few else of, end, "left").withColumn(end, F.coalesce("__root", end)).select("a", "b").distinct()

    rest = named(named(links, "b"), "a").where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rest = storage.stored(rest.distinct(), f"{folder}/rest")
    nodes = hooks.unionAll(hooks.select(F.col("root").alias("node"), "root"))
    if rest.isEmpty():
        found = nodes.withColumnRenamed("root", "component")
    else:
        above = _components(rest, f"{folder}/above").withColumnRenamed("node", "root")
        found = nodes.join(above, "root", "left").select("node", F.coalesce("component", "root").alias("component")).unionAll(above.select(F.col("root").alias("node"), "component"))
    return storage.stored(found.distinct(), f"{folder}/out")


def linked(links: DataFrame) -> DataFrame:
    """(a, b) for all ends that links (a, b), each taken both ways, lead from a to b; a node without a link has no row.

    The pairs come from a join of the components with themselves: none is
    stored or compared. A null end joins nothing, as in a rule: it leads
    to its neighbour's component, and nothing leads through it.
    """
    spark = links.sparkSession
    known = components(links.where("a IS NOT NULL AND b IS NOT NULL"))
    other = known.select(F.col("node").alias("b"), "component")
    pairs = known.select(F.col("node").alias("a"), "component").repartition(spark.sparkContext.defaultParallelism, "a").join(other, "component").select("a", "b")
    loose = links.where("a IS NULL OR b IS NULL").select(F.coalesce("a", "b").alias("node")).distinct()
    loose = storage.stored(loose, f"{storage.scratch(spark, 'components')}/loose")
    if loose.isEmpty():
        return pairs
    reached = loose.join(known, "node").select("component").distinct().join(known, "component").select("node").unionAll(loose).distinct()
    none = F.lit(None).cast(pairs.dtypes[0][1])
    return pairs.unionAll(reached.select("node", none)).unionAll(reached.where("node IS NOT NULL").select(none, "node")).unionAll(spark.range(1).select(none, none)).distinct()


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def path_count_sql(edges: DataFrame, root: str, predicate: str, max_depth: int = 100) -> DataFrame:
    """The same count by Spark's recursive SQL: one statement, paths as rows; for trees, where paths are nodes.

    LIMIT ALL lifts Spark's limit on the rows of a recursion (spark.sql.cteRecursionRowLimit, a million); a depth beyond max_depth stays an error.
    """
    _check(root, predicate)
    steps = _steps(edges, predicate)
    return edges.sparkSession.sql(
        "WITH RECURSIVE walk(node, depth) MAX RECURSION LEVEL " + str(int(max_depth)) + " AS (SELECT object_id, 1 FROM {steps} WHERE subject_id = :root UNION ALL SELECT s.object_id, w.depth + 1 FROM walk w JOIN {steps} s ON s.subject_id = w.node) SELECT count(*) AS count FROM (SELECT node FROM walk LIMIT ALL)",
        args={"root": root},
        steps=steps,
    )
