"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a shuffle of the links; no link or label goes to the driver. Steps
are written to the shared scratch folder, so lineage stays short and a lost
executor costs a task. The number of rounds grows with the logarithm of the
longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm import _common as c


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the least node reachable) for each node of a link; null ends and self links are left out."""
    spark = links.sparkSession
    folder, old = c.scratch(spark, "components"), None
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, mark, step = c.stored(edges, f"{folder}/0"), None, 0
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = down.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        edges = c.stored(small, f"{folder}/{step}")
        got = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if old:
            c.drop_path(spark, old)
        old = f"{folder}/{step - 1}"
        if mark == got:
            break
        mark = got
    nodes = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return c.stored(nodes.unionByName(roots), f"{folder}/out")
