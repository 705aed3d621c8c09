"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hooked = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hooked.union(least.select("a", F.col("m").alias("b")))


def components(ws: Workspace, edges: DataFrame, name: str = "components") -> DataFrame:
    """edges(a long, b long), a <> b -> (node, root): root is the least node that can be reached.

    Every step is a join and a distributed minimum, so that neither a hub nor a large
    component is ever gathered in one task. Each step's edges go to a table in the shared folder.
    Nodes without an edge don't appear; no edges give no rows.
    """
    now = ws.table(edges.select("a", "b").filter("a <> b").distinct(), f"{name}-0")
    mark = F.struct(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)))
    seen, k = now.select(mark).first()[0], 0
    while seen[0]:
        k += 1
        new = ws.table(_small_star(_large_star(now).distinct()).distinct(), f"{name}-{k}")
        ws.drop(f"{name}-{k - 1}")
        now, (last, seen) = new, (seen, new.select(mark).first()[0])
        if last == seen:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
