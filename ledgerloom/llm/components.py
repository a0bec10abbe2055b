"""Connected components by alternating stars, with every step a Spark aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.store import scratch, written


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node that has an edge; root is the component's smallest node.

    ``edges`` has two columns of one orderable type; direction, repeats and loops
    do not matter, null ends are ignored, no edges give no rows. Each round links
    the larger neighbours of every node to the smallest one (large star), then the
    smaller neighbours (small star), until only stars around smallest nodes are left. A node's
    neighbours are only ever reduced to their minimum, never gathered.
    """
    a, b = edges.columns
    flat = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    with scratch(edges.sparkSession):
        now = written(_starred(written(flat.where("u > v").distinct(), "edges")), "stars", outlives=True)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _starred(now: DataFrame) -> DataFrame:
    while not _stars(now):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = small.union(down.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        now = written(step, "edges")
    return now


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one smaller node at most, which itself hangs on none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    counts = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return counts.where("hangs + holds > 1 and hangs > 0").isEmpty()
