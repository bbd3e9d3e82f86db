"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pricepanel.session import stage


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node it reaches) for every node of a link (a, b); self-links are ignored.

    Each round first moves the larger neighbours of a node to its smallest
    neighbour, then the smaller ones, until every node points at its root: a number
    of rounds that grows with the logarithm of the size. A round's links are
    written out, so a lost executor costs at most one round, and what is written tells whether the round changed
    anything. Minima are aggregated before the shuffle and joined back, so a node with very many links is not gathered.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, mark = stage(edges, "links"), None
    while True:
        # u > v in every link; a node's smallest neighbour counts only if it is smaller than the node
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("m", "v").alias("w"))
        moved = moved.repartition("u")  # serves the minima and the join that takes them back
        least = moved.groupBy("u").agg(F.min("w").alias("m"))
        both = moved.join(least, "u").select(F.explode(F.array(F.struct(F.col("w").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        seen = Observation()
        after = both.select("e.u", "e.v").where("u <> v").distinct()
        after = after.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        edges = stage(after, "links")
        if seen.get == mark:
            break
        mark = seen.get
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components of earlier links, given as ``roots``, and of new ``links`` (a, b) together; a written table.

    Only links between different roots are contracted, and the roots are mapped once.
    """
    if roots is None:
        return stage(components(links), "roots")
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    joined = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    new = components(joined.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    new = stage(new, "roots")
    old = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stage(old.unionByName(new.join(roots.select("node"), "node", "left_anti").select("node", "root")), "roots")
