"""Connected components of a graph given as an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isolens.llm.scratch import passing, saved


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the edges (a, b): one root, a vertex of it, for each component.

    At each level a vertex is mapped to the first vertex of its closed neighbourhood in a random order (a hash
    of level and id), and the edges are mapped along, until none is left.  The order makes the graph shrink by a constant
    factor on average, whatever its shape.  Only aggregations and joins by vertex; nothing reaches the driver
    but whether edges are left.
    """
    with passing(edges.sparkSession) as keep:
        edges = saved(edges.select("a", "b").filter("a <> b").distinct(), "edges")
        roots = None
        level = 0
        while roots is None or not edges.isEmpty():
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            order = lambda c: F.struct(F.xxhash64(F.lit(level), c).alias("h"), c.alias("id"))  # noqa: E731, B023
            first = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("m")).select(F.col("a").alias("v"), F.least("m", order(F.col("a")))["id"].alias("to"))
            first = saved(first, "first")
            to = lambda end: first.select(F.col("v").alias(end), F.col("to").alias(f"to_{end}"))  # noqa: E731, B023
            edges = saved(edges.join(to("a"), "a").join(to("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).filter("a <> b").distinct(), "edges")
            if roots is None:
                roots = first.select("v", F.col("to").alias("root"))
            else:
                roots = roots.join(first.select(F.col("v").alias("root"), "to"), "root", "left").select("v", F.coalesce("to", "root").alias("root"))
            level += 1
        return keep(saved(roots, "roots"))


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(v, root) after links (a, b) were added to the graph whose components roots holds."""
    of = lambda end: roots.select(F.col("v").alias(end), F.col("root").alias(f"root_{end}"))
    ends = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    merged = components(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    moved = roots.join(merged.select(F.col("v").alias("root"), F.col("root").alias("to")), "root", "left").select("v", F.coalesce("to", "root").alias("root"))
    new = merged.join(roots.select("v"), "v", "left_anti").select("v", "root")
    return saved(moved.unionByName(new), "roots")
