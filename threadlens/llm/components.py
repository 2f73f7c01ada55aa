"""Connected components of an edge table by alternating large-star and small-star steps.

Each step joins every edge with the smallest neighbour of one of its ends. Only joins and
grouped minima are used, so no component is ever collected; a hub with many edges is reduced
before the shuffle, and skewed joins are split at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import discard, store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or smaller) neighbours to the least node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    j = both.join(least, "u")
    if large:
        out = j.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = j.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _is_star(edges: DataFrame) -> bool:
    """Whether each node that has a smaller one has only that, which has none itself."""
    ends = edges.select(F.col("a").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        edges.select(F.col("b").alias("k"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    by = ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return by.where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)``, stored: root is the smallest node reachable.

    Nodes without an edge are not listed; loops and repeated edges do no harm; no edge gives no
    row. The edge table shrinks to one star per component; the loop ends when it is one.
    """
    edges = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not _is_star(edges):
        last, edges = edges, store(_star(_star(edges, True), False), "edges")
        discard(last)
    out = store(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "components")
    discard(edges)
    return out
