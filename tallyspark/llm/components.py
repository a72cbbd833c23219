"""Connected components of an edge table, as DataFrame jobs.

Alternating star contraction: every round links each node's larger
neighbours to its smallest neighbour (large star), then its smaller
neighbours to the smallest (small star).  The edge count never grows and the
number of rounds is logarithmic in practice.  Minima are aggregates with
map-side combine; the join on a hub is split by adaptive execution because
one side is unique.  Each round is cut by ``checkpoint()`` in the shared
folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import checkpoint_dir


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a > b), returned as edges (a > b) again."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    j = both.join(low, "u")
    if large:
        out = j.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = j.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Self-links and repeated edges are fine; an edge with a null end is ignored;
    without edges the result is empty.
    """
    checkpoint_dir(edges.sparkSession)
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    e = e.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") > F.col("b"))).distinct().checkpoint()
    before = None
    while True:
        e = _star(_star(e, large=True), large=False).checkpoint()
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)
