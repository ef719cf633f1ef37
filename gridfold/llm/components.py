"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.plans.skew import spread
from gridfold.session import stored

#: Edges of one node from which on they are split over salts (and at least a thousandth of all edges).
HOT_EDGES = 100


def _with_least(edges: DataFrame, least: DataFrame, key: str, other: str, rows: int) -> DataFrame:
    """``edges`` with the ``m`` of their ``key``.  The edges of a star's centre are dealt over salts, its least is copied."""
    left, right, keys, _ = spread(edges, least, [key], F.col(other), F.col(key), rows, 0, HOT_EDGES)
    return left.join(right, keys)


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _with_least(both.where("v > u"), least, "u", "v", rows).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = _with_least(edges, least, "a", "b", rows).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: ``a, b`` (long, not null).  Returns ``node, root`` for every node that is not
    itself the smallest of its component; ``root`` is that smallest node.

    Each half of a round writes its edges to the shared folder, so a lost executor costs a re-read, and the
    number of rounds grows with the logarithm of the longest chain.  Loops and repeated edges are
    ignored; no edge gives an empty result.
    """
    step = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    step, seen = stored(step, "edges"), None
    rows = step.count()
    while True:
        large = stored(_large_star(step, rows), "edges")
        step = stored(_small_star(large, rows), "edges")
        sign = step.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(sign) == seen:
            return step.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, rows = tuple(sign), sign[0]
