"""Exact nearest-neighbour distance by descending a pyramid of grid cells.

The targets are grouped into square cells; each occupied cell is one node that
carries the tight envelope of its members, and cells nest four to one per level.
A query first takes an upper bound from the occupied cells it sits in, enters at
the level where that bound spans two cells, and goes down level by level.  A node
is dropped when its envelope is farther than the best bound of the query, so the
work per query stays small next to dense clusters of targets as well.  All steps
are equi-joins on cells and per-query minima.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfold.functions import kernel
from gridfold.functions.measure import is_point
from gridfold.plans.skew import copied_lookup, evened
from gridfold.session import stored

LEAF_ROWS = 64
MAX_DEPTH = 24
#: Node tables up to this many rows (about 60 bytes each) are broadcast; the count is measured.
BROADCAST_NODES = 200_000
#: Levels to this depth are broadcast at any size of the targets: 4 ** 8 cells are 65,536 rows at most.
SHALLOW = 8
#: Copies of a larger node or leaf table that queries are dealt over.
COPIES = 8
_BOX = ["x0", "y0", "x1", "y1"]
_SLACK = 1 + 1e-9


def _gap(a0: str, a1: str, b0: str, b1: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(b0) - F.col(a1), F.col(a0) - F.col(b1))


def _reach(a0: str, a1: str, b0: str, b1: str) -> Column:
    return F.greatest(F.col(b1) - F.col(a0), F.col(a1) - F.col(b0))


def _lower() -> Column:
    return F.hypot(_gap("x0", "x1", "nx0", "nx1"), _gap("y0", "y1", "ny0", "ny1"))


def _upper() -> Column:
    return F.hypot(_reach("x0", "x1", "nx0", "nx1"), _reach("y0", "y1", "ny0", "ny1"))


def _boxed(df: DataFrame) -> DataFrame:
    b = F.col("bbox")
    return df.where(b.isNotNull()).select(
        "fid", "geom", b["xmin"].alias("x0"), b["ymin"].alias("y0"), b["xmax"].alias("x1"), b["ymax"].alias("y1")
    )


class _Square:
    """The root square and its subdivisions."""

    def __init__(self, x: float, y: float, side: float):
        self.x, self.y, self.side = x, y, side

    def cell(self, value: Column, origin: float, depth: Column | int) -> Column:
        n = F.lit(2.0**depth) if isinstance(depth, int) else F.pow(F.lit(2.0), depth)
        c = F.floor((value - origin) / self.side * n)
        return F.greatest(F.lit(0), F.least(c, n.cast("bigint") - 1))


def _leaf_depth(items: DataFrame, sq: _Square, n: int) -> int:
    """Depth at which no leaf holds more than ``LEAF_ROWS`` targets (or the deepest there is)."""
    depth = max(0, math.ceil(math.log(max(n, 1) / (LEAF_ROWS / 8), 4)))
    while depth < MAX_DEPTH:
        depth = min(depth, MAX_DEPTH)
        fullest = (
            _leaves(items, sq, depth).groupBy("cx", "cy").count().agg(F.max("count").alias("m")).first()["m"]
        )
        if fullest <= LEAF_ROWS:
            return depth
        depth += max(1, math.ceil(math.log(fullest / LEAF_ROWS, 4)))
    return MAX_DEPTH


def _leaves(items: DataFrame, sq: _Square, depth: int) -> DataFrame:
    return items.withColumn("cx", sq.cell((F.col("nx0") + F.col("nx1")) / 2, sq.x, depth)).withColumn(
        "cy", sq.cell((F.col("ny0") + F.col("ny1")) / 2, sq.y, depth)
    )


def nearest_distance(left: DataFrame, right: DataFrame, max_distance: Column | None = None) -> DataFrame:
    """``fid, dist`` for each left feature: distance to its nearest right feature.

    Both inputs need ``fid, geom, bbox`` in the same plane.  Left rows without
    geometry, and rows beyond ``max_distance``, have no result row.
    """
    spark = left.sparkSession
    kernel.install(spark)
    queries = _boxed(left)
    targets = _boxed(right)
    stats = targets.agg(
        F.count(F.lit(1)).alias("n"),
        F.min((F.col("x0") + F.col("x1")) / 2).alias("x"),
        F.max((F.col("x0") + F.col("x1")) / 2).alias("xx"),
        F.min((F.col("y0") + F.col("y1")) / 2).alias("y"),
        F.max((F.col("y0") + F.col("y1")) / 2).alias("yy"),
        F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("extent"),
        F.coalesce(F.bool_and(is_point(F.col("geom"))), F.lit(True)).alias("points"),
    ).first()
    if not stats["n"]:
        return queries.where(F.lit(False)).select("fid", F.lit(None).cast("double").alias("dist"))
    left_stats = queries.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(is_point(F.col("geom"))), F.lit(True)).alias("points")
    ).first()
    points = stats["points"] and left_stats["points"]
    sq = _Square(stats["x"], stats["y"], max(stats["xx"] - stats["x"], stats["yy"] - stats["y"], 1e-9) * _SLACK)
    half = stats["extent"] / 2

    renamed = {c: f"n{c}" for c in _BOX}
    items = targets.withColumnsRenamed(renamed)
    items = items.select(*renamed.values(), *([] if points else [kernel.pack(F.col("geom")).alias("n_wkb")]))
    items = items.dropDuplicates(["nx0", "ny0"] if stats["points"] else ["nx0", "ny0", "nx1", "ny1", "n_wkb"])
    depth = _leaf_depth(items, sq, stats["n"])
    leaves = _leaves(items, sq, depth)

    mbr = [F.min("nx0").alias("nx0"), F.min("ny0").alias("ny0"), F.max("nx1").alias("nx1"), F.max("ny1").alias("ny1")]
    level = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    nodes = (
        leaves.groupBy("cx", "cy")
        .agg(*mbr)
        .withColumn("depth", level)
        .withColumn("cx", F.call_function("shiftright", F.col("cx"), F.lit(depth) - F.col("depth")))
        .withColumn("cy", F.call_function("shiftright", F.col("cy"), F.lit(depth) - F.col("depth")))
        .groupBy("depth", "cx", "cy")
        .agg(*mbr)
    )
    nodes = stored(nodes, "nodes", ["depth"])
    sizes = {r["depth"]: r["count"] for r in nodes.groupBy("depth").count().collect()}

    def look_up(left: DataFrame, table: DataFrame, keys: list[str], rows: int) -> DataFrame:
        """Many queries may share a cell: broadcast a small table, else deal the queries over copies."""
        if rows <= BROADCAST_NODES:
            return left.join(F.broadcast(table), keys)
        return copied_lookup(left, table, keys, F.col("fid"), COPIES)

    def at_level(left: DataFrame, d: int) -> DataFrame:
        return look_up(left, nodes.where(F.col("depth") == d).drop("depth"), ["cx", "cy"], sizes[d] if d > SHALLOW else 0)

    # Upper bound of each query from the occupied cells it sits in, every second level.
    probe = sorted({*range(depth, -1, -2), 0})
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    probes = (
        evened(queries.drop("geom"), left_stats["n"])
        .withColumn("depth", F.explode(F.array(*[F.lit(d) for d in probe])))
        .withColumn("cx", sq.cell(cx, sq.x, F.col("depth")))
        .withColumn("cy", sq.cell(cy, sq.y, F.col("depth")))
    )
    # Every query sits in the root: shallow cells, which many queries share, are looked up without a shuffle.
    low = F.col("depth") <= SHALLOW
    bounds = probes.where(low).join(F.broadcast(nodes.where(low)), ["depth", "cx", "cy"])
    deep = sum(n for d, n in sizes.items() if d > SHALLOW)
    if deep:
        found = look_up(probes.where(~low), nodes.where(~low), ["depth", "cx", "cy"], deep)
        bounds = bounds.unionByName(found.select(*bounds.columns))
    bounds = bounds.groupBy("fid", *_BOX).agg(F.min(_upper()).alias("best"))
    if max_distance is not None:
        bounds = bounds.withColumn("best", F.least(F.col("best"), max_distance))
    bounds = bounds.withColumn("best", F.col("best") * _SLACK)
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 2 * (F.col("best") + half)
    entry = F.greatest(F.lit(0), F.least(F.lit(depth), F.floor(F.log2(F.lit(sq.side) / F.greatest(span, F.lit(1e-300))))))
    entries = stored(bounds.withColumn("depth", entry.cast("int")), "entries", ["depth"])
    starts = {r["depth"] for r in entries.select("depth").distinct().collect()}
    if not starts:
        return queries.where(F.lit(False)).select("fid", F.lit(None).cast("double").alias("dist"))

    def entering(d: int) -> DataFrame:
        pad = F.col("best") + half
        out = entries.where(F.col("depth") == d).drop("depth")
        for axis, low, high, origin in (("cx", "x0", "x1", sq.x), ("cy", "y0", "y1", sq.y)):
            first, last = sq.cell(F.col(low) - pad, origin, d), sq.cell(F.col(high) + pad, origin, d)
            out = out.withColumn(axis, F.explode(F.sequence(first, last)))
        return out

    here: DataFrame | None = None
    per_query = Window.partitionBy("fid")
    for d in range(min(starts), depth + 1):
        if d in starts:
            new = entering(d)
            here = new if here is None else here.unionByName(new)
        seen = at_level(here, d).withColumn("low", _lower()).where(F.col("low") <= F.col("best"))
        seen = seen.withColumn("best", F.least(F.col("best"), F.min(_upper() * _SLACK).over(per_query)))
        here = seen.where(F.col("low") <= F.col("best")).select("fid", *_BOX, "best", "cx", "cy")
        if d < depth:
            for axis in ("cx", "cy"):
                child = F.explode(F.array(F.col(axis) * 2, F.col(axis) * 2 + 1))
                here = here.withColumn(axis, child)

    # Broadcast only points: their rows have a fixed size.
    met = look_up(here, leaves, ["cx", "cy"], stats["n"] if points else BROADCAST_NODES + 1)
    met = met.where(_lower() <= F.col("best"))
    if points:
        exact = F.hypot(F.col("x0") - F.col("nx0"), F.col("y0") - F.col("ny0"))
    else:
        shapes = queries.select("fid", kernel.pack(F.col("geom")).alias("wkb")).dropDuplicates(["fid"])
        met = met.join(shapes, "fid")
        exact = kernel.distance(F.col("wkb"), F.col("n_wkb"))
    out = met.groupBy("fid").agg(F.min(exact).alias("dist")).where(F.col("dist").isNotNull())
    return out if max_distance is None else out.where(F.col("dist") <= max_distance)
