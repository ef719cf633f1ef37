"""Intersection, difference and containment of two feature frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.functions import kernel
from gridfold.functions.measure import is_point
from gridfold.plans.grid import CellJoin, anchored, exists_join, fetched, keyed, profiles, some_of
from gridfold.schema import COLUMNS, computed, with_bbox
from gridfold.session import stored

CLIP_TOLERANCE = 0.0003
SUBTRACT_TOLERANCE = 1e-7


def _same_point(a, b) -> Column:
    return (a("_px") == b("_px")) & (a("_py") == b("_py"))


def _points(a, b) -> Column:
    return a("_px").isNotNull() & b("_px").isNotNull()


def intersects_test(a, b) -> Column:
    """The shapes share at least one point."""
    return F.when(_points(a, b), _same_point(a, b)).otherwise(kernel.intersects(a("_wkb"), b("_wkb")))


def contains_test(a, b) -> Column:
    """b lies in a and not only on its boundary."""
    return F.when(_points(a, b), _same_point(a, b)).otherwise(kernel.contains(a("_wkb"), b("_wkb")))


def _mode(op: str, mode: str, legal: tuple[str, str]) -> None:
    if mode not in legal:
        raise ValueError(f"{op}: mode must be one of {legal}")


def _mask_shape(tolerance: float) -> Column:
    return kernel.repair(kernel.simplify(kernel.pack(F.col("geom")), F.lit(tolerance)))


def _masks(a: DataFrame, b: DataFrame, tolerance: float, hot_rows: int | None) -> tuple[DataFrame, DataFrame, int]:
    """Anchored rows of a; per row the union of the (simplified, repaired) b shapes that meet it; the size of b.

    Only b shapes that meet a row can change it, so one mask per row equals one
    mask for all.  The union aggregate combines before the shuffle, so a row
    that meets very many shapes is not gathered as a list.  Unless a side is broadcast, cells
    join row numbers and envelopes only, and each shape that has a candidate is fetched (and simplified) afterwards.
    """
    kernel.install(a.sparkSession)
    shape = _mask_shape(tolerance)
    rows = anchored(a)
    measured = profiles((rows, None), (b, None))
    if any(p.small for p in measured):
        join = CellJoin(keyed(rows), b, right_shape=shape, hot_rows=hot_rows, measured=measured)
        join.points = False
        join.left = join.left.withColumn("_wkb", kernel.pack(F.col("geom")))
        join.right = join.right.withColumn("_wkb", shape)
        met = join.pairs(lambda p, q: kernel.intersects(p("_wkb"), q("_wkb")))
    else:
        others = anchored(b)
        join = CellJoin(keyed(rows), keyed(others), hot_rows=hot_rows, shapes=False, measured=measured)
        near = stored(join.pairs(lambda p, q: F.lit(True)).select("fid", "bfid"), "candidates")
        n = near.count()
        near = fetched(near, others.select(F.col("_row").alias("bfid"), shape.alias("b_wkb")), "bfid", "fid", n, hot_rows)
        met = fetched(stored(near, "candidates"), rows.select(F.col("_row").alias("fid"), kernel.pack(F.col("geom")).alias("_wkb")), "fid", "bfid", n, hot_rows)
        met = met.where(kernel.intersects(F.col("_wkb"), F.col("b_wkb")))
    masks = met.groupBy(F.col("fid").alias("_row")).agg(kernel.union_agg(F.col("b_wkb")).alias("_mask"))
    return rows, masks, measured[1].rows


def intersection(a: DataFrame, b: DataFrame, mode: str = "filter", hot_rows: int | None = None) -> DataFrame:
    """``filter``: rows of a that meet b.  ``clip``: those rows cut to what b covers."""
    _mode("intersection", mode, ("filter", "clip"))
    if mode == "filter":
        return exists_join(a, b, intersects_test, hot_rows=hot_rows, touch=True)
    kernel.install(a.sparkSession)
    rows, single = anchored(a), is_point(F.col("geom"))
    kinds = {r["single"] for r in rows.where(F.col("bbox").isNotNull()).select(single.alias("single")).distinct().collect()}
    # What is left of a point is the point, so it needs one partner and no mask of all of them.
    points = exists_join(some_of(rows, single), b, intersects_test, hot_rows=hot_rows, right_shape=_mask_shape(CLIP_TOLERANCE), touch=True)
    if kinds == {True}:
        return points if points.columns == COLUMNS else points.select(*COLUMNS)
    shapes = _clipped(some_of(rows, ~single), b, hot_rows)
    return shapes.unionByName(points.select(*COLUMNS)) if True in kinds else shapes


def _clipped(a: DataFrame, b: DataFrame, hot_rows: int | None) -> DataFrame:
    rows, masks, _ = _masks(a, b, CLIP_TOLERANCE, hot_rows)
    cut = rows.join(masks, "_row").withColumn("_cut", kernel.intersection(kernel.pack(F.col("geom")), F.col("_mask")))
    return with_bbox(cut.withColumn("geom", kernel.unpack(F.col("_cut"))))


def difference(a: DataFrame, b: DataFrame, mode: str = "subtract", hot_rows: int | None = None) -> DataFrame:
    """``exclude``: rows of a that meet no b (rows without geometry stay).

    ``subtract``: rows of a without the part b covers; rows covered completely
    and rows without geometry are dropped, and an empty b gives an empty result.
    """
    _mode("difference", mode, ("exclude", "subtract"))
    if mode == "exclude":
        return exists_join(a, b, intersects_test, anti=True, hot_rows=hot_rows, touch=True)
    rows, masks, b_rows = _masks(a, b, SUBTRACT_TOLERANCE, hot_rows)
    spatial = rows.where(F.col("geom").isNotNull())
    if b_rows == 0:
        return a.where(F.lit(False))
    left = spatial.join(masks, "_row", "left")
    rest = kernel.difference(kernel.pack(F.col("geom")), F.col("_mask"))
    cut = computed(left, _cut=F.when(F.col("_mask").isNotNull(), rest))
    kept = cut.where(F.col("_mask").isNull() | ~kernel.is_empty(F.col("_cut")))
    geom = F.when(F.col("_mask").isNull(), F.col("geom")).otherwise(kernel.unpack(F.col("_cut")))
    return with_bbox(kept.withColumn("geom", geom))


def contains(a: DataFrame, b: DataFrame, mode: str = "filter", hot_rows: int | None = None) -> DataFrame:
    """``filter``: rows of a that contain some b.  ``within``: rows of b inside some a."""
    _mode("contains", mode, ("filter", "within"))
    if mode == "filter":
        return exists_join(a, b, contains_test, hot_rows=hot_rows)
    return exists_join(b, a, lambda inner, outer: contains_test(outer, inner), hot_rows=hot_rows)
