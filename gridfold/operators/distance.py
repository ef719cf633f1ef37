"""Distance filter and nearest-distance annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.functions import kernel, units
from gridfold.functions.project import fixed_zone, frame_to_plane
from gridfold.functions.props import merge_properties
from gridfold.plans.grid import anchored, exists_join, keyed
from gridfold.plans.nearest import nearest_distance
from gridfold.schema import COLUMNS, with_bbox


def _on_plane(df: DataFrame, plane: Column) -> DataFrame:
    return with_bbox(frame_to_plane(df, plane))


def plane_distance(meters: float, zone: Column) -> Column:
    """A metric distance in plane units: metres, or degrees where there is no UTM zone."""
    degrees = units.meters_to_degrees(F.lit(float(meters)), zone["lat"])
    return F.when(zone["plane"].isNull(), degrees).otherwise(F.lit(float(meters)))


def within_test(limit: Column):
    def test(a, b) -> Column:
        points = a("_px").isNotNull() & b("_px").isNotNull()
        flat = F.hypot(a("_px") - b("_px"), a("_py") - b("_py"))
        return F.when(points, flat).otherwise(kernel.distance(a("_wkb"), b("_wkb"))) <= limit

    return test


def distance(
    a: DataFrame,
    b: DataFrame,
    mode: str = "filter",
    max_distance: float | None = None,
    units_: str = "meters",
    hot_rows: int | None = None,
) -> DataFrame:
    """``filter``: rows of a within ``max_distance`` of some b.

    ``annotate``: rows of a with the distance to the nearest b as property
    ``dist_<unit>``, rounded to one decimal, optionally cut off at
    ``max_distance``.  Distances are planar in the UTM zone of a.
    """
    if mode not in ("filter", "annotate"):
        raise ValueError("distance: mode must be 'filter' or 'annotate'")
    if max_distance is not None and max_distance <= 0:
        raise ValueError("distance: max_distance must be positive")
    if mode == "filter" and max_distance is None:
        raise ValueError("distance: filter mode needs max_distance")
    rows = anchored(a)
    zone = fixed_zone(rows)
    limit = None if max_distance is None else plane_distance(units.to_meters(max_distance, units_), zone)
    flat_a, flat_b = _on_plane(keyed(rows), zone["plane"]), _on_plane(b, zone["plane"])
    if mode == "filter":
        return exists_join(flat_a, flat_b, within_test(limit), grow=limit, payload=rows, hot_rows=hot_rows)
    found = nearest_distance(flat_a, flat_b, limit)
    per_degree = units.degrees_to_meters(F.lit(1.0), zone["lat"])
    scale = F.when(zone["plane"].isNull(), per_degree).otherwise(F.lit(1.0)) / units.to_meters(1.0, units_)
    rounded = F.round(F.col("dist") * scale, 1)
    patch = F.to_json(F.struct(rounded.alias(f"dist_{units.unit_suffix(units_)}")))
    joined = rows.join(found.select(F.col("fid").alias("_row"), patch.alias("_patch")), "_row")
    return joined.withColumn("properties", merge_properties(F.col("properties"), F.col("_patch"))).select(*COLUMNS)
