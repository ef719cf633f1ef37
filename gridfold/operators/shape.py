"""Per-feature geometry transforms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfold.functions import kernel, units
from gridfold.functions.clip import clip_geometry
from gridfold.functions.measure import centroid as centroid_of
from gridfold.functions.measure import point
from gridfold.functions.project import zone_value
from gridfold.operators.combine import one_feature, union_tree
from gridfold.operators.distance import plane_distance
from gridfold.plans.numbering import offsets
from gridfold.plans.skew import dealt
from gridfold.schema import computed, from_wkb, with_bbox


def simplify_fraction(quad_segs: int) -> float:
    """Simplification before a dissolve, as a share of the distance: half a chord height, at least 0.5 %."""
    return max(0.5 * (1 - math.cos(math.pi / (2 * quad_segs))), 0.005)


def buffer(
    df: DataFrame,
    distance: float,
    units_: str = "meters",
    quad_segs: int = 32,
    dissolve: bool = False,
    strict: bool = False,
) -> DataFrame:
    """Area within a distance of each feature, measured in the UTM zone of the dataset.

    Outside UTM the distance is converted to degrees.  Rows without geometry
    stay, unless ``dissolve`` merges all buffers to one feature.  ``strict``
    raises when there is no row at all.
    """
    if not distance or distance <= 0:
        raise ValueError("buffer: distance must be a positive number")
    kernel.install(df.sparkSession)
    if strict and df.isEmpty():
        raise ValueError("buffer: produced no features")
    zone = zone_value(df)
    flat = dealt(df).withColumn("_plane", zone["plane"]).withColumn("_r", plane_distance(units.to_meters(distance, units_), zone))
    plane = F.col("_plane")
    grown = kernel.buffer(kernel.to_plane(kernel.pack(F.col("geom")), plane), F.col("_r"), quad_segs)
    if not dissolve:
        return from_wkb(flat, kernel.from_plane(grown, plane))
    tolerance = F.col("_r") * simplify_fraction(quad_segs)
    shaped = computed(flat.where(F.col("geom").isNotNull()), wkb=kernel.repair(kernel.simplify(grown, tolerance)))
    # The envelope only places a shape in the union tree, so that of the unbuffered feature will do.
    one = union_tree(shaped.select("wkb", "bbox")).withColumn("_plane", zone["plane"])
    return one_feature(one.select(kernel.from_plane(F.col("wkb"), F.col("_plane")).alias("wkb")))


def centroid(df: DataFrame) -> DataFrame:
    """Centre of mass of each feature; rows without geometry are dropped."""
    c = centroid_of(F.col("geom"))
    out = df.where(F.col("geom").isNotNull()).withColumn("_c", c)
    return with_bbox(out.withColumn("geom", point(F.col("_c.x"), F.col("_c.y"))))


def _by_kernel(df: DataFrame, step) -> DataFrame:
    kernel.install(df.sparkSession)
    shape = F.when(F.col("geom").isNotNull(), kernel.unpack(step(kernel.pack(F.col("geom")))))
    return with_bbox(df.withColumn("geom", shape))


def simplify(df: DataFrame, tolerance: float) -> DataFrame:
    """Fewer vertices within a tolerance in coordinate units."""
    return _by_kernel(df, lambda wkb: kernel.simplify(wkb, F.lit(float(tolerance))))


def make_valid(df: DataFrame) -> DataFrame:
    """Repaired topology; valid shapes are unchanged."""
    return _by_kernel(df, kernel.repair)


def clip_to_bbox(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Geometry cut to a box; NULL where nothing is left."""
    box = [F.lit(float(v)) for v in (xmin, ymin, xmax, ymax)]
    return with_bbox(df.withColumn("geom", clip_geometry(F.col("geom"), *box)))


def _class() -> Column:
    """The class of the part at ``part`` of ``geom``."""
    t = F.col("geom.type")
    kind = (
        F.when(t.endswith("Point"), "point").when(t.endswith("LineString"), "line").when(t.endswith("Polygon"), "polygon")
    )
    listed = F.when(F.substring(F.col("geom.kinds"), F.col("part") + 1, F.lit(1)) == "P", "point").when(
        F.substring(F.col("geom.kinds"), F.col("part") + 1, F.lit(1)) == "L", "line"
    )
    return F.coalesce(kind, listed, F.lit("polygon"))


def explode_vertices(df: DataFrame) -> DataFrame:
    """One row per vertex: class, feature, part, ring and position."""
    parts = df.where(F.col("geom").isNotNull()).select("fid", "geom", F.posexplode("geom.parts").alias("part", "rings"))
    classed = parts.select("fid", _class().alias("class"), "part", "rings")
    rings = classed.select("fid", "class", "part", F.posexplode("rings").alias("ring", "vertices"))
    return rings.select("fid", "class", "part", "ring", F.posexplode("vertices").alias("idx", "v")).select(
        "fid", "class", "part", "ring", "idx", F.col("v.x").alias("x"), F.col("v.y").alias("y")
    )


def vertex_arrays(df: DataFrame) -> DataFrame:
    """``explode_vertices`` with places in flat arrays, one array a class: ``feature`` (number of the feature among all
    with geometry), ``single`` (number of the part within its class), ``part_start`` and ``ring_start`` (the
    first vertex of the part and the ring within its class) and ``vertex`` (the vertex's own place).

    Numbers follow the order in which the input is written once.  They come from sums per partition and
    offsets of these; within a feature, windows over its own rings.  No task sees all rows.
    """
    g, listed = F.col("geom"), {"P": "point", "L": "line", "A": "polygon"}
    kind = F.when(g["type"].endswith("Point"), "P").when(g["type"].endswith("LineString"), "L").when(g["type"].endswith("Polygon"), "A")
    kinds = F.transform(g["parts"], lambda _, i: F.coalesce(kind, F.substring(g["kinds"], i + 1, F.lit(1))))
    sizes = F.transform(g["parts"], lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda n, r: n + F.size(r)))
    pairs = F.arrays_zip(kinds.alias("k"), sizes.alias("n"))
    total = lambda k, what: F.aggregate(F.filter(pairs, lambda p: p["k"] == k), F.lit(0).cast("bigint"), lambda n, p: n + what(p))
    weights = {"feature": F.lit(1).cast("bigint")}
    for k in listed:
        weights |= {f"vertices_{k}": total(k, lambda p: p["n"]), f"singles_{k}": total(k, lambda _: F.lit(1))}
    placed = offsets(df.where(g.isNotNull()).select("fid", "geom"), **weights).repartition("feature")
    parts = placed.select("fid", "feature", kinds.alias("kinds"), *[c for c in weights if c != "feature"], F.posexplode("geom.parts").alias("part", "rings"))
    of = lambda what: F.coalesce(*[F.when(F.col("k") == k, F.col(f"{what}_{k}")) for k in listed])
    parts = parts.withColumn("k", F.get("kinds", F.col("part"))).select("fid", "feature", "part", "k", of("vertices").alias("v0"), of("singles").alias("s0"), F.posexplode("rings").alias("ring", "vertices"))
    # Within a feature: earlier parts of the class, and earlier rings.
    own = Window.partitionBy("feature", "k").orderBy("part", "ring")
    before = F.coalesce(F.sum(F.size("vertices")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rings = parts.withColumn("ring_start", F.col("v0") + before).withColumn("single", F.col("s0") + F.dense_rank().over(Window.partitionBy("feature", "k").orderBy("part")) - 1)
    rings = rings.withColumn("part_start", F.min("ring_start").over(Window.partitionBy("feature", "part")))
    name = F.coalesce(*[F.when(F.col("k") == k, F.lit(v)) for k, v in listed.items()]).alias("class")
    rows = rings.select("fid", "feature", name, "part", "single", "part_start", "ring", "ring_start", F.posexplode("vertices").alias("idx", "v"))
    return rows.select("fid", "feature", "class", "part", "single", "part_start", "ring", "ring_start", "idx", (F.col("ring_start") + F.col("idx")).alias("vertex"), F.col("v.x").alias("x"), F.col("v.y").alias("y"))


def numeric_properties(df: DataFrame) -> DataFrame:
    """``key, numeric``: whether every present value of a key is a number (all rows are looked at)."""
    pairs = df.where(F.col("properties").isNotNull()).select(
        F.explode(F.from_json(F.col("properties"), "map<string,string>")).alias("key", "value")
    )
    return pairs.groupBy("key").agg(
        F.coalesce(F.bool_and(F.col("value").try_cast("double").isNotNull()), F.lit(False)).alias("numeric")
    )

