"""Map projections as column expressions: transverse Mercator (UTM) and Web Mercator.

The transverse Mercator series in the third flattening follows the published
Krueger expansion; four terms keep the error far below a millimetre inside a
zone.  Points are plain column arithmetic; shapes with many vertices go through
the same series in the WKB functions.  A plane is a struct column ``(lon0, y0)``: central meridian in degrees and
false northing.  A NULL plane means "stay in degrees".
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.functions import kernel, units
from gridfold.functions.measure import centroid, point, point_x, point_y, vertex

_, N3 = units.ellipsoid()
RADIUS = units.rectifying_radius()
SCALE, FALSE_EASTING, FALSE_NORTHING_SOUTH = 0.9996, 500000.0, 10000000.0
# Series coefficients as polynomials in the third flattening n.
ALPHA = [
    N3 / 2 - 2 * N3**2 / 3 + 5 * N3**3 / 16 + 41 * N3**4 / 180,
    13 * N3**2 / 48 - 3 * N3**3 / 5 + 557 * N3**4 / 1440,
    61 * N3**3 / 240 - 103 * N3**4 / 140,
    49561 * N3**4 / 161280,
]
ECC = 2 * N3**0.5 / (1 + N3)


def plane(lon0: Column, south: Column) -> Column:
    return F.struct(
        lon0.cast("double").alias("lon0"),
        F.when(south, FALSE_NORTHING_SOUTH).otherwise(0.0).alias("y0"),
    )


def plane_of(epsg: str) -> Column:
    """Plane of a UTM code, as a literal."""
    match = re.fullmatch(r"EPSG:32([67])(\d\d)", epsg.upper())
    if not match or not 1 <= int(match[2]) <= 60:
        raise ValueError(f"unsupported projection '{epsg}'")
    return plane(F.lit(units.central_meridian(int(match[2]))), F.lit(match[1] == "7"))


def _sum(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _tm_sphere(lng: Column, lat: Column, lon0: Column) -> tuple[Column, Column]:
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - ECC * F.atanh(ECC * s))
    d = F.radians(lng - lon0)
    return F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))


def _tm_plane(xi: Column, eta: Column, y0: Column) -> tuple[Column, Column]:
    k = SCALE * RADIUS
    e = _sum([eta] + [a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1)])
    n = _sum([xi] + [a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1)])
    return FALSE_EASTING + k * e, y0 + k * n


def utm_xy(lng: Column, lat: Column, pl: Column) -> tuple[Column, Column]:
    """Forward projection of one position, for scalar columns."""
    xi, eta = _tm_sphere(lng, lat, pl["lon0"])
    return _tm_plane(xi, eta, pl["y0"])


def map_vertices(geom: Column, step) -> Column:
    """The same geometry with every vertex replaced by ``step(vertex)``."""
    parts = F.transform(geom["parts"], lambda p: F.transform(p, lambda r: F.transform(r, step)))
    return F.struct(geom["type"].alias("type"), geom["kinds"].alias("kinds"), parts.alias("parts"))


def to_plane(geom: Column, pl: Column) -> Column:
    """Degrees to the metric plane; unchanged when the plane is NULL."""
    kernel.install(SparkSession.active())
    return kernel.unpack(kernel.to_plane(kernel.pack(geom), pl))


def from_plane(geom: Column, pl: Column) -> Column:
    """Metric plane back to degrees; unchanged when the plane is NULL."""
    kernel.install(SparkSession.active())
    return kernel.unpack(kernel.from_plane(kernel.pack(geom), pl))


def frame_to_plane(df: DataFrame, pl: Column) -> DataFrame:
    """``geom`` of a frame on the plane, and the plane as column ``_plane``.

    Points are computed in stages of plain columns, so generated code evaluates
    every intermediate once; other shapes go through ``to_plane``.
    """
    from gridfold.schema import computed

    g = F.col("geom")
    lon0, y0 = F.col("_plane")["lon0"], F.col("_plane")["y0"]
    staged = df.withColumn("_plane", pl).withColumn("_sin", F.sin(F.radians(point_y(g))))
    staged = staged.withColumn("_t", F.sinh(F.atanh(F.col("_sin")) - ECC * F.atanh(ECC * F.col("_sin"))))
    staged = staged.withColumn("_d", F.radians(point_x(g) - lon0))
    staged = staged.withColumn("_xi", F.atan2(F.col("_t"), F.cos(F.col("_d")))).withColumn(
        "_eta", F.atanh(F.sin(F.col("_d")) / F.sqrt(1 + F.col("_t") * F.col("_t")))
    )
    x, y = _tm_plane(F.col("_xi"), F.col("_eta"), y0)
    single = point(x, y)
    flat = (
        F.when(g.isNull(), None)
        .when(F.col("_plane").isNull(), g)
        .when(g["type"] == "Point", single)
        .otherwise(to_plane(g, F.col("_plane")))
    )
    return computed(staged, geom=flat).drop("_sin", "_t", "_d", "_xi", "_eta")


def _to_web(v: Column) -> Column:
    y = F.log(F.tan(F.lit(0.7853981633974483) + F.radians(v["y"]) / 2))
    return vertex(F.radians(v["x"]) * units.WEB_MERCATOR_RADIUS, y * units.WEB_MERCATOR_RADIUS)


def _from_web(v: Column) -> Column:
    return vertex(
        F.degrees(v["x"] / units.WEB_MERCATOR_RADIUS),
        F.degrees(F.atan(F.sinh(v["y"] / units.WEB_MERCATOR_RADIUS))),
    )


def reproject(geom: Column, source: str, target: str) -> Column:
    """Between WGS84, UTM (EPSG:326xx, 327xx) and Web Mercator (EPSG:3857); other codes raise."""
    wgs = geom
    if not units.is_wgs84(source):
        if source.upper() == "EPSG:3857":
            wgs = F.when(geom.isNotNull(), map_vertices(geom, _from_web))
        else:
            wgs = from_plane(geom, plane_of(source))
    if units.is_wgs84(target):
        return wgs
    if target.upper() == "EPSG:3857":
        return F.when(wgs.isNotNull(), map_vertices(wgs, _to_web))
    return to_plane(wgs, plane_of(target))


def to_degrees(geom: Column, code: Column) -> Column:
    """Degrees from the CRS that each row names; NULL and degree codes leave the geometry, unknown codes raise."""
    from gridfold.schema import GEOM

    name = F.upper(code)
    zone = F.regexp_extract(name, "^EPSG:32[67](0[1-9]|[1-5][0-9]|60)$", 1).try_cast("int")
    utm = plane(zone * 6.0 - 183.0, name.startswith("EPSG:327"))
    unknown = F.raise_error(F.concat(F.lit("unsupported projection "), code)).cast(GEOM)
    return (
        F.when(name.isNull() | name.isin(units.WGS84_CODES), geom)
        .when(name == "EPSG:3857", F.when(geom.isNotNull(), map_vertices(geom, _from_web)))
        .when(zone.isNotNull(), from_plane(geom, utm))
        .otherwise(unknown)
    )


def projected_zone(df: DataFrame) -> DataFrame:
    """One row: mean centroid, UTM code and plane of a dataset; code and plane NULL beyond UTM.

    The mean runs over all features with geometry, so each dataset has one zone.
    """
    c = df.where(F.col("geom").isNotNull()).select(centroid(F.col("geom")).alias("c"))
    mean = c.agg(F.avg("c.x").alias("lng"), F.avg("c.y").alias("lat"))
    epsg = units.utm_epsg(F.col("lat"), F.col("lng"))
    lon0 = units.utm_zone(F.col("lng")) * 6.0 - 183.0
    return mean.select(
        "lng", "lat", epsg.alias("epsg"), F.when(epsg.isNotNull(), plane(lon0, F.col("lat") < 0)).alias("plane")
    )


def zone_value(df: DataFrame) -> Column:
    """The zone of ``df`` as a scalar subquery, so plans stay lazy and nothing is collected."""
    zone = projected_zone(df)
    return zone.select(F.struct("lng", "lat", "epsg", "plane").alias("zone")).scalar()


def fixed_zone(df: DataFrame) -> Column:
    """The zone of ``df`` as a literal, measured by one aggregate.

    For operators that run several jobs over ``df`` anyway: a subquery would be
    computed again in each of them.
    """
    row = projected_zone(df).first()
    flat = row["plane"]
    pl = F.lit(None).cast("struct<lon0:double,y0:double>") if flat is None else plane(F.lit(flat["lon0"]), F.lit(flat["y0"] > 0))
    return F.struct(
        F.lit(row["lng"]).cast("double").alias("lng"),
        F.lit(row["lat"]).cast("double").alias("lat"),
        F.lit(row["epsg"]).cast("string").alias("epsg"),
        pl.alias("plane"),
    )
