"""Measures of a geometry struct, written with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vertices(geom: Column) -> Column:
    return F.flatten(F.flatten(geom["parts"]))


def is_point(geom: Column) -> Column:
    return geom["type"] == "Point"


def point_x(geom: Column) -> Column:
    return geom["parts"][0][0][0]["x"]


def point_y(geom: Column) -> Column:
    return geom["parts"][0][0][0]["y"]


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def point(x: Column, y: Column) -> Column:
    """Point geometry from two numbers."""
    return F.struct(
        F.lit("Point").alias("type"),
        F.lit(None).cast("string").alias("kinds"),
        F.array(F.array(F.array(vertex(x, y)))).alias("parts"),
    )


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Axis-parallel polygon."""
    corners = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]
    return F.struct(
        F.lit("Polygon").alias("type"),
        F.lit(None).cast("string").alias("kinds"),
        F.array(F.array(F.array(*[vertex(x, y) for x, y in corners]))).alias("parts"),
    )


def line(*xy: tuple[Column, Column]) -> Column:
    """LineString through the given positions."""
    return F.struct(
        F.lit("LineString").alias("type"),
        F.lit(None).cast("string").alias("kinds"),
        F.array(F.array(F.array(*[vertex(x, y) for x, y in xy]))).alias("parts"),
    )


def bbox_of(geom: Column) -> Column:
    """Envelope; NULL for a NULL or empty geometry."""
    xs = F.transform(vertices(geom), lambda v: v["x"])
    ys = F.transform(vertices(geom), lambda v: v["y"])
    px, py = point_x(geom), point_y(geom)
    single = F.struct(px.alias("xmin"), py.alias("ymin"), px.alias("xmax"), py.alias("ymax"))
    spread = F.struct(
        F.array_min(xs).alias("xmin"),
        F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"),
        F.array_max(ys).alias("ymax"),
    )
    return F.when(geom.isNull() | (F.size(geom["parts"]) == 0), None).when(is_point(geom), single).otherwise(spread)


def _edges(ring: Column, step) -> Column:
    n = F.size(ring)
    return F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), step)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def ring_area(ring: Column) -> Column:
    """Signed shoelace area; offsets from the first vertex keep the digits."""
    o = ring[0]
    cross = _edges(ring, lambda a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"]))
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(_total(cross) / 2)


def _polygon_area(rings: Column) -> Column:
    return _total(F.transform(rings, lambda r, i: F.when(i == 0, F.abs(ring_area(r))).otherwise(-F.abs(ring_area(r)))))


def _kind(geom: Column, i: Column) -> Column:
    """P, L or A for part ``i``."""
    t = geom["type"]
    return (
        F.when(geom["kinds"].isNotNull(), F.substring(geom["kinds"], i + 1, F.lit(1)))
        .when(t.endswith("Point"), "P")
        .when(t.endswith("LineString"), "L")
        .otherwise("A")
    )


def area(geom: Column) -> Column:
    """Planar area, holes subtracted, in squared coordinate units."""
    return _total(
        F.transform(geom["parts"], lambda p, i: F.when(_kind(geom, i) == "A", _polygon_area(p)).otherwise(F.lit(0.0)))
    )


def length(geom: Column) -> Column:
    """Planar length of the line parts."""
    seg = lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])
    return _total(
        F.transform(
            geom["parts"],
            lambda p, i: F.when((_kind(geom, i) == "L") & (F.size(p[0]) > 1), _total(_edges(p[0], seg))).otherwise(
                F.lit(0.0)
            ),
        )
    )


def _moment(w: Column, x: Column, y: Column) -> Column:
    return F.struct(w.alias("w"), x.alias("x"), y.alias("y"))


def _sum_moments(values: Column) -> Column:
    zero = _moment(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return F.aggregate(values, zero, lambda s, m: _moment(s["w"] + m["w"], s["x"] + m["x"], s["y"] + m["y"]))


def _ring_moment(ring: Column, o: Column) -> Column:
    def edge(a, b):
        ax, ay, bx, by = a["x"] - o["x"], a["y"] - o["y"], b["x"] - o["x"], b["y"] - o["y"]
        cross = ax * by - bx * ay
        return _moment(cross / 2, (ax + bx) * cross / 6, (ay + by) * cross / 6)

    return _sum_moments(_edges(ring, edge))


def _signed(m: Column, sign: Column) -> Column:
    return _moment(m["w"] * sign, m["x"] * sign, m["y"] * sign)


def _polygon_moment(rings: Column, o: Column) -> Column:
    """Outer rings count positive and holes negative, whatever their winding."""
    return _sum_moments(
        F.transform(
            rings,
            lambda r, i: F.element_at(
                F.transform(
                    F.array(_ring_moment(r, o)),
                    lambda m: _signed(m, F.when(m["w"] < 0, -1.0).otherwise(1.0) * F.when(i == 0, 1.0).otherwise(-1.0)),
                ),
                1,
            ),
        )
    )


def _line_moment(ring: Column, o: Column) -> Column:
    def edge(a, b):
        w = F.hypot(b["x"] - a["x"], b["y"] - a["y"])
        return _moment(w, w * ((a["x"] + b["x"]) / 2 - o["x"]), w * ((a["y"] + b["y"]) / 2 - o["y"]))

    return _sum_moments(_edges(ring, edge))


def centroid(geom: Column) -> Column:
    """Centre of mass as a vertex: by area, else by length, else the mean of the vertices."""
    parts, o = geom["parts"], geom["parts"][0][0][0]
    by_area = _sum_moments(
        F.transform(
            parts,
            lambda p, i: F.when(_kind(geom, i) == "A", _polygon_moment(p, o)).otherwise(
                _moment(F.lit(0.0), F.lit(0.0), F.lit(0.0))
            ),
        )
    )
    by_length = _sum_moments(
        F.transform(
            F.flatten(F.filter(parts, lambda p, i: _kind(geom, i) != "P")),
            lambda r: _line_moment(r, o),
        )
    )
    every = _sum_moments(
        F.transform(vertices(geom), lambda v: _moment(F.lit(1.0), v["x"] - o["x"], v["y"] - o["y"]))
    )
    dims = F.when(geom["kinds"].isNotNull(), geom["kinds"]).otherwise(_kind(geom, F.lit(0)))

    def mean(m: Column, otherwise: Column) -> Column:
        bound = F.transform(
            F.array(m),
            lambda s: F.when(s["w"] != 0, vertex(o["x"] + s["x"] / s["w"], o["y"] + s["y"] / s["w"])),
        )
        return F.coalesce(bound[0], otherwise)

    points = mean(every, F.lit(None).cast("struct<x:double,y:double>"))
    lines = mean(by_length, points)
    return (
        F.when(F.size(parts) == 0, None)
        .when(is_point(geom), o)
        .when(F.contains(dims, F.lit("A")), mean(by_area, lines))
        .when(F.contains(dims, F.lit("L")), lines)
        .otherwise(points)
    )


def representative_point(geom: Column) -> Column:
    """The point itself, or the vertex mean of the first line or outer ring (closing vertex included)."""
    first = F.when(geom["type"] == "MultiPoint", F.transform(geom["parts"], lambda p: p[0][0])).otherwise(geom["parts"][0][0])
    n = F.size(first)
    sx, sy = _total(F.transform(first, lambda v: v["x"])), _total(F.transform(first, lambda v: v["y"]))
    zero = vertex(F.lit(0.0), F.lit(0.0))
    return F.when(F.size(geom["parts"]) == 0, zero).otherwise(vertex(sx / n, sy / n))
