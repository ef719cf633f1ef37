"""Clip a geometry to an axis-parallel box with array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridfold.functions.binding import let
from gridfold.functions.measure import vertex

_RING = "array<struct<x:double,y:double>>"
_GEOM = "struct<type:string,kinds:string,parts:array<array<array<struct<x:double,y:double>>>>>"


def _kept_side(ring: Column, axis: str, edge: Column, sign: int) -> Column:
    """Open ring cut at an axis-parallel line: every edge that passes the line gets a corner on it, then corners beyond it go.

    ``sign`` is 1 to keep the side of larger values, -1 for the other.
    """
    other = "y" if axis == "x" else "x"
    depth = lambda v: (v[axis] - edge) * sign

    def with_corner(v: Column, i: Column) -> Column:
        u = F.element_at(ring, F.when(i == 0, F.size(ring)).otherwise(i))
        share = depth(u) / (depth(u) - depth(v))
        level = u[other] + share * (v[other] - u[other])
        corner = vertex(edge, level) if axis == "x" else vertex(level, edge)
        passes = F.signum(depth(u)) * F.signum(depth(v)) < 0
        return F.when(passes, F.array(corner, v)).otherwise(F.array(v))

    return F.filter(F.flatten(F.transform(ring, with_corner)), lambda v: depth(v) >= 0)


def clip_ring(ring: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Closed ring cut to the box; empty when fewer than three corners remain."""
    none = F.array().cast(_RING)

    def opened(r: Column) -> Column:
        last = F.element_at(r, -1)
        closed = (F.size(r) > 1) & (r[0]["x"] == last["x"]) & (r[0]["y"] == last["y"])
        return F.when(closed, F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r)

    cut = let(ring, opened)
    for axis, edge, sign in (("x", xmin, 1), ("x", xmax, -1), ("y", ymin, 1), ("y", ymax, -1)):
        cut = let(cut, lambda r: _kept_side(r, axis, edge, sign))
    return let(cut, lambda r: F.when(F.size(r) >= 3, F.concat(r, F.slice(r, 1, 1))).otherwise(none))


def _segment(a: Column, b: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Part of a segment inside the box as a vertex pair, NULL when outside."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    bounds = [(dx, a["x"], xmin, xmax), (dy, a["y"], ymin, ymax)]
    enter, leave, outside = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for d, at, low, high in bounds:
        flat = d == 0
        safe = F.when(flat, F.lit(1.0)).otherwise(d)
        t_low, t_high = (low - at) / safe, (high - at) / safe
        enter.append(F.when(flat, F.lit(0.0)).otherwise(F.least(t_low, t_high)))
        leave.append(F.when(flat, F.lit(1.0)).otherwise(F.greatest(t_low, t_high)))
        outside = outside | (flat & ((at < low) | (at > high)))
    t0, t1 = F.greatest(*enter), F.least(*leave)
    at = lambda t: vertex(a["x"] + t * dx, a["y"] + t * dy)
    return F.when(~outside & (t0 <= t1), F.array(at(t0), at(t1)))


def clip_line(line: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Connected pieces of a line inside the box, as an array of lines.

    The places where a piece begins are found first, then each piece is one
    slice, so the work grows with the number of vertices.
    """
    n = F.size(line)
    cuts = F.zip_with(
        F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: _segment(a, b, xmin, ymin, xmax, ymax),
    )

    def pieces(inside: Column) -> Column:
        at = lambda i: F.element_at(inside, i)

        def begins(i: Column) -> Column:
            end, start = at(F.greatest(i - 1, F.lit(1)))[1], at(i)[0]
            return (i == 1) | (end["x"] != start["x"]) | (end["y"] != start["y"])

        places = F.filter(F.sequence(F.lit(1), F.size(inside)), begins)

        def piece(places: Column) -> Column:
            def one(first: Column, k: Column) -> Column:
                after = F.coalesce(F.get(places, k + 1), F.size(inside) + 1)
                run = F.slice(inside, first, after - first)
                return F.concat(F.array(at(first)[0]), F.transform(run, lambda s: s[1]))

            return F.transform(places, one)

        return F.when(F.size(inside) > 0, let(places, piece)).otherwise(F.array().cast(f"array<{_RING}>"))

    return let(F.filter(cuts, lambda s: s.isNotNull()), pieces)


def clip_geometry(geom: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Geometry cut to the box; NULL when nothing is left or the input is NULL.

    Every part is cut by its kind to a list of parts, and the lists are joined.
    """
    edges = (xmin, ymin, xmax, ymax)
    parts_type = f"array<array<{_RING}>>"

    def kept_point(p: Column) -> Column:
        v = p[0][0]
        inside = v["x"].between(xmin, xmax) & v["y"].between(ymin, ymax)
        return F.when(inside, F.array(p)).otherwise(F.array().cast(parts_type))

    def kept_area(p: Column) -> Column:
        # Without its outer ring a polygon is gone; holes that vanish are left out.
        rings = F.transform(p, lambda r: clip_ring(r, *edges))
        return let(
            rings,
            lambda rs: F.when(F.size(rs[0]) > 0, F.array(F.filter(rs, lambda r: F.size(r) > 0))).otherwise(
                F.array().cast(parts_type)
            ),
        )

    def cut(g: Column) -> Column:
        t = g["type"]

        def by_kind(p: Column, i: Column) -> Column:
            letter = F.substring(g["kinds"], i + 1, F.lit(1))
            return (
                F.when(t.endswith("Point") | (letter == "P"), kept_point(p))
                .when(
                    t.endswith("LineString") | (letter == "L"),
                    F.transform(clip_line(p[0], *edges), lambda piece: F.array(piece)),
                )
                .otherwise(kept_area(p))
            )

        def shaped(lists: Column) -> Column:
            letters = F.transform(
                lists, lambda ps, i: F.repeat(F.substring(g["kinds"], i + 1, F.lit(1)), F.size(ps))
            )
            kind = (
                F.when((t == "LineString") & (F.size(F.flatten(lists)) > 1), "MultiLineString").otherwise(t)
            )
            kinds = F.when(g["kinds"].isNotNull(), F.array_join(letters, ""))
            found = F.struct(kind.alias("type"), kinds.alias("kinds"), F.flatten(lists).alias("parts")).cast(_GEOM)
            return F.when(F.size(F.flatten(lists)) > 0, found)

        return let(F.transform(g["parts"], by_kind), shaped)

    return F.when(geom.isNotNull(), let(geom, cut))
