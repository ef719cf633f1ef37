"""GeoJSON and WKT text to geometry structs and back, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridfold.functions.binding import let
from gridfold.functions.measure import vertex

# Geometry type names of GeoJSON and their WKT spellings.
TYPES = ["Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon"]
COLLECTION = "GeometryCollection"

_PARTS = "array<array<array<struct<x:double,y:double>>>>"
_GEOM = f"struct<type:string,kinds:string,parts:{_PARTS}>"
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_WKT_TYPE = "(?:MULTI)?(?:POINT|LINESTRING|POLYGON)"
_NESTED = r"\((?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*\)"


def _at(text: Column, depth: int) -> Column:
    """Coordinate JSON text as an array nested ``depth`` deep over numeric strings."""
    schema = "string"
    for _ in range(depth):
        schema = f"array<{schema}>"
    return F.from_json(text, schema)


def _vertex(p: Column) -> Column:
    return vertex(F.get(p, F.lit(0)).try_cast("double"), F.get(p, F.lit(1)).try_cast("double"))


def _parts(kind: Column, coords: Column) -> Column:
    """Nested position arrays to ``parts``; extra ordinates are dropped."""
    ring = lambda r: F.transform(r, _vertex)
    return (
        F.when(kind == "Point", F.array(F.array(F.array(_vertex(_at(coords, 1))))))
        .when(kind == "MultiPoint", F.transform(_at(coords, 2), lambda p: F.array(F.array(_vertex(p)))))
        .when(kind == "LineString", F.array(F.array(ring(_at(coords, 2)))))
        .when(kind == "MultiLineString", F.transform(_at(coords, 3), lambda r: F.array(ring(r))))
        .when(kind == "Polygon", F.array(F.transform(_at(coords, 3), ring)))
        .when(kind == "MultiPolygon", F.transform(_at(coords, 4), lambda p: F.transform(p, ring)))
    )


def _checked(parts: Column) -> Column:
    """NULL unless there is at least one vertex and every vertex is a number pair."""
    flat = F.flatten(F.flatten(parts))
    good = (F.size(flat) > 0) & F.forall(flat, lambda v: v["x"].isNotNull() & v["y"].isNotNull())
    return F.when(good, parts)


def _geom(kind: Column, kinds: Column, parts: Column) -> Column:
    """Geometry from bound parts, NULL when they are NULL."""
    return F.when(parts.isNotNull(), F.struct(kind.alias("type"), kinds.alias("kinds"), parts.alias("parts"))).cast(_GEOM)


def _simple(kind: Column, coords: Column) -> Column:
    none = F.lit(None).cast("string")
    return let(
        F.struct(kind.alias("kind"), coords.alias("coords")),
        lambda s: let(_parts(s["kind"], s["coords"]), lambda parts: _geom(s["kind"], none, _checked(parts))),
    )


def _gather(members: Column) -> Column:
    """One collection from an array of simple geometries; one bad member spoils it."""
    letter = lambda g: (
        F.when(g["type"].endswith("Point"), "P").when(g["type"].endswith("LineString"), "L").otherwise("A")
    )

    def whole(ms: Column) -> Column:
        kinds = F.array_join(F.flatten(F.transform(ms, lambda g: F.transform(g["parts"], lambda p: letter(g)))), "")
        good = (F.size(ms) > 0) & F.forall(ms, lambda g: g.isNotNull())
        parts = F.flatten(F.transform(ms, lambda g: g["parts"]))
        return F.when(good, F.struct(F.lit(COLLECTION).alias("type"), kinds.alias("kinds"), parts.alias("parts"))).cast(_GEOM)

    return let(members, whole)


def _body(text: Column) -> Column:
    """The geometry of a Feature wrapper, or the text itself."""
    wrapper = F.get_json_object(text, "$.type") == "Feature"
    return F.when(wrapper, F.get_json_object(text, "$.geometry")).otherwise(text)


def parse_geojson(text: Column, collections: bool = False) -> Column:
    """GeoJSON geometry (or Feature wrapper) text to a geometry struct, NULL when it is neither.

    A GeometryCollection has no ``coordinates`` member; it is read only on request.
    """

    def simple(body: Column, kind: Column) -> Column:
        return F.when(kind.isin(TYPES), _simple(kind, F.get_json_object(body, "$.coordinates")))

    def any_kind(body: Column, kind: Column) -> Column:
        members = F.transform(
            F.from_json(F.get_json_object(body, "$.geometries"), "array<string>"),
            lambda g: _simple(F.get_json_object(g, "$.type"), F.get_json_object(g, "$.coordinates")),
        )
        return F.when(kind == COLLECTION, _gather(members)).otherwise(simple(body, kind))

    rule = any_kind if collections else simple
    return let(
        text, lambda t: let(_body(t), lambda b: let(F.get_json_object(b, "$.type"), lambda kind: rule(b, kind)))
    )


def _wkt_type(text: Column) -> Column:
    return F.upper(F.regexp_extract(text, rf"(?i)^\s*({_WKT_TYPE}|GEOMETRYCOLLECTION)\s*(?:ZM|Z|M)?\s*\(", 1))


def _wkt_coords(text: Column, kind: Column) -> Column:
    """The parenthesised part of WKT as coordinate JSON."""
    body = F.regexp_extract(text, r"(?s)(\(.*\))", 1)
    bare = F.regexp_replace(body, r"\(\s*([^(),]+?)\s*\)", "$1")
    body = F.when(kind == "MULTIPOINT", F.concat(F.lit("("), F.regexp_replace(bare, r"^\(|\)$", ""), F.lit(")"))).otherwise(body)
    pairs = F.regexp_replace(body, rf"({_NUMBER})\s+({_NUMBER})(?:\s+{_NUMBER})*", '["$1","$2"]')
    return F.translate(pairs, "()", "[]")


def _wkt_simple(text: Column) -> Column:
    spelled = F.create_map(*[F.lit(v) for name in TYPES for v in (name.upper(), name)])

    def build(t: Column, upper: Column) -> Column:
        kind = F.try_element_at(spelled, upper)
        coords = _wkt_coords(t, upper)
        bare = F.when(upper == "POINT", F.regexp_replace(coords, r"^\[\s*|\s*\]$", "")).otherwise(coords)
        return F.when(upper != "", _simple(kind, bare))

    return let(text, lambda t: let(_wkt_type(t), lambda upper: build(t, upper)))


def parse_wkt(text: Column) -> Column:
    """WKT to a geometry struct; EMPTY, unknown types and bad numbers give NULL."""

    def collection(t: Column) -> Column:
        inner = F.regexp_extract(t, r"(?s)\((.*)\)", 1)
        pattern = F.lit(rf"(?i)({_WKT_TYPE}\s*(?:ZM|Z|M)?\s*{_NESTED})")
        return _gather(F.transform(F.regexp_extract_all(inner, pattern, F.lit(1)), _wkt_simple))

    return let(
        text, lambda t: F.when(_wkt_type(t) == "GEOMETRYCOLLECTION", collection(t)).otherwise(_wkt_simple(t))
    )


def is_wkt(text: Column) -> Column:
    return text.rlike(rf"(?is)^\s*({_WKT_TYPE}|GEOMETRYCOLLECTION)\s*(?:\b(?:ZM|Z|M)\b)?\s*(\(.*|EMPTY\s*)$") | text.rlike(
        rf"(?is)^\s*({_WKT_TYPE}|GEOMETRYCOLLECTION)(?:ZM|Z|M)\s*(\(.*|EMPTY\s*)$"
    )


def is_geojson(text: Column) -> Column:
    known = lambda b: (
        F.get_json_object(b, "$.type").isin([*TYPES, COLLECTION]) & F.get_json_object(b, "$.coordinates").isNotNull()
    )
    return F.coalesce(let(text, lambda t: F.trim(t).startswith("{") & let(_body(t), known)), F.lit(False))


def parse_geometry(text: Column) -> Column:
    """WKT or GeoJSON text, whichever parses."""
    return let(text, lambda t: F.when(F.trim(t).startswith("{"), parse_geojson(t)).otherwise(parse_wkt(t)))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v.cast("string"), r"\.0$", "")


def wkt_of(geom: Column) -> Column:
    """Geometry struct to WKT."""
    return let(geom, _wkt_text)


def _wkt_text(geom: Column) -> Column:
    ring = lambda r: F.concat(
        F.lit("("),
        F.array_join(F.transform(r, lambda v: F.concat(_digits(v["x"]), F.lit(" "), _digits(v["y"]))), ", "),
        F.lit(")"),
    )
    polygon = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")"))
    listed = lambda each: F.concat(F.lit("("), F.array_join(F.transform(geom["parts"], each), ", "), F.lit(")"))
    member = F.transform(
        geom["parts"],
        lambda p, i: F.when(F.substring(geom["kinds"], i + 1, F.lit(1)) == "P", F.concat(F.lit("POINT "), ring(p[0])))
        .when(F.substring(geom["kinds"], i + 1, F.lit(1)) == "L", F.concat(F.lit("LINESTRING "), ring(p[0])))
        .otherwise(F.concat(F.lit("POLYGON "), polygon(p))),
    )
    t = geom["type"]
    body = (
        F.when(F.size(geom["parts"]) == 0, F.lit("EMPTY"))
        .when(t.isin("Point", "LineString"), ring(geom["parts"][0][0]))
        .when(t == "Polygon", polygon(geom["parts"][0]))
        .when(t.isin("MultiPoint", "MultiLineString"), listed(lambda p: ring(p[0])))
        .when(t == "MultiPolygon", listed(polygon))
        .otherwise(F.concat(F.lit("("), F.array_join(member, ", "), F.lit(")")))
    )
    return F.concat(F.upper(t), F.lit(" "), body)


def geojson_of(geom: Column) -> Column:
    """Geometry struct to GeoJSON geometry text."""
    return let(geom, _geojson_text)


def _geojson_text(geom: Column) -> Column:
    at = lambda v: F.array(v["x"], v["y"])
    ring = lambda r: F.transform(r, at)
    polygon = lambda p: F.transform(p, ring)
    parts, t = geom["parts"], geom["type"]

    def text(kind: str, coords: Column) -> Column:
        return F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), F.to_json(coords), F.lit("}"))

    member = F.transform(
        parts,
        lambda p, i: F.when(F.substring(geom["kinds"], i + 1, F.lit(1)) == "P", text("Point", at(p[0][0])))
        .when(F.substring(geom["kinds"], i + 1, F.lit(1)) == "L", text("LineString", ring(p[0])))
        .otherwise(text("Polygon", polygon(p))),
    )
    return (
        F.when(F.size(parts) == 0, F.concat(F.lit('{"type":"'), t, F.lit('","coordinates":[]}')))
        .when(t == "Point", text("Point", at(parts[0][0][0])))
        .when(t == "MultiPoint", text("MultiPoint", F.transform(parts, lambda p: at(p[0][0]))))
        .when(t == "LineString", text("LineString", ring(parts[0][0])))
        .when(t == "MultiLineString", text("MultiLineString", F.transform(parts, lambda p: ring(p[0]))))
        .when(t == "Polygon", text("Polygon", polygon(parts[0])))
        .when(t == "MultiPolygon", text("MultiPolygon", F.transform(parts, polygon)))
        .otherwise(
            F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.array_join(member, ","), F.lit("]}"))
        )
    )
