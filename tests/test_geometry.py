import math

import pytest
from helpers import box, features
from pyspark.sql import functions as F

from gridfold import operators as ops
from gridfold.functions import kernel, tilemath, units
from gridfold.functions.geomtext import geojson_of, is_geojson, is_wkt, parse_geojson, parse_wkt, wkt_of
from gridfold.functions.measure import area, representative_point
from gridfold.functions.names import dataset_id, dataset_name, slugify
from gridfold.functions.project import plane_of, projected_zone, reproject, to_plane

WKT = [
    "POINT (8.5 47)",
    "LINESTRING (7 46, 8 47.5, 9 46)",
    "POLYGON ((20 -6, 29 -6, 29 6, 20 6, 20 -6), (22 -2, 25 -2, 25 3, 22 -2))",
    "MULTIPOINT ((-3 8), (0.25 -7), (12 12))",
    "MULTILINESTRING ((3 9, 4 9), (-1 -1, -2 -3, -5 -8))",
    "MULTIPOLYGON (((-9 1, -7 1, -7 4, -9 1)), ((30 2, 36 2, 36 7, 30 7, 30 2)))",
    "GEOMETRYCOLLECTION (LINESTRING (6 2, 6 5), POLYGON ((7 7, 9 7, 9 8, 7 7)), POINT (-4 3))",
]


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


def test_kernel_jar_is_current():
    assert kernel.STAMP.read_text().strip() == kernel.source_digest()


@pytest.mark.parametrize("text", WKT)
def test_text_round_trips(spark, text):
    df = spark.createDataFrame([(text,)], "v string").withColumn("g", parse_wkt(F.col("v")))
    df = df.withColumn("j", geojson_of(F.col("g"))).withColumn("k", kernel.unpack(kernel.pack(F.col("g"))))
    row = df.select(wkt_of(F.col("g")), wkt_of(parse_geojson(F.col("j"), True)), wkt_of(F.col("k")), is_wkt(F.col("v"))).first()
    assert tuple(row) == (text, text, text, True)


PARSED_WKT = {
    " MultiPoint (7 46, 8 47) ": "MULTIPOINT ((7 46), (8 47))",
    "linestring zm(7 46 400 1, 8 47 410 2)": "LINESTRING (7 46, 8 47)",
    "POINT (85e-1 +47.0)": "POINT (8.5 47)",
    "POLYGON EMPTY": None,
    "CURVE (7 46, 8 47)": None,
    "POINT (east north)": None,
    "LINESTRING (7 46, 8)": None,
    "GEOMETRYCOLLECTION (POINT (7 46), POINT (8 north))": None,
    "": None,
}


@pytest.mark.parametrize("text", PARSED_WKT)
def test_parse_wkt(spark, text):
    assert one(spark, text, lambda c: wkt_of(parse_wkt(c))) == PARSED_WKT[text]


PARSED_GEOJSON = {
    '{"type":"LineString","coordinates":[[7,46,400],[8,47]]}': "LINESTRING (7 46, 8 47)",
    '{"type":"Feature","properties":{"quay":4},"geometry":{"type":"Point","coordinates":[8.5,47]}}': "POINT (8.5 47)",
    '{"type":"MultiPoint","coordinates":[[7,46],[8,47]]}': "MULTIPOINT ((7 46), (8 47))",
    '{"type":"GeometryCollection","geometries":[]}': None,
    '{"type":"LineString"}': None,
    '{"type":"Point",': None,
    "[8.5, 47]": None,
}


@pytest.mark.parametrize("text", PARSED_GEOJSON)
def test_parse_geojson(spark, text):
    want = PARSED_GEOJSON[text]
    assert one(spark, text, lambda c: wkt_of(parse_geojson(c))) == want
    assert one(spark, text, is_geojson) == (want is not None)


def test_centroid_kinds(spark):
    """Worked by hand: a half plate, legs of 6 and 8, a mean, lines above points, areas 12 and 4 of either orientation."""
    shapes = {
        1: ("POLYGON ((2 1, 14 1, 14 7, 2 7, 2 1), (8 1, 14 1, 14 7, 8 7, 8 1))", (5, 4)),
        2: ("LINESTRING (1 1, 1 7, 9 7)", (46 / 14, 80 / 14)),
        3: ("MULTIPOINT ((3 5), (6 -1), (0 2))", (3, 2)),
        4: ("GEOMETRYCOLLECTION (POINT (70 -40), LINESTRING (3 1, 3 9))", (3, 5)),
        5: ("MULTIPOLYGON (((0 0, 6 0, 6 2, 0 2, 0 0)), ((10 10, 10 12, 12 12, 12 10, 10 10)))", (5, 3.5)),
    }
    rows = ops.centroid(features(spark, [(k, v[0]) for k, v in shapes.items()])).collect()
    for r in rows:
        assert (r["bbox"]["xmin"], r["bbox"]["ymin"]) == pytest.approx(shapes[r["fid"]][1])


def test_representative_point_counts_the_closing_vertex(spark):
    df = features(spark, [(1, box(3, -2, 11, 6))]).select(representative_point(F.col("geom")).alias("p"))
    assert tuple(df.first()["p"]) == pytest.approx((31 / 5, 6 / 5))


def test_clip_to_bbox(spark):
    shapes = {
        1: "POINT (21 3)",
        2: "POINT (29 0)",
        3: "LINESTRING (16 0, 24 0, 24 9, 26 9, 26 1)",
        4: "POLYGON ((18 -6, 30 -6, 30 6, 18 6, 18 -6), (21 -3, 24 -3, 24 -1, 21 -1, 21 -3), (29 5, 29.5 5, 29.5 5.5, 29 5))",
        5: "POLYGON ((40 0, 44 0, 44 3, 40 0))",
        6: "MULTIPOINT ((22 1), (60 2))",
        7: None,
        8: "GEOMETRYCOLLECTION (POINT (23 -2), LINESTRING (19 2, 22 2), POINT (5 5))",
    }
    cut = ops.clip_to_bbox(features(spark, list(shapes.items())), 20, -4, 28, 4)
    got = {r["fid"]: r["w"] for r in cut.select("fid", wkt_of(F.col("geom")).alias("w")).collect()}
    assert {k for k in shapes if got[k] is None} == {2, 5, 7}
    assert got[1] == "POINT (21 3)"
    assert got[3] == "MULTILINESTRING ((20 0, 24 0, 24 4), (26 4, 26 1))"
    assert got[6] == "MULTIPOINT ((22 1))"
    assert got[8] == "GEOMETRYCOLLECTION (POINT (23 -2), LINESTRING (20 2, 22 2))"
    four = cut.where("fid = 4").select(area(F.col("geom")), F.size(F.col("geom.parts")[0])).first()
    assert tuple(four) == (8 * 8 - 3 * 2, 2)


def test_a_clipped_zigzag_keeps_every_piece(spark):
    """A line that leaves the box at the top 500 times: the box keeps the lower half of each tooth."""
    text = "LINESTRING (" + ", ".join(f"{i} {2 * (i % 2)}" for i in range(1001)) + ")"
    got = ops.clip_to_bbox(features(spark, [(1, text)]), 0, 0, 1000, 1).first()["geom"]
    pieces = [[(v["x"], v["y"]) for v in p[0]] for p in got["parts"]]
    assert len(pieces) == 501 and pieces[0] == [(0, 0), (0.5, 1)] and pieces[-1] == [(999.5, 1), (1000, 0)]
    assert pieces[1:-1] == [[(i - 0.5, 1), (i, 0), (i + 0.5, 1)] for i in range(2, 1000, 2)]


def test_buffer_of_line_and_simplify(spark):
    df = features(spark, [(1, "LINESTRING (9 47, 9.02 47)")])
    flat = to_plane(F.col("geom"), plane_of("EPSG:32632"))
    out = ops.buffer(df, 100, quad_segs=16).select(area(flat)).first()[0]
    n = 64
    length = df.select(flat.alias("g")).select(F.col("g.parts")[0][0].alias("v")).first()["v"]
    run = math.dist((length[0]["x"], length[0]["y"]), (length[1]["x"], length[1]["y"]))
    assert out == pytest.approx(200 * run + 0.5 * n * math.sin(2 * math.pi / n) * 1e4, rel=1e-6)


def test_units_and_crs():
    assert units.to_meters(3.5, "km") == 3500 and units.from_meters(3218.688, "miles") == 2
    assert units.unit_suffix("feet") == "ft"
    with pytest.raises(ValueError):
        units.to_meters(1, "cubits")
    cases = {
        " EPSG:3067 ": "EPSG:3067",
        "urn:ogc:def:crs:EPSG::2056": "EPSG:2056",
        "urn:ogc:def:crs:OGC:1.3:CRS84": "EPSG:4326",
        "swiss grid": None,
        "": None,
    }
    assert {k: units.parse_crs(k) for k in cases} == cases
    assert units.parse_crs({"id": {"authority": "EPSG", "code": 2056}}) == "EPSG:2056"
    # The first that is given counts; degrees need no projection.
    assert units.resolve_crs("EPSG:2056", "EPSG:3067", "EPSG:3857") == "EPSG:2056"
    assert units.resolve_crs(None, "EPSG:3067", "EPSG:3857") == "EPSG:3067"
    assert units.resolve_crs(None, None, None) is None and units.resolve_crs("EPSG:4269") is None


def test_utm_codes(spark):
    """Zurich, Nairobi, Reykjavik, Ushuaia, both caps, both ends."""
    places = {
        (47.4, 8.5): "EPSG:32632", (-1.3, 36.8): "EPSG:32737", (64.1, -21.9): "EPSG:32627", (-54.8, -68.3): "EPSG:32719",
        (88.0, 40.0): None, (-85.0, 70.0): None, (5.0, -180.0): "EPSG:32601", (-3.0, 180.0): "EPSG:32760",
    }
    df = spark.createDataFrame(list(places), "lat double, lng double")
    got = df.select("lat", "lng", units.utm_epsg(F.col("lat"), F.col("lng")).alias("code")).collect()
    assert {(r["lat"], r["lng"]): r["code"] for r in got} == places


def test_reprojection(spark):
    df = features(spark, [(1, "LINESTRING (10.5 47.2, 11.7 46.8)")])
    back = df.select(reproject(reproject(F.col("geom"), "EPSG:4326", "EPSG:32632"), "EPSG:32632", "CRS84").alias("g"))
    v = back.first()["g"]["parts"][0][0]
    assert (v[0]["x"], v[1]["y"]) == pytest.approx((10.5, 46.8), abs=1e-9)
    # On the central meridian: the meridian arc up to 47 degrees, 5,207,247 m, times 0.9996.
    north = features(spark, [(1, "POINT (9 47)")]).select(reproject(F.col("geom"), "EPSG:4326", "EPSG:32632").alias("g"))
    p = north.first()["g"]["parts"][0][0][0]
    assert p["x"] == pytest.approx(500000, abs=1e-6) and p["y"] == pytest.approx(5207247 * 0.9996, abs=50)
    with pytest.raises(ValueError):
        reproject(F.col("geom"), "EPSG:2056", "EPSG:4326")
    assert projected_zone(df).first()["epsg"] == "EPSG:32632"


def test_tile_ids_follow_the_curve(spark):
    df = spark.sql("SELECT x, y FROM (SELECT explode(sequence(0, 7)) x) JOIN (SELECT explode(sequence(0, 7)) y)")
    rows = df.select("x", "y", tilemath.tile_id(F.lit(3), F.col("x"), F.col("y")).alias("id")).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(21, 85))
    for a, b in zip(rows, rows[1:]):
        assert abs(a["x"] - b["x"]) + abs(a["y"] - b["y"]) == 1


def test_names(spark):
    assert one(spark, "", dataset_id) == "dataset_0"
    # 31 * (31 * 102 + 111) + 103
    assert one(spark, "fog", dataset_id) == f"dataset_{101566:x}"
    assert one(spark, "https://data.example/ferry/stops.2019.csv?lang=de", dataset_name) == "stops.2019"
    assert one(spark, "https://data.example/", dataset_name) == "data.example"
    long = "every quay and pier along the northern shore"
    assert one(spark, long, dataset_name) == long[:30]
    assert slugify("  Ferry Quays (north)! ") == "ferry_quays_north"
    with pytest.raises(ValueError):
        slugify("??")


def test_vertex_arrays_equal_a_loop(spark):
    """Places of all kinds of parts, over several partitions."""
    wkts = [
        "POINT (1 2)", "MULTIPOINT ((1 2), (3 4))", "LINESTRING (0 0, 1 1, 2 0)", "POLYGON ((0 0, 9 0, 9 9, 0 0), (1 1, 2 1, 2 2, 1 1))", None,
        "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 6, 5 5), (5.1 5.1, 5.2 5.1, 5.2 5.2, 5.1 5.1)))", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3, 4 4))",
    ]
    df = features(spark, [(i % 5, wkts[i % len(wkts)]) for i in range(60)]).repartition(6)
    rows = sorted(ops.vertex_arrays(df).collect(), key=lambda r: (r["feature"], r["part"], r["ring"], r["idx"]))
    assert sorted({r["feature"] for r in rows}) == list(range(len({r["feature"] for r in rows}))) and len(rows) == ops.explode_vertices(df).count()
    vertex, single, seen = {}, {}, {}
    for r in rows:
        c = r["class"]
        place = vertex.get(c, 0)
        if r["ring"] == r["idx"] == 0:
            single[c] = single.get(c, -1) + 1
            seen["part"] = place
        if r["idx"] == 0:
            seen["ring"] = place
        assert (r["vertex"], r["single"], r["part_start"], r["ring_start"]) == (place, single[c], seen["part"], seen["ring"])
        vertex[c] = place + 1
    assert ops.vertex_arrays(df.limit(0)).collect() == []


def test_broken_shapes_never_fail_a_union(spark):
    """Shapes that no union can join: beyond what numbers resolve, crossing themselves, flat."""
    broken = ["POLYGON ((0 0, 1e308 0, 1e308 1e308, -1e308 1e308, 0 0))", "POLYGON ((-1e308 -1e308, 1e308 1e-308, 0 1e308, -1e308 -1e308))", "POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))", "POLYGON ((0 0, 1 1, 2 2, 0 0))"]
    good = [box(0, 0, 1, 1), box(0.5, 0.5, 2, 2)]
    both = features(spark, [(i, w) for i, w in enumerate(broken[:2] + good)]), features(spark, [(i, w) for i, w in enumerate(broken[2:] + good)])
    assert ops.union(list(both), "dissolve").count() == 1
    (row,) = ops.union([both[1], features(spark, [(0, good[0])])], "dissolve").select(F.round(area(F.col("geom")), 6).alias("a")).collect()
    assert row["a"] == pytest.approx(3.5)
