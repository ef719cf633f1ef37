"""Geometry transforms (G) and aggregates (A)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridfold import operators as ops
from gridfold.functions import kernel
from gridfold.functions.measure import area, length, line, point_x, point_y, representative_point, vertices
from gridfold.functions.project import plane_of, projected_zone, reproject, to_plane
from gridfold.registry.base import (
    BL, BP, PC, PO, ctes, customers, event_rows, lots, orders, part_boxes, part_corner, part_lines, query,
    suppliers, table, tm,
)
from gridfold.schema import GEOM, as_features, computed

UTM10 = "EPSG:32610"


def _plane_area(df):
    return computed(df, area=kernel.area(kernel.to_plane(kernel.pack(F.col("geom")), plane_of(UTM10))))


def _disc(quad_segs: int, radius: float) -> float:
    n = 4 * quad_segs
    return 0.5 * n * math.sin(2 * math.pi / n) * radius**2


@query("G1_buffer_points", f"SELECT o_orderkey AS fid, round({_disc(32, 500.0)!r}::DOUBLE, 1) AS area FROM orders")
def g1_points(spark, d):
    out = ops.buffer(orders(spark, d), 500)
    return _plane_area(out).select("fid", F.round("area", 1).alias("area"))


@query("G1_buffer_lines", ctes(BP, tm("a", "bp", "xmin", "ymin"), tm("b", "bp", "xmax", "ymin")) + f"""SELECT a.fid,
  round(2 * 200.0 * sqrt((a.e - b.e) * (a.e - b.e) + (a.n - b.n) * (a.n - b.n)) + {_disc(8, 200.0)!r}::DOUBLE) AS area
  FROM a JOIN b USING (fid)""")
def g1_lines(spark, d):
    out = ops.buffer(part_lines(spark, d), 0.2, "kilometers", quad_segs=8)
    return _plane_area(out).select("fid", F.round("area", 0).alias("area"))


@query("G2_buffer_polar", f"""WITH p AS (SELECT o_orderkey AS fid, 85.0::DOUBLE + (o_orderkey % 100) / 100.0::DOUBLE AS lat FROM orders),
  m AS (SELECT avg(lat) AS lat FROM p)
  SELECT fid, round({_disc(8, 1.0)!r}::DOUBLE * power(5000.0 / (111320.0 * (1 + cos(radians(m.lat))) / 2), 2), 8) AS area FROM p, m""")
def g2(spark, d):
    from gridfold.functions.measure import point

    k = F.col("o_orderkey")
    geom = point(F.lit(10.0) + (k % 7) / F.lit(10.0), F.lit(85.0) + (k % 100) / F.lit(100.0))
    polar = as_features(table(spark, d, "orders"), geom, F.lit("{}"), k)
    out = ops.buffer(polar, 5, "km", quad_segs=8)
    return out.select("fid", F.round(area(F.col("geom")), 8).alias("area"))


@query("G3_centroid_polygons", ctes(BP) + "SELECT fid, round((xmin + xmax) / 2, 6) AS x, round((ymin + ymax) / 2, 6) AS y FROM bp")
def g3(spark, d):
    return _positions(ops.centroid(part_boxes(spark, d)))


@query("G3_centroid_lines", ctes(BP) + "SELECT fid, round((xmin + xmax) / 2, 6) AS x, round(ymin, 6) AS y FROM bp")
def g3_lines(spark, d):
    return _positions(ops.centroid(part_lines(spark, d)))


def _positions(df):
    g = F.col("geom")
    return df.select("fid", F.round(point_x(g), 6).alias("x"), F.round(point_y(g), 6).alias("y"))


@query("G4_reproject_utm", ctes(PO, tm("a", "po")) + "SELECT fid, round(e, 3) AS e, round(n, 3) AS n FROM a")
def g4(spark, d):
    flat = computed(orders(spark, d), geom=reproject(F.col("geom"), "EPSG:4326", UTM10))
    g = F.col("geom")
    return flat.select("fid", F.round(point_x(g), 3).alias("e"), F.round(point_y(g), 3).alias("n"))


@query("G4_reproject_back", ctes(PO) + "SELECT fid, round(lng, 6) AS x, round(lat, 6) AS y FROM po")
def g4_back(spark, d):
    flat = computed(orders(spark, d), geom=reproject(F.col("geom"), "EPSG:4326", "EPSG:32609"))
    flat = computed(flat, geom=reproject(F.col("geom"), "EPSG:32609", "EPSG:3857"))
    return _positions(computed(flat, geom=reproject(F.col("geom"), "EPSG:3857", "EPSG:4326")))


@query("G5_simplify", "SELECT p_partkey AS fid, CASE WHEN p_size * 0.001::DOUBLE > 0.0255 THEN 3 ELSE 2 END AS vertices FROM part")
def g5(spark, d):
    x, y, s = part_corner()
    bent = line((x, y), (x + 0.5, y + s / 2), (x + 1.0, y))
    df = as_features(table(spark, d, "part"), bent, F.lit("{}"), F.col("p_partkey"))
    return ops.simplify(df, 0.0255).select("fid", F.size(vertices(F.col("geom"))).alias("vertices"))


@query("G6_make_valid", "SELECT p_partkey AS fid, round(p_size * p_size * 0.000004::DOUBLE / 2, 9) AS area FROM part")
def g6(spark, d):
    from gridfold.functions.measure import vertex

    x, y, s = part_corner()
    corners = [(x, y), (x + s, y + s), (x + s, y), (x, y + s), (x, y)]
    ring = F.array(*[vertex(a, b) for a, b in corners])
    bow = F.struct(
        F.lit("Polygon").alias("type"), F.lit(None).cast("string").alias("kinds"), F.array(F.array(ring)).alias("parts")
    ).cast(GEOM)
    df = as_features(table(spark, d, "part"), bow, F.lit("{}"), F.col("p_partkey"))
    return ops.make_valid(df).select("fid", F.round(area(F.col("geom")), 9).alias("area"))


BOX = (-123.2, 49.2, -122.8, 49.7)


@query("G7_clip_polygons", ctes(BP) + f"""SELECT fid, round((least(xmax, {BOX[2]}) - greatest(xmin, {BOX[0]}))
  * (least(ymax, {BOX[3]}) - greatest(ymin, {BOX[1]})), 9) AS area FROM bp
  WHERE xmax > {BOX[0]} AND xmin < {BOX[2]} AND ymax > {BOX[1]} AND ymin < {BOX[3]}""")
def g7(spark, d):
    out = ops.clip_to_bbox(part_boxes(spark, d), *BOX).where(F.col("geom").isNotNull())
    return out.select("fid", F.round(area(F.col("geom")), 9).alias("area"))


@query("G7_clip_lines", ctes(BP) + f"""SELECT fid, round(least(xmax, {BOX[2]}) - greatest(xmin, {BOX[0]}), 9) AS length FROM bp
  WHERE xmax > {BOX[0]} AND xmin < {BOX[2]} AND ymin BETWEEN {BOX[1]} AND {BOX[3]}""")
def g7_lines(spark, d):
    out = ops.clip_to_bbox(part_lines(spark, d), *BOX).where(F.col("geom").isNotNull())
    return out.select("fid", F.round(length(F.col("geom")), 9).alias("length"))


@query("G8_representative_point", ctes(BP) + """SELECT fid, round((3 * xmin + 2 * xmax) / 5, 6) AS x, round((3 * ymin + 2 * ymax) / 5, 6) AS y FROM bp""")
def g8(spark, d):
    p = computed(part_boxes(spark, d), p=representative_point(F.col("geom")))
    return p.select("fid", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("G9_explode_vertices", ctes(BP) + """SELECT fid, 'polygon' AS class, 0 AS part, 0 AS ring, i AS idx,
  round(CASE WHEN i IN (1, 2) THEN xmax ELSE xmin END, 6) AS x, round(CASE WHEN i IN (2, 3) THEN ymax ELSE ymin END, 6) AS y
  FROM bp, (VALUES (0), (1), (2), (3), (4)) v(i)""")
def g9(spark, d):
    out = ops.explode_vertices(part_boxes(spark, d))
    return out.withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


@query("G9_vertex_arrays", """SELECT class, n AS singles, n * v AS vertices, n * (n - 1) // 2 AS single_sum, v * (n * (n - 1) // 2) AS start_sum,
  n * v * (n * v - 1) // 2 AS vertex_sum, (SELECT 2 * (SELECT count(*) FROM part) + count(*) FROM customer)::BIGINT AS features FROM (
  SELECT 'point' AS class, count(*)::BIGINT AS n, 1 AS v FROM customer UNION ALL SELECT 'line', count(*), 2 FROM part
  UNION ALL SELECT 'polygon', count(*), 5 FROM part)""")
def g9_arrays(spark, d):
    """Dense places: each sum is that of 0 to n - 1, and no vertex has another's place."""
    both = customers(spark, d).unionByName(part_lines(spark, d)).unionByName(part_boxes(spark, d))
    out = ops.vertex_arrays(both)
    head = F.col("idx") == 0
    by_class = out.groupBy("class").agg(
        F.countDistinct("single").alias("singles"), F.countDistinct("vertex").alias("vertices"), F.sum(F.when(head, F.col("single"))).alias("single_sum"),
        F.sum(F.when(head, F.col("ring_start"))).alias("start_sum"), F.sum("vertex").alias("vertex_sum"),
    )
    return by_class.crossJoin(F.broadcast(out.agg((F.max("feature") + 1).alias("features"))))


@query("G9_numeric_properties", """SELECT * FROM (VALUES ('o_custkey', true), ('o_orderstatus', false), ('o_totalprice', true),
  ('o_orderpriority', (SELECT bool_and(try_cast(o_orderpriority AS DOUBLE) IS NOT NULL) FROM orders))) t(key, "numeric")""")
def g9_numeric(spark, d):
    return ops.numeric_properties(orders(spark, d))


def _one(df, digits: int):
    return df.select(
        F.get_json_object("properties", "$.dissolved").alias("dissolved"), F.round(area(F.col("geom")), digits).alias("area")
    )


@query("A1_union_aggregate", ctes(BL) + """SELECT (fid % 7)::BIGINT AS grp,
  round(sum((xmax - xmin) * (ymax - ymin)), 9) AS area FROM bl GROUP BY fid % 7""")
def a1(spark, d):
    shapes = lots(spark, d).select((F.col("fid") % 7).alias("grp"), kernel.pack(F.col("geom")).alias("wkb"))
    merged = shapes.groupBy("grp").agg(kernel.union_agg(F.col("wkb")).alias("wkb"))
    shaped = computed(merged, geom=kernel.unpack(F.col("wkb")))
    return shaped.select("grp", F.round(area(F.col("geom")), 9).alias("area"))


@query("A2_buffer_dissolve", f"SELECT 'true' AS dissolved, round(count(*) * {_disc(4, 1.0)!r}::DOUBLE, 2) AS area FROM supplier")
def a2(spark, d):
    one = ops.buffer(suppliers(spark, d), 1, quad_segs=4, dissolve=True)
    flat = computed(one, geom=to_plane(F.col("geom"), plane_of(UTM10)))
    return _one(flat, 2)


@query("A3_union_dissolve", ctes(BL) + "SELECT 'true' AS dissolved, round(sum((xmax - xmin) * (ymax - ymin)), 8) AS area FROM bl")
def a3(spark, d):
    return _one(ops.union([lots(spark, d), lots(spark, d)], mode="dissolve"), 8)


@query("A4_bounds", ctes(PO) + "SELECT round(min(lng), 9) AS xmin, round(min(lat), 9) AS ymin, round(max(lng), 9) AS xmax, round(max(lat), 9) AS ymax FROM po")
def a4(spark, d):
    return ops.bounds(orders(spark, d)).select(*[F.round(c, 9).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query("A5_property_keys", """SELECT DISTINCT unnest(json_keys(j)) AS key FROM (SELECT props::JSON AS j FROM events
  UNION ALL SELECT json_object('o_custkey', o_custkey, 'o_orderstatus', o_orderstatus, 'o_totalprice', o_totalprice, 'o_orderpriority', o_orderpriority) FROM orders)""")
def a5(spark, d):
    return ops.property_keys(ops.append(orders(spark, d), event_rows(spark, d)))


@query("A6_property_keys_sample", "SELECT unnest(json_keys(props)) AS key FROM (SELECT props FROM events LIMIT 1)")
def a6(spark, d):
    return ops.property_keys(event_rows(spark, d), sample=1)


@query("A7_geometry_types", "SELECT CASE WHEN count(*) > 0 THEN 'Point' END AS type FROM orders UNION ALL "
       "SELECT CASE WHEN count(*) > 0 THEN 'Polygon' END FROM part UNION ALL SELECT CASE WHEN count(*) > 0 THEN 'LineString' END FROM part")
def a7(spark, d):
    return ops.geometry_types(ops.merge([orders(spark, d), part_boxes(spark, d), part_lines(spark, d)]))


@query("A8_feature_count", "SELECT event_type AS dataset_id, count(*)::BIGINT AS feature_count FROM events GROUP BY event_type")
def a8(spark, d):
    return ops.feature_count(table(spark, d, "events").withColumnRenamed("event_type", "dataset_id"), "dataset_id")


@query("A9_projected_zone", ctes(PC) + """SELECT round(avg(lng), 6) AS lng, round(avg(lat), 6) AS lat,
  'EPSG:326' || lpad((floor((avg(lng) + 180) / 6) + 1)::INTEGER::VARCHAR, 2, '0') AS epsg FROM pc""")
def a9(spark, d):
    return projected_zone(customers(spark, d)).select(F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"), "epsg")


