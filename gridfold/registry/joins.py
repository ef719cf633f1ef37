"""Joins (J) and predicates (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridfold import operators as ops
from gridfold.functions import kernel
from gridfold.functions.measure import area, point
from gridfold.functions.props import json_value
from gridfold.functions.tilemath import tile_range
from gridfold.operators.inspect import POINT_TYPES, POLYGON_TYPES
from gridfold.registry.base import (
    BL, BP, PC, PO, PS, Z, ctes, customers, event_rows, lots, orders, part_boxes, part_lines, query, suppliers,
    table, tm, zones,
)
from gridfold.schema import table_only

IN_BOX = "p.lng > b.xmin AND p.lng < b.xmax AND p.lat > b.ymin AND p.lat < b.ymax"
MEET = "a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax"
OVERLAP = (
    "(least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))"
)


@query("J1_intersection_filter", ctes(BP, BL) + f"SELECT fid FROM bp a WHERE EXISTS (SELECT 1 FROM bl b WHERE {MEET})")
def j1(spark, d):
    return ops.intersection(part_boxes(spark, d), lots(spark, d)).select("fid")


@query("J1_intersection_lines", ctes(BP, Z) + """SELECT fid FROM bp a WHERE EXISTS (
  SELECT 1 FROM z b WHERE a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin BETWEEN b.ymin AND b.ymax)""")
def j1_lines(spark, d):
    return ops.intersection(part_lines(spark, d), zones(spark, d)).select("fid")


@query("J2_intersection_clip", ctes(BP, BL) + f"""SELECT a.fid, round(sum({OVERLAP}), 9) AS area FROM bp a
  JOIN bl b ON {MEET} GROUP BY a.fid""")
def j2(spark, d):
    out = ops.intersection(part_boxes(spark, d), lots(spark, d), mode="clip")
    return out.select("fid", F.round(area(F.col("geom")), 9).alias("area"))


@query("J3_difference_exclude", ctes(PO, Z) + f"SELECT fid FROM po p WHERE NOT EXISTS (SELECT 1 FROM z b WHERE {IN_BOX})")
def j3(spark, d):
    return ops.difference(orders(spark, d), zones(spark, d), mode="exclude").select("fid")


@query("J4_difference_subtract", ctes(BP, BL) + f"""SELECT * FROM (SELECT a.fid,
  round((a.xmax - a.xmin) * (a.ymax - a.ymin) - coalesce(sum(CASE WHEN b.fid IS NOT NULL THEN {OVERLAP} END), 0.0::DOUBLE), 9) AS area
  FROM bp a LEFT JOIN bl b ON {MEET} GROUP BY a.fid, a.xmin, a.xmax, a.ymin, a.ymax) WHERE area > 0""")
def j4(spark, d):
    out = ops.difference(part_boxes(spark, d), lots(spark, d))
    return out.select("fid", F.round(area(F.col("geom")), 9).alias("area"))


@query("J5_contains_filter", ctes(BP, PC) + f"SELECT fid FROM bp b WHERE EXISTS (SELECT 1 FROM pc p WHERE {IN_BOX})")
def j5(spark, d):
    return ops.contains(part_boxes(spark, d), customers(spark, d)).select("fid")


@query("J6_contains_within", ctes(PC, Z) + f"""SELECT c_mktsegment AS segment, count(*)::BIGINT AS n FROM pc p
  WHERE EXISTS (SELECT 1 FROM z b WHERE {IN_BOX}) GROUP BY c_mktsegment""")
def j6(spark, d):
    inside = ops.contains(zones(spark, d), customers(spark, d), mode="within")
    segment = json_value(F.col("properties"), "c_mktsegment").alias("segment")
    return inside.groupBy(segment).agg(F.count(F.lit(1)).alias("n"))


@query("J6_contains_within_many", ctes(PO, BP) + f"SELECT fid FROM po p WHERE EXISTS (SELECT 1 FROM bp b WHERE {IN_BOX})")
def j6_many(spark, d):
    return ops.contains(part_boxes(spark, d), orders(spark, d), mode="within").select("fid")


@query("J7_distance_filter", ctes(PO, PS, tm("a", "po"), tm("b", "ps")) + """SELECT fid FROM a WHERE EXISTS (
  SELECT 1 FROM b WHERE sqrt((a.e - b.e) * (a.e - b.e) + (a.n - b.n) * (a.n - b.n)) <= 1500.0)""")
def j7(spark, d):
    return ops.distance(orders(spark, d), suppliers(spark, d), "filter", 1.5, "kilometers").select("fid")


@query("J8_distance_annotate", ctes(PC, PS, tm("a", "pc"), tm("b", "ps")) + """SELECT a.fid, a.c_mktsegment AS segment,
  round(min(sqrt((a.e - b.e) * (a.e - b.e) + (a.n - b.n) * (a.n - b.n))), 1) AS dist_m FROM a CROSS JOIN b GROUP BY a.fid, a.c_mktsegment""")
def j8(spark, d):
    out = ops.distance(customers(spark, d), suppliers(spark, d), "annotate")
    p = F.col("properties")
    return out.select(
        "fid", json_value(p, "c_mktsegment").alias("segment"), json_value(p, "dist_m").cast("double").alias("dist_m")
    )


@query("J8_distance_annotate_cutoff", ctes(PO, PS, tm("a", "po"), tm("b", "ps")) + """SELECT * FROM (SELECT a.fid,
  round(min(sqrt((a.e - b.e) * (a.e - b.e) + (a.n - b.n) * (a.n - b.n))) / 1000.0, 1) AS dist_km,
  min(sqrt((a.e - b.e) * (a.e - b.e) + (a.n - b.n) * (a.n - b.n))) AS m FROM a CROSS JOIN b GROUP BY a.fid)
  WHERE m <= 3000.0""".replace("SELECT * FROM (", "SELECT fid, dist_km FROM (", 1))
def j8_cutoff(spark, d):
    out = ops.distance(orders(spark, d), suppliers(spark, d), "annotate", 3, "km")
    return out.select("fid", json_value(F.col("properties"), "dist_km").cast("double").alias("dist_km"))


def _join_rows(spark, d, mode):
    """Orders get the columns of the supplier of their customer's number; most numbers have none."""
    s = table(spark, d, "supplier")
    source = table_only(s, F.to_json(F.struct("s_suppkey", "s_name", "s_nationkey")), F.col("s_suppkey"))
    out = ops.join(source, orders(spark, d), "s_suppkey", "o_custkey", mode)
    p = F.col("properties")
    return out.select("fid", json_value(p, "o_orderstatus").alias("status"), json_value(p, "s_name").alias("s_name"))


JOIN_SQL = "SELECT o_orderkey AS fid, o_orderstatus AS status, s_name FROM orders {} JOIN supplier ON s_suppkey = o_custkey"


@query("J9_join_left", JOIN_SQL.format("LEFT"))
def j9(spark, d):
    return _join_rows(spark, d, "left")


@query("J10_join_inner", JOIN_SQL.format("INNER"))
def j10(spark, d):
    return _join_rows(spark, d, "inner")


K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query("P1_attribute_number", f"SELECT event_id AS fid FROM events WHERE {K} >= 50")
def p1_number(spark, d):
    return ops.attribute(event_rows(spark, d), "k", ">=", 50).select("fid")


@query("P1_attribute_text", "SELECT o_orderkey AS fid FROM orders WHERE o_orderstatus != 'F'")
def p1_text(spark, d):
    return ops.attribute(orders(spark, d), "o_orderstatus", "!=", "F").select("fid")


@query("P2_attribute_where", f"SELECT event_id AS fid FROM events WHERE {K} BETWEEN 10 AND 20 OR {K} = 77")
def p2(spark, d):
    k = "CAST(json_extract_string(properties, '$.k') AS BIGINT)"
    return ops.attribute(event_rows(spark, d), where=f"{k} BETWEEN 10 AND 20 OR {k} = 77").select("fid")


@query("P3_geometry_not_null", "SELECT count(*)::BIGINT AS n FROM orders")
def p3(spark, d):
    both = ops.append(orders(spark, d), event_rows(spark, d))
    return ops.with_geometry(both).agg(F.count(F.lit(1)).alias("n"))


@query("P4_flatten", "SELECT o_custkey::VARCHAR AS o_custkey, o_orderpriority, o_orderstatus FROM orders")
def p4(spark, d):
    return ops.flatten(orders(spark, d), ["o_custkey", "o_orderpriority", "o_orderstatus"], geometry=None)


def _with_own_zone(spark, d):
    """Each customer next to the box of its nation."""
    own = customers(spark, d).withColumn("nat", json_value(F.col("properties"), "c_nationkey").cast("bigint"))
    z = zones(spark, d).select(F.col("fid").alias("nat"), F.col("geom").alias("zone"))
    return own.join(z, "nat").select("fid", kernel.pack(F.col("geom")).alias("p"), kernel.pack(F.col("zone")).alias("z"))


OWN = "FROM pc p JOIN z b ON b.fid = p.c_nationkey"


@query("P5_intersects", ctes(PC, Z) + f"SELECT p.fid, ({IN_BOX}) AS hit {OWN}")
def p5(spark, d):
    return _with_own_zone(spark, d).select("fid", kernel.intersects(F.col("z"), F.col("p")).alias("hit"))


@query("P6_contains", ctes(PC, Z) + f"SELECT p.fid, ({IN_BOX}) AS hit {OWN}")
def p6(spark, d):
    return _with_own_zone(spark, d).select("fid", kernel.contains(F.col("z"), F.col("p")).alias("hit"))


@query("P7_dwithin", ctes(PC, Z) + f"""SELECT p.fid, sqrt(power(greatest(b.xmin - p.lng, 0.0, p.lng - b.xmax), 2) +
  power(greatest(b.ymin - p.lat, 0.0, p.lat - b.ymax), 2)) <= 0.25 AS hit {OWN}""")
def p7(spark, d):
    return _with_own_zone(spark, d).select("fid", (kernel.distance(F.col("z"), F.col("p")) <= 0.25).alias("hit"))


@query("P8_geometry_class", "SELECT (SELECT count(*) FROM orders)::BIGINT AS points, (SELECT count(*) FROM part)::BIGINT AS polygons")
def p8(spark, d):
    mixed = ops.merge([orders(spark, d), part_boxes(spark, d), part_lines(spark, d)])
    points = ops.with_geometry(mixed, POINT_TYPES).agg(F.count(F.lit(1)).alias("points"))
    areas = ops.with_geometry(mixed, POLYGON_TYPES).agg(F.count(F.lit(1)).alias("polygons"))
    return points.select("points", areas.scalar().alias("polygons"))


def _row_sql(lat: str, z: int) -> str:
    return f"floor((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * {2**z})::BIGINT"


@query("P9_tile_range", ctes(BP) + f"""SELECT fid, floor((xmin + 180) / 360 * 4096)::BIGINT AS x0, floor((xmax + 180) / 360 * 4096)::BIGINT AS x1,
  {_row_sql("ymax", 12)} AS y0, {_row_sql("ymin", 12)} AS y1 FROM bp""")
def p9(spark, d):
    r = tile_range(F.col("bbox"), F.lit(12))
    return part_boxes(spark, d).select(
        "fid", r["xmin"].alias("x0"), r["xmax"].alias("x1"), r["ymin"].alias("y0"), r["ymax"].alias("y1")
    )


@query("U1_union_merge", ctes(PC, PS) + """SELECT fid * 2 AS fid, round(lng, 6) AS lng FROM pc
  UNION ALL SELECT fid * 2 + 1, round(lng, 6) FROM ps""")
def u1(spark, d):
    out = ops.union([customers(spark, d), suppliers(spark, d)])
    return out.select("fid", F.round(F.col("bbox.xmin"), 6).alias("lng"))


@query("U2_append", "SELECT count(*)::BIGINT AS n, count(DISTINCT k)::BIGINT AS keys FROM "
       "(SELECT c_custkey AS k FROM customer UNION ALL SELECT c_custkey FROM customer)")
def u2(spark, d):
    twice = ops.append(customers(spark, d), customers(spark, d))
    return twice.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fid").alias("keys"))


@query("U3_dedup_features", """SELECT status, kx, ky, min(fid) AS fid FROM (SELECT o_orderkey AS fid, o_orderstatus AS status,
  floor((-123.0::DOUBLE + (o_orderkey % 37) / 1000.0::DOUBLE) * 100000.0 + 0.5)::BIGINT AS kx,
  floor((49.0::DOUBLE + (o_orderkey % 11) / 1000.0::DOUBLE) * 100000.0 + 0.5)::BIGINT AS ky FROM orders) GROUP BY status, kx, ky""")
def u3(spark, d):
    k = F.col("o_orderkey")
    geom = point(F.lit(-123.0) + (k % 37) / F.lit(1000.0), F.lit(49.0) + (k % 11) / F.lit(1000.0))
    rows = table(spark, d, "orders").select(
        k.alias("fid"), geom.alias("geom"), F.col("o_orderstatus").alias("layer"), F.lit("{}").alias("properties")
    )
    p = F.col("geom")["parts"][0][0][0]
    return ops.dedup_features(rows, "layer", ["fid"]).select(
        F.col("layer").alias("status"),
        F.floor(p["x"] * 100000.0 + 0.5).alias("kx"),
        F.floor(p["y"] * 100000.0 + 0.5).alias("ky"),
        "fid",
    )

