"""Scalar functions (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridfold.functions import geomtext, names, props, tilemath, units
from gridfold.functions.measure import bbox_of
from gridfold.plans.skew import dealt
from gridfold.registry.base import BP, PO, ctes, event_rows, orders, part_boxes, query, table
from gridfold.schema import computed


@query("F1_units", """SELECT o_orderkey AS fid, round(o_totalprice * 0.3048, 4) AS from_feet, round(o_totalprice * 1609.344, 4) AS from_miles,
  round(o_totalprice * 1000.0, 4) AS from_km, round(o_totalprice / 1609.344, 6) AS to_miles FROM orders""")
def f1(spark, d):
    v = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("fid"),
        F.round(units.to_meters(v, "feet"), 4).alias("from_feet"),
        F.round(units.to_meters(v, "miles"), 4).alias("from_miles"),
        F.round(units.to_meters(v, "kilometers"), 4).alias("from_km"),
        F.round(units.from_meters(v, "miles"), 6).alias("to_miles"),
    )


@query("F2_meters_to_degrees", ctes(PO) + """SELECT fid, round(1000.0 / ((111320.0::DOUBLE + 111320.0::DOUBLE * cos(radians(lat))) / 2), 9) AS deg,
  round(0.01::DOUBLE * ((111320.0::DOUBLE + 111320.0::DOUBLE * cos(radians(lat))) / 2), 6) AS m FROM po""")
def f2(spark, d):
    lat = F.col("bbox.ymin")
    return orders(spark, d).select(
        "fid",
        F.round(units.meters_to_degrees(F.lit(1000.0), lat), 9).alias("deg"),
        F.round(units.degrees_to_meters(F.lit(0.01), lat), 6).alias("m"),
    )


@query("F3_parse_crs", """SELECT c_custkey AS fid, CASE c_custkey % 4 WHEN 0 THEN 'EPSG:' || (32600 + c_nationkey)::VARCHAR
  WHEN 1 THEN 'EPSG:4326' WHEN 2 THEN 'ESRI:' || c_nationkey::VARCHAR END AS crs FROM customer""")
def f3(spark, d):
    k, n = F.col("c_custkey") % 4, F.col("c_nationkey")
    text = (
        F.when(k == 0, F.concat(F.lit("urn:ogc:def:crs:EPSG::"), (n + 32600).cast("string")))
        .when(k == 1, F.lit("urn:ogc:def:crs:OGC:1.3:CRS84"))
        .when(k == 2, F.concat(F.lit('{"id":{"authority":"ESRI","code":'), n.cast("string"), F.lit("}}")))
        .otherwise(F.lit("no crs"))
    )
    return table(spark, d, "customer").select(F.col("c_custkey").alias("fid"), units.parse_crs_column(text).alias("crs"))


@query("F4_utm_epsg", """SELECT o_orderkey AS fid, CASE WHEN lat <= 84 AND lat >= -80 THEN
  'EPSG:' || CASE WHEN lat >= 0 THEN '326' ELSE '327' END || lpad(least(floor((lng + 180) / 6) + 1, 60)::INTEGER::VARCHAR, 2, '0') END AS epsg
  FROM (SELECT o_orderkey, (o_orderkey % 361)::DOUBLE - 180.0 AS lng, (o_orderkey % 179)::DOUBLE - 89.0 AS lat FROM orders)""")
def f4(spark, d):
    k = F.col("o_orderkey")
    lng, lat = (k % 361).cast("double") - 180.0, (k % 179).cast("double") - 89.0
    return table(spark, d, "orders").select(k.alias("fid"), units.utm_epsg(lat, lng).alias("epsg"))


@query("F5_json_value", "SELECT event_id AS fid, json_extract_string(props, '$.k') AS k FROM events")
def f5(spark, d):
    return event_rows(spark, d).select("fid", props.json_value(F.col("properties"), "k").alias("k"))


@query("F6_merge_properties", """SELECT c_custkey AS fid, c_name AS a, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END AS b,
  'new' AS c FROM customer""")
def f6(spark, d):
    target = F.to_json(F.struct(F.lit("old").alias("a"), F.col("c_mktsegment").alias("b")))
    removed = F.when(F.col("c_nationkey") % 2 != 0, F.lit(',"b":null')).otherwise(F.lit(""))
    source = F.concat(F.lit('{"a":"'), F.col("c_name"), F.lit('","c":"new"'), removed, F.lit("}"))
    merged = table(spark, d, "customer").select(
        F.col("c_custkey").alias("fid"), props.merge_properties(target, source).alias("p")
    )
    return merged.select("fid", *[props.json_value(F.col("p"), k).alias(k) for k in ("a", "b", "c")])


@query("F7_json_keys", "SELECT event_id AS fid, array_to_string(json_keys(props), ',') AS keys FROM events")
def f7(spark, d):
    return event_rows(spark, d).select("fid", F.array_join(props.json_keys(F.col("properties")), ",").alias("keys"))


LAT = "ln(tan(radians(lat)) + 1 / cos(radians(lat)))"


@query("F8_tile_of", ctes(PO) + f"""SELECT fid, floor((lng + 180) / 360 * 16384)::BIGINT AS x, floor((1 - {LAT} / pi()) / 2 * 16384)::BIGINT AS y,
  round(floor((lng + 180) / 360 * 16384) / 16384 * 360 - 180, 6) AS west,
  round(degrees(atan(sinh(pi() * (1 - 2 * floor((1 - {LAT} / pi()) / 2 * 16384) / 16384)))), 6) AS north FROM po""")
def f8(spark, d):
    z = F.lit(14)
    at = orders(spark, d).select("fid", tilemath.tile_of(F.col("bbox.xmin"), F.col("bbox.ymin"), z).alias("t"))
    b = tilemath.tile_bounds(F.col("t.x"), F.col("t.y"), z)
    return at.select("fid", F.col("t.x").alias("x"), F.col("t.y").alias("y"), F.round(b["xmin"], 6).alias("west"), F.round(b["ymax"], 6).alias("north"))


HILBERT = """RECURSIVE h AS (SELECT fid, 512::BIGINT AS s, x, y, 0::BIGINT AS d FROM t UNION ALL
  SELECT fid, s // 2, CASE WHEN ry = 1 THEN px ELSE CASE WHEN rx = 1 THEN s - 1 - py ELSE py END END,
    CASE WHEN ry = 1 THEN py ELSE CASE WHEN rx = 1 THEN s - 1 - px ELSE px END END, d + s * s * xor(3 * rx, ry)
  FROM (SELECT *, (x // s) % 2 AS rx, (y // s) % 2 AS ry, x % s AS px, y % s AS py FROM h WHERE s > 0))"""


@query("F9_tile_id", "WITH " + HILBERT.split(" h AS")[0] + " " + PO + """,
t AS (SELECT fid, floor((lng + 180) / 360 * 1024)::BIGINT * 7 % 1024 AS x, (fid * 13) % 1024 AS y FROM po),
h AS""" + HILBERT.split(" h AS")[1] + """
SELECT fid, d + 349525 AS tile_id FROM h WHERE s = 0""")
def f9(spark, d):
    x = F.floor((F.col("bbox.xmin") + 180) / 360 * 1024) * 7 % 1024
    return orders(spark, d).select("fid", tilemath.tile_id(F.lit(10), x, F.col("fid") * 13 % 1024).alias("tile_id"))


@query("F10_dataset_id", """WITH RECURSIVE h AS (SELECT page_id, url, 1 AS i, 0::BIGINT AS h FROM pages UNION ALL
  SELECT page_id, url, i + 1, ((h * 31 + unicode(substr(url, i, 1)) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648
  FROM h WHERE i <= length(url))
  SELECT page_id, 'dataset_' || lower(to_hex(abs(h))) AS id FROM h WHERE i = length(url) + 1""")
def f10(spark, d):
    return table(spark, d, "pages").select("page_id", names.dataset_id(F.col("url")).alias("id"))


@query("F11_slugify", """SELECT doc_id, nullif(left(regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 60), '') AS slug
  FROM (SELECT p_partkey AS doc_id, p_name || ' #' || p_brand AS t FROM part)""")
def f11(spark, d):
    text = F.concat("p_name", F.lit(" #"), "p_brand")
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), names.slug_column(text).alias("slug"))


@query("F12_dataset_name", r"""SELECT page_id, CASE WHEN seg <> '' THEN regexp_replace(seg, '\.[^/.]+$', '') ELSE host END AS name FROM (
  SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host,
    regexp_extract(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1) AS seg FROM pages)""")
def f12(spark, d):
    return table(spark, d, "pages").select("page_id", names.dataset_name(F.col("url")).alias("name"))


@query("F13_parse_geometry", ctes(PO) + "SELECT fid, fid % 3 = 0 AS wkt, fid % 3 = 1 AS geojson, CASE WHEN fid % 3 <> 2 THEN round(lng, 6) END AS lng, "
       "CASE WHEN fid % 3 <> 2 THEN round(lat, 6) END AS lat FROM po")
def f13(spark, d):
    b, k = F.col("bbox"), F.col("fid") % 3
    wkt = F.concat(F.lit(" point z ("), b["xmin"].cast("string"), F.lit(" "), b["ymin"].cast("string"), F.lit(" 7)"))
    json = F.concat(F.lit('{"type":"Feature","geometry":'), geomtext.geojson_of(F.col("geom")), F.lit("}"))
    texts = orders(spark, d).select("fid", F.when(k == 0, wkt).when(k == 1, json).otherwise("POINT (a b)").alias("t"))
    shaped = computed(texts, geom=geomtext.parse_geometry(F.col("t")))
    box = computed(shaped, box=bbox_of(F.col("geom")))
    return box.select(
        "fid",
        (geomtext.is_wkt(F.col("t")) & F.col("geom").isNotNull()).alias("wkt"),
        geomtext.is_geojson(F.col("t")).alias("geojson"),
        F.round("box.xmin", 6).alias("lng"),
        F.round("box.ymin", 6).alias("lat"),
    )


@query("F14_text_and_envelope", ctes(BP) + """SELECT fid, 5 AS wkt_points, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(xmax, 6) AS xmax,
  round(ymax, 6) AS ymax, 'POLYGON ((' AS head FROM bp""")
def f14(spark, d):
    text = geomtext.wkt_of(geomtext.parse_geojson(geomtext.geojson_of(F.col("geom"))))
    shown = computed(dealt(part_boxes(spark, d)), wkt=text)
    back = computed(shown, geom=geomtext.parse_wkt(F.col("wkt")))
    back = computed(back, bbox=bbox_of(F.col("geom")))
    return back.select(
        "fid",
        F.size(F.split("wkt", ",")).alias("wkt_points"),
        *[F.round(f"bbox.{c}", 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")],
        F.substring("wkt", 1, 10).alias("head"),
    )
