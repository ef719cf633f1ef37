"""Tiles: build (K4, K5), read (S15), order (L4), sizes (W3)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridfold import sinks
from gridfold.functions.measure import bbox_of
from gridfold.registry.base import BL, PC, PO, PS, Z, ctes, customers, lots, orders, query, suppliers, zones
from gridfold.session import new_path
from gridfold.sinks.tiles import build_layers

Y = "(1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2"


def _tiles_sql(points: str, name: str, low: int, high: int, among: str | None = None) -> str:
    """Tiles a point falls in, its buffer of 64/4096 included, within the tile range of the data, or of ``among``."""
    return f"""u_{name} AS (SELECT fid, (lng + 180) / 360 AS u, {Y} AS v FROM {points}),
b_{name} AS (SELECT min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM {among or f'u_{name}'}),
t_{name} AS (SELECT fid, z, x, y, '{name}' AS layer FROM (SELECT fid, u, v, z, power(2, z) AS n, unnest(generate_series(
    greatest(floor(u * power(2, z) - 0.015625), floor(u0 * power(2, z)))::BIGINT,
    least(floor(u * power(2, z) + 0.015625), floor(u1 * power(2, z)))::BIGINT)) AS x, v0, v1
  FROM u_{name}, b_{name}, generate_series({low}, {high}) g(z)),
  LATERAL unnest(generate_series(greatest(floor(v * n - 0.015625), floor(v0 * n))::BIGINT, least(floor(v * n + 0.015625), floor(v1 * n))::BIGINT)) w(y))"""


@query("K4_build_tiles", ctes(PO, _tiles_sql("po", "orders", 4, 12)) + """SELECT z::INTEGER AS z, count(*)::BIGINT AS features,
  count(DISTINCT (x, y))::BIGINT AS tiles, sum(x)::BIGINT AS xs, sum(y)::BIGINT AS ys FROM t_orders GROUP BY z""")
def k4(spark, d):
    return _summary(sinks.build_tiles(orders(spark, d), 4, 12, "orders")).drop("layer")


def _summary(tiles):
    return tiles.groupBy("z", "layer").agg(
        F.count(F.lit(1)).alias("features"),
        F.countDistinct("x", "y").alias("tiles"),
        F.sum("x").alias("xs"),
        F.sum("y").alias("ys"),
    )


BOTH = f"(SELECT (lng + 180) / 360 AS u, {Y} AS v FROM (SELECT lng, lat FROM pc UNION ALL SELECT lng, lat FROM ps))"


@query("K5_build_layers", ctes(PC, PS, _tiles_sql("pc", "customers", 0, 10, BOTH), _tiles_sql("ps", "suppliers", 0, 10, BOTH)) + """
SELECT z::INTEGER AS z, layer, count(*)::BIGINT AS features, count(DISTINCT (x, y))::BIGINT AS tiles, sum(x)::BIGINT AS xs, sum(y)::BIGINT AS ys
  FROM (SELECT * FROM t_customers UNION ALL SELECT * FROM t_suppliers) GROUP BY z, layer""")
def k5(spark, d):
    layers = {"customers": customers(spark, d), "suppliers": suppliers(spark, d)}
    return _summary(build_layers(layers, 0, 10))


@query("K4_build_tiles_polygons", ctes(BL) + f"""SELECT fid, count(*)::BIGINT AS tiles FROM (SELECT fid, x, y FROM (
  SELECT fid, unnest(generate_series(floor((xmin + 180) / 360 * 16384 - 0.015625)::BIGINT, floor((xmax + 180) / 360 * 16384 + 0.015625)::BIGINT)) AS x,
    floor({Y.replace("lat", "ymax")} * 16384 - 0.015625)::BIGINT AS y0, floor({Y.replace("lat", "ymin")} * 16384 + 0.015625)::BIGINT AS y1 FROM bl)
  , LATERAL unnest(generate_series(y0, y1)) w(y)), (SELECT floor((min(xmin) + 180) / 360 * 16384)::BIGINT AS bx0, floor((max(xmax) + 180) / 360 * 16384)::BIGINT AS bx1,
    floor({Y.replace("lat", "max(ymax)")} * 16384)::BIGINT AS by0, floor({Y.replace("lat", "min(ymin)")} * 16384)::BIGINT AS by1 FROM bl)
  WHERE x BETWEEN bx0 AND bx1 AND y BETWEEN by0 AND by1 GROUP BY fid""")
def k4_polygons(spark, d):
    tiles = sinks.build_tiles(lots(spark, d), 14, 14, "lots")
    return tiles.groupBy("fid").agg(F.count(F.lit(1)).alias("tiles"))


def _pieces_sql(table: str, layer: str, low: int, high: int) -> str:
    """Envelopes of axis-parallel boxes cut to each tile and its buffer, in tile units."""
    return f"""w_{layer} AS (SELECT fid, (xmin + 180) / 360 AS u0, (xmax + 180) / 360 AS u1, {Y.replace("lat", "ymax")} AS v0, {Y.replace("lat", "ymin")} AS v1 FROM {table}),
p_{layer} AS (SELECT '{layer}' AS layer, fid, z, x, y, greatest(u0 * n - x, -0.015625) * 4096 AS x0, greatest(v0 * n - y, -0.015625) * 4096 AS y0,
    least(u1 * n - x, 1.015625) * 4096 AS x1, least(v1 * n - y, 1.015625) * 4096 AS y1
  FROM (SELECT *, unnest(generate_series(greatest(floor(u0 * n - 0.015625), floor(r0 * n))::BIGINT, least(floor(u1 * n + 0.015625), floor(r1 * n))::BIGINT)) AS x
    FROM (SELECT *, power(2, z) AS n FROM w_{layer}, ranges, generate_series({low}, {high}) g(z))),
  LATERAL unnest(generate_series(greatest(floor(v0 * n - 0.015625), floor(s0 * n))::BIGINT, least(floor(v1 * n + 0.015625), floor(s1 * n))::BIGINT)) h(y))"""


LAYERS = f"""ranges AS (SELECT (min(xmin) + 180) / 360 AS r0, (max(xmax) + 180) / 360 AS r1, {Y.replace("lat", "max(ymax)")} AS s0, {Y.replace("lat", "min(ymin)")} AS s1
  FROM (SELECT xmin, ymin, xmax, ymax FROM z UNION ALL SELECT xmin, ymin, xmax, ymax FROM bl))"""
#: Least side, in tile units, of the compared pieces of coarser zooms: there simplifying by 3 units may drop thinner ones.
THIN = 8


@query("K5_tile_geometry", ctes(Z, BL, LAYERS, _pieces_sql("z", "zones", 9, 14), _pieces_sql("bl", "lots", 9, 14)) + f"""
SELECT layer, z::INTEGER AS z, x::BIGINT AS x, y::BIGINT AS y, fid, round(x0)::BIGINT AS x0, round(y0)::BIGINT AS y0, round(x1)::BIGINT AS x1, round(y1)::BIGINT AS y1
  FROM (SELECT * FROM p_zones UNION ALL SELECT * FROM p_lots) WHERE z = 14 OR least(round(x1) - round(x0), round(y1) - round(y0)) >= {THIN}""")
def k5_geometry(spark, d):
    """Shapes in their tiles: zones span many tiles and go down the pyramid, lots are cut directly."""
    tiles = build_layers({"zones": zones(spark, d), "lots": lots(spark, d)}, 9, 14)
    b = bbox_of(F.col("geom"))
    out = tiles.select("layer", "z", "x", "y", "fid", b.alias("b")).select(
        "layer", "z", "x", "y", "fid", *[F.col(f"b.{n}").cast("bigint").alias(m) for n, m in (("xmin", "x0"), ("ymin", "y0"), ("xmax", "x1"), ("ymax", "y1"))]
    )
    return out.where((F.col("z") == 14) | (F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) >= THIN))


EDGE = "(-123.2, 49.2, -122.8, 49.7)"


@query("S15_read_tiles", ctes(PC) + f"""SELECT fid, round(round((lng + 180) / 360 * 4096 * 4096) / 4096 / 4096 * 360 - 180, 6) AS lng
  FROM (SELECT *, floor((lng + 180) / 360 * 4096)::BIGINT AS x, floor({Y} * 4096)::BIGINT AS y FROM pc)
  WHERE x BETWEEN floor((-123.2 + 180) / 360 * 4096) AND floor((-122.8 + 180) / 360 * 4096)
    AND y BETWEEN floor({Y.replace("lat", "49.7::DOUBLE")} * 4096) AND floor({Y.replace("lat", "49.2::DOUBLE")} * 4096)""")
def s15(spark, d):
    path = new_path(spark, "tiles")
    sinks.write_tiles(sinks.build_tiles(customers(spark, d), 12, 12, "customers"), path)
    out = sinks.read_tiles(spark, path, (-123.2, 49.2, -122.8, 49.7), 12, ["customers"])
    return out.select("fid", F.round("bbox.xmin", 6).alias("lng"))


@query("L4_tile_order", ctes(PO, _tiles_sql("po", "orders", 8, 12)) + "SELECT count(*)::BIGINT AS n, true AS ordered FROM t_orders")
def l4(spark, d):
    """Inside each file the tile ids rise row by row, and the file ranges do not overlap."""
    path = new_path(spark, "tiles")
    sinks.write_tiles(sinks.build_tiles(orders(spark, d), 8, 12, "orders"), path, partitions=4)
    rows = spark.read.parquet(path).select("tile_id", "_metadata.file_path", "_metadata.row_index")
    last = F.lag("tile_id").over(Window.partitionBy("file_path").orderBy("row_index"))
    rows = rows.withColumn("rises", F.coalesce(F.col("tile_id") >= last, F.lit(True)))
    spans = rows.groupBy("file_path").agg(
        F.min("tile_id").alias("lo"), F.max("tile_id").alias("hi"), F.count(F.lit(1)).alias("n"), F.bool_and("rises").alias("rises")
    )
    before = F.max("hi").over(Window.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("ok", F.col("rises") & F.coalesce(F.col("lo") >= before, F.lit(True))).agg(
        F.sum("n").alias("n"), F.bool_and("ok").alias("ordered")
    )


@query("W3_tile_sizes", ctes(PO, _tiles_sql("po", "orders", 8, 9)) + """SELECT z::INTEGER AS z, count(DISTINCT (x, y))::BIGINT AS tiles, true AS gapless FROM t_orders GROUP BY z""")
def w3(spark, d):
    sizes = sinks.tile_sizes(sinks.build_tiles(orders(spark, d), 8, 9, "orders"))
    before = F.lag(F.col("offset") + F.col("bytes"), 1, 0).over(Window.partitionBy("z").orderBy("tile_id"))
    placed = sizes.withColumn("fits", (F.col("bytes") > 0) & (F.col("offset") == before))
    return placed.groupBy("z").agg(F.count(F.lit(1)).alias("tiles"), F.bool_and("fits").alias("gapless"))
