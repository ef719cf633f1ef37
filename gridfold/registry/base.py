"""Registration and the feature fixtures derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.functions import kernel
from gridfold.functions.measure import box, line, point
from gridfold.functions.project import ALPHA, ECC, FALSE_EASTING, RADIUS, SCALE
from gridfold.schema import as_features, table_only

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            kernel.install(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _d(v: float) -> Column:
    return F.lit(float(v))


def _json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


# Positions: plain arithmetic on keys, repeated literally in SQL below.


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    lng = _d(-123.5) + (k % 1000) / _d(1000)
    lat = _d(49) + ((k * 7919) % 9973) / _d(9973)
    props = _json("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return as_features(table(spark, sf_dir, "customer"), point(lng, lat), props, k)


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    lng = _d(-123.4997) + ((k * 37) % 1000) / _d(1000)
    lat = _d(49.0003) + ((k * 613) % 9973) / _d(9973)
    return as_features(table(spark, sf_dir, "supplier"), point(lng, lat), _json("s_name", "s_nationkey", "s_acctbal"), k)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    lng = _d(-123.5) + ((k * 31) % 10007) / _d(10007)
    lat = _d(49) + ((k * 7919) % 9973) / _d(9973)
    props = _json("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return as_features(table(spark, sf_dir, "orders"), point(lng, lat), props, k)


def _zone_box(shift: float) -> Column:
    k = F.col("n_nationkey")
    x = _d(-123.49995) + (k % 5) * _d(0.2) + _d(shift)
    y = _d(49.00005) + F.floor(k / 5) * _d(0.2) + _d(shift)
    return box(x, y, x + _d(0.15), y + _d(0.15))


def zones(spark: SparkSession, sf_dir: str, shift: float = 0.0) -> DataFrame:
    """25 disjoint boxes; shifted by 0.04 each meets only its own original."""
    return as_features(table(spark, sf_dir, "nation"), _zone_box(shift), _json("n_name", "n_regionkey"), F.col("n_nationkey"))


def part_corner() -> tuple[Column, Column, Column]:
    k = F.col("p_partkey")
    x = _d(-123.52) + ((k * 53) % 1009) / _d(1009)
    y = _d(48.98) + ((k * 97) % 997) / _d(997)
    return x, y, F.col("p_size") * _d(0.002)


def part_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping boxes of very different sizes."""
    x, y, s = part_corner()
    props = _json("p_name", "p_brand", "p_size", "p_retailprice")
    return as_features(table(spark, sf_dir, "part"), box(x, y, x + s, y + s), props, F.col("p_partkey"))


def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight west-east lines."""
    x, y, s = part_corner()
    return as_features(table(spark, sf_dir, "part"), line((x, y), (x + s, y)), _json("p_brand"), F.col("p_partkey"))


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint boxes, one per supplier."""
    k = F.col("s_suppkey")
    x = _d(-123.4997) + (k % 40) * _d(0.025)
    y = _d(49.0003) + F.floor(k / 40) * _d(0.02)
    geom = box(x, y, x + _d(0.015), y + _d(0.012))
    return as_features(table(spark, sf_dir, "supplier"), geom, _json("s_name", "s_nationkey"), k)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows without geometry."""
    return table_only(table(spark, sf_dir, "events"), F.col("props"), F.col("event_id"))


PC = """pc AS (SELECT c_custkey AS fid, -123.5::DOUBLE + (c_custkey % 1000) / 1000.0::DOUBLE AS lng,
  49.0::DOUBLE + ((c_custkey * 7919) % 9973) / 9973.0::DOUBLE AS lat, * FROM customer)"""
PS = """ps AS (SELECT s_suppkey AS fid, -123.4997::DOUBLE + ((s_suppkey * 37) % 1000) / 1000.0::DOUBLE AS lng,
  49.0003::DOUBLE + ((s_suppkey * 613) % 9973) / 9973.0::DOUBLE AS lat, * FROM supplier)"""
PO = """po AS (SELECT o_orderkey AS fid, -123.5::DOUBLE + ((o_orderkey * 31) % 10007) / 10007.0::DOUBLE AS lng,
  49.0::DOUBLE + ((o_orderkey * 7919) % 9973) / 9973.0::DOUBLE AS lat, * FROM orders)"""


def _zone_sql(name: str, shift: str) -> str:
    return f"""{name} AS (SELECT fid, x AS xmin, y AS ymin, x + 0.15::DOUBLE AS xmax, y + 0.15::DOUBLE AS ymax, n_name FROM (
  SELECT n_nationkey::BIGINT AS fid, n_name,
    -123.49995::DOUBLE + (n_nationkey % 5) * 0.2::DOUBLE + {shift}::DOUBLE AS x,
    49.00005::DOUBLE + floor(n_nationkey / 5.0::DOUBLE) * 0.2::DOUBLE + {shift}::DOUBLE AS y FROM nation))"""


Z = _zone_sql("z", "0.0")
ZS = _zone_sql("zs", "0.04")
BP = """bp AS (SELECT fid, x AS xmin, y AS ymin, x + s AS xmax, y + s AS ymax, s FROM (
  SELECT p_partkey AS fid, -123.52::DOUBLE + ((p_partkey * 53) % 1009) / 1009.0::DOUBLE AS x,
    48.98::DOUBLE + ((p_partkey * 97) % 997) / 997.0::DOUBLE AS y, p_size * 0.002::DOUBLE AS s FROM part))"""
BL = """bl AS (SELECT fid, x AS xmin, y AS ymin, x + 0.015::DOUBLE AS xmax, y + 0.012::DOUBLE AS ymax FROM (
  SELECT s_suppkey AS fid, -123.4997::DOUBLE + (s_suppkey % 40) * 0.025::DOUBLE AS x,
    49.0003::DOUBLE + floor(s_suppkey / 40.0::DOUBLE) * 0.02::DOUBLE AS y FROM supplier))"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def tm(name: str, source: str, lng: str = "lng", lat: str = "lat") -> str:
    """CTEs that add plane coordinates ``e, n`` of UTM zone 10 north to ``source`` under ``name``."""
    e = " + ".join(["eta", *[f"{a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(ALPHA, 1)]])
    n = " + ".join(["xi", *[f"{a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(ALPHA, 1)]])
    k = f"{SCALE * RADIUS!r}::DOUBLE"
    return f"""{name}_1 AS (SELECT *, sinh(atanh(sin(radians({lat}))) - {ECC!r}::DOUBLE * atanh({ECC!r}::DOUBLE * sin(radians({lat})))) AS t,
  radians({lng} + 123.0::DOUBLE) AS d FROM {source}),
{name}_2 AS (SELECT *, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM {name}_1),
{name} AS (SELECT *, {FALSE_EASTING}::DOUBLE + {k} * ({e}) AS e, {k} * ({n}) AS n FROM {name}_2)"""


def xy(geom: str = "geom") -> list[Column]:
    """Rounded position columns of a point frame."""
    p = F.col(geom)["parts"][0][0][0]
    return [F.round(p["x"], 6).alias("lng"), F.round(p["y"], 6).alias("lat")]
