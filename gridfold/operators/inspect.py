"""Questions about a feature frame: extent, keys, types, counts, preview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.functions.props import json_keys
from gridfold.operators.attribute import flatten
from gridfold.session import stored

# The extent reported for a dataset without geometry.
WORLD = {"xmin": -180.0, "ymin": -85.0, "xmax": 180.0, "ymax": 85.0}
#: Most property keys that become columns without being named.
COLUMNS = 10_000
# Geometry classes of the three display groups.
POLYGON_TYPES = ["Polygon", "MultiPolygon"]
LINE_TYPES = ["LineString", "MultiLineString", "Polygon", "MultiPolygon"]
POINT_TYPES = ["Point", "MultiPoint"]


def bounds(df: DataFrame, world_default: bool = False) -> DataFrame:
    """One row with the extent; NULL values, or the world, when there is no geometry."""
    b = F.col("bbox")

    def value(agg, name: str) -> Column:
        v = agg(b[name])
        return (F.coalesce(v, F.lit(WORLD[name])) if world_default else v).alias(name)

    return df.agg(value(F.min, "xmin"), value(F.min, "ymin"), value(F.max, "xmax"), value(F.max, "ymax"))


def property_keys(df: DataFrame, sample: int | None = None) -> DataFrame:
    """Distinct property keys in order, those with a leading underscore left out.

    With ``sample`` the keys of so many rows, in their own order.
    """
    props = df.where(F.col("properties").isNotNull())
    if sample is not None:
        keyed = props.limit(sample).select(F.posexplode(json_keys(F.col("properties"))).alias("pos", "key"))
        return keyed.where(~F.col("key").startswith("_")).groupBy("key").agg(F.min("pos").alias("pos")).orderBy("pos").select("key")
    keys = props.select(F.explode(json_keys(F.col("properties"))).alias("key")).distinct()
    return keys.where(~F.col("key").startswith("_") & (F.col("key") != "")).orderBy("key")


def key_list(df: DataFrame) -> list[str]:
    """The keys as a list for building columns.

    A table of more than ``COLUMNS`` columns is refused before their names reach the driver.
    """
    found = [r["key"] for r in property_keys(df).limit(COLUMNS + 1).collect()]
    if len(found) > COLUMNS:
        raise ValueError(f"more than {COLUMNS} property keys: name those to become columns (keys=...)")
    return found


def geometry_types(df: DataFrame) -> DataFrame:
    return df.where(F.col("geom").isNotNull()).select(F.col("geom.type").alias("type")).distinct()


def feature_count(df: DataFrame, by: str | None = None) -> DataFrame:
    n = F.count(F.lit(1)).alias("feature_count")
    return df.groupBy(by).agg(n) if by else df.agg(n)


def preview(df: DataFrame, limit: int = 50, order_by: str | None = None, keys: list[str] | None = None, shown: bool = False) -> DataFrame:
    """The first rows as flat text columns of all keys; rows without properties are skipped.

    ``shown`` takes the keys of the rows that are shown: a table of very many keys is neither read for them nor refused.
    """
    rows = df.where(F.col("properties").isNotNull())
    first = rows.orderBy(order_by).limit(limit) if order_by else rows.limit(limit)
    if keys is None and shown:
        first = stored(first, "preview")
        keys = [r["key"] for r in property_keys(first).collect()]
    return flatten(first, key_list(rows) if keys is None else keys, geometry=None)


def with_geometry(df: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Rows that have a geometry, optionally of the given types."""
    g = F.col("geom")
    return df.where(g.isNotNull() if types is None else g["type"].isin(types))
