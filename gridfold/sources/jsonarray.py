"""JSON arrays of plain objects to features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.functions.geomtext import parse_geojson
from gridfold.functions.props import json_member
from gridfold.schema import as_features, table_only
from gridfold.sources.geojson import feature_texts, features_of, read_documents
from gridfold.sources.guard import finish
from gridfold.sources.roles import GEOMETRY_NAMES, Profile, chosen, pair, position, position_columns, profile_members


def _without(item: Column, keys: list[str]) -> Column:
    """Item text without the members used for geometry; the other members keep their values."""
    members = F.from_json(item, "map<string,variant>")
    return F.to_json(F.map_filter(members, lambda k, v: ~k.isin(keys)))


def array_features(
    items: DataFrame,
    item: Column,
    profiles: dict[str, Profile],
    geo_column: str | None = None,
    lat_column: str | None = None,
    lng_column: str | None = None,
    table: bool = False,
    fid: Column | None = None,
) -> DataFrame:
    """Features of item texts; ``profiles`` of their members decide which one is the geometry.

    Order: named pair member, latitude and longitude (if any item has both), GeoJSON; else rows without geometry.
    """

    def rows(geom: Column, used: list[str]) -> DataFrame:
        return as_features(items, geom, _without(item, used), fid).where(F.col("geom").isNotNull())

    if not table and geo_column is not None:
        return rows(pair(json_member(item, geo_column)), [geo_column])
    if not table:
        try:
            lat, lng = (lat_column, lng_column) if lat_column and lng_column else position_columns(list(profiles))
            out = rows(
                position(json_member(item, lat).try_cast("double"), json_member(item, lng).try_cast("double")), [lat, lng]
            )
            if items.isStreaming or not out.isEmpty():
                return out
        except ValueError:
            pass
        shape = chosen(profiles, GEOMETRY_NAMES, "shapes")
        if shape is not None:
            return rows(parse_geojson(json_member(item, shape)), [shape])
    return table_only(items, item, fid)


def read_json_array(
    spark: SparkSession,
    path: str,
    lines: bool = False,
    geo_column: str | None = None,
    lat_column: str | None = None,
    lng_column: str | None = None,
    table: bool = False,
    crs: str | None = None,
    default_crs: str | None = None,
    fid_property: str | None = None,
    store: str | None = None,
) -> DataFrame:
    """Features of JSON arrays (or object lines); an array of GeoJSON Features is read as GeoJSON."""
    docs = read_documents(spark, path, lines)
    if not lines:
        geojson = docs.select(F.explode(feature_texts(F.col("value"))).alias("item"))
        if not table and not geojson.limit(1).isEmpty():
            return finish(features_of(geojson, F.col("item")), crs, None, default_crs, store=store)
    array = F.from_json(F.col("value"), "array<string>")
    items = docs.select(F.col("value").alias("item") if lines else F.explode(array).alias("item"))
    items = items.where(F.trim("item").startswith("{"))
    if items.isEmpty():
        raise ValueError("not a JSON array of objects")
    item = F.col("item")
    fid = json_member(item, fid_property).try_cast("bigint") if fid_property else None
    if geo_column is not None and not table and items.where(json_member(item, geo_column).isNotNull()).isEmpty():
        raise ValueError(f"column '{geo_column}' not found in any item")
    profiles = {} if table or geo_column else profile_members(items, item)
    out = array_features(items, item, profiles, geo_column, lat_column, lng_column, table, fid)
    return finish(out, crs, None, default_crs, check=not table, store=store)
