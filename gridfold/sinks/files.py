"""GeoJSON, CSV and Parquet files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.functions import kernel
from gridfold.functions.geomtext import geojson_of, wkt_of
from gridfold.functions.props import json_member
from gridfold.operators.inspect import key_list
from gridfold.schema import computed

#: Features of one GeoJSON document; further ones go to further documents.
DOCUMENT_ROWS = 10_000


def feature_text(geom: Column, properties: Column) -> Column:
    """One GeoJSON Feature as text."""
    return F.concat(
        F.lit('{"type":"Feature","geometry":'),
        geojson_of(geom),
        F.lit(',"properties":'),
        F.coalesce(properties, F.lit("{}")),
        F.lit("}"),
    )


def write_geojson(df: DataFrame, path: str, document: bool = False) -> None:
    """Newline-delimited Features in parallel files, or, ``document``, FeatureCollections of at most ``DOCUMENT_ROWS`` features, one to a file.

    Rows without geometry are left out.
    """
    rows = df.where(F.col("geom").isNotNull()).select(feature_text(F.col("geom"), F.col("properties")).alias("value"))
    if not document:
        rows.write.mode("overwrite").text(path)
        return
    # The number of a row is its task above its place there, so a document is a run of rows of one task.
    number = F.monotonically_increasing_id()
    per = rows.withColumn("n", number).groupBy(F.shiftright("n", 33).alias("task"), F.floor(F.col("n").bitwiseAND(2**33 - 1) / DOCUMENT_ROWS).alias("run"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("n", "value"))), lambda r: r["value"])
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(listed, ","), F.lit("]}"))
    per.agg(text.alias("value")).select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def flat_columns(df: DataFrame, geometry: Column, keys: list[str] | None, typed: bool) -> DataFrame:
    """Geometry first, then one column per key; text by default, or as typed by JSON with ``typed``."""
    names = key_list(df) if keys is None else keys
    shaped = computed(df, _geometry=geometry)
    text = [json_member(F.col("properties"), k).alias(k if k != "geometry" else "geometry_1") for k in names]
    if typed and names:
        kinds = {r["key"]: r["numeric"] for r in _numeric(df).collect()}
        text = [c.try_cast("double").alias(k) if kinds.get(k) else c for k, c in zip(names, text)]
    return shaped.select(F.col("_geometry").alias("geometry"), *text)


def _numeric(df: DataFrame) -> DataFrame:
    from gridfold.operators.shape import numeric_properties

    return numeric_properties(df)


def write_csv(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """WKT geometry and one text column per property key, with a header."""
    flat = flat_columns(df, wkt_of(F.col("geom")), keys, False)
    flat.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_parquet(df: DataFrame, path: str, keys: list[str] | None = None, typed: bool = False) -> None:
    """WKB geometry and one column per property key."""
    kernel.install(df.sparkSession)
    flat_columns(df, kernel.pack(F.col("geom")), keys, typed).write.mode("overwrite").parquet(path)
