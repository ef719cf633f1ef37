"""Which reader a path needs."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.sources.geojson import read_geojson
from gridfold.sources.geoparquet import read_geoparquet
from gridfold.sources.jsonarray import read_json_array
from gridfold.sources.table import read_csv_features

# Format by file extension and by last path segment.
BY_EXTENSION = {
    ".geojson": "geojson",
    ".json": "geojson",
    ".csv": "csv",
    ".tsv": "csv",
    ".parquet": "geoparquet",
    ".geoparquet": "geoparquet",
}
BY_SEGMENT = {"geojson": "geojson", "json": "geojson", "csv": "csv", "parquet": "geoparquet", "geoparquet": "geoparquet"}
#: Endings of files with one document a line; such files are split among tasks.
LINES = (".geojsonl", ".geojsons", ".ndjson", ".jsonl")
FORMATS = ["geojson", "json-array", "csv", "geoparquet"]


def resolve_format(path: str, explicit: str | None = None) -> str:
    """Explicit format, then extension, then last path segment, then GeoJSON."""
    if explicit is not None:
        if explicit not in FORMATS:
            raise ValueError(f"format must be one of {FORMATS}")
        return explicit
    last = urlparse(path).path.rstrip("/").rsplit("/", 1)[-1].lower()
    dot = last.rfind(".")
    if dot >= 0 and last[dot:] in BY_EXTENSION:
        return BY_EXTENSION[last[dot:]]
    return BY_SEGMENT.get(last, "geojson")


def format_column(url: Column) -> Column:
    """The same rule for a column of paths or URLs."""
    path = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/+$", "")
    last = F.lower(F.element_at(F.split(F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), "/"), -1))
    by_extension = F.create_map(*[F.lit(v) for pair in BY_EXTENSION.items() for v in pair])
    by_segment = F.create_map(*[F.lit(v) for pair in BY_SEGMENT.items() for v in pair])
    extension = F.regexp_extract(last, r"(\.[^.]*)$", 1)
    return F.coalesce(F.try_element_at(by_extension, extension), F.try_element_at(by_segment, last), F.lit("geojson"))


def read_features(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """Read with the resolved format; JSON that is no GeoJSON is tried as an array of objects."""
    kind = resolve_format(path, format)
    if kind == "csv":
        return read_csv_features(spark, path, **options)
    if kind == "geoparquet":
        return read_geoparquet(spark, path, **options)
    if kind == "json-array":
        return read_json_array(spark, path, **options)
    if urlparse(path).path.lower().rstrip("/").endswith(LINES):
        options.setdefault("lines", True)
    roles = {"geo_column", "lat_column", "lng_column", "table"}
    try:
        return read_geojson(spark, path, **{k: v for k, v in options.items() if k not in roles})
    except ValueError as error:
        if "not GeoJSON" not in str(error):
            raise
        return read_json_array(spark, path, **options)
