"""Readers from files to feature frames."""

from gridfold.sources.detect import format_column, read_features, resolve_format
from gridfold.sources.geojson import document_crs, features_of, read_geojson
from gridfold.sources.geoparquet import read_geoparquet
from gridfold.sources.guard import check_degrees, finish
from gridfold.sources.jsonarray import read_json_array
from gridfold.sources.pages import read_pages
from gridfold.sources.table import read_csv_features

__all__ = [
    "check_degrees",
    "document_crs",
    "features_of",
    "finish",
    "format_column",
    "read_csv_features",
    "read_features",
    "read_geojson",
    "read_geoparquet",
    "read_json_array",
    "read_pages",
    "resolve_format",
]
