"""Writers from feature frames to files."""

from gridfold.sinks.files import feature_text, write_csv, write_geojson, write_parquet
from gridfold.sinks.outputs import missing_sources, run_outputs, write_bundle
from gridfold.sinks.tiles import build_tiles, read_tiles, tile_sizes, write_tiles

__all__ = [
    "build_tiles",
    "feature_text",
    "missing_sources",
    "read_tiles",
    "run_outputs",
    "tile_sizes",
    "write_bundle",
    "write_csv",
    "write_geojson",
    "write_parquet",
    "write_tiles",
]
