"""Declared outputs, and a bundle of derived datasets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.plans.catalog import Catalog
from gridfold.sinks.files import write_csv, write_geojson, write_parquet
from gridfold.sinks.tiles import build_layers, build_tiles, read_tiles, write_tiles

STATUS = "source string, filename string, format string, path string, status string, error string"


def _sources(output: dict) -> list[str]:
    source = output["source"]
    return list(source) if isinstance(source, list) else [source]


def extracts(output: dict) -> bool:
    """Whether an output takes the tiles of one zoom out of a tile table instead of writing a dataset."""
    return output["format"] == "tiles" and (output.get("params") or {}).get("extractZoom") is not None


def missing_sources(catalog: Catalog, outputs: list[dict]) -> list[str]:
    """Ids named by outputs that the catalog does not have, each once; extracts read their table by its path."""
    return sorted({s for o in outputs if not extracts(o) for s in _sources(o) if not catalog.exists(s)})


def _write(catalog: Catalog, output: dict, path: str, urls: dict[str, str]) -> None:
    kind, params = output["format"], output.get("params") or {}
    if extracts(output):
        (source,) = _sources(output)
        zoom, box = params["extractZoom"], tuple(params["bbox"])
        found = read_tiles(catalog.spark, urls[source], box, zoom, params.get("layers"))
        found.select("layer", "fid", "geom", "bbox", "properties").write.mode("overwrite").parquet(path)
        return
    frames = {s: catalog.get(s) for s in _sources(output)}
    if kind == "tiles":
        zooms = (params.get("minzoom", 0), params.get("maxzoom", 14))
        if len(frames) > 1:
            tiles = build_layers(frames, *zooms)
        else:
            ((name, df),) = frames.items()
            tiles = build_tiles(df, *zooms, layer=params.get("layerName", name))
        write_tiles(tiles, path)
        return
    ((_, df),) = frames.items()
    {"geojson": write_geojson, "csv": write_csv, "parquet": write_parquet}[kind](df, path)


def run_outputs(catalog: Catalog, outputs: list[dict], folder: str, urls: dict[str, str] | None = None) -> DataFrame:
    """Write each output below ``folder``; one status row each, a failure does not stop the rest.

    Sources are looked up before anything is written.  An output with
    ``extractZoom`` and ``bbox`` takes the features of those tiles from the tile
    table at ``urls[source]``.
    """
    rows = []
    missing = set(missing_sources(catalog, outputs))
    for output in outputs:
        name = output.get("filename") or "-".join(_sources(output))
        path = f"{folder.rstrip('/')}/{name}.{output['format']}"
        row = [",".join(_sources(output)), name, output["format"], path]
        gone = [s for s in _sources(output) if s in missing and not extracts(output)]
        if gone:
            rows.append((*row, "error", f"unknown sources: {', '.join(gone)}"))
            continue
        try:
            _write(catalog, output, path, urls or {})
            rows.append((*row, "complete", None))
        except Exception as error:  # noqa: BLE001 - each output reports its own failure
            rows.append((*row, "error", str(error)[:500]))
    return catalog.spark.createDataFrame(rows, STATUS)


def _file_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-") or "dataset"


def write_bundle(catalog: Catalog, folder: str) -> DataFrame:
    """Every derived dataset as GeoJSON under ``data/`` with a unique name, and a manifest without operations."""
    used: set[str] = set()
    entries = []
    derived = catalog.derived_ids()
    for meta in catalog.entries():
        if meta["hidden"] and meta["id"] not in derived:
            continue
        url = meta["source_url"]
        if meta["id"] in derived or not url or url.startswith("file:"):
            base = _file_name(meta["name"])
            name, n = base, 2
            while name in used:
                name, n = f"{base}-{n}", n + 1
            used.add(name)
            write_geojson(catalog.get(meta["id"]), f"{folder.rstrip('/')}/data/{name}")
            url = f"./data/{name}"
        entries.append((meta["id"], meta["name"], url))
    manifest = catalog.spark.createDataFrame(entries, "id string, name string, url string")
    document = manifest.agg(F.to_json(F.struct(F.collect_list(F.struct("id", "name", "url")).alias("datasets"))).alias("value"))
    document.coalesce(1).write.mode("overwrite").text(f"{folder.rstrip('/')}/manifest")
    return manifest
