"""Run a declared pipeline: datasets, then operations, as chained lazy frames."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from gridfold import operators as ops
from gridfold.plans.catalog import Catalog, digest
from gridfold.plans.spec import check_spec, execution_order, inputs_of
from gridfold.session import stored
from gridfold.sources import read_features, read_pages

REPORT = "step string, id string, status string, error string"
_OPTIONS = {"format": "format", "latColumn": "lat_column", "lngColumn": "lng_column", "geoColumn": "geo_column", "crs": "crs"}


def load_dataset(spark: SparkSession, entry: dict, default_crs: str | None = None, store: str | None = None) -> DataFrame:
    options = {new: entry[old] for old, new in _OPTIONS.items() if old in entry}
    pages = entry.get("paginate")
    if pages:
        options.pop("format", None)
        limit = pages.get("maxPages") if isinstance(pages, dict) else None
        return read_pages(spark, entry["url"], max_pages=limit, default_crs=default_crs, store=store, **options)
    return read_features(spark, entry["url"], default_crs=default_crs, store=store, **options)


def run_operation(op: dict, inputs: list[DataFrame]) -> DataFrame:
    """One operation of a spec over its input frames."""
    kind, p = op["type"], op.get("params") or {}
    if kind == "buffer":
        return ops.buffer(inputs[0], p["distance"], p.get("units", "meters"), p.get("quadSegs", 32), p.get("dissolve", False))
    if kind == "centroid":
        return ops.centroid(inputs[0])
    if kind == "attribute":
        return ops.attribute(inputs[0], p.get("property"), p.get("operator", "="), p.get("value"), p.get("where"))
    if kind == "union":
        return ops.union(inputs, p.get("mode", "merge"))
    a, b = inputs
    if kind == "join":
        return ops.join(a, b, p["sourceKey"], p["targetKey"], p.get("mode", "left"))
    if kind == "distance":
        return ops.distance(a, b, p.get("mode", "filter"), p.get("maxDistance"), p.get("units", "meters"))
    default = {"intersection": "filter", "difference": "subtract", "contains": "filter"}[kind]
    return getattr(ops, kind)(a, b, p.get("mode", default))


def run_pipeline(
    spark: SparkSession, spec: dict, catalog: Catalog | None = None, frames: dict[str, DataFrame] | None = None
) -> tuple[Catalog, DataFrame]:
    """Load the datasets and chain the operations of a spec.

    ``frames`` supplies datasets that are frames already.  A dataset or operation
    that fails is reported and the rest goes on; an illegal spec, an unknown input
    or a cycle rejects everything.  Every dataset and result is written before it
    is reported complete, so each step starts from files.  With a catalog folder
    results are reused by later runs of the same operations over inputs of the same content:
    each dataset is digested once it is written, and the digests are chained through the operations.
    """
    frames = frames or {}
    declared = [*(spec.get("datasets") or []), *({"id": i, "url": f"frame:{i}"} for i in frames)]
    problems = check_spec({**spec, "datasets": declared})
    if problems:
        raise ValueError("; ".join(problems))
    catalog = catalog or Catalog(spark)
    order = execution_order({d["id"] for d in declared}, spec.get("operations") or [])
    report = []
    origin: dict[str, str] = {}
    made: set[str] = set()  # in this run: a catalog's folder may hold results of others under the same names
    crs = (spec.get("map") or {}).get("crs")
    for entry in declared:
        id = entry["id"]
        try:
            if id in frames:
                df = stored(frames[id], "dataset")
            else:
                store = catalog.path(id)
                df = load_dataset(spark, entry, crs, store)
                df = df if store else stored(df, "dataset")
            catalog.register(
                id, df, name=entry.get("name"), source_url=entry["url"], format=entry.get("format"),
                hidden=entry.get("hidden", False), source_crs=entry.get("crs"), path=catalog.path(id) if id not in frames else None,
            )
            if catalog.folder:
                origin[id] = digest(df)
            made.add(id)
            report.append(("dataset", id, "complete", None))
        except Exception as error:  # noqa: BLE001 - reported, the other steps go on
            report.append(("dataset", id, "error", str(error)[:500]))
    for place, op in enumerate(order):
        id = op["output"]
        try:
            made_by = json.dumps([op["type"], op.get("params") or {}, [origin.get(i) for i in inputs_of(op)]], sort_keys=True, default=str)
            made_by = origin[id] = hashlib.sha256(made_by.encode()).hexdigest()
            missing = [i for i in inputs_of(op) if i not in made]
            if missing:
                raise KeyError(f"dataset '{missing[0]}' not found")
            before = catalog.restore(id, made_by)
            df = before if before is not None else run_operation(op, [catalog.get(i) for i in inputs_of(op)])
            if before is None and catalog.folder is None:
                df = stored(df, "result")
            catalog.register(id, df, name=op.get("name"), source_url=f"operation:{op['type']}", path=catalog.path(id) if before is not None else None)
            if before is None:
                catalog.persist(id, made_by)
            catalog.record(id, op["type"], inputs_of(op), op.get("params") or {}, place)
            made.add(id)
            report.append(("operation", id, "complete", None))
        except Exception as error:  # noqa: BLE001
            report.append(("operation", id, "error", str(error)[:500]))
    return catalog, spark.createDataFrame(report, REPORT)
