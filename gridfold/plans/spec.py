"""Checks of a declared pipeline; each returns a list of messages, empty when legal."""

from __future__ import annotations

from graphlib import CycleError, TopologicalSorter

from gridfold.functions.units import METERS_PER_UNIT
from gridfold.operators.attribute import OPERATORS
from gridfold.sources.detect import FORMATS

UNARY = ["buffer", "centroid", "attribute"]
MODES = {
    "intersection": ("filter", "clip"),
    "union": ("merge", "dissolve"),
    "difference": ("subtract", "exclude"),
    "contains": ("filter", "within"),
    "distance": ("filter", "annotate"),
    "join": ("inner", "left"),
}
OUTPUT_FORMATS = ["geojson", "csv", "parquet", "tiles"]


def _text(value: object) -> bool:
    return isinstance(value, str) and value.strip() != ""


def _number(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def check_dataset(d: dict, where: str) -> list[str]:
    out = [f"{where}: missing '{k}'" for k in ("id", "url") if not _text(d.get(k))]
    if "format" in d and d["format"] not in FORMATS:
        out.append(f"{where}.format: must be one of {FORMATS}")
    out += [f"{where}.{k}: must be text" for k in ("name", "latColumn", "lngColumn", "geoColumn", "crs") if k in d and not _text(d[k])]
    if "geoColumn" in d and ("latColumn" in d or "lngColumn" in d):
        out.append(f"{where}: geoColumn excludes latColumn and lngColumn")
    pages = d.get("paginate")
    if isinstance(pages, dict):
        n = pages.get("maxPages")
        if n is not None and (not isinstance(n, int) or n < 1):
            out.append(f"{where}.paginate.maxPages: must be a positive integer")
    elif pages is not None and not isinstance(pages, bool):
        out.append(f"{where}.paginate: must be a boolean or an object")
    return out


def _check_params(kind: str, p: dict, where: str) -> list[str]:
    out = []
    if kind == "buffer":
        if not _number(p.get("distance")) or p["distance"] <= 0:
            out.append(f"{where}.distance: must be a positive number")
        if not isinstance(p.get("dissolve", False), bool):
            out.append(f"{where}.dissolve: must be a boolean")
        q = p.get("quadSegs", 32)
        if not isinstance(q, int) or isinstance(q, bool) or q < 1:
            out.append(f"{where}.quadSegs: must be a positive integer")
    if kind in ("buffer", "distance") and p.get("units") not in METERS_PER_UNIT:
        out.append(f"{where}.units: must be one of {sorted(METERS_PER_UNIT)}")
    if kind in MODES and "mode" in p and p["mode"] not in MODES[kind]:
        out.append(f"{where}.mode: must be one of {MODES[kind]}")
    if kind == "distance":
        if "mode" not in p:
            out.append(f"{where}.mode: is required")
        limit = p.get("maxDistance")
        if limit is None and p.get("mode") == "filter":
            out.append(f"{where}.maxDistance: is required in filter mode")
        if limit is not None and (not _number(limit) or limit <= 0):
            out.append(f"{where}.maxDistance: must be a positive number")
    if kind == "attribute":
        structured = any(k in p for k in ("property", "operator", "value"))
        if structured and "where" in p:
            out.append(f"{where}: property and where exclude each other")
        elif "where" in p:
            out += [] if _text(p["where"]) else [f"{where}.where: must be text"]
        else:
            out += [] if _text(p.get("property")) else [f"{where}.property: is required"]
            value = p.get("value")
            out += [] if isinstance(value, str) or _number(value) else [f"{where}.value: must be text or a number"]
            if p.get("operator", "=") not in OPERATORS:
                out.append(f"{where}.operator: must be one of {sorted(OPERATORS)}")
    if kind == "join":
        out += [f"{where}.{k}: is required" for k in ("sourceKey", "targetKey") if not _text(p.get(k))]
    return out


def check_operation(op: dict, where: str) -> list[str]:
    kind = op.get("type")
    if kind not in UNARY and kind not in MODES:
        return [f"{where}.type: must be one of {[*UNARY, *MODES]}"]
    out = [] if _text(op.get("output")) else [f"{where}.output: is required"]
    if kind in UNARY:
        out += [] if _text(op.get("input")) else [f"{where}.input: is required"]
        out += [f"{where}: '{kind}' takes input, not inputs"] if "inputs" in op else []
    else:
        ids = op.get("inputs")
        if not isinstance(ids, list) or len(ids) < 2 or not all(_text(i) for i in ids):
            out.append(f"{where}.inputs: needs at least two ids")
        elif kind != "union" and len(ids) != 2:
            out.append(f"{where}.inputs: needs exactly two ids")
        out += [f"{where}: '{kind}' takes inputs, not input"] if "input" in op else []
    params = op.get("params")
    if params is None and kind in ("buffer", "attribute", "join"):
        return [*out, f"{where}.params: is required"]
    return out + _check_params(kind, params or {}, f"{where}.params") if params is not None else out


def check_output(o: dict, where: str, known: set[str]) -> list[str]:
    source = o.get("source")
    ids = source if isinstance(source, list) else [source]
    out = []
    if not ids or not all(_text(i) for i in ids):
        return [f"{where}.source: is required"]
    if isinstance(source, list) and o.get("format") != "tiles":
        out.append(f"{where}.source: a list is only legal for tiles")
    if o.get("format") not in OUTPUT_FORMATS:
        out.append(f"{where}.format: must be one of {OUTPUT_FORMATS}")
    out += [f"{where}.source: '{i}' is unknown" for i in ids if i not in known]
    p = o.get("params")
    if p is not None and o.get("format") != "tiles":
        out.append(f"{where}.params: only legal for tiles")
    elif p is not None:
        zooms = [p.get("minzoom", 0), p.get("maxzoom", 14)]
        if not all(isinstance(z, int) and 0 <= z <= 22 for z in zooms) or zooms[0] > zooms[1]:
            out.append(f"{where}.params: need 0 <= minzoom <= maxzoom <= 22")
        if isinstance(source, list) and "layerName" in p:
            out.append(f"{where}.params.layerName: not legal with several sources")
        zoom, box = p.get("extractZoom"), p.get("bbox")
        if zoom is not None:
            if isinstance(source, list):
                out.append(f"{where}.params.extractZoom: not legal with several sources")
            if not isinstance(zoom, int) or not 0 <= zoom <= 22:
                out.append(f"{where}.params.extractZoom: must be a whole number of 0 to 22")
            if not isinstance(box, list) or len(box) != 4 or not all(isinstance(v, int | float) for v in box) or box[0] >= box[2] or box[1] >= box[3]:
                out.append(f"{where}.params.bbox: needs west, south, east and north")
    return out


def _twice(values: list[str]) -> list[str]:
    return sorted({v for v in values if values.count(v) > 1})


def inputs_of(op: dict) -> list[str]:
    return list(op["inputs"]) if "inputs" in op else [op["input"]]


def check_spec(spec: dict) -> list[str]:
    datasets, operations = spec.get("datasets") or [], spec.get("operations") or []
    out = [m for i, d in enumerate(datasets) for m in check_dataset(d, f"datasets[{i}]")]
    out += [m for i, op in enumerate(operations) for m in check_operation(op, f"operations[{i}]")]
    ids, made = [d.get("id") for d in datasets], [op.get("output") for op in operations]
    out += [f"datasets: id '{v}' is used twice" for v in _twice(ids)]
    out += [f"operations: output '{v}' is used twice" for v in _twice(made)]
    out += [f"operations: output '{v}' hides a dataset" for v in sorted(set(ids) & set(made))]
    known = set(ids) | set(made)
    outputs = spec.get("outputs") or []
    out += [m for i, o in enumerate(outputs) for m in check_output(o, f"outputs[{i}]", known)]
    names = [
        f"{o.get('filename') or '-'.join(o['source'] if isinstance(o['source'], list) else [o['source']])}.{o.get('format')}"
        for o in outputs
        if o.get("source")
    ]
    out += [f"outputs: file '{v}' is written twice" for v in _twice(names)]
    return out


def execution_order(ids: set[str], operations: list[dict]) -> list[dict]:
    """Operations so that inputs come first; unknown inputs and cycles reject the whole list."""
    by_output = {op["output"]: op for op in operations}
    unknown = sorted({i for op in operations for i in inputs_of(op)} - ids - set(by_output))
    if unknown:
        raise ValueError(f"unknown inputs: {unknown}")
    sorter = TopologicalSorter({o: [i for i in inputs_of(op) if i in by_output] for o, op in by_output.items()})
    try:
        return [by_output[o] for o in sorter.static_order()]
    except CycleError as error:
        raise ValueError(f"operations form a cycle: {error.args[1]}") from error
