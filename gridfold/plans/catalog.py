"""Named feature frames of a session, their metadata and lineage."""

from __future__ import annotations

import json
import time
from datetime import datetime, timezone
from itertools import chain, count

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridfold.functions.names import slugify

DATASETS = (
    "id string, name string, source_url string, format string, source_layer string, source_crs string, "
    "hidden boolean, is_spatial boolean, feature_count bigint, layer_order int, loaded_at timestamp"
)
LINEAGE = "output_id string, type string, inputs array<string>, params string, exec_order int"


def encoded(id: str) -> str:
    """A different name of letters, digits and ``_`` for each id."""
    return "".join(c if c.isascii() and c.isalnum() else f"_{ord(c):x}_" for c in id)


EVENT = "kind string, id string, at bigint, state string"


class Catalog:
    """Datasets by id.  Entries are option-sized; the data stays in the frames.

    With a folder, every change is appended there as rows of the entries it touched, and a catalog opened
    later on the same folder starts from the last row of each entry: metadata, order, lineage, and the
    frames that were stored.  Datasets that were never stored are listed, but ``get`` doesn't know them.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder.rstrip("/") if folder else None
        self._frames: dict[str, DataFrame] = {}
        self._meta: dict[str, dict] = {}
        self._lineage: dict[str, dict] = {}
        self._saved: dict[tuple[str, str], str] = {}
        if self.folder:
            self._open()

    # -- durable state --

    def _events(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(EVENT).parquet(f"{self.folder}/_events")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _open(self) -> None:
        events = self._events()
        if events is None:
            return
        last = events.groupBy("kind", "id").agg(F.max_by("state", "at").alias("state")).where("state is not null")
        for r in last.collect():  # entries, not features
            self._saved[r["kind"], r["id"]] = r["state"]
        states = {k: json.loads(v) for k, v in self._saved.items()}
        datasets = sorted((v for (kind, _), v in states.items() if kind == "dataset"), key=lambda v: v["place"])
        for meta in datasets:
            meta.pop("place")
            meta["loaded_at"] = datetime.fromisoformat(meta["loaded_at"])
            self._meta[meta["id"]] = meta
            if meta.get("path"):
                self._frames[meta["id"]] = self.spark.read.parquet(meta["path"])
                self._frames[meta["id"]].createOrReplaceTempView(self._view(meta["id"]))
        self._lineage = {id: v for (kind, id), v in states.items() if kind == "lineage"}

    def _save(self) -> None:
        """Append a row for each entry that changed since the last time; a removed one has no state."""
        if not self.folder:
            return
        now = {("dataset", id): json.dumps({**m, "place": i}, default=lambda t: t.isoformat(), sort_keys=True) for i, (id, m) in enumerate(self._meta.items())}
        now |= {("lineage", id): json.dumps(v, sort_keys=True) for id, v in self._lineage.items()}
        at = time.time_ns()
        changed = [(*k, at, v) for k, v in now.items() if self._saved.get(k) != v] + [(*k, at, None) for k in self._saved if k not in now]
        if changed:
            self.spark.createDataFrame(changed, EVENT).coalesce(1).write.mode("append").parquet(f"{self.folder}/_events")
        self._saved = now

    # -- datasets --

    def register(self, id: str, df: DataFrame, **meta) -> DataFrame:
        """Add or replace a dataset and its view; an entry keeps its place when it is replaced."""
        old = self._meta.get(id)
        top = max([m["layer_order"] for m in self._meta.values()], default=0)
        self._meta[id] = {
            "id": id,
            "name": meta.get("name") or id,
            "source_url": meta.get("source_url"),
            "format": meta.get("format"),
            "source_layer": meta.get("source_layer"),
            "source_crs": meta.get("source_crs"),
            "hidden": bool(meta.get("hidden", False)),
            "is_spatial": bool(meta.get("is_spatial", True)),
            "feature_count": meta.get("feature_count"),
            "layer_order": old["layer_order"] if old else top + 1,
            "loaded_at": datetime.now(timezone.utc).replace(tzinfo=None),
            "path": meta.get("path"),
        }
        self._frames[id] = df
        df.createOrReplaceTempView(self._view(id))
        self._save()
        return df

    @staticmethod
    def _view(id: str) -> str:
        return id if id.isidentifier() and id.isascii() else encoded(id)

    def exists(self, id: str) -> bool:
        return id in self._frames

    def get(self, id: str) -> DataFrame:
        if id not in self._frames:
            raise KeyError(f"dataset '{id}' not found")
        return self._frames[id]

    def entries(self) -> list[dict]:
        return list(self._meta.values())

    def datasets(self, include_hidden: bool = False) -> DataFrame:
        """Metadata, the highest place first."""
        columns = [c.split()[0] for c in DATASETS.split(", ")]
        rows = [tuple(m[c] for c in columns) for m in self._meta.values()]
        out = self.spark.createDataFrame(rows, DATASETS)
        out = out if include_hidden else out.where(~F.col("hidden"))
        return out.orderBy(F.col("layer_order").desc())

    def refresh_count(self, id: str) -> int:
        self._meta[id]["feature_count"] = self.get(id).count()
        self._save()
        return self._meta[id]["feature_count"]

    def append(self, id: str, page: DataFrame) -> DataFrame:
        """Add rows to a dataset; the count is unknown until refreshed."""
        merged = self.get(id).unionByName(page)
        self._frames[id] = merged
        self._meta[id].update(feature_count=None, path=None)
        self._save()
        merged.createOrReplaceTempView(self._view(id))
        return merged

    def rename(self, old: str, new_name: str) -> str:
        """Give a dataset a new name and the id made from it; lineage follows."""
        meta = self._meta[old]
        base = slugify(new_name)
        taken = set(self._meta) - {old}
        new = next(c for c in chain([base], (f"{base}_{n}" for n in count(2))) if c not in taken)
        order = list(self._meta)
        self._meta = {new if k == old else k: self._meta[k] for k in order}
        self._frames = {new if k == old else k: self._frames[k] for k in list(self._frames)}
        meta.update(id=new, name=new_name)
        self.spark.catalog.dropTempView(self._view(old))
        if new in self._frames:
            self._frames[new].createOrReplaceTempView(self._view(new))
        for row in self._lineage.values():
            row["inputs"] = [new if i == old else i for i in row["inputs"]]
        if old in self._lineage:
            self._lineage = {new if k == old else k: v for k, v in self._lineage.items()}
            self._lineage[new]["output_id"] = new
        self._save()
        return new

    def delete(self, id: str) -> None:
        """Remove a dataset, its ``id/child`` datasets, and their lineage."""
        for key in [k for k in self._meta if k == id or k.startswith(f"{id}/")]:
            self.spark.catalog.dropTempView(self._view(key))
            self._frames.pop(key, None), self._meta.pop(key), self._lineage.pop(key, None)
        self._save()

    def delete_all(self) -> None:
        for key in list(self._meta):
            if key in self._meta:
                self.delete(key)

    def reorder(self, ids: list[str]) -> None:
        """Set places to the positions in the list."""
        for place, id in enumerate(ids, 1):
            self._meta[id]["layer_order"] = place
        self._save()

    def swap(self, a: str, b: str) -> None:
        x, y = self._meta[a], self._meta[b]
        x["layer_order"], y["layer_order"] = y["layer_order"], x["layer_order"]
        self._save()

    # -- lineage --

    def record(self, output: str, type: str, inputs: list[str], params: dict, order: int) -> None:
        self._lineage[output] = {
            "output_id": output,
            "type": type,
            "inputs": list(inputs),
            "params": json.dumps(params or {}),
            "exec_order": order,
        }
        self._save()

    def lineage(self) -> DataFrame:
        rows = [(v["output_id"], v["type"], v["inputs"], v["params"], v["exec_order"]) for v in self._lineage.values()]
        return self.spark.createDataFrame(rows, LINEAGE).orderBy("exec_order")

    def derived_ids(self) -> set[str]:
        return set(self._lineage)

    def spec(self) -> list[dict]:
        """The recorded operations as a spec."""
        unary = ("buffer", "centroid", "attribute")
        out = []
        for v in sorted(self._lineage.values(), key=lambda v: v["exec_order"]):
            op = {"type": v["type"], "output": v["output_id"], "params": json.loads(v["params"])}
            op.update({"input": v["inputs"][0]} if v["type"] in unary else {"inputs": v["inputs"]})
            out.append(op)
        return out

    # -- persisted results --

    def path(self, id: str) -> str | None:
        return f"{self.folder}/{encoded(id)}" if self.folder else None

    def restore(self, id: str, made_by: str) -> DataFrame | None:
        """The stored result of ``made_by`` (a text naming operation, parameters and inputs), else ``None``.

        The note beside a result is written after it, so a killed write and a
        result of other parameters are both made again.
        """
        path = self.path(id)
        if path is None:
            return None
        try:
            note = self.spark.read.schema("made_by string").parquet(f"{path}.note").first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return self.spark.read.parquet(path) if note is not None and note["made_by"] == made_by else None

    def persist(self, id: str, made_by: str = "") -> DataFrame:
        """Write a dataset to the catalog folder, note what made it, and continue from the files."""
        path = self.path(id)
        if path is None:
            return self.get(id)
        df = self.get(id)
        note = self.spark.createDataFrame([(made_by,)], "made_by string").coalesce(1)
        note.where(F.lit(False)).write.mode("overwrite").parquet(f"{path}.note")
        df.write.mode("overwrite").parquet(path)
        note.write.mode("overwrite").parquet(f"{path}.note")
        meta = self._meta[id]
        return self.register(id, self.spark.read.schema(df.schema).parquet(path), **{**{k: meta[k] for k in meta if k != "id"}, "path": path})


def digest(df: DataFrame) -> str:
    """Of a frame's columns and rows, whatever their order: count, and two sums of row hashes."""
    first = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    second = F.xxhash64(F.lit("again"), *[F.col(f"`{c}`") for c in df.columns])
    row = df.agg(F.count(F.lit(1)), F.bit_xor(first), F.sum(F.shiftright(first, 20)), F.sum(F.shiftright(second, 20)), F.bit_xor(second)).first()
    return f"{df.schema.simpleString()}:{':'.join(map(str, row))}"


def backfill_order(catalog: DataFrame) -> DataFrame:
    """Places for catalog rows without one, by load time; catalog rows only, never features."""
    place = F.row_number().over(Window.orderBy("loaded_at", "id"))
    return catalog.withColumn("layer_order", F.coalesce("layer_order", place))
