"""Parquet with a WKB geometry column."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from gridfold.functions import kernel
from gridfold.functions.project import to_degrees
from gridfold.functions.units import parse_crs
from gridfold.schema import as_features, table_only
from gridfold.session import stored
from gridfold.sources.guard import check_degrees, finish

# Names tried for the geometry column, in order.
GEOMETRY_NAMES = ["geometry", "geom", "wkb_geometry", "shape", "the_geom", "geo"]


def geometry_column(df: DataFrame) -> str | None:
    """Binary column with a known name, else the first binary column."""
    binary = [f.name for f in df.schema.fields if isinstance(f.dataType, BinaryType)]
    by_lower = {c.lower(): c for c in reversed(binary)}
    return next((by_lower[n] for n in GEOMETRY_NAMES if n in by_lower), binary[0] if binary else None)


def _footers(column: str):
    """Reads the ``geo`` entry of the footer of each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs
        import pyarrow.parquet as pq

        for batch in batches:
            found = []
            for uri in batch["file_path"]:
                fs, name = pyarrow.fs.FileSystem.from_uri(uri)
                meta = pq.read_metadata(name, filesystem=fs).metadata or {}
                columns = json.loads(meta.get(b"geo", b"{}")).get("columns", {})
                found.append(parse_crs(columns.get(column, {}).get("crs")))
            yield pd.DataFrame({"file_path": batch["file_path"], "crs": pd.Series(found, dtype=object)})

    return run


def file_crs(df: DataFrame, column: str) -> DataFrame:
    """``file_path, crs`` for each file of ``df``, its footer read in a task.

    A store that only Spark reaches fails here: name the system (``crs=``) then.
    """
    files = df.select("_metadata.file_path").distinct()
    return files.mapInPandas(_footers(column), "file_path string, crs string")


def read_geoparquet(
    spark: SparkSession,
    path: str,
    crs: str | None = None,
    default_crs: str | None = None,
    table: bool = False,
    fid_column: str | None = None,
    store: str | None = None,
) -> DataFrame:
    """Features of Parquet files; all other columns become properties, rows without geometry are dropped.

    Without ``crs`` each file is taken in the system that its own footer names.
    """
    kernel.install(spark)
    df = spark.read.parquet(path)
    column = None if table else geometry_column(df)
    others = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, BinaryType)]
    props = F.to_json(F.struct(*others), {"ignoreNullFields": "false"}) if others else F.lit("{}")
    fid = F.col(f"`{fid_column}`").cast("bigint") if fid_column else None
    if column is None:
        return finish(table_only(df, props, fid), check=False, store=store)
    geom = kernel.unpack(F.col(f"`{column}`"))
    if crs is None:
        files = stored(file_crs(df, column), "crs")
        named = files.select("crs").distinct().limit(2).collect()
        if len(named) > 1:
            rows = df.withColumn("_file", F.col("_metadata.file_path"))
            placed = rows.join(files.select(F.col("file_path").alias("_file"), F.coalesce("crs", F.lit(default_crs)).alias("_crs")), "_file")
            check_degrees(as_features(placed.where(F.col("_crs").isNull()), geom, props, fid))
            out = as_features(placed, to_degrees(geom, F.col("_crs")), props, fid).where(F.col("geom").isNotNull())
            return finish(out, check=False, store=store)
        detected = named[0]["crs"] if named else None
    else:
        detected = None
    return finish(as_features(df, geom, props, fid).where(F.col("geom").isNotNull()), crs, detected, default_crs, store=store)
