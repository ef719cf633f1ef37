"""Last steps of every reader: degree check, reprojection, stored identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.functions.project import reproject
from gridfold.functions.units import resolve_crs
from gridfold.schema import with_bbox


def _projected() -> Column:
    b = F.col("bbox")
    wide = F.greatest(F.abs(b["xmin"]), F.abs(b["xmax"])) > 180
    return wide | (F.greatest(F.abs(b["ymin"]), F.abs(b["ymax"])) > 90)


def check_degrees(df: DataFrame) -> None:
    """Raise when coordinates of any row cannot be degrees; stops at the first hit."""
    rows = df.where(F.col("geom").isNotNull())
    if not rows.where(_projected()).limit(1).isEmpty():
        raise ValueError("coordinates are outside degrees: name the source CRS (crs=...)")


def finish(
    df: DataFrame,
    crs: str | None = None,
    detected: str | None = None,
    default_crs: str | None = None,
    check: bool = True,
    store: str | None = None,
) -> DataFrame:
    """Bring a freshly read frame to degrees and, with ``store``, fix its ids in Parquet files."""
    source = resolve_crs(crs, detected, default_crs)
    if source is not None:
        df = with_bbox(df.withColumn("geom", reproject(F.col("geom"), source, "EPSG:4326")))
    elif check and crs is None and detected is None:
        check_degrees(df)
    if store is not None:
        df.write.mode("overwrite").parquet(store)
        df = df.sparkSession.read.schema(df.schema).parquet(store)
    return df
