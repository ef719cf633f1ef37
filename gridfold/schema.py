"""The feature row: identity, geometry, envelope, properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.functions import kernel
from gridfold.functions.measure import bbox_of

VERTEX = "struct<x:double,y:double>"
PARTS = f"array<array<array<{VERTEX}>>>"
#: ``parts`` is polygon list -> ring list -> vertex list; a point is [[[p]]], a line [[[p, p, ..]]].
#: ``kinds`` names each part of a GeometryCollection (P, L or A) and is NULL for all other types.
GEOM = f"struct<type:string,kinds:string,parts:{PARTS}>"
BBOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
FEATURE = f"fid bigint, geom {GEOM}, bbox {BBOX}, properties string"
COLUMNS = ["fid", "geom", "bbox", "properties"]


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add or replace columns, each evaluated exactly once per row.

    A plain projection is copied into every filter that Spark pushes through it
    (null checks of join keys included), which multiplies long geometry
    expressions.  A one-row generator is a boundary for that, while filters on
    other columns still go below it.
    """
    rest = [c for c in df.columns if c not in columns]
    one = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*[F.col(f"`{c}`") for c in rest], F.inline(F.array(one)))


def as_features(df: DataFrame, geom: Column, properties: Column, fid: Column | None = None) -> DataFrame:
    """Feature rows from column expressions.

    ``fid`` should come from a key column where there is one.  Without it an id
    is drawn from the row position, which is stable only for a fixed file
    layout (``store=`` of the readers fixes it).  Operators number rows
    themselves, so ids may repeat or be missing.
    """
    fid = F.monotonically_increasing_id() if fid is None else fid
    return with_bbox(df.select(fid.cast("bigint").alias("fid"), properties.alias("properties"), geom.alias("geom")))


def with_bbox(df: DataFrame) -> DataFrame:
    """Recompute the envelope after ``geom`` changed."""
    shaped = computed(df, geom=F.col("geom"))
    return computed(shaped, bbox=bbox_of(F.col("geom"))).select(*COLUMNS)


def from_wkb(df: DataFrame, wkb: Column) -> DataFrame:
    """Geometry and envelope from a WKB column, which is evaluated once."""
    shaped = computed(df, _shape=wkb)
    both = {"geom": kernel.unpack(F.col("_shape")), "bbox": kernel.bounds(F.col("_shape"))}
    return computed(shaped, **both).select(*COLUMNS)


def table_only(df: DataFrame, properties: Column, fid: Column | None = None) -> DataFrame:
    """Rows without geometry."""
    return as_features(df, F.lit(None).cast(GEOM), properties, fid)
