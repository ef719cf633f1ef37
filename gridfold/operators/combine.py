"""Bag union, dissolve, append and de-duplication of feature frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.functions import kernel
from gridfold.functions.measure import representative_point
from gridfold.schema import COLUMNS, with_bbox

DISSOLVED = '{"dissolved": true}'
#: Cells per axis of the first and second union level.
FINE, COARSE, SALTS = 64, 8, 16


def merge(inputs: list[DataFrame]) -> DataFrame:
    """All rows of all inputs, renumbered as ``fid * inputs + index``, so ids of different inputs differ.

    An id beyond that range, as of hashed ids, becomes a hash of itself and the
    index.  No operator takes ``fid`` for a key, so a chance repeat does no harm.
    """
    if len(inputs) < 2:
        raise ValueError("union: needs at least two inputs")
    n = len(inputs)
    id = F.col("fid")

    def number(i: int) -> Column:
        beyond = F.when(id.isNotNull(), F.xxhash64(id, F.lit(i)))
        return F.coalesce(F.try_add(F.try_multiply(id, F.lit(n)), F.lit(i)), beyond)

    return reduce(DataFrame.unionByName, [df.select(*COLUMNS).withColumn("fid", number(i)) for i, df in enumerate(inputs)])


def append(df: DataFrame, page: DataFrame) -> DataFrame:
    """Add rows of a further page, without de-duplication."""
    return df.unionByName(page)


def union_tree(shapes: DataFrame) -> DataFrame:
    """One ``wkb`` from rows of ``wkb`` and ``bbox``: unions per cell, per coarse cell, then one.

    Every step combines before its shuffle.  A crowded cell is split over salts
    first, so no task gathers a whole cell and the last step sees at most
    ``COARSE * COARSE`` shapes.
    """
    step = FINE // COARSE
    joined = lambda df, keys: df.groupBy(*keys).agg(kernel.union_agg(F.col("wkb")).alias("wkb"))
    salted = joined(chunked(shapes).select("wkb", "cx", "cy", "salt"), ["cx", "cy", "salt"])
    cells = joined(salted, ["cx", "cy"])
    blocks = joined(
        cells.withColumn("cx", F.floor(F.col("cx") / step)).withColumn("cy", F.floor(F.col("cy") / step)), ["cx", "cy"]
    )
    return joined(blocks, []).where(F.col("wkb").isNotNull())


def chunked(shapes: DataFrame) -> DataFrame:
    """``shapes`` with their chunk of the first union level: cell ``cx, cy`` of the middle, and ``salt``."""
    b = F.col("bbox")
    extent = shapes.agg(
        F.struct(
            F.min(b["xmin"]).alias("x"),
            F.min(b["ymin"]).alias("y"),
            F.greatest(F.max(b["xmax"]) - F.min(b["xmin"]), F.lit(1e-9)).alias("w"),
            F.greatest(F.max(b["ymax"]) - F.min(b["ymin"]), F.lit(1e-9)).alias("h"),
        ).alias("extent")
    ).scalar()

    def cell(low: str, high: str, origin: str, size: str) -> Column:
        share = ((b[low] + b[high]) / 2 - F.col("_e")[origin]) / F.col("_e")[size]
        return F.least(F.floor(share * FINE), F.lit(FINE - 1)).cast("int")

    salt = F.pmod(F.xxhash64("bbox", "wkb"), F.lit(SALTS)).cast("int")
    return shapes.withColumn("_e", extent).select(
        *shapes.columns, cell("xmin", "xmax", "x", "w").alias("cx"), cell("ymin", "ymax", "y", "h").alias("cy"), salt.alias("salt")
    )


def one_feature(wkb: DataFrame) -> DataFrame:
    out = wkb.select(
        F.lit(0).cast("bigint").alias("fid"), kernel.unpack(F.col("wkb")).alias("geom"), F.lit(DISSOLVED).alias("properties")
    )
    return with_bbox(out)


def dissolve(inputs: list[DataFrame]) -> DataFrame:
    """One feature covering what any input covers; empty when there is no geometry at all."""
    every = merge(inputs) if len(inputs) > 1 else inputs[0]
    kernel.install(every.sparkSession)
    shapes = every.where(F.col("geom").isNotNull()).select(
        kernel.repair(kernel.pack(F.col("geom"))).alias("wkb"), "bbox"
    )
    return one_feature(union_tree(shapes))


def union(inputs: list[DataFrame], mode: str = "merge") -> DataFrame:
    """``merge`` keeps single features, ``dissolve`` makes one."""
    if len(inputs) < 2:
        raise ValueError("union: needs at least two inputs")
    if mode not in ("merge", "dissolve"):
        raise ValueError("union: mode must be 'merge' or 'dissolve'")
    return merge(inputs) if mode == "merge" else dissolve(inputs)


def dedup_features(df: DataFrame, layer: str = "layer", order: list[str] | None = None) -> DataFrame:
    """Per layer one of the features that agree on the rounded representative point and properties.

    With ``order`` the kept row is the first by those columns; a struct minimum
    finds it with a combine before the shuffle, so copies never meet in one task.
    """
    p = representative_point(F.col("geom"))
    key = [
        F.floor(p["x"] * 1e5 + 0.5).alias("_kx"),
        F.floor(p["y"] * 1e5 + 0.5).alias("_ky"),
        F.coalesce(F.col("properties"), F.lit("{}")).alias("_kp"),
    ]
    names = ["_kx", "_ky", "_kp"]
    if layer in df.columns:
        key.append(F.col(layer).alias("_kl"))
        names.append("_kl")
    first = F.min_by(F.struct(*df.columns), F.struct(*(order or ["fid"]))).alias("row")
    return df.where(F.col("geom").isNotNull()).select("*", *key).groupBy(*names).agg(first).select("row.*")
