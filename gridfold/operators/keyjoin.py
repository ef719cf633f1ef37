"""Join features to table rows on a property value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.functions.props import json_value, merge_properties
from gridfold.plans.grid import anchored
from gridfold.plans.skew import evened, spread
from gridfold.schema import COLUMNS


def join(
    source: DataFrame,
    target: DataFrame,
    source_key: str,
    target_key: str,
    mode: str = "left",
    hot_rows: int | None = None,
) -> DataFrame:
    """``target`` features with the properties of equal-keyed ``source`` rows merged in.

    Source values win.  Keys compare as text.  Several source rows of one key
    multiply the target row.  Target rows without geometry are dropped.  Hot keys
    are split on both sides; in ``left`` mode the rows without partner are kept
    apart, so a copied target row never counts as unmatched.
    """
    if mode not in ("left", "inner"):
        raise ValueError("join: mode must be 'left' or 'inner'")
    t = target.where(F.col("geom").isNotNull()).withColumn("_key", json_value(F.col("properties"), target_key))
    s = source.select(json_value(F.col("properties"), source_key).alias("_key"), F.col("properties").alias("_patch"))
    s = s.where(F.col("_key").isNotNull())
    t, s = anchored(t), anchored(s).withColumnRenamed("_row", "_other")
    rows, patches = t.count(), s.count()
    met = evened(t.where(F.col("_key").isNotNull()), rows)
    met, salted, keys, _ = spread(met, s, ["_key"], F.col("_row"), F.col("_other"), rows, patches, hot_rows)
    columns = [*COLUMNS, "_patch"]
    joined = met.join(salted, keys).select(*columns)
    if mode == "left":
        alone = t.join(s.select("_key").distinct(), "_key", "left_anti")
        joined = joined.unionByName(alone.withColumn("_patch", F.lit(None).cast("string")).select(*columns))
    return joined.withColumn("properties", merge_properties(F.col("properties"), F.col("_patch"))).select(*COLUMNS)
