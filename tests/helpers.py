from pyspark.sql import functions as F

from gridfold.functions.geomtext import parse_wkt
from gridfold.schema import as_features


def features(spark, rows):
    """Features from (fid, wkt or None, properties text) rows."""
    rows = [(r[0], r[1], r[2] if len(r) > 2 else "{}") for r in rows]
    df = spark.createDataFrame(rows, "k bigint, w string, p string")
    return as_features(df, parse_wkt(F.col("w")), F.col("p"), F.col("k"))


def fids(df):
    return sorted(r["fid"] for r in df.select("fid").collect())


def box(x0, y0, x1, y1):
    return f"POLYGON (({x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}, {x0} {y0}))"
