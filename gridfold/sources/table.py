"""Delimited text with a header to features."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.functions.props import typed_json
from gridfold.schema import as_features, table_only
from gridfold.sources.guard import finish
from gridfold.sources.ranges import open_ranges, quoted_records, read_ranges
from gridfold.sources.roles import geometry_of

DELIMITERS = [",", ";", "\t", "|"]


def detect_delimiter(header: str) -> str:
    """The candidate that occurs most outside quotes in the header line; a comma on a tie or none."""
    outside = "".join(header.split('"')[::2])
    return max(DELIMITERS, key=outside.count)


def _titles(record: str, delimiter: str) -> list[str]:
    """Column names of a header row; blank and repeated ones get their place."""
    names = [c.strip() for c in next(csv.reader([record], delimiter=delimiter, skipinitialspace=True))]
    seen = [c.lower() for c in names]
    return [f"_c{i}" if not c else f"{c}{i}" if seen.count(c.lower()) > 1 else c for i, c in enumerate(names)]


def read_table(spark: SparkSession, path: str, delimiter: str | None = None, multiline: bool = True) -> DataFrame:
    """All columns as trimmed text; missing cells are empty; blank lines are skipped.

    A quote opens or closes a field wherever it stands.  One scan says whether any quoted field goes over
    a line end: if not, Spark reads the file as it is; else tasks cut their byte ranges into records, so one
    large file is read by many either way.  ``multiline=False`` says beforehand that there is none.
    All files must have the same header; the delimiter is the one that occurs most in the headers.
    """
    lines = read_ranges(spark, path, "\n")
    spread, opened = open_ranges(lines) if multiline else (0, None)
    if spread:
        records = quoted_records(lines, opened)
        titles = [r["record"] for r in records.where("title").select("record").distinct().limit(2).collect()]
        if len(titles) > 1:
            raise ValueError(f"files have different headers: {titles}")
    else:
        first = lines.where((F.col("start") == 0) & (F.trim("value") != "")).groupBy("file").agg(F.first("value").alias("value"))
        titles = [r["value"] for r in first.select("value").distinct().limit(2).collect()]
    if not titles:
        raise ValueError("table is empty")
    if delimiter is None:
        delimiter = detect_delimiter("\n".join(titles))
    options = {"sep": delimiter, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    if spread:
        names = _titles(titles[0].lstrip("\ufeff"), delimiter)
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        parsed = F.from_csv("record", schema, {**{k: str(v) for k, v in options.items()}, "multiLine": "true"})
        raw = records.where("not title").select(parsed.alias("r")).select("r.*")
    else:
        raw = spark.read.csv(path, header=True, enforceSchema=False, **options)
    return raw.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip()) for c in raw.columns])


def read_csv_features(
    spark: SparkSession,
    path: str,
    delimiter: str | None = None,
    lat_column: str | None = None,
    lng_column: str | None = None,
    geo_column: str | None = None,
    table: bool = False,
    crs: str | None = None,
    default_crs: str | None = None,
    fid_column: str | None = None,
    store: str | None = None,
    multiline: bool = True,
    geometry_column: str | None = None,
) -> DataFrame:
    """Features of a delimited file; a file without geometry, or ``table``, gives rows with NULL geometry.

    Unless ``geometry_column`` (WKT or GeoJSON text), ``geo_column`` ("lat, lng" text) or the position columns are named,
    one aggregate over all rows decides which columns hold geometry.  Rows whose geometry cannot be read are skipped.  Values that are numbers
    become numbers in ``properties``.
    """
    df = read_table(spark, path, delimiter, multiline)
    geom, used = (None, []) if table else geometry_of(df, geo_column, lat_column, lng_column, geometry_column)
    props = typed_json([c for c in df.columns if c not in used])
    fid = F.col(f"`{fid_column}`").try_cast("bigint") if fid_column else None
    if geom is None:
        return finish(table_only(df, props, fid), check=False, store=store)
    out = as_features(df, geom, props, fid).where(F.col("geom").isNotNull())
    if geo_column is not None and out.isEmpty():
        raise ValueError(f"no coordinate pairs in column '{geo_column}'")
    return finish(out, crs, None, default_crs, store=store)
