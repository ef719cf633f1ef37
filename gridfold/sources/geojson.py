"""GeoJSON documents and newline-delimited features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.functions.geomtext import COLLECTION, TYPES, parse_geojson
from gridfold.functions.project import to_degrees
from gridfold.functions.units import parse_crs_column
from gridfold.schema import as_features
from gridfold.session import stored
from gridfold.sources.guard import check_degrees, finish
from gridfold.sources.ranges import split_documents


def _object(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)


def feature_texts(doc: Column) -> Column:
    """Array of Feature texts of a document; NULL when it is no GeoJSON."""
    kind = _object(doc, "$.type")
    listed = F.from_json(_object(doc, "$.features"), "array<string>")
    bare = kind.isin([*TYPES, COLLECTION]) & _object(doc, "$.coordinates").isNotNull()
    wrapped = F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), doc, F.lit("}"))
    array = F.trim(doc).startswith("[") & (_object(doc, "$[0].type") == "Feature")
    return (
        F.when((kind == "FeatureCollection") & _object(doc, "$.features").startswith("["), listed)
        .when((kind == "Feature") & F.array_contains(F.json_object_keys(doc), "geometry"), F.array(doc))
        .when(bare, F.array(wrapped))
        .when(array, F.from_json(doc, "array<string>"))
    )


def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per document: whole files, or single lines of newline-delimited files.

    A file that holds several documents, each on its own lines, gives one row for
    each: no valid document has a line end between ``}`` and ``{``.
    """
    if lines:
        return spark.read.text(path).where(F.trim("value") != "")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.split("value", r"(?<=\})\s*[\r\n]\s*(?=\{)")).alias("value"))


def document_crs(docs: DataFrame, column: str = "value") -> Column:
    """CRS of the legacy ``crs`` member."""
    return parse_crs_column(_object(F.col(column), "$.crs.properties.name"))


def feature_geometry(feature: Column) -> Column:
    """The geometry of a Feature text."""
    return parse_geojson(_object(feature, "$.geometry"), collections=True)


def features_of(texts: DataFrame, feature: Column, fid: Column | None = None, crs: Column | None = None, geom: Column | None = None) -> DataFrame:
    """Feature texts to feature rows, in degrees where ``crs`` names their system; rows without geometry are dropped.

    ``geom`` is ``feature_geometry(feature)``, for callers that need it many times.
    """
    geom = feature_geometry(feature) if geom is None else geom
    if crs is not None:
        geom = to_degrees(geom, crs)
    props = F.coalesce(_object(feature, "$.properties"), F.lit("{}"))
    return as_features(texts, geom, props, fid).where(F.col("geom").isNotNull())


def read_geojson(
    spark: SparkSession,
    path: str,
    lines: bool = False,
    crs: str | None = None,
    default_crs: str | None = None,
    fid_property: str | None = None,
    store: str | None = None,
    split: bool | None = None,
) -> DataFrame:
    """Features of FeatureCollection, Feature, geometry and Feature-array documents.

    Small files are read whole, many at a time.  With ``split`` (by default if a file is larger than a split)
    a document is cut into its features by many tasks, whatever its size, and each file is one document:
    content after it is refused.  Without the option ``crs`` each document is taken in the system of its own
    ``crs`` member.
    """
    if not lines and (is_large(spark, path) if split is None else split):
        return read_split(spark, path, crs, default_crs, fid_property, store)
    docs = read_documents(spark, path, lines)
    head = docs.limit(1).select(feature_texts(F.col("value")).isNotNull().alias("ok")).first()
    message = "not GeoJSON: expected FeatureCollection, Feature, geometry or Feature array"
    if head is None or not head["ok"]:
        raise ValueError(message)
    # Only the first document is looked at up front; a later bad one fails the job that reads it.
    texts = F.coalesce(feature_texts(F.col("value")), F.raise_error(F.lit(message)).cast("array<string>"))
    own = F.coalesce(document_crs(docs), F.lit(default_crs)) if crs is None else F.lit(None).cast("string")
    parts = docs.select(texts.alias("features"), own.alias("crs"))
    rows = parts.select(F.explode("features").alias("feature"), "crs")
    feature = F.col("feature")
    fid = _object(feature, f"$.properties.{fid_property}").try_cast("bigint") if fid_property else None
    return placed(rows, fid, crs, store)


def placed(rows: DataFrame, fid: Column | None, crs: str | None, store: str | None) -> DataFrame:
    """Feature rows of ``feature`` texts in degrees: all from ``crs``, or each from its own column ``crs``."""
    feature = F.col("feature")
    if crs is not None:
        return finish(features_of(rows, feature, fid), crs, store=store)
    check_degrees(features_of(rows.where(F.col("crs").isNull()), feature))
    return finish(features_of(rows, feature, fid, F.col("crs")), check=False, store=store)


def is_large(spark: SparkSession, path: str) -> bool:
    """Whether a file is larger than one split; only lengths are read."""
    most = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    return (most or 0) > spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def read_split(spark: SparkSession, path: str, crs: str | None, default_crs: str | None, fid_property: str | None, store: str | None) -> DataFrame:
    """``read_geojson`` of documents that many tasks cut into features."""
    records, frames = split_documents(spark, path)
    frames = stored(frames, "documents")
    known = ["FeatureCollection", "Feature", "array", *TYPES, COLLECTION]
    wrong = frames.where(~F.coalesce(F.col("kind").isin(known), F.lit(False))).first()
    if wrong is not None or frames.isEmpty():
        raise ValueError("not GeoJSON: expected FeatureCollection, Feature, geometry or Feature array")
    own = F.coalesce(parse_crs_column(F.col("crs_name")), F.lit(default_crs)) if crs is None else F.lit(None).cast("string")
    # One row a file, and only of those that name a system.
    systems = frames.select("file", own.alias("crs")).where("crs is not null")
    kind = F.get_json_object("record", "$.type")
    refused = F.raise_error(F.lit("not GeoJSON: an item of the array is no Feature")).cast("string")
    many = records.select("file", F.when(F.coalesce(kind == "Feature", F.lit(False)), F.col("record")).otherwise(refused).alias("feature"))
    single = frames.where(F.col("kind").isin(["Feature", *TYPES, COLLECTION])).select("file", F.explode(feature_texts(F.col("rest"))).alias("feature"))
    rows = many.unionByName(single).join(systems, "file", "left").select("feature", "crs")
    fid = _object(F.col("feature"), f"$.properties.{fid_property}").try_cast("bigint") if fid_property else None
    return placed(rows, fid, crs, store)
