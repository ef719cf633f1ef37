"""A directory of landed page files as one dataset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.schema import computed
from gridfold.sources.geojson import feature_texts, features_of
from gridfold.sources.guard import finish
from gridfold.sources.jsonarray import array_features
from gridfold.sources.roles import profile_members


def page_items(docs: DataFrame) -> DataFrame:
    """``file, item, geojson`` of page documents: GeoJSON features, or the items of a plain array."""
    doc = F.col("value")
    features = feature_texts(doc)
    plain = F.when(F.trim(doc).startswith("["), F.from_json(doc, "array<string>"))
    items = F.coalesce(features, plain)
    wrong = F.raise_error(F.lit("a page is neither GeoJSON nor an array")).cast("array<string>")
    filled = computed(docs.where(F.trim("value") != ""), items=F.coalesce(items, wrong), geojson=features.isNotNull())
    return filled.select("file", F.explode("items").alias("item"), "geojson")


def read_pages(
    spark: SparkSession,
    path: str,
    max_pages: int | None = None,
    crs: str | None = None,
    default_crs: str | None = None,
    store: str | None = None,
    **columns: str | None,
) -> DataFrame:
    """All pages in one job; with ``max_pages`` the first so many files by name.

    A page that is neither GeoJSON nor an array fails the job that reads it; blank pages have no items.

    Every page is transformed alike: the members of all plain pages decide which one is the geometry.
    ``columns`` are the options of ``read_json_array``.
    """
    docs = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    if max_pages is not None:
        # A limit the caller asked for: only that many names are ordered and broadcast.
        names = docs.select("file").distinct().orderBy("file").limit(max_pages)
        docs = docs.join(F.broadcast(names), "file", "left_semi")
    items = page_items(docs)
    kinds = {r["geojson"] for r in items.select("geojson").distinct().collect()}
    if not kinds:
        raise ValueError("no pages with items")
    item, parts = F.col("item"), []
    if True in kinds:
        parts.append(features_of(items.where("geojson"), item))
    if False in kinds:
        plain = items.where("not geojson")
        named = columns.get("table") or columns.get("geo_column")
        parts.append(array_features(plain, item, {} if named else profile_members(plain, item), **columns))
    out = reduce(DataFrame.unionByName, parts)
    return finish(out, crs, None, default_crs, check=True, store=store)


