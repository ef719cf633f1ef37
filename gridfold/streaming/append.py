"""File stream of page documents into a feature dataset."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridfold.functions.project import reproject
from gridfold.functions.units import resolve_crs
from gridfold.plans.numbering import numbered
from gridfold.schema import FEATURE, with_bbox
from gridfold.sources.geojson import feature_geometry, features_of
from gridfold.sources.jsonarray import array_features
from gridfold.sources.pages import page_items
from gridfold.sources.roles import profile_members


def stream_append(
    spark: SparkSession,
    pages: str,
    dataset: str,
    checkpoint: str,
    max_files_per_trigger: int = 100,
    first_item: str | None = None,
    fid_property: str | None = None,
    crs: str | None = None,
    available_now: bool = True,
    **columns: str | None,
) -> StreamingQuery:
    """Start a query that normalises new page files like the batch reader and appends them.

    GeoJSON pages need no hint.  Pages of plain objects need ``first_item``, a
    sample item whose members decide the geometry column, because a stream cannot
    look ahead.  Each batch is written to a folder of its own number and then counted
    beside it, so a batch that is repeated after a failure replaces itself.  Without
    ``fid_property`` items are numbered on from the counts of earlier batches: no two share an id.
    """
    docs = (
        spark.readStream.option("wholetext", "true")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .text(pages)
        .withColumn("file", F.input_file_name())
    )
    item = F.col("item")
    path = "$.properties." if first_item is None else "$."
    sample = None if first_item is None else profile_members(spark.createDataFrame([(first_item,)], "item string"), item)
    source = resolve_crs(crs)

    # Long expressions take longer to build than a batch to read: they are built once.
    geom = feature_geometry(item)
    shifted = None if source is None else reproject(F.col("geom"), source, "EPSG:4326")
    landed: dict[int, int] = {}  # items up to and with a batch that this query has landed

    def land(batch: DataFrame, number: int) -> None:
        seen, kept = Observation(), Observation()
        items = page_items(batch)
        if fid_property:
            fid = F.get_json_object(item, path + fid_property).try_cast("bigint")
            earlier = 0
        else:
            earlier = landed.get(number - 1)
            if earlier is None:
                before = _counts(spark, dataset)
                earlier = 0 if before is None else before.where(F.col("batch") < number).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            items, fid = numbered(items, "number", earlier), F.col("number")
        items = items.observe(seen, F.count(F.lit(1)).alias("n"))
        rows = features_of(items, item, fid, geom=geom) if sample is None else array_features(items, item, sample, fid=fid, **columns)
        if shifted is not None:
            rows = with_bbox(rows.withColumn("geom", shifted))
        rows = rows.observe(kept, F.count(F.lit(1)).alias("features"))
        rows.write.mode("overwrite").parquet(f"{dataset}/batch={number}")
        n, features = seen.get["n"], kept.get["features"]
        counts = spark.range(0, 1, 1, 1).select(F.lit(n).cast("bigint").alias("n"), F.lit(features).cast("bigint").alias("features"))
        counts.write.mode("overwrite").parquet(f"{dataset}.counts/batch={number}")
        landed.clear()
        landed[number] = earlier + n

    writer = docs.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _counts(spark: SparkSession, dataset: str) -> DataFrame | None:
    """``n`` items and ``features`` of each ``batch`` that is complete; nothing before the first one."""
    try:
        return spark.read.schema("n bigint, features bigint, batch int").parquet(f"{dataset}.counts")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def appended_count(spark: SparkSession, dataset: str) -> int:
    """Features of all complete batches: read from one small row a batch, not from the features."""
    counts = _counts(spark, dataset)
    return 0 if counts is None else counts.agg(F.coalesce(F.sum("features"), F.lit(0))).first()[0]


def read_appended(spark: SparkSession, dataset: str) -> DataFrame:
    """The features of all complete batches."""
    counts = _counts(spark, dataset)
    if counts is None:
        return spark.createDataFrame([], FEATURE)
    rows = spark.read.schema(f"{FEATURE}, batch int").parquet(dataset)
    return rows.join(F.broadcast(counts.select("batch")), "batch", "left_semi").drop("batch")
