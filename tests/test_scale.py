"""Steps that must not grow with copies, batches or pairs."""

from pyspark.sql import functions as F

from gridfold.functions import kernel
from gridfold.functions.measure import area, bbox_of, box, point
from gridfold.operators import spatial
from gridfold.plans.numbering import numbered
from gridfold.plans.skew import TASKS_PER_CORE, dealt
from gridfold.schema import as_features, from_wkb
from gridfold.sinks import tiles


def points(spark, n):
    k = F.col("id")
    return as_features(spark.range(n), point(k / 10 + 0.05, k * 0 + 0.05), F.lit("{}"), k)


def test_clip_of_points_needs_no_masks(spark, monkeypatch):
    def none(*args):
        raise AssertionError("points are not cut by masks")

    monkeypatch.setattr(spatial, "_masks", none)
    x = F.col("id") / 100
    boxes = as_features(spark.range(40), box(x, F.lit(0.0), x + 0.2, F.lit(0.2)), F.lit("{}"), F.col("id"))
    got = spatial.intersection(points(spark, 20), boxes, mode="clip").select("fid", "geom.type", "bbox.xmin").collect()
    assert sorted((r.fid, r.type, r.xmin) for r in got) == [(i, "Point", i / 10 + 0.05) for i in range(6)]


def test_more_tiles_are_sorted_by_more_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tiles, "SORTED_ROWS", 10)
    path = str(tmp_path / "tiles")
    tiles.write_tiles(tiles.build_tiles(points(spark, 100), 3, 3), path, partitions=2)
    rows = spark.read.parquet(path)
    assert rows.count() >= 100 and len(rows.inputFiles()) > 2


def test_bounds_and_area_of_a_buffer(spark):
    grown = from_wkb(points(spark, 3), kernel.buffer(kernel.pack(F.col("geom")), F.lit(2.0), 8))
    got = grown.select("bbox", bbox_of(F.col("geom")).alias("b"), area(F.col("geom")).alias("a"), kernel.area(kernel.pack(F.col("geom"))).alias("k")).collect()
    assert len(got) == 3 and all(r.bbox == r.b and abs(r.a - r.k) < 1e-12 for r in got)


def test_rows_are_dealt_and_numbered_without_a_join(spark):
    df = spark.range(0, 50, 1, 7)
    assert dealt(df).rdd.getNumPartitions() == TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    rows = numbered(df.where("id > 20"), "number", 5)
    assert sorted(r.number for r in rows.collect()) == list(range(5, 34))
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
