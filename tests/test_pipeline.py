import json

import pytest
from pyspark.sql import functions as F
from helpers import box, features, fids

from gridfold import operators as ops
from gridfold import sinks
from gridfold.plans.catalog import Catalog, digest
from gridfold.plans.pipeline import run_pipeline
from gridfold.plans.spec import check_spec, execution_order


def op(kind, output, *inputs, **params):
    unary = kind in ("buffer", "centroid", "attribute")
    return {"type": kind, "output": output, **({"input": inputs[0]} if unary else {"inputs": list(inputs)}), "params": params}


def test_order_diamond_cycle_unknown():
    diamond = [op("union", "d", "b", "c"), op("centroid", "b", "a"), op("centroid", "c", "a")]
    assert [o["output"] for o in execution_order({"a"}, diamond)][-1] == "d"
    with pytest.raises(ValueError, match="cycle"):
        execution_order({"a"}, [op("centroid", "x", "y"), op("centroid", "y", "x")])
    with pytest.raises(ValueError, match="unknown"):
        execution_order({"a"}, [op("centroid", "x", "nope")])


@pytest.mark.parametrize(
    "operation",
    [
        {"type": "buffer", "input": "a", "output": "o"},
        op("buffer", "o", "a", distance=-1, units="meters"),
        op("buffer", "o", "a", distance=1, units="yards"),
        op("buffer", "o", "a", distance=1, units="km", quadSegs=1.5),
        op("union", "o", "a"),
        op("join", "o", "a", "b", sourceKey="x"),
        op("distance", "o", "a", "b", mode="filter", units="km"),
        op("attribute", "o", "a", property="p", where="1=1"),
        op("attribute", "o", "a", property="p", value="v", operator="like"),
        op("contains", "o", "a", "b", mode="around"),
        {"type": "hull", "input": "a", "output": "o"},
        {"type": "buffer", "inputs": ["a"], "output": "o", "params": {"distance": 1, "units": "km"}},
        op("centroid", "a", "b"),
    ],
)
def test_spec_rejects(operation):
    datasets = [{"id": "a", "url": "/a"}, {"id": "b", "url": "/b"}]
    assert check_spec({"datasets": datasets, "operations": [operation]})


def test_spec_accepts():
    spec = {
        "datasets": [{"id": "a", "url": "/a", "format": "csv"}, {"id": "b", "url": "/b", "paginate": {"maxPages": 3}}],
        "operations": [op("buffer", "x", "a", distance=1, units="km"), op("intersection", "y", "x", "b", mode="clip")],
        "outputs": [{"source": "y", "format": "csv"}, {"source": ["x", "y"], "format": "tiles", "filename": "t"}],
    }
    assert check_spec(spec) == []
    assert check_spec({**spec, "outputs": [{"source": "zz", "format": "csv"}, {"source": ["x"], "format": "csv"}]})


def sample(spark):
    points = features(spark, [(i, f"POINT ({-123 + i * 0.01} 49.2)", json.dumps({"n": i})) for i in range(10)])
    zones = features(spark, [(1, box(-123.001, 49.1, -122.955, 49.3))])
    return {"points": points, "zones": zones}


OPS = [
    op("union", "all", "near", "far"),
    op("contains", "inside", "zones", "points", mode="within"),
    op("attribute", "near", "inside", property="n", operator="<", value=3),
    op("buffer", "far", "inside", distance=50, units="meters"),
]


def test_pipeline_equals_hand_chain_and_reuses(spark, tmp_path):
    frames = sample(spark)
    catalog, report = run_pipeline(spark, {"operations": OPS}, Catalog(spark, str(tmp_path)), frames)
    assert {r["status"] for r in report.collect()} == {"complete"}
    inside = ops.contains(frames["zones"], frames["points"], "within")
    hand = ops.union([ops.attribute(inside, "n", "<", 3), ops.buffer(inside, 50)])
    assert fids(catalog.get("all")) == fids(hand)
    lineage = [r["output_id"] for r in catalog.lineage().collect()]
    assert lineage[0] == "inside" and lineage[-1] == "all"
    rebuilt = {o["output"]: o for o in catalog.spec()}
    assert rebuilt["far"] == OPS[3] and rebuilt["all"]["inputs"] == ["near", "far"]
    written = {p: p.stat().st_mtime_ns for p in tmp_path.glob("all/*.parquet")}
    again, _ = run_pipeline(spark, {"operations": OPS}, Catalog(spark, str(tmp_path)), frames)
    assert fids(again.get("all")) == fids(hand) and written == {p: p.stat().st_mtime_ns for p in tmp_path.glob("all/*.parquet")}
    # The same names with other data are other inputs.
    fewer = {**frames, "points": frames["points"].where("fid < 2")}
    other, _ = run_pipeline(spark, {"operations": OPS}, Catalog(spark, str(tmp_path)), fewer)
    assert 0 < other.get("all").count() < hand.count()


def test_digest_is_of_the_rows(spark):
    frame = sample(spark)["points"]
    assert digest(frame) == digest(frame.orderBy(F.desc("fid")).repartition(3))
    assert len({digest(f) for f in (frame, frame.limit(0), frame.union(frame), frame.where("fid > 0"), frame.withColumn("fid", F.col("fid") + 1), frame.withColumnRenamed("fid", "id"))}) == 6


def test_second_catalog_on_a_folder(spark, tmp_path):
    frames = sample(spark)
    first = Catalog(spark, str(tmp_path))
    run_pipeline(spark, {"operations": OPS}, first, frames)
    first.register("extra", frames["zones"], hidden=True), first.rename("near", "Near Ones"), first.delete("far"), first.swap("all", "inside")
    later = Catalog(spark, str(tmp_path))
    plain = lambda c: [{k: v for k, v in m.items()} for m in c.entries()]
    assert plain(later) == plain(first) and later.datasets(True).collect() == first.datasets(True).collect()
    assert later.lineage().collect() == first.lineage().collect() and later.spec() == first.spec()
    assert fids(later.get("near_ones")) == fids(first.get("near_ones")) and later.get("inside").count() == first.get("inside").count()
    assert not later.exists("extra")  # never stored
    later.delete_all()
    assert Catalog(spark, str(tmp_path)).entries() == []


def test_failed_step_does_not_fall_back_on_an_older_run(spark, tmp_path):
    frames = sample(spark)
    run_pipeline(spark, {"operations": OPS}, Catalog(spark, str(tmp_path)), frames)
    broken = {**frames, "points": frames["points"].withColumn("properties", F.raise_error(F.lit("broken")).cast("string"))}
    _, report = run_pipeline(spark, {"operations": OPS}, Catalog(spark, str(tmp_path)), broken)
    assert {r["id"]: r["status"] for r in report.collect()} == {"zones": "complete", **{i: "error" for i in ("points", "inside", "near", "far", "all")}}


def test_failures_are_reported(spark):
    spec = {"datasets": [{"id": "gone", "url": "/no/such/file.csv"}], "operations": [op("centroid", "c", "gone"), op("centroid", "d", "points")]}
    catalog, report = run_pipeline(spark, spec, frames=sample(spark))
    status = {r["id"]: r["status"] for r in report.collect()}
    assert status["gone"] == status["c"] == "error" and status["d"] == "complete"
    with pytest.raises(ValueError):
        run_pipeline(spark, {"operations": [op("centroid", "x", "nope")]}, frames=sample(spark))


def test_catalog(spark):
    c = Catalog(spark)
    frames = sample(spark)
    c.register("a", frames["points"]), c.register("b", frames["zones"], hidden=True), c.register("a/child", frames["points"])
    c.record("out", "centroid", ["a"], {}, 0)
    c.register("out", frames["points"])
    assert [r["id"] for r in c.datasets().collect()] == ["out", "a/child", "a"]
    assert c.rename("a", "Bike Lanes") == "bike_lanes" and c.rename("out", "bike lanes") == "bike_lanes_2"
    row = c.lineage().first()
    assert (row["output_id"], row["inputs"]) == ("bike_lanes_2", ["bike_lanes"])
    c.swap("bike_lanes", "b")
    assert {m["id"]: m["layer_order"] for m in c.entries()}["b"] == 1
    c.reorder(["bike_lanes_2", "b", "bike_lanes"])
    assert c.refresh_count("b") == 1 and c.append("b", frames["zones"]).count() == 2
    c.register("x", frames["points"]), c.register("x/y", frames["points"])
    c.delete("x")
    assert not c.exists("x/y")
    c.delete_all()
    assert c.entries() == [] and c.lineage().count() == 0
    with pytest.raises(KeyError):
        c.get("x")


def test_outputs_and_bundle(spark, tmp_path):
    c, _ = run_pipeline(spark, {"operations": OPS}, frames=sample(spark))
    outputs = [
        {"source": "all", "format": "parquet", "filename": "first"},
        {"source": "nope", "format": "csv"},
        {"source": ["far", "near"], "format": "tiles", "params": {"minzoom": 8, "maxzoom": 9}},
    ]
    assert sinks.missing_sources(c, outputs) == ["nope"]
    assert [r["status"] for r in sinks.run_outputs(c, outputs, str(tmp_path)).collect()] == ["complete", "error", "complete"]
    assert {r["layer"] for r in spark.read.parquet(str(tmp_path / "far-near.tiles")).select("layer").distinct().collect()} == {"far", "near"}
    names = {r["id"]: r["url"] for r in sinks.write_bundle(c, str(tmp_path / "bundle")).collect()}
    assert names["all"] == "./data/all" and names["points"].startswith("frame:")


def test_results_belong_to_what_made_them(spark, tmp_path):
    """Other parameters make a result again, close names stay apart, and nothing is complete before it ran."""
    frames = sample(spark)

    def run(below, **more):
        step = op("attribute", "a/b", "points", property="n", operator="<", value=below)
        other = op("attribute", "a_b", "points", property="n", operator="<", value=1)
        return run_pipeline(spark, {"operations": [step, other]}, frames={**frames, **more}, **folder)

    folder = {"catalog": Catalog(spark, str(tmp_path))}
    for below in (3, 5, 3):
        folder = {"catalog": Catalog(spark, str(tmp_path))}
        catalog, _ = run(below)
        assert catalog.get("a/b").count() == below and catalog.get("a_b").count() == 1
        assert spark.table("a_b").count() == 1
    folder = {}
    broken = frames["points"].withColumn("properties", F.raise_error(F.lit("broken")).cast("string"))
    _, report = run(3, points=broken)
    assert {r["id"]: r["status"] for r in report.collect()} == {"zones": "complete", "points": "error", "a/b": "error", "a_b": "error"}


def test_extraction_outputs(spark, tmp_path):
    """Tiles of one zoom inside a box come from the table; their source need not be in the catalog."""
    points = sample(spark)["points"]
    sinks.write_tiles(sinks.build_tiles(points, 8, 9), str(tmp_path / "tiles"))
    whole = {"source": "remote", "format": "tiles", "params": {"extractZoom": 9, "bbox": [-124, 49, -122, 50]}}
    assert sinks.missing_sources(Catalog(spark), [whole, {"source": "remote2", "format": "csv"}]) == ["remote2"]
    outputs = [whole, {**whole, "filename": "away", "source": "nowhere"}]
    status = sinks.run_outputs(Catalog(spark), outputs, str(tmp_path / "out"), {"remote": str(tmp_path / "tiles")}).collect()
    assert [r["status"] for r in status] == ["complete", "error"]
    assert fids(spark.read.parquet(str(tmp_path / "out" / "remote.tiles"))) == list(range(10))
    spec = {"datasets": [{"id": "remote", "url": "/t"}], "outputs": [whole]}
    assert check_spec(spec) == []
    for bad in ({"extractZoom": 30, "bbox": [0, 0, 1, 1]}, {"extractZoom": 3}, {"extractZoom": 3, "bbox": [1, 0, 0, 1]}):
        assert check_spec({**spec, "outputs": [{**whole, "params": bad}]})
