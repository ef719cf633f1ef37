import json

import pytest
from helpers import box, features
from pyspark.sql import functions as F

from gridfold import sinks, sources
from gridfold.functions.geomtext import wkt_of
from gridfold.sources.roles import position_columns
from gridfold.sources.table import detect_delimiter
from gridfold.streaming import read_appended, stream_append

# A pier on Lake Zurich.
POINT = {"type": "Point", "coordinates": [8.545, 47.355]}
FEATURE = {"type": "Feature", "geometry": POINT, "properties": {"quay": 4, "boats": ["Linth"]}}
PIER, QUAY = "POINT (8.545 47.355)", {"quay": 4, "boats": ["Linth"]}


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def rows(df):
    return [(r["w"], json.loads(r["properties"])) for r in df.select(wkt_of(F.col("geom")).alias("w"), "properties").collect()]


def _collection(*items):
    return {"type": "FeatureCollection", "features": list(items)}


@pytest.mark.parametrize(
    "doc, props", [(POINT, {}), ([FEATURE], QUAY), (FEATURE, QUAY), (_collection({**FEATURE, "geometry": None}, FEATURE), QUAY)]
)
def test_geojson_documents(spark, tmp_path, doc, props):
    assert rows(sources.read_geojson(spark, put(tmp_path, "piers.geojson", json.dumps(doc)))) == [(PIER, props)]


@pytest.mark.parametrize("doc", ['{"quay": 4}', "[7, 8]", '{"type": "FeatureCollection", "items": []}', "true"])
def test_geojson_rejects(spark, tmp_path, doc):
    with pytest.raises(ValueError):
        sources.read_geojson(spark, put(tmp_path, "piers.geojson", doc))


def test_geojson_crs_member_and_guard(spark, tmp_path):
    """On a central meridian the easting is 500 km; 5250 km north of the equator is 47.4035 degrees (series of the meridian arc)."""
    doc = _collection({**FEATURE, "geometry": {"type": "Point", "coordinates": [500000, 5250000]}})
    with pytest.raises(ValueError, match="CRS"):
        sources.read_geojson(spark, put(tmp_path, "p.geojson", json.dumps(doc)))
    doc["crs"] = {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::32632"}}
    b = sources.read_geojson(spark, put(tmp_path, "q.geojson", json.dumps(doc))).first()["bbox"]
    assert (b["xmin"], b["ymin"]) == pytest.approx((9, 47.4035), abs=0.001)


@pytest.mark.parametrize("header, want", [("quay", ","), ("quay|boat", "|"), ("quay;boat;log", ";"), ("quay,boat", ","), ('"lat; lng; alt",boat', ","), ("quay\tboat", "\t")])
def test_delimiter(header, want):
    assert detect_delimiter(header) == want


CSV = {
    "wkt": ('quay,geometry\n4,"POLYGON ((8 47, 9 47, 9 48, 8 47))"\n5,at the lake\n', [("POLYGON ((8 47, 9 47, 9 48, 8 47))", {"quay": 4})]),
    "lat": ("lng,lat,boat\n8.545,47.355,Linth\neast,47,Säntis\n", [(PIER, {"boat": "Linth"})]),
    "wins": ('lat,lng,geometry,boat\n46,7,"POINT (8.545 47.355)",Linth\n', [(PIER, {"lat": 46, "lng": 7, "boat": "Linth"})]),
    "pair": ('spot,boat\n"47.355, 8.545",Linth\nmoored,Säntis\n', [(PIER, {"boat": "Linth"})]),
    "none": ("geometry,quay\nnorth shore,4\nsouth shore,b\n", [(None, {"geometry": "north shore", "quay": 4}), (None, {"geometry": "south shore", "quay": "b"})]),
    "json": ('boat;Geom\nLinth;"{""type"":""LineString"",""coordinates"":[[8,47],[8.5,47.25],[9,47]]}"\n', [("LINESTRING (8 47, 8.5 47.25, 9 47)", {"boat": "Linth"})]),
    "quote": ('boat,log,lat,lng\n"MS ""Linth""","left at 9\nback at 10",47.355,8.545\n\n Ufenau ,,46,7\n', [(PIER, {"boat": 'MS "Linth"', "log": "left at 9\nback at 10"}), ("POINT (7 46)", {"boat": "Ufenau", "log": ""})]),
}


@pytest.mark.parametrize("name", CSV)
def test_csv(spark, tmp_path, name):
    text, want = CSV[name]
    assert rows(sources.read_csv_features(spark, put(tmp_path, "a.csv", text))) == want


def test_csv_options(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'id,spot,lat,lng\n7,"1, 2",3,4\n')
    assert rows(sources.read_csv_features(spark, path, geo_column="spot"))[0][0] == "POINT (2 1)"
    assert sources.read_csv_features(spark, path, table=True).first()["geom"] is None
    assert sources.read_csv_features(spark, path, fid_column="id").first()["fid"] == 7
    with pytest.raises(ValueError):
        sources.read_csv_features(spark, path, geo_column="nope")
    assert position_columns(["Y", "X", "z"]) == ("Y", "X")
    with pytest.raises(ValueError):
        position_columns(["lat", "name"])


def test_json_array(spark, tmp_path):
    items = [{"lat": 1, "lng": "2", "a": {"b": 1}}, {"lat": None, "lng": 3}]
    assert rows(sources.read_json_array(spark, put(tmp_path, "a.json", json.dumps(items)))) == [("POINT (2 1)", {"a": {"b": 1}})]
    shaped = [{"n": 1, "geo_shape": POINT, "extra": [1]}]
    assert rows(sources.read_features(spark, put(tmp_path, "b.json", json.dumps(shaped)))) == [(PIER, {"n": 1, "extra": [1]})]
    plain = [{"n": 1}, {"n": 2, "m": 3}]
    assert rows(sources.read_json_array(spark, put(tmp_path, "c.json", json.dumps(plain)))) == [(None, {"n": 1}), (None, {"n": 2, "m": 3})]


def test_formats_by_name():
    assert sources.resolve_format("/x/a.CSV") == "csv"
    assert sources.resolve_format("https://h/exports/parquet?x=1") == "geoparquet"
    assert sources.resolve_format("/x/a.bin") == "geojson"
    assert sources.resolve_format("/x/a.csv", "json-array") == "json-array"


def test_writers_round_trip(spark, tmp_path):
    df = features(spark, [(1, box(0, 0, 1, 1), '{"name":"A","n":1}'), (2, "POINT (5 5)", '{"name":"B, \\"q\\"","x y":2}'), (3, None, '{"name":"C"}')])
    sinks.write_csv(df, str(tmp_path / "c"))
    assert len(rows(sources.read_csv_features(spark, str(tmp_path / "c")))) == 2
    sinks.write_parquet(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["geometry", "n", "name", "x y"]
    assert sources.read_geoparquet(spark, str(tmp_path / "p")).count() == 2
    sinks.write_geojson(df, str(tmp_path / "g"))
    assert sources.read_geojson(spark, str(tmp_path / "g"), lines=True).count() == 2
    sinks.write_geojson(df, str(tmp_path / "d"), document=True)
    assert sorted(w for w, _ in rows(sources.read_geojson(spark, str(tmp_path / "d")))) == ["POINT (5 5)", "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"]


def test_pages_and_stream(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    page = lambda i: json.dumps({"type": "FeatureCollection", "features": [{**FEATURE, "properties": {"id": i}}]})
    for i in range(3):
        put(folder, f"page{i}.json", page(i))
    assert sources.read_pages(spark, str(folder)).count() == 3
    assert sources.read_pages(spark, str(folder), max_pages=2).count() == 2
    args = (spark, str(folder), str(tmp_path / "out"), str(tmp_path / "mark"))
    stream_append(*args, fid_property="id").awaitTermination()
    put(folder, "page9.json", page(9))
    stream_append(*args, fid_property="id").awaitTermination()
    assert sorted(r["fid"] for r in read_appended(spark, str(tmp_path / "out")).collect()) == [0, 1, 2, 9]


def test_tiles(spark, tmp_path):
    df = features(spark, [(1, box(-123.3, 49.1, -122.1, 49.9), '{"a":1}'), (2, "POINT (-122.5 49.5)"), (3, "LINESTRING (-123.2 49.2, -122.2 49.8)")])
    tiles = sinks.build_tiles(df, 5, 11, "base")
    sinks.write_tiles(tiles, str(tmp_path / "t"))
    whole = sinks.read_tiles(spark, str(tmp_path / "t"), (-124.0, 49.0, -121.0, 50.0), 11)
    from gridfold.functions.measure import area

    got = whole.where("fid = 1").agg(F.sum(area(F.col("geom")))).first()[0]
    assert got == pytest.approx(1.2 * 0.8, rel=2e-3)
    assert whole.where("fid = 2").count() == 1
    with pytest.raises(ValueError, match="not found"):
        sinks.read_tiles(spark, str(tmp_path / "t"), (-123, 49, -122, 50), 8, ["roads"])
    with pytest.raises(ValueError):
        sinks.build_tiles(df.where("fid > 9"))


@pytest.mark.parametrize("minzoom", [4, 11])
def test_pyramid_equals_direct_cuts(spark, monkeypatch, minzoom):
    """Pieces cut from pieces, over several steps, are those cut from the whole shape."""
    from gridfold.functions.measure import area, bbox_of
    from gridfold.sinks import tiles

    star = "POLYGON ((-123.3 49.1, -122.1 49.13, -122.9 49.5, -122.15 49.9, -123.2 49.8, -122.95 49.45, -123.3 49.1), (-122.9 49.2, -122.8 49.2, -122.8 49.25, -122.9 49.2))"
    df = features(spark, [(1, star), (2, "LINESTRING (-123.21 49.2, -122.2 49.81, -123.1 49.83)"), (3, "POINT (-122.5 49.5)"), (4, None), (5, box(-122.501, 49.5, -122.5, 49.501))])

    def cut():
        b = bbox_of(F.col("geom"))
        rows = tiles.build_tiles(df, minzoom, 11).select("z", "x", "y", "fid", b.alias("b"), F.when(F.col("z") == 11, area(F.col("geom"))).alias("area")).collect()
        return {(r.z, r.x, r.y, r.fid): (*r.b, r.area or 0.0) for r in rows}

    steps = cut()
    monkeypatch.setattr(tiles, "SPAN", 10**9)
    direct = cut()
    assert steps.keys() == direct.keys() and {k[3] for k in steps} == {1, 2, 3, 5}
    for key, values in direct.items():
        assert steps[key][:4] == pytest.approx(values[:4], abs=1.01 if key[0] == 11 else 3.01)
        assert steps[key][4] == pytest.approx(values[4], abs=4096 * 2)
    with pytest.raises(ValueError, match="no features"):
        tiles.build_layers({"a": df, "b": df.where("fid > 9")}, 4, 5)


def _zone_document(code, x):
    point = {"type": "Feature", "properties": {"code": code}, "geometry": {"type": "Point", "coordinates": [x, 5400000.0]}}
    crs = {"type": "name", "properties": {"name": f"urn:ogc:def:crs:EPSG::{code}"}}
    return json.dumps({"type": "FeatureCollection", "crs": crs, "features": [point]})


def test_each_document_has_its_own_crs(spark, tmp_path):
    """Two zones whose central meridians are six degrees apart, and one file in degrees."""
    folder = tmp_path / "zones"
    folder.mkdir()
    put(folder, "a.geojson", _zone_document(32612, 500000.0)), put(folder, "b.geojson", _zone_document(32613, 500000.0))
    put(folder, "c.geojson", json.dumps({"type": "Point", "coordinates": [8.5, 47.0]}))
    got = sorted(round(r["bbox"]["xmin"], 6) for r in sources.read_geojson(spark, str(folder)).collect())
    assert got == [-111.0, -105.0, 8.5]


def test_lines_are_never_taken_for_one_document(spark, tmp_path):
    """A written result reads back whole, with or without an option or ending."""
    df = sources.read_geojson(spark, put(tmp_path, "t.ndjson", "\n".join(
        json.dumps({"type": "Feature", "properties": {"t": "} {"}, "geometry": {"type": "Point", "coordinates": [i, 1]}}) for i in range(5))))
    assert df.count() == 5 and sources.read_features(spark, str(tmp_path / "t.ndjson")).count() == 5
    sinks.write_geojson(df, str(tmp_path / "back"))
    assert sources.read_features(spark, str(tmp_path / "back")).count() == 5


def _parquet_with_crs(spark, path, code, x, y):
    """One plain Parquet file whose footer names the system."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from gridfold.functions import kernel

    wkb = bytes(features(spark, [(1, f"POINT ({x} {y})")]).select(kernel.pack(F.col("geom"))).first()[0])
    table = pa.table({"geometry": pa.array([wkb], pa.binary()), "name": [str(code)]})
    geo = {"columns": {"geometry": {"crs": {"id": {"authority": "EPSG", "code": code}}} if code else {}}}
    pq.write_table(table.replace_schema_metadata({"geo": json.dumps(geo)}), path)


def test_each_parquet_file_has_its_own_crs(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    _parquet_with_crs(spark, folder / "a.parquet", 32612, 500000, 5400000)
    _parquet_with_crs(spark, folder / "b.parquet", 32613, 500000, 5400000)
    _parquet_with_crs(spark, folder / "c.parquet", None, 8.5, 47)
    got = sorted(round(r["bbox"]["xmin"], 6) for r in sources.read_geoparquet(spark, str(folder)).collect())
    assert got == [-111.0, -105.0, 8.5]
    _parquet_with_crs(spark, folder / "d.parquet", None, 600000, 47)
    with pytest.raises(ValueError, match="CRS"):
        sources.read_geoparquet(spark, str(folder))


def test_documents_are_written_in_parallel(spark, tmp_path, monkeypatch):
    """More features than one document takes go to several files, and none is lost."""
    monkeypatch.setattr("gridfold.sinks.files.DOCUMENT_ROWS", 4)
    df = features(spark, [(i, f"POINT ({i} 1)") for i in range(30)]).repartition(3)
    sinks.write_geojson(df, str(tmp_path / "docs"), document=True)
    texts = [json.loads(f.read_text()) for f in (tmp_path / "docs").glob("part-*") if f.read_text().strip()]
    assert len(texts) >= 8 and max(len(t["features"]) for t in texts) <= 4
    assert sorted(f["geometry"]["coordinates"][0] for t in texts for f in t["features"]) == list(range(30))
    sinks.write_geojson(df.where("fid > 99"), str(tmp_path / "none"), document=True)


def test_too_many_keys_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("gridfold.operators.inspect.COLUMNS", 3)
    df = features(spark, [(i, "POINT (0 0)", json.dumps({f"k{i}": i})) for i in range(5)])
    with pytest.raises(ValueError, match="keys"):
        sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_csv(df, str(tmp_path / "d"), keys=["k0", "k4"])
    assert spark.read.csv(str(tmp_path / "d"), header=True).count() == 5
