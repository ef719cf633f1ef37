"""Files that many tasks cut: compared with whole-file parsing by Python's own csv and json modules."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from gridfold import sources
from gridfold.functions.props import json_value
from gridfold.sources.table import read_table


@pytest.fixture
def tiny_splits(spark):
    """Ranges of a few bytes, so that records begin, go on and end in different ones."""
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 16)

    yield use
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("size", [200, 1 << 20])
def test_quoted_line_ends_over_many_ranges(spark, tiny_splits, tmp_path, size):
    rnd = random.Random(size)
    cells = ["plain", "a, b", 'say "hi"', "two\nlines", "crlf\r\nhere", "", '"', "\n\n", "x" * 40, "é\nü", "end\n"]
    want = []
    for part in range(3):
        rows = [(f"{part}-{i}", rnd.choice(cells), rnd.choice(cells)) for i in range(40)]
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator="\r\n" if part == 1 else "\n").writerows([("id", "note", "more"), *rows])
        text = out.getvalue() if part else out.getvalue().rstrip("\n")  # no line end after the last row
        (tmp_path / f"{part}.csv").write_text(text, newline="")
        want += [tuple(c.strip() for c in r) for r in rows]
    tiny_splits(size)
    got = rows_of(read_table(spark, str(tmp_path)))
    strip = lambda r: tuple(c.strip() for c in r)
    assert sorted(map(strip, got)) == sorted(want)


def test_one_table_of_several_splits_uses_several_tasks(spark, tiny_splits, tmp_path):
    (tmp_path / "a.csv").write_text("id,note\n" + "".join(f'{i},"line\n{i}"\n' for i in range(2000)))
    tiny_splits(2000)
    table = read_table(spark, str(tmp_path))
    assert table.count() == 2000 and {r["note"] for r in table.collect()} == {f"line\n{i}" for i in range(2000)}
    assert table.rdd.getNumPartitions() > 4


def test_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n"first\nname"; b;b;\n1;2;"3\n4";5\n\n')
    assert read_table(spark, str(tmp_path)).columns == ["first\nname", "b1", "b2", "_c3"]
    (tmp_path / "b.csv").write_text('other;b;b;\n1;2;"3\n4";5\n')
    with pytest.raises(ValueError, match="different headers"):
        read_table(spark, str(tmp_path))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.csv").write_text("\n \n")
    with pytest.raises(ValueError, match="empty"):
        read_table(spark, str(tmp_path / "empty"))


def feature(i, props):
    return {"type": "Feature", "properties": {"id": i, **props}, "geometry": {"type": "Point", "coordinates": [i % 90, -(i % 80)]}}


ODD = ['}{"', "\\", '\\"', "]}", "[{", 'quote " and \\ end\\', "é}ü", '"features":[{', ""]


@pytest.mark.parametrize("size", [700, 4000])
@pytest.mark.parametrize("indent", [None, 1])
def test_document_over_many_ranges(spark, tiny_splits, tmp_path, size, indent):
    features = [feature(i, {"odd": ODD[i % len(ODD)], "deep": {"features": [{"type": "x", "a": [{}]}]}}) for i in range(60)]
    doc = {"bbox": [1, 2], "links": [{"features": [{}]}, {"type": "Feature"}], "note": "}]", "crs": {"type": "name", "properties": {"name": "EPSG:4326"}}, "type": "FeatureCollection", "features": features, "after": {"features": [{"z": 1}]}}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=False) + "\n" * (indent or 0))
    (tmp_path / "b.json").write_text(json.dumps([feature(i, {"odd": "array"}) for i in range(60, 80)], indent=indent))
    (tmp_path / "c.json").write_text(json.dumps({"type": "Point", "coordinates": [3, 4]}))
    tiny_splits(size)
    out = sources.read_geojson(spark, str(tmp_path), fid_property="id", split=True)
    got = sorted((r.fid, r.odd, r.x, r.y) for r in out.select("fid", json_value(F.col("properties"), "odd").alias("odd"), F.col("bbox.xmin").alias("x"), F.col("bbox.ymin").alias("y")).collect() if r.fid is not None)
    want = [(i, ODD[i % len(ODD)] if i < 60 else "array", float(i % 90), float(-(i % 80))) for i in range(80)]
    assert [(a, b or "", x, y) for a, b, x, y in got] == want
    assert out.where("fid is null").count() == 1


@pytest.mark.parametrize(
    "text", ['{"type":"FeatureCollection","features":[{"type":"Feature","geometry":null}]} x', '{"type":"FeatureCollection","features":[{"type":"Feature"},]}', '{"type":"FeatureCollection","features":[{"type":"Feature"} {"type":"Feature"}]}', '{"type":"FeatureCollection","features":[', '{"type":"FeatureCollection","features":[]}}', '{"type":"FeatureCollection","features":[]}{"a":1}', '{"type":"Topology"}', '["a"', '{"type":"FeatureCollection","features":{"a":{}}}']
)
def test_broken_documents_are_refused(spark, tiny_splits, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    tiny_splits(16)
    with pytest.raises(Exception, match="not GeoJSON"):
        sources.read_geojson(spark, str(tmp_path), split=True).collect()


def test_blank_first_values_keep_all_geometry(spark, tmp_path):
    point = '{"type":"Point","coordinates":[1,2]}'
    (tmp_path / "a.csv").write_text("id,geom,notes\n1,,POINT (9 9)\n2,POINT (1 2),x\n3,POINT (3 4),y\n")
    out = sources.read_csv_features(spark, str(tmp_path / "a.csv"), fid_column="id")
    assert sorted((r.fid, r.bbox.xmin) for r in out.collect()) == [(2, 1.0), (3, 3.0)]
    (tmp_path / "b.csv").write_text("id,spot\n1,\n2,\"48.5, -120\"\n3,\"49, -121\"\n")
    out = sources.read_csv_features(spark, str(tmp_path / "b.csv"), fid_column="id")
    assert sorted((r.fid, r.bbox.xmin, r.bbox.ymin) for r in out.collect()) == [(2, -120.0, 48.5), (3, -121.0, 49.0)]
    # One stray value doesn't make a column of other texts the geometry.
    (tmp_path / "c.csv").write_text("id,notes,lat,lng\n" + "".join(f"{i},{'POINT (9 9)' if i == 5 else 'text'},{i},{i}\n" for i in range(10)))
    out = sources.read_csv_features(spark, str(tmp_path / "c.csv"), fid_column="id")
    assert out.count() == 10 and out.where("bbox.xmin = 9").count() == 1
    (tmp_path / "d.json").write_text(json.dumps([{"id": 1, "shape": None}, {"id": 2, "shape": json.loads(point)}, {"id": 3}]))
    out = sources.read_json_array(spark, str(tmp_path / "d.json"), fid_property="id")
    assert [(r.fid, r.bbox.ymin) for r in out.collect()] == [(2, 2.0)]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "1.json").write_text(json.dumps([{"id": 1, "shape": None}]))
    (tmp_path / "pages" / "2.json").write_text(json.dumps([{"id": 2, "shape": json.loads(point)}]))
    (tmp_path / "pages" / "3.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(7, {})]}))
    assert sorted(r.bbox.ymin for r in sources.read_pages(spark, str(tmp_path / "pages")).collect()) == [-7.0, 2.0]
