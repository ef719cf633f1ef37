import json

import pytest
from helpers import box, features, fids
from pyspark.sql import functions as F

from gridfold import operators as ops
from gridfold.functions.props import merge_properties
from gridfold.schema import table_only


def test_attribute(spark):
    df = features(
        spark,
        [(1, "POINT (0 0)", '{"k":5,"s":"b","n":{"d":7}}'), (2, None, '{"k":"x","s":"a"}'), (3, "POINT (1 1)", '{"s":null}')],
    )
    assert fids(ops.attribute(df, "k", ">", 4)) == [1]
    assert fids(ops.attribute(df, "k", "!=", 4)) == [1]
    assert fids(ops.attribute(df, "s", "!=", "b")) == [2]
    assert fids(ops.attribute(df, "n.d", value=7)) == [1]
    assert fids(ops.attribute(df, where="json_extract_string(properties, '$.s') = 'a'")) == [2]
    for bad in ({"property": "k"}, {"property": "k", "value": 1, "operator": "~"}):
        with pytest.raises(ValueError):
            ops.attribute(df, **bad)


@pytest.mark.parametrize("hot_rows", [None, 5])
def test_join_hot_key_nulls_and_duplicates(spark, hot_rows):
    rows = [(i, None if i == 30 else "POINT (0 0)", json.dumps({"key": "h" if i % 3 else None, "v": i})) for i in range(31)]
    target = features(spark, rows)
    s = spark.createDataFrame([(1, '{"id":"h","v":"s1"}'), (2, '{"id":"h","v":null}'), (3, '{"id":"z"}')], "k bigint, p string")
    source = table_only(s, F.col("p"), F.col("k"))
    hot = sum(1 for i in range(30) if i % 3)
    left = ops.join(source, target, "id", "key", hot_rows=hot_rows)
    assert left.count() == 2 * hot + 10
    inner = ops.join(source, target, "id", "key", "inner", hot_rows=hot_rows)
    values = [json.loads(r["properties"]) for r in inner.collect()]
    assert len(values) == 2 * hot and sum("v" not in v for v in values) == hot
    with pytest.raises(ValueError):
        ops.join(source, target, "id", "key", "outer")


def test_merge_patch(spark):
    df = spark.createDataFrame([('{"a":1,"b":{"c":1}}', '{"b":null,"d":[1]}'), ('{"a":1}', None), (None, '{"x":1}')], "t string, s string")
    out = [r[0] for r in df.select(merge_properties(F.col("t"), F.col("s"))).collect()]
    assert [json.loads(v) for v in out] == [{"a": 1, "d": [1]}, {"a": 1}, {"x": 1}]


def test_inspection(spark):
    df = features(spark, [(1, "POINT (3 4)", '{"b":1,"_x":2,"a b":"t"}'), (2, box(0, 0, 1, 1), '{"c":null}'), (3, None, None)])
    assert [r["key"] for r in ops.property_keys(df).collect()] == ["a b", "b", "c"]
    assert [r["key"] for r in ops.property_keys(df, sample=1).collect()] == ["b", "a b"]
    assert {r["type"] for r in ops.geometry_types(df).collect()} == {"Point", "Polygon"}
    assert tuple(ops.bounds(df).first()) == (0.0, 0.0, 3.0, 4.0)
    empty = df.where("fid > 5")
    assert tuple(ops.bounds(empty).first()) == (None,) * 4
    assert tuple(ops.bounds(empty, world_default=True).first()) == (-180.0, -85.0, 180.0, 85.0)
    rows = ops.preview(df, 1, order_by="fid").collect()
    assert rows[0].asDict() == {"a b": "t", "b": "1", "c": None}
    assert ops.preview(df, 1, order_by="fid", shown=True).first().asDict() == {"a b": "t", "b": "1"}
    assert {r["key"]: r["numeric"] for r in ops.numeric_properties(df).collect()}["b"]


def test_union_renumbers_and_dedup(spark):
    a, b = features(spark, [(1, "POINT (0 0)"), (2, None)]), features(spark, [(1, "POINT (0.000001 0)")])
    merged = ops.union([a, b])
    assert len(set(fids(merged))) == 3
    assert ops.dedup_features(merged).count() == 1
    with pytest.raises(ValueError):
        ops.union([a])


def test_null_geometry_rules(spark):
    df = features(spark, [(1, "POINT (-123 49)"), (2, None)])
    assert ops.centroid(df).count() == 1
    assert fids(ops.buffer(df, 10)) == [1, 2]
    assert ops.buffer(df, 10, dissolve=True).count() == 1
    with pytest.raises(ValueError):
        ops.buffer(df, 0)
    with pytest.raises(ValueError):
        ops.buffer(df.where("fid > 9"), 5, strict=True)
