import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from gridfold.registry import ORACLES, QUERIES
from verify import canon

SF = "/root/testdata/sf0.001"
FAST = [
    "J1_intersection_filter", "J2_intersection_clip", "J4_difference_subtract", "J6_contains_within", "J8_distance_annotate",
    "J9_join_left", "U3_dedup_features", "P2_attribute_where", "F9_tile_id", "A2_buffer_dissolve", "K4_build_tiles", "C6_run_pipeline",
]


def test_entry(spark):
    assert entry(spark).columns == ["segment", "n"] and entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    rel = con.execute(oracle_sql()[name])
    want = canon([c[0] for c in rel.description], rel.fetchall())
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == want
