"""Existence joins of two large sides: covered cells, row numbers as bits, and rows written once."""

import pytest
from helpers import box, features
from pyspark.sql import functions as F

from gridfold import operators as ops
from gridfold.functions.measure import box as box_of
from gridfold.functions.measure import point
from gridfold.plans import grid
from gridfold.schema import as_features


def shapes(spark):
    """Left rows of all kinds, and areas that overlap, with a hole, a triangle, a line and a point among them."""
    spots = [(i, f"POINT ({(i * 37) % 101 / 10} {(i * 53) % 97 / 10})") for i in range(300)]
    left = features(spark, [*spots, (7, None), (None, "POINT (1.01 1.01)"), (400, "LINESTRING (0.3 0.3, 12 12)"), (401, box(30, 30, 31, 31)), (401, box(4, 4, 4.1, 4.1))])
    areas = [(i, box(x := i % 20 / 4, y := i // 20 * 2.5, x + 1.5 + i % 3, y + 1.5 + i % 2)) for i in range(60)]
    hole = "POLYGON ((6 6, 9.9 6, 9.9 9.9, 6 9.9, 6 6), (7 7, 8.5 7, 8.5 8.5, 7 8.5, 7 7))"
    odd = [(90, hole), (91, "POLYGON ((0 9.5, 5 5, 5 9.5, 0 9.5))"), (92, "LINESTRING (9 0, 9 5)"), (93, "POINT (3.7 0)"), (94, None)]
    return left, features(spark, areas + odd)


def numbers(df):
    return sorted((str(r.fid), str(r.geom)) for r in df.select("fid", "geom").collect())


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_rows_under_covered_cells_are_not_joined(spark, monkeypatch, hot_rows):
    """Both sides large: only rows outside of the cells that areas cover look for a partner."""
    left, right = shapes(spark)
    calls = {"filter": ops.intersection, "exclude": ops.difference, "clip": ops.intersection}
    some = left.where("geom is null or geom.type = 'Point'")
    given = {mode: some if mode == "clip" else left for mode in calls}
    direct = {mode: numbers(op(given[mode], right, mode)) for mode, op in calls.items()}
    joined, matched = [], grid.CellJoin.matched
    monkeypatch.setattr(grid.CellJoin, "matched", lambda self, test: joined.append(self.left.where("bbox is not null").count()) or matched(self, test))
    monkeypatch.setattr(grid, "BROADCAST_BYTES", 0)
    for mode, op in calls.items():
        assert numbers(op(given[mode], right, mode, hot_rows=hot_rows)) == direct[mode] and len(direct[mode]) > 60
    assert len(joined) == 3 and max(joined) < 200  # of 304
    joined.clear()
    monkeypatch.setattr(grid, "COVER_CELLS", 0)
    assert numbers(ops.intersection(left, right)) == direct["filter"] and joined == [304]


@pytest.mark.parametrize("most", [None, 0])
def test_a_chain_writes_its_rows_once(spark, monkeypatch, most):
    left, right = shapes(spark)
    zones = features(spark, [(1, box(0, 0, 4.05, 9)), (2, box(5, 0.05, 9, 9))])
    written, write = [], grid.stored
    monkeypatch.setattr(grid, "stored", lambda df, name, **kw: written.append(name) or write(df, name, **kw))
    if most is not None:  # neither side nor row numbers are broadcast, so what is left is written anew
        monkeypatch.setattr(grid, "BROADCAST_BYTES", most)
    met = ops.intersection(left.where("geom.type = 'Point'"), right)
    inside = ops.contains(zones, met, mode="within")
    outside = ops.difference(inside, features(spark, [(1, box(1, 1, 2, 2)), (2, box(50, 50, 51, 51))]), mode="exclude")
    cut = ops.intersection(ops.intersection(outside, right, mode="clip"), outside)
    got = cut.collect()
    x, y = (lambda r: r.bbox.xmin), (lambda r: r.bbox.ymin)
    want = [r for r in met.collect() if (0 < x(r) < 4.05 and 0 < y(r) < 9 or 5 < x(r) < 9 and 0.05 < y(r) < 9) and not (1 <= x(r) <= 2 and 1 <= y(r) <= 2)]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 100
    assert written.count("rows") == (1 if most is None else 5)


def test_shapes_beyond_the_reach_of_the_left_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(grid, "BROADCAST_BYTES", 4000)
    k = F.col("id")
    far = as_features(spark.range(200), box_of(k / 1, k * 0 + 0.0, k / 1 + 0.5, k * 0 + 0.1), F.lit("{}"), k)
    some = as_features(spark.range(20), point(k / 10 + 0.05, k * 0 + 0.05), F.lit("{}"), k)
    seen, made = [], grid.CellJoin.__init__
    monkeypatch.setattr(grid.CellJoin, "__init__", lambda self, *a, **kw: made(self, *a, **kw) or seen.append(self.rp.rows))
    assert [r.fid for r in ops.intersection(some, far).collect()] and max(seen) <= 3


def test_a_result_joined_with_itself(spark):
    left, right = shapes(spark)
    met = ops.intersection(left, right)
    n = met.count()
    assert n > 150 and ops.intersection(met, met).count() == n and ops.difference(met, met, mode="exclude").count() == 0
    assert ops.join(met, met, "k", "k", "left").count() == n
