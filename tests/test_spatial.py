import random

import pytest
from helpers import box, features, fids
from pyspark.sql import functions as F

from gridfold import operators as ops
from gridfold.functions.measure import area
from gridfold.plans.nearest import nearest_distance

HOLED = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"


def total_area(df):
    return df.agg(F.sum(area(F.col("geom")))).first()[0] or 0.0


def random_boxes(seed, n, sizes):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.choice(sizes)
        x, y = r.uniform(-50, 50), r.uniform(-50, 50)
        out.append((i, (x, y, x + s, y + s)))
    return out


def meets(a, b):
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_filters_match_brute_force_on_mixed_sizes(spark, hot_rows, monkeypatch):
    if hot_rows:
        monkeypatch.setattr("gridfold.plans.grid.BROADCAST_BYTES", 0)
    a = random_boxes(1, 60, [0.01, 0.5, 4, 40])
    b = random_boxes(2, 50, [0.02, 1, 9])
    fa, fb = (features(spark, [(i, box(*v)) for i, v in rows]) for rows in (a, b))
    want = sorted(i for i, v in a if any(meets(v, w) for _, w in b))
    assert fids(ops.intersection(fa, fb, hot_rows=hot_rows)) == want
    rest = fids(ops.difference(fa, fb, "exclude", hot_rows=hot_rows))
    assert rest == sorted({i for i, _ in a} - set(want))
    inside = lambda v, w: v[0] <= w[0] and v[1] <= w[1] and v[2] >= w[2] and v[3] >= w[3]
    assert fids(ops.contains(fa, fb, hot_rows=hot_rows)) == sorted(i for i, v in a if any(inside(v, w) for _, w in b))
    assert fids(ops.contains(fa, fb, "within", hot_rows=hot_rows)) == sorted(
        i for i, w in b if any(inside(v, w) for _, v in a)
    )


def test_hot_location_of_points(spark, monkeypatch):
    monkeypatch.setattr("gridfold.plans.grid.BROADCAST_BYTES", 0)
    points = [(i, f"POINT ({1.5 if i % 3 == 0 else i * 0.37 % 20} {1.5 if i % 3 == 0 else i * 0.53 % 20})") for i in range(300)]
    zones = [(i, box(i % 5 * 4, i // 5 * 4, i % 5 * 4 + 2, i // 5 * 4 + 2)) for i in range(25)]
    fp, fz = features(spark, points), features(spark, zones)

    def inside(i):
        x, y = (float(v) for v in points[i][1][7:-1].split())
        return any(k % 5 * 4 < x < k % 5 * 4 + 2 and k // 5 * 4 < y < k // 5 * 4 + 2 for k in range(25))

    want = [i for i in range(300) if inside(i)]
    assert fids(ops.contains(fz, fp, "within", hot_rows=20)) == want
    assert fids(ops.contains(fz, fp, "within")) == want


def test_contains_boundary_hole_and_vertex(spark):
    a = features(spark, [(1, HOLED)])
    points = {1: "POINT (1 1)", 2: "POINT (0 5)", 3: "POINT (0 0)", 4: "POINT (5 5)", 5: "POINT (4 5)", 6: "POINT (11 1)"}
    b = features(spark, list(points.items()))
    assert fids(ops.contains(a, b, "within")) == [1]
    assert fids(ops.intersection(b, a)) == [1, 2, 3, 5]
    touching = features(spark, [(1, box(0, 0, 4, 4)), (2, box(10, 0, 12, 2)), (3, box(4.5, 4.5, 5.5, 5.5))])
    assert fids(ops.contains(a, touching, "within")) == [1]
    assert fids(ops.intersection(touching, a)) == [1, 2]


def test_clip_and_subtract_add_up(spark):
    a = features(spark, [(i, box(*v)) for i, v in random_boxes(3, 20, [3, 12])] + [(99, None), (98, HOLED)])
    b = features(spark, [(i, box(*v)) for i, v in random_boxes(4, 40, [5, 15])] + [(50, None)])
    cut, rest = ops.intersection(a, b, "clip"), ops.difference(a, b)
    assert total_area(cut) + total_area(rest) == pytest.approx(total_area(a), rel=1e-9)
    assert 99 not in fids(cut) + fids(rest)
    salted = ops.intersection(a, b, "clip", hot_rows=2)
    assert total_area(salted) == pytest.approx(total_area(cut), rel=1e-12)


def test_subtract_edges(spark):
    a = features(spark, [(1, box(0, 0, 2, 2)), (2, box(5, 5, 6, 6)), (3, None)])
    assert fids(ops.difference(a, features(spark, [(1, box(-1, -1, 3, 3))]))) == [2]
    assert fids(ops.difference(a, features(spark, [(1, None)]))) == []
    assert fids(ops.difference(a, features(spark, [(1, box(0, 0, 9, 9))]), "exclude")) == [3]


def test_dissolve_matches_raster(spark):
    cells = random.Random(5).sample([(x, y) for x in range(12) for y in range(12)], 60)
    shapes = [(i, box(x, y, x + 2, y + 2)) for i, (x, y) in enumerate(cells)]
    covered = {(x + i, y + j) for x, y in cells for i in (0, 1) for j in (0, 1)}
    a, b = features(spark, shapes[:30] + [(100, None)]), features(spark, shapes[30:])
    out = ops.union([a, b], "dissolve")
    assert out.select("properties").first()[0] == '{"dissolved": true}'
    assert out.count() == 1 and total_area(out) == pytest.approx(len(covered))
    assert ops.union([features(spark, [(1, None)])] * 2, "dissolve").count() == 0
    assert ops.union([a, b]).count() == 61


def clustered(seed, n, spread):
    r = random.Random(seed)
    return [(i, (r.uniform(0, 1000) if i % 4 else 700 + r.uniform(0, spread), r.uniform(0, 1000) if i % 4 else 20 + r.uniform(0, spread))) for i in range(n)]


@pytest.mark.parametrize("leaf, broadcast", [(64, True), (2, False)])
def test_nearest_matches_brute_force(spark, leaf, broadcast, monkeypatch):
    monkeypatch.setattr("gridfold.plans.nearest.LEAF_ROWS", leaf)
    if not broadcast:
        monkeypatch.setattr("gridfold.plans.nearest.BROADCAST_NODES", -1)
    a, b = clustered(7, 80, 500), clustered(8, 120, 0.001)
    a += [(900, (-5000.0, -5000.0)), (901, (700.0, 9000.0))]
    fa, fb = (features(spark, [(i, f"POINT ({x!r} {y!r})") for i, (x, y) in rows]) for rows in (a, b))
    got = {r["fid"]: r["dist"] for r in nearest_distance(fa, fb).collect()}
    for i, (x, y) in a:
        assert got[i] == pytest.approx(min(((x - u) ** 2 + (y - v) ** 2) ** 0.5 for _, (u, v) in b), abs=1e-9)
    near = {r["fid"] for r in nearest_distance(fa, fb, F.lit(30.0)).collect()}
    assert near == {i for i, d in got.items() if d <= 30}


def test_nearest_of_extended_shapes(spark):
    a = [(i, box(*v)) for i, v in random_boxes(9, 30, [0.1, 5])] + [(40, "LINESTRING (-80 -80, 80 -79)")]
    b = [(i, box(*v)) for i, v in random_boxes(10, 40, [0.2, 3, 30])]

    def gap(v, w):
        dx, dy = max(w[0] - v[2], v[0] - w[2], 0), max(w[1] - v[3], v[1] - w[3], 0)
        return (dx * dx + dy * dy) ** 0.5

    got = {r["fid"]: r["dist"] for r in nearest_distance(features(spark, a), features(spark, b)).collect()}
    boxes = random_boxes(10, 40, [0.2, 3, 30])
    for i, v in random_boxes(9, 30, [0.1, 5]):
        assert got[i] == pytest.approx(min(gap(v, w) for _, w in boxes), abs=1e-9)
    assert 40 in got
    assert nearest_distance(features(spark, a), features(spark, [(1, None)])).count() == 0


def test_distance_modes_and_checks(spark):
    a = features(spark, [(1, "POINT (-123.1 49.2)", '{"n":1}'), (2, "POINT (-122.1 49.2)", '{"n":2}'), (3, None)])
    b = features(spark, [(1, "LINESTRING (-123.1 49.201, -123.0 49.201)")])
    assert fids(ops.distance(a, b, max_distance=200)) == [1]
    rows = ops.distance(a, b, "annotate").select("fid", F.get_json_object("properties", "$.dist_m").cast("double").alias("d"))
    got = {r["fid"]: r["d"] for r in rows.collect()}
    assert set(got) == {1, 2} and got[1] == pytest.approx(111.2, abs=0.2)
    assert fids(ops.distance(a, b, "annotate", max_distance=1, units_="km")) == [1]
    for bad in ({"mode": "near"}, {"mode": "filter"}, {"mode": "annotate", "max_distance": -1}):
        with pytest.raises(ValueError):
            ops.distance(a, b, **bad)
    with pytest.raises(ValueError):
        ops.contains(a, b, "around")


def test_plans_have_no_nested_loop(spark):
    a = features(spark, [(i, f"POINT ({i} {i})") for i in range(5)])
    b = features(spark, [(i, box(i, i, i + 2, i + 2)) for i in range(5)])
    for df in (ops.contains(b, a, "within"), ops.intersection(a, b), ops.intersection(b, b, "clip"), ops.difference(b, b)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_repeated_and_missing_ids(spark):
    """Rows count by themselves: equal or missing ids give the same answer on every path."""
    rows = [(7, "POINT (1 1)"), (7, "POINT (50 50)"), (None, "POINT (2 2)"), (None, "POINT (60 60)")]
    a, b = features(spark, rows), features(spark, [(1, box(0, 0, 5, 5))])
    place = lambda df: sorted((r["bbox"]["xmin"] for r in df.collect()))
    mixed = features(spark, [*rows, (7, box(3, 3, 4, 4)), (7, box(70, 70, 71, 71))])
    for hot_rows in (None, 1):
        assert place(ops.contains(b, a, "within", hot_rows=hot_rows)) == [1, 2]
        assert place(ops.contains(b, mixed, "within", hot_rows=hot_rows)) == [1, 2, 3]
        assert place(ops.intersection(mixed, b, "clip", hot_rows=hot_rows)) == [1, 2, 3]
        assert place(ops.difference(mixed, b, "exclude", hot_rows=hot_rows)) == [50, 60, 70]
        assert place(ops.difference(mixed, b, hot_rows=hot_rows)) == [50, 60, 70]
        assert len(place(ops.distance(mixed, b, "filter", 1.0, "meters", hot_rows=hot_rows))) == 3
    assert ops.distance(mixed, b, "annotate").count() == 6


def test_chain_reads_each_input_once(spark):
    """The plan of a chain does not grow with its length."""
    a = features(spark, [(i, box(i, i, i + 2, i + 2)) for i in range(6)])
    b = features(spark, [(i, box(i, i, i + 1, i + 1)) for i in range(4)])
    sizes, df = [], a
    for _ in range(5):
        df = ops.intersection(df, b)
        sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
    assert fids(df) == [0, 1, 2, 3, 4] and max(sizes) < 1.2 * min(sizes)


def test_merge_of_hashed_ids(spark):
    big = features(spark, [(2**62, "POINT (1 1)"), (3, "POINT (2 2)"), (None, "POINT (3 3)")])
    got = [r["fid"] for r in ops.merge([big, big]).collect()]
    assert len(got) == 6 and {6, 7} <= set(got) and len(set(got)) == 5


def test_join_splits_hot_keys_on_both_sides(spark):
    a = features(spark, [(i, "POINT (1 1)", '{"k": %s}' % (1 if i < 8 else i)) for i in range(10)])
    s = features(spark, [(i, None, '{"k": 1, "v": %d}' % i) for i in range(6)])
    for mode, n in (("inner", 48), ("left", 50)):
        plain, split = (ops.join(s, a, "k", "k", mode, hot_rows=h) for h in (None, 2))
        assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect())) and plain.count() == n


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_shapes_fetched_after_the_cells_give_the_same_cuts(spark, monkeypatch, hot_rows):
    """Both sides too large to broadcast: cells join numbers and envelopes, no shape travels with them."""
    from gridfold.functions.measure import area
    from gridfold.plans import grid

    big = [(100, box(-123.4, 49.0, -122.4, 49.9)), (101, None), (101, "POINT (-123.05 49.25)"), (102, "LINESTRING (-123.3 49.1, -122.6 49.7)")]
    fa = features(spark, big + [(i, box(-123.5 + i * 0.05, 49.1, -123.46 + i * 0.05, 49.6)) for i in range(20)])
    fb = features(spark, [(7, box(-123.5 + i * 0.11, 49.2 + j * 0.1, -123.42 + i * 0.11, 49.27 + j * 0.1)) for i in range(9) for j in range(4)])
    seen = []
    shown = grid.CellJoin._sides
    monkeypatch.setattr(grid.CellJoin, "_sides", lambda self, keep: seen.append(self) or shown(self, keep))

    def cut(op, mode):
        rows = op(fa, fb, mode, hot_rows=hot_rows).select("fid", F.round(area(F.col("geom")), 9).alias("a")).collect()
        return sorted((r.fid, r.a) for r in rows)

    direct = [cut(ops.intersection, "clip"), cut(ops.difference, "subtract")]
    monkeypatch.setattr(grid, "BROADCAST_BYTES", 0)
    seen.clear()
    assert [cut(ops.intersection, "clip"), cut(ops.difference, "subtract")] == direct and len(direct[0]) > 15
    assert len(seen) == 2 and all(dict(j.right.dtypes)["_wkb"] == "binary" and j.right.where("_wkb is not null").count() == 0 for j in seen)
