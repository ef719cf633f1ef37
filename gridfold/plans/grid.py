"""Spatial joins as equi-joins on grid cells.

A feature is put on the level whose cell side is at least its envelope side, so
it covers at most four cells there however large it is.  Two features meet on
the coarser of their two levels.  Levels are chosen from a histogram of envelope
sides (one aggregate per input, at most 83 rows); the histogram steers cost only,
never the result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import isnan
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.functions import kernel
from gridfold.functions.measure import box, is_point, point_x, point_y, vertices
from gridfold.plans.skew import evened, spread
from gridfold.schema import computed
from gridfold.session import stored

#: A side is broadcast only when its measured vertices and rows stay below this many bytes.
BROADCAST_BYTES = 32 * 1024 * 1024
#: Of 64 row numbers as one word, in a broadcast.
_WORD_BYTES = 32
#: A part of anchored rows smaller than one in so many is written anew, a larger one is named by its row numbers.
SPARSE = 8
#: Covered cells (see ``covers``) that are broadcast at most, the coarsest first.
COVER_CELLS = 2**18
_POINT, _LOW, _HIGH = -41, -40, 40
_STEP = 3
_SLACK = 1 + 1e-12

Test = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Profile:
    """Envelope-side histogram of one join input: power of two -> rows."""

    sides: dict[int, int]
    rows: int
    all_points: bool
    bytes: int
    extent: tuple[float, float, float, float] | None = None

    @property
    def small(self) -> bool:
        return self.bytes <= BROADCAST_BYTES

    def typical(self) -> int | None:
        """Exponent of a cell side that at least half of the extended features fit in."""
        extended = sorted((k, n) for k, n in self.sides.items() if k > _POINT)
        half, seen = sum(n for _, n in extended) / 2, 0
        for k, n in extended:
            seen += n
            if seen >= half:
                return k + 1
        return None


#: Results of ``exists_join`` -> the anchored files they come from, and a frame of their row numbers there.
_KEPT: WeakKeyDictionary[DataFrame, tuple[DataFrame, DataFrame]] = WeakKeyDictionary()
#: Some rows of anchored files, with their row numbers -> these files.
_FILES: WeakKeyDictionary[DataFrame, DataFrame] = WeakKeyDictionary()


def anchored(df: DataFrame) -> DataFrame:
    """The input of an operator that reads it several times, written once with an own row number ``_row``.

    What led to ``df`` runs once, so a chain costs the sum of its steps, and no
    result depends on ``fid`` being unique or present.  The files fix the numbers.
    What an existence join left of anchored rows isn't written again: its row numbers are, as bits.
    """
    if df in _FILES:
        return df
    if df in _KEPT:
        files, kept = _KEPT[df]
        words = stored(_words(kept), "kept")
        n, rows = words.agg(F.count(F.lit(1)), F.sum(F.bit_count("_bits"))).first()
        if n * _WORD_BYTES <= BROADCAST_BYTES and (rows or 0) * SPARSE >= files.count():
            return _part(files, _marked(files, F.broadcast(words), "left_semi"))
    return stored(df.withColumn("_row", F.monotonically_increasing_id()), "rows")


def _part(rows: DataFrame, some: DataFrame) -> DataFrame:
    """``some`` of the anchored ``rows``, known as such."""
    _FILES[some] = _FILES.get(rows, rows)
    return some


def some_of(rows: DataFrame, condition: Column) -> DataFrame:
    """Anchored rows that fulfil a condition; they count as anchored too."""
    return _part(rows, rows.where(condition))


def _words(ids: DataFrame) -> DataFrame:
    """Row numbers ``_row``, which may repeat, as one 64-bit word for each 64 of them."""
    bit = F.expr("shiftleft(1L, cast(_row & 63L as int))")
    return ids.groupBy(F.shiftright("_row", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def _hinted(words: DataFrame) -> DataFrame:
    """Stored words, to be broadcast unless they are too many."""
    return F.broadcast(words) if words.count() * _WORD_BYTES <= BROADCAST_BYTES else words


def _marked(rows: DataFrame, words: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of anchored rows with the words of row numbers."""
    bit = F.bit_get(F.col("_bits"), F.col("_row").bitwiseAND(F.lit(63)).cast("int"))
    return rows.join(words, (F.shiftright("_row", 6) == F.col("_word")) & (bit == 1), how)


def keyed(rows: DataFrame) -> DataFrame:
    """Anchored rows with the row number as ``fid``; the former ``fid`` is ``_fid``."""
    return rows.withColumn("_fid", F.col("fid")).withColumn("fid", F.col("_row")).drop("_row")


def grown(df: DataFrame, by: Column | None) -> DataFrame:
    """Join envelope columns, widened by a distance."""
    box = F.col("bbox")
    pad = F.lit(0.0) if by is None else by * F.lit(_SLACK)
    return (
        df.withColumn("_x0", box["xmin"] - pad)
        .withColumn("_y0", box["ymin"] - pad)
        .withColumn("_x1", box["xmax"] + pad)
        .withColumn("_y1", box["ymax"] + pad)
    )


def _side() -> Column:
    return F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))


def _powered(df: DataFrame) -> DataFrame:
    """Column ``_pw``: power-of-two class of the envelope side, one value below all others for points."""
    bounded = F.greatest(F.lit(_LOW), F.least(F.lit(_HIGH), F.floor(F.log2(F.col("_side")))))
    return df.withColumn("_side", _side()).withColumn("_pw", F.when(F.col("_side") > 0, bounded).otherwise(_POINT).cast("int"))



def profiles(*inputs: tuple[DataFrame, Column | None]) -> list[Profile]:
    """Measure inputs (each with the distance it is widened by) in one job."""
    shape = F.col("geom")
    size = F.when(is_point(shape), 1).otherwise(F.size(vertices(shape)))
    sides = [
        _powered(grown(df.where(F.col("bbox").isNotNull()).select("geom", "bbox"), by)).select(F.lit(i).alias("input"), "_pw", "geom", "_x0", "_y0", "_x1", "_y1")
        for i, (df, by) in enumerate(inputs)
    ]
    found = (
        reduce(DataFrame.unionByName, sides)
        .groupBy("input", F.col("_pw").alias("side"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.when(is_point(shape), 0).otherwise(1)).alias("extended"),
            F.sum(size).alias("vertices"),
            *[f(c).alias(c) for f, c in ((F.min, "_x0"), (F.min, "_y0"), (F.max, "_x1"), (F.max, "_y1"))],
        )
        .collect()
    )
    out = []
    for i in range(len(inputs)):
        rows = [r for r in found if r["input"] == i]
        n = sum(r["n"] for r in rows)
        ends = [[r[c] for r in rows] for c in ("_x0", "_y0", "_x1", "_y1")]
        extent = (min(ends[0]), min(ends[1]), max(ends[2]), max(ends[3])) if rows and not any(v is None or isnan(v) for e in ends for v in e) else None
        sides_of, points = {r["side"]: r["n"] for r in rows}, all(r["extended"] == 0 for r in rows)
        out.append(Profile(sides_of, n, points, sum(r["vertices"] for r in rows) * 16 + n * 64, extent))
    return out


def within_reach(left: Profile, right: DataFrame, grow: Column | None, measured: Profile) -> tuple[DataFrame, Profile]:
    """``right`` without what lies beyond the extent of the left, where that is more than half of its own, and its profile."""
    if measured.small or left.extent is None or measured.extent is None:
        return right, measured
    x0, y0, x1, y1 = left.extent
    share = 1.0
    for (low, high), (own, end) in zip(((x0, x1), (y0, y1)), (measured.extent[::2], measured.extent[1::2])):
        share *= (min(high, end) - max(low, own)) / (end - own) if end > own else 1.0
    if share > 0.5 and min(x1, measured.extent[2]) >= max(x0, measured.extent[0]):
        return right, measured
    near = (F.col("_x0") <= x1) & (F.col("_x1") >= x0) & (F.col("_y0") <= y1) & (F.col("_y1") >= y0)
    right = grown(right.where(F.col("bbox").isNotNull()), grow).where(near).drop("_x0", "_y0", "_x1", "_y1")
    return right, profiles((right, grow))[0]


def levels(a: Profile, b: Profile) -> list[int]:
    """Cell-side exponents in use, finest first."""
    typical = [t for t in (a.typical(), b.typical()) if t is not None]
    start = max(typical) if typical else -20
    top = max([k for p in (a, b) for k in p.sides] + [start - 1]) + 1
    out = [start]
    while out[-1] < top:
        out.append(out[-1] + _STEP)
    return out


def _own_levels(p: Profile, ks: list[int]) -> set[int]:
    return {next(k for k in ks if k >= side + 1) for side in p.sides}


def _level(ks: list[int]) -> Column:
    """Level of a row from its envelope side."""
    out = F.lit(ks[-1])
    for k in reversed(ks[:-1]):
        out = F.when(F.col("_pw") < k, k).otherwise(out)
    return out


def _cell(value: Column, k: Column | int) -> Column:
    side = F.lit(2.0**k) if isinstance(k, int) else F.pow(F.lit(2.0), k)
    return F.floor(value / side)


def with_cells(df: DataFrame, ks: list[int], own: set[int], other: set[int], points: bool) -> DataFrame:
    """One row per (level, cell) a feature has to be looked up in.

    Level L is needed when it is the feature's own and the other side has
    something as fine or finer, or when the other side has features of level L
    and L is coarser.
    """
    if points and len(ks) == 1:
        return df.withColumn("_k", F.lit(ks[0])).withColumn("_l", F.lit(ks[0])).withColumn(
            "_cx", _cell(F.col("_x0"), ks[0])
        ).withColumn("_cy", _cell(F.col("_y0"), ks[0]))
    finest = min(other) if other else ks[-1]
    wanted = F.filter(
        F.array(*[F.lit(k) for k in ks]),
        lambda k: ((k == F.col("_l")) & (k >= finest)) | ((k > F.col("_l")) & k.isin(sorted(other))),
    )
    out = _powered(df).withColumn("_l", _level(ks)).withColumn("_k", F.explode(wanted)).drop("_side", "_pw")
    for axis, low, high in (("_cx", "_x0", "_x1"), ("_cy", "_y0", "_y1")):
        out = out.withColumn(axis, F.explode(F.sequence(_cell(F.col(low), F.col("_k")), _cell(F.col(high), F.col("_k")))))
    return out


def _shape_columns(df: DataFrame, points: bool, shape: Column | None) -> DataFrame:
    """Columns the exact test may use: point coordinates, and WKB unless all are points."""
    g = F.col("geom")
    out = df.withColumn("_px", F.when(is_point(g), point_x(g))).withColumn("_py", F.when(is_point(g), point_y(g)))
    return out.withColumn("_wkb", F.lit(None).cast("binary") if points else (kernel.pack(g) if shape is None else shape))


def covers(right: DataFrame, shape: Column | None, rows: int) -> DataFrame:
    """Cells ``_k, _cx, _cy`` that lie within one area of ``right``: whatever has a point in one meets that area.

    An area is asked for the cells of half the power of two below its envelope side, at most nine, that its envelope holds.
    """
    areas = right.where(F.col("bbox").isNotNull() & F.col("geom")["type"].isin("Polygon", "MultiPolygon")).select("geom", "bbox")
    areas = _powered(grown(evened(areas, rows, "bbox"), None))
    areas = areas.where(F.col("_pw").between(_LOW, _HIGH - 1)).withColumn("_k", F.col("_pw") - 1).withColumn("_c", F.pow(F.lit(2.0), F.col("_k")))
    for low, high, first, last in (("_x0", "_x1", "_i0", "_i1"), ("_y0", "_y1", "_j0", "_j1")):
        areas = areas.withColumn(first, F.ceil(F.col(low) / F.col("_c"))).withColumn(last, F.floor(F.col(high) / F.col("_c")) - 1)
    areas = areas.where((F.col("_i0") <= F.col("_i1")) & (F.col("_j0") <= F.col("_j1")))

    def cells(i0: str, j0: str, i1: str, j1: str) -> Column:
        c = F.col("_c")
        return kernel.pack(box(F.col(i0) * c, F.col(j0) * c, (F.col(i1) + 1) * c, (F.col(j1) + 1) * c))

    shaped = computed(areas, _shape=kernel.pack(F.col("geom")) if shape is None else shape)
    whole = computed(shaped, _whole=kernel.contains(F.col("_shape"), cells("_i0", "_j0", "_i1", "_j1")))
    each = whole.withColumn("_cx", F.explode(F.sequence("_i0", "_i1"))).withColumn("_cy", F.explode(F.sequence("_j0", "_j1")))
    return each.where(F.col("_whole") | kernel.contains(F.col("_shape"), cells("_cx", "_cy", "_cx", "_cy"))).select("_k", "_cx", "_cy").distinct()


def _uncovered(left: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows of ``left`` without geometry, or whose first vertex is in none of the cells."""
    first = F.get(F.get(F.get(F.col("geom")["parts"], F.lit(0)), F.lit(0)), F.lit(0))
    known = F.when(F.col("bbox").isNotNull(), first)
    left = left.withColumns({c: F.nanvl(known[c[1]], F.lit(None).cast("double")) for c in ("_x", "_y")})
    counts = {r["_k"]: r["n"] for r in cells.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = 0
    for k in sorted(counts, reverse=True):
        taken += counts[k]
        if taken > COVER_CELLS:  # finer cells spare the exact join less
            break
        own = cells.where(F.col("_k") == k).select(F.col("_cx").alias("_ox"), F.col("_cy").alias("_oy"))
        left = left.join(F.broadcast(own), (_cell(F.col("_x"), k) == F.col("_ox")) & (_cell(F.col("_y"), k) == F.col("_oy")), "left_anti")
    return left.drop("_x", "_y")


_TAIL = ["_x0", "_y0", "_x1", "_y1", "_px", "_py", "_wkb", "_l", "_k", "_cx", "_cy"]


class CellJoin:
    """The two inputs of a spatial join with cells attached, ready to be joined."""

    def __init__(
        self,
        left: DataFrame,
        right: DataFrame,
        grow: Column | None = None,
        right_shape: Column | None = None,
        dedup_right: bool = False,
        hot_rows: int | None = None,
        shapes: bool = True,
        measured: list[Profile] | None = None,
    ):
        """``shapes``: whether exact shapes travel with the cells.  ``measured``: the profiles, if known."""
        kernel.install(left.sparkSession)
        self.hot_rows = hot_rows
        self.lp, self.rp = measured or profiles((left, None), (right, grow))
        self.points = self.lp.all_points and self.rp.all_points
        self.ks = levels(self.lp, self.rp)
        self.lo, self.ro = _own_levels(self.lp, self.ks), _own_levels(self.rp, self.ks)
        if self.rp.small:
            left = evened(left, self.lp.rows)
        bare = self.points or not shapes
        self.left = _shape_columns(grown(left, None), bare, None)
        right = _shape_columns(grown(right.where(F.col("bbox").isNotNull()), grow), bare, right_shape)
        # Identical shapes on the right answer the same question; one of each is enough for a test.
        if dedup_right and not self.rp.small:
            right = right.dropDuplicates(["_px", "_py"] if self.rp.all_points else ["_px", "_py", "_wkb"])
        self.right = right

    @property
    def one_cell(self) -> bool:
        """Each left row sits in exactly one cell."""
        return self.lp.all_points and len(self.ks) == 1

    def left_cells(self) -> DataFrame:
        return with_cells(self.left, self.ks, self.lo, self.ro, self.lp.all_points)

    def right_cells(self, keep_fid: bool = False) -> DataFrame:
        cells = with_cells(self.right, self.ks, self.ro, self.lo, False)
        names = (["fid"] if keep_fid else []) + _TAIL
        return cells.select(*[F.col(c).alias(f"b{c}") for c in names])

    def condition(self, keys: list[str], a, b, test: Test, once: bool) -> Column:
        terms = [a(k) == b(k) for k in keys]
        if len(self.ks) > 1:
            terms.append((a("_l") == a("_k")) | (b("_l") == b("_k")))
        terms += [a("_x0") <= b("_x1"), b("_x0") <= a("_x1"), a("_y0") <= b("_y1"), b("_y0") <= a("_y1")]
        if once:
            # A pair overlaps in several cells; it counts in the one holding its lower left corner.
            terms.append(a("_cx") == _cell(F.greatest(a("_x0"), b("_x0")), a("_k")))
            terms.append(a("_cy") == _cell(F.greatest(a("_y0"), b("_y0")), a("_k")))
        terms.append(test(a, b))
        return reduce(lambda p, q: p & q, terms)

    def _sides(self, keep_fid: bool) -> tuple[DataFrame, DataFrame, list[str]]:
        return self._placed(self.left_cells(), self.right_cells(keep_fid))

    def _placed(self, cells: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
        """Both sides broadcast or split over salts, and the keys to join them by."""
        keys = ["_k", "_cx", "_cy"]
        if self.rp.small:
            return cells, F.broadcast(right), keys
        if self.lp.small:
            # The right side streams past the broadcast left.
            return F.broadcast(cells), right, keys
        plain = right.withColumnsRenamed({f"b{k}": k for k in keys})
        row = F.struct("b_x0", "b_y0", "b_x1", "b_y1")
        cells, plain, keys, _ = spread(
            cells, plain, keys, F.col("fid"), row, self.lp.rows, self.rp.rows, self.hot_rows
        )
        return cells, plain.withColumnsRenamed({k: f"b{k}" for k in keys}), keys

    def matched(self, test: Test) -> DataFrame:
        """``fid`` of left rows with at least one right partner; it may come several times."""
        spatial = self.left.where(F.col("bbox").isNotNull())
        self.left = spatial.select("fid", *[c for c in _TAIL if c in spatial.columns])
        cells, right, keys = self._placed(self.left_cells(), self.right_cells())
        cond = self.condition(keys, F.col, lambda c: F.col(f"b{c}"), test, once=False)
        # With a small left side the large one streams past it.
        how = "inner" if self.lp.small and not self.rp.small else "left_semi"
        return cells.join(right, cond, how).select("fid")

    def pairs(self, test: Test) -> DataFrame:
        """Each matching pair once: columns of the left row and ``b``-prefixed columns of the right."""
        spatial = self.left.where(F.col("bbox").isNotNull())
        self.left = spatial.select("fid", *[c for c in _TAIL if c in spatial.columns])
        cells, right, keys = self._sides(True)
        cond = self.condition(keys, F.col, lambda c: F.col(f"b{c}"), test, once=True)
        return cells.join(right, cond, "inner")


def fetched(near: DataFrame, shapes: DataFrame, key: str, by: str, rows: int, hot_rows: int | None = None) -> DataFrame:
    """Candidate pairs ``near`` (ids only, from files) with the columns of ``shapes``, which has one row per ``key``.

    Shapes without a candidate are left behind by a semi join; pairs of a hot key are split over salts by ``by``.
    """
    wanted = shapes.join(near.select(key).distinct(), key, "left_semi")
    left, right, keys, _ = spread(near, wanted, [key], F.col(by), F.col(key), rows, 0, hot_rows)
    return left.join(right, keys).drop(*[k for k in keys if k != key])


def exists_join(
    left: DataFrame,
    right: DataFrame,
    test: Test,
    grow: Column | None = None,
    anti: bool = False,
    payload: DataFrame | None = None,
    hot_rows: int | None = None,
    right_shape: Column | None = None,
    touch: bool = False,
) -> DataFrame:
    """Rows of ``left`` with (or, ``anti``, without) a partner in ``right`` that passes ``test``.

    Where the joined geometry is a derived one, ``payload`` holds the anchored
    rows to return, and ``left`` their row numbers as ``fid``.  ``right_shape`` is the WKB that stands for a right row's geometry.
    ``touch`` says that one common point passes the test: between two large sides, left rows under a covered cell then need no
    partner to be looked for.  The join gives row numbers, and their bits are broadcast, so large inputs themselves are not shuffled.
    """
    kernel.install(left.sparkSession)
    rows = anchored(left) if payload is None else payload
    left = keyed(rows) if payload is None else left
    files = _FILES.get(rows, rows)
    names = [c for c in rows.columns if c != "_row"]
    lp, rp = profiles((left, None), (right, grow))
    right, rp = within_reach(lp, right, grow, rp)
    how = "left_anti" if anti else "left_semi"
    join = CellJoin(left, right, grow, right_shape, dedup_right=True, hot_rows=hot_rows, measured=[lp, rp])
    if join.one_cell and rp.small and payload is None:
        cells, right_cells, keys = join._placed(join.left_cells(), join.right_cells())
        cond = join.condition(keys, F.col, lambda c: F.col(f"b{c}"), test, once=False)
        kept = cells.join(right_cells, cond, how).withColumn("_row", F.col("fid")).withColumn("fid", F.col("_fid"))
    elif touch and not rp.small and not lp.small:
        others = _uncovered(left, stored(covers(right, right_shape, rp.rows), "covers"))
        unmet = stored(_words(others.select(F.col("fid").alias("_row"))), "open")
        lp = profiles((others, None))[0]
        if lp.rows:
            right, rp = within_reach(lp, right, grow, rp)
            join = CellJoin(others, right, grow, right_shape, dedup_right=True, hot_rows=hot_rows, measured=[lp, rp])
            met = _words(join.matched(test).withColumnRenamed("fid", "_row")).withColumnRenamed("_bits", "_met")
            rest = F.col("_bits").bitwiseAND(F.bitwise_not(F.coalesce("_met", F.lit(0).cast("bigint"))))
            unmet = stored(unmet.join(met, "_word", "left").select("_word", rest.alias("_bits")).where("_bits != 0"), "open")
        # Rows without geometry are among the unmet.
        kept = _marked(files if anti else rows, _hinted(unmet), "left_semi" if anti else "left_anti")
    else:
        words = stored(_words(join.matched(test).withColumnRenamed("fid", "_row")), "matched")
        # Numbers of kept rows say all: which part of the files they were looked for in does not matter any more.
        kept = _marked(rows if anti else files, _hinted(words), how)
    out = kept.select(*names)
    _KEPT[out] = (files, kept.select("_row"))
    return out
