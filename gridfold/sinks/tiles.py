"""Features cut into Web Mercator tiles, as a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridfold.functions import kernel
from gridfold.functions.clip import clip_geometry
from gridfold.functions.measure import bbox_of, is_point, vertex
from gridfold.functions.project import map_vertices
from gridfold.functions.tilemath import PI, grid, tile_bounds, tile_id, tile_range, world_x, world_y
from gridfold.operators.combine import dedup_features
from gridfold.schema import computed
from gridfold.session import stored

# Tile extent, buffer and simplification in tile units.
EXTENT, BUFFER, TOLERANCE = 4096, 64, 3.0
MARGIN = BUFFER / EXTENT
#: Features spanning more tiles than this at the last zoom go down a pyramid: each step of so many zooms cuts the pieces of the step before.
SPAN, STEP = 8, 3
#: Rows of the tile table that one task sorts.
SORTED_ROWS = 1_000_000

TILE_COLUMNS = ["z", "x", "y", "tile_id", "layer", "fid", "geom", "properties"]


def _unit(geom: Column) -> Column:
    """Degrees to the unit square of the world, latitude clamped to it."""
    y = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), world_y(v["y"])))
    return map_vertices(geom, lambda v: vertex(world_x(v["x"]), y(v)))


def _spread(rows: DataFrame, zooms: Column, limits: Column) -> DataFrame:
    """One row per tile that a unit-square geometry (with buffer) touches, inside the range of the data."""
    b, n, lim = F.col("ubox"), grid(F.col("z")), F.element_at(limits, F.col("z") + 1)

    def span(low: str, high: str) -> Column:
        first = F.greatest(F.floor(b[low] * n - MARGIN), lim[low])
        last = F.least(F.floor(b[high] * n + MARGIN), lim[high])
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    out = rows.withColumn("z", F.explode(zooms))
    return out.withColumn("x", span("xmin", "xmax")).withColumn("y", span("ymin", "ymax"))


def _cut(rows: DataFrame) -> DataFrame:
    """Clip the unit geometry to its tile with buffer."""
    n = grid(F.col("z"))
    edges = [
        (F.col("x") - MARGIN) / n,
        (F.col("y") - MARGIN) / n,
        (F.col("x") + 1 + MARGIN) / n,
        (F.col("y") + 1 + MARGIN) / n,
    ]
    b = F.col("ubox")
    whole = (b["xmin"] >= edges[0]) & (b["ymin"] >= edges[1]) & (b["xmax"] <= edges[2]) & (b["ymax"] <= edges[3])
    cut = F.when(whole, F.col("unit")).otherwise(clip_geometry(F.col("unit"), *edges))
    return computed(rows, unit=cut).where(F.col("unit").isNotNull())


_SIDES = {"xmin": min, "ymin": min, "xmax": max, "ymax": max}


def _measure(frames: dict[str, DataFrame], maxzoom: int) -> dict:
    """One aggregate over all frames: per name the tile range of each zoom, whether all are points, whether some span many tiles."""
    b = F.col("bbox")
    width = (b["xmax"] - b["xmin"]) / 360
    height = F.abs(world_y(b["ymin"]) - world_y(b["ymax"]))
    rows = [df.where(F.col("geom").isNotNull()).select(F.lit(name).alias("name"), "geom", "bbox") for name, df in frames.items()]
    stats = reduce(DataFrame.unionByName, rows).groupBy("name").agg(
        F.struct(*[(F.min if f is min else F.max)(b[c]).alias(c) for c, f in _SIDES.items()]).alias("b"),
        F.bool_and(is_point(F.col("geom"))).alias("points"),
        (F.max(F.greatest(width, height)) * 2.0**maxzoom > SPAN).alias("large"),
    )
    limits = F.array(*[tile_range(F.col("b"), F.lit(z)) for z in range(maxzoom + 1)])
    return {r["name"]: r for r in stats.select("name", "points", "large", limits.alias("limits")).collect()}


def _limits(stats: dict) -> Column:
    """The common tile range per zoom: each side depends on one side of the envelope, in its order."""
    zooms = zip(*[row["limits"] for row in stats.values()])
    ranges = [F.struct(*[F.lit(f(r[c] for r in same)).cast("bigint").alias(c) for c, f in _SIDES.items()]) for same in zooms]
    return F.array(*ranges)


def _pyramid(large: DataFrame, minzoom: int, maxzoom: int, limits: Column) -> DataFrame:
    """Pieces of large features: every ``STEP`` zooms, tiles are cut from the pieces of the last zoom before.

    The buffer of a tile lies inside that of its parent, so a piece holds all that its children need.  Each step is
    written, and its pieces are dealt by tile and feature: a long feature is cut by many tasks and in ever smaller parts.
    """
    name = "pieces"
    top = stored(_cut(_spread(large, F.array(F.lit(minzoom)), limits)).drop("ubox"), name)
    steps = [top]
    for last in range(minzoom, maxzoom, STEP):
        parents = top.where(F.col("z") == last).drop("z").withColumnsRenamed({"x": "_px", "y": "_py"}).repartition("_px", "_py", "fid")
        zooms = F.sequence(F.lit(last + 1), F.lit(min(last + STEP, maxzoom)))
        below = _spread(computed(parents, ubox=bbox_of(F.col("unit"))), zooms, limits)
        shift = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("z") - last))  # noqa: B023, E731
        below = below.where((shift("x") == F.col("_px")) & (shift("y") == F.col("_py"))).drop("_px", "_py")
        top = stored(_cut(below).drop("ubox"), name)
        steps.append(top)
    return reduce(DataFrame.unionByName, steps)


def build_tiles(
    df: DataFrame, minzoom: int = 0, maxzoom: int = 14, layer: str = "features", among: list[DataFrame] | None = None
) -> DataFrame:
    """``z, x, y, tile_id, layer, fid, geom, properties`` with geometry in tile units 0..4096.

    Features spanning many tiles are cut zoom step by zoom step, each from the pieces of the step before, so
    one large feature does not end up in one task.  With ``among`` the tiles may lie in the common range of those frames.
    """
    own = _measure({layer: df}, maxzoom)
    wide = own if among is None else _measure({str(i): o for i, o in enumerate(among)}, maxzoom)
    return _tiles(df, minzoom, maxzoom, layer, own, wide)


def _tiles(df: DataFrame, minzoom: int, maxzoom: int, layer: str, own: dict, wide: dict) -> DataFrame:
    if not 0 <= minzoom <= maxzoom <= 22:
        raise ValueError("tiles: need 0 <= minzoom <= maxzoom <= 22")
    if layer not in own:
        raise ValueError("tiles: no features to tile")
    kernel.install(df.sparkSession)
    stats, limits = own[layer], _limits(wide)
    spatial = df.where(F.col("geom").isNotNull())
    unit = computed(spatial.select("fid", "geom", "properties"), unit=_unit(F.col("geom"))).drop("geom")
    unit = computed(unit, ubox=bbox_of(F.col("unit")))

    every = F.sequence(F.lit(minzoom), F.lit(maxzoom))
    if stats["points"]:
        # The tile range of a point is exact; there is nothing to clip.
        tiles = _spread(unit, every, limits)
    elif not stats["large"]:
        tiles = _cut(_spread(unit, every, limits))
    else:
        b = F.col("ubox")
        large = F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"]) * 2.0**maxzoom > SPAN
        tiles = _cut(_spread(unit.where(~large), every, limits)).drop("ubox")
        tiles = tiles.unionByName(_pyramid(unit.where(large), minzoom, maxzoom, limits))

    n = grid(F.col("z"))
    scaled = map_vertices(
        F.col("unit"), lambda v: vertex((v["x"] * n - F.col("x")) * EXTENT, (v["y"] * n - F.col("y")) * EXTENT)
    )
    if not stats["points"]:
        tiles = computed(tiles, unit=scaled)
        simple = kernel.unpack(kernel.simplify(kernel.pack(F.col("unit")), F.lit(TOLERANCE)))
        coarser = ~is_point(F.col("unit")) & (F.col("z") < maxzoom)
        tiles = computed(tiles, unit=F.when(coarser, simple).otherwise(F.col("unit"))).where(F.size("unit.parts") > 0)
        scaled = F.col("unit")
    return tiles.select(
        "z",
        "x",
        "y",
        tile_id(F.col("z"), F.col("x"), F.col("y")).alias("tile_id"),
        F.lit(layer).alias("layer"),
        "fid",
        map_vertices(scaled, lambda v: vertex(F.round(v["x"]), F.round(v["y"]))).alias("geom"),
        "properties",
    )


def build_layers(layers: dict[str, DataFrame], minzoom: int = 0, maxzoom: int = 14) -> DataFrame:
    """Tiles of several datasets, one layer each, in their common range, all measured in one job; every dataset needs features."""
    if not layers:
        raise ValueError("tiles: needs at least one layer")
    stats = _measure(layers, maxzoom)
    return reduce(DataFrame.unionByName, [_tiles(df, minzoom, maxzoom, name, stats, stats) for name, df in layers.items()])


def write_tiles(tiles: DataFrame, path: str, partitions: int | None = None) -> None:
    """Tile table by zoom, in Hilbert order inside the files.

    The zoom leads the sort: a write by zoom would otherwise sort by it alone and
    lose the order.  Tiles are made once and counted, and a task sorts some ``SORTED_ROWS`` of them: ``partitions`` is
    the least number of ranges, and more rows have more ranges.
    """
    keys = ["z", "tile_id", "layer", "fid"]
    tiles = stored(tiles, "tiles")
    ranges = -(-tiles.count() // SORTED_ROWS)
    least = partitions or int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = tiles.repartitionByRange(max(least, ranges), *keys)
    spread.sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("z").parquet(path)


def tile_sizes(tiles: DataFrame) -> DataFrame:
    """``z, tile_id, bytes, offset``: text size of each tile and the running start in tile order.

    The running sum goes block by block, so no window holds all tiles of a zoom.
    """
    text = F.octet_length(F.to_json("geom")) + F.octet_length(F.coalesce("properties", F.lit("")))
    sizes = tiles.groupBy("z", "tile_id").agg(F.sum(text).cast("bigint").alias("bytes"))
    sizes = sizes.withColumn("block", F.floor(F.col("tile_id") / 65536))
    blocks = sizes.groupBy("z", "block").agg(F.sum("bytes").alias("n"))
    before = Window.partitionBy("z").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("z", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("z", "block").orderBy("tile_id").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.join(blocks, ["z", "block"])
        .withColumn("offset", F.col("start") + F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
        .select("z", "tile_id", "bytes", "offset")
    )


def read_tiles(
    spark: SparkSession,
    path: str,
    bbox: tuple[float, float, float, float],
    zoom: int,
    layers: list[str] | None = None,
) -> DataFrame:
    """Features of the tiles of one zoom that meet a bbox, cut to their tile, copies removed.

    The zoom is a partition of the table and the tile range is pushed to the scan.
    """
    table = spark.read.parquet(path)
    box = F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(bbox, ("xmin", "ymin", "xmax", "ymax"))])
    r = spark.range(1).select(tile_range(box, F.lit(zoom)).alias("r")).first()["r"]
    inside = (F.col("z") == zoom) & F.col("x").between(r["xmin"], r["xmax"]) & F.col("y").between(r["ymin"], r["ymax"])
    tiles = table.where(inside)
    if layers:
        known = {row["layer"] for row in table.where(F.col("z") == zoom).select("layer").distinct().collect()}
        unknown = [name for name in layers if name not in known]
        if unknown:
            raise ValueError(f"layers {unknown} not found, available: {sorted(known)}")
        tiles = tiles.where(F.col("layer").isin(layers))
    n = float(2**zoom)
    lat = lambda v: F.degrees(F.atan(F.sinh(PI * (1 - 2 * (F.col("y") + v["y"] / EXTENT) / n))))
    degrees = map_vertices(F.col("geom"), lambda v: vertex((F.col("x") + v["x"] / EXTENT) / n * 360 - 180, lat(v)))
    tiles = computed(tiles.withColumn("_b", tile_bounds(F.col("x"), F.col("y"), F.lit(zoom))), geom=degrees)
    b = F.col("_b")
    cut = clip_geometry(F.col("geom"), b["xmin"], b["ymin"], b["xmax"], b["ymax"])
    tiles = computed(tiles, geom=cut).where(F.col("geom").isNotNull())
    unique = dedup_features(tiles, "layer", ["tile_id", "fid"])
    return computed(unique, bbox=bbox_of(F.col("geom"))).select("layer", "fid", "geom", "bbox", "properties")
