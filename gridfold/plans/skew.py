"""Two-sided salting of hot join keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more rows than this and more than a thousandth of its side.
HOT_ROWS = 100_000
HOT_SHARE = 1000


def hot_limit(rows: int, hot_rows: int | None = None) -> int:
    """Rows a key may hold before it is split; at most ``HOT_SHARE`` keys can exceed it."""
    return max(HOT_ROWS if hot_rows is None else hot_rows, rows // HOT_SHARE)


def _salts(df: DataFrame, keys: list[str], limit: int, name: str) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    return counts.select(*keys, F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias(name))


def spread(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_id: Column,
    right_id: Column,
    left_rows: int,
    right_rows: int,
    hot_rows: int | None = None,
) -> tuple[DataFrame, DataFrame, list[str], bool]:
    """Split the rows of hot keys over salted keys, copying the other side to match.

    Returns both frames, the extended key list and whether left rows may have
    been copied.  Rows of key k get one of ``nl(k)`` left salts and one of
    ``nr(k)`` right salts; a left row is copied to all right salts and the other
    way round, so each pair of rows still meets exactly once.  The table of hot
    keys holds at most ``2 * HOT_SHARE`` rows per cell a feature covers, whatever
    the input size, and is therefore safe to broadcast.
    """
    left_limit, right_limit = hot_limit(left_rows, hot_rows), hot_limit(right_rows, hot_rows)
    hot_left, hot_right = left_rows > left_limit, right_rows > right_limit
    if not hot_left and not hot_right:
        return left, right, keys, False
    null_salt = F.lit(None).cast("int")
    sides = []
    if hot_left:
        sides.append(_salts(left, keys, left_limit, "_nl").withColumn("_nr", null_salt))
    if hot_right:
        sides.append(_salts(right, keys, right_limit, "_nr").withColumn("_nl", null_salt).select(*keys, "_nl", "_nr"))
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    hot = both.groupBy(*[F.col(k).alias(f"_h_{k}") for k in keys]).agg(F.max("_nl").alias("_nl"), F.max("_nr").alias("_nr"))

    def salted(df: DataFrame, row_id: Column, own: str, other: str, own_salt: str, other_salt: str) -> DataFrame:
        # A NULL key never joins, but its rows still travel: spread those as well.
        on = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys]
        out = df.join(F.broadcast(hot), on, "left")
        own_n, other_n = F.coalesce(F.col(own), F.lit(1)), F.coalesce(F.col(other), F.lit(1))
        out = out.withColumn(own_salt, F.pmod(F.xxhash64(row_id), own_n).cast("int"))
        out = out.withColumn(other_salt, F.explode(F.sequence(F.lit(0), other_n - 1)))
        return out.drop("_nl", "_nr", *[f"_h_{k}" for k in keys])

    return (
        salted(left, left_id, "_nl", "_nr", "_sl", "_sr"),
        salted(right, right_id, "_nr", "_nl", "_sr", "_sl"),
        [*keys, "_sl", "_sr"],
        hot_right,
    )


def copied_lookup(left: DataFrame, right: DataFrame, keys: list[str], row_id: Column, copies: int) -> DataFrame:
    """Inner join to a table with few rows per key, whose left keys may be hot.

    Left rows are dealt over ``copies`` salts and the right table is repeated for
    each.  Needs no count of the left side, which may be costly to compute twice.
    """
    if copies <= 1:
        return left.join(right, keys)
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(copies)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return dealt.join(repeated, [*keys, "_salt"]).drop("_salt")


#: Inputs up to this many rows are dealt over all cores before a costly test.
EVEN_ROWS = 2_000_000


def evened(df: DataFrame, rows: int, by: str = "fid") -> DataFrame:
    """A small input, often a single file, over all cores; larger ones have splits enough."""
    if rows > EVEN_ROWS:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, by)


#: Tasks a core, for work that costs far more than a shuffle of its input.
TASKS_PER_CORE = 4


def dealt(df: DataFrame) -> DataFrame:
    """Rows over all cores before costly work on each, however few files and row groups they come from."""
    return df.repartition(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)
