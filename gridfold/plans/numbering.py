"""Row numbers without a sort or a window over all rows: counts per partition first, then offsets."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfold.session import stored

_PLACE = 2**33 - 1


def offsets(df: DataFrame, **weights: Column) -> DataFrame:
    """``df``, written once, with a column for each of ``weights``: the sum over all rows before, in partition order.

    A row's weight must be a whole number.  Within a partition a running sum (a window by partition) is taken, and
    each partition starts at the total of those before it: one small row per partition passes the driver.
    """
    names = list(weights)
    rows = stored(df.withColumns({f"_w_{n}": w for n, w in weights.items()}).withColumn("_at", F.monotonically_increasing_id()), "offsets")
    part = F.shiftright("_at", 33)
    totals = rows.groupBy(part.alias("_part")).agg(*[F.sum(f"_w_{n}").alias(n) for n in names]).orderBy("_part").collect()
    starts = [list(accumulate((r[n] or 0 for r in totals), initial=0)) for n in names]
    table = [(r["_part"], *[s[i] for s in starts]) for i, r in enumerate(totals)]
    spark = df.sparkSession
    first = spark.createDataFrame(table, "_part bigint, " + ", ".join(f"_s_{n} bigint" for n in names))
    before = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_part", part).join(F.broadcast(first), "_part")
    out = {n: F.col(f"_s_{n}") + F.coalesce(F.sum(f"_w_{n}").over(before), F.lit(0)) for n in names}
    return summed.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def numbered(df: DataFrame, name: str, start: int = 0) -> DataFrame:
    """``df``, written once, with a dense number for each row from ``start`` on."""
    rows = stored(df.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    totals = sorted(rows.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect())
    starts = dict(zip((r["_part"] for r in totals), accumulate((r["n"] for r in totals), initial=start)))
    # By partition number, as one text literal that the optimizer folds into an array: no join, however small the input.
    table = F.split(F.lit(",".join(str(starts.get(p, 0)) for p in range(max(starts, default=0) + 1))), ",").cast("array<bigint>")
    return rows.select(*df.columns, (F.get(table, part.cast("int")) + F.col("_at").bitwiseAND(F.lit(_PLACE))).alias(name))
