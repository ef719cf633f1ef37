"""Registration of this subpackage's queries and helpers that its operators share."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a filter for each of its keys, and of a part that one row of its table holds; with more keys than the most allow, more rows pass.
FILTER_BITS, PART_BITS, MOST_BITS = 32, 1 << 15, 1 << 27
#: Rows of a batch that Python works on at a time.
SLICE = 512
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL where there is one."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def ship(spark: SparkSession) -> None:
    """Give the package to the session's Python workers, once per context."""
    context = spark.sparkContext
    if getattr(context, "_gridfold_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='gridfold-code-')}/gridfold", "zip", package.parent, package.name)
    context.addPyFile(archive)
    context._gridfold_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def whole_text(docs: DataFrame, column: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    """XXH64 of each word."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def sliced(batches: Iterator[pa.RecordBatch | pa.Array], rows: int | None = None) -> Iterator[pa.RecordBatch | pa.Array]:
    """Batches cut into slices of at most ``rows`` rows (``SLICE``), so that what is made of them is never that of a whole batch."""
    for batch in batches:
        for at in range(0, len(batch), rows or SLICE):
            yield batch.slice(at, rows or SLICE)


def may_be_among(keys: DataFrame, name: str) -> Callable[[Column], Column]:
    """A test of a hash (long, not null): true for each value of the column ``name`` of ``keys``, and for few others.

    The values are hashes themselves and set one bit each.  The bits, at most ``MOST_BITS``, are broadcast: what cannot match
    need not be shuffled, and an exact join of the rest has to follow.
    """
    size = PART_BITS
    wanted = min(MOST_BITS, FILTER_BITS * keys.count())
    while size < wanted:
        size *= 2
    at = F.col(name).bitwiseAND(F.lit(size - 1))
    parts = keys.groupBy(F.shiftright(at, 15).alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(PART_BITS - 1))).alias("bits"))
    held = np.zeros(size // 8, np.uint8)
    for part, bits in parts.collect():
        held[part * (PART_BITS // 8) : (part + 1) * (PART_BITS // 8)] = np.frombuffer(bits, np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(held)

    @F.arrow_udf(T.BooleanType())
    def among(hashes: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in hashes:
            at = part.to_numpy(zero_copy_only=False) & np.int64(size - 1)
            yield pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return among


def by_group(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Batches of rows sorted by ``key``, cut so that no group is in two of them.

    Memory is bounded by one batch and one group, so groups have to be bounded.
    """
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        rest = now if rest is None else pa.concat_tables([rest, now]).combine_chunks()
        differs = np.zeros(rest.num_rows, bool)
        for name in key:
            differs |= rest[name].to_numpy() != rest[name][-1].as_py()
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if cut:
            yield rest.slice(0, cut)
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest
