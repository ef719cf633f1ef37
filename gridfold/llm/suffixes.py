"""Repeated passages by a sparse suffix array.

Only suffixes at minimiser positions are kept: the least hashed word group of every few, which equal
passages choose alike.  Suffixes are sorted by the hash of their first words, then by id, and compared with
the neighbour before; equal neighbours that continue each other are one run, whose ends are then
extended left and right until the texts differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfold.llm.base import whole_text, word_hashes
from gridfold.session import stored

#: Words of a group, groups of which the least is chosen, and first words that neighbours must share.
GROUP, CHOICE, PREFIX = 4, 10, 40
#: Every repeat of this many words is found.
LEAST = PREFIX + CHOICE
#: Up to here the steps of an extension are single words.
NEAR = 16
KEYS = ["prefix", "doc_id", "at"]
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 2**64))


def _reaches() -> np.ndarray:
    out = [1]
    while out[-1] < 2**31:
        out.append(out[-1] + max(1, out[-1] // 8))
    return np.array(out)


#: Lengths tried at the ends of a run, each longer by an eighth or one word.
REACHES = _reaches()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def chosen_positions(hashes: np.ndarray) -> np.ndarray:
    """Positions of the least of each ``CHOICE`` neighbouring word groups (the first of equal ones)."""
    n = len(hashes) - GROUP + 1
    if n < CHOICE:
        return np.zeros(0, np.int64)
    group = np.zeros(n, np.uint64)
    for i in range(GROUP):
        group = group * _FACTOR + hashes[i : i + n]
    group ^= group >> np.uint64(31)
    views = np.lib.stride_tricks.sliding_window_view(group, CHOICE)
    return np.unique(views.argmin(axis=1) + np.arange(len(views)))


class Running:
    """Hashes of any stretch of a text's words: differences of one running polynomial."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _FACTOR)]), dtype=np.uint64)
        self.total = np.concatenate([[np.uint64(0)], np.cumsum(hashes * power[:n], dtype=np.uint64)])
        # Powers of the factor's inverse make equal words equal wherever they stand.
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]), dtype=np.uint64)

    def of(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        out = (self.total[at + size] - self.total[at]) * self.back[at]
        return out ^ (out >> np.uint64(32))


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i, (tag, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            words = words_of(text)
            if len(words) < LEAST:
                continue
            hashes = word_hashes(words)
            at = chosen_positions(hashes)
            at = at[at + PREFIX <= len(words)]
            out.append((np.full(len(at), i), Running(hashes).of(at, PREFIX).view(np.int64), at + (tag << 32)))
        if out:
            row, prefix, at = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(prefix), batch.column(0).take(pa.array(row)), pa.array(at)], KEYS)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes: links of each to the one before with an equal prefix, and the two ends of the part."""
    names = ["end", *KEYS, "other_id", "other_at"]
    last: tuple | None = None

    def emit(end: bool, cols: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), end)), *[pa.array(c, pa.int64()) for c in cols]], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        prefix, doc, at = (c.to_numpy() for c in batch.columns)
        if last is None:
            yield emit(True, [[int(prefix[0])], [int(doc[0])], [int(at[0])], [None], [None]])
        before = [np.concatenate([[x[0] if last is None else last[i]], x[:-1]]) for i, x in enumerate((prefix, doc, at))]
        same = before[0] == prefix
        same[0] &= last is not None
        if same.any():
            yield emit(False, [c[same] for c in (prefix, doc, at, before[1], before[2])])
        last = (prefix[-1], doc[-1], at[-1])
    if last is not None:
        yield emit(True, [[int(x)] for x in last] + [[None], [None]])


def _common_prefix(a: Column, b: Column) -> Column:
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def surroundings(text: pd.Series, asked: pd.Series) -> pd.Series:
    """For each asked run: its words hashed, and hashes of the ``REACHES`` before and after that the text has."""
    out = []
    for t, runs in zip(text, asked):
        words = words_of(t)
        running, rows = Running(word_hashes(words)), []
        for r in runs:
            a, b = r["start"], r["stop"]
            left, right = (REACHES[: np.searchsorted(REACHES, room, "right")] for room in (a, len(words) - b))
            seen = {"left": running.of(a - left, left).view(np.int64), "right": running.of(np.full(len(right), b), right).view(np.int64)}
            rows.append({"run": r["run"], "second": r["second"], "digest": xxhash.xxh3_128_hexdigest(b" ".join(words[a:b])), **seen})
        out.append(rows)
    return pd.Series(out, dtype=object)


def closing_words(text: pd.Series, asked: pd.Series) -> pd.Series:
    """For each asked run of which so many ``REACHES`` agree: the last of them, and the words hashed up to the next, nearest first."""
    out = []
    for t, runs in zip(text, asked):
        hashes, rows = word_hashes(words_of(t)).view(np.int64), []
        for r in runs:
            (left, left_end), (right, right_end) = ((int(REACHES[k - 1]) if k else 0, int(REACHES[k])) for k in (r["n_left"], r["n_right"]))
            a, b = r["start"], r["stop"]
            seen = {"left": hashes[max(0, a - left_end) : a - left][::-1], "right": hashes[b + right : b + right_end]}
            rows.append({"run": r["run"], "second": r["second"], "more_left": left, "more_right": right, **seen})
        out.append(rows)
    return pd.Series(out, dtype=object)


def _asked(rows: DataFrame, runs: DataFrame, look, returns: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """What ``look`` sees in both texts of each run."""
    asked = runs.select("run", *extra, F.explode(F.array(F.lit(False), F.lit(True))).alias("second"))
    pick = lambda a, b: F.when(F.col("second"), F.col(f"run.{b}")).otherwise(F.col(f"run.{a}"))
    back = F.when(F.col("second"), F.col("run.shift")).otherwise(F.lit(0))
    request = F.struct("run", "second", (F.col("run.start") - back).cast("int").alias("start"), (F.col("run.stop") - back).cast("int").alias("stop"), *extra)
    asked = asked.select(pick("doc_id", "other_id").alias("doc_id"), pick("tag", "other_tag").alias("tag"), request.alias("request"))
    asked = asked.groupBy("doc_id", "tag").agg(F.collect_list("request").alias("asked"))  # links of one document
    seen = F.pandas_udf(look, f"array<struct<run:{runs.schema['run'].dataType.simpleString()},second:boolean,{returns},left:array<long>,right:array<long>>>")
    return rows.join(asked, ["doc_id", "tag"]).select(F.explode(seen("text", "asked")).alias("seen")).select("seen.*")


def _both(seen: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row per run with each column of the first (``_0``) and the second (``_1``) text."""
    side = lambda c, second: F.max(F.when(F.col("second") == second, F.col(c))).alias(f"{c}_{int(second)}")
    return seen.groupBy("run").agg(*[side(c, s) for c in columns for s in (False, True)])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``doc_id, start, length, other_id, other_start``: passages (in words between ASCII white space)
    that two places of ``docs`` share word by word, as long as they go on to both sides, each place linked
    with its neighbour in the suffix order.

    A passage of ``LEAST`` words or more that occurs n times is found at all n places, which are joined through
    links.  Suffixes of equal first ``PREFIX`` words are in order of id, not of what follows, so of a longer passage a
    link of such a chain may hold a part only, but ``PREFIX`` words or more.  Nothing shorter than ``PREFIX`` is reported.
    Suffixes are sorted over ranges of (prefix, id, position), so a passage of a third of all documents
    is spread over many tasks; only the two end rows of each part are compared apart.  Words beside
    a run are compared by 64-bit hashes.
    Places within one row count too.  Null ids count as the largest id and are returned as null; rows
    of equal id and text are one document; null and blank texts have no passages.
    """
    text = whole_text(docs)
    none = F.lit(2**63 - 1)
    tag = F.xxhash64(text).bitwiseAND(F.lit(2**31 - 1)).alias("tag")
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), none).alias("doc_id"), tag, text.alias("text"))
    keyed = "prefix long, doc_id long, at long"
    found = rows.mapInArrow(_suffixes, keyed).distinct().repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)
    pairs = stored(found.mapInArrow(_neighbours, f"end boolean, {keyed}, other_id long, other_at long"), "neighbours")
    ends = pairs.where("end").select(*KEYS).distinct()  # two rows per part
    whole = Window.orderBy(*KEYS)
    ends = ends.select("*", F.lag("prefix").over(whole).alias("p"), F.lag("doc_id").over(whole).alias("other_id"), F.lag("at").over(whole).alias("other_at"))
    links = pairs.where("not end").select("doc_id", "at", "other_id", "other_at")
    links = links.union(ends.where("p = prefix").select("doc_id", "at", "other_id", "other_at")).distinct()
    # Runs: one other place, one distance, no more than a choice apart.
    low = F.lit(2**32 - 1)
    place = {"tag": F.shiftright("at", 32), "other_tag": F.shiftright("other_at", 32), "start": F.col("at").bitwiseAND(low), "other_start": F.col("other_at").bitwiseAND(low)}
    links = links.select("doc_id", "other_id", *[c.alias(n) for n, c in place.items()]).withColumn("shift", F.col("start") - F.col("other_start"))
    one = ["doc_id", "tag", "other_id", "other_tag", "shift"]
    order = Window.partitionBy(*one).orderBy("start")
    new = F.coalesce((F.col("start") - F.lag("start").over(order) > PREFIX).cast("int"), F.lit(1))
    runs = links.withColumn("new", new).withColumn("part", F.sum("new").over(order)).groupBy(*one, "part")
    runs = runs.agg(F.min("start").cast("int").alias("start"), (F.max("start") + PREFIX).cast("int").alias("stop"))
    runs = stored(runs.withColumn("run", F.struct(*one, "start", "stop")).select("run"), "runs")
    agree = [_common_prefix(F.col(f"{c}_0"), F.col(f"{c}_1")) for c in ("left", "right")]
    seen = _both(_asked(rows, runs, surroundings, "digest:string"), ("digest", "left", "right")).where("digest_0 = digest_1")
    seen = stored(seen.select("run", *[c.alias(n) for n, c in zip(("n_left", "n_right"), agree)]), "extended")
    far = (F.col("n_left") >= NEAR) | (F.col("n_right") >= NEAR)  # up to there, so many reaches are so many words
    near = seen.where(~far).select("run", "n_left", "n_right")
    more = _both(_asked(rows, seen.where(far), closing_words, "more_left:int,more_right:int", ("n_left", "n_right")), ("more_left", "more_right", "left", "right"))
    more = more.select("run", *[(F.col(f"more_{c}_0") + n).alias(f"n_{c}") for c, n in zip(("left", "right"), agree)])
    start = F.col("run.start") - F.col("n_left")
    size = F.col("run.stop") - start + F.col("n_right")
    # Runs of one distance may grow into the same passage.
    grown = near.union(more).select(*[F.col(f"run.{c}") for c in one], start.alias("start"), size.alias("length")).distinct()
    real = lambda c: F.when(F.col(c) != none, F.col(c)).alias(c)
    return grown.select(real("doc_id"), "start", "length", real("other_id"), (F.col("start") - F.col("shift")).cast("int").alias("other_start"))
