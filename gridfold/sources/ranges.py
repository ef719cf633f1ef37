"""Records that cross lines and splits: each task scans its byte range of a file, and loose ends are put together.

Spark's text source deals the ranges, so any store it reads will do.  A first pass finds the state in
which each range starts (one small row per range); a second cuts the ranges into records.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridfold.session import stored

#: What a piece is of its record: all of it, its first part, a whole range inside it, its last part.
WHOLE, HEAD, MIDDLE, TAIL = range(4)


def read_ranges(spark: SparkSession, path: str, end: str) -> DataFrame:
    """``file, start, size, value``: texts up to each ``end``, in the order of their range (``start`` in ``file``)."""
    given = spark.read.text(path, lineSep=end)
    return given.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), "value")


def joined(pieces: DataFrame, *kept: str) -> DataFrame:
    """``file, record`` and ``kept`` columns of whole records, and of those whose pieces lie in several ranges.

    ``pieces``: ``file, start, kind, record``.  Only loose ends (two a range at most) are sorted and grouped.
    """
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "record", *kept)
    loose = pieces.where(F.col("kind") != WHOLE)
    head = F.col("kind") == HEAD
    order = Window.partitionBy("file").orderBy("start", head)  # a range ends one record before it begins another
    numbered = loose.withColumn("number", F.sum(head.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("start", head.alias("head"), "record")))
    first = [F.max_by(c, head).alias(c) for c in kept]
    one = numbered.groupBy("file", "number").agg(F.array_join(F.transform(parts, lambda p: p["record"]), "").alias("record"), *first)
    return whole.unionByName(one.select("file", "record", *kept))


# --- delimited text -------------------------------------------------------------------------------------


def open_ranges(lines: DataFrame) -> tuple[int, DataFrame]:
    """How many lines leave a quoted field open, and the ranges (``file, start``) that begin inside one."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    blocks = lines.groupBy("file", "start").agg(F.sum(quotes).alias("n"), F.count_if(quotes % 2 == 1).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    started = blocks.select("file", "start", "odd", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("open"))
    total = blocks.agg(F.coalesce(F.sum("odd"), F.lit(0))).first()[0]
    return total, started.where("open").select("file", "start")


def _records(shared):
    """Lines of ranges to pieces of records; quotes open and close fields wherever they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began: set = shared.value
        now, held, inside, continued, titled = None, [], False, False, False
        names = ["file", "start", "kind", "title", "record"]

        for batch in batches:
            out: list[tuple] = []
            for file, start, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (file, start) != now:
                    if held:  # the rest of the range before
                        out.append((*now, MIDDLE if continued else HEAD, not titled and now[1] == 0, "".join(held)))
                    now, held = (file, start), []
                    inside = continued = now in began
                    titled = start != 0
                held.append(value + "\n")
                if value.count('"') % 2:
                    inside = not inside
                if not inside:
                    record = "".join(held)
                    if record.strip() or continued:
                        out.append((*now, TAIL if continued else WHOLE, not titled, record))
                        titled = True
                    held, continued = [], False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, MIDDLE if continued else HEAD, not titled and now[1] == 0, "".join(held))], names)

    return run


def quoted_records(lines: DataFrame, opened: DataFrame) -> DataFrame:
    """``file, record, title``: rows of delimited files with line ends inside quotes; ``title`` marks a file's first.

    The ranges that begin inside quotes are broadcast: one entry of a path and a number for a split of a file at most.
    """
    began = {(r["file"], r["start"]) for r in opened.collect()}
    shared = lines.sparkSession.sparkContext.broadcast(began)
    pieces = lines.select("file", "start", "value").mapInArrow(_records(shared), "file string, start long, kind long, title boolean, record string")
    trimmed = F.regexp_replace("record", r"[\r\n]+$", "")
    return joined(pieces, "title").select("file", trimmed.alias("record"), "title").where(F.trim("record") != "")


# --- JSON documents ---------------------------------------------------------------------------------------

#: Containers below the root: the features array, and any other.
FEATURES, OTHER = 1, 2
#: A piece of what remains of a document without its features.
REST = 4
_QUOTE, _BACKSLASH = b'"\\'
_FEATURES_KEY = re.compile(rb'"features"\s*:\s*$')


def _marks(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Per byte: whether an odd number of quotes stands before it (itself included), and +1 or -1 for brackets of any kind."""
    b = np.frombuffer(text, np.uint8)
    quote = b == _QUOTE
    if b"\\" in text:
        place = np.arange(len(b))
        plain = np.maximum.accumulate(np.where(b != _BACKSLASH, place, -1))
        run = np.concatenate([[0], place[:-1] - plain[:-1]])  # of backslashes right before
        quote &= run % 2 == 0
    step = np.isin(b, np.frombuffer(b"{[", np.uint8)).astype(np.int8) - np.isin(b, np.frombuffer(b"}]", np.uint8)).astype(np.int8)
    return np.cumsum(quote) % 2 == 1, step


def _openers(text: bytes, outside: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of opening brackets outside strings, the depth each leads to (from 0 at the start), and the depth at the end."""
    depth = np.cumsum(np.where(outside, step, 0))
    at = np.flatnonzero(outside & (step > 0))
    return at, depth[at], int(depth[-1]) if len(depth) else 0


def _container(text: bytes, at: int) -> int:
    return FEATURES if text[at : at + 1] == b"[" and _FEATURES_KEY.search(text, max(0, at - 200), at) else OTHER


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """Neighbouring rows of one range as one text, every row with the bracket that ended it."""
    for batch in batches:
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
        for key, group in groupby(rows, key=lambda r: (r[0], r[1])):
            yield key, b"".join(r[2] + b"}" for r in group)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a range: bytes, whether it holds an odd number of quotes, the first character, and for a start outside and
    inside a string the depth gained and the last container opened at each depth."""
    now, size, odd, first, gained, last = None, 0, False, "", [0, 0], [{}, {}]

    def done() -> pa.RecordBatch:
        values = [(now[0], pa.string()), (now[1], pa.int64()), (size, pa.int64()), (odd, pa.bool_()), (first, pa.string()), (json.dumps([gained, [sorted(x.items()) for x in last]]), pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], ["file", "start", "bytes", "odd", "first", "depths"])

    for key, text in _texts(batches):
        if key != now:
            if now is not None:
                yield done()
            now, size, odd, first, gained, last = key, 0, False, "", [0, 0], [{}, {}]
        size += len(text)
        first = first or text.lstrip(b"\xef\xbb\xbf \t\r\n")[:1].decode("latin-1")
        inside, step = _marks(text)
        for began in (0, 1):
            outside = inside if began ^ odd else ~inside
            at, depth, end = _openers(text, outside, step)
            for d in np.unique(depth).tolist():
                last[began][gained[began] + d] = _container(text, int(at[np.flatnonzero(depth == d)[-1]]))
            gained[began] += end
        odd ^= bool(inside[-1])
    if now is not None:
        yield done()


def range_states(rows: list) -> tuple[dict, dict]:
    """From the summaries of all ranges: the state in which each starts, and a fault of each file that has one.

    A state is whether a string is open, the depth, the container below the root, and the depth of a feature.
    """
    states, faults = {}, {}
    for file, group in groupby(sorted(rows, key=lambda r: (r["file"], r["start"])), key=lambda r: r["file"]):
        inside, depth, container, level, total = False, 0, OTHER, 3, 0
        for r in group:
            if r["start"] == 0:
                level, container = (2, FEATURES) if r["first"] == "[" else (3, OTHER)
            states[file, r["start"]] = (inside, depth, container, level)
            gained, last = json.loads(r["depths"])
            began = int(inside)
            if level == 3:
                container = dict(last[began]).get(2 - depth, container)
            depth, inside, total = depth + gained[began], inside ^ r["odd"], total + r["bytes"]
        if total > r["size"] and not inside:
            depth += 1  # the bracket that a text without one at its very end was given
        if inside or depth:
            faults[file] = "a string or bracket is left open" if inside or depth > 0 else "a bracket is closed that was not opened"
    return states, faults


def _cut(shared):
    """Ranges to pieces of features and of what remains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = shared.value
        now, state, held, continued, rest, out = None, None, [], False, [], []

        def close() -> None:
            if now is not None:
                if held:
                    out.append((*now, MIDDLE if continued else HEAD, b"".join(held)))
                if rest:
                    out.append((*now, REST, b"".join(rest)))

        def batch() -> pa.RecordBatch:
            file, start, kind, record = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(file), pa.array(start, pa.int64()), pa.array(kind, pa.int64()), pa.array([x.decode() for x in record])], ["file", "start", "kind", "record"])

        for key, text in _texts(batches):
            if key != now:
                close()
                now, state, held, rest = key, states[key], [], []
                continued = state[2] == FEATURES and state[1] >= state[3]  # inside a feature that began before
                inside_feature = continued
            string, depth0, container, level = state
            inside, step = _marks(text)
            outside = inside if string else ~inside
            depth = depth0 + np.cumsum(np.where(outside, step, 0))
            b = np.frombuffer(text, np.uint8)
            below = np.flatnonzero(outside & (step > 0) & (depth == 2)) if level == 3 else np.zeros(0, np.int64)
            kinds = [container, *(_container(text, int(at)) for at in below)]
            starts = np.flatnonzero(outside & (depth == level) & (b == ord("{")))
            starts = starts[np.array(kinds)[np.searchsorted(below, starts)] == FEATURES] if len(starts) else starts
            ends = np.flatnonzero(outside & (depth == level - 1) & (b == ord("}"))) + 1
            at = 0
            while at < len(text):
                if inside_feature:
                    later = np.searchsorted(ends, at, "right")
                    upto = int(ends[later]) if later < len(ends) else len(text)
                    held.append(text[at:upto])
                    if later < len(ends):
                        out.append((*now, TAIL if continued else WHOLE, b"".join(held)))
                        held, continued, inside_feature = [], False, False
                else:
                    later = np.searchsorted(starts, at, "left")
                    inside_feature = later < len(starts)
                    upto = int(starts[later]) if inside_feature else len(text)
                    between = text[at:upto]
                    if between.strip() != b"," or not inside_feature:
                        rest.append(between if between.strip() or not inside_feature else b"!")  # no comma: not JSON
                at = upto
            state = (string ^ bool(inside[-1]), int(depth[-1]), kinds[-1], level)
            if len(out) >= 2000:
                yield batch()
                out.clear()
        close()
        if out:
            yield batch()

    return run


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What remains of documents without their features: kind, system and the text itself; trailing content is refused."""
    for batch in batches:
        out = []
        for file, text, spare in zip(*(batch.column(i).to_pylist() for i in range(3))):
            text = text.rstrip().removesuffix("}") if spare else text
            try:
                doc = json.loads(text.lstrip("﻿"))
            except ValueError as error:
                raise ValueError(f"not GeoJSON: {file}: {error}") from None
            found = doc if isinstance(doc, dict) else {"type": "array"}
            name = found.get("crs") if isinstance(found.get("crs"), dict) else {}
            name = name.get("properties") if isinstance(name.get("properties"), dict) else {}
            kind = found.get("type") if found.get("type") != "FeatureCollection" or isinstance(found.get("features"), list) else None
            out.append((file, kind if isinstance(kind, str) else None, name.get("name") if isinstance(name.get("name"), str) else None, text))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["file", "kind", "crs_name", "rest"])


def split_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Features of large JSON documents by many tasks: ``file, record``, and per file ``file, kind, crs_name, rest``.

    Each file is one document.  ``record`` is an object of the ``features`` array of the root, or of a root that is an
    array; ``rest`` is the document without these.  Only the ranges' summaries (one of a file's split each) and the
    states made from them pass the driver.  A document that doesn't end where its root does fails.
    """
    given = read_ranges(spark, path, "}").withColumn("value", F.col("value").cast("binary"))
    summary = given.select("file", "start", "value").mapInArrow(_summaries, "file string, start long, bytes long, odd boolean, first string, depths string")
    sizes = given.groupBy("file").agg(F.first("size").alias("size"))
    rows = summary.join(sizes, "file").collect()
    states, faults = range_states(rows)
    if faults:
        raise ValueError(f"not GeoJSON: {next(f'{k}: {v}' for k, v in faults.items())}")
    shared = spark.sparkContext.broadcast(states)
    pieces = stored(given.select("file", "start", "value").mapInArrow(_cut(shared), "file string, start long, kind long, record string"), "pieces")
    features = joined(pieces.where(F.col("kind") != REST))
    total = summary_bytes(spark, rows)
    rest = pieces.where(F.col("kind") == REST).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "record"))).alias("parts"))
    rest = rest.select("file", F.array_join(F.transform("parts", lambda p: p["record"]), "").alias("rest")).join(total, "file")
    return features, rest.select("file", "rest", "spare").mapInArrow(_frames, "file string, kind string, crs_name string, rest string")


def summary_bytes(spark: SparkSession, rows: list) -> DataFrame:
    """``file, spare``: whether the last text of a file had no bracket at its end."""
    size, total = {}, {}
    for r in rows:
        size[r["file"]] = r["size"]
        total[r["file"]] = total.get(r["file"], 0) + r["bytes"]
    return spark.createDataFrame([(f, total[f] > size[f]) for f in size], "file string, spare boolean")
