"""Exact substring deduplication behind a count-min sketch of word windows.

First pass: every task counts hashed windows in a count-min sketch; the sketches are merged block by
block.  Counts are never too low, so a window that any row of the sketch has seen once is unique.
Second pass: only windows estimated as repeated are grouped, exactly, by 96 bits of two hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfold.llm.base import whole_text, word_hashes

WINDOW = 13
#: Sketch rows and cells per row (2 ** CELL_BITS); what is broadcast is one bit per cell.
DEPTH, CELL_BITS, BLOCK_BITS = 2, 29, 23
#: Windows that a task gathers before it sends its part of the sketch.
GATHERED = 3_000_000
#: A cell with at least one of so many windows is hot; there are at most DEPTH times so many.
HOT_SHARE = 4096
#: Groups over which the rows of a hot window are dealt.
SALTS = 16
NAMES = ["a", "b", "doc_id", "at"]
_FACTORS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return (text or "").encode().split()


def window_hashes(words: list[bytes], window: int, factor: int = 0, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each window; equal windows have equal hashes."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    one = word_hashes(words, seed)
    out, f = np.zeros(n, np.uint64), np.uint64(_FACTORS[factor])
    for i in range(window):
        out = out * f + one[i : i + n]
    return out ^ (out >> np.uint64(32))


def _cells(hashes: np.ndarray, row: int) -> np.ndarray:
    """The cell of each window in one row of the sketch."""
    mixed = hashes if row == 0 else (hashes ^ np.uint64(0x2545F4914F6CDD1D * row % 2**64)) * np.uint64(0x9FB21C651E98DF25)
    return (mixed >> np.uint64(64 - CELL_BITS)).view(np.int64)


def pack_cells(cells: np.ndarray) -> bytes:
    """Ascending cells of one block in Elias-Fano form: about two bits each, and the low bits of an even gap."""
    low = max(0, BLOCK_BITS - 1 - int(len(cells)).bit_length())
    upper = np.zeros(len(cells) + (1 << (BLOCK_BITS - low)), bool)
    upper[(cells >> low) + np.arange(len(cells))] = True
    lower = (cells[:, None] >> np.arange(low)) & 1 > 0
    return np.array([len(cells), low], "<u4").tobytes() + np.packbits(upper).tobytes() + np.packbits(lower).tobytes()


def unpack_cells(packed: bytes) -> np.ndarray:
    n, low = (int(x) for x in np.frombuffer(packed, "<u4", 2))
    cut = 8 + (n + (1 << (BLOCK_BITS - low)) + 7) // 8
    upper = np.flatnonzero(np.unpackbits(np.frombuffer(packed[8:cut], np.uint8)))[:n] - np.arange(n)
    lower = np.unpackbits(np.frombuffer(packed[cut:], np.uint8), count=n * low).reshape(n, low)
    return (upper << low) + (lower @ (1 << np.arange(low)) if low else 0)


def _partial(gathered: list[np.ndarray], row: int) -> Iterator[tuple]:
    """One task's part of a sketch row: per block the cells seen and their counts."""
    cells = np.sort(_cells(np.concatenate(gathered), row))
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    counts, cells = np.diff(first, append=len(cells)).astype("<u4"), cells[first]
    edges = np.searchsorted(cells, np.arange((1 << (CELL_BITS - BLOCK_BITS)) + 1) << BLOCK_BITS)
    for block, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if b > a:
            yield row, block, pack_cells(cells[a:b] - (block << BLOCK_BITS)), zlib.compress(counts[a:b].tobytes(), 1)


def _count(window: int):
    """Each window of a document counts once: repeats within it are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for row in range(DEPTH if gathered else 0):
                cols = list(zip(*_partial(gathered, row)))
                types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["row", "block", "cells", "counts"])

        for batch in in_parts(batches):
            for text in batch.column(0).to_pylist():
                own = np.unique(window_hashes(words_of(text), window))
                if len(own):
                    gathered.append(own)
                    size += len(own)
                if size > GATHERED:
                    yield from flush()
                    gathered, size = [], 0
        yield from flush()

    return run


def _merge(hot: int):
    """Rows sorted by (row, block): per block one bit for each cell counted twice or more, and the hot cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, np.zeros(1 << BLOCK_BITS, np.uint32)

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None:
                bits = zlib.compress(np.packbits(counts > 1, bitorder="little").tobytes(), 1)
                many = (np.flatnonzero(counts >= hot) + (now[1] << BLOCK_BITS)).tolist()
                arrays = [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([bits], pa.binary()), pa.array([many], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "block", "bits", "hot"])

        for batch in batches:
            for row, block, cells, seen in zip(*[c.to_pylist() for c in batch.columns]):
                if (row, block) != now:
                    yield from done()
                    now = (row, block)
                    counts[:] = 0
                counts[unpack_cells(cells)] += np.frombuffer(zlib.decompress(seen), "<u4")
        yield from done()

    return run


class Repeated:
    """The merged sketch as the second pass needs it: which cells have a count of two or more."""

    def __init__(self, rows: list, window: int):
        self.window = window
        self.bits = {(r["row"], r["block"]): bytes(r["bits"]) for r in rows}
        self.hot = [np.array(sorted(c for r in rows if r["row"] == d for c in r["hot"]), np.int64) for d in range(DEPTH)]
        self._tables: list[np.ndarray] = []

    def tables(self) -> list[np.ndarray]:
        """Unpacked once per worker."""
        if not self._tables:
            size = 1 << BLOCK_BITS
            for row in range(DEPTH):
                table = np.zeros(1 << (CELL_BITS - 3), np.uint8)
                for block in range(1 << (CELL_BITS - BLOCK_BITS)):
                    if (row, block) in self.bits:
                        table[block * size // 8 : (block + 1) * size // 8] = np.frombuffer(zlib.decompress(self.bits[row, block]), np.uint8)
                self._tables.append(table)
            self.bits = {}
        return self._tables

    def candidates(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of windows estimated as repeated, and whether all their cells are hot."""
        at, hot = np.arange(len(hashes)), np.ones(len(hashes), bool)
        for row, table in enumerate(self.tables()):
            cells = _cells(hashes[at], row)
            seen = (table[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 > 0
            at, hot = at[seen], hot[seen] & np.isin(cells[seen], self.hot[row])
        return at, hot


def repeated_sketch(texts: DataFrame, window: int, windows: int) -> Repeated:
    """The merged sketch of ``texts`` (one column).  It has a fixed size: ``DEPTH * 2 ** CELL_BITS`` bits."""
    parts = texts.mapInArrow(_count(window), "row int, block int, cells binary, counts binary")
    sorted_parts = parts.repartition("row", "block").sortWithinPartitions("row", "block")
    hot = max(1000, windows // HOT_SHARE)
    merged = sorted_parts.mapInArrow(_merge(hot), "row int, block int, bits binary, hot array<long>")
    return Repeated(merged.collect(), window)


def _windows(shared):
    """Windows that may be repeated: two hashes, the row's id, and position and text tag in one long.

    Rows of a hot window are dealt over ``SALTS`` groups by their id, folded into the second hash.
    Each task sends its smallest id of a hot window to all of these groups (``at`` null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, least = shared.value, {}
        for batch in in_parts(batches):
            ids, out = batch.column(0), []
            plain = ids.to_pylist()
            for i, (tag, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                words = words_of(text)
                first = window_hashes(words, sketch.window)
                at, hot = sketch.candidates(first)
                if not len(at):
                    continue
                a, b = first[at], window_hashes(words, sketch.window, 1, 1)[at]
                if hot.any():
                    for pair in set(zip(a[hot].tolist(), b[hot].tolist())):
                        least[pair] = min(plain[i], least.get(pair, plain[i]))
                    salt = (plain[i] * _FACTORS[1] % 2**64 >> 40) % SALTS  # by id: copies have one tag
                    b = np.where(hot, b + np.uint64((1 + salt) * _FACTORS[0] % 2**64), b)
                out.append((np.full(len(at), i), a.view(np.int64), (b >> np.uint64(32)).astype(np.uint32).view(np.int32), at + (tag << 32)))
            if out:
                row, a, b, at = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), ids.take(pa.array(row)), pa.array(at)], NAMES)
        if least:
            pairs = np.repeat(np.array(list(least), np.uint64), SALTS, axis=0)
            salt = np.tile(np.arange(1, SALTS + 1, dtype=np.uint64), len(least)) * np.uint64(_FACTORS[0])  # wraps
            a, b = pairs[:, 0].copy().view(np.int64), ((pairs[:, 1] + salt) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            ids = pa.array(np.repeat(np.array(list(least.values()), np.int64), SALTS))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), ids, pa.nulls(len(a), pa.int64())], NAMES)

    return run


def later_windows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, at`` of windows that also start in a row of smaller ``doc_id``.

    ``rows``: ``doc_id`` (long, not null), ``tag`` (31 bits of the text's hash), ``text``.  ``at`` is the position of the
    window's first word, with the tag in the upper half.
    """
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    sketch = repeated_sketch(rows.select("text"), window, total // 6)
    shared = rows.sparkSession.sparkContext.broadcast(sketch)
    maybe = rows.select("doc_id", "tag", "text").mapInArrow(_windows(shared), "a long, b int, doc_id long, at long")
    least = F.min("doc_id").over(Window.partitionBy("a", "b"))
    return maybe.withColumn("least", least).where("doc_id > least and at is not null").select("doc_id", "at")


def packed_text(text: pd.Series) -> pd.Series:
    """Texts deflated: half the bytes on their way to the removal."""
    return pd.Series([zlib.compress(t.encode(), 1) for t in text], dtype=object)


def without(text: pd.Series, starts: pd.Series, window: pd.Series) -> pd.DataFrame:
    """Each deflated text without the words of the windows that start at ``starts``."""
    out = []
    for t, s, w in zip(text, starts, window):
        words = zlib.decompress(t).split()
        if s is None or not len(s):
            out.append((len(words), 0, b" ".join(words).decode()))
            continue
        edge = np.zeros(len(words) + 1, np.int64)
        at = np.unique(np.asarray(s, np.int64))
        edge[at] += 1
        edge[at + w] -= 1
        kept = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
        out.append((len(words), len(words) - len(kept), b" ".join([words[i] for i in kept]).decode()))
    return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])


def drop_repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row of ``docs`` (``doc_id`` integer, ``text``).

    A word goes if it lies in a window of ``window`` words that also starts in a row of smaller
    ``doc_id``; all windows are judged on the texts as given.  ``kept`` joins the other words by one space.
    Rows of equal id don't remove each other's words.  A null id counts as larger than any other; null and blank texts
    have no words.  Other columns are ignored; an empty table gives an empty one.
    """
    text = whole_text(docs)
    last = F.lit(2**63 - 1)
    rows = docs.select(docs["doc_id"].alias("own_id"), F.coalesce(docs["doc_id"].cast("long"), last).alias("doc_id"), F.xxhash64(text).bitwiseAND(F.lit(2**31 - 1)).alias("tag"), text.alias("text"))
    later = later_windows(rows, window)
    tag, place = F.shiftright("at", 32), F.col("at").bitwiseAND(F.lit(2**32 - 1)).cast("int")
    starts = later.groupBy("doc_id", tag.alias("tag")).agg(F.collect_set(place).alias("starts"))  # at most one document's windows
    cut = F.pandas_udf(without, "struct<n_words:long,n_removed:long,kept:string>")
    rows = rows.select("own_id", "doc_id", "tag", F.pandas_udf(packed_text, "binary")("text").alias("text"))
    done = rows.join(starts, ["doc_id", "tag"], "left").select(F.col("own_id").alias("doc_id"), cut("text", "starts", F.lit(window)).alias("r"))
    return done.select("doc_id", "r.n_words", "r.n_removed", "r.kept")
