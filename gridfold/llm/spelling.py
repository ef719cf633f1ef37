"""Spelling variants: words one edit apart, found by probing generated edits in Bloom filters.

The vocabulary is put into blocked Bloom filters, one shard or more per word length.  Every word's
edits are hashed without being built and probed in the broadcast shards of their length; only
positives become strings and are shuffled to an exact join with the vocabulary, which removes the
false ones.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.llm.base import whole_text
from gridfold.session import stored

#: Letters that words consist of: A-Z are lower-cased, U+00C0 to U+00FF stay as they are.
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
_RUNS = re.compile("[a-zÀ-ÿ]+")
LEAST_LENGTH, LEAST = 6, 5
#: A form has at least so many times its variant's occurrences.
RATIO = 5
#: Bits of a filter for each of its words (a block of 256 for eight); bytes of filters that one pass broadcasts.
BITS, PASS_BYTES = 32, 64 << 20
#: Blocks of a filter that one task builds at a time (64 KB).
PART_BLOCKS = 2048
#: Distinct words, and characters of text, that a task gathers before it sends their counts.
GATHERED, GATHERED_CHARS = 300_000, 256 << 20
#: Edits that are hashed at a time.
HASHED = 1 << 20
_STEP = 0x9E3779B97F4A7C15
_LANES = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)


# --- vocabulary -----------------------------------------------------------------------------------


def runs_of(doc_id, text: str, dropped: int | None = None) -> Counter:
    """Lower-cased letter runs of a text and how often each occurs.

    Where ``dropped`` divides the CRC-32 of ``<doc_id>:<run>``, the run loses the letter at that
    hash modulo its length; a null id is written as nothing.
    """
    found = Counter(_RUNS.findall(text.encode().lower().decode()))  # of bytes, only A-Z change
    if not dropped:
        return found
    start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    out: Counter = Counter()
    for run, n in found.items():
        h = zlib.crc32(run.encode(), start)
        if h % dropped == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def vocabulary(docs: DataFrame, dropped: int | None = None, length: int = LEAST_LENGTH, least: int = LEAST) -> DataFrame:
    """``word, n``: letter runs of at least ``length`` code points with at least ``least`` occurrences.

    Counts are added up in each task before the shuffle.  Null texts have no words; repeated rows
    count again; other columns of ``docs`` (``doc_id``, ``text``) are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        chars = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                chars += len(text)
                for word, n in runs_of(doc_id.as_py(), text, dropped).items():
                    if len(word) >= length:
                        counts[word] += n
                if len(counts) > GATHERED or chars > GATHERED_CHARS:
                    yield flush()
                    counts, chars = Counter(), 0
        yield flush()

    parts = docs.select("doc_id", whole_text(docs).alias("text")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# --- hashes of words and of their edits -------------------------------------------------------------


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _values(codes: np.ndarray) -> np.ndarray:
    """A 64-bit value of each code point."""
    return mixed((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_STEP))


def _powers(n: int) -> np.ndarray:
    """``_STEP ** (n - 1), ..., _STEP ** 0`` modulo 2 ** 64."""
    out = np.full(n, np.uint64(_STEP))
    out[:1] = 1
    return np.multiply.accumulate(out)[::-1]


def letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row for each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def polynomials(codes: np.ndarray) -> np.ndarray:
    """The hash of each row of code points: its values as digits to the base ``_STEP``."""
    return (_values(codes) * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def replaced(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, positions, new letters and hashes of words with one letter replaced by a larger one.

    ``codes`` are words of one length.  A pair of words that differ in a letter is met once, from the smaller.
    """
    n, length = codes.shape
    power, whole, new = _powers(length), polynomials(codes), _values(alphabet)
    step = max(1, HASHED // (n * len(alphabet)))
    for at in range(0, length, step):
        part = codes[:, at : at + step]
        delta = (new[None, None, :] - _values(part)[:, :, None]) * power[None, at : at + step, None] + whole[:, None, None]
        row, place, letter = np.nonzero(alphabet[None, None, :] > part[:, :, None])
        yield row, place + at, letter, delta[row, place, letter]


def deleted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, positions and hashes of words with one letter deleted, each result once (of equal neighbours the last goes)."""
    n, length = codes.shape
    if length < 2:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    terms = _values(codes) * _powers(length)
    after = terms.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(terms, axis=1, dtype=np.uint64)
    # Letters before the deleted one lose one power of the base: divide by it, as it is odd.
    before = (np.cumsum(terms, axis=1, dtype=np.uint64) - terms) * np.uint64(pow(_STEP, -1, 2**64))
    keep = np.ones((n, length), bool)
    keep[:, :-1] = codes[:, 1:] != codes[:, :-1]
    row, place = np.nonzero(keep)
    return row, place, (before + after)[row, place]


# --- filters ------------------------------------------------------------------------------------------


class Shards:
    """Layout of the filters of one pass: per length its number of parts, the first and last part in this pass, and blocks."""

    def __init__(self, layout: dict[int, tuple[int, int, int, int]]):
        self.layout = layout
        self.first = {}
        total = 0
        for length, (_, low, high, blocks) in sorted(layout.items()):
            self.first[length] = total
            total += (high - low) * blocks
        self.blocks = total

    def places(self, length: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes of words of this length belong to this pass, and their block."""
        parts, low, high, blocks = self.layout[length]
        part = (h & np.uint64(0xFFFF)) * np.uint64(parts) >> np.uint64(16)
        here = np.flatnonzero((part >= low) & (part < high))
        block = (h[here] >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
        return here, ((part[here] - np.uint64(low)) * np.uint64(blocks) + block).astype(np.int64) + self.first[length]


def _bit(h: np.ndarray, lane: int) -> np.ndarray:
    low = (h & np.uint64(0xFFFFFFFF)) * _LANES[lane] & np.uint64(0xFFFFFFFF)
    return np.uint32(1) << (low >> np.uint64(27)).astype(np.uint32)


def plan_passes(sizes: dict[int, int], pass_bytes: int = PASS_BYTES) -> list[Shards]:
    """Shards of all lengths (words by length: ``sizes``), dealt over passes of at most ``pass_bytes`` each.

    A length whose filter is larger is cut into parts by hash.  Neighbouring lengths share a pass where they fit.
    """
    passes, now, free = [], {}, pass_bytes // 32
    for length in sorted(sizes):
        blocks = max(8, -(-sizes[length] * BITS // 256))
        parts = max(1, -(-blocks // (pass_bytes // 32)))
        blocks = -(-blocks // parts)
        for part in range(parts):
            if blocks > free and now:
                passes.append(Shards(now))
                now, free = {}, pass_bytes // 32
            now[length] = (parts, part, part + 1, blocks)
            free -= blocks
            if parts > 1:  # parts of one length in a pass of their own, as a pass knows one range of them
                passes.append(Shards(now))
                now, free = {}, pass_bytes // 32
    return [*passes, Shards(now)] if now else passes


def by_length(words: list[str]) -> Iterator[tuple[int, list[str]]]:
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    yield from groups.items()


def _entries(shards: Shards):
    """Words to their block (as filter part and place in it) and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, words in by_length(batch.column(0).to_pylist()):
                h = mixed(polynomials(letters(words)))
                here, block = shards.places(length, h)
                arrays = [pa.array(block // PART_BLOCKS), pa.array((block % PART_BLOCKS).astype(np.int32)), pa.array(h[here].view(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["part", "block", "h"])

    return run


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by part: the bits of each part."""
    now, bits = None, np.zeros((PART_BLOCKS, 8), np.uint32)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["part", "bits"])

    for batch in batches:
        part, block, h = (c.to_numpy() for c in batch.columns)
        for p in np.unique(part):
            if p != now:
                if now is not None:
                    yield done()
                now = int(p)
                bits[:] = 0
            own = part == p
            for lane in range(8):
                np.bitwise_or.at(bits, (block[own], lane), _bit(h[own].view(np.uint64), lane))
    if now is not None:
        yield done()


class Filters:
    """The filters of one pass: broadcast, at most ``PASS_BYTES``."""

    def __init__(self, shards: Shards, parts: list):
        self.shards = shards
        self.bits = np.zeros((-(-shards.blocks // PART_BLOCKS) * PART_BLOCKS, 8), np.uint32)
        for p in parts:
            self.bits[p["part"] * PART_BLOCKS : (p["part"] + 1) * PART_BLOCKS] = np.frombuffer(bytes(p["bits"]), np.uint32).reshape(-1, 8)

    def positive(self, length: int, polynomial: np.ndarray) -> np.ndarray:
        """Positions of hashes that may be words of this length."""
        if length not in self.shards.layout:
            return np.zeros(0, np.int64)
        h = mixed(polynomial)
        at, block = self.shards.places(length, h)
        h = h[at]
        for lane in range(8):
            seen = self.bits[block, lane] & _bit(h, lane) > 0
            at, block, h = at[seen], block[seen], h[seen]
        return at


def build_filters(words: DataFrame, shards: Shards) -> Filters:
    """Filters of one column of ``words`` whose lengths are in ``shards``; each part is built in one task."""
    entries = words.mapInArrow(_entries(shards), "part long, block int, h long")
    parts = entries.repartition("part").sortWithinPartitions("part").mapInArrow(_build, "part long, bits binary")
    return Filters(shards, parts.collect())  # at most PASS_BYTES, and a part


def _probe(shared, alphabet: str):
    """Words with their occurrences: the edits of each that may be words."""
    order = np.array(sorted(map(ord, alphabet)), np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: Filters = shared.value
        for batch in batches:
            counts = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for length, group in by_length(list(counts)):
                step = max(1, HASHED // (length * len(order)))
                for i in range(0, len(group), step):
                    words, found = group[i : i + step], []
                    codes = letters(words)
                    if length in filters.shards.layout:
                        for row, place, letter, h in replaced(codes, order):
                            hit = filters.positive(length, h)
                            for r, p, c in zip(row[hit], place[hit], order[letter[hit]]):
                                found.append((words[r], words[r][:p] + chr(c) + words[r][p + 1 :]))
                    if length - 1 in filters.shards.layout:
                        row, place, h = deleted(codes)
                        hit = filters.positive(length - 1, h)
                        found += [(words[r], words[r][:p] + words[r][p + 1 :]) for r, p in zip(row[hit], place[hit])]
                    if found:
                        word, near = zip(*found)
                        arrays = [pa.array(word, pa.string()), pa.array([counts[w] for w in word], pa.int64()), pa.array(near, pa.string())]
                        yield pa.RecordBatch.from_arrays(arrays, ["word", "n", "near"])

    return run


def near_pairs(words: DataFrame, alphabet: str = ALPHABET, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``word, n, near, near_n``: each pair of words one insertion, deletion or replacement apart, once.

    ``words``: distinct ``word`` over ``alphabet``, and ``n``.  The filters of one pass hold at most
    ``pass_bytes``; a larger vocabulary takes more passes, and a word is probed only in those of its
    length.  A word has at most ``2 * length + 1`` times the alphabet's near words, so no join key is hot.
    """
    size = F.char_length("word")
    sizes = {r["size"]: r["count"] for r in words.groupBy(size.alias("size")).count().collect()}
    spark, parts = words.sparkSession, []
    for shards in plan_passes(sizes, pass_bytes):
        here = sorted(shards.layout)
        filters = build_filters(words.where(size.isin(here)).select("word"), shards)
        probing = words.where(size.isin(sorted({*here, *(x + 1 for x in here)}))).select("word", "n")
        shared = spark.sparkContext.broadcast(filters)
        parts.append(probing.repartition("word").mapInArrow(_probe(shared, alphabet), "word string, n long, near string"))
    if not parts:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    maybe = reduce(DataFrame.union, parts)
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return maybe.join(known, "near").select("word", "n", "near", "near_n")


# --- forms and roots ------------------------------------------------------------------------------------


def spelling_variants(words: DataFrame, ratio: int = RATIO, alphabet: str = ALPHABET, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every row of ``words`` (distinct ``word``, ``n``).

    ``form`` is the near word of largest ``n`` (ties: the smallest in code-point order) if that is at
    least ``ratio`` times the word's own; ``root`` is where following forms ends, the word itself if it has
    none.  Occurrences grow by ``ratio`` with each form, so a chain has at most their logarithm of
    steps and doubling its reach takes the logarithm of that in rounds.  No word gives an empty table.
    """
    words = stored(words.select("word", "n"), "words")
    once = near_pairs(words, alphabet, pass_bytes)
    ends = F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    pairs = once.select(ends.alias("p")).select("p.*")
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    found = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    named = words.join(found, "word", "left").withColumn("best", F.when(F.col("best.near_n") >= ratio * F.col("n"), F.col("best")))
    named = stored(named.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("form"), F.col("best.near_n").alias("form_n")), "forms")
    least, most = words.agg(F.min("n"), F.max("n")).first()
    roots = named.where("form is not null").select("word", F.col("form").alias("root"))
    reach = 1
    while least and least * ratio**reach < most:  # a chain of more steps would need more occurrences
        later = roots.select(F.col("word").alias("root"), F.col("root").alias("later"))
        roots = stored(roots.join(later, "root", "left").select("word", F.coalesce("later", "root").alias("root")), "roots")
        reach *= 2
    done = named.join(roots, "word", "left")
    return done.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
