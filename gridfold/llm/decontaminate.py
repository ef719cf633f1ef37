"""Benchmark decontamination by spaced-seed hashing.

Each fixed mask names the token positions that count; the others may differ.  Hashes of the masked
tokens of benchmark texts are sorted and broadcast, those of every document position are looked up,
and around each hit the two texts are compared token by token on the hit's diagonal.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.llm.base import whole_text, word_hashes

#: Fixed masks of six counted positions each.
MASKS = ("11101101", "1100110101", "101011011", "1110010011")
#: A text of fewer tokens fits no mask; it is found where all its tokens stand in a row.
SHORTEST = min(map(len, MASKS))
#: A match has this many tokens at least (or the whole benchmark text), and this share of them is equal.
LEAST, SIMILARITY = 13, 0.8
#: Benchmark texts of one broadcast index; more are searched block by block.
ITEMS_PER_BLOCK = 50_000
_SPACES = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_STEP = 0x9E3779B97F4A7C15
LEAK = "array<struct<item_id:{kind},start:int,stop:int,item_start:int,matched:int>>"


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the lower-case tokens of a whole text; ASCII marks and white space separate them."""
    return word_hashes((text or "").lower().encode().translate(_SPACES).split())


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """One hash per position at which ``mask`` fits."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, factor = np.full(n, len(mask), np.uint64), 1
    for i, counts in enumerate(mask):
        if counts == "1":
            factor = factor * _STEP % 2**64 | 1
            out += hashes[i : i + n] * np.uint64(factor)
    return out ^ (out >> np.uint64(29))


def sequences(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash per position for the ``size`` tokens from there on."""
    return seeds(hashes, "1" * size)


@dataclass
class SeedIndex:
    """Sorted seed hashes of benchmark texts with the text and position of each."""

    ids: list
    items: list[np.ndarray]
    hashes: list[np.ndarray]
    owner: list[np.ndarray]
    place: list[np.ndarray]
    bits: list[np.ndarray]
    #: Texts too short for any mask: by their number of tokens, the hash of all tokens and the texts that have it.
    short: dict[int, dict[int, list[int]]]

    @classmethod
    def of(cls, rows: list[tuple]) -> SeedIndex:
        items = [tokens(t) for _, t in rows]
        index = cls([i for i, _ in rows], items, [], [], [], [], {})
        for n, item in enumerate(items):
            if 0 < len(item) < SHORTEST:
                index.short.setdefault(len(item), {}).setdefault(int(sequences(item, len(item))[0]), []).append(n)
        for mask in MASKS:
            found = [seeds(t, mask) for t in items]
            hashes = np.concatenate([*found, np.zeros(0, np.uint64)])
            owner = np.repeat(np.arange(len(items)), [len(f) for f in found])
            place = np.concatenate([*[np.arange(len(f)) for f in found], np.zeros(0, np.int64)]).astype(np.int64)
            order = np.argsort(hashes, kind="stable")
            bits = np.zeros(1 << 22, bool)
            bits[hashes & np.uint64(len(bits) - 1)] = True
            for name, value in (("hashes", hashes[order]), ("owner", owner[order]), ("place", place[order]), ("bits", bits)):
                getattr(index, name).append(value)
        return index

    def hits(self, words: np.ndarray) -> set[tuple[int, int]]:
        """``(item number, document position of the item's first token)`` of all seed hits."""
        out: set[tuple[int, int]] = set()
        for mask, hashes, owner, place, bits in zip(MASKS, self.hashes, self.owner, self.place, self.bits):
            own = seeds(words, mask)
            at = np.flatnonzero(bits[own & np.uint64(len(bits) - 1)])
            if not len(at) or not len(hashes):
                continue
            low, high = np.searchsorted(hashes, own[at]), np.searchsorted(hashes, own[at], "right")
            for p, a, b in zip(at[high > low], low[high > low], high[high > low]):
                out.update((int(o), int(p - q)) for o, q in zip(owner[a:b], place[a:b]))
        for size, whole in self.short.items():
            own = sequences(words, size)
            known = np.flatnonzero(np.isin(own, np.fromiter(whole, np.uint64, len(whole))))
            out.update((n, int(p)) for p in known for n in whole[int(own[p])])
        return out

    def leaks(self, text: str | None) -> list[tuple]:
        words = tokens(text)
        found = []
        for item, shift in sorted(self.hits(words)):
            for start, stop, matched in segments(words, self.items[item], shift):
                found.append((self.ids[item], start, stop, start - shift, matched))
        return found


def segments(words: np.ndarray, item: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """Runs of one diagonal that are long and alike enough: ``(start, stop, equal tokens)`` in the document.

    The longest run comes first, then the longest ones beside it, so all are disjoint.  Differing tokens at the
    ends of a run are left out as far as it stays long enough.
    """
    low, high = max(0, shift), min(len(words), shift + len(item))
    same = words[low:high] == item[low - shift : high - shift]
    least, share = min(LEAST, len(item)), round(SIMILARITY * 100) if len(item) >= SHORTEST else 100
    # A run is alike enough if its total is not below zero: the sum at its stop is at least that at its start.
    total = np.concatenate([[0], np.cumsum(np.where(same, 100 - share, -share))])
    found, todo = [], [(0, len(same))]
    while todo:
        a, b = todo.pop()
        if b - a < least:
            continue
        own = total[a : b + 1]
        first = np.searchsorted(-np.minimum.accumulate(own), -own)
        length = np.arange(len(own)) - first
        if length.max() < least:
            continue
        ends = np.flatnonzero(length == length.max())
        end = ends[np.argmax(own[ends] - own[first[ends]])]
        start, stop = a + int(first[end]), a + int(end)
        while stop - start > least and not same[stop - 1]:
            stop -= 1
        while stop - start > least and not same[start]:
            start += 1
        found.append((low + start, low + stop, int(same[start:stop].sum())))
        todo += [(a, start), (stop, b)]
    return sorted(found)


def leaks(docs: DataFrame, benchmark: DataFrame, column: str = "leaks") -> DataFrame:
    """``docs`` with ``column``: for each benchmark text found in the row's whole text its ``item_id``, the
    tokens covered (``start``, ``stop``, and ``item_start`` in the benchmark text) and how many are equal.

    ``benchmark``: ``item_id, text``; equal texts are searched once, by the smallest id, null texts and texts
    without tokens not at all.  A text of fewer than ``SHORTEST`` tokens, too short for a mask, is looked up by
    the hash of all its tokens and found wherever they stand in a row.  The index of a block of ``ITEMS_PER_BLOCK`` texts is broadcast;
    further blocks are searched one after the other, so nothing larger is ever sent.  Null and empty
    documents have no leaks; repeated rows are judged alike.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()
    known = benchmark.where("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    n = known.count()
    blocks = max(1, -(-n // ITEMS_PER_BLOCK))
    known = known.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    sc = docs.sparkSession.sparkContext
    parts: list[Column] = []
    for block in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in known.where(F.col("block") == block).orderBy("item_id").collect()]
        shared = sc.broadcast(rows)
        built: list[SeedIndex] = []

        @F.pandas_udf(LEAK.format(kind=kind))
        def search(text: pd.Series) -> pd.Series:
            if not built:
                built.append(SeedIndex.of(shared.value))
            names = ("item_id", "start", "stop", "item_start", "matched")
            return pd.Series([[dict(zip(names, f)) for f in built[0].leaks(t)] for t in text], dtype=object)

        parts.append(search(whole_text(docs)))
    return docs.withColumn(column, F.concat(*parts))


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without leaks, with their columns."""
    return leaks(docs, benchmark, "_leaks").where(F.size("_leaks") == 0).drop("_leaks")
