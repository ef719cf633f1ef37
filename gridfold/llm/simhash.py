"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Two fingerprints of eight bytes that differ in at most three bits differ in at most three bytes, so
they share at least five bytes by position.  Of the four positions of one half they then share at
least three.  The index therefore has a posting list for each choice of three positions of one half
and each value there (eight lists per fingerprint); within a list the shared positional bytes of a
pair are tallied, pairs below five are dropped, and the rest are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfold.llm.base import by_group, may_be_among, sliced, whole_text
from gridfold.llm.components import components
from gridfold.session import stored

WIDTH, BITS = 3, 3
#: Triples of byte positions within one half.
LISTS = [c for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for c in combinations(half, 3)]
#: Fingerprints of a posting list that one block holds; longer lists are compared block by block.
BLOCK = 512
#: Found links are contracted to a forest when so many have gathered.
GATHERED = 1_000_000


def simhash(text: str | None, width: int = WIDTH) -> int:
    """Signed 64-bit SimHash of one text: ASCII lower case, words between ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    n = max(1, len(words) - width + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    ones = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


@F.arrow_udf(T.LongType())
def simhash_column(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in sliced(texts):
        yield pa.array(map(simhash, part.to_pylist()), pa.int64())


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(up := root[root], root):
            root = up
        live = root[a] != root[b]
        a, b = a[live], b[live]
    return root


def _links(group: np.ndarray, fp: np.ndarray, bits: int) -> np.ndarray:
    """``group`` sorted: for each row the index of the first row of its cluster of linked rows."""
    n = len(fp)
    at, found, gathered, step = np.arange(n), [], 0, 1
    while True:
        at = at[at + step < n]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        x = fp[at] ^ fp[at + step]
        tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        near = at[(tally >= 8 - bits) & (np.bitwise_count(x) <= bits)]
        found.append((near, near + step))
        gathered += len(near)
        if gathered > GATHERED:
            root = _forest(n, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
            found, gathered = [(np.flatnonzero(root != np.arange(n)), root[root != np.arange(n)])], 0
        step += 1
    if not found:
        return at
    return _forest(n, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def _verified(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_group(batches, ["key", "i", "j"]):
            cols = [rows[c].to_numpy() for c in ("key", "i", "j")]
            fp = np.ascontiguousarray(rows["fp"].to_numpy())
            new = np.zeros(len(fp), bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            root = _links(np.cumsum(new), fp.view(np.uint64), bits)
            linked = np.flatnonzero(root != np.arange(len(root))) if len(root) else root
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[root[linked]])], ["a", "b"])

    return run


def linked_fingerprints(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """``fps``: distinct ``fp`` (long).  Edges ``a, b`` that connect the same fingerprints as all
    pairs at ``bits`` (at most 3) or fewer differing bits do; a cluster gives a forest, not all pairs.

    A posting list longer than ``BLOCK`` is dealt over blocks, and each pair of blocks is one group,
    so no task has to hold a long list.
    """
    if not 0 <= bits <= BITS:
        raise ValueError("bits must be 0 to 3")
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys = [F.lit(k).cast("long") * F.lit(1 << 24) + byte[p] * F.lit(1 << 16) + byte[q] * F.lit(1 << 8) + byte[r] for k, (p, q, r) in enumerate(LISTS)]
    index = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    lists = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = index.join(lists, "key").withColumn("own", F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("key", "fp", "own", other).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return dealt.mapInArrow(_verified(bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``doc_id, row_key, fp, root, component_id`` for each row of ``docs`` (``doc_id`` integer, ``text``).

    ``row_key`` is a hash of id and text, ``root`` the smallest fingerprint of the component and
    ``component_id`` the smallest ``doc_id`` reachable over links of ``bits`` or fewer differing bits.
    Null and blank texts have fingerprint zero and are linked like any other.  Rows with a null
    ``doc_id`` take part; ``component_id`` is null only where all ids of the component are null.
    Repeated rows give repeated rows; other columns are ignored; an empty table gives an empty one.
    """
    text = whole_text(docs)
    marked = stored(docs.select(docs["doc_id"], F.xxhash64(docs["doc_id"], text).alias("row_key"), simhash_column(text).alias("fp")), "simhash")
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    tree = components(linked_fingerprints(first.select("fp"), bits))
    placed = stored(first.join(tree, first["fp"] == tree["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "classes")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(placed.select("fp", "root").join(named, "root"), "fp")


def one_of_each(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """``docs`` with one row of each ``root`` of ``marked`` (``doc_id, row_key, root``): the smallest ``doc_id`` (null last).

    Rows of equal id and text are one document and one of them stays.  Rows that a filter of the others' keys tells
    to stay are not shuffled.
    """
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    own = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("row_key").alias("_row")]
    kept = stored(marked.groupBy("root").agg(F.min(order).alias("first")).select("first.doc_id", "first.row_key").select(own), "kept")
    rows = marked.select(own).groupBy("_id", "_row").agg(F.count("*").alias("n"))
    doubted = rows.join(kept.withColumn("stays", F.lit(True)), ["_id", "_row"], "left").where("stays is null or n > 1")
    doubtful = may_be_among(stored(doubted.select("_row"), "doubted"), "_row")
    row_key = F.xxhash64(docs["doc_id"], whole_text(docs))
    keyed = docs.where(doubtful(row_key)).select(F.coalesce(docs["doc_id"], F.lit(0)).alias("_id"), row_key.alias("_row"), F.struct(*docs.columns).alias("doc"))
    once = F.row_number().over(Window.partitionBy("_id", "_row").orderBy(F.xxhash64("doc")))
    checked = keyed.join(kept, ["_id", "_row"], "left_semi").withColumn("_once", once).where("_once = 1").select("doc.*")
    return docs.where(~doubtful(row_key)).union(checked)


def drop_near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each group of near copies: the smallest ``doc_id`` (null last)."""
    return one_of_each(docs, near_duplicates(docs, bits))
