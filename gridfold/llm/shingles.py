"""Near copies: SimHash groups and MinHash bands name the candidates, whole five-word shingle sets decide.

Texts that ``simhash.near_duplicates`` puts into one component meet in one bucket, and so do texts that agree in all
hashes of a band, which reaches pairs whose fingerprints differ in more bits.  Buckets with the same members are
compared once, and buckets that hang together as one where that is not more work.  Within a bucket the exact Jaccard similarity of the shingle sets is taken, and links of
``SIMILARITY`` or more leave it as a forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfold.llm.base import by_group, may_be_among, sliced, whole_text
from gridfold.llm.components import components
from gridfold.llm.simhash import near_duplicates, one_of_each
from gridfold.session import stored

WIDTH, SIMILARITY = 5, 0.8
#: At similarity s a pair misses all bands with probability (1 - s^ROWS)^BANDS: 3 in a million at 0.8.
BANDS, ROWS = 32, 5
#: Texts of a bucket that one block holds; larger buckets are compared block by block.
BLOCK = 512
#: Shingles hashed at a time.
CHUNK = 4096
_RANDOM = np.random.Generator(np.random.PCG64(5))
_FACTORS, _TERMS = (_RANDOM.integers(0, 2**64, BANDS * ROWS, np.uint64)[:, None] for _ in range(2))
_FACTORS |= np.uint64(1)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the shingles of one text: ASCII lower case, words between ASCII white space.

    A text of at most ``width`` words is one shingle, also without any word.
    """
    words = (text or "").encode().lower().split()
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    n = max(1, len(words) - width + 1)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n))


def bands(text: str | None) -> list[int]:
    """One signed key per band."""
    own = shingle_set(text)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(own), CHUNK):
        mixed = own[None, i : i + CHUNK] * _FACTORS
        mixed ^= mixed >> np.uint64(32)
        np.minimum(least, (mixed * _FACTORS + _TERMS).min(axis=1), out=least)
    keys = np.fromiter((xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))), np.uint64, BANDS)
    return keys.view(np.int64).tolist()


@F.arrow_udf(T.ArrayType(T.LongType()))
def bands_column(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in sliced(texts):
        yield pa.array(map(bands, part.to_pylist()), pa.list_(pa.int64()))


@F.arrow_udf(T.BinaryType())
def sets_column(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in sliced(texts):
        yield pa.array([shingle_set(t).tobytes() for t in part.to_pylist()], pa.binary())


def linked_rows(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For each set the index of the first one that it reaches over pairs of at least ``similarity``."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    known, number = np.unique(np.concatenate(sets), return_inverse=True)
    held, root = np.zeros(len(known), np.int64), np.arange(n)
    for i in range(n - 1):
        if (root[i + 1 :] == root[i]).all():
            continue
        own = number[starts[i] : starts[i + 1]]
        held[own] = 1
        shared = np.add.reduceat(held[number[starts[i + 1] :]], starts[i + 1 : -1] - starts[i + 1])
        held[own] = 0
        near = shared >= similarity * (sizes[i] + sizes[i + 1 :] - shared) - 1e-9
        met = np.unique(np.append(root[i + 1 :][near], root[i]))
        if len(met) > 1:
            root[np.isin(root, met)] = met[0]
    return root


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in by_group(sliced(batches), ["key", "i", "j"]):
        cols = [rows[c].to_numpy() for c in ("key", "i", "j")]
        node, sets = rows["node"].to_numpy(), rows["shingles"]
        new = np.zeros(len(node), bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), len(node)]
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                root = linked_rows([np.frombuffer(s.as_py(), np.uint64) for s in sets.slice(a, b - a)])
                linked = np.flatnonzero(root != np.arange(b - a))
                if len(linked):
                    yield pa.RecordBatch.from_arrays([pa.array(node[a:b][linked]), pa.array(node[a:b][root[linked]])], ["a", "b"])


def _blocks(n: str) -> Column:
    return F.ceil(F.col(n) / BLOCK).cast("int").alias("blocks")


def _places(members: DataFrame) -> DataFrame:
    """``row_key, node, places``: the buckets (``key, blocks``) that each text of ``members`` is compared in.

    ``members`` has a row for each text of a bucket (``key, row_key, node, n, least, blocks``).  Buckets that hang together
    by common texts become one, so that a text is sent once, if they have up to ``BLOCK`` texts in all, or more but
    neither more copies of texts nor more pairs to compare than the single buckets.
    """
    tree = components(members.select(F.col("node").alias("a"), F.col("least").alias("b")))
    held = stored(members.join(tree, "node", "left").withColumn("whole", F.coalesce("root", "node")).drop("root"), "held")
    texts = held.groupBy("whole", "row_key", "node").agg(F.sum("blocks").alias("copies"), F.sum("n").alias("pairs"))
    sizes = texts.groupBy("whole").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"), F.sum("pairs").alias("pairs"))
    sizes = sizes.select("whole", "n", "copies", "pairs", _blocks("n")).where((F.col("n") <= BLOCK) | (F.expr("n * blocks <= copies") & F.expr("n * n <= pairs")))
    sizes = stored(sizes.select("whole", "blocks"), "wholes")
    single = held.join(sizes, "whole", "left_anti").select("row_key", "node", "key", "blocks")
    places = texts.select("whole", "row_key", "node").join(sizes, "whole").select("row_key", "node", F.col("whole").alias("key"), "blocks").union(single)
    return places.groupBy("row_key", "node").agg(F.collect_list(F.struct("key", "blocks")).alias("places"))


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, root`` for each row of ``docs`` (``doc_id`` integer, ``text``).

    ``row_key`` is a hash of id and text.  Rows have one ``root`` if they are linked, directly or through others, by
    pairs whose five-word similarity is ``SIMILARITY`` or more.  Null and blank texts are equal.  Candidates are
    texts of one SimHash component or of one band.
    """
    text = whole_text(docs)
    row_key = F.xxhash64(docs["doc_id"], text)
    marked = stored(docs.select(docs["doc_id"], row_key.alias("row_key"), F.xxhash64(text).alias("node"), bands_column(text).alias("bands")), "bands")
    once = marked.groupBy("node").agg(F.min_by("bands", "row_key").alias("bands"), F.min("row_key").alias("row_key"))
    # A component's bucket has the component's smallest fingerprint as its key; if that is a band's too, more pairs are compared.
    similar = near_duplicates(docs).select("row_key", F.xxhash64("root").alias("key")).distinct()
    keys = once.select("node", "row_key", F.explode("bands").alias("key")).union(once.join(similar, "row_key").select("node", "row_key", "key"))
    index = stored(keys, "buckets")
    met = stored(index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "met")
    found = stored(index.where(may_be_among(met, "key")(F.col("key"))).join(met, "key"), "found")
    buckets = found.groupBy("key").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(node))").alias("sign"), F.min("node").alias("least"))
    buckets = buckets.groupBy("n", "sign", "least").agg(F.min("key").alias("key")).select("key", "n", "least", _blocks("n"))
    asked = stored(_places(stored(found.join(buckets, "key"), "members")), "places")
    texts = docs.select(row_key.alias("row_key"), text.alias("text")).where(may_be_among(asked, "row_key")(F.col("row_key")))
    # Joined and freed of repeated rows by one shuffle; a set is made once and only then copied to its places.
    sets = texts.join(asked, "row_key").dropDuplicates(["row_key", "node"]).select("node", "places", sets_column(F.col("text")).alias("shingles"))
    dealt = sets.select("node", "shingles", F.inline("places")).withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("key", "node", "shingles", "own", other)
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "shingles").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    tree = components(dealt.mapInArrow(_verified, "a long, b long").distinct())
    return marked.select("doc_id", "row_key", "node").join(tree, "node", "left").select("doc_id", "row_key", F.coalesce("root", "node").alias("root"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of ``near_copies``: the smallest ``doc_id`` (null last)."""
    return one_of_each(docs, near_copies(docs))
