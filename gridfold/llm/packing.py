"""Packing documents into training sequences, shortest pack first over the histogram of lengths.

Tokenizing cuts each document into pieces of the full sequence length and one shorter rest.  The
histogram of piece lengths (as many entries as a sequence has tokens) is packed on its own: lengths
go longest first into the emptiest packs, and only counts of equal packs are kept.  Each placement
covers a range of ranks of one length, so pieces find their sequence by their rank among equals.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfold.llm.base import sliced, whole_text
from gridfold.session import stored

END = 1
SIZE = 2048
#: Rows of one length that are ranked together; a longer list is salted.
RANKED = 200_000
#: Words that a task remembers; as many more are kept from before until they are used again or replaced.
REMEMBERED = 500_000
#: Texts that go to the tokenizer as they are: special tokens, separators at which Python alone splits.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
_WIDE = re.compile("[^\x00-\xff]")
#: The tokenizer file's word pattern, for lower-case text of the first 256 characters.
_PARTS = re.compile(r"[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|'s|'t|'re|'ve|'m|'ll|'d|[^\sa-z0-9\xaa\xb5\xba\xdf-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+")


class WordEncoder:
    """Ids of whole texts from remembered words, as little-endian 32-bit words.

    The tokenizer never joins ids over white space, and in Latin text never over the parts of its word
    pattern, so a part's ids don't depend on its neighbours.  Anything else goes to the tokenizer as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For parts that are cut and in lower case already, with one space between them.
        self.cut = Tokenizer.from_file(path)
        self.cut.normalizer = normalizers.Sequence([])
        self.cut.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.known: dict[str, bytes]
        self.older: dict[str, bytes]
        self.forget()

    def forget(self) -> None:
        """Give the memory of words back."""
        self.known, self.older = {}, {}

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, parts: list[str]) -> None:
        """Many parts in one call: each ends at an id that ends a word."""
        for i in range(0, len(parts), 1000):
            some = parts[i : i + 1000]
            ids = np.array(self.cut.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")  # no offsets
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                cut = ids.tobytes()
                self.known.update(zip(some, (cut[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends))))
            else:
                self.known.update((p, self.plain(p)) for p in some)

    def _parts(self, text: str) -> list[str] | None:
        if any(odd in text for odd in _ODD):
            return None
        if not text.isascii() and _WIDE.search(text):
            return [p for w in text.split() for p in ([w] if _WIDE.search(w) else _PARTS.findall(w.lower()))]
        parts: list[str] = []
        for w in text.lower().split():
            if w.isalpha():
                parts.append(w)
            elif w[:-1].isalpha():
                parts += (w[:-1], w[-1])
            else:
                parts += _PARTS.findall(w)
        return parts

    def _remember(self, parts: set[str]) -> None:
        """Parts that aren't known, from those known before or learnt."""
        again = [p for p in parts if p in self.older]
        self.known.update((p, self.older[p]) for p in again)
        parts.difference_update(again)
        wide = [p for p in parts if not p.isascii() and _WIDE.search(p)]
        self._learn([*parts.difference(wide)])
        self.known.update((p, self.plain(p)) for p in wide)

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 128):
            cut = [self._parts(t) for t in texts[i : i + 128]]
            if len(self.known) > REMEMBERED:  # before a group of texts, which may add its own words
                self.known, self.older = {}, self.known
            get = self.known.get
            found = [None if parts is None else [*map(get, parts)] for parts in cut]
            gaps = [[k for k, ids in enumerate(own) if ids is None] if own and None in own else [] for own in found]
            missing = {parts[k] for parts, own in zip(cut, gaps) for k in own}
            if missing:
                self._remember(missing)
            for parts, own, new in zip(cut, found, gaps):
                for k in new:
                    own[k] = get(parts[k])
            out += [self.plain(t) if own is None else b"".join(own) for t, own in zip(texts[i : i + 128], found)]
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker process; its words are remembered until ``forget``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """``doc_id, start, length, doc_tokens`` (long) and ``ids`` (binary, little-endian unsigned 32-bit).

    A document's ids are those of its whole text and then ``end``; null and blank texts have ``end``
    alone.  Every ``size`` ids are cut.  ``tokenizer`` is the path of a tokenizer file on the workers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        tail = np.array([end], "<u4").tobytes()
        try:
            for part in sliced(batches, 1024):
                keys, cuts = part.column(0), []
                for row, ids in enumerate(encode(part.column(1).to_pylist())):
                    ids += tail
                    cuts += [(row, p // 4, len(ids) // 4, ids[p : p + 4 * size]) for p in range(0, len(ids), 4 * size)]
                row, start, total, ids = zip(*cuts)
                long = pa.int64()
                length = pa.array([len(x) // 4 for x in ids], long)
                arrays = [keys.take(pa.array(row)), pa.array(start, long), length, pa.array(total, long), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "doc_tokens", "ids"])
        finally:  # the worker goes on with tasks of other steps, which need the memory
            encode.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, ids binary"
    return docs.select("doc_id", whole_text(docs).alias("text")).mapInArrow(run, schema)


def pack_histogram(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Shortest pack first: placements ``(length, first rank, ranks, first sequence, offset)``.

    Packs of one pattern have neighbouring numbers and are one heap entry with their count.  Lengths
    go longest first to the emptiest packs; if even those have no room, new packs are begun.
    """
    heap: list[tuple[int, int, int]] = []
    placed, sequences = [], 0
    for length in sorted(counts, reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"length {length} is not in 1..{size}")
        rank, left = 0, counts[length]

        def put(fill: int, first: int, packs: int, copies: int = 1) -> int:
            placed.extend((length, rank + i * packs, packs, first, fill + i * length) for i in range(copies))
            if fill + copies * length < size:
                heapq.heappush(heap, (fill + copies * length, first, packs))
            return packs * copies

        while left:
            if heap and heap[0][0] + length <= size:
                fill, first, packs = heapq.heappop(heap)
                if left < packs:
                    heapq.heappush(heap, (fill, first + left, packs - left))
                done = put(fill, first, min(left, packs))
            else:
                # A pack just begun is the emptiest until it is full, so new packs take as many equal pieces as they can.
                copies = size // length
                packs, copies = (left // copies, copies) if left >= copies else (1, left)
                done = put(0, sequences, packs, copies)
                sequences += packs
            rank, left = rank + done, left - done
    return placed


def pack(pieces: DataFrame, size: int = SIZE, order: list[str] | None = None) -> DataFrame:
    """``pieces`` (``length`` long, 1 to ``size``) with ``sequence_id`` and ``offset``.

    The histogram is at most ``size`` rows and all that the driver sees.  Ranks among pieces of one
    length are dealt over salts (``RANKED`` rows each) and joined with the salts' first ranks, so a
    length that most pieces have is no hot group.  ``order`` names the columns that tell pieces
    apart (all by default); equal rows may take each other's place.  ``pieces`` is read twice:
    store it first if it is costly.  An empty table gives an empty table.
    """
    order = order or [c for c in pieces.columns if c != "length"]
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    spark = pieces.sparkSession
    salts = [max(1, -(-counts.get(n, 0) // RANKED)) for n in range(size + 1)]
    salt = F.pmod(F.xxhash64(*order), F.element_at(F.array(*[F.lit(s) for s in salts]), (F.col("length") + 1).cast("int"))).cast("int")
    dealt = pieces.withColumn("_salt", salt)
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    firsts = pieces.groupBy("length", salt.alias("_salt")).agg(F.count("*").alias("_n"))
    firsts = firsts.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_rank", within).join(firsts, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    places = spark.createDataFrame(pack_histogram(counts, size), "length long, _from long, _n long, _first long, offset long")
    # Placements depend on the histogram's shape alone (its at most ``size`` entries), not on the number of pieces.
    found = (ranked["length"] == places["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_n"))
    sequence: Column = F.col("_first") + F.col("_rank") - F.col("_from")
    kept = [ranked[c] for c in pieces.columns]
    return ranked.join(F.broadcast(places), found).select(*kept, sequence.alias("sequence_id"), "offset")


def packed_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """Pieces of all documents with their place: ``doc_id, start, length, doc_tokens, ids_crc32,
    sequence_id, offset``.

    Pieces without ids are written once to the shared folder.  Null ids, repeated rows and texts of
    any length are packed like others; other columns of ``docs`` are ignored.
    """
    pieces = token_pieces(docs, tokenizer, size, end).select("doc_id", "start", "length", "doc_tokens", F.crc32("ids").alias("ids_crc32"))
    return pack(stored(pieces, "pieces"), size, ["doc_id", "start", "doc_tokens", "ids_crc32"])


def sequences(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """The packed training sequences themselves: ``sequence_id``, ``ids`` (array of int) and ``doc_ids`` by piece."""
    placed = pack(stored(token_pieces(docs, tokenizer, size, end), "pieces"), size, ["doc_id", "start", "doc_tokens", "ids"])
    part = F.struct("offset", "doc_id", "ids")
    whole = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))  # at most ``size`` pieces

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p), "<u4").astype(np.int32) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["sequence_id", "doc_ids", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    flat = whole.select("sequence_id", F.col("parts.doc_id").alias("doc_ids"), F.col("parts.ids").alias("ids"))
    return flat.mapInArrow(unpack, f"sequence_id long, doc_ids array<{kind}>, ids array<int>")
