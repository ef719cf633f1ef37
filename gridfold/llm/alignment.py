"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of linked id pairs.

Texts are encoded in units that begin with a space.  An id pair of a block of documents is one
posting: a compressed bitmap of the documents that hold it linked, and bit planes of how often each
does.  Popcounts of the bitmaps, added up over blocks, give document counts; joined back to the
postings they return each document's scores.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.llm.base import whole_text
from gridfold.session import stored

#: Documents, and characters of text, of a block at most (one longer text is a block of its own).
BLOCK_DOCUMENTS, BLOCK_CHARS = 4096, 8 << 20
#: A bitmap of so many documents or more is stored as bits, a smaller one as places.
DENSE = BLOCK_DOCUMENTS // 16
#: Units, and bytes of them, that a worker remembers.
REMEMBERED, REMEMBERED_BYTES = 700_000, 40 << 20
#: A unit ends where one space stands between two characters that aren't white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than the space itself.
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]


# --- tokenizers ---------------------------------------------------------------------------------------


def _byte_alphabet() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Byte-level BPE from a tokenizer file: ids of ``space + text``, and the bytes of each id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters, vocabulary = _byte_alphabet(), self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def ids(self, spaced: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([spaced], add_special_tokens=False)[0].ids  # no offsets


class Pieces:
    """A piece model that adds the leading space itself and writes unknown characters as bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        self.bytes = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in ids]

    def ids(self, spaced: str) -> list[int]:
        return self.model.encode(spaced[1:], num_threads=1)


def _uneven(text: str) -> bool:
    """Whether white space begins or ends ``text``, or stands beside a space."""
    return text[:1].isspace() or text[-1:].isspace() or "  " in text or any(c in text and (f"{c} " in text or f" {c}" in text) for c in _SPACES)


def units_of(text: str) -> list[str]:
    """``space + text`` cut before each single space between two other characters; every unit begins with a space.

    Neither tokenizer joins anything over such a cut, so a unit's ids don't depend on its neighbours.
    """
    if not text:
        return []
    parts = _CUT.split(text) if _uneven(text) else text.split(" ")
    return [" " + p for p in parts]


class Units:
    """What is known about units: ids and links, computed once per worker and distinct unit.

    ``numbers`` maps a unit to its row in the columns: ``n_a, n_b, n_groups`` (-1 in ``n_a``: the joined
    bytes differ from the unit), links from ``first`` on as numbers in ``pairs`` (of codes ``a << 32 | b``), and the
    groups as text.
    """

    #: Of a unit whose bytes differ: no links, and -1 for its tokens.
    LOST = (np.array([[-1, 0, 0]]), np.zeros(1, np.int64), np.zeros(0, np.int64), [b""])

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.lengths = [np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        # Each id as text before what follows it: another of its group, then the last of it, in a unit or at its end.
        self.names = [[np.array([f"{i}{mark}".encode() for i in range(len(t.bytes))], object) for mark in marks] for t, marks in ((self.a, ",|"), (self.b, (",", ";", "")))]
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.counts = np.zeros((0, 3), np.int64)
        self.first = np.zeros(1, np.int64)
        self.links = np.zeros(0, np.int32)
        self.pairs: dict[int, int] = {}
        self.groups: list[bytes] = []
        self.size = 0

    def learn(self, units: list[str]) -> None:
        """Many even units in one call; uneven ones, and those of a call that doesn't give back the bytes, one by one."""
        uneven = [u for u in units if "▁" in u or (len(u.split()) != 1 or u[1].isspace() or u[-1].isspace()) and _uneven(u[1:])]
        even = [*dict.fromkeys(units)]
        if uneven:
            apart = set(uneven)
            even = [u for u in even if u not in apart]
        groups = [even[i : i + 20_000] for i in range(0, len(even), 20_000)]
        done = [(g, self._aligned(g)) for g in groups]
        alone = uneven + [u for g, found in done if found is None for u in g]
        done = [(g, found) for g, found in done if found] + [([u], self._aligned([u]) or self.LOST) for u in alone]
        counts, sizes, links = [self.counts], [np.diff(self.first)], [self.links]
        for names, (n, size, codes, texts) in done:
            self.numbers.update(zip(names, range(len(self.numbers), len(self.numbers) + len(names))))
            counts.append(n)
            sizes.append(size)
            once, at = np.unique(codes, return_inverse=True)
            links.append(np.array([self.pairs.setdefault(c, len(self.pairs)) for c in once.tolist()], np.int32)[at])
            self.groups += texts
            self.size += sum(map(len, names)) + sum(map(len, texts))
        self.counts, self.links = np.concatenate(counts), np.concatenate(links)
        self.first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def _aligned(self, units: list[str]):
        """Counts, links per unit, links and group texts of units that follow each other; None if bytes or cuts differ."""
        text = "".join(units)
        given = text.encode()
        ids = [np.array(t.ids(text), np.int64) for t in (self.a, self.b)]
        for t, own in zip((self.a, self.b), ids):
            if b"".join(map(t.bytes.__getitem__, own.tolist())) != given:
                return None
        ends = [np.cumsum(size[own]) for size, own in zip(self.lengths, ids)]
        marks = np.zeros(len(given) + 1, np.int8)
        marks[ends[0]] |= 1
        marks[ends[1]] |= 2
        cuts = np.cumsum([len(u.encode()) for u in units])
        if not (marks[cuts] == 3).all():
            return None
        shared, either = np.flatnonzero(marks == 3), np.flatnonzero(marks)
        # Between two neighbouring ends lies one overlap of an A token with a B token.
        starts = np.concatenate([[0], either[:-1]])
        at = [np.searchsorted(e, starts, "right") for e in ends]
        codes = ids[0][at[0]] << 32 | ids[1][at[1]]
        upto = [np.searchsorted(x, cuts, "right") for x in (*ends, shared, either)]
        n = np.stack([np.diff(x, prepend=0) for x in upto[:3]], axis=1)
        # A group's A ids come before its B ids, so a token stands after all of the earlier groups and its own group's A ids.
        inner = [np.searchsorted(shared, e, "left") for e in ends]  # each token's group
        last = [marks[e] == 3 for e in ends]
        upto_group = [np.searchsorted(e, shared, "right") for e in ends]
        place = np.arange(len(ids[0])) + np.concatenate([[0], upto_group[1]])[inner[0]], np.arange(len(ids[1])) + upto_group[0][inner[1]]
        texts = np.empty(len(ids[0]) + len(ids[1]), object)
        more, final = self.names[0]
        texts[place[0]] = np.where(last[0], final[ids[0]], more[ids[0]])
        more, between, end = self.names[1]
        closing = np.zeros(len(marks), bool)
        closing[cuts] = True
        texts[place[1]] = np.where(closing[ends[1]], end[ids[1]], np.where(last[1], between[ids[1]], more[ids[1]]))
        flat, bounds = texts.tolist(), [0, *(upto[0] + upto[1]).tolist()]
        return n, np.diff(upto[3], prepend=0), codes, [b"".join(flat[i:j]) for i, j in zip(bounds, bounds[1:])]

    def rows(self, documents: list[list[str]]) -> list[np.ndarray]:
        """Numbers of each document's units, new ones learnt first."""
        if len(self.numbers) > REMEMBERED or self.size > REMEMBERED_BYTES:
            self.forget()
        get = self.numbers.get
        found = [[*map(get, d)] for d in documents]
        gaps = [[k for k, number in enumerate(own) if number is None] if None in own else [] for own in found]
        new = list(dict.fromkeys(d[k] for d, own in zip(documents, gaps) for k in own))
        if new:
            self.learn(new)
        for d, own, new in zip(documents, found, gaps):
            for k in new:
                own[k] = get(d[k])
        return [np.array(own, np.int64) for own in found]


_UNITS: dict[tuple[str, str], Units] = {}


def remembered(a: str, b: str) -> Units:
    """One per worker process, so that units are remembered over tasks."""
    if (a, b) not in _UNITS:
        _UNITS[a, b] = Units(a, b)
    return _UNITS[a, b]


# --- bitmaps ------------------------------------------------------------------------------------------


def bitmaps(key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Distinct keys, popcounts and compressed bitmaps of ``place`` by ``key`` (sorted by key, then place).

    A bitmap is the little-endian 16-bit places, or from ``DENSE`` places on one bit for each document
    of a block, which has another length than any list of fewer places.
    """
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    n = np.diff(first, append=len(key))
    plain = place.astype("<u2").tobytes()
    dense = np.flatnonzero(n >= DENSE)
    if not len(dense):
        edges = pa.py_buffer(np.concatenate([2 * first, [2 * len(key)]]).astype(np.int32))
        return key[first], n, pa.Array.from_buffers(pa.binary(), len(first), [None, edges, pa.py_buffer(plain)])
    size = np.where(n >= DENSE, BLOCK_DOCUMENTS // 8, 2 * n)
    out, last = [], 0
    for i in dense:
        out.append(plain[2 * last : 2 * first[i]])
        bits = np.zeros(BLOCK_DOCUMENTS, bool)
        last = first[i] + n[i]
        bits[place[first[i] : last]] = True
        out.append(np.packbits(bits).tobytes())
    out.append(plain[2 * last :])
    edges = pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
    return key[first], n, pa.Array.from_buffers(pa.binary(), len(first), [None, edges, pa.py_buffer(b"".join(out))])


def places_of(bitmap: bytes) -> np.ndarray:
    """The places of one bitmap."""
    if len(bitmap) == BLOCK_DOCUMENTS // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8)))
    return np.frombuffer(bitmap, "<u2")


# --- postings -----------------------------------------------------------------------------------------

_DOC = "block long, slot int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_POSTING = "code long, plane int, documents long, links long, bitmap binary"
#: The plane of a pair's document bitmap, kept where it differs from plane 0: some document holds the pair twice or more.
HOLDERS = -1


def _block(units: Units, texts: list[str]) -> tuple[list[tuple], list[tuple]]:
    """Rows of a block's documents, and per plane ``codes, plane, documents, links, bitmaps``.

    Plane k has the documents whose number of links of the pair has bit k.  ``documents`` is the popcount of a
    document bitmap and 0 in other planes; ``links`` is a plane's popcount times its power of two.
    """
    docs, place, unit, times = [], [], [], []
    for i, own in enumerate(units.rows([units_of(t) for t in texts])):
        if not len(own) or (units.counts[own, 0] < 0).any():
            docs.append((0, 0, 0, 0, ""))
            continue
        sha = hashlib.sha256(b";".join(map(units.groups.__getitem__, own.tolist()))).hexdigest()
        docs.append((*units.counts[own].sum(axis=0).tolist(), int((units.first[own + 1] - units.first[own]).sum()), sha))
        once, n = np.unique(own, return_counts=True)
        unit.append(once)
        times.append(n)
        place.append(np.full(len(once), i))
    if not unit:
        return docs, []
    unit, times, place = (np.concatenate(x).astype(np.int32) for x in (unit, times, place))
    size = units.first[unit + 1] - units.first[unit]
    link = np.arange(size.sum()) + np.repeat(units.first[unit] - (np.cumsum(size) - size), size)
    entry = units.links[link].astype(np.int64) * BLOCK_DOCUMENTS + np.repeat(place, size)
    order = np.argsort(entry)
    entry, many = entry[order], np.repeat(times, size)[order]
    del link, order
    first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
    entry, many = entry[first], np.add.reduceat(many, first, dtype=np.int64)  # pairs, their documents and links, in this order
    pair, place = entry // BLOCK_DOCUMENTS, entry % BLOCK_DOCUMENTS
    codes = np.fromiter(units.pairs, np.int64, len(units.pairs))
    plural = np.zeros(len(codes), bool)
    plural[pair[many > 1]] = True
    planes = []
    for plane in range(HOLDERS, int(many.max()).bit_length()):
        here = plural[pair] if plane == HOLDERS else many >> plane & 1 > 0
        if here.any():
            own, n, bits = bitmaps(pair[here], place[here])
            holders = plane == HOLDERS or (plane == 0) & ~plural[own]
            planes.append((codes[own], plane, np.where(holders, n, 0), n << plane if plane >= 0 else 0 * n, bits))
    return docs, planes


def postings(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of documents (``code`` null) and of postings (``slot`` null) by ``block``, in one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, block = remembered(a, b), TaskContext.get().partitionId() << 32
        long, names = pa.int64(), ["doc_id", *[x.split()[0] for x in f"{_DOC}, {_POSTING}".split(", ")]]

        def emit(ids: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
            rows, planes = _block(units, texts)
            n, counts = len(rows), list(zip(*rows))
            given = [pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), *[pa.array(x, long) for x in counts[:4]], pa.array(counts[4], pa.string())]
            blank = [pa.nulls(n, t) for t in (long, pa.int32(), long, long, pa.binary())]
            yield pa.RecordBatch.from_arrays([ids, *given, *blank], names)
            for codes, plane, documents, links, bits in planes:
                n = len(codes)
                blank = [pa.nulls(n, t) for t in (pa.int32(), long, long, long, long, pa.string())]
                given = [pa.array(codes), pa.array(np.full(n, plane, np.int32)), pa.array(documents), pa.array(links), bits]
                yield pa.RecordBatch.from_arrays([pa.nulls(n, ids.type), pa.array(np.full(n, block)), *blank, *given], names)

        ids: list[pa.Array] = []
        texts: list[str] = []
        chars = 0
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                if texts and (len(texts) == BLOCK_DOCUMENTS or chars + len(text) > BLOCK_CHARS):
                    yield from emit(pa.concat_arrays(ids), texts)
                    ids, texts, chars, block = [], [], 0, block + 1
                ids.append(batch.column(0).slice(i, 1))
                texts.append(text)
                chars += len(text)
        if texts:
            yield from emit(pa.concat_arrays(ids), texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text(docs).alias("text")).mapInArrow(run, f"doc_id {kind}, {_DOC}, {_POSTING}")


def pair_counts(table: DataFrame) -> DataFrame:
    """``code, a, b, documents, links, best`` of each id pair in ``table`` (of ``postings``).

    Counts of blocks are added up in each task before the shuffle.  ``best``: no pair of the same A id is in
    more documents; these maxima are broadcast, as a vocabulary bounds them.
    """
    pairs = table.where("code is not null").groupBy("code").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links"))
    pairs = pairs.select("code", F.shiftright("code", 32).alias("a"), F.col("code").bitwiseAND(F.lit(2**32 - 1)).alias("b"), "documents", "links")
    most = pairs.groupBy("a").agg(F.max("documents").alias("most"))
    return pairs.join(F.broadcast(most), "a").select("code", "a", "b", "documents", "links", (F.col("documents") == F.col("most")).alias("best"))


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings with their pair's count, sorted by block: scores of each block's documents."""
    now, best, total = None, np.zeros(BLOCK_DOCUMENTS, np.int64), np.zeros(BLOCK_DOCUMENTS, np.int64)

    def done() -> pa.RecordBatch:
        slot = np.flatnonzero(total)
        arrays = [pa.array(np.full(len(slot), now)), pa.array(slot.astype(np.int32)), pa.array(best[slot]), pa.array(total[slot])]
        return pa.RecordBatch.from_arrays(arrays, ["block", "slot", "n_best", "count_sum"])

    for batch in batches:
        block, plane, count, top = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        bitmap = batch.column(4)
        for own in np.unique(block).tolist():
            if own != now:
                if now is not None:
                    yield done()
                now = own
                best[:] = total[:] = 0
            rows = np.flatnonzero(block == own)
            places = [places_of(x) for x in bitmap.take(pa.array(rows)).to_pylist()]
            at, n = np.concatenate(places).astype(np.int64), [len(p) for p in places]
            np.add.at(total, at, np.repeat(count[rows] << plane[rows], n))
            np.add.at(best, at, np.repeat(top[rows].astype(np.int64) << plane[rows], n))
    if now is not None:
        yield done()


def aligned_documents(docs: DataFrame, a: str, b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``.

    ``a`` is the path of a byte-level tokenizer file, which gets a space and the text, ``b`` that of a piece
    model, which adds the space.  Groups lie between byte offsets where tokens of both end; links are the pairs of
    tokens that overlap.  ``count_sum`` adds up the documents that hold each link's id pair, ``n_best`` counts the links
    whose pair is in as many as any of its A id.  Special tokens' strings are plain text.

    Null and empty texts, and those that either tokenizer doesn't give back byte by byte, have no tokens: zeros
    and ''.  Repeated rows count as documents of their own, null ids too; other columns are ignored; an empty
    table gives an empty one.  Postings are written once to the shared folder.
    """
    table = stored(postings(docs, a, b), "postings")
    pairs = stored(pair_counts(table).select("code", "documents", "best"), "pairs")
    # Pairs grow with the corpus: never broadcast, and a pair of many blocks can be split.
    counted = table.where(f"plane > {HOLDERS}").select("block", "plane", "bitmap", "code").join(pairs.hint("merge"), "code")
    counted = counted.select("block", "plane", "documents", "best", "bitmap").repartition("block").sortWithinPartitions("block")
    scores = counted.mapInArrow(_scored, "block long, slot int, n_best long, count_sum long")
    rows = table.where("slot is not null").join(scores, ["block", "slot"], "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
