"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

Labelled rows are a bounded sample.  Their term counts, weighted by inverse document frequency, are
projected onto the leading singular vectors; these vectors and the sample's positions are broadcast,
every document is projected alike, its cosines to the whole sample are computed block by block, and
the labels of the nearest vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.llm.base import whole_text

#: Labelled rows that the space is fitted on and that vote, at most.
SAMPLE = 4096
RANK, NEIGHBOURS = 48, 9
#: A neighbour votes with this power of its cosine, so that a few alike outweigh many that are less so.
SHARPNESS = 8
#: Documents whose cosines are computed at once.
BLOCK = 256
LETTERS = 2048
#: Byte classes: lower, upper, digit, space, line end, each common mark on its own, other marks, non-ASCII.
_MARKS = b".,!?#&%*$|-_:;@/\\<>[](){}\"'="
CLASSES = 6 + len(_MARKS) + 1


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES - 1, np.uint32)
    for first, last, number in ((97, 122, 0), (65, 90, 1), (48, 57, 2), (32, 32, 3), (10, 13, 4), (128, 255, 5)):
        table[first : last + 1] = number
    for i, mark in enumerate(_MARKS):
        table[mark] = 6 + i
    return table


_TABLE = _class_table()
SHAPES = CLASSES * CLASSES
STATS = 24
TERMS = LETTERS + SHAPES + STATS


def _share_terms(shares: list[float]) -> np.ndarray:
    """Each share (0 to 1) as weights of the nearer of six levels, so that equal shares are common terms."""
    levels = np.linspace(0, 1, STATS // 4)
    return np.concatenate([np.maximum(0, 1 - np.abs(levels - s) * (len(levels) - 1)) for s in shares])


def terms(text: str | None) -> np.ndarray:
    """Term weights of one whole text: hashed letter triples, pairs of byte classes, shares of repeated
    words and lines, capitals and marks."""
    raw = (text or "").encode()
    out = np.zeros(TERMS, np.float32)
    if not raw:
        return out
    b = np.frombuffer(raw, np.uint8)
    shape = _TABLE[b]
    if len(b) > 2:
        low = (b | (shape == 1).astype(np.uint8) * 32).astype(np.uint32)
        triple = (low[:-2] * np.uint32(40503) ^ low[1:-1] * np.uint32(2654435) ^ low[2:] * np.uint32(97)) % LETTERS
        out[:LETTERS] = np.log1p(np.bincount(triple, minlength=LETTERS))
    pairs = shape[:-1] * np.uint32(CLASSES) + shape[1:]
    out[LETTERS : LETTERS + SHAPES] = np.log1p(np.bincount(pairs, minlength=SHAPES))
    words, lines = raw.split(), raw.splitlines()
    share = lambda parts: 1 - len(set(parts)) / len(parts) if parts else 0.0
    marks = float((shape >= 6).mean())
    capitals = float((shape == 1).sum() / max(1, (shape <= 1).sum()))
    norm = float(np.linalg.norm(out)) or 1.0
    out[LETTERS + SHAPES :] = _share_terms([share(words), share(lines), min(1.0, 2 * marks), capitals])
    out[: LETTERS + SHAPES] /= norm
    out[LETTERS + SHAPES :] *= 0.5
    return out


@dataclass
class LatentSpace:
    """``weights`` by term, ``axes`` (terms x rank), ``positions`` of the sample (unit rows), ``labels``, ``prior``."""

    weights: np.ndarray
    axes: np.ndarray
    positions: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, rows: np.ndarray) -> np.ndarray:
        return self.placed(rows * self.weights)

    def placed(self, weighted: np.ndarray) -> np.ndarray:
        at = weighted @ self.axes
        return at / np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-12)

    def scores(self, rows: np.ndarray, neighbours: int) -> np.ndarray:
        """Weighted votes of the nearest; rows at the origin and an empty sample give the prior."""
        if not len(self.labels):
            return np.full(len(rows), self.prior)
        cosines = self.project(rows) @ self.positions.T
        k = min(neighbours, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        votes = (weight * self.labels[near]).sum(axis=1)
        return np.where(total > 1e-9, np.clip(votes / np.maximum(total, 1e-9), 0, 1), self.prior)


def _axes(x: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration with a fixed seed."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(7).standard_normal((x.shape[1], min(rank + 16, x.shape[1]))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :rank]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, rank: int = RANK) -> LatentSpace:
    """Fit on at most ``sample`` labelled documents: those whose ids have the least hashes.

    ``labels``: ``doc_id`` and ``label`` (0 or 1); null labels are left out, of several labels of one id the
    least counts.  The driver gets term weights of the sample, a fixed size per row, and never texts.
    """
    given = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("_label"))
    chosen = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", whole_text(docs).alias("text")).join(F.broadcast(chosen), "doc_id")

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["_label"], "terms": [terms(t).astype("<f2").tobytes() for t in frame["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInPandas(weigh, f"doc_id {kind}, label int, terms binary").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id", ignore_index=True)
    y = found["label"].to_numpy(np.float64)
    x = np.empty((len(found), TERMS), np.float32)
    for row, weighed in zip(x, found["terms"]):
        row[:] = np.frombuffer(weighed, "<f2")
    del found
    weights = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(0.5)
    empty = np.zeros((0, 1), np.float32)
    if not len(x):
        return LatentSpace(weights, np.zeros((TERMS, 1), np.float32), empty, y, 0.5)
    x *= weights  # the one copy that the driver holds
    space = LatentSpace(weights, _axes(x, rank).astype(np.float32), empty, y, float(y.mean()))
    space.positions = space.placed(x)
    return space


def score(docs: DataFrame, space: LatentSpace, column: str = "score", neighbours: int = NEIGHBOURS) -> DataFrame:
    """``docs`` with ``column``: 0 to 1, higher where label 1 is likelier, for every row and whole text.

    The broadcast is ``SAMPLE`` positions and the axes, whatever the number of documents.  Null and
    empty texts get the share of label 1 in the sample (0.5 without a sample).
    """
    shared = docs.sparkSession.sparkContext.broadcast(space)

    @F.pandas_udf("double")
    def voted(text: pd.Series) -> pd.Series:
        out = np.empty(len(text))
        for i in range(0, len(text), BLOCK):
            rows = np.stack([terms(t) for t in text[i : i + BLOCK]])
            out[i : i + BLOCK] = shared.value.scores(rows, neighbours)
        return pd.Series(out)

    return docs.withColumn(column, voted(whole_text(docs)))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their columns."""
    return score(docs, fit(docs, labels), "_score").where(F.col("_score") >= threshold).drop("_score")
