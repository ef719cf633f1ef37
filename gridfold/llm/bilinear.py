"""A log-bilinear language model, trained with noise-contrastive estimation over all training documents.

A context predicts the vector of the next token: the sum of its tokens' vectors, each times the matrix of
its distance.  The next token's outcome is scored by the product with the outcome's vector.  Outcomes are the
most frequent tokens themselves and, for all others, their ending; a token's probability within its ending
is its smoothed share.  So a text's probabilities add up to one over all tokens, known or not, and the
normalising sum over outcomes is a product of two matrices.

Counts of all training tokens are gathered by a shuffle.  Training goes over every training document once:
in each round the tasks start from the same parameters, and their results are averaged, part by part.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.llm.base import whole_text
from gridfold.session import stored

#: The token that ends every text: no word contains it.
END = "\n"
SMOOTHING = 0.1
#: Tokens whose counts are broadcast (longer ones never are); other tokens' counts are joined.
COMMON, COMMON_BYTES = 1 << 17, 64
#: Tokens that are outcomes themselves; endings that are outcomes (the last one stands for all other endings).
SINGLE, ENDINGS = 96, 64
#: Letters of an ending.
SUFFIX = 2
#: Tokens with a vector of their own as context; the others share vectors by a hash of their ending.
INPUTS, HASHED_INPUTS = 8192, 1024
CONTEXT, WIDTH = 5, 16
#: Noise outcomes per group of positions, and positions of a group.
NOISE, GROUP = 24, 1024
ROUNDS, RATE = 8, 0.1
#: Distinct tokens that a task gathers before it sends their counts; positions that are scored at a time.
GATHERED, SCORED = 300_000, 1024
GATHERED_CHARS = 256 << 20


def tokens_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (in bytes, only these change), and the end."""
    return [*text.encode().lower().split(), END.encode()]


def ending(token: str) -> str:
    return token[-SUFFIX:]


def token_counts(texts: DataFrame) -> DataFrame:
    """``token, n`` over one column of texts that aren't null, ends included.  Tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        chars = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([t.decode() for t in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                counts.update(tokens_of(text))
                chars += len(text)
                if len(counts) > GATHERED or chars > GATHERED_CHARS:
                    yield flush()
                    counts, chars = Counter(), 0
        yield flush()

    return texts.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Vocabulary:
    """What encoding needs of the counts: bounded by ``COMMON``, ``SINGLE`` and ``ENDINGS``.

    ``common`` maps a token to its number by falling count; the first ``singles`` are outcomes.  An ending's outcome is
    its place in ``endings`` after these, the last one for endings that aren't listed.  ``masses`` are the smoothed
    occurrences of each ending: its tokens that aren't outcomes, and one unknown token.
    """

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.sum("n"), F.count("*")).first()
        self.tokens, self.known = total[0] or 0, total[1]
        short = counts.where(F.octet_length("token") <= COMMON_BYTES)
        # Few bins of counts say from which count on there are at most COMMON tokens: no task sends more than it has of these.
        size, room, least = F.floor(F.log2("n") * 16), COMMON, 1 << 62
        for r in short.groupBy(size.alias("bin")).agg(F.count("*").alias("v"), F.min("n").alias("n")).orderBy(F.desc("bin")).collect():
            room -= r["v"]
            if room < 0:
                break
            least = r["n"]
        short = sorted(short.where(F.col("n") >= least).collect(), key=lambda r: (-r["n"], r["token"]))
        self.common = {r["token"].encode(): i for i, r in enumerate(short)}
        self.n = np.array([r["n"] for r in short], np.float64)
        self.singles = min(SINGLE, len(short))
        rest = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(r["token"],) for r in short[: self.singles]], "token string")), "token", "left_anti")
        # In code points from the right, as ``ending``.
        by_ending = rest.groupBy(F.substring("token", -SUFFIX, SUFFIX).alias("ending")).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
        listed = by_ending.orderBy(F.desc("n"), "ending").limit(ENDINGS - 1).collect()
        self.endings = {r["ending"]: i for i, r in enumerate(listed)}
        whole = by_ending.agg(F.sum("n"), F.sum("v")).first()
        n = np.array([*[r["n"] for r in listed], (whole[0] or 0) - sum(r["n"] for r in listed)], np.float64)
        v = np.array([*[r["v"] for r in listed], (whole[1] or 0) - sum(r["v"] for r in listed)], np.float64)
        self.masses = n + SMOOTHING * (v + 1)
        self.outcomes = self.singles + len(self.masses)
        shares = np.concatenate([self.n[: self.singles] + SMOOTHING, self.masses])
        self.shares = shares / shares.sum()
        self.last = len(self.masses) - 1

    @property
    def base(self) -> float:
        """The base model's denominator."""
        return self.tokens + SMOOTHING * (self.known + 1)


def _input(token: bytes) -> int:
    """The shared context vector of a token that has none of its own."""
    return INPUTS + zlib.crc32(token[-SUFFIX:]) % HASHED_INPUTS


class Encoder:
    """Texts to inputs and outcomes; remembers endings of tokens that aren't common."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        names = list(v.common)
        self.inputs = np.array([i if i < INPUTS else _input(t) for i, t in enumerate(names)], np.uint16)
        self.outcomes = np.array([i if i < v.singles else self.outcome(t.decode()) for i, t in enumerate(names)], np.uint16)
        self.log_n = np.log10(v.n + SMOOTHING)
        self.log_mass = np.concatenate([np.zeros(v.singles), np.log10(v.masses)])
        # Of an outcome that is a token, its count is not part of the score.
        self.within = np.where(np.arange(len(names)) < v.singles, 0.0, self.log_n)

    def outcome(self, token: str) -> int:
        return self.v.singles + self.v.endings.get(ending(token), self.v.last)

    def __call__(self, text: str) -> tuple[bytes, bytes, int, float, float, int, dict[str, int]]:
        """Inputs and outcomes (16 bits each), tokens, base and inner log-probabilities without other tokens' counts, common tokens, other tokens."""
        tokens = tokens_of(text)
        number = np.fromiter(map(self.v.common.get, tokens, repeat(-1)), np.int64, len(tokens))
        other = np.flatnonzero(number < 0)
        common = number[number >= 0]
        if len(self.inputs):
            inputs, outcomes = self.inputs[number], self.outcomes[number]
        else:
            inputs, outcomes = np.zeros(len(tokens), np.uint16), np.zeros(len(tokens), np.uint16)
        rare: Counter = Counter()
        for i in other.tolist():
            t = tokens[i].decode()
            inputs[i], outcomes[i] = _input(tokens[i]), self.outcome(t)
            rare[t] += 1
        return inputs.tobytes(), outcomes.tobytes(), len(tokens), float(self.log_n[common].sum()), float(self.within[common].sum() - self.log_mass[outcomes].sum()), len(common), rare


_ENCODED = "n_tokens long, inputs binary, outcomes binary, base_part double, inner_part double, n_common long, rare map<string,int>"


def encoded(docs: DataFrame, vocabulary: Vocabulary, held_out: Column) -> DataFrame:
    """Rows with their own ``key``, ``doc_id``, ``held_out``, the ``round`` that learns from them, and what ``Encoder`` gives."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(shared.value)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [encode(t) for t in part.column(2).to_pylist()]
                columns = list(zip(*rows))
                keys = np.arange(key, key + len(rows))
                key += len(rows)
                types = [pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64()]
                values = [pa.array(c, t) for c, t in zip((columns[2], columns[0], columns[1], *columns[3:6]), types)]
                rare = pa.array([list(r.items()) for r in columns[6]], pa.map_(pa.string(), pa.int32()))
                turn = pa.array((keys % ROUNDS).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(keys), part.column(0), part.column(1), turn, *values, rare], ["key", "doc_id", "held_out", "round", *[x.split()[0] for x in _ENCODED.split(", ")]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out.alias("held_out"), whole_text(docs).alias("text"))
    return rows.mapInArrow(run, f"key long, doc_id {kind}, held_out boolean, round int, {_ENCODED}")


# --- the model ----------------------------------------------------------------------------------------

#: The input that stands before a text, ``CONTEXT`` times.
PAD = INPUTS + HASHED_INPUTS


class Stream:
    """Texts one after the other, with pads before each: inputs, outcomes, row numbers, and which positions are pads."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]]):
        before = np.full(CONTEXT, PAD, np.uint16)
        none = np.zeros(CONTEXT, np.uint16)
        inputs = [np.frombuffer(x, np.uint16) for _, x, _ in rows]
        self.inputs = np.concatenate([x for own in inputs for x in (before, own)])
        self.outcomes = np.concatenate([x for _, _, y in rows for x in (none, np.frombuffer(y, np.uint16))]).astype(np.int64)
        sizes = np.array([len(x) + CONTEXT for x in inputs])
        self.rows = np.repeat([r for r, _, _ in rows], sizes)
        self.real = np.ones(len(self.inputs), np.float32)
        first = np.cumsum(sizes) - sizes
        for k in range(CONTEXT):
            self.real[first + k] = 0

    def groups(self, size: int) -> Iterator[tuple[np.ndarray, slice]]:
        """Neighbouring positions, with the inputs from ``CONTEXT`` before the first to the last."""
        for at in range(CONTEXT, len(self.inputs), size):
            yield self.inputs[at - CONTEXT : at + size], slice(at, min(at + size, len(self.inputs)))


def windows(vectors: np.ndarray) -> np.ndarray:
    """The ``CONTEXT`` vectors before each position but the first ones, side by side, farthest first."""
    view = np.lib.stride_tricks.sliding_window_view(vectors.ravel(), CONTEXT * WIDTH)[::WIDTH]
    return np.ascontiguousarray(view[: len(vectors) - CONTEXT])


class Model:
    """Parameters, all 32-bit: ``inputs`` and ``outputs`` (vectors), ``weights`` (a matrix for each distance, farthest first), ``bias`` of outcomes."""

    PARTS = ("inputs", "outputs", "weights", "bias", "inputs_seen", "outputs_seen", "weights_seen", "bias_seen")

    def __init__(self, vocabulary: Vocabulary, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.inputs = rng.normal(0, 0.1, (PAD + 1, WIDTH)).astype(np.float32)
        self.outputs = rng.normal(0, 0.1, (vocabulary.outcomes, WIDTH)).astype(np.float32)
        self.weights = np.tile(np.eye(WIDTH, dtype=np.float32) / 2, (CONTEXT, 1))
        self.bias = np.log(vocabulary.shares).astype(np.float32)
        self.shares = vocabulary.shares
        # Squares of past steps: by row for vectors, by entry for the rest.
        self.inputs_seen, self.outputs_seen = np.ones(len(self.inputs), np.float32), np.ones(len(self.outputs), np.float32)
        self.weights_seen, self.bias_seen = np.ones_like(self.weights), np.ones_like(self.bias)

    def copy(self) -> Model:
        out = Model.__new__(Model)
        out.shares = self.shares
        for p in self.PARTS:
            setattr(out, p, getattr(self, p).copy())
        return out

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, p).ravel() for p in self.PARTS])

    def replace(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.PARTS:
            now = getattr(self, p)
            setattr(self, p, flat[at : at + now.size].reshape(now.shape).astype(np.float32))
            at += now.size

    def predicted(self, vectors: np.ndarray) -> np.ndarray:
        """The vector that each position's context predicts, from the vectors of its inputs and those ``CONTEXT`` before."""
        return windows(vectors) @ self.weights

    def log_probabilities(self, inputs: np.ndarray, outcomes: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities of outcomes: one product with all outcomes' vectors."""
        scores = self.predicted(self.inputs[inputs]) @ self.outputs.T
        scores += self.bias
        own = scores[np.arange(len(outcomes)), outcomes]
        top = scores.max()
        scores -= top
        np.exp(scores, out=scores)
        total = scores @ np.ones(scores.shape[1], np.float32)
        far = np.flatnonzero(total < 1e-30)  # rows whose scores all lie so far below the largest
        if len(far):
            again = (self.predicted(self.inputs[inputs])[far] @ self.outputs.T + self.bias - top).astype(np.float64)
            most = again.max(axis=1)
            logs = np.log(np.maximum(total, 1e-30))
            logs[far] = most + np.log(np.exp(again - most[:, None]).sum(axis=1))
            return own - top - logs
        return own - top - np.log(total)


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct row numbers and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[first], np.add.reduceat(values[order], first, axis=0)


class Trainer:
    """Noise-contrastive estimation with adaptive steps, in groups of positions that share their noise."""

    def __init__(self, model: Model, seed: int):
        self.m, self.rng = model, np.random.default_rng(seed)
        self.cumulated = np.cumsum(model.shares)
        self.log_noise = np.log(NOISE * model.shares).astype(np.float32)

    def _step(self, part: str, rows, grad: np.ndarray) -> None:
        seen, now = getattr(self.m, f"{part}_seen"), getattr(self.m, part)
        seen[rows] += np.square(grad) if seen.shape == now.shape else np.square(grad).mean(axis=1)
        step = RATE * grad / (np.sqrt(seen[rows]) if seen.shape == now.shape else np.sqrt(seen[rows])[:, None])
        now[rows] += step

    def learn(self, inputs: np.ndarray, outcomes: np.ndarray, real: np.ndarray) -> None:
        """Data against noise: a logistic regression on each score less the log-rate of the noise."""
        m, n = self.m, len(outcomes)
        noise = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE)), len(m.bias) - 1)
        given = windows(m.inputs[inputs])
        query = given @ m.weights
        mine, others = m.outputs[outcomes], m.outputs[noise]
        own = np.einsum("nd,nd->n", query, mine) + (m.bias - self.log_noise)[outcomes]
        up = real / (1 + np.exp(np.clip(own, -30, 30)))
        other = query @ others.T
        other += (m.bias - self.log_noise)[noise]
        np.clip(other, -30, 30, out=other)
        np.negative(other, out=other)
        np.exp(other, out=other)
        other += 1
        down = np.divide(-real[:, None], other, out=other)
        to_query = up[:, None] * mine
        to_query += down @ others
        bias = np.bincount(outcomes, up, len(m.bias)) + np.bincount(noise, down.sum(axis=0), len(m.bias))
        place = (outcomes[:, None] * WIDTH + np.arange(WIDTH)).ravel()
        by_output = np.bincount(place, (up[:, None] * query).ravel(), m.outputs.size).reshape(m.outputs.shape)
        np.add.at(by_output, noise, down.T @ query)
        by_given = to_query @ m.weights.T
        by_input = np.zeros((len(inputs), WIDTH), np.float32)
        for k in range(CONTEXT):
            by_input[k : k + n] += by_given[:, k * WIDTH : (k + 1) * WIDTH]
        self._step("outputs", slice(None), by_output.astype(np.float32))
        self._step("bias", slice(None), bias.astype(np.float32))
        self._step("weights", slice(None), given.T @ to_query)
        self._step("inputs", *_summed(inputs, by_input))


#: Positions that a task holds at a time, but for one longer text.
HELD = 1 << 18


def streams(batches, inputs: str, outcomes: str) -> Iterator[Stream]:
    """Streams of some ``HELD`` positions; rows are numbered from 0 in each batch, and no stream spans two."""
    for batch in batches:
        rows, size = [], 0
        for i, (x, y) in enumerate(zip(batch.column(inputs), batch.column(outcomes))):
            rows.append((i, x.as_py(), y.as_py()))
            size += len(rows[-1][1]) // 2
            if size > HELD:
                yield Stream(rows)
                rows, size = [], 0
        if rows:
            yield Stream(rows)


#: Parameters that one row of the averaging holds.
_PART = 1 << 14


def _train(shared, turn: int):
    """One task's texts of a round: its parameters in parts, weighted by positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.copy()  # workers keep what is broadcast
        trainer, seen = Trainer(model, turn), 0
        for stream in streams(batches, "inputs", "outcomes"):
            for inputs, at in stream.groups(GROUP):
                trainer.learn(inputs, stream.outcomes[at], stream.real[at])
            seen += int(stream.real.sum())
        if seen:
            flat, task = model.flat(), TaskContext.get().partitionId()
            for part, at in enumerate(range(0, len(flat), _PART)):
                values = [(part, pa.int32()), (task, pa.int32()), (seen, pa.int64()), (flat[at : at + _PART].tobytes(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in values], ["part", "task", "seen", "numbers"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts sorted by number and task: their means, weighted by positions."""
    now, total, weight = None, np.zeros(0), 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], ["part", "numbers"])

    for batch in batches:
        for part, seen, numbers in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3))):
            if part != now:
                if now is not None:
                    yield done()
                now, total, weight = part, np.zeros(len(numbers) // 4), 0
            total += seen * np.frombuffer(numbers, np.float32).astype(np.float64)
            weight += seen
    if now is not None:
        yield done()


def train(rows: DataFrame, vocabulary: Vocabulary) -> Model:
    """The model after one pass over ``rows`` (``round, inputs, outcomes`` of training documents), in ``ROUNDS`` rounds.

    Each task learns from its own texts of a round; parameters are averaged part by part in a shuffle, so the
    driver holds one model.  A lost task repeats the same steps.
    """
    model, context = Model(vocabulary), rows.sparkSession.sparkContext
    for turn in range(ROUNDS):
        shared = context.broadcast(model.copy())
        own = rows.where(F.col("round") == turn).select("inputs", "outcomes")
        parts = own.mapInArrow(_train(shared, turn), "part int, task int, seen long, numbers binary")
        means = parts.repartition("part").sortWithinPartitions("part", "task").mapInArrow(_average, "part int, numbers binary").collect()
        if means:
            model.replace(np.concatenate([np.frombuffer(bytes(r["numbers"]), np.float32) for r in sorted(means, key=lambda r: r["part"])]))
    return model


def _score(shared):
    """Inputs and outcomes to the log10 probability of each text's outcomes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for stream in streams([batch], "inputs", "outcomes"):
                for inputs, at in stream.groups(SCORED):
                    found = model.log_probabilities(inputs, stream.outcomes[at])
                    total += np.bincount(stream.rows[at], found * stream.real[at], len(total))
            kept = [c for c in batch.schema.names if c not in ("inputs", "outcomes")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(total / np.log(10))], [*kept, "outer"])

    return run


def score_texts(docs: DataFrame, held_out: Column) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs`` (``doc_id``, ``text``).

    The model learns from rows where ``held_out`` is false.  ``score`` is its log10 probability of the whole text
    and the end after it, ``base_score`` that of smoothed token counts; ``n_known`` counts tokens seen in
    training.  Null and blank texts are the end alone.  Repeated rows and null ids are rows of their own; other columns
    are ignored; an empty table gives an empty one, and without training rows nothing is known.
    """
    spark: SparkSession = docs.sparkSession
    given = docs.select("doc_id", held_out.alias("held_out"), whole_text(docs).alias("text"))
    counts = stored(token_counts(given.where(~F.col("held_out")).select("text")), "tokens")
    vocabulary = Vocabulary(counts)
    rows = stored(encoded(given, vocabulary, F.col("held_out")), "encoded")
    model = train(rows.where(~F.col("held_out")), vocabulary)
    shared = spark.sparkContext.broadcast(model.copy())
    scored = rows.select("key", "doc_id", "held_out", "n_tokens", "base_part", "inner_part", "n_common", "inputs", "outcomes")
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = scored.mapInArrow(_score(shared), f"key long, doc_id {kind}, held_out boolean, n_tokens long, base_part double, inner_part double, n_common long, outer double")
    rare = rows.select("key", F.explode("rare").alias("token", "times")).join(counts, "token", "left")
    sums = rare.groupBy("key").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTHING))).alias("rare_part"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("n_rare")
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("rare_part", "n_rare")}
    done = scored.join(sums, "key", "left").select("*", zero["rare_part"].alias("r"), zero["n_rare"].alias("k"))
    base = F.col("base_part") + F.col("r") - F.col("n_tokens") * F.lit(float(np.log10(vocabulary.base)))
    return done.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_common") + F.col("k")).cast("long").alias("n_known"), F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("outer") + F.col("inner_part") + F.col("r")).alias("score"),
    )
