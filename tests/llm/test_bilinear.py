import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridfold.llm import bilinear
from gridfold.llm.queries import lm_scores

WORDS = re.compile("[^ \t-\r]+")


def plain_tokens(text):
    return [*WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), "\n"]


def plain_base(rows, held):
    counts = Counter(t for i, text in rows if not held(i) for t in plain_tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        tokens = plain_tokens(text)
        score = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        out.append((str(i), held(i), len(tokens), sum(counts[t] > 0 for t in tokens), n, round(score, 6)))
    return sorted(out)


def base_of(rows):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)


def tenth(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


def test_query_on_the_table(spark):
    """Base scores equal a plain version; the model beats them on held-out texts."""
    sf = "/root/testdata/sf0.01"
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = lm_scores(spark, sf).collect()
    assert base_of(got) == plain_base(given, tenth)
    held = [r for r in got if r.held_out]
    gain = (sum(r.score for r in held) - sum(r.base_score for r in held)) / sum(r.n_tokens for r in held)
    assert len(held) > 60 and gain > 0.15
    assert all(r.score < 0 for r in got)


def test_odd_rows(documents):
    rows = [(i, "the cat sat on the mat " * (1 + i % 5) + "and The End\x0bÉté x") for i in range(60)]
    rows += [(None, None), (None, "unseen words only"), (1, ""), (1, rows[0][1]), (8, "w " * 70000), (9, "q" * 50000), (10, "\x1c \x85 a b")]
    docs = documents(rows, extra="score")
    held = F.coalesce(F.col("doc_id") % 4 == 0, F.lit(True))
    got = bilinear.score_texts(docs, held).collect()
    assert base_of(got) == plain_base(rows, lambda i: True if i is None else i % 4 == 0)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert bilinear.score_texts(docs.limit(0), held).collect() == []
    nothing = bilinear.score_texts(docs, F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens) for r in nothing} == {(0, 0)} and len(nothing) == len(rows) and all(math.isfinite(r.score) for r in nothing)


def test_probabilities_add_up(spark, documents):
    """After any context, all known tokens and one unknown token of each ending add up to one."""
    docs = documents([(i, "alpha beta gamma delta " * 3 + f"rare{i % 7} word{i % 31}ing") for i in range(200)])
    counts = bilinear.token_counts(docs.select("text"))
    v = bilinear.Vocabulary(counts)
    v_small = [r.token for r in counts.orderBy("token").collect()]
    encode, model = bilinear.Encoder(v), bilinear.Model(v)
    n = {r.token: r.n for r in counts.collect()}
    context = np.array([bilinear.PAD] * 3 + encode.inputs[:2].tolist(), np.uint16)
    total = 0.0
    for token in v_small:
        number = v.common[token.encode()]
        outcome = int(encode.outcomes[number])
        p = math.exp(model.log_probabilities(np.append(context, 0).astype(np.uint16), np.array([outcome]))[0])
        total += p * (1 if number < v.singles else (n[token] + 0.1) / v.masses[outcome - v.singles])
    for e in range(len(v.masses)):
        total += math.exp(model.log_probabilities(np.append(context, 0).astype(np.uint16), np.array([v.singles + e]))[0]) * 0.1 / v.masses[e]
    assert total == pytest.approx(1, abs=1e-4)


def test_far_scores_stay_finite():
    class Few:
        shares, outcomes = np.array([0.5, 0.5]), 2

    model = bilinear.Model(Few)
    model.bias[:] = [0, 300]
    model.inputs[1], model.weights[:] = 400, 1
    model.outputs[0], model.outputs[1] = 0.05, 0
    inputs = np.array([bilinear.PAD] * bilinear.CONTEXT + [1, 0, 0], np.uint16)
    got = model.log_probabilities(inputs, np.array([1, 0, 1]))
    both = [model.log_probabilities(inputs, np.array([k] * 3)) for k in (0, 1)]
    assert np.isfinite(got).all() and np.allclose(np.exp(both[0]) + np.exp(both[1]), 1)


def test_noise_contrastive_steps_find_the_distribution():
    """Without contexts that tell anything, probabilities approach the shares of the outcomes."""

    class Three:
        shares, outcomes = np.array([0.4, 0.35, 0.25]), 3

    model, rng = bilinear.Model(Three), np.random.default_rng(0)
    trainer = bilinear.Trainer(model, 1)
    draw = rng.choice(3, 200_000, p=[0.7, 0.2, 0.1])
    for at in range(0, len(draw), 1000):
        trainer.learn(np.zeros(1000 + bilinear.CONTEXT, np.uint16), draw[at : at + 1000], np.ones(1000, np.float32))
    got = np.exp(model.log_probabilities(np.zeros(3 + bilinear.CONTEXT, np.uint16), np.arange(3)))
    assert np.abs(got - [0.7, 0.2, 0.1]).max() < 0.03
