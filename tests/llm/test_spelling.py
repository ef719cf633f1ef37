import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from gridfold.llm import spelling
from gridfold.llm.queries import spelling_forms

WORD = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_vocabulary(rows, dropped=199, length=6, least=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in WORD.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if dropped and h % dropped == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= length and n >= least}


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced code point, by stripping what both have in common."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def plain_variants(words, ratio=5):
    # Words of one edit share a pattern with one place blanked or left out.
    groups = defaultdict(set)
    for w in words:
        groups[w].add(w)
        for i in range(len(w)):
            groups[w[:i] + w[i + 1 :]].add(w)
            groups[w[:i] + "?" + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for g in groups.values():
        for a in g:
            near[a].update(b for b in g if one_edit(a, b))
    forms = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (n, len(near[w]), forms[w], words.get(forms[w]), root)
    return out


def found(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def test_query_equals_brute_force_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    words = plain_vocabulary(rows)
    got = found(spelling_forms(spark, sf))
    assert len(words) > 100 and got == plain_variants(words)


def test_chains_ties_and_odd_letters(spark, documents):
    texts = ["colour " * 700 + "coloure " * 130 + "coloures " * 25 + "colouress " * 5, "straße strase " * 30 + "strabe " * 160 + "straze " * 160 + "strabes", "ÀÉÎÕÜ÷ ÀÉÎÕÜ× " * 5, "aabbcc aabbc " * 6 + "aabbccd " * 40]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (None, "Straße STRASE"), (0, ""), (7, "x" * 5000 + " " + "y" * 70000), (7, texts[0])]
    words = plain_vocabulary(rows, None)
    docs = documents(rows, extra="word")
    got = found(spelling.spelling_variants(spelling.vocabulary(docs)))
    assert got == plain_variants(words)
    assert got["colouress"][4] == "colour" and got["strase"][2] == "strabe"  # of equal counts the smaller
    assert spelling.spelling_variants(spelling.vocabulary(docs.limit(0))).collect() == []


@pytest.mark.parametrize("pass_bytes", [1 << 26, 1024, 512])
def test_passes_and_shards_lose_nothing(spark, pass_bytes):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 9))) for _ in range(900)] + ["a" * 300, "a" * 299 + "b", "a" * 301]
    words = {w: rnd.randint(5, 400) for w in base}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    if pass_bytes < 1 << 26:
        assert len(spelling.plan_passes(Counter(map(len, words)), pass_bytes)) > 1
    assert found(spelling.spelling_variants(frame, pass_bytes=pass_bytes)) == plain_variants(words)


def test_edits_are_hashed_as_built_words(monkeypatch):
    """Also when positions are taken in several goes."""
    monkeypatch.setattr(spelling, "HASHED", 200)
    import numpy as np

    alphabet = np.array(sorted(map(ord, spelling.ALPHABET)), np.uint32)
    for word in ["banana", "é", "ab", "zzzzzz", "aéaé"]:
        codes = spelling.letters([word])
        one = lambda w: int(spelling.polynomials(spelling.letters([w]))[0])
        seen = set()
        for _, place, letter, h in spelling.replaced(codes, alphabet):
            for p, c, x in zip(place, alphabet[letter], h):
                new = word[:p] + chr(c) + word[p + 1 :]
                assert one(new) == int(x) and new > word
                seen.add(new)
        assert len(seen) == sum((alphabet > ord(c)).sum() for c in word)
        _, place, h = spelling.deleted(codes)
        got = [(word[:p] + word[p + 1 :], int(x)) for p, x in zip(place, h)]
        assert all(one(w) == x for w, x in got if w)
        assert len({w for w, _ in got}) == len(got) and {w for w, _ in got} == ({word[:i] + word[i + 1 :] for i in range(len(word))} if len(word) > 1 else set())
