import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from gridfold.llm import alignment
from gridfold.llm.queries import aligned

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    "plain words here.", " leading", "trailing  ", "two  spaces   three\n\n  lines\n next", "tab\tand nbsp 　 wide", "<|endoftext|> <s> </s> <unk> <0x0A> a<|endoftext|>b",
    "naïve café Übergröße ½ ² ﬁ", "日本語 テキスト 한국어", "emoji 👩‍👩‍👧 ‍ zero​width", "don't we'll I'M they've 12345 3.14 $#@!!", "\r\n;\r )\r\n", "a▁b", "▁", "\x00 nul \x1f unit", " ", "\n", "x" * 3000,
    "é" * 2000, "é ̈ alone", "word " * 50, "퟿�", "a ́b", "a   b c", "the the the the", "\x1c a \x1d\x1eb",
]


class Plain:
    """Whole texts through both tokenizers, pairs by comparing every byte range."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.back = {chr(c): c for c in keep}
        self.back.update({chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in keep)})

    def tokens(self, text):
        a = [(i, bytes(self.back[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        pieces = [(i, self.b.id_to_piece(i)) for i in self.b.encode(text)]
        return a, [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]

    def document(self, text):
        """Number of tokens of both, group text, links."""
        if not text:
            return 0, 0, "", []
        a, b = self.tokens(text)
        if any(b"".join(x for _, x in t) != (" " + text).encode() for t in (a, b)):
            return 0, 0, "", []

        def ranges(tokens):
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            return out

        ra, rb = ranges(a), ranges(b)
        cuts = sorted({e for _, _, e in ra} & {e for _, _, e in rb})
        groups, links, low = [], [], 0
        for cut in cuts:
            ga, gb = [r for r in ra if low < r[2] <= cut], [r for r in rb if low < r[2] <= cut]
            groups.append(",".join(str(r[0]) for r in ga) + "|" + ",".join(str(r[0]) for r in gb))
            links += [(x[0], y[0]) for x in ga for y in gb if x[1] < y[2] and y[1] < x[2]]
            low = cut
        return len(a), len(b), ";".join(groups), links


def plain_rows(texts):
    one = Plain()
    docs = [one.document(t) for t in texts]
    count = Counter(p for d in docs for p in set(d[3]))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return [
        (na, nb, g.count(";") + 1 if g else 0, len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for na, nb, g, links in docs
    ], count, Counter(p for d in docs for p in d[3])


def found(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_odd_texts_equal_brute_force(documents):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (3, ""), (3, ODD[0]), (None, ODD[3])]
    want, _, _ = plain_rows([t for _, t in rows])
    docs = documents(rows, extra="code")
    assert found(alignment.aligned_documents(docs, A, B)) == sorted((str(i), *w) for (i, _), w in zip(rows, want))
    assert alignment.aligned_documents(docs.limit(0), A, B).collect() == []
    assert sum(w[0] == 0 for w in want) >= 4  # the two texts with U+2581, and those without any text


def test_query_equals_brute_force_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want, _, _ = plain_rows([t for _, t in rows])
    assert found(aligned(spark, sf)) == sorted((str(i), *w) for (i, _), w in zip(rows, want))


def test_many_blocks_and_planes(spark, documents, monkeypatch):
    """Document and link counts from bitmaps, over blocks of few characters."""
    rnd = random.Random(2)
    words = "the of and rendering unbelievable Straße x1 ,,, naïveté".split()
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))) for _ in range(600)] + ["the " * 5000]
    docs = documents(list(enumerate(texts)))
    want, count, times = plain_rows(texts)
    assert found(alignment.aligned_documents(docs.repartition(5), A, B)) == sorted((str(i), *w) for i, w in enumerate(want))
    got = alignment.pair_counts(alignment.postings(docs.coalesce(1), A, B)).collect()
    assert {(r.a, r.b): (r.documents, r.links) for r in got} == {p: (n, times[p]) for p, n in count.items()}


def test_bitmaps_round_trip():
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(alignment.BLOCK_DOCUMENTS, n, replace=False)) for n in (1, 2, alignment.DENSE - 1, alignment.DENSE, alignment.DENSE + 1, 4096, 7)]
    keys, n, bits = alignment.bitmaps(np.repeat([3, 5, 6, 9, 11, 12, 40], [len(s) for s in sets]), np.concatenate(sets))
    assert keys.tolist() == [3, 5, 6, 9, 11, 12, 40] and n.tolist() == [len(s) for s in sets]
    assert all((alignment.places_of(b) == s).all() for b, s in zip(bits.to_pylist(), sets))


def test_units_of_some_blocks_are_learnt_once(monkeypatch):
    """More distinct units than one block has stay known, also with white space inside and around."""
    units, learnt = alignment.Units(A, B), []
    learn = units.learn
    monkeypatch.setattr(units, "learn", lambda new: (learnt.extend(new), learn(new)))
    texts = [" ".join(f"w{i * 40 + j}" for j in range(40)) for i in range(5000)]
    for block in (texts, ["a\nb  c\td \n e\xa0", "a\nb c"], texts[:1]):
        rows = units.rows([alignment.units_of(t) for t in block])
    assert len(learnt) == len(set(learnt)) and len(units.numbers) >= 200_000
    plain = Plain()
    for t, own in [(texts[0], rows[0]), *((t, units.rows([alignment.units_of(t)])[0]) for t in ("a\nb  c\td \n e\xa0", "a\nb c", *ODD[:12]))]:
        assert b";".join(units.groups[i] for i in own).decode() == plain.document(t)[2]


def test_forgotten_units_are_learnt_again(documents, monkeypatch):
    texts = [" ".join(f"w{i}{j}" for j in range(30)) for i in range(40)]
    units = alignment.Units(A, B)
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    for t in texts + texts:
        (own,) = units.rows([alignment.units_of(t)])
        plain = Plain().document(t)
        assert b";".join(units.groups[i] for i in own).decode() == plain[2]
    assert len(units.numbers) <= 60
