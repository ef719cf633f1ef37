import random

import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from gridfold.llm import base, shingles, simhash
from gridfold.llm.components import components
from gridfold.session import stored


def plain_simhash(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, bits=3):
    fps = [plain_simhash(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, fps[i], least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def varied(n, seed=5):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rnd.randrange(40)) for _ in range(120)) for _ in range(12)]
    rows = []
    for i in range(n):
        words = rnd.choice(base).split()
        for _ in range(rnd.randrange(3)):
            words[rnd.randrange(len(words))] = f"new{rnd.randrange(99)}"
        rows.append((i * 3, " ".join(words)))
    return rows


EDGES = [(901, None), (902, ""), (903, " \t\n"), (904, "One"), (904, "One"), (None, "one"), (905, "Ärger 　x"), (906, "word " * 30000), (None, None), (907, "ONE")]


def test_equals_brute_force(documents):
    rows = varied(150) + EDGES
    got = simhash.near_duplicates(documents(rows, extra="fp2")).collect()
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=repr) == brute(rows)


def test_dense_cluster_in_blocks(spark, monkeypatch):
    """A list far longer than a block, with links across blocks, gives the components of all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rnd = random.Random(1)
    fps = {0}
    while len(fps) < 300:
        fps.add(rnd.choice(sorted(fps)) ^ (1 << rnd.randrange(40)) ^ (1 << rnd.randrange(64)))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    edges = simhash.linked_fingerprints(df)
    got = {r.node: r.root for r in components(edges).collect()}
    root = {f: f for f in signed}
    for _ in range(len(signed)):
        before = dict(root)
        for a in signed:
            for b in signed:
                if bin((a ^ b) % 2**64).count("1") <= 3:
                    root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    assert {f: got.get(f, f) for f in signed} == root
    assert edges.count() < 8 * len(signed) * 40


def test_components_of_a_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 5), (3, 2), (1000, 999)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 1000: 999}
    assert components(edges.limit(0)).count() == 0


def test_components_of_hot_stars(spark, monkeypatch):
    """Two stars of many edges, joined by a chain, beside a star whose centre has the largest id."""
    monkeypatch.setattr("gridfold.llm.components.HOT_EDGES", 7)
    edges = [(100, i) for i in range(1000, 1400)] + [(90, i) for i in range(2000, 2300)] + [(100, 50), (50, 60), (60, 90)] + [(9999, i) for i in range(5000, 5200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    first = {*range(1000, 1400), *range(2000, 2300), 100, 60, 90}
    assert got == {**{i: 50 for i in first}, **{i: 5000 for i in (*range(5001, 5200), 9999)}}


def test_one_of_each_group_stays(documents):
    rows = [(5, "same words here today"), (2, "same words here today"), (2, "same words here today"), (None, "same words here today"), (7, "something else entirely different"), (None, "alone without any id at all"), (9, None), (8, "")]
    docs = documents(rows, extra="_row")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(2, rows[0][1]), (7, rows[4][1]), (None, rows[5][1]), (8, "")], key=repr)
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_own_columns_stay(documents):
    """Columns named like those of the work keep their values, in rows that are checked and in rows that are not."""
    rows = [(1, "some words that come twice"), (2, "some words that come twice"), (3, "a text of its own"), (3, "a text of its own"), (4, None)]
    docs = documents(rows, extra="_row").withColumn("_id", F.col("doc_id") * 10).withColumn("doc", F.lit("x"))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    got = sorted((r.doc_id, r._id, r._row) for r in kept.collect())
    assert [g[:2] for g in got] == [(1, 10), (3, 30), (4, 40)] and [g[2] for g in got] in (["own 0", "own 2", "own 4"], ["own 0", "own 3", "own 4"])


def test_filter_of_keys(spark, monkeypatch):
    """All keys pass and few others, also where the bits are too few; without keys nothing does."""
    hashes = spark.range(20000).select(F.xxhash64("id").alias("h"), "id")
    for most, others in ((1 << 27, 900), (1 << 15, 3000)):
        monkeypatch.setattr(base, "MOST_BITS", most)
        among = base.may_be_among(hashes.where("id < 2000").select("h"), "h")
        passed = {r.id for r in hashes.where(among(F.col("h"))).collect()}
        assert passed >= set(range(2000)) and len(passed) < 2000 + others
    assert hashes.where(base.may_be_among(hashes.where("false"), "h")(F.col("h"))).count() == 0


def test_a_text_is_sent_once(documents, monkeypatch):
    """Buckets of different members that hang together are one; only texts that meet others are fetched."""
    seen = {}
    monkeypatch.setattr(shingles, "stored", lambda df, name: seen.setdefault(name, stored(df, name)))
    rows = varied(120, seed=8)
    shingles.near_copies(documents(rows + [(1000 + i, f"alone {i} " * 30) for i in range(20)])).collect()
    places = [p for r in seen["places"].collect() for p in r.places]
    assert len(places) == seen["places"].count() == len({t for _, t in rows})
    assert seen["members"].count() > 2 * len(places)


def test_places_of_large_components(spark, monkeypatch):
    """More texts than a block: one place by blocks where the buckets overlap much, else the buckets."""
    monkeypatch.setattr(shingles, "BLOCK", 8)
    dense = [(k, t) for k in range(9) for t in range(100, 120) if t != 110 + k]
    chain = [(1000 + t, u) for t in range(200, 220) for u in (t, t + 1)]
    small = [(5000 + t, u) for t in range(300, 304) for u in (t, t + 1)]
    rows = [(k, t) for part in (dense, chain, small) for k, t in part]
    size, least = {}, {}
    for k, t in rows:
        size[k], least[k] = size.get(k, 0) + 1, min(t, least.get(k, t))
    made = [(k, -t, t, size[k], least[k], -(-size[k] // 8)) for k, t in rows]
    members = spark.createDataFrame(made, "key bigint, row_key bigint, node bigint, n bigint, least bigint, blocks int")
    got = {r.node: sorted((p.key, p.blocks) for p in r.places) for r in shingles._places(members).collect()}
    assert all(got[t] == [(100, 3)] for t in range(100, 120))
    assert all(got[t] == [(1000 + k, 1) for k in (t - 1, t) if 200 <= k < 220] for t in range(200, 221))
    assert all(got[t] == [(300, 1)] for t in range(300, 305)) and len(got) == 20 + 21 + 5


def five_words(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies_by_five_words(documents, monkeypatch):
    """Of each group linked by pairs of 0.8 or more the smallest id stays; small blocks give the same."""
    rows = varied(120, seed=8) + [(d, t) for d, t in EDGES if d is not None and len(t or "") < 1000]
    sets = [five_words(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    want = sorted({min(d for (d, _), r in zip(rows, root) if r == own) for own in set(root)})
    for block in (512, 8):
        monkeypatch.setattr(shingles, "BLOCK", block)
        assert sorted(r.doc_id for r in shingles.drop_near_copies(documents(rows)).collect()) == want
    assert len(want) < len({simhash.simhash(t) for _, t in rows})


def test_simhash_names_candidates(documents, monkeypatch):
    """Without any common band, pairs of 0.8 or more within three bits are still found, and less alike ones stay."""
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "new"])), (3, " ".join(words[:40])), (4, None), (4, None), (None, " "), (5, " ".join(words[40:80]))]
    assert bin(plain_simhash(rows[0][1]) ^ plain_simhash(rows[1][1])).count("1") <= 3
    rows.append((6, rows[0][1].replace("w100 ", "odd ")))
    own = lambda t: t.map(lambda x: [xxhash.xxh64_intdigest((x or "").encode(), k) >> 1 for k in range(3)])
    monkeypatch.setattr(shingles, "bands_column", F.pandas_udf(own, "array<long>"))
    got = {(r.doc_id, r.root) for r in shingles.near_copies(documents(rows)).collect()}
    assert len({root for d, root in got if d in (1, 2, 6)}) == 1
    assert len({root for d, root in got if d in (1, 3, 4, 5)}) == 4
    assert sorted(r.doc_id for r in shingles.drop_near_copies(documents(rows)).collect()) == [1, 3, 4, 5]


def test_linked_rows_need_similarity():
    a = shingles.shingle_set(" ".join(f"w{i}" for i in range(104)))
    near, far = (shingles.shingle_set(" ".join([f"w{i}" for i in range(104 - n)] + [f"x{i}" for i in range(n)])) for n in (11, 12))
    assert shingles.linked_rows([a, near]).tolist() == [0, 0] and shingles.linked_rows([a, far]).tolist() == [0, 1]


def test_texts_go_through_in_slices(monkeypatch):
    """What is made of a batch comes out a few rows at a time, with the values of whole texts."""
    monkeypatch.setattr("gridfold.llm.base.SLICE", 7)
    texts = [t for _, t in varied(20)] + [None, "", "Ärger 　x"]
    for column, made in ((simhash.simhash_column, simhash.simhash), (shingles.bands_column, shingles.bands), (shingles.sets_column, lambda t: shingles.shingle_set(t).tobytes())):
        parts = list(column.func(iter([pa.array(texts[:20]), pa.array(texts[20:], pa.string())])))
        assert [len(p) for p in parts] == [7, 7, 6, 3]
        assert [v for p in parts for v in p.to_pylist()] == [made(t) for t in texts]
