import random
from itertools import combinations

import numpy as np

from gridfold.llm import decontaminate, suffixes, windows


def words(n, seed):
    rnd = random.Random(seed)
    return [f"{rnd.choice('abcdefgh')}{rnd.randrange(10**6)}" for _ in range(n)]


def brute_windows(rows, size=13):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    rank = lambda d: float("inf") if d is None else d
    for d, w in split:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            least[k] = min(least.get(k, rank(d)), rank(d))
    out = []
    for d, w in split:
        gone = {i + j for i in range(len(w) - size + 1) if least[tuple(w[i : i + size])] < rank(d) for j in range(size)}
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def window_rows():
    shared, other = words(40, 1), words(13, 2)
    return [
        (10, " ".join(words(30, 3) + shared + words(5, 4))), (4, " ".join(shared)), (12, " ".join(other + words(3, 5) + other)), (11, " ".join(other)), (13, " ".join(other[:12])),
        (20, " \t".join(other)), (20, " ".join(other) + " tail"), (None, " ".join(shared[:20])), (None, None), (30, ""), (31, "\n"), (32, "x " * 4000), (33, "x " * 5), (34, "x " * 20),
        (4, " ".join(shared)),
    ]


def test_windows_equal_brute_force(documents, monkeypatch):
    rows = window_rows()
    got = windows.drop_repeated_windows(documents(rows, extra="tag")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == brute_windows(rows)
    assert windows.drop_repeated_windows(documents(rows).limit(0)).count() == 0


def test_hot_windows_are_dealt_over_salts(documents, spark):
    hot = " ".join(words(20, 9))
    rows = [(i, hot if i % 2 else hot + f" and {i}") for i in range(2300)]
    got = {r.doc_id: r.n_removed for r in windows.drop_repeated_windows(documents(rows)).collect()}
    assert got == {i: 0 if not i else 20 if i % 2 else 21 for i in range(2300)}


def test_cells_round_trip():
    import numpy as np

    for n in (1, 2, 1000, 100_000):
        cells = np.unique(np.random.default_rng(n).integers(0, 1 << windows.BLOCK_BITS, n))
        assert (windows.unpack_cells(windows.pack_cells(cells)) == cells).all()


def test_repeats_of_fifty_words_are_found(documents):
    passage, long = words(50, 1), words(400, 2)
    rows = [
        (1, " ".join(words(33, 3) + passage + words(8, 4))), (2, " ".join(passage)), (3, " ".join(words(7, 5) + passage + words(90, 6))), (4, " ".join(words(500, 7))), (5, " ".join(passage[:39])),
        (6, " ".join(long)), (7, " ".join(long)), (7, " ".join(long)), (None, " ".join(words(60, 8) + long[100:200])), (8, None), (9, ""), (10, "y " * 30000), (11, " ".join(words(60, 10) * 2)),
    ]
    docs = documents(rows, extra="start")
    found = suffixes.repeated_passages(docs).collect()
    split = [(d, (t or "").split()) for d, t in rows]
    for r in found:
        assert r.length >= suffixes.PREFIX
        mine = [w[r.start : r.start + r.length] for d, w in split if d == r.doc_id]
        theirs = [w[r.other_start : r.other_start + r.length] for d, w in split if d == r.other_id]
        assert any(a == b and len(a) == r.length for a in mine for b in theirs)
    spans = {}
    for r in found:
        spans.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.length))
        spans.setdefault(r.other_id, set()).update(range(r.other_start, r.other_start + r.length))
    assert spans[1] == set(range(33, 83)) and spans[2] == set(range(50)) and spans[3] == set(range(7, 57))
    assert spans[6] == spans[7] == set(range(400)) and spans[None] == set(range(60, 160)) and spans[11] == set(range(120))
    assert spans.keys().isdisjoint({4, 5, 8, 9})
    assert suffixes.repeated_passages(docs.limit(0)).count() == 0


def test_leaks_tolerate_substitutions(documents, spark):
    item, short, tiny = words(40, 1), words(13, 2), words(7, 3)
    changed = [w if i % 9 != 4 else "changed" for i, w in enumerate(item)]
    broken = [w if i % 2 else f"other{i}" for i, w in enumerate(item)]
    rows = [
        (1, " ".join(words(50, 4) + changed + words(20, 5))), (2, " ".join(broken)), (3, "!! ".join(item).upper()), (4, " ".join(words(90, 6))), (5, " ".join(item[:13])), (6, " ".join(item[:12])),
        (7, " ".join(words(9, 7) + short)), (8, None), (9, ""), (None, " ".join(item)), (10, " ".join(tiny)), (3, "!! ".join(item).upper()), (11, " ".join(item + words(30, 8) + item)),
    ]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short)), (9, " ".join(short)), (3, None), (4, ""), (5, " ".join(tiny))], "item_id bigint, text string")
    docs = documents(rows)
    found = decontaminate.leaks(docs, bench, "_found").collect()
    by = sorted(((r.doc_id, [(x.item_id, x.start, x.stop, x.item_start) for x in r._found]) for r in found), key=repr)
    whole = {1: [(1, 50, 90, 0)], 3: [(1, 0, 40, 0)], 5: [(1, 0, 13, 0)], 7: [(2, 9, 22, 0)], 10: [(5, 0, 7, 0)], None: [(1, 0, 40, 0)], 11: [(1, 0, 40, 0), (1, 70, 110, 0)]}
    assert by == sorted(((d, whole.get(d, [])) for d, _ in rows), key=repr)
    kept = decontaminate.drop_leaking(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 6, 8, 9]
    assert decontaminate.drop_leaking(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_benchmark_in_blocks(documents, spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS_PER_BLOCK", 2)
    bench = spark.createDataFrame([(i, " ".join(words(20, i))) for i in range(7)], "item_id bigint, text string")
    docs = documents([(i, " ".join(words(5, 90 + i) + words(20, i))) for i in range(9)])
    found = {r.doc_id: [x.item_id for x in r["found"]] for r in decontaminate.leaks(docs, bench, "found").collect()}
    assert found == {i: [i] if i < 7 else [] for i in range(9)}


def test_substitutions_at_every_place():
    """Any 1 to 3 substitutions in 13 to 20 tokens: found exactly if some run of 13 tokens or more is 80 % equal."""
    for n in range(13, 21):
        item = decontaminate.tokens(" ".join(words(n, n)))
        around = decontaminate.tokens(" ".join(words(12, 99)))
        for k in (1, 2, 3):
            for places in combinations(range(n), k):
                text = item.copy()
                text[list(places)] = np.arange(k, dtype=np.uint64)
                same = np.ones(n, bool)
                same[list(places)] = False
                runs = [b - a for a in range(n) for b in range(a + 13, n + 1) if 5 * same[a:b].sum() >= 4 * (b - a)]
                found = decontaminate.segments(np.concatenate([around, text, around]), item, 12)
                assert bool(found) == bool(runs), (n, places)
                for start, stop, matched in found:
                    assert stop - start >= 13 and matched == same[start - 12 : stop - 12].sum() and 5 * matched >= 4 * (stop - start)


def test_all_runs_of_a_diagonal():
    item = decontaminate.tokens(" ".join(words(90, 1)))
    text = item.copy()
    text[20:60] = 7
    assert decontaminate.segments(text, item, 0) == [(0, 20, 20), (60, 90, 30)]


def test_changed_third_token_is_a_leak(documents, spark):
    item = words(15, 1)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    docs = documents([(1, " ".join(words(9, 2) + item[:2] + ["changed"] + item[3:] + words(9, 3)))])
    (row,) = decontaminate.leaks(docs, bench, "found").collect()
    assert [(x.item_id, x.start, x.stop, x.item_start, x.matched) for x in row["found"]] == [(1, 9, 24, 0, 14)]


def test_short_benchmark_texts_are_found_whole(documents, spark):
    """Texts too short for a mask count where all their tokens stand in a row; brute force over all places."""
    import random

    rnd = random.Random(3)
    bench = [(1, "One two"), (2, "alpha, beta gamma!"), (3, "zeta"), (4, "a b c d e f g"), (5, "one TWO"), (6, "..."), (7, ""), (8, None), (9, "b b")]
    texts = [" ".join(rnd.choices(["one", "two", "alpha", "beta", "gamma", "a", "b", "c"], k=rnd.randrange(30))) for _ in range(60)]
    texts += [None, "", "zeta", "ZETA.", "x a b c d e f g y", "a b c d e f h", "zetas", "b b b b"]
    found = decontaminate.leaks(documents(list(enumerate(texts))), spark.createDataFrame(bench, "item_id bigint, text string"), "found").collect()
    items = {i: t.lower().replace(",", " ").replace("!", " ").replace(".", " ").split() for i, t in bench if t and i != 5}
    for r in found:
        words = (r.text or "").lower().replace(".", " ").split()
        want = {(i, p, p + len(w)) for i, w in items.items() if w for p in range(len(words) - len(w) + 1) if words[p : p + len(w)] == w}
        got = {(1 if x.item_id == 5 else x.item_id, x.start, x.stop) for x in r.found}
        assert got == want and all(x.matched == x.stop - x.start and x.item_start == 0 for x in r.found)


def maximal_matches(split, least):
    """All (i, a, j, b, length): stretches of two texts that are equal and can't be extended."""
    for i, j in combinations(range(len(split)), 2):
        x, y = split[i], split[j]
        for shift in range(-len(y) + 1, len(x)):
            a = max(0, shift)
            while a < len(x) and a - shift < len(y):
                n = 0
                while a + n < len(x) and a + n - shift < len(y) and x[a + n] == y[a + n - shift]:
                    n += 1
                if n >= least:
                    yield i, a, j, a - shift, n
                a += n + 1


def test_places_of_every_repeat_are_joined(documents):
    """Brute force: the places of every maximal repeat are joined, and every link goes on as long as the texts agree."""
    rnd = random.Random(5)
    base = words(420, 21)
    split = []
    for n in range(26):
        a = rnd.randrange(0, 300)
        part = base[a : a + rnd.randrange(60, 400)]
        for _ in range(rnd.randrange(4)):
            part = part[:]
            part[rnd.randrange(len(part))] = f"changed{rnd.randrange(10**6)}"
        split.append(words(rnd.randrange(40), 100 + n) + part + words(rnd.randrange(40), 200 + n))
    found = suffixes.repeated_passages(documents([(i, " ".join(w)) for i, w in enumerate(split)])).collect()
    matches = set(maximal_matches(split, suffixes.PREFIX))
    for r in found:  # every link is a maximal match
        key = (r.doc_id, r.start, r.other_id, r.other_start, r.length)
        assert key in matches or (*key[2:4], *key[:2], r.length) in matches
    assert len({tuple(r) for r in found}) == len(found)
    links = {}
    for r in found:
        links.setdefault(r.doc_id, []).append((r.start, r.length, r.other_id, r.other_start))
        links.setdefault(r.other_id, []).append((r.other_start, r.length, r.doc_id, r.start))
    for i, a, j, b, n in matches:
        if n < suffixes.LEAST:
            continue
        reached, todo = {(i, a)}, [(i, a)]
        while todo:
            d, at = todo.pop()
            for s, size, o, t in links.get(d, []):
                shared = min(at + n, s + size) - max(at, s)
                place = (o, at - s + t)
                if shared >= suffixes.PREFIX and place not in reached:
                    reached.add(place)
                    todo.append(place)
        assert (j, b) in reached, (i, a, j, b, n)
        for d, at in ((i, a), (j, b)):  # and every word of the place lies in a link
            assert set(range(at, at + n)) <= {x for s, size, _, _ in links[d] for x in range(s, s + size)}


def test_longest_match_is_linked_past_a_shorter_one(documents):
    """Texts 1 and 3 share 500 words, text 2 only the first 300 of them."""
    shared = words(500, 1)
    rows = [(1, words(20, 2) + shared + words(9, 3)), (2, words(4, 4) + shared[:300] + words(90, 5)), (3, words(31, 6) + shared + words(50, 7)), (3, words(31, 6) + shared + words(50, 7))]
    found = {(r.doc_id, r.start, r.length, r.other_id, r.other_start) for r in suffixes.repeated_passages(documents([(d, " ".join(w)) for d, w in rows])).collect()}
    assert (3, 31, 500, 1, 20) in found or (1, 20, 500, 3, 31) in found
    assert any(n == 300 and 2 in (d, o) for d, _, n, o, _ in found)
