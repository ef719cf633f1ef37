import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridfold.llm import base, queries, revisits, urltrie  # noqa: F401
from gridfold.session import stored
from verify import canon

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(base.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = base.QUERIES[name](spark, SF)
    rel = con.execute(base.ORACLES[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon([c[0] for c in rel.description], rel.fetchall())


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("a.example.com/de/x", "allow"), ("/top", "block")]
URLS = [
    None, "", "no scheme", "https://www.Example.NET/en/1?q#f", "http://example.net", "http://example.net/EN/", "x://net?a/b", "http://notnet/en/", "http://a.example.com/de/xyz",
    "http://example.com/de", "http://b.org/fr/", "ftp://org/fr/a://b/", "http://h/top/x", "http:///top", "http://a..net/", "http://exämple.net/en/\n?", "http://net./", "http://u@net:80/", "://net/",
]


def plain_judge(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = []
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h) or not h) and path.startswith(slash + p):
            fit.append((len(rule), rule, verdict))
    return (host, path, *(max(fit)[1:] if fit else (None, "allow")))


@pytest.mark.parametrize("per_trie", [2, 100])
def test_trie_equals_plain_rules(spark, monkeypatch, per_trie):
    monkeypatch.setattr(urltrie, "RULES_PER_TRIE", per_trie)
    rnd = random.Random(4)
    made = ["http://" + ".".join(rnd.choice(["a", "example", "b"]) for _ in range(rnd.randrange(3))) + rnd.choice([".com", ".net", ".org", ""]) + "/" + "/".join(rnd.choice(["de", "en", "x", ""]) for _ in range(3)) for _ in range(80)]
    rows = [(i, u, "own") for i, u in enumerate(URLS + made + made[:3])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urltrie.judge_urls(pages, RULES).collect()}
    assert got == {i: plain_judge(u, RULES) for i, u, _ in rows}
    assert urltrie.judge_urls(pages.limit(0), RULES).count() == 0 and urltrie.judge_urls(pages, []).where("rule is null and verdict = 'allow'").count() == len(rows)
    with pytest.raises(ValueError):
        urltrie.judge_urls(pages, [("a/", "block"), ("a/", "allow")])
    with pytest.raises(ValueError):
        urltrie.judge_urls(pages, [("A.net/", "block"), ("a.net/", "allow")])
    shared = urltrie.SharedTrie(RULES)
    assert shared.trie() is shared.trie()


def test_revisits_equal_plain_search(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(400):
        kind = rnd.choice(["response", "revisit", "request"])
        url = rnd.choice(["http://www.A.com:80/x?b=1&a=2#f", "https://a.com/x?a=2&b=1&utm_source=q", "http://hot.com", "http://hot.com/", "http://hot.com/?", None, "none"])
        tag, time = rnd.choice([None, '"1"', 'W/"1"', '"2"']), rnd.choice([None, "t1", "t2"])
        headers = {k: v for k, v in (("ETag", tag), ("Last-Modified", time), ("Content-Type", f"c{i}"), ("X-Id", str(i)), (f"X-{i % 3}", "y")) if v}
        rows.append((i, kind, url, rnd.choice([None, *range(60)]), headers or None, None if kind == "revisit" else f"body {i}", "own"))
    rows.append((rows[5][0], *rows[5][1:]))
    records = spark.createDataFrame(rows, "record_id bigint, kind string, url string, at bigint, headers map<string,string>, body string, status string")
    canon_url = {u: c for u, c in records.select("url", revisits.canonical_url(F.col("url"))).distinct().collect()}
    assert canon_url["http://www.A.com:80/x?b=1&a=2#f"] == canon_url["https://a.com/x?a=2&b=1&utm_source=q"] == "a.com/x?a=2&b=1" and canon_url["none"] is None
    want = []
    for i, kind, url, at, headers, _, _ in rows:
        if kind != "revisit":
            continue
        own = {k.lower(): v for k, v in (headers or {}).items()}
        earlier = [r for r in rows if r[1] == "response" and canon_url[r[2]] is not None and canon_url[r[2]] == canon_url[url] and None not in (at, r[3]) and r[3] < at]
        if not earlier:
            want.append((i, "missing", None, own, None))
            continue
        best = max(earlier, key=lambda r: (r[3], r[0]))
        full = {k.lower(): v for k, v in (best[4] or {}).items()}
        a, b = (h.get("etag", "").removeprefix("W/") for h in (own, full))
        c, d = own.get("last-modified"), full.get("last-modified")
        status = ("resolved" if a == b else "changed") if a and b else ("resolved" if c == d else "changed") if c and d and not a and not b else "unproven"
        merged = {**full, **{k: v for k, v in own.items() if k not in revisits.KEPT_HEADERS}} if status == "resolved" else own
        want.append((i, status, best[0], merged, best[5] if status == "resolved" else None))
    for slice_rows, hot_rows in ((100_000, 100_000), (10, 5), (1, 1)):
        got = [(r.record_id, r.status, r.response_id, r.headers, r.body) for r in revisits.resolve_revisits(records, slice_rows, hot_rows).collect()]
        assert sorted(map(repr, [(*g[:3], sorted(g[3].items()), g[4]) for g in got])) == sorted(map(repr, [(*w[:3], sorted(w[3].items()), w[4]) for w in want]))
    assert revisits.resolve_revisits(records.limit(0)).count() == 0


def test_revisits_of_a_burst_and_an_outlying_time(spark, monkeypatch):
    """One URL, nearly all of it within a short time, one record far away: every slice stays small."""
    rows = [(i, "response" if i % 3 else "revisit", "http://hot.com/", 10**9 if i == 0 else i, {"ETag": str(i // 50)}, f"b{i}") for i in range(3000)]
    rows += [(5000 + i, "revisit", "http://hot.com/", 700, {"ETag": "13"}, None) for i in range(500)]
    records = spark.createDataFrame(rows, "record_id bigint, kind string, url string, at bigint, headers map<string,string>, body string")
    sizes = []
    keep = revisits.Window.partitionBy

    def noted(*keys):
        sizes.append(keys)
        return keep(*keys)

    monkeypatch.setattr(revisits.Window, "partitionBy", noted)
    got = {r.record_id: (r.status, r.response_id, r.body) for r in revisits.resolve_revisits(records, 100, 50).collect()}
    assert sizes == [("canonical",), ("canonical", "slice")] and len(got) == 1500
    for i, kind, _, at, headers, _ in rows:
        if kind == "revisit":
            best = max((r for r in rows if r[1] == "response" and r[3] < at), key=lambda r: r[3], default=None)
            same = best is not None and best[4] == headers
            assert got[i] == (("resolved", best[0], best[5]) if same else ("missing", None, None) if best is None else ("changed", best[0], None))


def test_revisits_of_equal_record_ids(spark):
    rows = [(1, "response", "http://a/x", 10, {"ETag": "p"}, "first"), (1, "response", "http://a/x", 20, {"ETag": "q"}, "second"), (1, "response", "http://b/", 5, {"ETag": "q"}, "third")]
    rows += [(2, "revisit", "http://a/x", 15, {"ETag": "p"}, None), (3, "revisit", "http://a/x", 25, {"ETag": "q"}, None), (4, "revisit", "http://b/", 25, {"ETag": "q"}, None)]
    records = spark.createDataFrame(rows, "record_id bigint, kind string, url string, at bigint, headers map<string,string>, body string")
    assert {r.record_id: r.body for r in revisits.resolve_revisits(records).collect()} == {2: "first", 3: "second", 4: "third"}


def test_pipeline_stages(spark):
    docs = base.table(spark, SF, "documents")
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string")).union(docs.limit(2).withColumn("text", F.lit(""))).union(docs.limit(2))
    now = docs.union(odd).withColumn("leaks", F.lit("own"))
    before = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, now.limit(0), SF).count() == 0, name
        after = stage(spark, now, SF)
        assert after.columns == before, name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in now.select("doc_id").collect()} and ids, name
        now = stored(after, name)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids


def test_pipeline_run_keeps_clean_documents(spark):
    out = corpus_pipeline.run(spark, SF)
    bad = base.table(spark, SF, "labels").where("quality = 0").join(out, "doc_id", "left_semi").count()
    good = base.table(spark, SF, "labels").where("quality = 1")
    kept = good.join(out, "doc_id", "left_semi").count()
    assert bad <= 1 and kept >= 0.7 * good.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "leaks", "secrets", "packing"] and corpus_pipeline.ORACLE_SQL is None
