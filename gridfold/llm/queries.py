"""One query per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.llm import alignment, bilinear, decontaminate, fingerprints, markov, neighbours, packing, revisits, simhash, spelling, suffixes, urltrie, windows
from gridfold.llm.base import query, table

#: The rules that the url query applies.
URL_RULES = [("net/", urltrie.BLOCK), ("example.net/en/", urltrie.ALLOW), ("example.com/de/", urltrie.BLOCK), ("org/fr/", urltrie.ALLOW)]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_packing")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op2_decontamination")
def leaking(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of ``pages``: each page is a response, and is asked for again some time later."""
    pages = table(spark, sf_dir, "pages")
    n = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.sha2("html", 256), 1, 16), F.lit('"'))
    tag = F.when(n % 7 != 0, tag)
    changed = F.when(n % 35 != 0, F.concat(F.lit("t"), (n % 5).cast("string")))
    url = F.regexp_replace("url", "/[0-9]+", F.concat(F.lit("/"), (n % 20).cast("string")))
    later = n * 10 + (n % 50) * 100 + 5

    def headers(*pairs):
        given = F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v for _, v in pairs]))
        return F.map_filter(given, lambda _, v: v.isNotNull())

    first = headers(
        ("ETag", tag), ("Last-Modified", changed), ("Content-Type", F.lit("text/html")), ("Content-Length", F.octet_length(F.encode("html", "utf-8")).cast("string")),
        ("Cache-Control", F.lit("max-age=60")), ("Date", (n * 10).cast("string")),
    )
    again = headers(
        ("etag", F.concat(F.lit("W/"), tag)), ("last-modified", changed), ("content-length", F.lit("0")), ("cache-control", F.concat(F.lit("max-age="), (n % 100).cast("string"))),
        ("date", later.cast("string")), ("x-cache", F.lit("hit")),
    )
    full = pages.select((n * 2).alias("record_id"), F.lit("response").alias("kind"), url.alias("url"), (n * 10).alias("at"), first.alias("headers"), F.col("html").alias("body"))
    asked = pages.select(
        (n * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.concat(url, F.lit("#again")).alias("url"), later.alias("at"),
        again.alias("headers"), F.lit(None).cast("string").alias("body"),
    )
    return full.union(asked)


@query(
    "op3_revisits",
    r"""
WITH p AS (SELECT page_id AS n, html, regexp_replace(url, '/[0-9]+', '/' || (page_id % 20), 'g') AS url,
    CASE WHEN page_id % 7 <> 0 THEN '"' || substr(sha256(html), 1, 16) || '"' END AS tag,
    CASE WHEN page_id % 35 <> 0 THEN 't' || (page_id % 5) END AS changed FROM pages),
s AS (SELECT *, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)', 1) AS h0,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)', 2) AS p0,
    regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q0 FROM p),
u AS (SELECT *, array_to_string(list_sort(list_filter(string_split(q0, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS q FROM s),
c AS (SELECT *, regexp_replace(regexp_replace(lower(h0), ':(80|443)$', ''), '^www\.', '') || (CASE WHEN p0 = '' THEN '/' ELSE p0 END)
    || (CASE WHEN q = '' THEN '' ELSE '?' || q END) AS canonical FROM u),
r AS (SELECT n * 2 + 1 AS record_id, canonical, n * 10 + (n % 50) * 100 + 5 AS t, tag, changed, n FROM c),
l AS (SELECT r.record_id, max(c.n) AS f FROM r JOIN c ON c.canonical = r.canonical AND c.n * 10 < r.t GROUP BY r.record_id),
j AS (SELECT r.*, l.f, o.tag AS otag, o.changed AS ochanged, o.html, CASE WHEN l.f IS NULL THEN 'missing'
    WHEN r.tag IS NOT NULL AND o.tag IS NOT NULL THEN CASE WHEN r.tag = o.tag THEN 'resolved' ELSE 'changed' END
    WHEN r.tag IS NULL AND o.tag IS NULL AND r.changed IS NOT NULL AND o.changed IS NOT NULL
    THEN CASE WHEN r.changed = o.changed THEN 'resolved' ELSE 'changed' END ELSE 'unproven' END AS status
    FROM r LEFT JOIN l USING (record_id) LEFT JOIN c o ON o.n = l.f)
SELECT record_id, canonical, t AS "at", status, f * 2 AS response_id,
  'cache-control: max-age=' || (n % 100) || CASE WHEN status = 'resolved' THEN '|content-length: ' || strlen(html) || '|content-type: text/html' ELSE '|content-length: 0' END
  || '|date: ' || t || CASE WHEN tag IS NOT NULL THEN '|etag: W/' || tag ELSE '' END
  || CASE WHEN changed IS NOT NULL THEN '|last-modified: ' || changed WHEN status = 'resolved' AND ochanged IS NOT NULL THEN '|last-modified: ' || ochanged ELSE '' END
  || '|x-cache: hit' AS headers,
  CASE WHEN status = 'resolved' THEN sha256(html) END AS body_sha256 FROM j""",
)
def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve_revisits(archive(spark, sf_dir))
    lines = F.array_join(F.sort_array(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "|")
    return found.select("record_id", "canonical", "at", "status", "response_id", lines.alias("headers"), F.sha2("body", 256).alias("body_sha256"))


@query("op4_suffixes")
def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


@query(
    "op5_url_filter",
    r"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(rule, h, p, v) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM u JOIN r
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)""",
)
def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urltrie.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op6_quality")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    space = neighbours.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = neighbours.score(docs, space)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_fingerprints")
def fingerprinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.compared_with_edited(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprints.as_text(F.col("fingerprint")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


@query("op8_secrets")
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markov.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # A filter function with a second parameter, default or not, is given the position there.
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(markov.KINDS[:3])]
    base = F.sha2(markov.spans_text(F.col("base_spans")), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, markov.spans_text(F.col("spans")).alias("spans"))


@query(
    "op9_windows",
    r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT k, min(doc_id) AS m FROM h GROUP BY k),
r AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT h.doc_id, h.i, unnest(range(0, 13)) AS j FROM h JOIN f USING (k) WHERE h.doc_id > f.m)),
o AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT o.doc_id, count(*) AS n, string_agg(o.v, ' ' ORDER BY o.i) AS t FROM o ANTI JOIN r ON o.doc_id = r.doc_id AND o.i = r.i GROUP BY o.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
)
def without_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = windows.drop_repeated_windows(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_simhash")
def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op11_spelling")
def spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(table(spark, sf_dir, "documents"), dropped=199)
    return spelling.spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


@query("op12_lm_scores")
def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bilinear.score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 10 == 0)


@query("op13_alignment")
def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.aligned_documents(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
