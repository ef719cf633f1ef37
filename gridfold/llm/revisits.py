"""Not-modified revisits of a web archive: as-of join to the latest earlier full response.

A revisit record has no body.  It takes that of the latest earlier response of its canonical URL if
the validators agree, and that response's headers, renewed by those that a 304 may change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfold.plans.skew import hot_limit, spread
from gridfold.session import stored

RESPONSE, REVISIT = "response", "revisit"
RESOLVED, CHANGED, UNPROVEN, MISSING = "resolved", "changed", "unproven", "missing"
#: Header fields that describe one message or its body and that a 304 doesn't renew.
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Times of one URL that are ordered in one group; a longer history (and one over a thousandth of all) is cut into slices.
SLICE_ROWS = 20_000
#: Quantiles taken of a hot URL's times; it is cut at as many of them as it needs.
CUTS = 1024
_URL = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """Host, path and query without scheme, ``www.``, default port, fragment and ``utm_`` parameters.

    Host in lower case, an empty path is ``/``, parameters are sorted.  Null for null and for what has no ``://``.
    """
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 2)), ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_extract(url, _URL, 3)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    parts = F.filter(F.split(F.regexp_extract(url, _URL, 4), "&"), lambda p: (p != "") & ~p.startswith("utm_"))
    query = F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(F.sort_array(parts), "&"))).otherwise(F.lit(""))
    return F.when(url.rlike(_URL), F.concat(host, path, query))


def _etag(value: Column) -> Column:
    """Weak comparison: the mark of weak tags doesn't count."""
    return F.regexp_replace(value, "^W/", "")


def merge_headers(stored_headers: Column, renewed: Column) -> Column:
    """Stored header fields, replaced and added to by those of a 304 that it may renew.  Names are lower case."""
    lower = lambda m: F.transform_keys(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    allowed = F.map_filter(lower(renewed), lambda k, _: ~k.isin(*KEPT_HEADERS))
    rest = F.map_filter(lower(stored_headers), lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(rest, allowed)


def latest_earlier(records: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``canonical, at, found`` for every URL and time of a revisit: ``at, record_id, etag, modified`` of the latest
    response strictly before (of equal times the largest ``record_id``), or null.

    Equal times of a URL are one row before anything is ordered.  A URL with more than ``slice_rows`` times (and a
    thousandth of all) is cut at quantiles of its own times, so no slice grows with a burst or an outlying time; over slices
    only one row each is carried on.  The cut points of all such URLs are a few thousand numbers, and are broadcast.
    """
    full = F.when(F.col("kind") == RESPONSE, F.struct("at", "record_id", "etag", "modified"))
    rows = records.where(F.col("canonical").isNotNull() & F.col("at").isNotNull())
    times = rows.groupBy("canonical", "at").agg(F.max(full).alias("full"), F.bool_or(F.col("kind") == REVISIT).alias("asked"))
    times = stored(times, "times")
    limit = hot_limit(times.count(), slice_rows)
    hot = times.groupBy("canonical").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    cuts = times.join(F.broadcast(hot), "canonical").groupBy("canonical").agg(
        F.first("n").alias("n"), F.percentile_approx("at", [i / CUTS for i in range(1, CUTS)], 20 * CUTS).alias("all")
    )
    step = F.greatest(F.lit(1), F.floor(F.lit(CUTS) * limit / F.col("n")))
    cuts = cuts.select("canonical", F.filter("all", lambda _, i: (i + 1) % step == 0).alias("cuts"))
    sliced = times.join(F.broadcast(cuts), "canonical", "left")
    place = F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("at"))), F.lit(0))
    sliced = sliced.withColumn("slice", F.when(F.col("cuts").isNull(), 0).otherwise(place)).drop("cuts")
    carried = sliced.groupBy("canonical", "slice").agg(F.max("full").alias("newest"))
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select("canonical", "slice", F.last("newest", ignorenulls=True).over(before).alias("carried"))
    order = Window.partitionBy("canonical", "slice").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    within = sliced.withColumn("within", F.last("full", ignorenulls=True).over(order)).where("asked")
    return within.join(carried, ["canonical", "slice"], "left").select("canonical", "at", F.coalesce("within", "carried").alias("found"))


def resolve_revisits(records: DataFrame, slice_rows: int = SLICE_ROWS, hot_rows: int = SLICE_ROWS) -> DataFrame:
    """``record_id, canonical, at, status, response_id, headers, body`` for every revisit of ``records``.

    ``records``: ``record_id`` (long), ``kind`` (``response`` or ``revisit``; other kinds are ignored), ``url``, ``at``
    (long), ``headers`` (map), ``body``.  ``status``: ``resolved`` if the entity tags agree (weakly), or
    without a tag on either side the times of last change; ``changed`` if they differ; ``unproven`` if there is nothing to
    compare; ``missing`` without an earlier response, which holds for null urls and times.  Only
    resolved revisits have a body and the merged headers; others keep their own.  Repeated revisits
    give repeated rows; responses that share ``record_id``, URL, time and validators are one capture, of which one is taken.

    Times and validators alone are ordered; headers and bodies are joined to the result afterwards.  Revisits of one
    moment, and those of one response, are dealt over salts where there are more than ``hot_rows`` (and a thousandth of all).
    """
    lower = F.transform_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    keyed = records.where(F.col("kind").isin(RESPONSE, REVISIT)).select("record_id", "kind", "at", canonical_url(F.col("url")).alias("canonical"), lower.alias("headers"), "body")
    keyed = keyed.withColumns({"etag": _etag(F.col("headers")["etag"]), "modified": F.col("headers")["last-modified"]})
    latest = latest_earlier(keyed.select("record_id", "kind", "at", "canonical", "etag", "modified"), slice_rows)
    revisits = keyed.where(F.col("kind") == REVISIT).drop("kind", "body")
    placed = F.col("canonical").isNotNull() & F.col("at").isNotNull()
    n = revisits.count()
    left, right, keys, _ = spread(revisits.where(placed), latest, ["canonical", "at"], F.col("record_id"), F.col("at"), n, 0, hot_rows)
    asked = left.join(right, keys, "left").drop(*[k for k in keys if k not in ("canonical", "at")])
    asked = asked.unionByName(revisits.where(~placed), allowMissingColumns=True)
    tags = F.col("etag").isNotNull() & F.col("found.etag").isNotNull()
    times = F.col("modified").isNotNull() & F.col("found.modified").isNotNull() & F.col("etag").isNull() & F.col("found.etag").isNull()
    status = F.when(F.col("found").isNull(), MISSING).when(tags, F.when(F.col("etag") == F.col("found.etag"), RESOLVED).otherwise(CHANGED))
    status = status.when(times, F.when(F.col("modified") == F.col("found.modified"), RESOLVED).otherwise(CHANGED)).otherwise(UNPROVEN)
    asked = stored(asked.select("record_id", "canonical", "at", status.alias("status"), "found", "headers"), "asked")
    resolved = asked.where(F.col("status") == RESOLVED).withColumn("capture", _capture("found.record_id", "canonical", "found.at", "found.etag", "found.modified"))
    full = keyed.where(F.col("kind") == RESPONSE).select(
        _capture("record_id", "canonical", "at", "etag", "modified").alias("capture"), F.col("headers").alias("full_headers"), "body"
    )
    left, right, keys, _ = spread(resolved, full, ["capture"], F.col("record_id"), F.col("capture"), n, 0, hot_rows)
    # One of equal captures a key: the exchange for this is the one of the join, so bodies are shuffled once.
    right = right.dropDuplicates(keys)
    columns = ["record_id", "canonical", "at", "status", F.col("found.record_id").alias("response_id")]
    done = left.join(right, keys).select(*columns, merge_headers(F.col("full_headers"), F.col("headers")).alias("headers"), "body")
    rest = asked.where(F.col("status") != RESOLVED).select(*columns, "headers", F.lit(None).cast(records.schema["body"].dataType).alias("body"))
    return done.unionByName(rest)


def _capture(*columns: str) -> Column:
    """Identity of a response; nulls of the validators stay apart from every text."""
    return F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]))
