"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame functions only.

A sketch is an ascending array of the ``k`` least distinct 64-bit shingle hashes.  Sketches of parts
merge into that of the whole, and two sketches estimate resemblance, containment and counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfold.llm.base import bind, whole_text

WIDTH, K = 5, 64
#: Rows of one bucket of the order by id.
BUCKET = 2000
_SPACE = "[ \\t-\\r]+"


def sketch(text: Column, width: int = WIDTH, k: int = K) -> Column:
    """Bottom-k sketch of the word shingles of ``text``.

    The first words are shingled with blanks before them, so each word ends one shingle and a text
    shorter than ``width`` words has a sketch too.  No word (null, blank): an empty sketch.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")
    padded = F.concat(F.array_repeat(F.lit(""), width - 1), words)
    hashes = bind(padded, lambda p: F.transform(F.slice(p, 1, F.size(p) - (width - 1)), lambda _, i: F.xxhash64(*[F.get(p, i + j) for j in range(width)])))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of both (0 to 1); two empty sketches: 1."""
    union = merge(a, b, k)
    return bind(union, lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else from the k-th least hash."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too (0 to 1); empty ``a``: 1."""
    common = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def merged(sketches: DataFrame, keys: list[str], column: str = "fingerprint", k: int = K) -> DataFrame:
    """One sketch per group of ``keys``, of all its parts.

    Hashes are made distinct under (keys, hash) and ranks above ``k`` go before the last shuffle, so a
    group with any number of parts sends at most ``k`` rows per task.  Groups of empty sketches are absent.
    """
    rows = sketches.select(*keys, F.explode(column).alias("_hash")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))
    least = rows.withColumn("_rank", rank).where(F.col("_rank") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(column))


def as_text(a: Column) -> Column:
    """16 lower-case hex digits per hash."""
    return F.concat_ws("", F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")))


def with_next(rows: DataFrame, carried: list[str], bucket: int = BUCKET) -> DataFrame:
    """``rows`` with ``next_<c>`` for each carried column: that of the next row by descending
    ``doc_id`` (null last; ties by the row's own hash), after the last row of the first.

    Buckets are ranges of ids between approximate quantiles, which are ids themselves, so the row
    that follows a bucket is known by its id: it is sent to both buckets.  No bucket is the whole table.
    """
    least = F.lit(-(2**63)).cast("long")
    keyed = rows.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), least))
    n = keyed.count()
    parts = max(1, min(-(-n // bucket), 10_000))
    shares = [(i + 1) / parts for i in range(parts)]
    found = keyed.agg(F.percentile_approx("_key", shares, 10 * parts).alias("q"), F.max("_key").alias("top")).first()
    bounds = sorted({*(found["q"] or []), *([found["top"]] if n else [])})
    step = max(1, round(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[0]]
    below = F.array(*[F.lit(b[-1]).cast("long") for b in blocks])
    inner = F.array(*[F.array(*[F.lit(x).cast("long") for x in b]) for b in blocks])
    coarse = F.size(F.filter(below, lambda x: x < F.col("_key")))
    number = bind(coarse, lambda c: c * step + F.size(F.filter(F.coalesce(F.get(inner, c), F.array().cast("array<long>")), lambda x: x < F.col("_key"))))
    keyed = keyed.withColumn("_bucket", number)
    ends = F.array_contains(F.get(inner, F.floor(F.col("_bucket") / step).cast("int")), F.col("_key"))
    here = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("sent"))
    there = F.struct(F.pmod(F.col("_bucket") + 1, F.lit(max(1, len(bounds)))).alias("b"), F.lit(True).alias("sent"))
    both = keyed.withColumn("_at", F.explode(F.when(ends, F.array(here, there)).otherwise(F.array(here))))
    order = Window.partitionBy("_at.b").orderBy("_at.sent", F.desc("_key"), F.xxhash64(*carried))
    return both.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).where("not _at.sent").drop("_key", "_bucket", "_at")


def fingerprinted(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """``doc_id, text, fingerprint, next_text, next_fingerprint`` for every row of ``docs``.

    Null texts count as empty.  Rows of equal id are ordered by a hash of their text.  Other columns
    are ignored; an empty table gives an empty one; a single row is its own next.
    """
    base = docs.select("doc_id", whole_text(docs).alias("text"))
    return with_next(base.withColumn("fingerprint", sketch(F.col("text"), width, k)), ["text", "fingerprint"])


def compared_with_edited(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """Fingerprints of texts and of their edited texts: ``doc_id, n_chars, text, edited, fingerprint,
    edited_fingerprint, near_edited, near_next``.

    The edited text has its last third replaced by as many first characters of the next document.
    """
    rows = fingerprinted(docs, width, k).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))
    rows = rows.withColumn("edited", edited).withColumn("edited_fingerprint", sketch(F.col("edited"), width, k))
    a = F.col("fingerprint")
    near = {"near_edited": resemblance(a, F.col("edited_fingerprint"), k), "near_next": resemblance(a, F.col("next_fingerprint"), k)}
    return rows.withColumns(near).drop("next_text", "next_fingerprint")
