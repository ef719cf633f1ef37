"""Secret scans: base patterns, and character Markov models of random strings and ordinary words.

Two first-order models over the printable ASCII characters give the log-likelihood ratio of each long
token; tokens that look random by it are further spans.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.llm.base import bind, whole_text

#: Kinds in their order, patterns and least sizes of the base rules.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 and more characters: what follows AKIA is taken whole, so the size can stand in the pattern
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12

TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"[A-Za-z0-9+/_=-]{4,}"
#: Nats per character pair above which a token counts as random.
THRESHOLD = 0.5
SYMBOLS = 128
#: Weight, in counts, of the single characters in the estimate of a pair.
BACK = 20.0
SPAN = "struct<start:int,kind:int,stop:int,value:string>"


def _found(text: Column, pattern: str, kind: int) -> Column:
    """Spans of all matches (code points, end exclusive): pieces between the matches give the positions."""
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    pieces = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.char_length(pair["p"])
        stop = begin + F.char_length(pair["m"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), pair["m"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    pairs = F.filter(F.arrays_zip(pieces.alias("p"), matches.alias("m")), lambda x: x["m"].isNotNull())
    return F.aggregate(pairs, start, step, lambda acc: acc["spans"])


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def base_spans(text: Column) -> Column:
    """Spans of the base rules by start, then kind.  A failing assignment still uses up its characters."""
    long_enough = lambda s: F.char_length(F.regexp_extract(s["value"], f"^{ASSIGN}$", 2)) >= ASSIGN_LEAST
    may_assign = text.contains("=") | text.contains(":")
    assign = F.when(may_assign & text.rlike(ASSIGN), F.filter(_found(text, ASSIGN, 0), long_enough)).otherwise(_none())
    access = F.when(text.contains("AKIA"), _found(text, ACCESS, 1)).otherwise(_none())
    hexes = F.when(text.rlike(HEX), _found(text, HEX, 2)).otherwise(_none())
    return F.sort_array(F.concat(assign, access, hexes))


def _secret(span: Column) -> Column:
    """The secret part of a finding: of an assignment its value."""
    return F.when(span["kind"] == 0, F.regexp_extract(span["value"], f"^{ASSIGN}$", 2)).otherwise(span["value"])


def pair_counts(samples: DataFrame) -> DataFrame:
    """``samples``: ``token``, ``random`` (boolean).  Counts of character pairs: ``random, pair, n``.

    Equal tokens are taken apart once and weigh as often as they occur.
    """
    samples = samples.groupBy("random", "token").agg(F.count("*").alias("n"))
    points = F.transform(F.split("token", ""), lambda c: F.ascii(c))
    pairs = F.transform(F.sequence(F.lit(1), F.char_length("token") - 1), lambda i: F.get("points", i - 1) * SYMBOLS + F.get("points", i))
    rows = samples.where(F.char_length("token") > 1).withColumn("points", points).select("random", "n", F.explode(pairs).alias("pair"))
    return rows.where(F.col("pair").between(0, SYMBOLS * SYMBOLS - 1)).groupBy("random", "pair").agg(F.sum("n").alias("n"))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio per character pair, from labelled samples.

    A pair that a model has seldom seen falls back on how often its second character occurs.  What comes to the
    driver is at most ``2 * SYMBOLS ** 2`` counts.  Without samples of a kind its model is uniform.
    """
    counts: list[dict[int, int]] = [{}, {}]
    for row in pair_counts(samples).collect():
        counts[row["random"]][row["pair"]] = row["n"]
    logs = []
    for seen in counts:
        firsts, seconds = {}, {}
        for pair, n in seen.items():
            firsts[pair // SYMBOLS] = firsts.get(pair // SYMBOLS, 0) + n
            seconds[pair % SYMBOLS] = seconds.get(pair % SYMBOLS, 0) + n
        total = sum(seconds.values())
        single = [(seconds.get(c, 0) + 1) / (total + SYMBOLS) for c in range(SYMBOLS)]
        logs.append([math.log((seen.get(p, 0) + BACK * single[p % SYMBOLS]) / (firsts.get(p // SYMBOLS, 0) + BACK)) for p in range(SYMBOLS * SYMBOLS)])
    return [r - o for r, o in zip(logs[1], logs[0])]


def labelled_samples(docs: DataFrame) -> DataFrame:
    """Random strings: the distinct values that base rules find in ``docs``.  Ordinary: the words outside
    base findings of all ``docs`` (equal texts count once)."""
    texts = docs.select(whole_text(docs).alias("text"))
    hits = texts.withColumn("spans", base_spans(F.col("text"))).where(F.size("spans") > 0)
    random = hits.select(F.explode("spans").alias("s")).select(_secret(F.col("s")).alias("token"), F.lit(True).alias("random")).distinct()
    once = texts.withColumn("mark", F.xxhash64("text")).dropDuplicates(["mark"])
    words = F.explode(F.regexp_extract_all(F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " "), F.lit(WORD), 0))
    return random.union(once.select(words.alias("token"), F.lit(False).alias("random")))


def random_spans(text: Column, ratios: list[float], base: Column, threshold: float = THRESHOLD) -> Column:
    """Spans of long tokens whose mean ratio per character pair is over ``threshold`` and that no base span touches."""
    # One text literal, which the optimizer folds into an array: thousands of literals would swell the plan.
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in ratios)), ",").cast("array<double>")

    def mean(token: Column) -> Column:
        points = F.transform(F.split(token, ""), lambda c: F.ascii(c))
        total = lambda p: F.aggregate(
            F.sequence(F.lit(1), F.char_length(token) - 1), F.lit(0.0), lambda acc, i: acc + F.coalesce(F.get(table, F.get(p, i - 1) * SYMBOLS + F.get(p, i)), F.lit(0.0))
        )
        return bind(points, total) / (F.char_length(token) - 1)

    def wanted(span: Column) -> Column:
        free = ~F.exists(base, lambda b: (b["start"] < span["stop"]) & (span["start"] < b["stop"]))
        return free & (mean(span["value"]) > threshold)

    return F.when(text.rlike(TOKEN), F.filter(_found(text, TOKEN, 3), wanted)).otherwise(_none())


def scan(docs: DataFrame, ratios: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans`` (base ones and those of the models, by start, then kind).

    Spans are ``start, kind, stop, value``; kinds are numbered as in ``KINDS``.  ``ratios`` are the trained
    log-likelihood ratios, by default learnt from ``docs`` itself.  Null and empty texts have no spans.
    """
    ratios = train(labelled_samples(docs)) if ratios is None else ratios
    text = whole_text(docs)
    based = docs.withColumn("base_spans", base_spans(text))
    more = random_spans(whole_text(based), ratios, F.col("base_spans"), threshold)
    return based.withColumn("spans", F.sort_array(F.concat("base_spans", more)))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])))


def mask_secrets(docs: DataFrame, ratios: list[float] | None = None, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mask`` (overlapping spans by one) and ``n_chars`` renewed.

    Rows without spans stay as they are, null texts too.  The columns are those of ``docs``.
    """
    found = scan(docs, ratios).withColumn("_text", whole_text(docs))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substring("_text", acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], between, F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), out.alias("out"))

    def rest(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring("_text", acc["at"] + 1, F.char_length("_text")))

    masked = F.when(F.size("spans") > 0, F.aggregate("spans", start, step, rest)).otherwise(F.col("text"))
    out = found.withColumn("text", masked)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
