"""Dataset ids and names, for columns and for driver options."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridfold.functions.binding import let


def dataset_id(url: Column) -> Column:
    """Rolling 32-bit hash ``h*31+c`` over the UTF-16 code units, absolute value in hex."""
    digits = F.hex(F.encode(url, "UTF-16BE"))
    number = lambda d, i: F.conv(F.substring(d, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint")
    units16 = let(digits, lambda d: F.transform(F.array_repeat(F.lit(0), (F.length(d) / 4).cast("int")), lambda _, i: number(d, i)))

    def step(h: Column, c: Column) -> Column:
        return F.pmod(h * 31 + c + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)

    h = F.aggregate(units16, F.lit(0).cast("bigint"), step)
    return F.concat(F.lit("dataset_"), F.lower(F.hex(F.abs(h))))


def slug_column(name: Column) -> Column:
    """Lower case, runs of other characters to ``_``, trimmed, at most 60 characters; NULL when empty."""
    s = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_")
    s = F.substring(F.regexp_replace(s, "^_+|_+$", ""), 1, 60)
    return F.when(s != "", s)


def slugify(name: str) -> str:
    slug = re.sub(r"^_+|_+$", "", re.sub(r"[^a-z0-9]+", "_", name.lower()))[:60]
    if not slug:
        raise ValueError(f"'{name}' has no characters usable in an id")
    return slug


def dataset_name(url: Column) -> Column:
    """Last path segment without its extension, else the host, else the first 30 characters."""
    path = F.try_parse_url(url, F.lit("PATH"))
    host = F.try_parse_url(url, F.lit("HOST"))
    segments = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: p != "")
    last = F.regexp_replace(F.element_at(segments, -1), r"\.[^/.]+$", "")
    valid = url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & host.isNotNull()
    return F.when(valid & (F.size(segments) > 0), last).when(valid, host).otherwise(F.substring(url, 1, 30))
