"""Name an intermediate value inside one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]
