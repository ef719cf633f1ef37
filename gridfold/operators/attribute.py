"""Filters on properties, and properties as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.functions.props import install_aliases, json_member, json_value

OPERATORS = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}


def attribute(
    df: DataFrame,
    property: str | None = None,
    operator: str = "=",
    value: str | float | int | None = None,
    where: str | None = None,
) -> DataFrame:
    """Rows whose property compares true, or for which the SQL predicate ``where`` holds.

    A number compares the property as DOUBLE, a text compares it as text.  A
    missing property, or one that is no number, never matches.
    """
    if where is not None:
        install_aliases(df.sparkSession)
        return df.where(where)
    if property is None or value is None:
        raise ValueError("attribute: needs property and value, or where")
    if operator not in OPERATORS:
        raise ValueError(f"attribute: operator must be one of {sorted(OPERATORS)}")
    text = json_value(F.col("properties"), property)
    numeric = isinstance(value, (int, float)) and not isinstance(value, bool)
    left = text.try_cast("double") if numeric else text
    return df.where(OPERATORS[operator](left, F.lit(float(value) if numeric else str(value))))


def flatten(df: DataFrame, keys: list[str], geometry: str | None = "geom") -> DataFrame:
    """One text column per property key, after the geometry column when one is named."""
    lead = [F.col(geometry)] if geometry else []
    return df.select(*lead, *[json_member(F.col("properties"), k).alias(k) for k in keys])
