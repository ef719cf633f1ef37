"""Properties text: access, keys, merge, typing."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def json_value(properties: Column, path: str) -> Column:
    """Text of the value at a (possibly nested) path; JSON null gives NULL."""
    return F.get_json_object(properties, f"$.{path}")


def json_member(properties: Column, key: str) -> Column:
    """Text of the top-level member with exactly this key, whatever characters it has."""
    if "'" not in key:
        return F.get_json_object(properties, f"$['{key}']")
    return F.from_json(properties, "map<string,string>")[key]


def json_keys(properties: Column) -> Column:
    return F.json_object_keys(properties)


def merge_properties(target: Column, source: Column) -> Column:
    """JSON merge patch on the top level: source wins, a null in source removes the key.

    Nested objects are replaced as a whole.  A NULL source leaves target as it is.
    """
    schema = "map<string,variant>"
    patch = F.from_json(source, schema)
    base = F.coalesce(F.from_json(target, schema), F.from_json(F.lit("{}"), schema))
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(patch, k))
    added = F.map_filter(patch, lambda k, v: ~F.is_variant_null(F.coalesce(v, F.parse_json(F.lit("null")))))
    return F.when(source.isNull(), target).otherwise(F.to_json(F.map_concat(kept, added)))


def typed_json(columns: list[str]) -> Column:
    """JSON object of text columns where each value that is a number becomes a JSON number.

    The rule looks at single values, so one column may hold numbers and text.
    """
    def entry(name: str) -> Column:
        text = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
        whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
        return (
            F.when(number.isNull(), text.cast("variant"))
            .when(whole, number.cast("bigint").cast("variant"))
            .otherwise(number.cast("variant"))
        )

    if not columns:
        return F.lit("{}")
    pairs = [part for name in columns for part in (F.lit(name), entry(name))]
    return F.to_json(F.create_map(*pairs))


def install_aliases(spark: SparkSession) -> None:
    """``json_extract_string`` as a SQL name, so raw predicates over properties run unchanged."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION json_extract_string(j STRING, p STRING) RETURNS STRING "
        "RETURN get_json_object(j, p)"
    )
