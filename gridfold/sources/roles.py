"""Which columns of a table hold coordinates or geometry."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.functions.geomtext import is_geojson, is_wkt, parse_geometry
from gridfold.functions.measure import point

# Column names read as latitude, longitude, combined position and geometry text.
LAT_NAMES = ["lat", "latitude", "y", "lat_y", "point_y", "ylat", "coordy"]
LNG_NAMES = ["lng", "lon", "long", "longitude", "x", "lng_x", "lon_x", "point_x", "xlong", "coordx"]
PAIR_NAMES = [
    "googlemapdest", "geo_point_2d", "latlng", "lat_lng", "latlong",
    "coordinates", "location", "geolocation", "geo_point", "point",
]
GEOMETRY_NAMES = ["geometry", "geom", "wkt", "the_geom", "shape"]

_LEADING_NUMBER = r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"


def _named(columns: list[str], names: list[str]) -> list[str]:
    by_lower = {c.lower(): c for c in columns}
    return [by_lower[n] for n in names if n in by_lower]


def position_columns(columns: list[str], lat: str | None = None, lng: str | None = None) -> tuple[str, str]:
    """Latitude and longitude column: both as given, or the first known names, case-insensitive."""
    if lat and lng:
        for role, name in (("lat", lat), ("lng", lng)):
            if name not in columns:
                raise ValueError(f"{role} column '{name}' not found in {columns}")
        return lat, lng
    found_lat, found_lng = _named(columns, LAT_NAMES), _named(columns, LNG_NAMES)
    if not found_lat or not found_lng:
        raise ValueError(f"no coordinate columns among {columns}")
    return found_lat[0], found_lng[0]


def number_prefix(text: Column) -> Column:
    """The number a text starts with, NULL when there is none."""
    return F.nullif(F.regexp_extract(text, _LEADING_NUMBER, 1), F.lit("")).try_cast("double")


def pair(text: Column) -> Column:
    """Point from ``"lat, lng"`` text, NULL unless there are exactly two numbers."""
    parts = F.split(text, ",")
    lat, lng = number_prefix(F.get(parts, F.lit(0))), number_prefix(F.get(parts, F.lit(1)))
    return F.when((F.size(parts) == 2) & lat.isNotNull() & lng.isNotNull(), point(lng, lat))


def position(lat: Column, lng: Column) -> Column:
    return F.when(lat.isNotNull() & lng.isNotNull(), point(lng, lat))


class Profile(NamedTuple):
    """What all values of a column, or of a member of JSON items, look like."""

    filled: int
    shapes: int
    pairs: int


def _counts(text: Column, shape: Column) -> list[Column]:
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    one_comma = text.rlike("^[^,]+,[^,]+$") & pair(text).isNotNull()
    return [F.count_if(~blank), F.count_if(F.coalesce(shape, F.lit(False))), F.count_if(F.coalesce(one_comma, F.lit(False)))]


def profile_columns(df: DataFrame) -> dict[str, Profile]:
    """Profiles of all (text) columns in one aggregate over all rows."""
    names = df.columns
    tests = [n for c in names for n in _counts(F.col(f"`{c}`"), is_wkt(F.col(f"`{c}`")) | is_geojson(F.col(f"`{c}`")))]
    row = df.agg(*[t.alias(f"n{i}") for i, t in enumerate(tests)]).first()
    return {c: Profile(*row[3 * i : 3 * i + 3]) for i, c in enumerate(names)}


def profile_members(items: DataFrame, item: Column) -> dict[str, Profile]:
    """Profiles of the members of JSON items over all items, in order of their first place and name.

    Only members that may hold geometry, by name or by some value, reach the driver.
    """
    members = items.select(F.posexplode(F.map_entries(F.from_json(item, "map<string,string>"))).alias("at", "m")).select("at", "m.key", "m.value")
    filled, shapes, pairs = _counts(F.col("value"), is_geojson(F.col("value")))
    found = members.groupBy("key").agg(F.min("at").alias("at"), filled.alias("filled"), shapes.alias("shapes"), pairs.alias("pairs"))
    named = F.lower("key").isin([*LAT_NAMES, *LNG_NAMES, *PAIR_NAMES, *GEOMETRY_NAMES])
    kept = found.where(named | (F.col("shapes") > 0)).orderBy("at", "key").collect()
    return {r["key"]: Profile(r["filled"], r["shapes"], r["pairs"]) for r in kept}


def chosen(profiles: dict[str, Profile], names: list[str], role: str) -> str | None:
    """The column of a role (``shapes`` or ``pairs``): of known names the first with any such value, else the
    first column at least half of whose values that aren't blank are such."""
    of = {c: getattr(p, role) for c, p in profiles.items()}
    known = next((c for c in _named(list(profiles), names) if of[c]), None)
    return known or next((c for c, p in profiles.items() if of[c] and 2 * of[c] >= p.filled), None)


def geometry_of(
    df: DataFrame, geo_column: str | None, lat: str | None, lng: str | None, geometry_column: str | None = None
) -> tuple[Column | None, list[str]]:
    """Geometry expression of a text table and the columns it uses up.

    Order: named geometry text or pair column, found geometry text, latitude and
    longitude, found pair column; none of them gives ``None``.  What is found is
    decided by all rows, wherever the first values stand.
    """
    for name, read in ((geometry_column, parse_geometry), (geo_column, pair)):
        if name is not None:
            if name not in df.columns:
                raise ValueError(f"column '{name}' not found in {df.columns}")
            return read(F.col(f"`{name}`")), [name]
    profiles = profile_columns(df)
    text = chosen(profiles, GEOMETRY_NAMES, "shapes")
    if text is not None:
        return parse_geometry(F.col(f"`{text}`")), [text]
    try:
        a, b = position_columns(df.columns, lat, lng)
    except ValueError:
        a = b = None
    if a is not None:
        found = position(number_prefix(F.col(f"`{a}`")), number_prefix(F.col(f"`{b}`")))
        if not df.where(found.isNotNull()).limit(1).isEmpty():
            return found, [a, b]
    one = chosen(profiles, PAIR_NAMES, "pairs")
    return (None, []) if one is None else (pair(F.col(f"`{one}`")), [one])
