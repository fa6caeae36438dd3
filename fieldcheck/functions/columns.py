"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(value: Column, markers: Sequence[float] = ()) -> Column:
    """Null, NaN or a listed marker value."""
    out = value.isNull() | F.isnan(value)
    return out | F.coalesce(value.isin(*markers), F.lit(False)) if markers else out


def finite(value: Column) -> Column:
    inf = float("inf")
    return value.isNotNull() & ~F.isnan(value) & (value != inf) & (value != -inf)


def isclose(value: Column, reference: Column, atol: Column, rtol: Column) -> Column:
    """|value - reference| <= atol + rtol * |reference|; equal infinities match."""
    near = F.abs(value - reference) <= atol + rtol * F.abs(reference)
    return (value == reference) | (finite(value) & finite(reference) & near)


def longitude_360(lon: Column) -> Column:
    """Floored modulo, so that -10 becomes 350."""
    return F.pmod(lon, F.lit(360.0))


def in_area(lat: Column, lon: Column, north: Column, west: Column, south: Column, east: Column) -> Column:
    """Inside [north, west, south, east]; a full circle keeps all, west > east crosses the dateline."""
    full = (east - west) >= 360.0
    w, e, x = longitude_360(west), longitude_360(east), longitude_360(lon)
    inside = F.when(full, F.lit(True)).when(w <= e, x.between(w, e)).otherwise((x >= w) | (x <= e))
    return lat.between(south, north) & inside


def area_problem(north: Column, west: Column, south: Column, east: Column) -> Column:
    """Reason code for a contract area, or 'ok'."""
    gap = north.isNull() | west.isNull() | south.isNull() | east.isNull()
    lat_ok = (south >= -90) & (south <= north) & (north <= 90)
    lon_ok = west.between(-180, 180) & east.between(-180, 180)
    return (
        F.when(gap, "not_numeric")
        .when(~lat_ok, "latitude")
        .when(~lon_ok, "longitude")
        .when(west > east, "dateline")
        .otherwise("ok")
    )


def json_literal(value: Column, value_type: Column) -> Column:
    """Text of a selector value as compact JSON: strings are quoted, numbers and booleans are not."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(value, r'(["\\])', r"\\$1"), F.lit('"'))
    return F.when(value_type == "string", quoted).otherwise(value)


def field_id(name: Column, selectors: Column, mode: str = "sorted_typed") -> Column:
    """`name[dim=value,...]` of an array of (dimension, value, value_type) structs.

    `sorted_typed` orders by dimension and keeps JSON types; `contract_order_text` keeps the
    contract's order and quotes every value.
    """
    if mode == "sorted_typed":
        ordered = F.sort_array(selectors)
        part = lambda s: F.concat(s["dimension"], F.lit("="), json_literal(s["value"], s["value_type"]))
    elif mode == "contract_order_text":
        ordered = selectors
        part = lambda s: F.concat(s["dimension"], F.lit("="), json_literal(s["value"], F.lit("string")))
    else:
        raise ValueError(f"unknown field id mode {mode!r}")
    inner = F.concat_ws(",", F.transform(ordered, part))
    return F.when(F.size(selectors) == 0, name).otherwise(F.concat(name, F.lit("["), inner, F.lit("]")))


CF_UNITS = r"(?i)^\s*(seconds|minutes|hours|days)\s+since\s+(.+?)\s*$"
# Calendars that can be decoded, seconds per CF unit.
CF_CALENDARS = ("standard", "gregorian", "proleptic_gregorian")
CF_SECONDS = (("seconds", 1), ("minutes", 60), ("hours", 3600), ("days", 86400))


def cf_status(units: Column, calendar: Column) -> Column:
    origin = F.try_to_timestamp(F.replace(F.regexp_extract(units, CF_UNITS, 2), F.lit("T"), F.lit(" ")))
    return (
        F.when(~F.coalesce(calendar, F.lit("standard")).isin(*CF_CALENDARS), "calendar_unsupported")
        .when(~F.coalesce(units, F.lit("")).rlike(CF_UNITS), "units_unsupported")
        .when(origin.isNull(), "origin_unsupported")
        .otherwise("decoded")
    )


def cf_micros(value: Column, units: Column) -> Column:
    """Microseconds since 1970 of a numeric CF time, offset rounded half to even."""
    unit = F.lower(F.regexp_extract(units, CF_UNITS, 1))
    scale = F.lit(None).cast("double")
    for name, seconds in CF_SECONDS:
        scale = F.when(unit == name, F.lit(float(seconds))).otherwise(scale)
    origin = F.try_to_timestamp(F.replace(F.regexp_extract(units, CF_UNITS, 2), F.lit("T"), F.lit(" ")))
    return F.unix_micros(origin) + F.rint(value * scale * F.lit(1e6)).cast("long")


def slug(text: Column) -> Column:
    """Lower case words joined by underscores; 'dataset' when nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "dataset").otherwise(s)


def tag(text: Column) -> Column:
    """Lower case words joined by hyphens; null when nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s != "", s)


def label_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


# Words that carry no meaning in a proposal.
STOP_WORDS = (
    "a", "an", "and", "by", "for", "from", "if", "in", "is", "of", "on", "or", "that", "the",
    "this", "to", "will", "with", "without", "change", "changes", "improve", "pipeline",
)


def meaningful_tokens(text: Column) -> Column:
    """Distinct `[a-z0-9_]+` words longer than two characters that are no stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{3,}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)))


def safe_path(path: Column) -> Column:
    """Non-empty, relative and without a parent step."""
    steps = F.split(path, "/")
    return (F.coalesce(path, F.lit("")) != "") & ~path.startswith("/") & ~F.array_contains(steps, "..")


def flags(*named: tuple[str, Column]) -> Column:
    """Sorted text of the names whose condition holds; empty text when none does."""
    held = F.array(*[F.when(cond, F.lit(name)) for name, cond in sorted(named, key=lambda n: n[0])])
    return F.concat_ws(",", F.array_compact(held))
