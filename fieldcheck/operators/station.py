"""Station observation tables: canonical form, key and scope gates, profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("station_id", "timestamp", "field_id")

# Provider names and the canonical names they stand for.
COORDINATE_ALIASES = {
    "valid_time": "time",
    "lat": "latitude",
    "lon": "longitude",
    "level": "pressure_level",
    "isobaricInhPa": "pressure_level",
}
VARIABLE_ALIASES = {"t": "temperature", "z": "geopotential"}


def canonicalise(df: DataFrame, station: str, timestamp: str, variables: Mapping[str, str]) -> DataFrame:
    """Wide provider rows to (station_id, timestamp, field_id, value).

    `variables` maps a provider column to its field id; the hints have to name distinct columns.
    """
    used = [station, timestamp, *variables]
    if len(set(used)) != len(used):
        raise ValueError("column hints must be unique")
    unknown = sorted(set(used) - set(df.columns))
    if unknown:
        raise ValueError(f"column hints name absent columns: {unknown}")
    wide = df.select(
        F.col(station).cast("string").alias("station_id"),
        F.col(timestamp).alias("timestamp"),
        *[F.col(c).cast("double").alias(f) for c, f in variables.items()],
    )
    return wide.unpivot(["station_id", "timestamp"], list(variables.values()), "field_id", "value")


def rename_aliases(df: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Provider names to canonical ones, only where the canonical name is still free."""
    table = {**COORDINATE_ALIASES, **VARIABLE_ALIASES} if aliases is None else dict(aliases)
    taken = set(df.columns)
    renames: dict[str, str] = {}
    for old in df.columns:
        new = table.get(old)
        if new and new not in taken:
            renames[old] = new
            taken.add(new)
    return df.withColumnsRenamed(renames)


def station_scan(df: DataFrame, station_id: str, field_id: str) -> DataFrame:
    """One station and field; both equalities are pushed to the Parquet reader."""
    return df.filter((F.col("station_id") == station_id) & (F.col("field_id") == field_id))


def scope_violations(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows outside the half-open range [start, end + 1 day)."""
    ts = F.col("timestamp")
    return df.filter((ts < start) | (ts >= end + F.expr("INTERVAL 1 DAY")))


def key_quality(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Rows, rows with a null in the key, repeated keys and the rows they add."""
    null_key = F.lit(False)
    for k in key:
        null_key = null_key | F.col(k).isNull()
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(null_key, F.col("_n")).otherwise(0)), F.lit(0)).alias("null_key_rows"),
        F.count_if(F.col("_n") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("surplus_rows"),
    ).select("*", (F.col("row_count") == 0).alias("empty"))


def profile(df: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """One row per distinct station and field with its rows and time span.

    The distinct ids stay rows instead of one collected set. With `expected` (kind, id) each row
    says whether the id is declared, undeclared or absent.
    """
    ids = df.select(F.col("station_id").alias("station"), F.col("field_id").alias("field"), "timestamp").unpivot(
        ["timestamp"], ["station", "field"], "kind", "id"
    )
    seen = ids.groupBy("kind", "id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )
    if expected is None:
        return seen
    want = expected.select("kind", "id", F.lit(True).alias("_want"))
    state = F.when(F.col("_want").isNull(), "undeclared").when(F.col("rows").isNull(), "absent").otherwise("declared")
    return seen.join(want, ["kind", "id"], "full_outer").select(
        "kind", "id", F.coalesce("rows", F.lit(0)).alias("rows"), "first_ts", "last_ts", state.alias("state")
    )
