"""Contract-driven selection of times, areas, levels and fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcheck.functions.columns import area_problem, field_id, in_area, isclose

LEVEL_ATOL, LEVEL_RTOL = 1e-8, 1e-5


def requested_timestamps(scopes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every (day, time of day) of scopes with start_date, end_date, inclusive and times (seconds)."""
    last = F.when(F.col("inclusive"), F.col("end_date")).otherwise(F.date_sub("end_date", 1))
    days = scopes.filter(F.col("start_date") <= last).select(
        *keys, "times", F.explode(F.sequence("start_date", last)).alias("_day")
    )
    each = days.select(*keys, "_day", F.explode("times").alias("_sec"))
    return each.select(
        *keys, (F.col("_day").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("_sec"))).alias("timestamp")
    ).distinct()


def select_times(df: DataFrame, requested: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(requested, [*keys, "timestamp"], "left_semi")


def missing_times(df: DataFrame, requested: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requested times without any source row, and the first of them, per scope."""
    gone = requested.join(df.select(*keys, "timestamp").distinct(), [*keys, "timestamp"], "left_anti")
    return gone.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("missing"), F.min("timestamp").alias("first_missing")
    )


def select_area(df: DataFrame, north: Column, west: Column, south: Column, east: Column) -> DataFrame:
    return df.filter(in_area(F.col("latitude"), F.col("longitude"), north, west, south, east))


#: Cells a unit of the stretched scale: a tolerance reaches over less than half a cell.
LEVEL_CELLS = 1 / (4 * LEVEL_RTOL)


def _cell(value: Column) -> Column:
    """Place of a number on a scale that is even near zero and logarithmic beyond, as the tolerance is."""
    return F.signum(value) * F.asinh(F.abs(value) * (LEVEL_RTOL / LEVEL_ATOL)) * LEVEL_CELLS


def select_level(coordinates: DataFrame, selectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matches of each selector (selector_id, keys, value) on its coordinate (keys, idx, value, text).

    A coordinate has numbers in `value` or, if the column is there, texts in `text`; one without idx is a
    scalar, which has to equal its selector. Selectors are numbers or texts: on a coordinate of numbers one
    matches within tolerance, and a text that is no number matches nothing; on a coordinate of texts one
    matches its own text. Where there is no coordinate the channel has no such axis, and nothing to select.

    A selector is known by its id and its keys, so ids may come again on other coordinates.
    The tolerance join is an equi-join on cells; a selector reaches two of them at most, whatever its size.
    """
    if "text" not in coordinates.columns:
        coordinates = coordinates.withColumn("text", F.lit(None).cast("string"))
    number, text = F.col("value").try_cast("double"), F.col("value").cast("string")
    tol = F.lit(LEVEL_ATOL) + F.lit(LEVEL_RTOL) * F.abs(number)
    reach = [F.concat(F.lit("n"), F.floor(_cell(number + d * tol) + d * 1e-6).cast("string")) for d in (-1, 1)]
    places = F.array_compact(F.array_distinct(F.array(*reach, F.concat(F.lit("t"), text))))
    wanted = selectors.select("selector_id", *keys, number.alias("_want"), F.explode(places).alias("_place"))
    known = coordinates.select(
        *keys, "idx", F.col("value").alias("_have"),
        F.coalesce(F.concat(F.lit("n"), F.floor(_cell(F.col("value"))).cast("string")), F.concat(F.lit("t"), "text")).alias("_place"),
    )
    near = F.col("_have").isNull() | isclose(F.col("_have"), F.col("_want"), F.lit(LEVEL_ATOL), F.lit(LEVEL_RTOL))
    hits = (
        wanted.join(known, [*keys, "_place"])
        .filter(near)
        .groupBy("selector_id", *keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("idx").alias("_idx"))
    )
    axes = coordinates.groupBy(*keys).agg(F.max(F.col("idx").isNull()).alias("_scalar"))
    n = F.coalesce("_n", F.lit(0))
    status = (
        F.when(F.col("_scalar").isNull(), "no_axis")
        .when(F.col("_scalar"), F.when(n == 1, "scalar").otherwise("scalar_mismatch"))
        .when(n == 1, "selected")
        .when(n == 0, "no_match")
        .otherwise("ambiguous")
    )
    return (
        selectors.join(hits, ["selector_id", *keys], "left")
        .join(axes, list(keys), "left")
        .select(
            "selector_id",
            *keys,
            "value",
            n.alias("matches"),
            F.when(n == 1, F.coalesce("_idx", F.lit(-1))).otherwise(F.lit(-1)).alias("idx"),
            status.alias("status"),
        )
    )


def first_source_wins(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of sources by name; for each key and variable the earliest source that has a value wins.

    source_no is the earliest source of the key. Folded with min_by before the shuffle, so overlapping
    copies never travel.
    """
    stacked = None
    for i, df in enumerate(sources):
        part = df.withColumn("source_no", F.lit(i))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    rest = [c for c in stacked.columns if c not in keys and c != "source_no"]
    held = lambda c: F.when(F.col(c).isNotNull(), F.col("source_no"))
    return stacked.groupBy(*keys).agg(
        F.min("source_no").alias("source_no"), *(F.min_by(c, held(c)).alias(c) for c in rest)
    )


def contract_faults(cells: DataFrame, contract: DataFrame) -> DataFrame:
    """(dataset, variable, level, fault) of contract rows that cannot be served; what is in order gives no row.

    An invalid area is named by its reason. `no_variable`: the dataset has no cell of it; `no_level`: it has,
    but none at this level. Cells are folded to their levels before they meet the contract.
    """
    key = ["dataset", "variable", "level"]
    held = cells.groupBy(*key).agg(F.lit(True).alias("_level"))
    named = held.groupBy("dataset", "variable").agg(F.lit(True).alias("_variable"))
    area = area_problem(F.col("north"), F.col("west"), F.col("south"), F.col("east"))
    fault = (
        F.when(~area.isin("ok", "dateline"), F.concat(F.lit("area_"), area))
        .when(F.col("_variable").isNull(), "no_variable")
        .when(F.col("_level").isNull(), "no_level")
    )
    met = contract.join(named, ["dataset", "variable"], "left").join(held, key, "left")
    return met.select(*key, fault.alias("fault")).filter(F.col("fault").isNotNull())


def contract_select(cells: DataFrame, contract: DataFrame, inventory: DataFrame) -> DataFrame:
    """Cells a contract asks for, as canonical long rows with restored units.

    `contract` has one row per (dataset, variable, level) with start_date, end_date, times,
    north, west, south and east. Selection is one equi-join on (dataset, variable, level) whose
    residual tests time and area. Units missing on the cells come from `inventory`; they join the
    contract, so the cells pass one join only. Rows with an invalid area select nothing; contract_faults
    reports them, and requested fields and levels without data.
    """
    units = inventory.select("variable", F.col("units").alias("_units"))
    want = contract.join(units, "variable", "left").select(
        "dataset", "variable", "level", "start_date", "end_date", "times", "north", "west", "south", "east", "_units"
    ).filter(
        area_problem(F.col("north"), F.col("west"), F.col("south"), F.col("east")).isin("ok", "dateline")
    )
    ts = F.col("timestamp")
    second = (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("int")
    box = [F.col(c) for c in ("north", "west", "south", "east")]
    chosen = cells.join(want, ["dataset", "variable", "level"]).filter(
        (ts >= F.col("start_date"))
        & (ts < F.date_add("end_date", 1))
        & F.array_contains("times", second)
        & in_area(F.col("latitude"), F.col("longitude"), *box)
    )
    selector = F.array(
        F.struct(
            F.lit("level").alias("dimension"),
            F.col("level").cast("string").alias("value"),
            F.lit("number").alias("value_type"),
        )
    )
    return chosen.select(
        "dataset",
        "station_id",
        "timestamp",
        field_id(F.col("variable"), selector).alias("field_id"),
        "value",
        F.coalesce("units", "_units", F.lit("unknown")).alias("units"),
    )
