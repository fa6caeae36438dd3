"""Order-free fingerprints of tables and grids.

The digest of every row is cut into four lanes of 60 bits and the lanes are added. Addition does
not care about row order, combines before the shuffle and needs no group in one place, so one
fingerprint costs one pass over the table whatever its size or skew. Only equality has meaning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcheck.functions.columns import missing

LANES = 4
LANE_HEX = 15


def combine_digests(
    df: DataFrame, keys: Sequence[str], digest: str, also: Mapping[str, Column] | None = None
) -> DataFrame:
    """(keys, rows, fingerprint, also...) from one hex digest per row, in one aggregation."""
    extra = dict(also or {})
    lanes = [
        F.sum(
            F.conv(F.substring(digest, 1 + LANE_HEX * i, LANE_HEX), 16, 10).cast("decimal(20,0)")
        ).alias(f"_l{i}")
        for i in range(LANES)
    ]
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *lanes, *[c.alias(n) for n, c in extra.items()])
    text = F.concat_ws(
        ":",
        F.col("rows").cast("string"),
        *[F.coalesce(F.col(f"_l{i}").cast("string"), F.lit("0")) for i in range(LANES)],
    )
    return total.select(*keys, "rows", F.sha2(text, 256).alias("fingerprint"), *extra)


def canonical_text(column: Column, kind: T.DataType) -> Column:
    """Text of one cell, exact: two different cells have two texts, null where the cell is missing. -0.0 is 0.0."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = column.cast("double")
        return F.when(~missing(value), (value + 0.0).cast("string"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        column = F.to_json(column, {"ignoreNullFields": "false"})
    return column.cast("string")


def framed(cells: Sequence[Column]) -> Column:
    """One text for a list of texts: each behind its length, so no text can pass for a border or for null."""
    frame = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("~"))
    return F.concat(*[frame(c) for c in cells])


def row_digest(df: DataFrame) -> Column:
    """sha256 of every column in name order, extra columns included."""
    return F.sha2(framed([canonical_text(F.col(f.name), f.dataType) for f in sorted(df.schema.fields, key=lambda f: f.name)]), 256)


def table_fingerprint(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return combine_digests(df.withColumn("_digest", row_digest(df)), keys, "_digest")


def rerun_equal(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fingerprints of two runs side by side per key."""
    both = (
        table_fingerprint(first, keys)
        .withColumn("_run", F.lit(1))
        .unionByName(table_fingerprint(second, keys).withColumn("_run", F.lit(2)))
    )
    pick = lambda run, c: F.max(F.when(F.col("_run") == run, F.col(c)))
    return (
        both.groupBy(*keys)
        .agg(
            F.coalesce(pick(1, "rows"), F.lit(0)).alias("rows_initial"),
            F.coalesce(pick(2, "rows"), F.lit(0)).alias("rows_rerun"),
            pick(1, "fingerprint").alias("_f1"),
            pick(2, "fingerprint").alias("_f2"),
        )
        .select(*keys, "rows_initial", "rows_rerun", F.col("_f1").eqNullSafe(F.col("_f2")).alias("equal"))
    )


def grid_fingerprint(cells: DataFrame, coords: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, rows, fingerprint) of a grid: shape and type of each channel, coordinates, values and the missing mask.

    A missing value enters by its mask alone, whatever stands there; a cell that is absent changes the shape
    or the number of rows. One digest a cell, coordinate and channel, added up in any order.
    """
    part = lambda df, *texts: df.select(*keys, F.sha2(framed(texts), 256).alias("_digest"))
    text = lambda name: F.col(name).cast("string")
    kind = F.lit(cells.schema["value"].dataType.simpleString())
    value = canonical_text(F.col("value"), cells.schema["value"].dataType)
    mask = value.isNull().cast("string")
    shapes = cells.groupBy(*keys, "field_id").agg(*[(F.max(a) + 1).alias(f"_{a}") for a in ("sample", "y", "x")])
    rows = part(cells, F.lit("cell"), text("field_id"), text("sample"), text("y"), text("x"), mask, value)
    rows = rows.unionByName(part(shapes, F.lit("shape"), text("field_id"), kind, text("_sample"), text("_y"), text("_x")))
    at = canonical_text(F.col("value"), coords.schema["value"].dataType)
    rows = rows.unionByName(part(coords, F.lit("coordinate"), text("axis"), text("idx"), at))
    return combine_digests(rows, keys, "_digest")
