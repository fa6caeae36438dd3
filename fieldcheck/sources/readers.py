"""Readers: observation tables, provider files of several formats, record documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBSERVATION_COLUMNS = ("station_id", "timestamp", "field_id", "value")


def scan_observations(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = OBSERVATION_COLUMNS,
    where: Column | None = None,
) -> DataFrame:
    """Projected and optionally filtered scan; both reach the Parquet reader."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns)


def read_sources(
    spark: SparkSession,
    sources: Sequence[tuple[str, str]],
    schemas: Mapping[str, T.StructType] | None = None,
) -> DataFrame:
    """Union of (format, path) sources by column name; absent columns become null.

    JSON and CSV sources are read with the schema given for their path, never inferred.
    """
    frames = []
    for fmt, path in sources:
        if fmt not in ("parquet", "json", "csv"):
            raise ValueError(f"unsupported source format {fmt!r}")
        reader = spark.read
        if fmt != "parquet":
            reader = reader.schema((schemas or {})[path])
        if fmt == "csv":
            reader = reader.option("header", True)
        frames.append(reader.format(fmt).load(path))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def promote_scalar(df: DataFrame, dimension: str, value: object) -> DataFrame:
    """A level that holds for a whole file becomes a column."""
    return df if dimension in df.columns else df.withColumn(dimension, F.lit(value))


UNREADABLE = "_unreadable"


def scan_records(spark: SparkSession, path: str, schema: T.StructType, whole_files: bool = False) -> DataFrame:
    """JSON records read with a fixed schema, with their file name and what could not be read.

    Appended records stand one on a line; with `whole_files` each file is one document, indented or not.
    A record that is no JSON or does not fit keeps its text in `_unreadable`, which is null for all others.
    """
    return (
        spark.read.schema(T.StructType([*schema.fields, T.StructField(UNREADABLE, T.StringType())]))
        .option("columnNameOfCorruptRecord", UNREADABLE)
        .option("multiLine", whole_files)
        .json(path)
        .withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    )


def absent_records(records: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected documents that are not there."""
    return expected.join(records, list(keys), "left_anti")
