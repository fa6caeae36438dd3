"""Registry of the llm queries and small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldcheck.plans.registry import prepare
from fieldcheck.session import scratch, written  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Rows and bytes of one Arrow batch: bounds what a Python worker holds, however long the texts are.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its DuckDB twin if SQL can express it."""

    def add(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ready(spark)
            return build(spark, sf_dir.rstrip("/"))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return build

    return add


def ready(spark: SparkSession) -> None:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def most_frequent(counts: DataFrame, n: str, limit: int) -> pd.DataFrame:
    """The rows of the largest n, `limit` at most; rows of nearly equal n come together or not at all.

    A histogram of n, 64 steps a doubling and so some thousand rows, tells the least n; then only the rows
    wanted reach the driver. orderBy().limit() would send that many from every task.
    """
    step = F.floor(F.log2(n) * 64).cast("int")
    sizes = counts.groupBy(step.alias("step")).count().collect()
    least, held = None, 0
    for row in sorted(sizes, key=lambda r: -r["step"]):
        held += row["count"]
        if held > limit:
            break
        least = row["step"]
    return counts.filter(step >= least if least is not None else F.lit(False)).toPandas()


def map_batches(
    df: DataFrame, work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """mapInArrow over single batches; empty batches are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """Texts of a column; a null text is empty."""
    return [t or "" for t in column.to_pylist()]


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in one array and the n + 1 offsets that cut it; null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads 64-bit values evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
