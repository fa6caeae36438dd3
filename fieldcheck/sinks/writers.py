"""Writers: canonical observation tables, caches, grid blocks, receipts, result files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcheck.operators.grid import shape_report, validate_coordinates
from fieldcheck.operators.station import key_quality, profile
from fieldcheck.session import shared_folder
from fieldcheck.sources.files import hash_files, list_files, tree_hash


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; every executor reaches it and nothing is overwritten."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def canonical_columns(df: DataFrame) -> DataFrame:
    """The four columns in order and with their types, timestamps as UTC instants."""
    return df.select(
        F.col("station_id").cast("string").alias("station_id"),
        F.col("timestamp").cast("timestamp").alias("timestamp"),
        F.col("field_id").cast("string").alias("field_id"),
        F.col("value").cast("double").alias("value"),
    )


def utc_timestamps(spark: SparkSession) -> None:
    """Timestamps as Parquet instants with a UTC mark instead of the INT96 default."""
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")


def write_observations(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """Canonical table as Parquet; an existing target is refused."""
    utc_timestamps(df.sparkSession)
    canonical_columns(df).write.option("compression", compression).mode("errorifexists").parquet(path)


def write_cache(df: DataFrame, path: str) -> None:
    """Cache laid out by field and day. Rows are rebalanced by (field, day) before writing.

    Adaptive execution splits a hot (field, day) by its bytes into as many tasks as it needs and joins
    small ones, so files are of one size whatever the skew.
    """
    dated = df.withColumn("date", F.to_date("timestamp"))
    dated.hint("rebalance", "field_id", "date").write.partitionBy("field_id", "date").mode("errorifexists").parquet(path)


def write_grid_blocks(blocks: DataFrame, path: str) -> None:
    blocks.write.partitionBy("field_id").option("compression", "zstd").mode("errorifexists").parquet(path)


def write_results_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """Headered CSV in the given column order."""
    df.select(*fields).write.option("header", True).mode("errorifexists").csv(path)


def emit_receipts(receipts: DataFrame, path: str) -> None:
    receipts.write.mode("append").json(path)


def publish(df: DataFrame, path: str, compression: str = "zstd") -> DataFrame:
    """Writes a new table and returns its receipt: bytes, files and content hash.

    Spark's job committer is the staging step; the target must not exist. For readers outside that take a plain
    folder; publish_version judges the rows before anyone sees them.
    """
    utc_timestamps(df.sparkSession)
    df.write.option("compression", compression).mode("errorifexists").parquet(path)
    return receipt(df.sparkSession, path)


Step = Callable[[DataFrame], DataFrame]
Gate = Callable[[DataFrame], DataFrame]

#: Start of a version's folder; a plain reader of the path takes it as a partition.
VERSION = "version="
#: The file that makes a folder a published table: its version's folder, rows, bytes and hash.
MANIFEST = "_published.json"


class NotFit(ValueError):
    """A table that a gate refused; faults holds the count of each gate that found some."""

    def __init__(self, faults: dict[str, int]) -> None:
        super().__init__("not fit to publish: " + ", ".join(f"{n} {k}" for k, n in sorted(faults.items())))
        self.faults = faults


def station_gates(expected: DataFrame | None = None) -> list[Gate]:
    """Gates of a station table: its keys and, with `expected` (kind, id), its fields and stations.

    A gate turns the staged table into one row of named fault counts.
    """

    def keys(df: DataFrame) -> DataFrame:
        return key_quality(df).select(F.col("empty").cast("long").alias("empty"), "null_key_rows", "duplicate_keys")

    def ids(df: DataFrame) -> DataFrame:
        states = profile(df, expected)
        return states.agg(*[F.count_if(F.col("state") == s).alias(f"{s}_ids") for s in ("undeclared", "absent")])

    return [keys] if expected is None else [keys, ids]


def grid_gates(coords: DataFrame, spec: DataFrame, expected: DataFrame) -> list[Gate]:
    """Gates of a table of cells: its coordinates hold `spec`, its channels have the `expected` shapes."""

    def axes(df: DataFrame) -> DataFrame:
        checked = validate_coordinates(coords, spec)
        fine = reduce(Column.__and__, [F.col(c) for c in checked.columns if c.endswith("_ok")])
        bad = ~fine | (F.col("not_finite") > 0) | (F.col("duplicates") > 0)
        return checked.agg(F.count_if(bad).alias("bad_axes"))

    def shapes(df: DataFrame) -> DataFrame:
        return shape_report(df, expected).agg(F.count_if(~(F.col("complete") & F.col("as_expected"))).alias("bad_channels"))

    return [axes, shapes]


def publish_version(df: DataFrame, path: str, gates: Sequence[Gate] = (), compression: str = "zstd") -> DataFrame:
    """Writes a version of a table below `path`, lets the gates judge the written rows, commits it, returns its receipt.

    The commit is one file, MANIFEST, created only where there is none: it needs no rename, which object
    stores do not have, and of two writers at once the later one is told that the target exists. Readers go by
    the manifest (scan_published), so they never see a version that is refused or unfinished. A refused
    version is removed; one left by a lost driver does not keep others from publishing. Anything else at
    `path` is an existing target. A store has to support creation without overwriting.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    utc_timestamps(spark)
    store, top = _store(spark, path), _path(spark, path)
    if store.exists(top) and any(not n.startswith(VERSION) for n in _names(store, top)):
        raise FileExistsError(f"{path} already exists")
    version = f"{VERSION}{uuid.uuid4().hex}"
    staged = f"{root}/{version}"
    try:
        df.write.option("compression", compression).mode("errorifexists").parquet(staged)
        written = spark.read.schema(df.schema).parquet(staged)
        faults = {k: n for gate in gates for k, n in gate(written).first().asDict().items() if n}
        if faults:
            raise NotFit(faults)
        told = receipt(spark, staged)
        row = told.first()
        _create(store, _path(spark, f"{root}/{MANIFEST}"), json.dumps({"version": version, **row.asDict()}, sort_keys=True))
    except BaseException:
        store.delete(_path(spark, staged), True)
        if store.exists(top) and not _names(store, top):
            store.delete(top, False)
        raise
    return spark.createDataFrame([row], told.schema)


def _names(store, folder) -> list[str]:
    return [s.getPath().getName() for s in store.listStatus(folder)]


def _create(store, at, text: str) -> None:
    """Creates a file with this text if there is none."""
    try:
        out = store.create(at, False)
    except Py4JJavaError as e:
        if store.exists(at):
            raise FileExistsError(f"{at.toString()} already exists") from e
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def published_manifest(spark: SparkSession, path: str) -> dict:
    """Version and receipt of a published table; a path without a whole manifest is refused."""
    store, at = _store(spark, path), _path(spark, f"{path.rstrip('/')}/{MANIFEST}")
    text = ""
    if store.exists(at):
        stream = store.open(at)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
    if not text:
        raise FileNotFoundError(f"{path} holds no published table")
    return json.loads(text)


def scan_published(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a published table."""
    return spark.read.parquet(f"{path.rstrip('/')}/{published_manifest(spark, path)['version']}")


def materialise(
    source: DataFrame, steps: Sequence[Step], path: str, expected: DataFrame | None = None
) -> DataFrame:
    """Applies the steps in order and publishes the canonical result behind the gates of a station table."""
    for step in steps:
        source = source.transform(step)
    return publish_version(canonical_columns(source), path, station_gates(expected))


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str):
    """The file system of a path, whatever its scheme."""
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def receipt(spark: SparkSession, path: str) -> DataFrame:
    """Bytes, files and content hash of a written table."""
    hashed = hash_files(list_files(spark, path, "*.parquet"))
    return tree_hash(hashed).select(
        F.lit("parquet").alias("storage_format"),
        "size_bytes",
        F.col("files").alias("file_count"),
        F.col("tree_sha256").alias("sha256"),
    )
