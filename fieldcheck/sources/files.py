"""File audits: inventories, manifests, tree hashes, Parquet footers, footprints."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcheck.session import pinned

CHUNK_BYTES = 8 << 20
PAGE_ENTRIES = 10_000


ENTRY = "path string, size_bytes long, is_folder boolean"


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Direct entries of each folder, page by page, with the folder's own scheme and host in front.

    Local names come without sizes, since a size costs a call a file; stores that list sizes give them.
    """
    from pyarrow import fs

    for batch in batches:
        for folder in batch["path"]:
            uri = _uri(folder)
            store, name = fs.FileSystem.from_uri(uri)
            head = uri.rstrip("/").removesuffix(name.rstrip("/"))
            listed = _local_names(name) if isinstance(store, fs.LocalFileSystem) else _store_names(store, name)
            while page := list(islice(listed, PAGE_ENTRIES)):
                rows = [(head + path, size, is_folder) for path, size, is_folder in page]
                yield pd.DataFrame(rows, columns=["path", "size_bytes", "is_folder"]).astype({"size_bytes": "Int64"})


def _local_names(folder: str) -> Iterator[tuple[str, int | None, bool]]:
    with os.scandir(folder) as entries:
        for e in entries:
            if e.is_symlink():
                raise ValueError(f"{e.path} is a symbolic link")
            yield e.path, None, e.is_dir()


def _store_names(store, folder: str) -> Iterator[tuple[str, int | None, bool]]:
    from pyarrow import fs

    for e in store.get_file_info(fs.FileSelector(folder)):
        yield e.path, e.size, e.type == fs.FileType.Directory


def _sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fills in the sizes that the listing left open."""
    from pyarrow import fs

    for batch in batches:
        open_ = batch["size_bytes"].isna()
        found = []
        for path in batch.loc[open_, "path"]:
            store, name = fs.FileSystem.from_uri(_uri(path))
            found.append(store.get_file_info(name).size)
        yield batch.assign(size_bytes=batch["size_bytes"].mask(open_, pd.Series(found, batch.index[open_], "float64"))).astype({"size_bytes": "Int64"})


def list_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, relative_path, size_bytes) of every file below root, without reading contents.

    Folders are listed in tasks, one round per level of depth. One task reads a folder's names, in pages
    of PAGE_ENTRIES; the files are then dealt by path over all tasks, which look up their sizes, so that
    a flat folder keeps none of them alone for long. Unlike a file source this also sees empty files and
    files whose name starts with an underscore or a dot. `pattern` is a glob on the file name.
    """
    spread = spark.sparkContext.defaultParallelism
    folders = spark.sql("SELECT :root AS path", args={"root": root.rstrip("/")})
    out = None
    while True:
        level = pinned(
            folders.repartition(spread, "path").mapInPandas(_entries, ENTRY)
        )
        files = level.filter(~F.col("is_folder")).repartition(spread, "path").mapInPandas(_sizes, ENTRY).select("path", "size_bytes")
        out = files if out is None else out.unionByName(files)
        folders = level.filter("is_folder").select("path")
        if folders.isEmpty():
            break
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
    whole, base = plain(F.col("path")), plain(F.lit(root.rstrip("/")))
    listed = out.select("path", F.substring(whole, F.length(base) + 2, F.length(whole)).alias("relative_path"), "size_bytes")
    if pattern is None:
        return listed
    body = pattern.replace(".", r"\.").replace("*", ".*").replace("?", ".")
    return listed.filter(F.element_at(F.split("path", "/"), -1).rlike(f"^{body}$"))


def _uri(path: str) -> str:
    """Spark writes local paths as file:/x, Arrow wants file:///x."""
    return "file:///" + path[6:].lstrip("/") if path.startswith("file:/") else path


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams each file in chunks, so file size is not bounded by a row's 2 GB."""
    from pyarrow import fs

    for batch in batches:
        out = []
        for path in batch["path"]:
            store, name = fs.FileSystem.from_uri(_uri(path))
            digest = hashlib.sha256()
            with store.open_input_stream(name) as stream:
                while chunk := stream.read(CHUNK_BYTES):
                    digest.update(chunk)
            out.append(digest.hexdigest())
        yield batch.assign(sha256=out)


def hash_files(files: DataFrame, parallelism: int | None = None) -> DataFrame:
    """Adds sha256 per file; files are spread one task each as far as slots allow."""
    n = parallelism or files.sparkSession.sparkContext.defaultParallelism
    spread = files.repartition(n, "path")
    return spread.mapInPandas(
        _digests, "path string, relative_path string, size_bytes long, sha256 string"
    )


def build_manifest(hashed: DataFrame) -> DataFrame:
    """Manifest rows with the reason an entry cannot be accepted."""
    repeats = hashed.groupBy("relative_path").agg(F.count(F.lit(1)).alias("_n"))
    return hashed.join(repeats, "relative_path").select(
        F.col("relative_path").alias("entry_id"),
        "relative_path",
        "size_bytes",
        "sha256",
        F.when(F.col("_n") > 1, "duplicate")
        .when(F.col("size_bytes") == 0, "empty")
        .otherwise("accepted")
        .alias("status"),
    )


def manifest_total(manifest: DataFrame) -> DataFrame:
    """One row: entries, those accepted, those refused, and the bytes of the accepted ones.

    An empty manifest has a row of zeros.
    """
    fit = F.col("status") == "accepted"
    return manifest.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(fit).alias("accepted"),
        F.count_if(~fit).alias("refused"),
        F.coalesce(F.sum(F.when(fit, F.col("size_bytes"))), F.lit(0)).alias("total_bytes"),
    )


#: Stands for the whole tree among the paths of a verified manifest.
TREE = "."


def verify_manifest(observed: DataFrame, manifest: DataFrame, total_bytes: int | None = None) -> DataFrame:
    """One status per path: ok, missing, undeclared, size or sha256; and one for the path '.', the tree.

    The tree is ok if the observed files hold `total_bytes`, or what the manifest's entries add up to
    where no total is given; else its status is total. A path named twice on a side keeps its rows.
    """
    o = observed.select("relative_path", F.col("size_bytes").alias("_os"), F.col("sha256").alias("_oh"))
    m = manifest.select("relative_path", F.col("size_bytes").alias("_ms"), F.col("sha256").alias("_mh"))
    status = (
        F.when(F.col("_os").isNull(), "missing")
        .when(F.col("_ms").isNull(), "undeclared")
        .when(F.col("_os") != F.col("_ms"), "size")
        .when(~F.col("_oh").eqNullSafe(F.col("_mh")), "sha256")
        .otherwise("ok")
    )
    each = o.join(m, "relative_path", "full_outer").select(
        "relative_path", F.col("_ms").alias("declared_bytes"), F.col("_os").alias("observed_bytes"), status.alias("status")
    )
    sides = m.select(F.col("_ms").alias("_m"), F.lit(0).cast("long").alias("_o")).unionByName(
        o.select(F.lit(0).cast("long").alias("_m"), F.col("_os").alias("_o"))
    )
    declared = F.coalesce(F.sum("_m"), F.lit(0)) if total_bytes is None else F.lit(total_bytes).cast("long")
    whole = sides.agg(declared.alias("declared_bytes"), F.coalesce(F.sum("_o"), F.lit(0)).alias("observed_bytes"))
    agrees = F.col("declared_bytes") == F.col("observed_bytes")
    return each.unionByName(
        whole.select(F.lit(TREE).alias("relative_path"), "declared_bytes", "observed_bytes", F.when(agrees, "ok").otherwise("total").alias("status"))
    )


def select_declared(files: DataFrame, manifest: DataFrame, key: str = "relative_path") -> DataFrame:
    return files.join(manifest.select(key), key, "left_semi")


def tree_hash(hashed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One hash per tree over (relative path, bytes), whatever order the rows arrive in.

    Each file contributes the digest of its path and content; digests are added lane by lane, so
    the total needs no sorted list and combines on the map side.
    """
    from fieldcheck.operators.fingerprint import combine_digests, framed

    rows = hashed.withColumn("_d", F.sha2(framed([F.col("relative_path"), F.col("sha256")]), 256))
    return combine_digests(rows, list(keys), "_d", {"size_bytes": F.sum("size_bytes")}).withColumnsRenamed(
        {"rows": "files", "fingerprint": "tree_sha256"}
    )


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    for batch in batches:
        rows = []
        for path in batch["path"]:
            store, name = fs.FileSystem.from_uri(_uri(path))
            try:
                meta = pq.read_metadata(store.open_input_file(name))
            except (pa.ArrowException, OSError):
                continue  # damaged: no rows, like a file without row groups
            arrow = meta.schema.to_arrow_schema()
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                for c in range(group.num_columns):
                    chunk = group.column(c)
                    column = chunk.path_in_schema.split(".")[0]
                    kind = str(arrow.field(column).type)
                    rows.append((path, g, group.num_rows, column, kind, chunk.compression.lower(), chunk.total_compressed_size))
        yield pd.DataFrame(
            rows,
            columns=["path", "row_group", "rows", "column", "arrow_type", "codec", "bytes"],
        )


def parquet_footers(files: DataFrame) -> DataFrame:
    """One row per (file, row group, column chunk); only footers are read."""
    n = files.sparkSession.sparkContext.defaultParallelism
    return files.select("path").repartition(n, "path").mapInPandas(
        _footers,
        "path string, row_group int, rows long, column string, arrow_type string, codec string, bytes long",
    )


# Physical types the canonical station table must have.
STATION_TYPES = {
    "station_id": r"^(large_)?string$",
    "timestamp": r"^timestamp\[(ns|us|ms|s), tz=UTC\]$",
    "field_id": r"^(large_)?string$",
    "value": r"^(halffloat|float|double)$",
}


def check_parquet_physical(
    files: DataFrame,
    required: dict[str, str],
    codec: str,
) -> DataFrame:
    """Per file: row groups, required columns, declared types and codec.

    A damaged file, and one without row groups, has no footer rows: zero row groups, nothing ok.
    """
    chunks = parquet_footers(files)
    present = [F.max((F.col("column") == c).cast("int")).alias(f"_has_{c}") for c in required]
    typed = F.lit(True)
    for c, pattern in required.items():
        typed = typed & ((F.col("column") != c) | F.col("arrow_type").rlike(pattern))
    per_file = chunks.groupBy("path").agg(
        F.countDistinct("row_group").alias("row_groups"),
        F.countDistinct("column").alias("columns"),
        F.bool_and(typed).alias("types_ok"),
        F.bool_and(F.col("codec") == codec.lower()).alias("codec_ok"),
        *present,
    )
    complete = F.lit(True)
    for c in required:
        complete = complete & (F.col(f"_has_{c}") == 1)
    return (
        files.select("path")
        .join(per_file, "path", "left")
        .select(
            "path",
            F.coalesce("row_groups", F.lit(0)).alias("row_groups"),
            F.coalesce("columns", F.lit(0)).alias("columns"),
            F.coalesce(complete, F.lit(False)).alias("columns_ok"),
            F.coalesce("types_ok", F.lit(False)).alias("types_ok"),
            F.coalesce("codec_ok", F.lit(False)).alias("codec_ok"),
        )
    )


# File names that hold metadata, not data.
METADATA_NAMES = ("_SUCCESS", "_metadata", "_common_metadata", "zarr.json", ".zattrs", ".zgroup", ".zmetadata")


def storage_footprint(files: DataFrame) -> DataFrame:
    """Bytes and objects by kind; a file reached twice counts once."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(name.isin(*METADATA_NAMES) | name.endswith(".crc"), "metadata").otherwise("data")
    once = files.select("path", "size_bytes").dropDuplicates(["path"])
    return once.groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("objects"), F.sum("size_bytes").alias("bytes")
    )
