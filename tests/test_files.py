from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from fieldcheck.sinks import writers
from fieldcheck.sources import files, readers


@pytest.fixture
def tree(tmp_path):
    for name, body in {"a.txt": b"alpha", "sub/b.bin": b"\x00" * 100, "c.txt": b""}.items():
        target = tmp_path / "tree" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(body)
    return tmp_path / "tree"


def hashed(spark, root):
    return files.hash_files(files.list_files(spark, str(root)))


def test_manifest_has_sizes_and_hashes(spark, tree):
    rows = {r["relative_path"]: r for r in files.build_manifest(hashed(spark, tree)).collect()}
    assert rows["a.txt"]["sha256"] == hashlib.sha256(b"alpha").hexdigest() and rows["a.txt"]["status"] == "accepted"
    assert rows["sub/b.bin"]["size_bytes"] == 100 and rows["c.txt"]["status"] == "empty"


def test_chunked_hash_of_a_larger_file(spark, tmp_path, monkeypatch):
    body = bytes(range(256)) * 4096 * 9  # above one chunk
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "x.bin").write_bytes(body)
    assert hashed(spark, tmp_path / "big").first()["sha256"] == hashlib.sha256(body).hexdigest()


def test_verify_names_each_defect(spark, tree):
    manifest = files.build_manifest(hashed(spark, tree)).cache()
    manifest.count()
    (tree / "a.txt").write_bytes(b"ALPHA")
    (tree / "sub/b.bin").write_bytes(b"\x00" * 99)
    (tree / "c.txt").unlink()
    (tree / "new.txt").write_bytes(b"n")
    got = {r["relative_path"]: r["status"] for r in files.verify_manifest(hashed(spark, tree), manifest).collect()}
    assert got == {"a.txt": "sha256", "sub/b.bin": "size", "c.txt": "missing", "new.txt": "undeclared", ".": "ok"}


def test_totals_of_a_manifest(spark, tree):
    seen = hashed(spark, tree)
    manifest = files.build_manifest(seen)
    assert files.manifest_total(manifest).first().asDict() == {"entries": 3, "accepted": 2, "refused": 1, "total_bytes": 105}
    tree_row = lambda total: files.verify_manifest(seen, manifest, total).filter("relative_path = '.'").first()
    assert tree_row(105)["status"] == "ok" and tree_row(104)["status"] == "total"
    none = files.verify_manifest(seen.limit(0), manifest.limit(0)).collect()
    assert [r.asDict() for r in none] == [{"relative_path": ".", "declared_bytes": 0, "observed_bytes": 0, "status": "ok"}]
    assert files.manifest_total(manifest.limit(0)).first()["total_bytes"] == 0


def test_a_flat_folder_is_measured_in_many_tasks(spark, tmp_path, monkeypatch):
    for i in range(3000):
        (tmp_path / f"f{i}").write_bytes(b"x" * (i % 5))
    listed = files.list_files(spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
    row = listed.agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), F.count_distinct("task").alias("tasks")).first()
    assert (row["n"], row["bytes"]) == (3000, 6000) and row["tasks"] == spark.sparkContext.defaultParallelism


def test_names_come_in_pages(tmp_path, monkeypatch):
    import pandas as pd

    for i in range(25):
        (tmp_path / f"f{i}").touch()
    monkeypatch.setattr(files, "PAGE_ENTRIES", 10)
    pages = list(files._entries(iter([pd.DataFrame({"path": [str(tmp_path)]})])))
    assert [len(p) for p in pages] == [10, 10, 5]


def test_tree_hash_follows_paths_and_content(spark, tree):
    one = files.tree_hash(hashed(spark, tree)).first()
    assert one == files.tree_hash(hashed(spark, tree).repartition(3)).first() and one["files"] == 3
    (tree / "a.txt").rename(tree / "z.txt")
    moved = files.tree_hash(hashed(spark, tree)).first()
    assert moved["tree_sha256"] != one["tree_sha256"] and moved["size_bytes"] == one["size_bytes"]


def station(spark):
    return spark.sql("SELECT 's' AS station_id, TIMESTAMP '2024-01-01 00:00:00' AS timestamp, 't' AS field_id, 1.5D AS value")


@pytest.mark.parametrize("codec, ok", [("zstd", True), ("snappy", False)])
def test_physical_codec(spark, tmp_path, codec, ok):
    path = str(tmp_path / codec)
    writers.write_observations(station(spark), path, codec)
    row = files.check_parquet_physical(files.list_files(spark, path, "*.parquet"), files.STATION_TYPES, "zstd").first()
    assert (row["columns_ok"], row["types_ok"], row["codec_ok"], row["row_groups"]) == (True, True, ok, 1)


def test_physical_types_and_columns(spark, tmp_path):
    bad = station(spark).select("station_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), F.col("value").cast("int").alias("value"))
    bad.write.option("compression", "zstd").parquet(str(tmp_path / "bad"))
    row = files.check_parquet_physical(files.list_files(spark, str(tmp_path / "bad"), "*.parquet"), files.STATION_TYPES, "zstd").first()
    assert (row["columns_ok"], row["types_ok"], row["codec_ok"]) == (False, False, True)


def test_publish_refuses_an_existing_target(spark, tmp_path):
    path = str(tmp_path / "out")
    receipt = writers.publish(station(spark), path).first()
    on_disk = list((tmp_path / "out").glob("*.parquet"))
    assert receipt["file_count"] == len(on_disk) and receipt["size_bytes"] == sum(p.stat().st_size for p in on_disk)
    with pytest.raises(Exception, match="(?i)already exists"):
        writers.publish(station(spark), path)


def test_sources_union_by_name(spark, tmp_path):
    spark.range(3).select(F.col("id").alias("a"), F.lit("p").alias("src")).write.parquet(str(tmp_path / "p"))
    csv = spark.range(2).select(F.col("id").alias("a"), F.lit("c").alias("src"), F.lit(1.5).alias("b"))
    writers.write_results_csv(csv, str(tmp_path / "c"), ["a", "src", "b"])
    sources = [("parquet", str(tmp_path / "p")), ("csv", str(tmp_path / "c"))]
    got = readers.read_sources(spark, sources, {str(tmp_path / "c"): csv.schema})
    assert {r["src"]: (r["count"], r["b"]) for r in got.groupBy("src").agg(F.count("*").alias("count"), F.max("b").alias("b")).collect()} == {"p": (3, None), "c": (2, 1.5)}
    with pytest.raises(ValueError):
        readers.read_sources(spark, [("grib", "x")])


def test_footprint_counts_a_file_once(spark, tree):
    listed = files.list_files(spark, str(tree))
    rows = {r["kind"]: (r["objects"], r["bytes"]) for r in files.storage_footprint(listed.unionByName(listed)).collect()}
    assert rows == {"data": (3, 105)}


def test_footprint_tells_metadata_apart(spark, tmp_path):
    station(spark).write.parquet(str(tmp_path / "o"))
    rows = {r["kind"]: r["objects"] for r in files.storage_footprint(files.list_files(spark, str(tmp_path))).collect()}
    assert rows == {"data": 1, "metadata": 3}


def test_scan_pushes_filter_and_columns(spark, tmp_path):
    writers.write_observations(station(spark), str(tmp_path / "o"))
    df = readers.scan_observations(spark, str(tmp_path / "o"), ("station_id", "value"), F.col("station_id") == "s")
    plan = df._jdf.queryExecution().toString()
    assert "EqualTo(station_id,s)" in plan and "ReadSchema: struct<station_id:string,value:double>" in plan


def test_materialise_publishes_only_fit_tables(spark, tmp_path):
    steps = [lambda df: df.withColumn("value", F.col("value") * 2), lambda df: df.filter("value > 0")]
    receipt = writers.materialise(station(spark), steps, str(tmp_path / "good")).first()
    assert receipt["file_count"] == 1 and spark.read.parquet(str(tmp_path / "good")).first()["value"] == 3.0
    twice = [lambda df: df.unionByName(df)]
    with pytest.raises(ValueError, match="duplicate_keys"):
        writers.materialise(station(spark), twice, str(tmp_path / "bad"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["good"]


def test_published_versions_are_seen_through_the_manifest(spark, tmp_path):
    path = tmp_path / "table"
    (path / "version=lost").mkdir(parents=True)  # what a lost driver left
    told = writers.publish_version(station(spark), str(path), writers.station_gates()).first()
    assert writers.published_manifest(spark, str(path))["sha256"] == told["sha256"]
    assert writers.scan_published(spark, str(path)).columns == ["station_id", "timestamp", "field_id", "value"]
    with pytest.raises(FileExistsError):
        writers.publish_version(station(spark), str(path))
    assert writers.scan_published(spark, str(path)).count() == 1
    with pytest.raises(FileNotFoundError):
        writers.scan_published(spark, str(tmp_path / "none"))


def test_the_later_of_two_writers_is_told(spark, tmp_path):
    path = tmp_path / "table"
    late = lambda df: writers.publish_version(df, str(path)).selectExpr("0L AS nothing")  # another writer commits meanwhile
    with pytest.raises(FileExistsError):
        writers.publish_version(station(spark), str(path), [late])
    kept = sorted(p.name for p in path.iterdir() if not p.name.startswith("."))
    assert kept == ["_published.json", writers.published_manifest(spark, str(path))["version"]]


def test_undeclared_ids_are_not_published(spark, tmp_path):
    expected = spark.createDataFrame([("station", "s"), ("field", "u")], "kind string, id string")
    with pytest.raises(writers.NotFit) as refused:
        writers.materialise(station(spark), [], str(tmp_path / "bad"), expected)
    assert refused.value.faults == {"undeclared_ids": 1, "absent_ids": 1} and not (tmp_path / "bad").exists()


def test_grids_are_published_behind_their_gates(spark, tmp_path):
    cells = spark.range(6).selectExpr("'c' AS field_id", "id DIV 2 AS sample", "0L AS y", "id % 2 AS x", "1D AS value")
    coords = spark.createDataFrame([("x", 0, 1.0), ("x", 1, 2.0)], "axis string, idx long, value double")
    spec = spark.createDataFrame([("x", "increasing", 1.0)], "axis string, monotonic string, expected_step double")
    shape = lambda width: spark.createDataFrame([("c", 3, 1, width)], "field_id string, samples long, height long, width long")
    writers.publish_version(cells, str(tmp_path / "good"), writers.grid_gates(coords, spec, shape(2)))
    assert writers.scan_published(spark, str(tmp_path / "good")).count() == 6
    with pytest.raises(writers.NotFit, match="bad_channels"):
        writers.publish_version(cells, str(tmp_path / "bad"), writers.grid_gates(coords, spec, shape(3)))


def test_damaged_files_and_links(spark, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 this is no footer PAR1")
    found = files.list_files(spark, str(tmp_path), "*.parquet")
    row = files.check_parquet_physical(found, files.STATION_TYPES, "zstd").first()
    assert row["row_groups"] == 0 and not row["columns_ok"]
    (tmp_path / "link.parquet").symlink_to(tmp_path / "bad.parquet")
    with pytest.raises(Exception, match="symbolic link"):
        files.list_files(spark, str(tmp_path)).count()


def test_indented_documents_and_broken_records(spark, tmp_path):
    schema = "a int, b string"
    kind = spark.createDataFrame([], schema).schema
    (tmp_path / "one.json").write_text('{\n  "a": 1,\n  "b": "x"\n}\n')
    whole = readers.scan_records(spark, str(tmp_path / "one.json"), kind, whole_files=True).collect()
    assert [(r["a"], r["b"], r["_unreadable"], r["source_file"]) for r in whole] == [(1, "x", None, "one.json")]
    (tmp_path / "lines.json").write_text('{"a": 1}\n{"a": \n')
    lines = readers.scan_records(spark, str(tmp_path / "lines.json"), kind).collect()
    assert [(r["a"], r["_unreadable"] is None) for r in lines] == [(1, True), (None, False)]
