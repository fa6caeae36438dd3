"""File, manifest, receipt and provenance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcheck.operators import diff, provenance
from fieldcheck.plans.observations import LANES
from fieldcheck.plans.registry import Tables, query
from fieldcheck.sinks.writers import NotFit, canonical_columns, emit_receipts, materialise, publish, scan_published, scratch, write_observations
from fieldcheck.sources import files, readers


def given_files(t: Tables) -> DataFrame:
    return files.hash_files(files.list_files(t.spark, t.dir, "*.parquet"))


@query("manifest_build")
def manifest_build(t: Tables) -> DataFrame:
    return files.build_manifest(given_files(t))


@query("manifest_verify")
def manifest_verify(t: Tables) -> DataFrame:
    """Manifest with one changed hash, one changed size, one lost and one invented entry."""
    seen = given_files(t)
    path = F.col("relative_path")
    manifest = (
        seen.filter(path != "labels.parquet")
        .withColumn("sha256", F.when(path == "events.parquet", F.sha2("sha256", 256)).otherwise(F.col("sha256")))
        .withColumn("size_bytes", F.when(path == "orders.parquet", F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))
        .withColumn("relative_path", F.when(path == "region.parquet", "regions.parquet").otherwise(path))
    )
    return files.verify_manifest(seen, manifest)


def text_files(t: Tables) -> DataFrame:
    """The texts as (relative_path, size_bytes, sha256), as hash_files gives them; null is an empty file."""
    body = F.coalesce("text", F.lit(""))
    return t.texts().select(F.col("path").alias("relative_path"), F.octet_length(body).cast("long").alias("size_bytes"), F.sha2(body, 256).alias("sha256"))


TEXT_FILES = "SELECT path AS relative_path, octet_length(encode(coalesce(text, ''))) AS size_bytes, sha256(coalesce(text, '')) AS sha256 FROM texts"


def text_manifest(t: Tables) -> DataFrame:
    """Every file once, those of labelled documents twice, as a source that lists them again would."""
    seen = text_files(t)
    return files.build_manifest(seen.unionByName(manifest_again(t, seen)))


def manifest_again(t: Tables, seen: DataFrame) -> DataFrame:
    labelled = t.read("labels").select(F.concat(F.lit("doc/"), "doc_id", F.lit(".txt")).alias("relative_path")).distinct()
    return seen.join(labelled, "relative_path", "left_semi")


TEXT_MANIFEST = f"""SELECT *, CASE WHEN count(*) OVER (PARTITION BY relative_path) > 1 THEN 'duplicate' WHEN size_bytes = 0 THEN 'empty' ELSE 'accepted' END AS status
    FROM (SELECT * FROM ({TEXT_FILES}) UNION ALL SELECT * FROM ({TEXT_FILES}) WHERE relative_path IN (SELECT 'doc/' || doc_id || '.txt' FROM labels))"""


@query("manifest_entries", f"SELECT relative_path AS entry_id, relative_path, size_bytes, sha256, status FROM ({TEXT_MANIFEST})")
def manifest_entries(t: Tables) -> DataFrame:
    return text_manifest(t)


@query(
    "manifest_total",
    f"""SELECT count(*) AS entries, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status <> 'accepted') AS refused,
        CAST(sum(size_bytes) FILTER (status = 'accepted') AS BIGINT) AS total_bytes FROM ({TEXT_MANIFEST})""",
)
def manifest_total(t: Tables) -> DataFrame:
    return files.manifest_total(text_manifest(t))


@query(
    "manifest_check",
    f"""WITH o AS MATERIALIZED (SELECT *, CAST(regexp_extract(relative_path, '[0-9]+') AS BIGINT) AS n FROM ({TEXT_FILES})),
        m AS (SELECT CASE WHEN n % 50 = 3 THEN relative_path || '.old' ELSE relative_path END AS relative_path, CASE WHEN n % 50 = 1 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes,
              CASE WHEN n % 50 = 2 THEN sha256(sha256) ELSE sha256 END AS sha256 FROM o WHERE n % 50 <> 0)
        SELECT coalesce(o.relative_path, m.relative_path) AS relative_path, m.size_bytes AS declared_bytes, o.size_bytes AS observed_bytes, CASE WHEN o.relative_path IS NULL THEN 'missing'
          WHEN m.relative_path IS NULL THEN 'undeclared' WHEN o.size_bytes <> m.size_bytes THEN 'size' WHEN o.sha256 <> m.sha256 THEN 'sha256' ELSE 'ok' END AS status
        FROM o FULL JOIN m ON o.relative_path = m.relative_path
        UNION ALL SELECT '.', d, s, CASE WHEN d = s THEN 'ok' ELSE 'total' END FROM (SELECT CAST((SELECT sum(size_bytes) FROM m) AS BIGINT) AS d, CAST((SELECT sum(size_bytes) FROM o) AS BIGINT) AS s)""",
)
def manifest_check(t: Tables) -> DataFrame:
    """A manifest of the texts with changed sizes and hashes, lost and invented entries."""
    seen = text_files(t)
    n, path = F.regexp_extract("relative_path", "[0-9]+", 0).cast("long") % 50, F.col("relative_path")
    manifest = seen.filter(n != 0).select(
        F.when(n == 3, F.concat(path, F.lit(".old"))).otherwise(path).alias("relative_path"),
        F.when(n == 1, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"),
        F.when(n == 2, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"),
    )
    return files.verify_manifest(seen, manifest)


@query(
    "tree_hash_text",
    f"""WITH f AS (SELECT *, left(relative_path, 5) AS tree FROM ({TEXT_FILES})), d AS (SELECT tree, size_bytes, sha256(length(relative_path) || ':' || relative_path || '64:' || sha256) AS h FROM f)
        SELECT tree, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, sha256(concat_ws(':', count(*), {LANES})) AS tree_sha256 FROM d GROUP BY 1""",
)
def tree_hash_text(t: Tables) -> DataFrame:
    return files.tree_hash(text_files(t).withColumn("tree", F.left("relative_path", F.lit(5))), ["tree"])


@query(
    "footprint_text",
    f"""WITH f AS (SELECT relative_path || CASE WHEN size_bytes % 7 = 0 THEN '/zarr.json' WHEN size_bytes % 7 = 1 THEN '.crc' ELSE '' END AS path, size_bytes FROM ({TEXT_FILES}))
        SELECT CASE WHEN path LIKE '%/zarr.json' OR path LIKE '%.crc' THEN 'metadata' ELSE 'data' END AS kind, count(*) AS objects, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM f GROUP BY 1""",
)
def footprint_text(t: Tables) -> DataFrame:
    """Every file listed twice, by two stores that share it."""
    end = F.when(F.col("size_bytes") % 7 == 0, "/zarr.json").when(F.col("size_bytes") % 7 == 1, ".crc").otherwise("")
    listed = text_files(t).select(F.concat("relative_path", end).alias("path"), "size_bytes")
    return files.storage_footprint(listed.unionByName(listed))


@query(
    "manifest_semi",
    "SELECT path AS relative_path, text IS NOT NULL AS has_text FROM texts WHERE path IN (SELECT 'doc/' || doc_id || '.txt' FROM labels)",
)
def manifest_semi(t: Tables) -> DataFrame:
    listed = t.texts().select(F.col("path").alias("relative_path"), F.col("text").isNotNull().alias("has_text"))
    manifest = t.read("labels").select(F.concat(F.lit("doc/"), "doc_id", F.lit(".txt")).alias("relative_path"))
    return files.select_declared(listed, manifest)


RECORD = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("candidate_id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("outputs", T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("size_bytes", T.DoubleType())]))),
    ]
)


def receipts_written(t: Tables) -> DataFrame:
    """Receipts appended in two batches as JSON documents and read back with a fixed schema."""
    path = scratch(t.spark, "receipts")
    o = t.read("orders")
    output = F.struct(F.concat(F.lit("out/"), "o_orderkey").alias("path"), F.col("o_totalprice").alias("size_bytes"))
    made = o.select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_custkey").alias("candidate_id"),
        F.col("o_orderstatus").alias("status"),
        F.array(output).alias("outputs"),
    )
    emit_receipts(made.filter(F.col("status") == "F"), path)
    emit_receipts(made.filter(F.col("status") != "F"), path)
    return readers.scan_records(t.spark, path, RECORD)


@query(
    "records_scan",
    """SELECT 'present' AS state, o_orderstatus AS status, count(*) AS records, round(sum(o_totalprice), 2) AS bytes FROM orders GROUP BY 2
       UNION ALL SELECT 'absent', 'none', count(*), 0.0::DOUBLE FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
)
def records_scan(t: Tables) -> DataFrame:
    records = receipts_written(t)
    present = records.groupBy("status").agg(
        F.count(F.lit(1)).alias("records"), F.round(F.sum(F.element_at("outputs", 1)["size_bytes"]), 2).alias("bytes")
    )
    expected = t.read("customer").select(F.col("c_custkey").alias("candidate_id"))
    absent = readers.absent_records(records, expected, ["candidate_id"]).agg(F.count(F.lit(1)).alias("records"))
    return present.select(F.lit("present").alias("state"), "status", "records", "bytes").unionByName(
        absent.select(F.lit("absent").alias("state"), F.lit("none").alias("status"), "records", F.lit(0.0).alias("bytes"))
    )


@query("parquet_physical")
def parquet_physical(t: Tables) -> DataFrame:
    """Footers of a canonical table as written, and of the given tables, against the station policy."""
    path = scratch(t.spark, "physical")
    write_observations(t.obs(), path)
    both = files.list_files(t.spark, path, "*.parquet").unionByName(files.list_files(t.spark, t.dir, "*.parquet"))
    checked = files.check_parquet_physical(both, files.STATION_TYPES, "zstd")
    name = F.element_at(F.split("path", "/"), -1)
    return checked.select(
        F.when(name.startswith("part-"), "observations").otherwise(name).alias("artifact"),
        (F.col("row_groups") > 0).alias("readable"),
        "columns_ok",
        "types_ok",
        "codec_ok",
    ).distinct()


@query("publish_receipt")
def publish_receipt(t: Tables) -> DataFrame:
    return publish(canonical_columns(t.obs()), scratch(t.spark, "published"))


IDS = """SELECT DISTINCT 'station' AS kind, station_id AS id FROM {0} UNION SELECT DISTINCT 'field', field_id FROM {0}"""


@query(
    "publish_gated",
    f"""WITH other AS (SELECT station_id, CASE WHEN field_id = (SELECT min(field_id) FROM obs) THEN 'other' ELSE field_id END AS field_id FROM obs)
        SELECT 'exact' AS candidate, field_id AS item, count(*) AS row_count FROM obs GROUP BY 2
        UNION ALL SELECT 'copies', 'duplicate_keys', count(*) FROM (SELECT 1 FROM obs_cand GROUP BY station_id, "timestamp", field_id HAVING count(*) > 1)
        UNION ALL SELECT 'renamed', 'undeclared_ids', count(*) FROM ({IDS.format("other")} EXCEPT ({IDS.format("obs")}))
        UNION ALL SELECT 'renamed', 'absent_ids', count(*) FROM ({IDS.format("obs")} EXCEPT ({IDS.format("other")}))""",
)
def publish_gated(t: Tables) -> DataFrame:
    """Three candidates: one is published and read back, two are refused with what their gates counted."""
    obs = t.obs()
    expected = obs.select(F.lit("station").alias("kind"), F.col("station_id").alias("id")).union(obs.select(F.lit("field"), "field_id")).distinct()
    first = F.lit(obs.agg(F.min("field_id")).first()[0])
    renamed = lambda df: df.withColumn("field_id", F.when(F.col("field_id") == first, "other").otherwise(F.col("field_id")))
    candidates = {"exact": (obs, [], expected), "copies": (t.obs_cand(), [], None), "renamed": (obs, [renamed], expected)}
    out = None
    for name, (source, steps, ids) in candidates.items():
        path = scratch(t.spark, f"published-{name}")
        try:
            materialise(source, steps, path, ids)
            rows = scan_published(t.spark, path).groupBy(F.col("field_id").alias("item")).agg(F.count(F.lit(1)).alias("row_count"))
        except NotFit as refused:
            rows = t.spark.createDataFrame(list(refused.faults.items()), "item string, row_count long")
        rows = rows.select(F.lit(name).alias("candidate"), "item", "row_count")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("storage_footprint")
def storage_footprint(t: Tables) -> DataFrame:
    listed = files.list_files(t.spark, t.dir)
    return files.storage_footprint(listed.unionByName(listed))


@query("tree_hash")
def tree_hash(t: Tables) -> DataFrame:
    return files.tree_hash(given_files(t))


@query(
    "inputs_unchanged",
    """SELECT c_custkey AS name, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'missing' WHEN c_mktsegment = 'MACHINERY' THEN 'extra' ELSE 'changed' END AS change FROM customer
       WHERE c_mktsegment IN ('FURNITURE', 'MACHINERY') OR c_acctbal < 0""",
)
def inputs_unchanged(t: Tables) -> DataFrame:
    c, seg = t.read("customer"), F.col("c_mktsegment")
    before = c.filter(seg != "MACHINERY").select(F.col("c_custkey").alias("name"), F.md5("c_name").alias("sha256"))
    body = F.when(F.col("c_acctbal") < 0, F.lower("c_name")).otherwise(F.col("c_name"))
    after = c.filter(seg != "FURNITURE").select(F.col("c_custkey").alias("name"), F.md5(body).alias("sha256"))
    return diff.changed_hashes(before, after, ["name"], ["sha256"])


@query(
    "freeze_drift",
    """SELECT c_nationkey AS owner, c_name AS path, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'missing' WHEN c_mktsegment = 'MACHINERY' THEN 'extra' WHEN c_acctbal < 0 THEN 'content' ELSE 'metadata' END AS drift FROM customer
       WHERE c_mktsegment IN ('FURNITURE', 'MACHINERY') OR c_acctbal < 0 OR c_acctbal > 9000""",
)
def freeze_drift(t: Tables) -> DataFrame:
    c, seg, bal = t.read("customer"), F.col("c_mktsegment"), F.col("c_acctbal")
    owner, path = F.col("c_nationkey").alias("owner"), F.col("c_name").alias("path")
    locked = c.filter(seg != "MACHINERY").select(owner, path, F.md5("c_name").alias("sha256"), F.lit("v1").alias("meta"))
    current = c.filter(seg != "FURNITURE").select(
        owner,
        path,
        F.md5(F.when(bal < 0, F.lower("c_name")).otherwise(F.col("c_name"))).alias("sha256"),
        F.when(bal > 9000, "v2").otherwise("v1").alias("meta"),
    )
    return provenance.freeze_drift(locked, current)


RECEIPT_FIELDS = ["pipeline_id", "output_path", "storage_format", "size_bytes", "file_count", "sha256"]


@query(
    "receipt_mismatch",
    """WITH m AS (SELECT o_orderkey AS run_id, array_to_string(list_filter([CASE WHEN o_orderpriority = '1-URGENT' THEN 'file_count' END, CASE WHEN o_totalprice < 5000 THEN 'sha256' END,
           CASE WHEN o_orderstatus = 'P' THEN 'size_bytes' END], lambda x: x IS NOT NULL), ',') AS mismatches FROM orders)
       SELECT run_id, CAST(len(string_split(mismatches, ',')) AS BIGINT) AS mismatch_count, mismatches FROM m WHERE mismatches <> ''""",
)
def receipt_mismatch(t: Tables) -> DataFrame:
    o = t.read("orders")
    base = dict(
        pipeline_id=F.col("o_custkey").cast("string"),
        output_path=F.concat(F.lit("out/"), "o_orderkey"),
        storage_format=F.lit("parquet"),
        size_bytes=F.col("o_totalprice"),
        file_count=F.lit(3),
        sha256=F.md5(F.col("o_orderkey").cast("string")),
    )
    expected = o.select(F.col("o_orderkey").alias("run_id"), *[c.alias(n) for n, c in base.items()])
    bent = dict(base)
    bent["size_bytes"] = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    bent["file_count"] = F.when(F.col("o_orderpriority") == "1-URGENT", 4).otherwise(3)
    bent["sha256"] = F.when(F.col("o_totalprice") >= 5000, base["sha256"])
    receipts = o.select(F.col("o_orderkey").alias("run_id"), *[c.alias(n) for n, c in bent.items()])
    return provenance.identity_mismatches(receipts, expected, ["run_id"], RECEIPT_FIELDS)


@query(
    "claim_mismatch",
    """WITH m AS (SELECT c_custkey AS candidate_id, array_to_string(list_filter([CASE WHEN c_nationkey = 4 THEN 'dataset_slug' END, CASE WHEN c_acctbal < 0 THEN 'target_format' END], lambda x: x IS NOT NULL), ',') AS mismatches FROM customer)
       SELECT candidate_id, CAST(len(string_split(mismatches, ',')) AS BIGINT) AS mismatch_count, mismatches FROM m WHERE mismatches <> ''""",
)
def claim_mismatch(t: Tables) -> DataFrame:
    c = t.read("customer")
    key = F.col("c_custkey").alias("candidate_id")
    observed = c.select(key, F.col("c_mktsegment").alias("dataset_slug"), F.lit("parquet").alias("target_format"), F.col("c_name").alias("entry_point"))
    claims = c.select(
        key,
        F.when(F.col("c_nationkey") == 4, "other").otherwise(F.col("c_mktsegment")).alias("dataset_slug"),
        F.when(F.col("c_acctbal") < 0, "zarr").otherwise("parquet").alias("target_format"),
        F.col("c_name").alias("entry_point"),
    )
    return provenance.identity_mismatches(claims, observed, ["candidate_id"], ["dataset_slug", "target_format", "entry_point"])


# Hashes every run has to record.
REQUIRED_IDENTITIES = (
    "suite", "evaluator_source_bundle", "contract_lock", "inventory", "pipeline_contract", "manifest",
    "candidate_source_bundle", "reference_artifact", "reference_content_id", "frozen_cache",
    "logical_output_initial", "logical_output_rerun",
)


@query(
    "missing_identities",
    f"""WITH r AS (SELECT l_orderkey AS run_id, {list(REQUIRED_IDENTITIES)}[l_linenumber] AS name FROM lineitem WHERE l_tax > 0)
        SELECT o_orderkey AS run_id, n.name FROM orders, (SELECT unnest({list(REQUIRED_IDENTITIES)}) AS name) n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.run_id = o_orderkey AND r.name = n.name)""",
)
def missing_identities(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(n) for n in REQUIRED_IDENTITIES])
    recorded = t.read("lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.element_at(names, F.col("l_linenumber")).alias("name"),
        F.when(F.col("l_tax") > 0, F.md5(F.col("l_partkey").cast("string"))).alias("sha256"),
    )
    return provenance.missing_identities(t.read("orders").select(F.col("o_orderkey").alias("run_id")), recorded, REQUIRED_IDENTITIES)


@query(
    "cache_evidence",
    f"""WITH p AS (SELECT l_orderkey AS run_id, 'k' || l_partkey || '/' || l_linenumber AS partition_key, l_returnflag AS f FROM lineitem),
        c AS (SELECT run_id, count(*) FILTER (f = 'A') AS hits, count(*) FILTER (f = 'N') AS misses, count(*) FILTER (f = 'R') AS acquired FROM p GROUP BY 1),
        k AS (SELECT run_id, f, sha256(concat_ws(':', count(*), {LANES})) AS mark FROM (SELECT run_id, f, sha256(partition_key) AS h FROM p WHERE f IN ('A', 'R')) GROUP BY 1, 2)
        SELECT c.*, r.mark AS reused_keys, a.mark AS acquired_keys FROM c LEFT JOIN k r ON c.run_id = r.run_id AND r.f = 'A' LEFT JOIN k a ON c.run_id = a.run_id AND a.f = 'R'""",
)
def cache_evidence(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    partitions = t.read("lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.concat(F.lit("k"), "l_partkey", F.lit("/"), "l_linenumber").alias("partition_key"),
        F.when(flag == "A", "hit").when(flag == "N", "miss").otherwise("acquired").alias("state"),
    )
    return provenance.cache_evidence(partitions, ["run_id"])


@query(
    "path_overlap",
    """WITH f AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS bundle, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages),
       d AS (SELECT DISTINCT bundle, p AS prefix FROM (SELECT bundle, unnest([split_part(path, '/', 1), CASE WHEN starts_with(path, 'en/') THEN path ELSE 'fr' END]) AS p FROM f))
       SELECT f.bundle, f.path, count(*) AS reached_from FROM f JOIN d ON f.bundle = d.bundle AND (f.path = d.prefix OR starts_with(f.path, d.prefix || '/')) GROUP BY 1, 2 HAVING count(*) > 1""",
)
def path_overlap(t: Tables) -> DataFrame:
    f = t.read("pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("bundle"), F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1).alias("path")
    )
    top = F.split_part("path", F.lit("/"), F.lit(1))
    declared = f.select("bundle", F.explode(F.array(top, F.when(F.col("path").startswith("en/"), F.col("path")).otherwise("fr"))).alias("prefix"))
    return provenance.path_overlap(f, declared)


@query(
    "credential_union",
    """SELECT o_orderpriority AS owner, 'KEY_' || (o_custkey % 50) AS name FROM orders UNION SELECT o_orderpriority, 'TOKEN_' || o_orderstatus FROM orders""",
)
def credential_union(t: Tables) -> DataFrame:
    o = t.read("orders")
    owner = F.col("o_orderpriority").alias("owner")
    return provenance.credential_union(
        o.select(owner, F.concat(F.lit("KEY_"), F.col("o_custkey") % 50).alias("name")),
        o.select(owner, F.concat(F.lit("TOKEN_"), "o_orderstatus").alias("name")),
    )


@query(
    "id_set_diff",
    """SELECT id, 'missing' AS difference FROM (SELECT o_orderkey AS id FROM orders EXCEPT SELECT l_orderkey * 2 FROM lineitem)
       UNION ALL SELECT id, 'extra' FROM (SELECT l_orderkey * 2 AS id FROM lineitem EXCEPT SELECT o_orderkey FROM orders)""",
)
def id_set_diff(t: Tables) -> DataFrame:
    expected = t.read("orders").select(F.col("o_orderkey").alias("id"))
    observed = t.read("lineitem").select((F.col("l_orderkey") * 2).alias("id"))
    return diff.id_set_diff(expected, observed, ["id"])
