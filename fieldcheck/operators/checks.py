"""Evaluation checks: the catalog, plan resolution, gate coverage and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldcheck.functions.columns import flags

CORE = ("core",)
GRID = ("regular-grid",)
ZARR = ("zarr",)
ZARR_V3 = ("zarr", "zarr-v3")
TENSOR = ("workload:full-field-tensor",)
STATION = ("data-class:station-time-series",)
PARQUET = ("parquet",)
STATION_SCAN = ("workload:filtered-station-scan",)
RUBRIC = ("engineering:meroda",)
ALTERNATE = ("robustness:alternate-contract",)

# Check id, layer, role, required profile tags, required parameter roots.
CATALOG = (
    ("contract.declared_metadata", "data_class", "hard_gate", GRID, ("grid",)),
    ("contract.filtered_station_scan", "workload", "hard_gate", STATION_SCAN, ("workload",)),
    ("contract.grounding", "core", "hard_gate", CORE, ("candidate_source", "contract_lock", "execution", "inventory")),
    ("contract.initial_execution", "core", "hard_gate", CORE, ("execution",)),
    ("contract.initial_materialization", "core", "hard_gate", CORE, ()),
    ("contract.parquet_integrity", "output_format", "hard_gate", PARQUET, ("output_policy",)),
    ("contract.pytorch_consumer", "workload", "hard_gate", TENSOR, ("grid", "workload")),
    ("contract.reference_integrity", "data_class", "hard_gate", GRID, ("grid", "reference")),
    ("contract.scope_coordinates", "data_class", "hard_gate", GRID, ("comparison", "grid")),
    ("contract.station_reference_integrity", "data_class", "hard_gate", STATION, ("reference", "table")),
    ("contract.station_scope_and_keys", "data_class", "hard_gate", STATION, ("table",)),
    ("contract.zarr_integrity", "output_format", "hard_gate", ZARR, ("comparison", "grid")),
    ("contract.zarr_output_policy", "output_format", "hard_gate", ZARR_V3, ("output_policy",)),
    ("engineering.meroda", "engineering", "assessment", RUBRIC, ("candidate_source", "engineering_quality")),
    ("objective.consumer_samples_per_second", "objective", "objective", CORE, ("workload",)),
    ("objective.materialization_seconds", "objective", "objective", CORE, ("execution",)),
    ("objective.output_bytes", "objective", "objective", CORE, ("grid",)),
    ("provenance.candidate_claims", "core", "hard_gate", CORE, ("execution",)),
    ("provenance.identities", "core", "hard_gate", CORE, ()),
    ("provenance.receipt.initial", "core", "hard_gate", CORE, ()),
    ("provenance.receipt.rerun", "core", "hard_gate", CORE, ()),
    ("provenance.receipts", "core", "hard_gate", CORE, ()),
    ("provenance.trusted_inputs_unchanged", "core", "hard_gate", CORE, ()),
    ("rerun.declared_metadata", "data_class", "hard_gate", GRID, ("grid",)),
    ("rerun.execution", "core", "hard_gate", CORE, ("execution",)),
    ("rerun.logical_equivalence", "core", "hard_gate", CORE, ("comparison",)),
    ("rerun.public_output_policy", "output_format", "hard_gate", ZARR_V3, ("output_policy",)),
    ("rerun.station_logical_equivalence", "data_class", "hard_gate", STATION, ("output_policy",)),
    ("rerun.zarr_output_policy", "output_format", "hard_gate", ZARR_V3, ("output_policy",)),
    ("robustness.alternate_contract", "robustness", "assessment", ALTERNATE, ("extensibility_probe",)),
    ("security.execution_isolation", "core", "hard_gate", CORE, ("execution_policy",)),
    ("security.secret_scan", "core", "hard_gate", CORE, ("security",)),
    ("semantic.native_values_and_missingness", "data_class", "hard_gate", GRID, ("comparison", "grid")),
    ("semantic.station_values_and_missingness", "data_class", "hard_gate", STATION, ("table",)),
)
MANDATORY_CORE = tuple(c[0] for c in CATALOG if c[1] == "core")
SEMANTIC_GATES = {
    "regular_rectilinear_grid": "semantic.native_values_and_missingness",
    "station_time_series": "semantic.station_values_and_missingness",
}
TAG_NAMESPACES = ("dataset:", "domain:", "family:", "provider:")
LAYER_LABELS = {
    "core": "Core",
    "data_class": "Data Structure",
    "output_format": "Output Format",
    "workload": "Consumer Workload",
    "objective": "Objectives",
    "engineering": "Engineering Quality",
}
MAPPING_LABEL = "Dataset Mapping/Oracle"
CONSTRAINTS = ("contract_correctness", "semantic_equivalence", "rerun_safety", "provenance_security")
STATUS_ORDER = ("PASS", "NOT_ASSESSED", "FAIL", "ERROR")


def values_sql(rows: Sequence[Sequence[str]]) -> str:
    """Inline rows of texts for a VALUES clause."""
    quote = lambda v: "'" + str(v).replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(quote(v) for v in row) + ")" for row in rows)


def catalog_table(spark: SparkSession) -> DataFrame:
    """The catalog as rows: check_id, layer, role, required tags and parameter roots as arrays."""
    rows = [(i, layer, role, " ".join(tags), " ".join(roots)) for i, layer, role, tags, roots in CATALOG]
    text = spark.sql(f"SELECT * FROM {values_sql(rows)} AS c(check_id, layer, role, tags, roots)")
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    return text.select("check_id", "layer", "role", words("tags").alias("tags"), words("roots").alias("roots"))


def profile_tags(
    data_class: Column, fmt: Column, version: Column, workload: Column, dataset_tags: Column, engineering: Column, probe: Column
) -> Column:
    """Sorted distinct selection tags of an evaluation profile."""
    kind = F.when(data_class == "regular_rectilinear_grid", "regular-grid").otherwise(
        F.concat(F.lit("data-class:"), F.replace(data_class, F.lit("_"), F.lit("-")))
    )
    base = F.array(
        F.lit("core"),
        kind,
        fmt,
        F.concat(F.lit("workload:"), F.replace(workload, F.lit("_"), F.lit("-"))),
        F.when(version.isNotNull(), F.concat(fmt, F.lit("-v"), version.cast("string"))),
        F.when(engineering, F.lit("engineering:meroda")),
        F.when(probe, F.lit("robustness:alternate-contract")),
    )
    return F.sort_array(F.array_distinct(F.array_compact(F.concat(base, dataset_tags))))


def check_plan(profiles: DataFrame, catalog: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Checks whose required tags are all among the profile's tags, with the columns `also` of the profile.

    A check is found by an equi-join on one of its tags; the others are looked up in the profile's row, so
    nothing is grouped and a task holds one row at a time.
    """
    need = catalog.select("check_id", "layer", "role", F.col("tags").alias("_need"), F.element_at("tags", -1).alias("_tag"))
    have = profiles.select("profile_id", *also, F.col("tags").alias("_tags"), F.explode(F.array_distinct("tags")).alias("_tag"))
    return (
        have.join(need.filter(F.size("_need") > 0), "_tag")
        .filter(F.size(F.array_except("_need", "_tags")) == 0)
        .select("profile_id", *also, "check_id", "layer", "role")
    )


def gate_problems(profiles: DataFrame, plan: DataFrame, emitted: DataFrame) -> DataFrame:
    """Mandatory gates missing from a plan and emitted checks no hard gate of the plan covers.

    The gates of a plan are folded to one row a profile, which the catalog bounds; both sides look them up there.
    """
    gates = plan.filter(F.col("role") == "hard_gate").groupBy("profile_id").agg(F.collect_set("check_id").alias("_gates"))
    held = F.coalesce("_gates", F.array().cast("array<string>"))
    semantic = F.lit(None).cast("string")
    for kind, gate in SEMANTIC_GATES.items():
        semantic = F.when(F.col("data_class") == kind, gate).otherwise(semantic)
    required = F.array_compact(F.concat(F.array(*[F.lit(c) for c in MANDATORY_CORE]), F.array(semantic)))
    key = ["profile_id", "check_id"]
    must = profiles.select("profile_id", required.alias("_must")).join(gates, "profile_id", "left")
    lacking = must.select("profile_id", F.explode(F.array_except("_must", held)).alias("check_id"))
    sent = emitted.select(*key).distinct().join(gates, "profile_id", "left")
    foreign = sent.filter(~F.coalesce(F.array_contains("_gates", F.col("check_id")), F.lit(False))).select(*key)
    problem = lambda df, name: df.withColumn("problem", F.lit(name))
    return problem(lacking, "mandatory_missing").unionByName(problem(foreign, "outside_plan"))


def instance_problems(instances: DataFrame, catalog: DataFrame) -> DataFrame:
    """Declarative instances (instance_id, check_id, params map) against the trusted catalog."""
    roots = catalog.select("check_id", "roots")
    lacking = F.sort_array(F.array_except("roots", F.map_keys("params")))
    return instances.join(roots, "check_id", "left").select(
        "instance_id",
        "check_id",
        F.when(F.col("roots").isNull(), "unknown_check")
        .when(F.size(lacking) > 0, "missing_parameters")
        .otherwise("bound")
        .alias("status"),
        F.coalesce(F.concat_ws(",", lacking), F.lit("")).alias("missing"),
    )


def tag_problems(tags: Column, *names: Column) -> Column:
    """Broken rules of a profile's dataset tags and canonical names."""
    allowed = lambda w: F.exists(F.array(*[F.lit(n) for n in TAG_NAMESPACES]), lambda n: w.startswith(n))
    plain = F.lit(True)
    for name in names:
        plain = plain & (name == F.lower(name)) & ~name.contains(" ")
    return flags(
        ("name_not_canonical", ~plain),
        ("tag_namespace", ~F.forall(tags, allowed)),
        ("tag_repeated", F.size(F.array_distinct(tags)) != F.size(tags)),
    )


def status_rank(status: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, name in enumerate(STATUS_ORDER):
        out = F.when(status == name, i).otherwise(out)
    return out


def status_name(rank: Column) -> Column:
    out = F.lit("NOT_ASSESSED")
    for i, name in enumerate(STATUS_ORDER):
        out = F.when(rank == i, name).otherwise(out)
    return out


def constraint_rollup(checks: DataFrame) -> DataFrame:
    """Worst status per constraint in one pass; no check means NOT_ASSESSED; feasible needs four PASS."""
    worst = [
        F.max(F.when(F.col("constraint") == c, status_rank(F.col("status")))).alias(f"_{c}") for c in CONSTRAINTS
    ]
    rolled = checks.groupBy("candidate_id").agg(*worst)
    feasible = F.lit(True)
    for c in CONSTRAINTS:
        feasible = feasible & F.coalesce(F.col(f"_{c}") == 0, F.lit(False))
    return rolled.select(
        "candidate_id", *[status_name(F.col(f"_{c}")).alias(c) for c in CONSTRAINTS], feasible.alias("feasible")
    )


def feedback(checks: DataFrame) -> DataFrame:
    """Distinct feedback codes of non-passing checks per candidate, in first-seen order.

    Rows are folded to (candidate, code) before they are numbered, so a window holds at most one
    row per code.
    """
    folded = (
        checks.filter(F.col("status") != "PASS")
        .groupBy("candidate_id", "feedback_code")
        .agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("signals"))
    )
    place = F.row_number().over(Window.partitionBy("candidate_id").orderBy("first_seq"))
    return folded.withColumn("position", place)


def acceptance_rollup(checks: DataFrame, reports: DataFrame) -> DataFrame:
    """Passed iff a required check exists and all pass; advisory checks do not count.

    `reports` holds the declared final_status, origin and repair reference of each candidate.
    """
    required = F.col("required")
    rolled = checks.groupBy("candidate_id").agg(
        F.count_if(required).alias("required_checks"),
        F.count_if(required & (F.col("status") != "PASS")).alias("failed"),
    )
    passed = (F.coalesce("required_checks", F.lit(0)) > 0) & (F.coalesce("failed", F.lit(0)) == 0)
    derived = F.when(passed, "passed").otherwise("failed")
    has_ref = F.coalesce(F.col("repair_reference"), F.lit("")) != ""
    return reports.join(rolled, "candidate_id", "left").select(
        "candidate_id",
        F.coalesce("required_checks", F.lit(0)).alias("required_checks"),
        derived.alias("derived_status"),
        flags(
            ("status_mismatch", F.col("final_status") != derived),
            ("repair_without_reference", (F.col("origin") == "repaired") & ~has_ref),
            ("reference_without_repair", (F.col("origin") == "generated") & has_ref),
        ).alias("problems"),
    )


def coverage_matrix(runs: DataFrame, checks: DataFrame) -> DataFrame:
    """Resolved checks per dataset and category, from the first run that has any.

    runs(dataset, run_id, success), checks(dataset, run_id, layer).
    """
    per_run = checks.groupBy("dataset", "run_id").agg(
        *[F.count_if(F.col("layer") == layer).alias(f"_{layer}") for layer in LAYER_LABELS]
    )
    counts = F.struct(*[f"_{layer}" for layer in LAYER_LABELS])
    first = per_run.groupBy("dataset").agg(F.min_by(counts, "run_id").alias("_c"))
    good = runs.groupBy("dataset").agg(F.bool_and("success").alias("_ok"))
    cells = [
        F.struct(F.lit(label).alias("category"), F.coalesce(F.col(f"_c._{layer}"), F.lit(0)).alias("resolved"))
        for layer, label in LAYER_LABELS.items()
    ]
    mapping = F.when(F.col("_c").isNotNull(), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    cells.append(F.struct(F.lit(MAPPING_LABEL).alias("category"), mapping.alias("resolved")))
    return (
        good.join(first, "dataset", "left")
        .select("dataset", "_ok", F.explode(F.array(*cells)).alias("_x"))
        .select(
            "dataset",
            "_x.category",
            "_x.resolved",
            F.when(F.col("_ok") & (F.col("_x.resolved") > 0), "resolved").otherwise("invalid").alias("state"),
        )
    )


def mandatory_recall(planned: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of a dataset's expected checks a run planned (1 when none are expected), and the surplus."""
    sizes = expected.groupBy("dataset").agg(F.count(F.lit(1)).alias("_e"))
    known = expected.select("dataset", "check_id", F.lit(True).alias("_want"))
    marked = planned.distinct().join(known, ["dataset", "check_id"], "left")
    per_run = marked.groupBy("run_id", "dataset").agg(
        F.count("_want").alias("hits"), F.count_if(F.col("_want").isNull()).alias("unauthorized")
    )
    return per_run.join(sizes, "dataset", "left").select(
        "run_id",
        "dataset",
        "hits",
        "unauthorized",
        F.when(F.col("_e").isNull(), 1.0).otherwise(F.col("hits") / F.col("_e")).alias("recall"),
    )


def field_sets(contract: DataFrame, artifact: DataFrame) -> DataFrame:
    """Field lists (run_id, pos, field) of contract and artifact: missing, extra, repeated, order."""
    side = lambda df, n: df.select("run_id", "pos", "field", F.lit(n).alias("_s"))
    both = side(contract, 1).unionByName(side(artifact, 2))
    mine = F.col("_s") == 1
    per_field = both.groupBy("run_id", "field").agg(
        F.count_if(mine).alias("_c"),
        F.count_if(~mine).alias("_a"),
        F.min(F.when(mine, F.col("pos"))).alias("_pc"),
        F.min(F.when(~mine, F.col("pos"))).alias("_pa"),
    )
    rolled = per_field.groupBy("run_id").agg(
        F.count_if(F.col("_a") == 0).alias("missing"),
        F.count_if(F.col("_c") == 0).alias("extra"),
        F.count_if(F.col("_a") > 1).alias("repeated"),
        F.bool_and(F.col("_pc").eqNullSafe(F.col("_pa"))).alias("same_order"),
    )
    return rolled.withColumn("equal", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("repeated") == 0))


def promotion_failures(catalog_version: str) -> Column:
    """Reasons a proposed check stays quarantined, from its evidence columns."""
    empty = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) == 0
    return flags(
        ("catalog_version_unchanged", F.col("proposed_catalog_version") == catalog_version),
        ("mutation_tests", empty("mutation_test_ids")),
        ("negative_tests", empty("negative_test_ids")),
        ("no_independent_oracle", F.coalesce(F.col("oracle_path"), F.lit("")) == ""),
        ("not_quarantined", ~F.col("implementation_path").startswith(QUARANTINE)),
        ("positive_tests", empty("positive_test_ids")),
        ("provider_network", ~F.col("network_disabled")),
        ("sandbox", ~F.col("sandbox_verified")),
        ("secret_access", ~F.col("secrets_disabled")),
    )


# Fixed value: folder proposed checks have to live in.
QUARANTINE = "project/benchmarks/evaluation_check_candidates/"


def plan_complete(data_class: Column, axes: Column, has_station: Column, compatible: Column, proposals: Column) -> Column:
    """Reasons a plan is not complete; empty text when it is."""
    grid = data_class == "regular_rectilinear_grid"
    wanted = F.sort_array(F.array(F.lit("sample"), F.lit("y"), F.lit("x")))
    valid = F.when(grid, (F.sort_array(F.array_distinct(axes)) == wanted) & ~has_station).otherwise(
        (F.size(axes) == 0) & has_station
    )
    return flags(("incompatible", ~compatible), ("mapping_invalid", ~valid), ("open_proposals", proposals > 0))
