"""Check catalog, plan, gate and roll-up queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcheck.operators import checks
from fieldcheck.plans.registry import Tables, query

CATALOG_TAGS = checks.values_sql(
    [(i, layer, role, tag, len(tags)) for i, layer, role, tags, _ in checks.CATALOG for tag in tags]
)
CATALOG_CTE = f"""
catalog AS (SELECT check_id, layer, role, tag, CAST(need AS INTEGER) AS need FROM ({CATALOG_TAGS}) c(check_id, layer, role, tag, need)),
profiles AS (SELECT c_custkey AS profile_id, CASE WHEN c_nationkey % 2 = 0 THEN 'regular_rectilinear_grid' ELSE 'station_time_series' END AS data_class,
               c_nationkey % 2 = 0 AS is_grid, c_nationkey % 4 = 0 AS v3, c_acctbal, c_mktsegment FROM customer),
tags AS (SELECT profile_id, unnest(['core', CASE WHEN is_grid THEN 'regular-grid' ELSE 'data-class:station-time-series' END,
             CASE WHEN is_grid THEN 'zarr' ELSE 'parquet' END,
             CASE WHEN is_grid THEN 'workload:full-field-tensor' ELSE 'workload:filtered-station-scan' END,
             CASE WHEN v3 THEN 'zarr-v3' END, CASE WHEN c_acctbal > 0 THEN 'engineering:meroda' END,
             CASE WHEN c_acctbal > 5000 THEN 'robustness:alternate-contract' END, 'domain:' || lower(c_mktsegment)]) AS tag FROM profiles),
plan AS (SELECT profile_id, check_id, layer, role FROM tags JOIN catalog USING (tag) GROUP BY profile_id, check_id, layer, role, need HAVING count(*) = need)"""


def profiles(t: Tables) -> DataFrame:
    grid = F.col("c_nationkey") % 2 == 0
    data_class = F.when(grid, "regular_rectilinear_grid").otherwise("station_time_series")
    return t.spread("customer", "c_custkey").select(
        F.col("c_custkey").alias("profile_id"),
        data_class.alias("data_class"),
        "c_acctbal",
        checks.profile_tags(
            data_class,
            F.when(grid, "zarr").otherwise("parquet"),
            F.when(F.col("c_nationkey") % 4 == 0, 3),
            F.when(grid, "full_field_tensor").otherwise("filtered_station_scan"),
            F.array(F.concat(F.lit("domain:"), F.lower("c_mktsegment"))),
            F.col("c_acctbal") > 0,
            F.col("c_acctbal") > 5000,
        ).alias("tags"),
    )


@query("check_plan", f"WITH {CATALOG_CTE} SELECT profile_id, check_id, layer, role FROM plan")
def check_plan(t: Tables) -> DataFrame:
    return checks.check_plan(profiles(t), checks.catalog_table(t.spark))


MANDATORY = checks.values_sql([(c,) for c in checks.MANDATORY_CORE])


@query(
    "mandatory_gates",
    f"""WITH {CATALOG_CTE}, kept AS (SELECT plan.* FROM plan JOIN customer ON profile_id = c_custkey
              WHERE NOT (check_id = 'security.secret_scan' AND c_acctbal < 0) AND NOT (layer = 'data_class' AND c_acctbal > 9000)),
        gates AS (SELECT profile_id, check_id FROM kept WHERE role = 'hard_gate'),
        must AS (SELECT profile_id, check_id FROM profiles, ({MANDATORY}) m(check_id)
                 UNION ALL SELECT profile_id, CASE WHEN is_grid THEN 'semantic.native_values_and_missingness' ELSE 'semantic.station_values_and_missingness' END FROM profiles),
        emitted AS (SELECT DISTINCT o_custkey AS profile_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'contract.grounding' WHEN '2-HIGH' THEN 'contract.zarr_integrity'
              WHEN '3-MEDIUM' THEN 'objective.output_bytes' WHEN '4-NOT SPECIFIED' THEN 'contract.public_output_policy' ELSE 'security.secret_scan' END AS check_id FROM orders)
        SELECT profile_id, check_id, 'mandatory_missing' AS problem FROM must ANTI JOIN gates USING (profile_id, check_id)
        UNION ALL SELECT profile_id, check_id, 'outside_plan' FROM emitted ANTI JOIN gates USING (profile_id, check_id)""",
)
def mandatory_gates(t: Tables) -> DataFrame:
    """Plans that lost a gate by hand, and emitted checks a plan does not cover."""
    p = profiles(t)
    plan = checks.check_plan(p, checks.catalog_table(t.spark), also=["c_acctbal"])
    lost = ((F.col("check_id") == "security.secret_scan") & (F.col("c_acctbal") < 0)) | (
        (F.col("layer") == "data_class") & (F.col("c_acctbal") > 9000)
    )
    pr = F.col("o_orderpriority")
    emitted = t.read("orders").select(
        F.col("o_custkey").alias("profile_id"),
        F.when(pr == "1-URGENT", "contract.grounding")
        .when(pr == "2-HIGH", "contract.zarr_integrity")
        .when(pr == "3-MEDIUM", "objective.output_bytes")
        .when(pr == "4-NOT SPECIFIED", "contract.public_output_policy")
        .otherwise("security.secret_scan")
        .alias("check_id"),
    )
    return checks.gate_problems(p, plan.filter(~lost), emitted)


CATALOG_ROOTS = checks.values_sql([(i, " ".join(roots)) for i, _, _, _, roots in checks.CATALOG])


@query(
    "check_instances",
    f"""WITH roots AS (SELECT check_id, list_filter(string_split(r, ' '), lambda w: w <> '') AS roots FROM ({CATALOG_ROOTS}) c(check_id, r)),
         i AS (SELECT o_orderkey AS instance_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'contract.grounding' WHEN '2-HIGH' THEN 'semantic.native_values_and_missingness'
                 WHEN '3-MEDIUM' THEN 'provenance.identities' WHEN '4-NOT SPECIFIED' THEN 'security.secret_scan' ELSE 'custom.check' END AS check_id,
                 CASE o_orderstatus WHEN 'F' THEN ['grid', 'comparison'] WHEN 'O' THEN ['execution', 'security'] ELSE ['inventory', 'contract_lock', 'execution', 'candidate_source'] END AS given FROM orders),
         j AS (SELECT instance_id, i.check_id, roots, list_sort(list_filter(roots, lambda r: NOT list_contains(given, r))) AS lacking FROM i LEFT JOIN roots ON i.check_id = roots.check_id)
        SELECT instance_id, check_id, CASE WHEN roots IS NULL THEN 'unknown_check' WHEN len(lacking) > 0 THEN 'missing_parameters' ELSE 'bound' END AS status,
               coalesce(array_to_string(lacking, ','), '') AS missing FROM j""",
)
def check_instances(t: Tables) -> DataFrame:
    pr, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    given = lambda *roots: F.array(*[F.lit(r) for r in roots])
    roots = F.when(st == "F", given("grid", "comparison")).when(st == "O", given("execution", "security")).otherwise(
        given("inventory", "contract_lock", "execution", "candidate_source")
    )
    instances = t.read("orders").select(
        F.col("o_orderkey").alias("instance_id"),
        F.when(pr == "1-URGENT", "contract.grounding")
        .when(pr == "2-HIGH", "semantic.native_values_and_missingness")
        .when(pr == "3-MEDIUM", "provenance.identities")
        .when(pr == "4-NOT SPECIFIED", "security.secret_scan")
        .otherwise("custom.check")
        .alias("check_id"),
        F.map_from_arrays(roots, F.transform(roots, lambda r: F.lit("set"))).alias("params"),
    )
    return checks.instance_problems(instances, checks.catalog_table(t.spark))


@query(
    "tag_rules",
    """WITH p AS (SELECT p_partkey, p_type AS kind, ['domain:' || p_type, 'provider:' || p_brand] ||
                 CASE WHEN p_size > 40 THEN ['provider:' || p_brand] WHEN p_size < 10 THEN ['level:' || p_size] ELSE [] END AS tags FROM part)
       SELECT p_partkey, array_to_string(list_filter([CASE WHEN kind <> lower(kind) OR contains(kind, ' ') THEN 'name_not_canonical' END,
          CASE WHEN len(list_filter(tags, lambda w: NOT regexp_matches(w, '^(dataset:|domain:|family:|provider:)'))) > 0 THEN 'tag_namespace' END,
          CASE WHEN len(list_distinct(tags)) <> len(tags) THEN 'tag_repeated' END], lambda x: x IS NOT NULL), ',') AS problems FROM p""",
)
def tag_rules(t: Tables) -> DataFrame:
    base = F.array(F.concat(F.lit("domain:"), "p_type"), F.concat(F.lit("provider:"), "p_brand"))
    more = F.when(F.col("p_size") > 40, F.array(F.concat(F.lit("provider:"), "p_brand"))).when(
        F.col("p_size") < 10, F.array(F.concat(F.lit("level:"), F.col("p_size").cast("string")))
    )
    tags = F.concat(base, F.coalesce(more, F.array().cast("array<string>")))
    return t.read("part").select("p_partkey", checks.tag_problems(tags, F.col("p_type")).alias("problems"))


@query(
    "constraint_rollup",
    """WITH r AS (SELECT candidate_id, "constraint" AS c, max(CASE status WHEN 'ERROR' THEN 3 WHEN 'FAIL' THEN 2 WHEN 'NOT_ASSESSED' THEN 1 ELSE 0 END) AS s FROM checks GROUP BY 1, 2),
       p AS (SELECT candidate_id, max(s) FILTER (c = 'contract_correctness') AS a, max(s) FILTER (c = 'semantic_equivalence') AS b,
               max(s) FILTER (c = 'rerun_safety') AS d, max(s) FILTER (c = 'provenance_security') AS e FROM r GROUP BY 1)
       SELECT candidate_id, ['PASS', 'NOT_ASSESSED', 'FAIL', 'ERROR'][coalesce(a, 1) + 1] AS contract_correctness,
         ['PASS', 'NOT_ASSESSED', 'FAIL', 'ERROR'][coalesce(b, 1) + 1] AS semantic_equivalence,
         ['PASS', 'NOT_ASSESSED', 'FAIL', 'ERROR'][coalesce(d, 1) + 1] AS rerun_safety,
         ['PASS', 'NOT_ASSESSED', 'FAIL', 'ERROR'][coalesce(e, 1) + 1] AS provenance_security,
         coalesce(a, 1) + coalesce(b, 1) + coalesce(d, 1) + coalesce(e, 1) = 0 AS feasible FROM p""",
)
def constraint_rollup(t: Tables) -> DataFrame:
    return checks.constraint_rollup(t.checks())


@query(
    "feedback",
    """WITH g AS (SELECT candidate_id, feedback_code, min(seq) AS first_seq, count(*) AS signals FROM checks WHERE status <> 'PASS' GROUP BY 1, 2)
       SELECT *, CAST(row_number() OVER (PARTITION BY candidate_id ORDER BY first_seq) AS INTEGER) AS position FROM g""",
)
def feedback(t: Tables) -> DataFrame:
    return checks.feedback(t.checks())


@query(
    "acceptance_rollup",
    """WITH r AS (SELECT candidate_id, count(*) FILTER (required) AS n, count(*) FILTER (required AND status <> 'PASS') AS f FROM checks GROUP BY 1),
       j AS (SELECT c_custkey AS candidate_id, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) > 0 AND f = 0 THEN 'passed' ELSE 'failed' END AS derived,
               CASE WHEN c_acctbal > 2000 THEN 'passed' ELSE 'failed' END AS declared, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'repaired' ELSE 'generated' END AS origin,
               c_acctbal > 0 AS has_ref FROM customer LEFT JOIN r ON c_custkey = candidate_id)
       SELECT candidate_id, n AS required_checks, derived AS derived_status, array_to_string(list_filter([
         CASE WHEN origin = 'generated' AND has_ref THEN 'reference_without_repair' END, CASE WHEN origin = 'repaired' AND NOT has_ref THEN 'repair_without_reference' END,
         CASE WHEN derived <> declared THEN 'status_mismatch' END], lambda x: x IS NOT NULL), ',') AS problems FROM j""",
)
def acceptance_rollup(t: Tables) -> DataFrame:
    reports = t.read("customer").select(
        F.col("c_custkey").alias("candidate_id"),
        F.when(F.col("c_acctbal") > 2000, "passed").otherwise("failed").alias("final_status"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "repaired").otherwise("generated").alias("origin"),
        F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("repair_reference"),
    )
    return checks.acceptance_rollup(t.checks(), reports)


LAYERS = [*checks.LAYER_LABELS, "robustness"]


@query(
    "coverage_matrix",
    f"""WITH c AS (SELECT o_custkey AS dataset, o_orderkey AS run_id, {LAYERS}[l_linenumber] AS layer FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        rep AS (SELECT dataset, min(run_id) AS run_id FROM c GROUP BY 1),
        good AS (SELECT o_custkey AS dataset, bool_and(o_totalprice > 20000) AS ok FROM orders GROUP BY 1),
        labels_(layer, category) AS ({checks.values_sql(list(checks.LAYER_LABELS.items()))}),
        n AS (SELECT g.dataset, ok, category, (SELECT count(*) FROM c JOIN rep USING (dataset, run_id) WHERE c.dataset = g.dataset AND c.layer = l.layer) AS resolved FROM good g, labels_ l
              UNION ALL SELECT g.dataset, ok, '{checks.MAPPING_LABEL}', CASE WHEN rep.dataset IS NOT NULL THEN 1 ELSE 0 END FROM good g LEFT JOIN rep ON g.dataset = rep.dataset)
        SELECT dataset, category, CAST(resolved AS BIGINT) AS resolved, CASE WHEN ok AND resolved > 0 THEN 'resolved' ELSE 'invalid' END AS state FROM n""",
)
def coverage_matrix(t: Tables) -> DataFrame:
    o = t.read("orders").select(
        F.col("o_custkey").alias("dataset"), F.col("o_orderkey").alias("run_id"), (F.col("o_totalprice") > 20000).alias("success")
    )
    names = F.array(*[F.lit(x) for x in LAYERS])
    lines = (
        t.read("lineitem")
        .select(F.col("l_orderkey").alias("run_id"), F.element_at(names, F.col("l_linenumber")).alias("layer"))
    )
    planned = lines.join(o.select("dataset", "run_id"), "run_id")
    return checks.coverage_matrix(o, planned)


ALL_IDS = [c[0] for c in checks.CATALOG]


@query(
    "mandatory_recall",
    f"""WITH p AS (SELECT DISTINCT l_orderkey AS run_id, o_orderpriority AS dataset, {ALL_IDS}[l_partkey % 34 + 1] AS check_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        e AS (SELECT DISTINCT o_orderpriority AS dataset, id AS check_id FROM orders, (SELECT unnest({ALL_IDS}) AS id) WHERE length(id) % 5 = CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1),
        s AS (SELECT dataset, count(*) AS n FROM e GROUP BY 1),
        j AS (SELECT p.run_id, p.dataset, count(e.check_id) AS hits, count(*) - count(e.check_id) AS unauthorized FROM p LEFT JOIN e ON p.dataset = e.dataset AND p.check_id = e.check_id GROUP BY 1, 2)
        SELECT run_id, j.dataset, hits, unauthorized, round(CASE WHEN s.n IS NULL THEN 1.0 ELSE hits / s.n END, 9) AS recall FROM j LEFT JOIN s ON j.dataset = s.dataset""",
)
def mandatory_recall(t: Tables) -> DataFrame:
    o = t.read("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("dataset"))
    ids = F.array(*[F.lit(i) for i in ALL_IDS])
    planned = (
        t.spread("lineitem", "l_orderkey")
        .select(F.col("l_orderkey").alias("run_id"), F.element_at(ids, (F.col("l_partkey") % 34 + 1).cast("int")).alias("check_id"))
        .join(o, "run_id")
        .select("run_id", "dataset", "check_id")
    )
    turn = F.substring("dataset", 1, 1).cast("int") - 1
    expected = (
        o.select("dataset")
        .distinct()
        .select("dataset", F.explode(ids).alias("check_id"))
        .filter(F.length("check_id") % 5 == turn)
    )
    return checks.mandatory_recall(planned, expected).withColumn("recall", F.round("recall", 9))


@query(
    "field_set",
    """WITH c AS (SELECT l_orderkey AS run_id, l_linenumber AS pos, l_partkey % 7 AS field FROM lineitem),
       a AS (SELECT l_orderkey AS run_id, CASE WHEN l_tax > 0.06 THEN 8 - l_linenumber ELSE l_linenumber END AS pos, CASE WHEN l_discount > 0.08 THEN l_suppkey % 7 ELSE l_partkey % 7 END AS field FROM lineitem),
       f AS (SELECT run_id, field, count(*) FILTER (s = 1) AS c, count(*) FILTER (s = 2) AS a, min(pos) FILTER (s = 1) AS pc, min(pos) FILTER (s = 2) AS pa
             FROM (SELECT *, 1 AS s FROM c UNION ALL SELECT *, 2 FROM a) GROUP BY 1, 2)
       SELECT run_id, count(*) FILTER (a = 0) AS missing, count(*) FILTER (c = 0) AS extra, count(*) FILTER (a > 1) AS repeated,
              bool_and(pc IS NOT DISTINCT FROM pa) AS same_order, count(*) FILTER (a = 0 OR c = 0 OR a > 1) = 0 AS equal FROM f GROUP BY 1""",
)
def field_set(t: Tables) -> DataFrame:
    li = t.read("lineitem")
    contract = li.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 7).alias("field"))
    artifact = li.select(
        F.col("l_orderkey").alias("run_id"),
        F.when(F.col("l_tax") > 0.06, 8 - F.col("l_linenumber")).otherwise(F.col("l_linenumber")).alias("pos"),
        F.when(F.col("l_discount") > 0.08, F.col("l_suppkey") % 7).otherwise(F.col("l_partkey") % 7).alias("field"),
    )
    return checks.field_sets(contract, artifact)


@query(
    "promotion_gate",
    """WITH p AS (SELECT o_orderkey AS candidate_id, array_to_string(list_filter([CASE WHEN o_orderpriority = '1-URGENT' THEN 'catalog_version_unchanged' END,
             CASE WHEN o_totalprice < 20000 THEN 'mutation_tests' END, CASE WHEN o_totalprice < 40000 THEN 'negative_tests' END, CASE WHEN o_custkey < 100 THEN 'no_independent_oracle' END,
             CASE WHEN o_orderstatus = 'P' AND o_totalprice > 300000 THEN 'not_quarantined' END, CASE WHEN o_totalprice < 60000 THEN 'positive_tests' END,
             CASE WHEN o_orderpriority = '2-HIGH' THEN 'provider_network' END, CASE WHEN o_orderstatus = 'O' THEN 'sandbox' END, CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'secret_access' END],
             lambda x: x IS NOT NULL), ',') AS failures FROM orders)
       SELECT candidate_id, failures, CASE WHEN failures = '' THEN 'promotion_gates_passed' ELSE 'quarantined' END AS status FROM p""",
)
def promotion_gate(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    tests = lambda bound: F.when(price < bound, F.array().cast("array<string>")).otherwise(F.array(F.lit("t1")))
    evidence = t.read("orders").select(
        F.col("o_orderkey").alias("candidate_id"),
        F.when((F.col("o_orderstatus") == "P") & (price > 300000), "elsewhere/")
        .otherwise(checks.QUARANTINE + "x.py")
        .alias("implementation_path"),
        F.when(F.col("o_custkey") >= 100, "oracle.py").alias("oracle_path"),
        tests(60000).alias("positive_test_ids"),
        tests(40000).alias("negative_test_ids"),
        tests(20000).alias("mutation_test_ids"),
        (F.col("o_orderstatus") != "O").alias("sandbox_verified"),
        (F.col("o_orderpriority") != "2-HIGH").alias("network_disabled"),
        (F.col("o_orderpriority") != "3-MEDIUM").alias("secrets_disabled"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "v1").otherwise("v2").alias("proposed_catalog_version"),
    )
    failed = evidence.select("candidate_id", checks.promotion_failures("v1").alias("failures"))
    return failed.withColumn("status", F.when(F.col("failures") == "", "promotion_gates_passed").otherwise("quarantined"))


@query(
    "plan_complete",
    """WITH p AS (SELECT o_orderkey, o_custkey % 2 = 0 AS grid, CASE o_orderstatus WHEN 'F' THEN ['y', 'x', 'sample'] WHEN 'O' THEN [] ELSE ['x', 'y'] END AS axes,
                 o_totalprice > 200000 AS has_station, o_orderpriority <> '5-LOW' AS compatible, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 0 END AS proposals FROM orders)
       SELECT o_orderkey AS plan_id, array_to_string(list_filter([CASE WHEN NOT compatible THEN 'incompatible' END,
         CASE WHEN NOT (CASE WHEN grid THEN list_sort(axes) = ['sample', 'x', 'y'] AND NOT has_station ELSE len(axes) = 0 AND has_station END) THEN 'mapping_invalid' END,
         CASE WHEN proposals > 0 THEN 'open_proposals' END], lambda x: x IS NOT NULL), ',') AS reasons FROM p""",
)
def plan_complete(t: Tables) -> DataFrame:
    axis = lambda *names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    axes = (
        F.when(F.col("o_orderstatus") == "F", axis("y", "x", "sample"))
        .when(F.col("o_orderstatus") == "O", axis())
        .otherwise(axis("x", "y"))
    )
    reasons = checks.plan_complete(
        F.when(F.col("o_custkey") % 2 == 0, "regular_rectilinear_grid").otherwise("station_time_series"),
        axes,
        F.col("o_totalprice") > 200000,
        F.col("o_orderpriority") != "5-LOW",
        F.when(F.col("o_orderpriority") == "1-URGENT", 2).otherwise(0),
    )
    return t.read("orders").select(F.col("o_orderkey").alias("plan_id"), reasons.alias("reasons"))
