"""Trial, call, measurement and judgement queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcheck.operators import checks, experiments
from fieldcheck.plans.registry import Tables, query
from fieldcheck.sinks.writers import scratch, write_results_csv

PICK = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ',')"


def sql_flags(*named: tuple[str, str]) -> str:
    return PICK.format(", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in sorted(named)))


@query(
    "trial_violations",
    "SELECT trial_id, "
    + sql_flags(
        ("error_on_success", "generation_succeeded AND generation_error IS NOT NULL"),
        ("failure_exposes_success", "NOT generation_succeeded AND (pipeline_id IS NOT NULL OR manifest_path IS NOT NULL OR initial_passed OR final_passed OR repairs_attempted > 0)"),
        ("failure_without_error", "NOT generation_succeeded AND generation_error IS NULL"),
        ("final_without_cause", "final_passed AND NOT (initial_passed OR coalesce(repair_status, '') = 'repaired')"),
        ("first_success_not_final", "initial_passed AND (repairs_attempted <> 0 OR NOT final_passed)"),
        ("logs_without_repair", "repairs_attempted = 0 AND repair_logs > 0"),
        ("repair_after_success", "repairs_attempted > 0 AND initial_passed"),
        ("repair_out_of_range", "repairs_attempted NOT BETWEEN 0 AND 3"),
        ("repair_without_logs", "repairs_attempted > 0 AND repair_logs = 0"),
        ("repair_without_status", "repairs_attempted > 0 AND repair_status IS NULL"),
        ("status_without_repair", "repairs_attempted = 0 AND coalesce(repair_status, 'already_succeeded') <> 'already_succeeded'"),
        ("success_without_id", "generation_succeeded AND pipeline_id IS NULL"),
        ("success_without_manifest", "generation_succeeded AND manifest_path IS NULL"),
        ("success_with_unverified_prompts", "generation_succeeded AND NOT coalesce(verified, false)"),
        ("first_success_without_report", "initial_passed AND initial_report = ''"),
        ("final_success_without_report", "final_passed AND final_report IS NULL"),
        ("declared_at_1_differs", "declared_at_1 <> (generation_succeeded AND initial_passed)"),
        ("declared_after_repairs_differs", """declared_after_repairs <> (generation_succeeded AND (initial_passed OR (repairs_attempted BETWEEN 1 AND 3 AND coalesce(repair_status, '') = 'repaired' AND final_passed)))"""),
    )
    + """ AS violations FROM (SELECT *, CASE WHEN trial_id % 11 <> 0 AND (generation_succeeded OR trial_id % 19 = 0) THEN 'm' || trial_id END AS manifest_path,
           CASE WHEN trial_id % 13 = 0 THEN NULL ELSE trial_id % 23 <> 0 END AS verified, CASE WHEN trial_id % 7 = 0 THEN '' ELSE 'r' END AS initial_report, CASE WHEN trial_id % 5 <> 0 THEN 'r' END AS final_report,
           CASE WHEN trial_id % 3 <> 0 THEN trial_id % 2 = 0 END AS declared_at_1, CASE WHEN trial_id % 4 <> 0 THEN final_passed END AS declared_after_repairs FROM trials)""",
)
def trial_violations(t: Tables) -> DataFrame:
    """The trials with evidence that is lost, and flags that are wrong, for some of them."""
    n = F.col("trial_id")
    trials = t.trials().withColumns(
        {
            "manifest_path": F.when((n % 11 != 0) & (F.col("generation_succeeded") | (n % 19 == 0)), F.concat(F.lit("m"), n)),
            "prompt_sources_verified": F.when(n % 13 != 0, n % 23 != 0),
            "initial_report": F.when(n % 7 == 0, "").otherwise("r"),
            "final_report": F.when(n % 5 != 0, "r"),
            "declared_at_1": F.when(n % 3 != 0, n % 2 == 0),
            "declared_after_repairs": F.when(n % 4 != 0, F.col("final_passed")),
        }
    )
    return experiments.trial_violations(trials)


@query(
    "success_at_k",
    """WITH f AS (SELECT *, generation_succeeded AND initial_passed AS s1, generation_succeeded AND (initial_passed OR
              (repairs_attempted BETWEEN 1 AND 3 AND coalesce(repair_status, '') = 'repaired' AND final_passed)) AS s3 FROM trials)
       SELECT condition, count(*) AS trials, count(*) FILTER (s1) AS success_at_1, round(count(*) FILTER (s1) / count(*), 9) AS success_at_1_rate,
         count(*) FILTER (s3) AS success_after_repairs, round(count(*) FILTER (s3) / count(*), 9) AS success_after_repairs_rate,
         count(*) FILTER (NOT generation_succeeded) AS generation_failures, count(*) FILTER (repairs_attempted = 0) AS attempts_0,
         count(*) FILTER (repairs_attempted = 1) AS attempts_1, count(*) FILTER (repairs_attempted = 2) AS attempts_2, count(*) FILTER (repairs_attempted = 3) AS attempts_3
       FROM f GROUP BY 1""",
)
def success_at_k(t: Tables) -> DataFrame:
    out = experiments.success_at_k(t.trials())
    return out.withColumns({c: F.round(c, 9) for c in ("success_at_1_rate", "success_after_repairs_rate")})


@query(
    "matrix_gaps",
    """WITH p AS (SELECT condition, max(repetition) - CAST(substr(condition, 1, 1) AS INTEGER) AS planned FROM trials GROUP BY 1),
       e AS (SELECT condition, unnest(range(1, planned + 1)) AS repetition FROM p),
       s AS (SELECT condition, repetition, count(*) AS n FROM trials GROUP BY 1, 2),
       j AS (SELECT coalesce(e.condition, s.condition) AS condition, coalesce(e.repetition, s.repetition) AS repetition,
              CASE WHEN s.condition IS NULL THEN 'missing' WHEN e.condition IS NULL THEN 'extra' WHEN n > 1 THEN 'repeated' END AS problem
             FROM e FULL JOIN s ON e.condition = s.condition AND e.repetition = s.repetition)
       SELECT * FROM j WHERE problem IS NOT NULL
       UNION ALL SELECT DISTINCT condition, repetition, 'foreign' FROM trials WHERE pipeline_id IS NULL""",
)
def matrix_gaps(t: Tables) -> DataFrame:
    trials = t.trials().withColumn("experiment_id", F.when(F.col("pipeline_id").isNull(), "other").otherwise("main"))
    planned = trials.groupBy("condition").agg(F.max("repetition").alias("_m")).select(
        "condition", (F.col("_m") - F.substring("condition", 1, 1).cast("int")).alias("planned")
    )
    return experiments.matrix_gaps(trials, planned, "main")


PRICED = """
priced AS (SELECT *, CASE model WHEN 'gpt-4o' THEN 'gpt-4o' WHEN 'gpt-5.4-2026-03-05' THEN 'gpt-5.4' ELSE 'unpriced' END AS family,
   CASE WHEN model = 'gpt-4o' THEN ((input_tokens - cached_input_tokens) * 25000 + cached_input_tokens * 12500 + output_tokens * 100000) / 10000
        WHEN model = 'gpt-5.4-2026-03-05' THEN ((input_tokens - cached_input_tokens) * 25000 * m + cached_input_tokens * 2500 * m + output_tokens * CASE WHEN m = 2 THEN 225000 ELSE 150000 END) / 10000
        END / 1e6 AS cost_usd
  FROM (SELECT *, CASE WHEN input_tokens > 272000 THEN 2 ELSE 1 END AS m FROM calls))"""


@query("price_calls", f"WITH {PRICED} SELECT trial_id, call_no, part, family, round(cost_usd, 6) AS cost_usd FROM priced")
def price_calls(t: Tables) -> DataFrame:
    return experiments.price_calls(t.calls()).select(
        "trial_id", "call_no", "part", "family", F.round(F.col("cost_usd").cast("double"), 6).alias("cost_usd")
    )


@query(
    "usage_rollup",
    f"""WITH {PRICED} SELECT kind, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cached_input_tokens) AS BIGINT) AS cached_input_tokens,
          CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens,
          CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens, round(sum(cost_usd), 3) AS cost_usd, count(DISTINCT family) AS families,
          count(*) FILTER (cached_input_tokens > input_tokens) AS cached_above_input FROM priced GROUP BY 1""",
)
def usage_rollup(t: Tables) -> DataFrame:
    out = experiments.usage_rollup(experiments.price_calls(t.calls()), ["kind"])
    return out.withColumn("cost_usd", F.round(F.col("cost_usd").cast("double"), 3))


@query(
    "trial_costs",
    f"""WITH {PRICED}, one AS (SELECT trial_id, call_no, part, input_tokens, kind, has_usage, started_at, CASE WHEN has_usage THEN coalesce(cost_usd, 0) ELSE 0 END AS cost FROM priced),
        a AS (SELECT trial_id, count(*) FILTER (kind = 'agent') AS calls, count(*) FILTER (kind = 'agent' AND NOT has_usage) AS bare,
               coalesce(sum(cost) FILTER (kind = 'agent'), 0) AS agent, coalesce(sum(cost) FILTER (kind = 'judge'), 0) AS judge,
               date_diff('second', min(started_at), max(started_at)) AS secs FROM one GROUP BY 1),
        f AS (SELECT trial_id, max(cost) AS first FROM (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY call_no, part, started_at, input_tokens) AS r FROM one WHERE kind = 'agent') WHERE r = 1 GROUP BY 1)
        SELECT a.trial_id, calls AS generation_repair_calls, bare AS calls_without_usage, round(coalesce(first, 0), 6) AS generation_usd,
          round(agent - coalesce(first, 0), 6) AS repair_usd, round(judge, 6) AS judge_usd, round(agent + judge, 6) AS total_usd, secs AS wall_seconds
        FROM a LEFT JOIN f ON a.trial_id = f.trial_id""",
)
def trial_costs(t: Tables) -> DataFrame:
    """Order lines may share a line number, so calls are ordered by part, time and size as well."""
    calls = experiments.price_calls(t.calls())
    key = F.struct("call_no", F.col("part"), F.col("started_at"), F.col("input_tokens"))
    out = experiments.trial_costs(calls.withColumn("call_no", key))
    usd = ("generation_usd", "repair_usd", "judge_usd", "total_usd")
    return out.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in usd})


@query(
    "throughput",
    """SELECT candidate_id, round(median(s), 6) AS median, round(min(s), 6) AS minimum, round(max(s), 6) AS maximum, round(quantile_cont(s, 0.25), 6) AS q1,
         round(quantile_cont(s, 0.75), 6) AS q3, round(quantile_cont(s, 0.75) - quantile_cont(s, 0.25), 6) AS iqr, count(*) AS repetitions
       FROM (SELECT candidate_id, samples_per_second AS s FROM passes WHERE pass_no > 1) GROUP BY 1""",
)
def throughput(t: Tables) -> DataFrame:
    out = experiments.throughput_summary(t.passes(), ["candidate_id"], warmup=1)
    return out.withColumns({c: F.round(c, 6) for c in ("median", "minimum", "maximum", "q1", "q3", "iqr")})


@query(
    "median_objectives",
    """SELECT candidate_id, round(median(seconds), 6) AS seconds, round(median(samples_per_second), 6) AS samples_per_second,
         CAST(trunc(median(output_bytes)) AS BIGINT) AS output_bytes, count(*) AS repetitions FROM passes GROUP BY 1""",
)
def median_objectives(t: Tables) -> DataFrame:
    names = ["seconds", "samples_per_second", "output_bytes"]
    out = experiments.median_objectives(t.passes(), ["candidate_id"], names, whole=["output_bytes"])
    return out.withColumns({c: F.round(c, 6) for c in ("seconds", "samples_per_second")})


@query(
    "variation",
    """WITH l AS (SELECT candidate_id, u.measure, u.v FROM passes, LATERAL (VALUES ('seconds', seconds), ('output_bytes', CAST(output_bytes AS DOUBLE))) u(measure, v))
       SELECT candidate_id, measure, min(v) AS minimum, median(v) AS median, max(v) AS maximum,
         round(CASE WHEN median(v) = 0 THEN 0 ELSE (max(v) - min(v)) / abs(median(v)) END, 9) AS relative_span FROM l GROUP BY 1, 2""",
)
def variation(t: Tables) -> DataFrame:
    out = experiments.variation(t.passes(), ["candidate_id"], ["seconds", "output_bytes"])
    return out.withColumn("relative_span", F.round("relative_span", 9))


E1 = """
runs AS (SELECT o_custkey AS dataset, CASE WHEN o_orderpriority < '3' THEN 'development' ELSE 'held_out' END AS role, o_orderkey AS run_id, o_orderstatus <> 'P' AS run_success,
           o_totalprice / 500000 AS mandatory_recall, o_orderpriority <> '5-LOW' AS planning_complete, CASE WHEN o_totalprice < 50000 THEN 2 ELSE 0 END AS gap_count FROM orders)"""


def e1_runs(t: Tables) -> DataFrame:
    return t.read("orders").select(
        F.col("o_custkey").alias("dataset"),
        F.when(F.col("o_orderpriority") < "3", "development").otherwise("held_out").alias("role"),
        F.col("o_orderkey").alias("run_id"),
        (F.col("o_orderstatus") != "P").alias("run_success"),
        (F.col("o_totalprice") / 500000).alias("mandatory_recall"),
        (F.col("o_orderpriority") != "5-LOW").alias("planning_complete"),
        F.when(F.col("o_totalprice") < 50000, 2).otherwise(0).alias("gap_count"),
    )


@query(
    "e1_summary",
    f"""WITH {E1} SELECT dataset, role, count(*) FILTER (run_success) AS successful_runs, count(*) AS total_runs, round(avg(mandatory_recall), 12) AS mean_recall,
          count(*) FILTER (planning_complete) AS planning_complete_runs, count(*) FILTER (gap_count > 0) AS gap_runs,
          round(count(*) FILTER (run_success) / count(*), 9) AS success_rate FROM runs GROUP BY 1, 2""",
)
def e1_summary(t: Tables) -> DataFrame:
    out = experiments.e1_summary(e1_runs(t))
    return out.withColumns({"mean_recall": F.round("mean_recall", 12), "success_rate": F.round("success_rate", 9)})


@query(
    "e1_results",
    f"""WITH {E1} SELECT role, run_success, count(*) AS runs, CAST(sum(gap_count) AS BIGINT) AS gaps, round(avg(mandatory_recall), 6) AS mean_recall FROM runs GROUP BY 1, 2""",
)
def e1_results(t: Tables) -> DataFrame:
    """Results written as CSV in fixed column order and read back with their schema."""
    runs = e1_runs(t)
    fields = ["dataset", "role", "run_id", "run_success", "mandatory_recall", "planning_complete", "gap_count"]
    path = scratch(t.spark, "results-csv")
    write_results_csv(runs, path, fields)
    back = t.spark.read.schema(runs.select(*fields).schema).option("header", True).csv(path)
    return back.groupBy("role", "run_success").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("gap_count").alias("gaps"),
        F.round(F.avg("mandatory_recall"), 6).alias("mean_recall"),
    )


SPEC_FIELDS = ["field_ids", "scope", "objective", "workload", "credentials", "target"]


@query(
    "spec_exact",
    """WITH p AS (SELECT o_orderkey AS run_id, o_orderpriority <> '1-URGENT' AS a, o_totalprice > 30000 AS b, o_orderstatus <> 'P' AS c, o_custkey >= 50 AS d FROM orders)
       SELECT run_id, a AS field_ids_exact, b AS scope_exact, true AS objective_exact, c AS workload_exact, d AS credentials_exact, true AS target_exact, a AND b AND c AND d AS run_success FROM p""",
)
def spec_exact(t: Tables) -> DataFrame:
    o = t.read("orders")
    run = F.col("o_orderkey").alias("run_id")
    expected = o.select(
        run,
        F.array(F.lit("t"), F.lit("z")).alias("field_ids"),
        F.col("o_orderdate").cast("string").alias("scope"),
        F.lit("throughput").alias("objective"),
        F.col("o_orderpriority").alias("workload"),
        F.when(F.col("o_custkey") >= 50, "none").alias("credentials"),
        F.lit(None).cast("string").alias("target"),
    )
    observed = o.select(
        run,
        F.when(F.col("o_orderpriority") != "1-URGENT", F.array(F.lit("t"), F.lit("z"))).otherwise(F.array(F.lit("t"))).alias("field_ids"),
        F.when(F.col("o_totalprice") > 30000, F.col("o_orderdate").cast("string")).alias("scope"),
        F.lit("throughput").alias("objective"),
        F.when(F.col("o_orderstatus") == "P", "other").otherwise(F.col("o_orderpriority")).alias("workload"),
        F.lit("none").alias("credentials"),
        F.lit(None).cast("string").alias("target"),
    )
    return experiments.exactness(observed, expected, "run_id", SPEC_FIELDS)


JUDGE = """
j AS (SELECT source AS run_id, l.doc_id AS judge, lang AS dimension, CASE WHEN toxic = 0 OR n_chars > 200 THEN CAST(quality * 3 + (1 - toxic) AS DOUBLE) END AS score,
        1.0::DOUBLE / (1 + n_chars) AS confidence FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
DIMS = {"en": 1, "de": 1, "fr": 1, "es": 1}


@query(
    "quality_score",
    f"""WITH {JUDGE}, dim AS (SELECT run_id, dimension, median(score) AS m, min(score) AS lo, max(score) AS hi FROM j WHERE score IS NOT NULL AND dimension IN ('en', 'de', 'fr', 'es') GROUP BY 1, 2),
        c AS (SELECT run_id, dimension, median(confidence) AS conf FROM j GROUP BY 1, 2),
        n AS (SELECT run_id, count(DISTINCT judge) AS judges FROM j GROUP BY 1)
        SELECT n.run_id, judges, count(m) AS scored, min(lo) AS score_min, max(hi) AS score_max, round(min(conf), 9) AS least_confidence,
          round(CASE WHEN count(m) = 4 AND judges >= 0 THEN avg(m) END, 6) AS q_engineering
        FROM n LEFT JOIN dim ON n.run_id = dim.run_id LEFT JOIN c ON dim.run_id = c.run_id AND dim.dimension = c.dimension GROUP BY 1, 2""",
)
def quality_score(t: Tables) -> DataFrame:
    """Judges are documents here, so every source is asked for as many judges as it has."""
    d = t.read("documents").select("doc_id", "source", "lang", "n_chars")
    score = F.when((F.col("toxic") == 0) | (F.col("n_chars") > 200), (F.col("quality") * 3 + (1 - F.col("toxic"))).cast("double"))
    rows = t.read("labels").join(d, "doc_id").select(
        F.col("source").alias("run_id"),
        F.col("doc_id").alias("judge"),
        F.col("lang").alias("dimension"),
        score.alias("score"),
        (F.lit(1.0) / (1 + F.col("n_chars"))).alias("confidence"),
    )
    out = experiments.quality_score(rows, DIMS, repetitions=None)
    return out.withColumns({"least_confidence": F.round("least_confidence", 9), "q_engineering": F.round("q_engineering", 6)})


@query(
    "objective_valid",
    """WITH v AS (SELECT o_orderkey AS candidate_id, o_orderstatus <> 'P' AS feasible, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice - 5000 END AS s,
                 CASE WHEN o_custkey < 20 THEN 'inf'::DOUBLE ELSE o_totalprice END AS c, CASE WHEN o_orderpriority <> '2-HIGH' THEN CAST(o_custkey AS DOUBLE) END AS b,
                 CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_totalprice / 100000 END AS q FROM orders)
       SELECT candidate_id, """
    + sql_flags(
        ("feasible_incomplete", "feasible AND (s IS NULL OR c IS NULL OR b IS NULL)"),
        ("infeasible_exposes", "NOT feasible AND (s IS NOT NULL OR c IS NOT NULL OR b IS NOT NULL OR q IS NOT NULL)"),
        ("not_finite", "c = 'inf'::DOUBLE"),
        ("not_positive", "s <= 0 OR c <= 0 OR b <= 0"),
        ("q_out_of_range", "q NOT BETWEEN 0 AND 4"),
    )
    + " AS problems FROM v",
)
def objective_valid(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    rows = t.read("orders").select(
        F.col("o_orderkey").alias("candidate_id"),
        (F.col("o_orderstatus") != "P").alias("feasible"),
        F.when(p != "1-URGENT", F.col("o_totalprice") - 5000).alias("materialization_seconds"),
        F.when(F.col("o_custkey") < 20, F.lit(float("inf"))).otherwise(F.col("o_totalprice")).alias("consumer_samples_per_second"),
        F.when(p != "2-HIGH", F.col("o_custkey").cast("double")).alias("output_bytes"),
        F.when(p == "3-MEDIUM", F.col("o_totalprice") / 100000).alias("q_engineering"),
    )
    return experiments.objective_problems(rows)


@query(
    "cache_only",
    "SELECT o_orderkey AS run_id FROM orders WHERE o_custkey > 100 AND o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT'",
)
def cache_only(t: Tables) -> DataFrame:
    from fieldcheck.operators.provenance import cache_only as keep

    receipts = t.read("orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.greatest(F.col("o_custkey") - 100, F.lit(0)).alias("hits"),
        F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("misses"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("acquired"),
    )
    return keep(receipts).select("run_id")


@query(
    "node_status",
    """SELECT o_orderkey AS node_id, CASE WHEN o_totalprice < 20000 THEN 'evaluation_failed' WHEN o_orderstatus = 'P' THEN 'infeasible'
         WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'optimization_ready' ELSE 'incomplete' END AS status FROM orders""",
)
def node_status(t: Tables) -> DataFrame:
    status = experiments.node_status(
        F.col("o_totalprice") >= 20000, F.col("o_orderstatus") != "P", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    )
    return t.read("orders").select(F.col("o_orderkey").alias("node_id"), status.alias("status"))


@query(
    "evidence_ready",
    "SELECT o_orderkey AS run_id, "
    + sql_flags(
        ("advisory", "o_custkey < 100"),
        ("few_repetitions", "o_custkey % 7 < 3"),
        ("invalid_judgements", "o_totalprice < 30000"),
        ("isolation", "o_orderstatus = 'O'"),
        ("not_final_mode", "o_orderpriority = '5-LOW'"),
        ("probe", "o_orderpriority = '1-URGENT' AND o_totalprice < 200000"),
        ("vector_incomplete", "o_orderstatus = 'P'"),
    )
    + " AS blockers FROM orders",
)
def evidence_ready(t: Tables) -> DataFrame:
    reps = (F.col("o_custkey") % 7).cast("int")
    runs = t.read("orders").select(
        F.col("o_orderkey").alias("run_id"),
        (F.col("o_custkey") < 100).alias("advisory"),
        reps.alias("repetitions"),
        F.when(F.col("o_totalprice") < 30000, reps + 1).otherwise(reps).alias("valid_judgements"),
        F.when(F.col("o_orderstatus") != "O", F.lit(True)).alias("full_isolation"),
        F.when(F.col("o_orderpriority") != "5-LOW", "final").alias("mode"),
        (F.col("o_orderpriority") == "1-URGENT").alias("probe_required"),
        F.when(F.col("o_totalprice") >= 200000, "PASS").alias("probe_status"),
        (F.col("o_orderstatus") != "P").alias("vector_complete"),
    )
    return experiments.evidence_ready(runs)


@query(
    "resource_rollup",
    """WITH i AS (SELECT l_suppkey AS run_id, l_shipdate AS instant, sum(l_quantity) AS rss, sum(l_discount) AS cpu FROM lineitem GROUP BY 1, 2)
       SELECT run_id, count(*) AS instants, max(rss) AS peak_rss, round(max(cpu), 6) AS peak_cpu FROM i GROUP BY 1""",
)
def resource_rollup(t: Tables) -> DataFrame:
    samples = t.read("lineitem").select(
        F.col("l_suppkey").alias("run_id"), F.col("l_shipdate").alias("instant"), F.col("l_quantity").alias("rss"), F.col("l_discount").alias("cpu")
    )
    return experiments.resource_rollup(samples, ["run_id"], ["rss", "cpu"]).withColumn("peak_cpu", F.round("peak_cpu", 6))


@query(
    "operational_ratios",
    """SELECT o_orderkey AS run_id, round(CASE WHEN o_custkey <> 0 THEN 10.0 / o_custkey END, 9) AS metadata_share, o_totalprice - o_custkey AS samples_span,
         o_orderstatus = 'F' AS cache_only, CASE WHEN o_orderpriority <> '1-URGENT' THEN round(o_custkey / o_totalprice, 9) END AS execution_share FROM orders""",
)
def operational_ratios(t: Tables) -> DataFrame:
    runs = t.read("orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.lit(10.0).alias("metadata_bytes"),
        F.col("o_custkey").alias("output_bytes"),
        F.col("o_totalprice").alias("max_samples_per_second"),
        F.col("o_custkey").alias("min_samples_per_second"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(3).alias("cache_misses"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey")).alias("execution_seconds"),
        F.col("o_totalprice").alias("total_seconds"),
    )
    out = experiments.operational_ratios(runs)
    return out.withColumns({c: F.round(c, 9) for c in ("metadata_share", "execution_share")})


@query(
    "station_objectives",
    """WITH m AS (SELECT o_custkey AS candidate_id, median(l_quantity) AS s, median(l_extendedprice) AS r, CAST(trunc(median(floor(l_extendedprice))) AS BIGINT) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
       f AS (SELECT candidate_id, count(DISTINCT "constraint") = 4 AND bool_and(status = 'PASS') AS ok FROM checks GROUP BY 1)
       SELECT m.candidate_id, coalesce(ok, false) AS eligible, CASE WHEN ok THEN s END AS materialization_seconds, CASE WHEN ok THEN round(r, 6) END AS rows_per_second, CASE WHEN ok THEN b END AS output_bytes, coalesce(ok, false) AS ready
       FROM m LEFT JOIN f ON m.candidate_id = f.candidate_id""",
)
def station_objectives(t: Tables) -> DataFrame:
    o = t.read("orders").select("o_orderkey", F.col("o_custkey").alias("candidate_id"))
    runs = t.read("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "candidate_id",
        F.col("l_quantity").alias("materialization_seconds"),
        F.col("l_extendedprice").alias("rows_per_second"),
        F.floor("l_extendedprice").alias("output_bytes"),
    )
    out = experiments.station_objectives(
        runs, checks.constraint_rollup(t.checks()), ["materialization_seconds", "rows_per_second", "output_bytes"]
    )
    return out.withColumn("rows_per_second", F.round("rows_per_second", 6))


@query(
    "matched_measure",
    """WITH r AS (SELECT o_custkey AS experiment_id, o_orderkey, o_custkey < 50 AND o_orderpriority = '1-URGENT' AS p, o_orderstatus = 'P' AND o_custkey % 3 = 0 AS r,
                 o_totalprice < 3000 AS bad_order, o_totalprice > 490000 AS other_order, o_totalprice BETWEEN 100000 AND 105000 AS short FROM orders)
       SELECT experiment_id, count(*) AS records, array_to_string(list_filter([CASE WHEN bool_or(short) THEN 'incomplete_passes' END,
         CASE WHEN count(DISTINCT CASE WHEN bad_order THEN 1 WHEN other_order THEN 2 ELSE 3 END) > 1 THEN 'mixed_orders' END,
         CASE WHEN count(DISTINCT p) > 1 THEN 'mixed_protocols' END, CASE WHEN count(DISTINCT r) > 1 THEN 'mixed_runtimes' END,
         CASE WHEN bool_or(bad_order) THEN 'order_not_a_permutation' END], lambda x: x IS NOT NULL), ',') AS problems FROM r GROUP BY 1""",
)
def matched_measure(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    order = lambda *n: F.array(*[F.lit(i).cast("long") for i in n])
    records = t.read("orders").select(
        F.col("o_custkey").alias("experiment_id"),
        F.when((F.col("o_custkey") < 50) & (F.col("o_orderpriority") == "1-URGENT"), "p2").otherwise("p1").alias("protocol"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 3 == 0), "r2").otherwise("r1").alias("runtime"),
        F.when(price < 3000, order(0, 1, 1, 3)).when(price > 490000, order(0, 1, 2, 3)).otherwise(order(2, 0, 3, 1)).alias("sample_order"),
        F.lit(4).alias("sample_count"),
        F.when(price.between(100000, 105000), 4).otherwise(5).alias("timed"),
        F.lit(5).alias("timed_planned"),
        F.lit(1).alias("warmup"),
        F.lit(1).alias("warmup_planned"),
    )
    return experiments.matched_measurements(records)


@query(
    "probe_verdict",
    """SELECT c_custkey AS candidate_id, CASE WHEN c_acctbal < -500 THEN 'NOT_RUN' WHEN c_mktsegment = 'BUILDING' THEN 'source_differs' WHEN c_nationkey = 3 THEN 'inventory_differs'
         WHEN c_nationkey = 5 THEN 'same_contract' WHEN c_acctbal > 1000 AND c_mktsegment <> 'MACHINERY' THEN 'PASS' ELSE 'FAIL' END AS verdict FROM customer""",
)
def probe_verdict(t: Tables) -> DataFrame:
    c = t.read("customer")
    cand, nation = F.col("c_custkey").alias("candidate_id"), F.col("c_nationkey")
    primary = c.select(
        cand, F.col("c_name").alias("source_hash"), nation.cast("string").alias("inventory_hash"), F.lit("k1").alias("contract_hash")
    )
    source = F.when(F.col("c_mktsegment") == "BUILDING", "changed").otherwise(F.col("c_name"))
    alternate = c.filter(F.col("c_acctbal") >= -500).select(
        cand,
        source.alias("source_hash"),
        F.when(nation == 3, "other").otherwise(nation.cast("string")).alias("inventory_hash"),
        F.when(nation == 5, "k1").otherwise("k2").alias("contract_hash"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "touched").otherwise(F.col("c_name")).alias("source_hash_after"),
        (F.col("c_acctbal") > 1000).alias("feasible"),
    )
    return experiments.probe_verdict(primary, alternate)


@query(
    "latest_passed",
    """WITH r AS (SELECT o_custkey AS candidate_id, 'acceptance/' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS path, o_orderstatus = 'F' AS passed, o_totalprice > 100000 AS policy FROM orders),
       g AS (SELECT candidate_id, count(*) AS reports, max(path) FILTER (passed) AS report, arg_max(policy, path) FILTER (passed) AS pol FROM r GROUP BY 1)
       SELECT candidate_id, reports, coalesce(report, 'none') AS report, CASE WHEN report IS NULL THEN 'no_passed_report' WHEN pol THEN 'accepted' ELSE 'lacks_output_policy' END AS status FROM g""",
)
def latest_passed(t: Tables) -> DataFrame:
    reports = t.read("orders").select(
        F.col("o_custkey").alias("candidate_id"),
        F.concat(F.lit("acceptance/"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("path"),
        F.when(F.col("o_orderstatus") == "F", "passed").otherwise("failed").alias("final_status"),
        F.when(F.col("o_totalprice") > 100000, "pass").otherwise("fail").alias("policy_status"),
    )
    return experiments.latest_passed(reports, "output_policy")


@query(
    "interaction_summary",
    """WITH c AS (SELECT conv_id, count(*) - 1 AS rounds, CAST(sum(length(text) * 3) AS BIGINT) AS latency_ms, CAST(sum(length(text)) AS BIGINT) AS tokens FROM conversations WHERE role = 'assistant' GROUP BY 1)
       SELECT v.conv_id, count(*) AS turns, count(*) FILTER (role = 'system') AS clarification_turns, coalesce(max(rounds), 0) AS clarification_rounds,
         coalesce(max(latency_ms), 0) AS latency_ms, coalesce(max(tokens), 0) AS tokens, arg_max(role, turn) = 'user' AS unresolved
       FROM conversations v LEFT JOIN c ON v.conv_id = c.conv_id GROUP BY 1""",
)
def interaction_summary(t: Tables) -> DataFrame:
    v = t.read("conversations")
    n = F.length("text").cast("long")
    calls = v.filter(F.col("role") == "assistant").select("conv_id", (n * 3).alias("latency_ms"), n.alias("tokens"))
    last = v.groupBy("conv_id").agg(F.max_by("role", "turn").alias("_last"))
    open_ = last.filter(F.col("_last") == "user")
    return experiments.interaction_summary(v, calls, open_)


@query(
    "latest_runs",
    """SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS generated_at FROM orders
       ORDER BY generated_at DESC NULLS LAST, run_id""",
)
def latest_runs(t: Tables) -> DataFrame:
    runs = t.read("orders").select(
        F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("generated_at")
    )
    return experiments.latest_runs(runs)
