"""Certification: is a candidate equal to the trusted output and fit to publish? Station tables and grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcheck.operators import certify
from fieldcheck.operators.checks import constraint_rollup
from fieldcheck.plans.observations import ATOL, RTOL
from fieldcheck.plans.registry import Tables, query

# status of a gate from its count; of a constraint from its gates
GATE = "CASE WHEN {n} = 0 THEN 'PASS' ELSE 'FAIL' END"
WORST = "CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'NOT_ASSESSED') THEN 'NOT_ASSESSED' ELSE 'PASS' END"
ROLLUP = ", ".join(
    f"(SELECT {WORST} FROM g WHERE g.candidate_id = c.candidate_id AND g.\"constraint\" = '{n}') AS {n}"
    for n in ("contract_correctness", "semantic_equivalence", "rerun_safety", "provenance_security")
)


@query(
    "certify_observations",
    f"""WITH cand AS (SELECT 'defective' AS candidate_id, * FROM obs_cand UNION ALL SELECT 'exact', * FROM obs),
       again AS (SELECT 'defective' AS candidate_id, * FROM obs_cand WHERE value IS NULL OR value < 50 UNION ALL SELECT 'exact', * FROM obs),
       ref AS (SELECT c AS candidate_id, obs.* FROM obs, (VALUES ('defective'), ('exact')) v(c)),
       n AS (SELECT c AS candidate_id,
           (SELECT count(*) FROM (SELECT 1 FROM cand WHERE candidate_id = c GROUP BY station_id, "timestamp", field_id HAVING count(*) > 1)) AS dup,
           (SELECT count(*) FROM cand WHERE candidate_id = c AND ("timestamp" < TIMESTAMP '2024-01-01' OR "timestamp" >= TIMESTAMP '2025-01-01')) AS scope,
           (SELECT count(*) FROM (SELECT DISTINCT station_id FROM cand WHERE candidate_id = c) x FULL JOIN (SELECT DISTINCT station_id FROM obs) y ON x.station_id = y.station_id WHERE x.station_id IS NULL OR y.station_id IS NULL)
           + (SELECT count(*) FROM (SELECT DISTINCT field_id FROM cand WHERE candidate_id = c) x FULL JOIN (SELECT DISTINCT field_id FROM obs) y ON x.field_id = y.field_id WHERE x.field_id IS NULL OR y.field_id IS NULL) AS ids,
           (SELECT count(*) FROM (SELECT * FROM ref WHERE candidate_id = c) a FULL JOIN (SELECT * FROM cand WHERE candidate_id = c) b
              ON a.station_id = b.station_id AND a."timestamp" = b."timestamp" AND a.field_id = b.field_id WHERE a.value IS DISTINCT FROM b.value) AS off,
           (SELECT count(*) FROM (SELECT * FROM cand WHERE candidate_id = c EXCEPT ALL SELECT * FROM again WHERE candidate_id = c))
           + (SELECT count(*) FROM (SELECT * FROM again WHERE candidate_id = c EXCEPT ALL SELECT * FROM cand WHERE candidate_id = c)) AS rerun,
           (SELECT count(*) FROM (SELECT field_id, count(*) AS k FROM cand WHERE candidate_id = c GROUP BY 1) x FULL JOIN (SELECT field_id, count(*) AS k FROM obs GROUP BY 1) y
              ON x.field_id = y.field_id WHERE x.k IS DISTINCT FROM y.k) AS claims
         FROM (VALUES ('defective'), ('exact')) v(c)),
       g AS (SELECT candidate_id, 'contract_correctness' AS "constraint", {GATE.format(n="dup")} AS status FROM n
         UNION ALL SELECT candidate_id, 'contract_correctness', {GATE.format(n="scope")} FROM n
         UNION ALL SELECT candidate_id, 'contract_correctness', {GATE.format(n="ids")} FROM n
         UNION ALL SELECT candidate_id, 'semantic_equivalence', CASE WHEN dup + scope > 0 THEN 'NOT_ASSESSED' ELSE {GATE.format(n="off")} END FROM n
         UNION ALL SELECT candidate_id, 'rerun_safety', {GATE.format(n="rerun")} FROM n
         UNION ALL SELECT candidate_id, 'provenance_security', {GATE.format(n="claims")} FROM n)
       SELECT candidate_id, {ROLLUP}, (SELECT bool_and(status = 'PASS') FROM g WHERE g.candidate_id = c.candidate_id) AS feasible
       FROM (SELECT DISTINCT candidate_id FROM g) c""",
)
def certify_observations(t: Tables) -> DataFrame:
    """An exact candidate, and one with defects whose rerun lacks rows; both hold receipts of the true rows."""
    reference, defective = t.obs(), t.obs_cand()
    stations = reference.select(F.lit("station").alias("kind"), F.col("station_id").alias("id")).distinct()
    fields = reference.select(F.lit("field").alias("kind"), F.col("field_id").alias("id")).distinct()
    claims = reference.groupBy("field_id").agg(F.count(F.lit(1)).alias("rows"))
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    gates = lambda first, again: certify.station_gates(
        first, again, reference, stations.unionByName(fields), claims, day("2024-01-01"), day("2024-12-31"), ATOL, RTOL
    )
    checks = certify.assess(t.spark, "defective", gates(defective, defective.filter("value IS NULL OR value < 50")))
    checks = checks.unionByName(certify.assess(t.spark, "exact", gates(reference, t.obs())))
    return constraint_rollup(checks)


CANDIDATES = ("good", "shifted", "broken", "restless")
COORDS_SQL = """SELECT 'sample' AS axis, vec_id AS idx, vec_id * 6.0::DOUBLE AS value FROM embeddings
  UNION ALL SELECT DISTINCT 'y', CAST(y AS BIGINT), 50.0::DOUBLE - y FROM grid UNION ALL SELECT DISTINCT 'x', CAST(x AS BIGINT), x * 0.25::DOUBLE FROM grid"""
SHAPE_SQL = """(SELECT count(*) FROM (SELECT field_id, max(sample) + 1 AS s, max(y) + 1 AS h, max(x) + 1 AS w, count(*) AS k FROM {0} WHERE candidate_id = c GROUP BY 1) x
  FULL JOIN (SELECT DISTINCT field_id, (SELECT count(*) FROM embeddings) AS n FROM grid) e ON e.field_id = x.field_id
  WHERE x.field_id IS NULL OR e.field_id IS NULL OR s <> n OR h <> 4 OR w <> 4 OR k <> s * h * w)"""


@query(
    "certify_grid",
    f"""WITH names AS (SELECT unnest({list(CANDIDATES)}) AS c),
       cand AS (SELECT c AS candidate_id, grid.* FROM grid, names WHERE c <> 'broken' OR NOT (field_id = 'ch1' AND sample % 50 = 7 AND y = 2 AND x = 1)),
       again AS (SELECT c AS candidate_id, grid.* FROM grid, names WHERE c <> 'restless' UNION ALL SELECT 'restless', * FROM grid_cand),
       refc AS ({COORDS_SQL}),
       coords AS (SELECT c AS candidate_id, axis, idx, value + CASE WHEN c = 'shifted' AND axis = 'x' AND idx = 2 THEN 0.125 ELSE 0 END AS value FROM refc, names),
       n AS (SELECT c AS candidate_id, {SHAPE_SQL.format("cand")} AS valid, {SHAPE_SQL.format("again")} AS valid_again,
           (SELECT count(DISTINCT a.axis) FROM refc a FULL JOIN (SELECT * FROM coords WHERE candidate_id = c) b ON a.axis = b.axis AND a.idx = b.idx
              WHERE a.value IS NULL OR b.value IS NULL OR abs(a.value - b.value) > 1e-6) AS off_axes,
           (SELECT count(*) FROM grid a FULL JOIN (SELECT * FROM cand WHERE candidate_id = c) b ON a.field_id = b.field_id AND a.sample = b.sample AND a.y = b.y AND a.x = b.x
              WHERE a.field_id IS NULL OR b.field_id IS NULL OR a.value IS DISTINCT FROM b.value) AS off,
           (SELECT least(1, count(*)) FROM (SELECT * FROM cand WHERE candidate_id = c) a FULL JOIN (SELECT * FROM again WHERE candidate_id = c) b
              ON a.field_id = b.field_id AND a.sample = b.sample AND a.y = b.y AND a.x = b.x WHERE a.field_id IS NULL OR b.field_id IS NULL OR a.value IS DISTINCT FROM b.value) AS rerun,
           (SELECT count(*) FROM (SELECT field_id, count(*) AS k FROM cand WHERE candidate_id = c GROUP BY 1) x FULL JOIN (SELECT field_id, count(*) AS k FROM grid GROUP BY 1) y
              ON x.field_id = y.field_id WHERE x.k IS DISTINCT FROM y.k) AS claims
         FROM names),
       g AS (SELECT candidate_id, 'contract_correctness' AS "constraint", 'contract.valid_grid' AS check_id, valid AS observed FROM n
         UNION ALL SELECT candidate_id, 'contract_correctness', 'contract.scope_coordinates', CASE WHEN valid = 0 THEN off_axes END FROM n
         UNION ALL SELECT candidate_id, 'semantic_equivalence', 'semantic.native_values_and_missingness', CASE WHEN valid = 0 AND off_axes = 0 THEN off END FROM n
         UNION ALL SELECT candidate_id, 'rerun_safety', 'rerun.valid_grid', valid_again FROM n
         UNION ALL SELECT candidate_id, 'rerun_safety', 'rerun.logical_equivalence', CASE WHEN valid = 0 AND valid_again = 0 THEN rerun END FROM n
         UNION ALL SELECT candidate_id, 'provenance_security', 'provenance.receipts', claims FROM n),
       s AS (SELECT *, CASE WHEN observed IS NULL THEN 'NOT_ASSESSED' ELSE {GATE.format(n="observed")} END AS status FROM g)
       SELECT s.*, f.feasible, CASE WHEN f.feasible THEN (SELECT count(*) * 4 + (max(sample) + 1 + max(y) + 1 + max(x) + 1) * 8 FROM grid) END AS objective
       FROM s JOIN (SELECT candidate_id, bool_and(status = 'PASS') AS feasible FROM s GROUP BY 1) f ON f.candidate_id = s.candidate_id""",
)
def certify_grid(t: Tables) -> DataFrame:
    """Fit, with a shifted coordinate, with lost cells, and with another result on the second run."""
    cells = t.grid()
    sample = t.read("embeddings").select(F.lit("sample").alias("axis"), F.col("vec_id").alias("idx"), (F.col("vec_id") * 6.0).alias("value"))
    y = cells.select(F.lit("y").alias("axis"), F.col("y").cast("bigint").alias("idx"), (50.0 - F.col("y")).alias("value")).distinct()
    x = cells.select(F.lit("x").alias("axis"), F.col("x").cast("bigint").alias("idx"), (F.col("x") * 0.25).alias("value")).distinct()
    coords = sample.unionByName(y).unionByName(x)
    reference = certify.Grid(cells, coords)
    off = F.when((F.col("axis") == "x") & (F.col("idx") == 2), 0.125).otherwise(0.0)
    lost = (F.col("field_id") == "ch1") & (F.col("sample") % 50 == 7) & (F.col("y") == 2) & (F.col("x") == 1)
    outputs = {
        "good": (reference, reference),
        "shifted": (certify.Grid(cells, coords.withColumn("value", F.col("value") + off)),) * 2,
        "broken": (certify.Grid(cells.filter(~lost), coords), reference),
        "restless": (reference, certify.Grid(t.grid_cand(), coords)),
    }
    expected = cells.select("field_id").distinct().select(
        "field_id", F.lit(t.read("embeddings").count()).alias("samples"), F.lit(4).alias("height"), F.lit(4).alias("width")
    )
    claims = cells.groupBy("field_id").agg(F.count(F.lit(1)).alias("rows"))
    out = []
    for name, (first, again) in outputs.items():
        gates = certify.grid_gates(first, again, reference, expected, claims, 1e-6, 0.0, 0.0)
        checks = certify.assess(t.spark, name, gates)
        out.append(certify.with_objective(checks, lambda first=first: certify.grid_bytes(first)))
    return reduce(DataFrame.unionByName, out)
