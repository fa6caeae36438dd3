"""Certification of a candidate, station table or grid, as a graph of gates.

A gate counts what speaks against the candidate: none is PASS, any is FAIL. It needs other gates: while one of
these has not passed it is NOT_ASSESSED, and what it would have measured is not computed at all. Gates that
are ready together are measured in one job, each by one row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcheck.operators.diff import diff_coordinates, diff_values, mismatch_summary
from fieldcheck.operators.fingerprint import grid_fingerprint, rerun_equal
from fieldcheck.operators.grid import logical_bytes, shape_report
from fieldcheck.operators.station import KEY, key_quality, profile, scope_violations

CELL_KEY = ["field_id", "sample", "y", "x"]
RESULT = "candidate_id string, constraint string, check_id string, status string, observed bigint"


@dataclass(frozen=True)
class Gate:
    """measure: one row whose first column counts the faults; null is as good as none measured."""

    check_id: str
    constraint: str
    measure: Callable[[], DataFrame]
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Grid:
    """Cells (field_id, sample, y, x, value) and coordinates (axis, idx, value) of one output."""

    cells: DataFrame
    coords: DataFrame


def assess(spark: SparkSession, candidate_id: str, gates: Sequence[Gate]) -> DataFrame:
    """One row per gate, in the order given."""
    by_id = {g.check_id: g for g in gates}
    order = TopologicalSorter({g.check_id: g.needs for g in gates})
    order.prepare()
    found: dict[str, tuple[str, int | None]] = {}
    while order.is_active():
        level = list(order.get_ready())
        open_ = [c for c in level if all(found[n][0] == "PASS" for n in by_id[c].needs)]
        if open_:
            rows = [by_id[c].measure().toDF("observed").select(F.lit(c).alias("id"), F.col("observed").cast("bigint")) for c in open_]
            counts = {r["id"]: r["observed"] for r in reduce(DataFrame.unionByName, rows).collect()}
        for c in level:
            count = counts.get(c) if c in open_ else None
            found[c] = ("NOT_ASSESSED" if count is None else "FAIL" if count else "PASS", count)
            order.done(c)
    rows = [(candidate_id, g.constraint, g.check_id, *found[g.check_id]) for g in gates]
    return spark.createDataFrame(rows, RESULT)


def receipt_faults(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """Fields whose receipt(field_id, rows) does not tell the rows that are there."""
    seen = rows.groupBy("field_id").agg(F.count(F.lit(1)).alias("_n"))
    both = seen.join(claims.select("field_id", F.col("rows").alias("_claimed")), "field_id", "full_outer")
    return both.agg(F.count_if(~F.col("_n").eqNullSafe(F.col("_claimed"))).alias("observed"))


def station_gates(
    candidate: DataFrame,
    rerun: DataFrame,
    reference: DataFrame,
    expected_ids: DataFrame,
    claims: DataFrame,
    start: Column,
    end: Column,
    atol: float,
    rtol: float,
) -> list[Gate]:
    """Values are compared only where keys and scope hold, as a repeated key has no one value."""

    def keys() -> DataFrame:
        return key_quality(candidate).select(F.col("null_key_rows") + F.col("duplicate_keys") + F.col("empty").cast("long"))

    def values() -> DataFrame:
        return mismatch_summary(diff_values(candidate, reference, KEY, atol, rtol)).select("mismatches")

    return [
        Gate("contract.station_scope_and_keys", "contract_correctness", keys),
        Gate("contract.time_scope", "contract_correctness", lambda: scope_violations(candidate, start, end).agg(F.count(F.lit(1)))),
        Gate(
            "contract.identities", "contract_correctness",
            lambda: profile(candidate, expected_ids).agg(F.count_if(F.col("state") != "declared")),
        ),
        Gate(
            "semantic.station_values_and_missingness", "semantic_equivalence", values,
            ("contract.station_scope_and_keys", "contract.time_scope"),
        ),
        Gate(
            "rerun.station_logical_equivalence", "rerun_safety",
            lambda: rerun_equal(candidate, rerun, []).select((~F.col("equal")).cast("long")),
        ),
        Gate("provenance.receipts", "provenance_security", lambda: receipt_faults(candidate, claims)),
    ]


def grid_gates(
    candidate: Grid, rerun: Grid, reference: Grid, expected: DataFrame, claims: DataFrame, coordinate_atol: float, atol: float, rtol: float
) -> list[Gate]:
    """The order of the gates: shape, then coordinates, then values; a rerun is compared only if both are grids."""

    def faults(grid: Grid) -> DataFrame:
        """Channels that are not complete or not as declared, and axes whose length is not that of the cells."""
        report = shape_report(grid.cells, expected).agg(
            F.count_if(~(F.col("complete") & F.col("as_expected"))).alias("n"), F.count(F.lit(1)).alias("channels")
        )
        axes = grid.coords.groupBy("axis").agg(F.count(F.lit(1)).alias("len"), (F.max("idx") + 1).alias("top"))
        wrong = axes.agg(F.count_if(F.col("len") != F.col("top")).alias("w"), F.count(F.lit(1)).alias("a"))
        bad = F.col("n") + F.col("w") + F.abs(F.col("a") - 3) + (F.col("channels") == 0).cast("long")
        return report.join(wrong).select(bad)

    def coordinates() -> DataFrame:
        off = ~F.col("same_shape") | (F.col("differing") > 0)
        return diff_coordinates(candidate.coords, reference.coords, coordinate_atol).agg(F.count_if(F.coalesce(off, F.lit(True))))

    def values() -> DataFrame:
        return mismatch_summary(diff_values(candidate.cells, reference.cells, CELL_KEY, atol, rtol)).select("mismatches")

    def again() -> DataFrame:
        prints = [grid_fingerprint(g.cells, g.coords).select("fingerprint") for g in (candidate, rerun)]
        return reduce(DataFrame.unionByName, prints).agg((F.count_distinct("fingerprint") - 1).alias("observed"))

    valid = "contract.valid_grid"
    return [
        Gate(valid, "contract_correctness", lambda: faults(candidate)),
        Gate("contract.scope_coordinates", "contract_correctness", coordinates, (valid,)),
        Gate("semantic.native_values_and_missingness", "semantic_equivalence", values, (valid, "contract.scope_coordinates")),
        Gate("rerun.valid_grid", "rerun_safety", lambda: faults(rerun)),
        Gate("rerun.logical_equivalence", "rerun_safety", again, (valid, "rerun.valid_grid")),
        Gate("provenance.receipts", "provenance_security", lambda: receipt_faults(candidate.cells, claims)),
    ]


def with_objective(checks: DataFrame, objective: Callable[[], DataFrame]) -> DataFrame:
    """Adds `feasible` (every gate passed) and, for a feasible candidate alone, its objective of one row."""
    feasible = checks.filter("status <> 'PASS'").isEmpty()
    value = objective().first()[0] if feasible else None
    return checks.withColumns({"feasible": F.lit(feasible), "objective": F.lit(value).cast("bigint")})


def grid_bytes(grid: Grid) -> DataFrame:
    return logical_bytes(grid.cells).select("total_bytes")
