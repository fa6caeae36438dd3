"""Queries that make much of few bytes deal their rows over tasks before they do so."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fieldcheck.operators import checks
from fieldcheck.plans import registry

SF = "/root/testdata/sf0.001"


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


@pytest.mark.parametrize(
    "name, rows",
    [("extract_options", "input = 'size'"), ("layout_tables", "table_id = 'main_variables'"), ("sensitive_keys", "path = '$.body.secret_token'")],
)
def test_one_split_of_documents_is_read_by_many_tasks(spark, name, rows):
    assert tasks(entry.queries()[name](spark, SF).filter(rows)) > 1


def test_a_plan_is_found_without_grouping_its_rows(spark):
    """Grouped rows of all profiles stood in one task's memory; tags may be repeated and in any order."""
    plan = entry.queries()["check_plan"](spark, SF)
    assert "Aggregate" not in plan._jdf.queryExecution().executedPlan().toString()
    p = spark.createDataFrame([(1, 7, ["b", "a", "b"]), (2, 8, ["b"]), (3, 9, [])], "profile_id int, seen int, tags array<string>")
    c = spark.createDataFrame([("ab", "l", "r", ["a", "b"]), ("b", "l", "r", ["b"]), ("none", "l", "r", [])], "check_id string, layer string, role string, tags array<string>")
    got = checks.check_plan(p, c, also=["seen"]).collect()
    assert sorted((r["profile_id"], r["seen"], r["check_id"]) for r in got) == [(1, 7, "ab"), (1, 7, "b"), (2, 8, "b")]


def test_gates_are_one_row_a_profile(spark):
    """Neither the mandatory gates nor those of the plans are joined as rows of a check each."""
    problems = entry.queries()["mandatory_gates"](spark, SF)
    assert "LeftAnti" not in problems._jdf.queryExecution().executedPlan().toString()
    p = spark.createDataFrame([(1, "station_time_series"), (2, "other")], "profile_id int, data_class string")
    every = [(1, c, "hard_gate") for c in (*checks.MANDATORY_CORE, "x")] + [(1, "y", "objective")]
    plan = spark.createDataFrame(every * 2, "profile_id int, check_id string, role string")
    sent = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (9, "x")], "profile_id int, check_id string")
    got = [(r["profile_id"], r["check_id"], r["problem"]) for r in checks.gate_problems(p, plan, sent).collect()]
    lacking = [(1, checks.SEMANTIC_GATES["station_time_series"]), *[(2, c) for c in checks.MANDATORY_CORE]]
    assert sorted(got) == sorted([(*k, "mandatory_missing") for k in lacking] + [(1, "y", "outside_plan"), (9, "x", "outside_plan")])


def test_parts_grow_with_the_lines_of_all_runs(spark, monkeypatch):
    monkeypatch.setattr(registry, "SPREAD_ROWS", 500, raising=False)
    assert entry.queries()["mandatory_recall"](spark, SF).rdd.getNumPartitions() >= 6000 // 500
