from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fieldcheck.functions import columns, text
from fieldcheck.operators import bundles, checks, contracts, diff, experiments, inventory, provenance


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize("wildcard, want", [(True, {"f1": True, "f2": True, "f3": False}), (False, {"f1": True, "f2": False, "f3": False})])
def test_rule_wildcards(spark, wildcard, want):
    fields = rows(spark, [("d", "f1", {"variable": "t", "level": "500"}), ("d", "f2", {"variable": "z", "level": "1"}), ("d", "f3", {"variable": "q", "level": "1"})], "dataset string, field string, selection map<string,string>")
    rules = rows(spark, [("d", {"variable": ["t"], "level": ["500", "850"]}), ("d", {"variable": ["z"]})], "dataset string, rule map<string,array<string>>")
    got = contracts.rule_allowed(fields, rules, wildcard).collect()
    assert {r["field"]: r["allowed"] for r in got} == want


def test_dataset_without_rules(spark):
    fields = rows(spark, [("d", "f", {"variable": "t"})], "dataset string, field string, selection map<string,string>")
    none = rows(spark, [], "dataset string, rule map<string,array<string>>")
    assert contracts.rule_allowed(fields, none, True).first()["allowed"] and not contracts.rule_allowed(fields, none, False).first()["allowed"]


def test_versions_reuse_content(spark):
    revisions = rows(spark, [("s", 1, "a"), ("s", 2, "b"), ("s", 3, "a"), ("s", 4, "c"), ("q", 5, "b")], "slug string, seq int, hash string")
    got = {(r["slug"], r["hash"]): r["version"] for r in contracts.lock_versions(revisions, ["hash"]).collect()}
    assert got == {("s", "a"): 1, ("s", "b"): 2, ("s", "c"): 3, ("q", "b"): 1}


def test_preferences(spark):
    data = [("ok", "ordered", "output_bytes", "minimize", 1), ("ok", "ordered", "q_engineering", "maximize", 2), ("ok", "descriptive", "materialization_seconds", None, None),
            ("bad", "ordered", "output_bytes", "maximize", 1), ("bad", "ordered", "output_bytes", "minimize", 3), ("bad", "descriptive", "output_bytes", None, None)]
    got = {r["contract"]: r["problems"] for r in contracts.preference_problems(rows(spark, data, "contract string, role string, objective string, direction string, priority int")).collect()}
    assert got == {"ok": "", "bad": "direction,objective_repeated,ordered_and_descriptive,priority_gap"}


def cost(spark, model, i, c, o):
    df = rows(spark, [(model, i, c, o)], "model string, input_tokens long, cached_input_tokens long, output_tokens long")
    return experiments.price_calls(df).first()


@pytest.mark.parametrize(
    "model, i, c, o, family, usd",
    [
        ("gpt-4o-2024-08-06", 1000, 400, 50, "gpt-4o", Decimal("0.0025")),
        ("gpt-5.4", 272000, 0, 0, "gpt-5.4", Decimal("0.68")),
        ("gpt-5.4", 272001, 0, 100, "gpt-5.4", Decimal("1.362255")),
        ("gemini-3.1-pro-preview", 200001, 200001, 0, "gemini-3.1-pro-preview", Decimal("0.0800004")),
        ("gpt-4o-mini", 1, 0, 0, "unpriced", None),
    ],
)
def test_prices(spark, model, i, c, o, family, usd):
    row = cost(spark, model, i, c, o)
    assert (row["family"], row["cost_usd"]) == (family, usd)


def test_success_at_k(spark):
    schema = "condition string, trial_id int, generation_succeeded boolean, initial_passed boolean, repairs_attempted int, repair_status string, final_passed boolean"
    data = [("c", 1, True, True, 0, None, True), ("c", 2, True, False, 2, "repaired", True), ("c", 3, True, False, 3, "exhausted", False), ("c", 4, False, False, 0, None, False)]
    row = experiments.success_at_k(rows(spark, data, schema)).first()
    assert (row["success_at_1"], row["success_after_repairs"], row["generation_failures"]) == (1, 2, 1)
    assert [row[f"attempts_{k}"] for k in range(4)] == [2, 0, 1, 1]


def test_constraint_status_priority(spark):
    data = [("a", c, i, s) for i, (c, s) in enumerate([(checks.CONSTRAINTS[0], "PASS"), (checks.CONSTRAINTS[0], "FAIL"), (checks.CONSTRAINTS[0], "ERROR"), (checks.CONSTRAINTS[1], "NOT_ASSESSED"), (checks.CONSTRAINTS[1], "FAIL"), (checks.CONSTRAINTS[2], "PASS")])]
    row = checks.constraint_rollup(rows(spark, data, "candidate_id string, constraint string, seq int, status string")).first()
    assert [row[c] for c in checks.CONSTRAINTS] == ["ERROR", "FAIL", "PASS", "NOT_ASSESSED"] and not row["feasible"]


def test_plan_of_a_station_profile(spark):
    p = rows(spark, [(1, ["core", "data-class:station-time-series", "parquet", "workload:filtered-station-scan"])], "profile_id int, tags array<string>")
    plan = {r["check_id"] for r in checks.check_plan(p, checks.catalog_table(spark)).collect()}
    assert len(plan) == 16 + 6 and "semantic.station_values_and_missingness" in plan and "contract.zarr_integrity" not in plan
    assert len(checks.MANDATORY_CORE) == 13 and len(checks.CATALOG) == 34


def test_logical_field_ids(spark):
    sel = "array<struct<dimension:string,value:string,value_type:string>>"
    df = rows(spark, [("t", [("p", "500", "number"), ("kind", 'a"b', "string")]), ("z", [])], f"name string, s {sel}")
    got = df.select(columns.field_id(F.col("name"), F.col("s")), columns.field_id(F.col("name"), F.col("s"), "contract_order_text")).collect()
    assert [tuple(r) for r in got] == [('t[kind="a\\"b",p=500]', 't[p="500",kind="a\\"b"]'), ("z", "z")]


@pytest.mark.parametrize(
    "body, reason",
    [
        ("all fine", "clean"),
        ("x known-one y password = 'longenough1'", "known_environment_secret"),
        ("-----BEGIN PRIVATE KEY-----\npassword='longenough1'", "private_key_material"),
        ("API-KEY: \"12345678\"", "assigned_secret_like_value"),
        ("password='short'", "clean"),
        ('{"access_token": "abcdefgh"}', "assigned_secret_like_value"),
    ],
)
def test_secret_reasons(spark, body, reason):
    df = rows(spark, [(body,)], "t string")
    assert df.select(text.secret_reason(F.col("t"), ["known-one"])).first()[0] == reason


def test_redaction_is_longest_first(spark):
    df = rows(spark, [("abcd abc ab abcd",)], "t string")
    out = df.select(text.redacted(F.col("t"), ["abc", "abcd"]), text.redaction_count(F.col("t"), ["abc", "abcd"])).first()
    assert tuple(out) == ("<redacted> <redacted> ab <redacted>", 3)


@pytest.mark.parametrize(
    "log, launched, timed_out, pytest_run, origin",
    [
        ("Permission denied", False, False, False, "harness"),
        ("Permission denied", True, False, False, "candidate"),
        ("No module named 'pytest'", True, False, True, "environment"),
        ("No module named 'pytest'", True, False, False, "candidate"),
        ("No module named pytest_extra", True, False, True, "candidate"),
        ("library not loaded; bad gateway", True, False, False, "environment"),
        ("HTTP Error 403", True, False, False, "provider"),
        ("shared public output policy hash mismatch", True, False, False, "policy"),
    ],
)
def test_failure_owner(spark, log, launched, timed_out, pytest_run, origin):
    df = rows(spark, [(log, launched, timed_out, pytest_run)], "l string, a boolean, b boolean, c boolean")
    assert df.select(text.failure_class(*[F.col(c) for c in "labc"])).first()[0] == origin


@pytest.mark.parametrize("path, safe", [("a/b.txt", True), ("/a", False), ("a/../b", False), ("", False), (None, False), ("a/..b", True)])
def test_safe_path(spark, path, safe):
    assert rows(spark, [(path,)], "p string").select(columns.safe_path(F.col("p"))).first()[0] is safe


def test_json_of_any_depth(spark):
    docs = rows(spark, [(1, '{"a":{"b":{"my_token":"x"}},"secret":"","key":[1]}')], "doc int, j string")
    whole = {(r["path"], r["finding"]) for r in inventory.sensitive_keys(docs, "doc", "j").collect()}
    assert whole == {("$.a.b.my_token", "sensitive"), ("$.key", "sensitive")}
    deep = '{"b":' * 14 + '{"type":"table","id":"t","token":"x"}' + "}" * 14
    docs = rows(spark, [(1, deep), (2, '{"type":"table","id":"root"}'), (3, "[]"), (4, "1")], "doc int, j string")
    assert [r["path"] for r in inventory.sensitive_keys(docs, "doc", "j").collect()] == ["$" + ".b" * 14 + ".token"]
    assert {(r["doc"], r["table_id"]) for r in inventory.layout_tables(docs, "doc", "j").collect()} == {(1, "t"), (2, "root")}


def test_catalogue_urls(spark):
    urls = ["https://cds.climate.copernicus.eu/datasets/era5-x?tab=d", "https://cds.climate.copernicus.eu/about", "https://other.org/datasets/y", "not a url"]
    extractor, dataset = inventory.route_source(F.col("u"))
    got = [tuple(r) for r in rows(spark, [(u,) for u in urls], "u string").select(extractor, dataset).collect()]
    assert got == [("process_metadata", "era5-x")] + [("minimal_manual_inventory", "")] * 3


def test_budget_and_relevance(spark):
    files = rows(spark, [("b", 1, 50), ("b", 2, 200), ("b", 3, 30), ("b", 4, 10)], "bundle string, pos int, n_chars int")
    got = {r["pos"]: (r["included"], r["state"]) for r in bundles.budget_pack(files, ["bundle"], ["pos"], 100, 160).collect()}
    assert got == {1: (50, "whole"), 2: (100, "truncated"), 3: (10, "truncated"), 4: (0, "excluded")}
    texts = rows(spark, [("r", "a/x.md", "needle haystack"), ("r", "b.py", "needle"), ("r", "c.py", "none"), ("r", "z.txt", "nothing")], "run_id string, path string, text string")
    logs = rows(spark, [("r", 'Error: File "z.txt" needle HAYSTACK line')], "run_id string, log string")
    ranked = bundles.failure_relevance(texts, logs).orderBy("rank").collect()
    assert [r["path"] for r in ranked] == ["z.txt", "a/x.md", "b.py", "c.py"]


def test_overlap_by_ancestors(spark):
    files = rows(spark, [("b", "src/a/x.py"), ("b", "src/y.py"), ("b", "srcs/z.py")], "bundle string, path string")
    declared = rows(spark, [("b", "src"), ("b", "src/a"), ("b", "srcs/z.py")], "bundle string, prefix string")
    assert [tuple(r) for r in provenance.path_overlap(files, declared).collect()] == [("b", "src/a/x.py", 2)]


def test_trial_costs_split(spark):
    data = [("t", 2, "agent", True, "2024-01-01 00:00:10", Decimal(3)), ("t", 1, "agent", True, "2024-01-01 00:00:00", Decimal(1)), ("t", 3, "judge", True, "2024-01-01 00:01:00", Decimal(5)), ("t", 4, "agent", False, "2024-01-01 00:00:30", Decimal(9))]
    df = rows(spark, data, "trial_id string, call_no int, kind string, has_usage boolean, started_at string, cost_usd decimal(20,10)").withColumn("started_at", F.col("started_at").cast("timestamp"))
    r = experiments.trial_costs(df).first()
    assert (r["generation_usd"], r["repair_usd"], r["judge_usd"], r["total_usd"], r["calls_without_usage"], r["wall_seconds"]) == (1, 3, 5, 9, 1, 60)


def test_rules_against_all_pairs(spark):
    """A dataset of 10,000 rules of four shapes, small ones beside it; every field against every rule by hand."""
    import random

    draw = random.Random(9)
    dims, fields, rules = ["a", "b", "c"], [], []
    for dataset, n in (("hot", 10_000), ("d1", 3), ("d2", 1), ("wild", 1)):
        for _ in range(n):
            chosen = [] if dataset == "wild" else draw.sample(dims, draw.randint(1, 3))
            rules.append((dataset, {d: [str(draw.randint(0, 60)) for _ in range(draw.randint(0, 4))] + [None] for d in chosen}))
        for i in range(40):
            chosen = draw.sample(dims, draw.randint(0, 3))
            fields.append((dataset, f"{dataset}{i}", {d: draw.choice([None, *map(str, range(61))]) for d in chosen}))
    frames = (
        rows(spark, fields, "dataset string, field string, selection map<string,string>"),
        rows(spark, rules + rules[:50], "dataset string, rule map<string,array<string>>"),
    )
    for wildcard in (True, False):
        fits = lambda sel, rule: all((v is not None and v in rule[d]) if d in rule else wildcard for d, v in sel.items())
        want = {f: any(fits(sel, r) for d2, r in rules if d2 == d) for d, f, sel in fields}
        got = {r["field"]: r["allowed"] for r in contracts.rule_allowed(*frames, wildcard).collect()}
        assert got == want and len(set(want.values())) == 2


def test_options_of_odd_documents(spark):
    rows = [
        ("null", None), ("list", "[]"), ("broken", "{"), ("bare", '{"inputs":{"x":5}}'),
        ("flat", '{"inputs":{"x":{"title":3,"schema":{"items":"any","enum":[1,true,"a"],"default":[1]}}}}'),
    ]
    docs = spark.createDataFrame(rows, "dataset string, process string")
    got = {r["dataset"]: r for r in inventory.extract_options(docs).collect()}
    assert set(got) == {"bare", "flat"} and got["bare"]["option_count"] == 0 and got["bare"]["constraint_values"] == "{}"
    flat = got["flat"]
    assert (flat["title"], flat["options"], flat["default_value"], flat["required"]) == ("", ["1", "true", "a"], "[1]", None)
    assert flat["constraint_values"] == '{"items":"any"}' and flat["item_constraints"] is None


def test_declarations_against_the_policy(spark):
    declared = spark.createDataFrame([("a", "units", "m"), ("b", "units", "K"), ("c", "units", None), ("d", "title", "x")], "channel string, property string, expected string")
    policy = spark.createDataFrame([("units", "K")], "property string, expected string")
    got = [tuple(r) for r in diff.policy_conflicts(declared, policy, ["channel"]).collect()]
    assert got == [("a", "units", "m", "K")]


def test_bundles_end_at_a_line(spark):
    body = {1: "aaaa\nbbbb", 2: "cc\ndd\nee", 3: "x"}
    files = spark.createDataFrame([("r", i, t, len(t)) for i, t in body.items()], "bundle string, pos int, text string, n_chars int")
    packed = bundles.budget_pack(files, ["bundle"], ["pos"], 100, 16, "text")
    assert {r["pos"]: (r["included"], r["state"]) for r in packed.collect()} == {1: (9, "whole"), 2: (5, "truncated"), 3: (0, "excluded")}
    one = bundles.pack_coverage(packed, ["bundle"]).first().asDict()
    assert one == {"bundle": "r", "files": 3, "included_files": 2, "truncated_files": 1, "excluded_files": 1, "total_chars": 18, "included_chars": 14}
    no_line = bundles.budget_pack(files.filter("pos <> 2"), ["bundle"], ["pos"], 100, 3, "text")
    assert {r["pos"]: r["included"] for r in no_line.collect()} == {1: 0, 3: 0}


def test_store_metadata_is_scanned(spark):
    paths = spark.createDataFrame([("s/.zattrs",), ("s/zarr.json",), ("s/.zindex",), ("a.TXT",), ("x/.env",), ("c.bin",), ("a.txt/c",)], "path string")
    got = {r[0]: r[1] for r in paths.select("path", text.is_scanned(F.col("path"))).collect()}
    assert [p for p, scanned in got.items() if scanned] == ["s/.zattrs", "s/zarr.json", "a.TXT"]
