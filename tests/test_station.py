"""Each gate gets a clean input and a mutated one that must flip exactly that gate."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldcheck.operators import certify, diff, fingerprint, selection, station

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "station_id string, timestamp timestamp_ntz, field_id string, value double"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def clean():
    return [(s, DAY + dt.timedelta(hours=h), f, 10.0 * h + len(f)) for s in "ab" for f in ("t", "rh") for h in range(3)]


def ids(spark):
    return spark.createDataFrame([("station", "a"), ("station", "b"), ("field", "t"), ("field", "rh")], "kind string, id string")


def gates(spark, candidate, rerun=None, claimed=6):
    day = F.lit("2024-01-01").cast("timestamp_ntz")
    claims = spark.createDataFrame([("t", claimed), ("rh", 6)], "field_id string, rows long")
    rows = certify.station_gates(
        table(spark, candidate), table(spark, rerun or candidate), table(spark, clean()), ids(spark), claims, day, day, 1e-6, 1e-6
    )
    return {r["check_id"]: r["status"] for r in certify.assess(spark, "c", rows).collect()}


def mutated(index, **change):
    rows = [list(r) for r in clean()]
    for name, value in change.items():
        rows[index][("station_id", "timestamp", "field_id", "value").index(name)] = value
    return [tuple(r) for r in rows]


VALUES, KEYS = "semantic.station_values_and_missingness", "contract.station_scope_and_keys"
SCOPE, IDS, RERUN = "contract.time_scope", "contract.identities", "rerun.station_logical_equivalence"
RECEIPTS = "provenance.receipts"


@pytest.mark.parametrize(
    "candidate, rerun, flipped",
    [
        (clean(), None, set()),
        (clean()[::-1], clean(), set()),
        (mutated(4, value=99.0), None, {VALUES}),
        (mutated(4, value=None), None, {VALUES}),
        (mutated(4, value=NAN), None, {VALUES}),
        (mutated(4, value=INF), None, {VALUES}),
        (clean()[:-1], None, {VALUES, RECEIPTS}),
        (clean() + [clean()[0]], None, {KEYS, VALUES, RECEIPTS}),
        (mutated(2, station_id=None), None, {KEYS, VALUES, IDS}),
        (mutated(0, timestamp=DAY + dt.timedelta(days=1)), None, {SCOPE, VALUES}),
        (mutated(0, field_id="extra"), None, {IDS, VALUES, RECEIPTS}),
        (clean(), mutated(1, value=10.0000001), {RERUN}),
        (clean(), clean()[1:], {RERUN}),
        ([], None, {KEYS, VALUES, IDS, RECEIPTS}),
    ],
)
def test_mutation_flips_only_its_gates(spark, candidate, rerun, flipped):
    seen = gates(spark, candidate, rerun)
    assert {k for k, v in seen.items() if v != "PASS"} == flipped


def test_a_failed_gate_blocks_those_that_need_it(spark):
    """What is blocked is not measured at all."""
    seen = gates(spark, clean() + [clean()[0]])
    assert seen[KEYS] == "FAIL" and seen[VALUES] == "NOT_ASSESSED" and seen[RERUN] == "PASS"
    assert gates(spark, mutated(4, value=99.0))[VALUES] == "FAIL" and gates(spark, clean(), claimed=5)[RECEIPTS] == "FAIL"
    ran = []
    count = lambda name, n: lambda: ran.append(name) or spark.range(1).select(F.lit(n))
    graph = [
        certify.Gate("last", "d", count("last", 0), ("middle",)),
        certify.Gate("middle", "c", count("middle", 0), ("first", "other")),
        certify.Gate("first", "a", count("first", 3)),
        certify.Gate("other", "b", count("other", None)),
    ]
    rows = certify.assess(spark, "c", graph).collect()
    assert [(r["check_id"], r["status"], r["observed"]) for r in rows] == [
        ("last", "NOT_ASSESSED", None), ("middle", "NOT_ASSESSED", None), ("first", "FAIL", 3), ("other", "NOT_ASSESSED", None)
    ]
    assert sorted(ran) == ["first", "other"]


@pytest.mark.parametrize(
    "left, right, status",
    [(1.0, 1.0, "match"), (INF, INF, "match"), (INF, -INF, "value"), (NAN, None, "match"), (1.0, NAN, "missingness"),
     (-999.0, NAN, "match"), (100.5, 100.0, "match"), (0.5, 0.0, "value"), (1e-10, 0.0, "match")],
)
def test_tolerance_and_missing(spark, left, right, status):
    rows = [("s", DAY, "f", left)], [("s", DAY, "f", right)]
    out = diff.diff_values(table(spark, rows[0]), table(spark, rows[1]), station.KEY, 1e-9, 0.01, markers=(-999.0,)).first()
    assert out["status"] == status


def test_unequal_missing_switch(spark):
    t = table(spark, [("s", DAY, "f", NAN)])
    assert diff.diff_values(t, t, station.KEY, equal_missing=False).first()["status"] == "missingness"


def test_summary_of_infinite_relative_error(spark):
    a, b = table(spark, [("s", DAY, "f", 2.0), ("s", DAY, "g", 3.0)]), table(spark, [("s", DAY, "f", 0.0), ("s", DAY, "g", 2.0)])
    row = diff.mismatch_summary(diff.diff_values(a, b, station.KEY)).first()
    assert (row["value_mismatches"], row["infinite_relative"], row["max_abs_error"], row["max_rel_error"]) == (2, 1, 2.0, 0.5)


def test_a_zero_reference_without_a_candidate_has_no_relative_error(spark):
    """Neither a lost value nor a lost key is an infinite error."""
    a = table(spark, [("s", DAY, "f", None), ("s", DAY, "g", 2.0)])
    b = table(spark, [("s", DAY, "f", 0.0), ("t", DAY, "f", 0.0), ("s", DAY, "g", 1.0)])
    row = diff.mismatch_summary(diff.diff_values(a, b, station.KEY)).first()
    assert (row["missingness_mismatches"], row["missing_keys"], row["infinite_relative"], row["max_rel_error"]) == (1, 1, 0, 1.0)


def test_hot_repeated_key_is_one_row(spark):
    many = spark.range(5000).select(F.lit("s").alias("station_id"), F.lit(DAY).cast("timestamp_ntz").alias("timestamp"), F.lit("f").alias("field_id"), F.col("id").cast("double").alias("value"))
    out = diff.diff_values(many, table(spark, [("s", DAY, "f", 1.0)]), station.KEY).collect()
    assert [(r["candidate_rows"], r["status"]) for r in out] == [(5000, "repeated_key")]


def test_error_of_a_repeated_key_is_between_the_values_of_its_row(spark):
    """Equal tables have no error, though a key of both has several values."""
    rows = [("s", DAY, "f", 1.0), ("s", DAY, "f", 5.0)]
    same = diff.diff_values(table(spark, rows), table(spark, rows), station.KEY)
    row = same.first()
    assert (row["candidate"], row["reference"], row["abs_error"], row["status"]) == (5.0, 5.0, 0.0, "repeated_key")
    total = diff.mismatch_summary(same).first()
    assert (total["max_abs_error"], total["max_rel_error"], total["repeated_keys"]) == (0.0, 0.0, 1)
    more = diff.diff_values(table(spark, rows), table(spark, [("s", DAY, "f", 0.0), ("s", DAY, "f", 4.0)]), station.KEY)
    assert more.first()["abs_error"] == 1.0


def test_fingerprint_ignores_order_but_not_content(spark):
    one = fingerprint.table_fingerprint(table(spark, clean())).first()["fingerprint"]
    assert one == fingerprint.table_fingerprint(table(spark, clean()[::-1]).repartition(7)).first()["fingerprint"]
    for other in (mutated(3, value=3.5), clean()[1:], clean() + [clean()[0]]):
        assert one != fingerprint.table_fingerprint(table(spark, other)).first()["fingerprint"]
    wider = table(spark, clean()).withColumn("extra", F.lit("x"))
    assert one != fingerprint.table_fingerprint(wider).first()["fingerprint"]


def test_fingerprint_tells_null_and_borders_apart(spark):
    mark = lambda *rows: fingerprint.table_fingerprint(spark.createDataFrame(list(rows), "a string, b string")).first()["fingerprint"]
    assert len({mark(("missing", "x")), mark((None, "x")), mark(("~", "x")), mark(("", "x")), mark(("x", None))}) == 5
    assert mark(("a\x1fb", "c")) != mark(("a", "b\x1fc")) and mark(("1:a", "")) != mark(("", "1:a"))


def test_canonicalise_refuses_bad_hints(spark):
    df = spark.createDataFrame([("s", DAY, 1.0, 2.0)], "st string, ts timestamp_ntz, t double, z double")
    out = station.canonicalise(df, "st", "ts", {"t": "temperature", "z": "geopotential"})
    assert {(r["field_id"], r["value"]) for r in out.collect()} == {("temperature", 1.0), ("geopotential", 2.0)}
    for hints in ({"st": "x"}, {"absent": "x"}):
        with pytest.raises(ValueError):
            station.canonicalise(df, "st", "ts", hints)


def test_rename_keeps_a_taken_name(spark):
    df = spark.createDataFrame([(1, 2, 3)], "lat int, latitude int, lon int")
    assert station.rename_aliases(df).columns == ["lat", "latitude", "longitude"]


@pytest.mark.parametrize("west, east, kept", [(10, 20, [15]), (170, -170, [175, -175]), (-180, 180, [-175, 0, 15, 175]), (350, 5, [0])])
def test_area_wraps_the_dateline(spark, west, east, kept):
    df = spark.createDataFrame([(0.0, float(x)) for x in (-175, 0, 15, 175)], "latitude double, longitude double")
    out = selection.select_area(df, *[F.lit(float(v)) for v in (90, west, -90, east)])
    assert [r["longitude"] for r in out.collect()] == [x for x in (-175, 0, 15, 175) if x in kept]


def test_requested_times_half_open(spark):
    scopes = spark.createDataFrame(
        [("a", dt.date(2024, 2, 28), dt.date(2024, 3, 1), True, [0, 43200]), ("b", dt.date(2024, 1, 1), dt.date(2024, 1, 3), False, [0]), ("c", dt.date(2024, 1, 1), dt.date(2024, 1, 1), False, [0])],
        "scope string, start_date date, end_date date, inclusive boolean, times array<int>",
    )
    out = selection.requested_timestamps(scopes, ["scope"]).groupBy("scope").count().collect()
    assert {r["scope"]: r["count"] for r in out} == {"a": 6, "b": 2}


def test_first_source_wins(spark):
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    b = spark.createDataFrame([(1, "b", 7), (2, "b", 8)], "k int, v string, w int")
    out = {r["k"]: (r["v"], r["w"]) for r in selection.first_source_wins([a, b], ["k"]).collect()}
    assert out == {1: ("a", 7), 2: ("b", 8)}


def test_first_source_wins_for_each_variable(spark):
    a = spark.createDataFrame([("k", 1.0, None)], "k string, t double, h double")
    b = spark.createDataFrame([("k", 2.0, 9.0), ("m", None, 3.0)], "k string, t double, h double")
    out = {r["k"]: (r["source_no"], r["t"], r["h"]) for r in selection.first_source_wins([a, b], ["k"]).collect()}
    assert out == {"k": (0, 1.0, 9.0), "m": (1, None, 3.0)}


def test_fingerprints_are_exact(spark):
    from fieldcheck.operators import fingerprint

    mark = lambda *v: fingerprint.table_fingerprint(spark.createDataFrame([(x,) for x in v], "v double")).first()["fingerprint"]
    assert mark(1e-20) != mark(2e-20) and mark(1e25) != mark(1e26) and mark(0.1) != mark(0.1 + 2**-55)
    assert mark(0.0) == mark(-0.0) and mark(1.0, 2.0) == mark(2.0, 1.0) and mark(None) == mark(float("nan"))
