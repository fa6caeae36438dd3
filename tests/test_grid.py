from __future__ import annotations

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcheck.operators import certify, fingerprint, grid, selection


@pytest.fixture(scope="module")
def cells(spark):
    axes = itertools.product(["a", "b"], range(20), range(6), range(6))
    rows = [(f, s, y, x, float(1000 * s + 10 * y + x + (0.5 if f == "b" else 0))) for f, s, y, x in axes]
    return spark.createDataFrame(rows, "field_id string, sample int, y int, x int, value double").cache()


def windows(df):
    return df.groupBy("sample").agg(F.first("top").alias("top"), F.first("left").alias("left"), F.count("*").alias("n"), F.countDistinct("top", "left").alias("k"))


def test_aligned_patches(cells):
    for r in windows(grid.patches(cells, 6, 6, 3, "chunk_aligned", seed=1, chunk=3)).collect():
        assert r["top"] in (0, 3) and r["left"] in (0, 3) and r["n"] == 18 and r["k"] == 1


def test_misaligned_patches_avoid_corners(cells):
    seen = windows(grid.patches(cells, 6, 6, 2, "misaligned", seed=1, chunk=2)).collect()
    assert len(seen) == 20 and len({(r["top"], r["left"]) for r in seen}) > 3
    for r in seen:
        assert 0 <= r["top"] <= 4 and 0 <= r["left"] <= 4
        # Only the last corner has no room to step aside.
        assert (r["top"], r["left"]) == (4, 4) or r["top"] % 2 or r["left"] % 2
        assert r["n"] == 8


def test_patches_repeat_by_seed(cells):
    draw = lambda seed: {r["sample"]: (r["top"], r["left"]) for r in windows(grid.patches(cells, 6, 6, 2, "misaligned", seed)).collect()}
    assert draw(4) == draw(4) != draw(5)


@pytest.mark.parametrize("size, mode, chunk", [(7, "misaligned", None), (2, "chunk_aligned", 3), (2, "other", None)])
def test_bad_patches_are_refused(cells, size, mode, chunk):
    with pytest.raises(ValueError):
        grid.patches(cells, 6, 6, size, mode, 1, chunk)


def test_sample_order_is_a_fixed_permutation(spark):
    df = spark.range(500).select(F.col("id").alias("sample"))
    order = lambda seed: [r["sample"] for r in grid.sample_order(df.repartition(5), seed).orderBy("position").collect()]
    first = order(3)
    assert sorted(first) == list(range(500)) and first == order(3) and first != order(4) and first != sorted(first)


@pytest.mark.parametrize("shape, bound", [((28, 721, 1440), 400_000), ((5, 1, 3), 4), ((1, 1, 1), 0), ((9, 9), 81)])
def test_block_widths_fit_and_cover(spark, shape, bound):
    shape = (*shape, 1)[:3]
    row = grid.block_widths(spark.createDataFrame([shape], "sample long, y long, x long"), bound).first()
    widths = [row[f"{a}_width"] for a in grid.AXES]
    assert math.prod(widths) <= max(1, bound) and all(1 <= w <= s for w, s in zip(widths, shape))


@pytest.mark.parametrize("height, width, rows", [(721, 1440, 273), (8, 4, 8), (500, 100_000, 16), (10, 0, 10)])
def test_rows_per_block(spark, height, width, rows):
    assert spark.range(1).select(grid.rows_per_block(F.lit(height), F.lit(width))).first()[0] == rows


def whole(blocks) -> dict:
    """Sample -> tensor, from blocks in any order."""
    out: dict = {}
    for r in sorted(blocks.collect(), key=lambda r: (r["sample"], r["first"])):
        out.setdefault(r["sample"], []).append(np.frombuffer(r["data"], "<f4"))
    return {k: np.concatenate(v) for k, v in out.items()}


@pytest.mark.parametrize("block_cells", [1, 7, 36, 1 << 16])
def test_tensor_keeps_channel_order(cells, block_cells):
    packed = grid.tensor_pack(cells, ["b", "a"], block_cells)
    row = packed.filter("sample = 2").first()
    tensor = whole(packed)[2]
    assert (row["c"], row["h"], row["w"]) == (2, 6, 6) and len(tensor) == 72
    assert tensor[0] == 2000.5 and tensor[36] == 2000.0 and tensor[7] == 2011.5
    broken = cells.filter(~((F.col("sample") == 3) & (F.col("y") == 5) & (F.col("x") == 5) & (F.col("field_id") == "a")))
    lacking = grid.tensor_pack(broken, ["b", "a"], block_cells)
    assert np.isnan(whole(lacking)[3]).sum() == 1 or block_cells == 1
    doubled = grid.tensor_pack(broken.unionByName(broken.filter("sample = 3 AND y = 5 AND x = 4 AND field_id = 'a'")), ["b", "a"], block_cells)
    for frame in (lacking, doubled):
        assert [r["sample"] for r in grid.tensor_check(frame, 2, 6, 6).filter(~F.col("accepted")).collect()] == [3]


def test_unequal_channels_are_refused(cells):
    low = cells.filter(~((F.col("sample") == 4) & (F.col("y") == 5) & (F.col("field_id") == "a")))
    with pytest.raises(Exception, match="unequal shape in sample 4"):
        grid.tensor_pack(low, ["b", "a"]).collect()
    assert len(grid.tensor_pack(low.filter("sample <> 4"), ["b", "a"]).collect()) == 19
    lone = grid.tensor_pack(cells.filter("field_id = 'a'"), ["b", "a"])
    assert lone.first()["c"] == 1 and not grid.tensor_check(lone, 2, 6, 6).filter("accepted").count()


def test_a_full_size_tensor_comes_in_blocks(spark):
    """721 x 1440 x 3 cells: 48 blocks of a quarter of a MiB at most."""
    h, w = 721, 1440
    n = spark.range(3 * h * w, numPartitions=8)
    cells = n.select(
        F.lit(0).alias("sample"), F.concat(F.lit("f"), F.floor(F.col("id") / (h * w)).cast("string")).alias("field_id"),
        F.floor(F.col("id") / w).cast("int").alias("_r"), (F.col("id") % w).cast("int").alias("x"), (F.col("id") % 97).cast("double").alias("value"),
    ).withColumn("y", (F.col("_r") % h).cast("int"))
    blocks = grid.tensor_pack(cells, ["f0", "f1", "f2"]).cache()
    sizes = [len(r["data"]) for r in blocks.collect()]
    assert len(sizes) == -(-3 * h * w // grid.BLOCK_CELLS) and max(sizes) == 4 * grid.BLOCK_CELLS
    assert (whole(blocks)[0] == np.arange(3 * h * w) % 97).all()
    assert grid.tensor_reduce(blocks).first()["total"] == float((np.arange(3 * h * w) % 97).sum())
    assert grid.tensor_check(blocks, 3, h, w).first()["accepted"]
    blocks.unpersist()


def test_shape_report_sees_a_lost_cell(spark, cells):
    want = spark.createDataFrame([("a", 20, 6, 6), ("b", 20, 6, 6), ("c", 20, 6, 6)], "field_id string, samples int, height int, width int")
    lost = cells.filter(~((F.col("sample") == 3) & (F.col("y") == 2) & (F.col("x") == 5) & (F.col("field_id") == "a")))
    got = {r["field_id"]: (r["complete"], r["as_expected"]) for r in grid.shape_report(lost, want).collect()}
    assert got == {"a": (False, True), "b": (True, True), "c": (False, False)}


@pytest.mark.parametrize(
    "value, units, calendar, want",
    [
        (1.5, "hours since 2000-01-01", "standard", dt.datetime(2000, 1, 1, 1, 30)),
        (90.0, " Minutes since 2000-01-01T00:00:00 ", None, dt.datetime(2000, 1, 1, 1, 30)),
        (-1.0, "days since 1970-01-01", "gregorian", dt.datetime(1969, 12, 31)),
        (0.0000005, "seconds since 1970-01-01", "standard", dt.datetime(1970, 1, 1)),
        (0.0000015, "seconds since 1970-01-01", "standard", dt.datetime(1970, 1, 1, 0, 0, 0, 2)),
        (1.0, "days since 1970-01-01", "noleap", "calendar_unsupported"),
        (1.0, "months since 1970-01-01", "standard", "units_unsupported"),
        (1.0, "days since someday", "standard", "origin_unsupported"),
    ],
)
def test_cf_time(spark, value, units, calendar, want):
    df = spark.createDataFrame([(value, units, calendar)], "value double, units string, calendar string")
    row = grid.decode_cf(df).first()
    if isinstance(want, str):
        assert row["status"] == want and row["epoch_micros"] is None
    else:
        assert row["epoch_micros"] == (want - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def test_coordinate_checks(spark):
    rows = [("good", i, i * 0.25) for i in range(5)]
    rows += [("twice", i, v) for i, v in enumerate([0.0, 1.0, 1.0])] + [("down", i, -float(i)) for i in range(3)]
    rows += [("gap", i, v) for i, v in enumerate([0.0, 1.0, float("nan")])] + [("one", 0, 5.0)]
    coords = spark.createDataFrame(rows, "axis string, idx int, value double")
    spec = spark.createDataFrame(
        [("good", "increasing", 0.25), ("twice", "increasing", 1.0), ("down", "decreasing", 1.0), ("gap", None, None), ("one", "increasing", 2.0)],
        "axis string, monotonic string, expected_step double",
    )
    got = {r["axis"]: (r["not_finite"], r["duplicates"], r["monotonic_ok"], r["step_ok"]) for r in grid.validate_coordinates(coords, spec).collect()}
    assert got == {"good": (0, 0, True, True), "twice": (0, 1, False, False), "down": (0, 0, True, True), "gap": (1, 0, True, True), "one": (0, 0, True, True)}


def test_time_steps_are_exact_seconds(spark):
    hour = 3_600_000_000
    rows = [("even", i, None, i * hour) for i in range(4)] + [("odd", i, None, i * hour + (i == 2)) for i in range(4)]
    rows += [("number", i, float(i), None) for i in range(3)] + [("unread", 0, None, 0), ("unread", 1, None, None)]
    coords = spark.createDataFrame(rows, "axis string, idx long, value double, epoch_micros long")
    spec = spark.createDataFrame(
        [(a, "increasing", None, 3600.0) for a in ("even", "odd", "number", "unread")], "axis string, monotonic string, expected_step double, expected_step_seconds double"
    )
    got = {r["axis"]: (r["not_finite"], r["monotonic_ok"], r["step_ok"]) for r in grid.validate_coordinates(coords, spec).collect()}
    assert got == {"even": (0, True, True), "odd": (0, True, False), "number": (0, True, False), "unread": (1, True, True)}


def test_declarations_of_an_axis(spark):
    coords = spark.createDataFrame([("x", 0, 1.0)], "axis string, idx long, value double")
    kind = "axis string, monotonic string, expected_step double, expected_dtype string, dtype string, expected_fill string, fill string, metadata map<string,string>, attrs map<string,string>"
    flags = ["dtype_ok", "fill_ok", "metadata_ok", "policy_ok"]
    cases = [
        (("f8", "f8", "nan", "NaN", {"units": "m"}, {"units": "m", "more": "x"}), [True] * 4),
        (("f8", None, "0", None, {"units": "m"}, None), [False, False, False, True]),
        (("f4", "f8", None, "0", {"policy": "a"}, {"policy": "b"}), [False, True, True, False]),
        ((None, "f8", None, None, None, {"units": "m"}), [True] * 4),
    ]
    for given, want in cases:
        spec = spark.createDataFrame([("x", None, None, *given)], kind)
        row = grid.validate_coordinates(coords, spec, ["policy"]).first()
        assert [row[f] for f in flags] == want, given


@pytest.mark.parametrize("text, want", [("2000-01-01", 0), ("2000-01-01T06", 6), ("2000-01-01 06:30", 6.5), ("2000-01", 0), ("2000", None), ("yesterday", None), ("", None)])
def test_iso_times(spark, text, want):
    df = spark.createDataFrame([(None, None, None, text)], "value double, units string, calendar string, iso string")
    row = grid.decode_cf(df).first()
    start = dt.datetime(2000, 1, 1).replace(tzinfo=dt.timezone.utc).timestamp()
    assert row["epoch_micros"] == (None if want is None else (start + want * 3600) * 1e6)
    assert row["status"] == ("text_unsupported" if want is None else "decoded")


def test_level_matches(spark):
    coords = spark.createDataFrame([("c", 0, 500.0), ("c", 1, 850.0), ("c", 2, 850.0001), ("d", 0, -0.5)], "channel string, idx int, value double")
    wanted = spark.createDataFrame(
        [(1, "c", 500.000001), (2, "c", 850.0), (3, "c", 700.0), (4, "e", 1.0), (5, "d", -0.5)], "selector_id int, channel string, value double"
    )
    got = {r["selector_id"]: (r["matches"], r["status"]) for r in selection.select_level(coords, wanted, ["channel"]).collect()}
    assert got == {1: (1, "selected"), 2: (2, "ambiguous"), 3: (0, "no_match"), 4: (0, "no_axis"), 5: (1, "selected")}


def test_selector_ids_may_come_again_on_other_coordinates(spark):
    coords = spark.createDataFrame([("c", 0, 500.0), ("d", 3, 7.0), ("d", 4, 8.0)], "channel string, idx int, value double")
    wanted = spark.createDataFrame([(1, "c", 500.0), (1, "d", 7.0), (2, "c", 1.0), (2, "d", 8.0)], "selector_id int, channel string, value double")
    got = {(r["selector_id"], r["channel"]): (r["matches"], r["idx"], r["status"]) for r in selection.select_level(coords, wanted, ["channel"]).collect()}
    assert got == {(1, "c"): (1, 0, "selected"), (1, "d"): (1, 3, "selected"), (2, "c"): (0, -1, "no_match"), (2, "d"): (1, 4, "selected")}


def test_selectors_of_all_sizes_and_kinds(spark):
    """Against comparing each selector with each coordinate; a selector has two cells at most."""
    rng = np.random.default_rng(5)
    values = np.concatenate([10.0 ** rng.uniform(-12, 12, 150) * rng.choice([-1, 1], 150), [0.0, 1e-9, 1e9, -1e15]])
    near = values * (1 + rng.choice([0, 0.9e-5, -0.9e-5, 1.1e-5, 3e-5], len(values))) + rng.choice([0, 0.9e-8, -1.1e-8], len(values))
    coords = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(values)], "channel string, idx long, value double")
    wanted = spark.createDataFrame([(i, "c", float(v)) for i, v in enumerate(near)], "selector_id int, channel string, value double")
    got = {r["selector_id"]: r["matches"] for r in selection.select_level(coords, wanted, ["channel"]).collect()}
    assert got == {i: int((np.abs(values - v) <= 1e-8 + 1e-5 * abs(v)).sum()) for i, v in enumerate(near)}
    assert (np.abs(values - near) <= 1e-8 + 1e-5 * np.abs(near)).sum() > 60
    typed = spark.createDataFrame(
        [("t", 0, None, "surface"), ("t", 1, None, "850"), ("n", 0, 850.0, None), ("s", None, 2.0, None), ("u", None, None, "x")],
        "channel string, idx long, value double, text string",
    )
    asked = [("t", "850"), ("t", "850.0"), ("n", "850.0"), ("n", "surface"), ("s", "2"), ("s", "3"), ("u", "x"), ("u", "2"), ("v", "1")]
    wanted = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "selector_id int, channel string, value string")
    got = {r["selector_id"]: (r["status"], r["idx"]) for r in selection.select_level(typed, wanted, ["channel"]).collect()}
    no = lambda s: (s, -1)
    assert [got[i] for i in range(9)] == [
        ("selected", 1), no("no_match"), ("selected", 0), no("no_match"), no("scalar"), no("scalar_mismatch"), no("scalar"), no("scalar_mismatch"), no("no_axis")
    ]


def test_coordinate_modes(spark):
    axis = lambda mode: spark.createDataFrame([("t", i, v, mode) for i, v in enumerate([3.0, 1.0, 2.0])], "axis string, idx long, value double, mode string")
    order = lambda mode: [r["source_idx"] for r in grid.normalise_coordinates(axis(mode)).orderBy("idx").collect()]
    assert order("none") == order("cf_datetime") == [0, 1, 2]
    assert order("ascending") == order("cf_datetime_ascending") == [1, 2, 0]
    with pytest.raises(Exception, match="unknown coordinate mode"):
        order("descending")


def grid_of(cells, shift=0.0):
    axes = cells.sparkSession.createDataFrame(
        [(a, i, i * 1.5 + (shift if (a, i) == ("x", 2) else 0.0)) for a, n in (("sample", 20), ("y", 6), ("x", 6)) for i in range(n)],
        "axis string, idx long, value double",
    )
    return certify.Grid(cells, axes)


def test_grid_gates_in_order(spark, cells):
    cells = cells.filter("field_id <> 'c'")
    want = spark.createDataFrame([("a", 20, 6, 6), ("b", 20, 6, 6)], "field_id string, samples int, height int, width int")
    claims = cells.groupBy("field_id").count().withColumnRenamed("count", "rows")
    good = grid_of(cells)

    def statuses(first, again):
        gates = certify.grid_gates(first, again, good, want, claims, 1e-6, 0.0, 0.0)
        rows = certify.with_objective(certify.assess(spark, "c", gates), lambda: certify.grid_bytes(first)).collect()
        return [r["status"] for r in rows], rows[0]["feasible"], rows[0]["objective"]

    cell = (F.col("sample") == 3) & (F.col("y") == 5) & (F.col("x") == 1) & (F.col("field_id") == "b")
    value = lambda v: grid_of(cells.withColumn("value", F.when(cell, v).otherwise(F.col("value"))))
    bytes_ = 2 * 20 * 36 * 4 + 32 * 8
    p, f, n = "PASS", "FAIL", "NOT_ASSESSED"
    assert statuses(good, good) == ([p] * 6, True, bytes_)
    assert statuses(grid_of(cells, 0.1), good) == ([p, f, n, p, f, p], False, None)
    assert statuses(grid_of(cells.filter(~cell)), good) == ([f, n, n, p, n, f], False, None)
    assert statuses(good, grid_of(cells.filter(~cell))) == ([p, p, p, f, n, p], False, None)
    assert statuses(value(F.lit(None)), value(F.lit(float("nan")))) == ([p, p, f, p, p, p], False, None)
    assert statuses(good, value(F.lit(0.125))) == ([p, p, p, p, f, p], False, None)
    lost_axis = certify.Grid(cells, good.coords.filter("axis <> 'y'"))
    assert statuses(lost_axis, good) == ([f, n, n, p, n, p], False, None)


def test_grid_fingerprint(spark, cells):
    mark = lambda g: fingerprint.grid_fingerprint(g.cells, g.coords).first()["fingerprint"]
    good = grid_of(cells)
    assert mark(good) == mark(certify.Grid(cells.repartition(5), good.coords.repartition(3)))
    turn = lambda a, b: F.when(F.col("sample") == 0, F.col(a)).otherwise(F.col(b))
    swapped = cells.withColumns({"y": turn("x", "y"), "x": turn("y", "x")})
    typed = cells.withColumn("value", F.col("value").cast("float"))
    others = [grid_of(cells, 0.5), grid_of(swapped), grid_of(typed), grid_of(cells.filter("sample < 19"))]
    assert len({mark(g) for g in [good, *others]}) == 5
