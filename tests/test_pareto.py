from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldcheck.operators import pareto
from fieldcheck.operators.pareto import Objective

SEARCH = (Objective("throughput", True, 1.0, 0.05), Objective("bytes", False, 65536.0, 0.005))

# Stored search nodes (number, samples per second, output bytes, admitted).
GOLDEN = [
    (0, 44.985339599048366, 182307091.0, True),
    (1, 54.33852261922518, 175196006.0, True),
    (2, 55.99926271340618, 161615129.0, True),
    (3, 209.71910695278441, 348881582.0, True),
    (4, 61.58475161517731, 109455072.0, True),
    (5, 91.55756160748207, 348886346.0, False),
    (6, 61.613328502656316, 115493408.0, False),
    (7, 81.51117859147547, 124939790.0, True),
    (8, 75.30366883429723, 114727843.0, True),
    (9, 197.6989843487911, 349365422.0, False),
    (10, 59.548436803020635, 107181768.0, True),
    (11, 109.05681141411637, 321818854.0, True),
    (12, 69.21363225902928, 112850201.0, True),
    (13, 116.2334346274187, 340873314.0, True),
    (14, 29.11533823592683, 107782555.0, False),
    (15, 106.93689477582983, 329835298.0, False),
    (16, 72.88957812791715, 125598712.0, False),
    (17, 140.89618781314522, 347462445.0, False),
    (18, 75.84841018077924, 113899270.0, True),
    (19, 193.26200041530905, 348881360.0, False),
    (20, 73.01492307688005, 123111991.0, False),
]
FINAL = {3, 7, 10, 11, 12, 13, 18}


@pytest.mark.parametrize("slice_rows", [4096, 3])
def test_golden_archive(spark, slice_rows):
    nodes = spark.createDataFrame([("r", n, n, a, b) for n, a, b, _ in GOLDEN], "run_id string, node_id long, seq long, throughput double, bytes double")
    got = {r["node_id"]: r for r in pareto.pareto_archive(nodes, SEARCH, slice_rows).collect()}
    assert [got[n]["admitted"] for n, *_ in GOLDEN] == [flag for *_, flag in GOLDEN]
    assert {n for n, r in got.items() if r["in_archive"]} == FINAL


def relation(new, old, objectives):
    better = worse = False
    for n, o, s in zip(new, old, objectives):
        gain, floor = (n - o) * s.sign, max(s.absolute, abs(o) * s.relative)
        better, worse = better or gain > floor, worse or gain < -floor
    return {(True, False): "dominates", (False, True): "dominated", (True, True): "tradeoff", (False, False): "equivalent"}[(better, worse)]


def brute_fronts(points, objectives):
    left, fronts, n = dict(points), {}, 0
    while left:
        n += 1
        front = [i for i, p in left.items() if not any(j != i and relation(q, p, objectives) == "dominates" for j, q in left.items())]
        assert front
        for i in front:
            fronts[i] = n
            del left[i]
    return fronts


def brute_archive(points, objectives):
    held, admitted = {}, {}
    for i, p in points.items():
        seen = {j: relation(p, q, objectives) for j, q in held.items()}
        admitted[i] = not any(r in ("dominated", "equivalent") for r in seen.values())
        if admitted[i]:
            held = {j: q for j, q in held.items() if seen[j] != "dominates"} | {i: p}
    return admitted, set(held)


OBJ3 = (Objective("a", True, 0.3, 0.02), Objective("b", False, 0.2, 0.05), Objective("c", True, 0.1, 0.0))


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    frame = pd.DataFrame(rng.uniform(1, 9, (70, 3)).round(1), columns=["a", "b", "c"])
    frame.insert(0, "seq", np.arange(70))
    frame.insert(0, "node_id", np.arange(70))
    frame.insert(0, "run_id", np.where(np.arange(70) < 50, "hot", "cold"))
    return frame


def per_run(cloud, fn):
    for _, part in cloud.groupby("run_id"):
        yield fn({int(r.node_id): (r.a, r.b, r.c) for r in part.itertuples()}, OBJ3)


@pytest.mark.parametrize("slice_rows", [4096, 9])
def test_fronts_match_brute_force(spark, cloud, slice_rows):
    got = {r["node_id"]: r["front"] for r in pareto.pareto_fronts(spark.createDataFrame(cloud), OBJ3, slice_rows).collect()}
    want = {}
    for fronts in per_run(cloud, brute_fronts):
        want |= fronts
    assert got == want
    first = {r["node_id"] for r in pareto.first_front(spark.createDataFrame(cloud), OBJ3).collect()}
    assert first == {n for n, f in want.items() if f == 1}


@pytest.mark.parametrize("slice_rows", [4096, 8])
def test_archive_matches_brute_force(spark, cloud, slice_rows):
    got = pareto.pareto_archive(spark.createDataFrame(cloud), OBJ3, slice_rows).toPandas().set_index("node_id")
    admitted, held = {}, set()
    for a, h in per_run(cloud, brute_archive):
        admitted |= a
        held |= h
    assert got["admitted"].to_dict() == admitted
    assert set(got.index[got["in_archive"]]) == held


def test_seeds_match_brute_force(spark, cloud):
    hot = cloud[cloud.run_id == "hot"]
    points = {int(r.node_id): np.array([r.a, r.b, r.c]) for r in hot.itertuples()}
    fronts = brute_fronts({k: tuple(v) for k, v in points.items()}, OBJ3)
    ranked = sorted(points, key=lambda i: (fronts[i], i))
    scale = np.maximum(np.ptp(np.array(list(points.values())), axis=0), 1e-12)
    chosen = [7]
    while len(chosen) < 5:
        rest = [i for i in ranked if i not in chosen]
        near = lambda i: min((np.abs(points[i] - points[c]) / scale).sum() for c in chosen)
        chosen.append(max(rest, key=lambda i: (near(i), -ranked.index(i))))
    df = spark.createDataFrame(hot)
    layers = spark.createDataFrame([("hot", k, v) for k, v in fronts.items()], "run_id string, node_id long, front long")
    first = df.filter("node_id = 7").select("run_id", "node_id")
    got = pareto.branch_seeds(df, layers, first, OBJ3, 5).orderBy("step").collect()
    assert [r["node_id"] for r in got] == chosen


@pytest.mark.parametrize(
    "new, want",
    [((12.0, 100.0), "dominates"), ((10.4, 100.0), "equivalent"), ((8.0, 100.0), "dominated"), ((12.0, 120.0), "tradeoff")],
)
def test_relation_and_noise_floor(spark, new, want):
    obj = (Objective("x", True, 0.5, 0.0), Objective("y", False, 1.0, 0.01))
    rows = spark.createDataFrame([(0, 0, 10.0, 100.0), (1, 0, *new)], "node_id long, parent_id long, x double, y double")
    assert pareto.parent_relations(rows, obj).first()["relation"] == want


def test_focus_schedule_is_the_weighted_round_robin(spark):
    quota = {"throughput": 5, "footprint": 1, "joint": 2}
    left, want = dict(quota), []
    while any(left.values()):
        for name in ("throughput", "footprint", "throughput", "joint"):
            if left[name]:
                want.append(name)
                left[name] -= 1
    df = spark.createDataFrame([("r", *quota.values())], "run_id string, throughput long, footprint long, joint long")
    got = pareto.focus_schedule(df).orderBy("iteration").collect()
    assert [r["focus"] for r in got] == want and [r["iteration"] for r in got] == list(range(1, 9))


def test_objective_cycle(spark):
    got = pareto.objective_cycle(spark.range(1, 6).select(F.col("id").alias("iteration")), ["a", "b"]).orderBy("iteration")
    assert [r["targets"] for r in got.collect()] == ["a", "b", "a", "b", "a"]


def test_fronts_take_a_round_a_slice_and_copies_none(spark, monkeypatch):
    """Slices send once, in the order of their noise-scaled sums; sixty copies of a node are one row."""
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"run_id": "hot", "node_id": np.arange(240), "a": rng.normal(5, 1, 240), "b": rng.normal(5, 1, 240)})
    two = (Objective("a", True, 0.2, 0.0), Objective("b", False, 0.2, 0.0))
    want = brute_fronts({int(r.node_id): (r.a, r.b) for r in frame.itertuples()}, two)
    kept = []
    real = pareto.pinned
    monkeypatch.setattr(pareto, "pinned", lambda df: kept.append(1) or real(df))
    fronts = lambda df, n: {r["node_id"]: r["front"] for r in pareto.pareto_fronts(spark.createDataFrame(df), two, n).collect()}
    assert fronts(frame, 40) == want
    assert len(kept) <= 3 + 2 * 7 + 1
    kept.clear()
    many = pd.concat([frame.assign(node_id=frame.node_id + 1000 * i) for i in range(60)])
    assert fronts(many, 4096) == {k + 1000 * i: f for k, f in want.items() for i in range(60)}
    assert len(kept) <= 3


def test_thousands_of_nodes_take_no_rounds(spark, monkeypatch):
    """Each round leaves plans and classes with the driver; a slice holds what took two of them, and no pairs."""
    import tracemalloc

    rng = np.random.default_rng(7)
    frame = pd.DataFrame({"run_id": "hot", "node_id": np.arange(4500), "a": rng.normal(5, 1, 4500), "b": rng.normal(5, 1, 4500)})
    two = (Objective("a", True, 0.2, 0.01), Objective("b", False, 0.2, 0.0))
    kept = []
    real = pareto.pinned
    monkeypatch.setattr(pareto, "pinned", lambda df: kept.append(1) or real(df))
    fronts = lambda *n: {r["node_id"]: r["front"] for r in pareto.pareto_fronts(spark.createDataFrame(frame), two, *n).collect()}
    got = fronts()
    assert len(kept) == 3
    assert got == fronts(2000) and len(kept) > 6
    tracemalloc.start()
    solved = pareto._solved(two)((), frame.assign(front=0, _moved=False, _bound=0))
    assert tracemalloc.get_traced_memory()[1] < 4500**2
    tracemalloc.stop()
    assert dict(zip(solved["node_id"], solved["front"], strict=True)) == got


def test_floors_that_do_not_order_are_refused():
    """Three nodes that dominate each other in a ring, and one that is free."""
    three = tuple(Objective(n, True, 1.0, 0.0) for n in "abc")
    ring = pd.DataFrame([(0.0, 0.0, 0.0), (1.2, -0.9, -0.9), (0.3, 0.3, -1.8), (9.0, 9.0, 9.0)], columns=list("abc"))
    with pytest.raises(RuntimeError, match="free of dominators"):
        pareto._solved(three)((), ring.assign(run_id="r", node_id=range(4), front=0, _moved=False, _bound=0))
