from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldcheck.operators import ordered
from fieldcheck.operators.ordered import exact_quantiles, ranked, running


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    key = np.where(rng.random(4000) < 0.6, "hot", rng.choice(["a", "b", "c"], 4000))
    return pd.DataFrame({"key": key, "seq": rng.permutation(4000), "value": rng.integers(0, 90, 4000).astype(float)})


def test_rank_of_a_hot_key(spark, rows):
    got = ranked(spark.createDataFrame(rows), ["key"], [F.col("value").desc(), "seq"], "rank").toPandas()
    want = rows.sort_values(["value", "seq"], ascending=[False, True]).copy()
    want["rank"] = want.groupby("key").cumcount() + 1
    both = got.merge(want, on=["key", "seq"])
    assert len(both) == len(rows) and (both["rank_x"] == both["rank_y"]).all()


def test_running_sum(spark, rows):
    got = running(spark.createDataFrame(rows), ["key"], ["seq"], {"total": F.col("value")}).toPandas()
    want = rows.sort_values("seq").copy()
    want["total"] = want.groupby("key")["value"].cumsum()
    both = got.merge(want, on=["key", "seq"])
    assert np.allclose(both["total_x"], both["total_y"])


def test_quantiles_match_numpy(spark, rows):
    df = spark.createDataFrame(rows)
    got = exact_quantiles(df, ["key"], "value", {"q1": 0.25, "median": 0.5, "p90": 0.9}).toPandas().set_index("key")
    for key, part in rows.groupby("key"):
        want = np.percentile(part["value"], [25, 50, 90], method="linear")
        assert np.allclose(got.loc[key, ["q1", "median", "p90"]].astype(float), want)
        assert got.loc[key, "n"] == len(part)
    whole = exact_quantiles(df, [], "value", {"median": 0.5}).first()
    assert whole["median"] == np.median(rows["value"])


def test_missing_values_are_left_out(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (4.0,)], "value double")
    row = exact_quantiles(df, [], "value", {"median": 0.5}).first()
    assert (row["n"], row["median"]) == (2, 2.5)


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([(None, 1, 5.0), (None, 2, 7.0), ("a", 3, 1.0)], "key string, seq int, value double")
    got = {(r["key"], r["seq"]): r["rank"] for r in ranked(df, ["key"], ["seq"]).collect()}
    assert got == {(None, 1): 1, (None, 2): 2, ("a", 3): 1}
    q = {r["key"]: r["m"] for r in exact_quantiles(df, ["key"], "value", {"m": 0.5}).collect()}
    assert q == {None: 6.0, "a": 1.0}


@pytest.mark.parametrize("most", [4096, 9, 0])
def test_only_large_keys_go_through_slices(spark, monkeypatch, most):
    """All measures of a key share its rows; only values of large keys are sorted by range."""
    rng = np.random.default_rng(6)
    key = np.where(np.arange(600) < 300, -1, rng.integers(0, 60, 600))
    frame = pd.DataFrame({"key": key, "a": rng.normal(0, 1, 600), "b": rng.integers(-3, 3, 600).astype(float)})
    df = spark.createDataFrame(frame).select(
        F.when(F.col("key") != 7, F.col("key")).alias("key"),
        F.when(F.col("key") == 9, None).when(F.col("key") % 2 == 0, float("nan")).otherwise(F.col("a")).alias("a"),
        F.when(F.col("key") != 9, F.col("b")).alias("b"),
    )
    monkeypatch.setattr(ordered, "LIGHT_ROWS", most, raising=False)
    through, real = [], ordered.sliced
    monkeypatch.setattr(ordered, "sliced", lambda d, *a: through.append(d.agg(F.sum("_c")).first()[0]) or real(d, *a))
    probs = {"q1": 0.25, "median": 0.5}
    got = {r["key"]: r.asDict(recursive=True) for r in ordered.quantiles_of(df, ["key"], ["a", "b"], probs).collect()}
    counts, values = frame.groupby("key").size(), 0
    for k, part in frame.groupby("key"):
        row = got.pop(None if k == 7 else k, None)
        for name in ("a", "b"):
            gone = k == 9 or (name == "a" and k % 2 == 0)
            values += 0 if gone or counts[k] <= most else len(part)
            if gone:
                assert row is None or row[name] is None
                continue
            want = {"n": len(part), "minimum": part[name].min(), "maximum": part[name].max(), "q1": np.percentile(part[name], 25), "median": part[name].median()}
            assert row[name] == pytest.approx(want)
    assert not got and sum(through) == values


def test_medians_of_small_keys_pin_each_row_once(spark, monkeypatch):
    """Rows were a row a measure, sorted by range and kept, before."""
    from fieldcheck.operators import experiments

    def not_here(*_):
        raise AssertionError("sorted by range")

    monkeypatch.setattr(ordered, "sliced", not_here)
    df = spark.createDataFrame([(1, 2.0, None), (1, 3.0, 8.5), (2, None, None), (None, 1.0, 9.9)], "k int, a double, b double")
    got = experiments.median_objectives(df, ["k"], ["a", "b"], whole=["b"]).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 2.5, 8, 2), (None, 1.0, 9, 1)]
    spans = experiments.variation(df, ["k"], ["a", "b"]).collect()
    assert sorted(map(tuple, spans), key=str) == [(1, "a", 2.0, 2.5, 3.0, 0.4), (1, "b", 8.5, 8.5, 8.5, 0.0), (None, "a", 1.0, 1.0, 1.0, 0.0), (None, "b", 9.9, 9.9, 9.9, 0.0)]


def test_numbered_has_no_long_array(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", ordered.CHUNK), ("d", ordered.CHUNK + 1), ("e", 3 * ordered.CHUNK**2 // 2), ("f", -3)], "k string, n long")
    got = {r["k"]: (r["n"], r["lo"], r["hi"], r["c"]) for r in ordered.numbered(df, F.col("n"), "i").groupBy("k", "n").agg(
        F.min("i").alias("lo"), F.max("i").alias("hi"), F.count_distinct("i").alias("c")).collect()}
    assert set(got) == {"b", "c", "d", "e"} and all(v[1:] == (0, v[0] - 1, v[0]) for v in got.values())


def test_gaps_of_ten_million_repetitions(spark):
    from fieldcheck.operators import experiments

    n = 10_000_000
    plan = spark.createDataFrame([("big", n), ("small", 5), ("none", 0), ("unseen", 2)], "condition string, planned long")
    lost = F.col("repetition").isin(1, 4097, 5_000_000, n)
    big = spark.range(1, n + 1, numPartitions=8).select(F.lit("big").alias("condition"), F.col("id").alias("repetition")).filter(~lost)
    few = spark.createDataFrame([("small", 1), ("small", 2), ("small", 2), ("small", 3), ("small", 4), ("small", 6), ("small", 6), ("small", 0), ("none", 1), ("odd", 3), ("big", n + 1)], "condition string, repetition long")
    got = experiments.matrix_gaps(big.unionByName(few), plan).collect()
    assert sorted(tuple(r) for r in got) == sorted(
        [("big", r, "missing") for r in (1, 4097, 5_000_000, n)] + [("big", n + 1, "extra"), ("small", 5, "missing"), ("small", 2, "repeated")]
        + [("small", 6, "extra"), ("small", 0, "extra"), ("none", 1, "extra"), ("odd", 3, "extra"), ("unseen", 1, "missing"), ("unseen", 2, "missing")]
    )
