"""Comparison of a candidate table with its independent reference.

Both sides are stacked and folded once per key, so a key that one side repeats a billion times is
combined before the shuffle; no join ever multiplies copies. Tolerance is relative to the
reference value, missing means null, NaN or a listed marker.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcheck.functions.columns import finite, isclose, missing

CANDIDATE, REFERENCE = 1, 2


def diff_values(
    candidate: DataFrame,
    reference: DataFrame,
    keys: Sequence[str],
    atol: float = 0.0,
    rtol: float = 0.0,
    policy: DataFrame | None = None,
    policy_key: str | None = None,
    markers: Sequence[float] = (),
    equal_missing: bool = True,
) -> DataFrame:
    """One row per key with both values, the error and a status.

    Status is match, missing_key, extra_key, repeated_key, missingness or value. Of a repeated key the
    largest value of each side stands in the row, and the error is between these two. `policy` rows
    (policy_key, atol, rtol, equal_missing) override the defaults for their channel.
    """
    side = lambda df, n: df.select(*keys, F.col("value").cast("double").alias("_v"), F.lit(n).alias("_s"))
    both = side(candidate, CANDIDATE).unionByName(side(reference, REFERENCE))
    gone = missing(F.col("_v"), markers)
    mine = F.col("_s") == CANDIDATE
    there = F.when(~gone, F.col("_v"))
    folded = both.groupBy(*keys).agg(
        F.count_if(mine).alias("_nc"),
        F.count_if(~mine).alias("_nr"),
        F.count_if(mine & gone).alias("_gc"),
        F.count_if(~mine & gone).alias("_gr"),
        F.max(F.when(mine, there)).alias("candidate"),
        F.max(F.when(~mine, there)).alias("reference"),
    )
    folded = with_policy(folded, policy, policy_key, atol, rtol, equal_missing)
    cand, ref = F.col("candidate"), F.col("reference")
    inside = isclose(cand, ref, F.col("_atol"), F.col("_rtol"))
    status = (
        F.when(F.col("_nc") == 0, "missing_key")
        .when(F.col("_nr") == 0, "extra_key")
        .when((F.col("_nc") > 1) | (F.col("_nr") > 1), "repeated_key")
        .when(F.col("_gc") != F.col("_gr"), "missingness")
        .when(F.col("_gc") > 0, F.when(F.col("_same"), "match").otherwise("missingness"))
        .when(inside, "match")
        .otherwise("value")
    )
    error = F.when(cand == ref, 0.0).otherwise(F.abs(cand - ref))
    return folded.select(
        *keys,
        F.col("_nc").alias("candidate_rows"),
        F.col("_nr").alias("reference_rows"),
        "candidate",
        "reference",
        error.alias("abs_error"),
        status.alias("status"),
    )


def with_policy(
    df: DataFrame, policy: DataFrame | None, key: str | None, atol: float, rtol: float, equal_missing: bool
) -> DataFrame:
    default = (F.lit(float(atol)), F.lit(float(rtol)), F.lit(bool(equal_missing)))
    if policy is None:
        return df.select("*", *[c.alias(n) for c, n in zip(default, ("_atol", "_rtol", "_same"))])
    rows = policy.select(
        key, F.col("atol").alias("_pa"), F.col("rtol").alias("_pr"), F.col("equal_missing").alias("_pe")
    )
    given = ("_pa", "_pr", "_pe")
    return df.join(rows, key, "left").select(
        *df.columns,
        *[F.coalesce(F.col(g), d).alias(n) for g, d, n in zip(given, default, ("_atol", "_rtol", "_same"))],
    )


def relative_error(diff: Column, reference: Column) -> Column:
    """abs / |reference|; 0 for 0/0, infinite when only the reference is zero, null where a side has no value."""
    inf = F.lit(float("inf"))
    return F.when(reference == 0, F.when(diff == 0, 0.0).when(diff > 0, inf)).otherwise(diff / F.abs(reference))


def mismatch_summary(diff: DataFrame, channel: str | None = None) -> DataFrame:
    """Counts and largest finite errors, for the whole diff or per channel."""
    rel = relative_error(F.col("abs_error"), F.col("reference"))
    by = [channel] if channel else []
    count = lambda s: F.count_if(F.col("status") == s)
    return diff.withColumn("_rel", rel).groupBy(*by).agg(
        F.count(F.lit(1)).alias("keys_compared"),
        F.count_if(F.col("status") != "match").alias("mismatches"),
        count("missing_key").alias("missing_keys"),
        count("extra_key").alias("extra_keys"),
        count("repeated_key").alias("repeated_keys"),
        count("missingness").alias("missingness_mismatches"),
        count("value").alias("value_mismatches"),
        F.max(F.when(finite(F.col("abs_error")), F.col("abs_error"))).alias("max_abs_error"),
        F.max(F.when(finite(F.col("_rel")), F.col("_rel"))).alias("max_rel_error"),
        F.count_if(F.col("_rel") == float("inf")).alias("infinite_relative"),
    )


def mismatch_examples(diff: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First n mismatches in key order; a top-n, so nothing is sorted as a whole."""
    return (
        diff.filter(F.col("status") != "match")
        .select(*order, "status", "candidate", "reference")
        .orderBy(*order)
        .limit(n)
    )


def diff_coordinates(candidate: DataFrame, reference: DataFrame, atol: float) -> DataFrame:
    """Per axis: both lengths and the first index whose values differ by more than atol."""
    side = lambda df, n: df.select("axis", "idx", F.col("value").alias("_v"), F.lit(n).alias("_s"))
    both = side(candidate, CANDIDATE).unionByName(side(reference, REFERENCE))
    mine = F.col("_s") == CANDIDATE
    at = both.groupBy("axis", "idx").agg(
        F.max(F.when(mine, F.col("_v"))).alias("_c"),
        F.max(F.when(~mine, F.col("_v"))).alias("_r"),
        F.count_if(mine).alias("_nc"),
        F.count_if(~mine).alias("_nr"),
    )
    near = isclose(F.col("_c"), F.col("_r"), F.lit(float(atol)), F.lit(0.0))
    off = F.when(~F.coalesce(near, F.lit(False)), F.col("idx"))
    return (
        at.groupBy("axis")
        .agg(
            F.sum("_nc").alias("candidate_length"),
            F.sum("_nr").alias("reference_length"),
            F.min(off).alias("_first"),
            F.count(off).alias("differing"),
        )
        .select(
            "axis",
            "candidate_length",
            "reference_length",
            (F.col("candidate_length") == F.col("reference_length")).alias("same_shape"),
            F.coalesce("_first", F.lit(-1)).alias("first_mismatch"),
            "differing",
        )
    )


def changed_hashes(
    before: DataFrame, after: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Names whose recorded columns differ: missing, extra or changed. Equal names are left out."""
    b = before.select(*keys, F.struct(*columns).alias("_b"))
    a = after.select(*keys, F.struct(*columns).alias("_a"))
    state = (
        F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "extra").otherwise("changed")
    )
    both = b.join(a, list(keys), "full_outer")
    return both.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys, state.alias("change"))


def property_mismatches(
    observed: DataFrame, expected: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Long list (keys, property, expected, observed) of declared properties that do not hold.

    Both sides are turned to one row per property. Text 'nan' equals NaN; undeclared (null)
    expectations are not checked.
    """
    text = lambda df, out: df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), "property", out
    )
    e = text(expected, "expected").filter(F.col("expected").isNotNull())
    o = text(observed, "observed")
    same = F.lower("observed").eqNullSafe(F.lower("expected")) & (F.lower("expected") == "nan")
    return (
        e.join(o, [*keys, "property"], "left")
        .filter(~(F.col("observed").eqNullSafe(F.col("expected")) | same))
        .select(*keys, "property", "expected", F.coalesce("observed", F.lit("absent")).alias("observed"))
    )


def check_metadata(
    observed: DataFrame, expected: DataFrame, keys: Sequence[str], columns: Sequence[str], policy: Sequence[str] = ()
) -> DataFrame:
    """property_mismatches with the class of each: output_policy for properties that the public policy demands, else metadata."""
    demanded = F.col("property").isin(*policy) if policy else F.lit(False)
    found = property_mismatches(observed, expected, keys, columns)
    return found.withColumn("class", F.when(demanded, "output_policy").otherwise("metadata"))


def policy_conflicts(declared: DataFrame, policy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Declarations (keys, property, expected) that contradict policy(property, expected); null declares nothing."""
    wanted = policy.select("property", F.col("expected").alias("demanded"))
    return declared.filter(F.col("expected").isNotNull()).join(wanted, "property").filter(
        ~F.col("expected").eqNullSafe(F.col("demanded"))
    ).select(*keys, "property", "expected", "demanded")


def mismatch_names(mismatches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mismatching property names per row key; a key has at most one row per declared property."""
    return mismatches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("mismatch_count"),
        F.concat_ws(",", F.sort_array(F.collect_set("property"))).alias("mismatches"),
    )


def id_set_diff(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ids on one side only: missing or extra. Copies fold before the shuffle."""
    side = lambda df, n: df.select(*keys, F.lit(n).alias("_s"))
    folded = side(expected, 1).unionByName(side(observed, 2)).groupBy(*keys).agg(
        F.max(F.col("_s") == 1).alias("_e"), F.max(F.col("_s") == 2).alias("_o")
    )
    return folded.filter(F.col("_e") != F.col("_o")).select(
        *keys, F.when(F.col("_e"), "missing").otherwise("extra").alias("difference")
    )
