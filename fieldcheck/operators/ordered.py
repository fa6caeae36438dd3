"""Ordered jobs (ranks, running sums, exact quantiles) that never put one group in one task.

A plain window sends a whole partition key to one task. Here rows are range partitioned on
(keys, order), so a hot key is spread over as many slices as its rows need. Each slice is
scanned alone and the totals of the slices before it, one small row per (key, slice), are
added afterwards. Quantiles of keys that have few rows need no slices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcheck.session import pinned

SLICE = "_slice"

#: Rows up to which the values of a key are held as lists.
LIGHT_ROWS = 4096

#: Numbers that one row is expanded to at a time.
CHUNK = 4096


def chunked(df: DataFrame, size: Column, name: str) -> DataFrame:
    """A row for each CHUNK numbers of 0 .. size - 1, numbered in `name`; no array is longer than CHUNK below CHUNK ** 3."""
    last = F.floor((size.cast("long") - 1) / CHUNK)
    up = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / CHUNK)))
    rows = df.filter(size > 0).withColumn("_last", last).withColumn("_up", up)
    inner = F.sequence(F.lit(0).cast("long"), F.least(F.lit(CHUNK - 1).cast("long"), F.col("_last") - F.col("_up") * CHUNK))
    return rows.withColumn(name, F.explode(inner)).withColumn(name, F.col("_up") * CHUNK + F.col(name)).drop("_last", "_up")


def numbered(df: DataFrame, size: Column, name: str) -> DataFrame:
    """A row for each number 0 .. size - 1, without an array of that length."""
    rows = chunked(df.withColumn("_size", size.cast("long")), F.col("_size"), "_chunk")
    first = F.col("_chunk") * CHUNK
    return rows.withColumn(name, F.explode(F.sequence(first, F.least(first + CHUNK, F.col("_size")) - 1))).drop("_size", "_chunk")


def _name(order: Column | str) -> Column:
    return F.col(order) if isinstance(order, str) else order


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Range partitioned rows with their slice number, pinned so the numbers cannot change."""
    by = [F.col(k) for k in keys] + [_name(o) for o in order]
    return pinned(df.repartitionByRange(*by).withColumn(SLICE, F.spark_partition_id()))


def join_slices(rows: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the columns of the one row per (key, slice) to the rows of that slice; null is a key too."""
    on = [*keys, SLICE]
    right = spans.withColumnsRenamed({k: f"_j_{k}" for k in on})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in on])
    return rows.join(right, same).drop(*[f"_j_{k}" for k in on])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    sums: Mapping[str, Column],
) -> DataFrame:
    """Inclusive running sums per key in the given total order."""
    cut = sliced(df, keys, order)
    totals = cut.groupBy(*keys, SLICE).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *keys,
        SLICE,
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums],
    )
    here = (
        Window.partitionBy(*keys, SLICE)
        .orderBy(*[_name(o) for o in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    scanned = cut.select("*", *[F.sum(c).over(here).alias(f"_r_{n}") for n, c in sums.items()])
    joined = join_slices(scanned, before, keys)
    return joined.select(
        *df.columns, *[(F.col(f"_b_{n}") + F.col(f"_r_{n}")).alias(n) for n in sums]
    )


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rank"
) -> DataFrame:
    """1-based row number per key; `order` must be total for a repeatable result."""
    return running(df, keys, order, {name: F.lit(1).cast("long")})


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Exact linear-interpolated quantiles per key, plus `n`, `minimum` and `maximum`; keys without values are left out."""
    if not keys:
        whole = exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs)
        return whole.drop("_all")
    return quantiles_of(df, keys, [value], probs).filter(F.col(value).isNotNull()).select(*keys, f"{value}.*")


def quantiles_of(df: DataFrame, keys: Sequence[str], values: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """A row per key with a struct for each of `values`: `n`, `minimum`, `maximum` and the exact quantiles, or null.

    Missing values are left out. Nearly all keys have few rows: their values are sorted lists of LIGHT_ROWS numbers at
    most, after one shuffle. Rows of larger keys are only counted there and go through slices, which no key can fill.
    """
    there = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") + 0.0).alias(c) for c in values}
    rows = pinned(df.select(*keys, *there.values()))
    large = pinned(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > LIGHT_ROWS).drop("_rows"))
    if large.isEmpty():
        return _listed_quantiles(rows, keys, values, probs)
    right = large.withColumnsRenamed({k: f"_j_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in keys])
    light = _listed_quantiles(rows.join(right, same, "left_anti"), keys, values, probs)
    long = rows.join(right, same, "left_semi").unpivot(list(keys), list(values), "_of", "_value")
    cut = _sliced_quantiles(long, [*keys, "_of"], "_value", probs)
    found = F.struct("n", "minimum", "maximum", *probs)
    return light.unionByName(cut.groupBy(*keys).agg(*[F.max(F.when(F.col("_of") == c, found)).alias(c) for c in values]))


def _listed_quantiles(df: DataFrame, keys: Sequence[str], values: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """`quantiles_of` for keys whose values fit into a list."""
    lists = df.groupBy(*keys).agg(*[F.sort_array(F.collect_list(c)).alias(c) for c in values])
    out = []
    for c in values:
        n = F.size(c)
        at = lambda pos, c=c: F.get(F.col(c), pos.cast("int"))
        found = []
        for name, p in probs.items():
            pos = F.lit(float(p)) * (n - 1)
            lo, hi = at(F.floor(pos)), at(F.ceil(pos))
            found.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
        ends = (n.cast("long").alias("n"), at(F.lit(0)).alias("minimum"), at(n - 1).alias("maximum"))
        out.append(F.when(n > 0, F.struct(*ends, *found)).alias(c))
    return lists.select(*keys, *out)


def _sliced_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Quantiles of keys of any size; a key without values has no row.

    Rows are first folded to (key, value, count), so repeated values cost one row; the running
    count then finds the two order statistics around each position.
    """
    folded = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    cut = sliced(folded, keys, ["_v"])
    totals = cut.groupBy(*keys, SLICE).agg(F.sum("_c").alias("_t"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    every = Window.partitionBy(*keys)
    earlier = every.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    spans = totals.select(
        *keys,
        SLICE,
        F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_t").over(every).alias("n"),
        F.min("_min").over(every).alias("minimum"),
        F.max("_max").over(every).alias("maximum"),
    )
    here = Window.partitionBy(*keys, SLICE).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = join_slices(cut, spans, keys).withColumn("_upto", F.col("_before") + F.sum("_c").over(here))
    picks = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n") - 1)
        picks += [
            F.min(F.when(F.col("_upto") > F.floor(pos), F.col("_v"))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_upto") > F.ceil(pos), F.col("_v"))).alias(f"_hi_{name}"),
        ]
    found = both.groupBy(*keys, "n", "minimum", "maximum").agg(*picks)
    out = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return found.select(*keys, "n", "minimum", "maximum", *out)
