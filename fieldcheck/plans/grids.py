"""Grid, coordinate and tensor queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcheck.functions.columns import missing
from fieldcheck.operators import diff, grid, selection
from fieldcheck.operators.ordered import ranked
from fieldcheck.plans.registry import Tables, query
from fieldcheck.sinks.writers import scratch, write_grid_blocks

HEIGHT = WIDTH = 4
CHANNELS = ("ch0", "ch1", "ch2", "ch3")
SAMPLES = 100


@query("sample_limit", f"SELECT * FROM grid WHERE sample < {SAMPLES}")
def sample_limit(t: Tables) -> DataFrame:
    return grid.limit_samples(t.grid(), SAMPLES)


DRAW = "CAST('0x' || substr(md5(sample || ':7:{salt}'), 1, 15) AS BIGINT) % {bound}"
PATCH = """SELECT field_id, sample, y - top AS y, x - "left" AS x, value, top, "left" FROM placed
       WHERE y >= top AND y < top + 2 AND x >= "left" AND x < "left" + 2"""


@query(
    "patch_aligned",
    f"""WITH placed AS (SELECT *, 2 * ({DRAW.format(salt="top", bound=(HEIGHT - 2) // 2 + 1)}) AS top,
         2 * ({DRAW.format(salt="left", bound=(WIDTH - 2) // 2 + 1)}) AS "left" FROM grid) {PATCH}""",
)
def patch_aligned(t: Tables) -> DataFrame:
    return grid.patches(t.grid(), HEIGHT, WIDTH, 2, "chunk_aligned", seed=7, chunk=2)


@query(
    "patch_misaligned",
    f"""WITH drawn AS (SELECT *, {DRAW.format(salt="top", bound=HEIGHT - 1)} AS t, {DRAW.format(salt="left", bound=WIDTH - 1)} AS l FROM grid),
       placed AS (SELECT * EXCLUDE (t, l), CASE WHEN t % 2 = 0 AND l % 2 = 0 AND l >= {WIDTH - 2} AND t < {HEIGHT - 2} THEN t + 1 ELSE t END AS top,
         CASE WHEN t % 2 = 0 AND l % 2 = 0 AND l < {WIDTH - 2} THEN l + 1 ELSE l END AS "left" FROM drawn) {PATCH}""",
)
def patch_misaligned(t: Tables) -> DataFrame:
    return grid.patches(t.grid(), HEIGHT, WIDTH, 2, "misaligned", seed=7, chunk=2)


NORMAL = """
normal AS (SELECT axis, row_number() OVER (PARTITION BY axis ORDER BY v, idx) - 1 AS idx, idx AS source_idx, v AS value
           FROM (SELECT axis, idx, CASE mode WHEN 'ascending' THEN value ELSE (value % 360 + 360) % 360 END AS v FROM axes))"""


@query("coord_normalise", f"WITH {NORMAL} SELECT axis, idx, source_idx, value FROM normal")
def coord_normalise(t: Tables) -> DataFrame:
    return grid.normalise_coordinates(t.axes())


#: The days with orders of each month, as the axis of that month; some times cannot be read.
DAYS = """
days AS (SELECT axis, row_number() OVER (PARTITION BY axis ORDER BY day) - 1 AS idx, CASE WHEN day = DATE '1995-05-05' THEN NULL ELSE epoch_us(CAST(day AS TIMESTAMP)) END AS us
         FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS axis, CAST(o_orderdate AS DATE) AS day FROM orders))"""


def month_days(t: Tables) -> DataFrame:
    day = t.read("orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    placed = ranked(day.withColumn("axis", F.date_format("day", "yyyy-MM")), ["axis"], ["day"], "rank")
    kind = F.dayofmonth("day") % 3
    times = placed.select(
        "axis",
        (F.col("rank") - 1).alias("idx"),
        F.when(kind == 0, F.datediff("day", F.lit("1990-01-01").cast("date"))).cast("double").alias("value"),
        F.lit("days since 1990-01-01").alias("units"),
        F.lit("standard").alias("calendar"),
        F.when(kind == 1, F.date_format("day", "yyyy-MM-dd")).alias("iso"),
        F.when((kind == 2) & (F.col("day") != "1995-05-05"), F.col("day").cast("timestamp")).alias("native"),
    )
    return grid.decode_cf(times).select("axis", "idx", F.lit(None).cast("double").alias("value"), "epoch_micros")


@query(
    "coord_validate",
    f"""WITH {NORMAL}, {DAYS}, d AS (SELECT *, lead(value) OVER (PARTITION BY axis ORDER BY idx) - value AS step FROM normal)
        SELECT axis, count(*) AS length, count(*) FILTER (value IS NULL) AS not_finite, count(*) - count(DISTINCT value) AS duplicates,
               coalesce(min(step) > 0, true) AS monotonic_ok,
               coalesce(min(abs(step)) = s.e AND max(abs(step)) = s.e, true) AS step_ok,
               axis NOT LIKE 'lon_M%' AS dtype_ok, axis <> 'lon_BUILDING' AS fill_ok, axis NOT LIKE 'lon_H%' AS metadata_ok, axis <> 'time' AS policy_ok
        FROM d, LATERAL (SELECT CASE WHEN axis = 'time' THEN 86400.0 ELSE 0.25 END AS e) s GROUP BY axis, s.e
        UNION ALL SELECT axis, count(*), count(*) FILTER (us IS NULL), count(*) - count(DISTINCT coalesce(us, -1)), coalesce(bool_and(nxt > us), true), coalesce(min(abs(nxt - us)) = 86400000000 AND max(abs(nxt - us)) = 86400000000, true), true, true, true, true
        FROM (SELECT *, lead(us) OVER (PARTITION BY axis ORDER BY idx) AS nxt FROM days) GROUP BY axis""",
)
def coord_validate(t: Tables) -> DataFrame:
    """Numeric axes with their declarations, and one time axis a month whose times are of three kinds."""
    axes = grid.normalise_coordinates(t.axes()).select("axis", "idx", "value", F.lit(None).cast("long").alias("epoch_micros"))
    axis = F.col("axis")
    time = axis == "time"
    spec = axes.select("axis").distinct().select(
        "axis",
        F.lit("increasing").alias("monotonic"),
        F.when(time, 86400.0).otherwise(0.25).alias("expected_step"),
        F.lit(None).cast("double").alias("expected_step_seconds"),
        F.when(axis.startswith("lon_M"), "float32").otherwise("float64").alias("expected_dtype"),
        F.when(axis == "lon_BUILDING", "0").otherwise("nan").alias("expected_fill"),
        F.create_map(F.lit("units"), F.when(axis.startswith("lon_H"), "metre").otherwise("degree"), F.lit("calendar"), F.lit("standard")).alias("metadata"),
        F.lit("float64").alias("dtype"),
        F.lit("NaN").alias("fill"),
        F.create_map(F.lit("units"), F.lit("degree"), F.lit("calendar"), F.when(time, "noleap").otherwise("standard")).alias("attrs"),
    )
    days = month_days(t)
    steps = days.select("axis").distinct().select("axis", F.lit("increasing").alias("monotonic"), F.lit(86400.0).alias("expected_step_seconds"))
    return grid.validate_coordinates(axes.unionByName(days), spec.unionByName(steps, allowMissingColumns=True), ["calendar"])


@query(
    "cf_decode",
    """WITH x AS (SELECT o_orderkey, o_totalprice / 7 AS value, o_orderpriority AS p FROM orders),
       u AS (SELECT *, CASE p WHEN '1-URGENT' THEN 'seconds since 1970-01-01 00:00:00' WHEN '2-HIGH' THEN 'hours since 1900-01-01'
               WHEN '3-MEDIUM' THEN 'Minutes since 2000-01-01T06:00:00' WHEN '4-NOT SPECIFIED' THEN 'days since 1990-03-01' ELSE 'furlongs' END AS units,
               o_orderkey % 10 = 4 AS is_text, o_orderkey % 10 = 7 AS is_native, o_orderkey % 100 = 34 AS is_bad, CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400) AS ts FROM x JOIN orders USING (o_orderkey))
       SELECT o_orderkey, units, CASE WHEN is_native THEN 'decoded' WHEN is_bad THEN 'text_unsupported' WHEN is_text THEN 'decoded' WHEN o_orderkey % 1000 >= 990 THEN 'calendar_unsupported' WHEN units = 'furlongs' THEN 'units_unsupported' ELSE 'decoded' END AS status,
         CASE WHEN is_bad THEN NULL WHEN is_text OR is_native THEN epoch_us(ts) WHEN o_orderkey % 1000 < 990 THEN CASE p
           WHEN '1-URGENT' THEN CAST(round_even(value * 1e6, 0) AS BIGINT)
           WHEN '2-HIGH' THEN epoch_us(TIMESTAMP '1900-01-01') + CAST(round_even(value * 3600.0::DOUBLE * 1e6, 0) AS BIGINT)
           WHEN '3-MEDIUM' THEN epoch_us(TIMESTAMP '2000-01-01 06:00:00') + CAST(round_even(value * 60.0::DOUBLE * 1e6, 0) AS BIGINT)
           WHEN '4-NOT SPECIFIED' THEN epoch_us(TIMESTAMP '1990-03-01') + CAST(round_even(value * 86400.0::DOUBLE * 1e6, 0) AS BIGINT) END END AS epoch_micros
       FROM u""",
)
def cf_decode(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    units = (
        F.when(p == "1-URGENT", "seconds since 1970-01-01 00:00:00")
        .when(p == "2-HIGH", "hours since 1900-01-01")
        .when(p == "3-MEDIUM", "Minutes since 2000-01-01T06:00:00")
        .when(p == "4-NOT SPECIFIED", "days since 1990-03-01")
        .otherwise("furlongs")
    )
    odd = F.col("o_orderkey") % 1000 >= 990
    key = F.col("o_orderkey")
    instant = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + key % 86400 * 1000000)
    iso = F.when(key % 100 == 34, "in spring").otherwise(F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss"))
    times = t.read("orders").select(
        "o_orderkey",
        (F.col("o_totalprice") / 7).alias("value"),
        units.alias("units"),
        F.when(odd, "360_day").otherwise("standard").alias("calendar"),
        F.when(key % 10 == 4, iso).alias("iso"),
        F.when(key % 10 == 7, instant).alias("native"),
    )
    return grid.decode_cf(times).select("o_orderkey", "units", "status", "epoch_micros")


@query(
    "cf_pick",
    """WITH a AS (SELECT o_custkey AS store, 'coords/' || o_orderkey AS path, o_orderpriority = '1-URGENT' AS declared,
                    o_orderstatus = 'F' AND o_totalprice > 250000 AS cf, o_orderkey % 9 = 0 AS off FROM orders),
       g AS (SELECT store, bool_or(declared AND off) AS astray, max(path) FILTER (declared) AS own, count(*) FILTER (declared AND cf) AS own_cf,
               count(*) FILTER (NOT declared AND cf AND NOT off) AS candidates, min(path) FILTER (NOT declared AND cf AND NOT off) AS other FROM a GROUP BY 1)
       SELECT store, candidates, CASE WHEN astray THEN 'not_on_sample' WHEN own_cf = 0 AND candidates > 1 THEN 'ambiguous' WHEN own_cf = 0 AND candidates = 1 THEN other ELSE own END AS coordinate FROM g""",
)
def cf_pick(t: Tables) -> DataFrame:
    cf = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 250000)
    arrays = t.read("orders").select(
        F.col("o_custkey").alias("store"),
        F.concat(F.lit("coords/"), "o_orderkey").alias("path"),
        F.when(F.col("o_orderkey") % 9 == 0, "y,x").otherwise("sample").alias("dims"),
        F.lit("double").alias("dtype"),
        F.when(cf, "hours since 1900-01-01").otherwise("m").alias("units"),
        F.lit(None).cast("string").alias("standard_name"),
        (F.col("o_orderpriority") == "1-URGENT").alias("declared"),
    )
    return grid.pick_cf_coordinate(arrays)


@query(
    "missing_mask",
    """SELECT field_id, count(*) FILTER (value IS NULL OR value IN (0.3, 12.31)) AS missing, count(*) AS row_count FROM obs_cand GROUP BY 1""",
)
def missing_mask(t: Tables) -> DataFrame:
    return t.obs_cand().groupBy("field_id").agg(
        F.count_if(missing(F.col("value"), (0.3, 12.31))).alias("missing"), F.count(F.lit(1)).alias("row_count")
    )


def orders_of(t: Tables) -> DataFrame:
    """Coordinates of the stand-in grid: rows run north to south, columns from -180 to 90 degrees."""
    g = t.grid()
    y = g.select(F.lit("y").alias("axis"), F.col("y").cast("long").alias("idx")).distinct()
    x = g.select(F.lit("x").alias("axis"), F.col("x").cast("long").alias("idx")).distinct()
    coords = y.select(
        "axis", "idx", (F.col("idx") * -30.0 + 45.0).alias("value"), F.lit("ascending").alias("mode")
    ).unionByName(
        x.select("axis", "idx", (F.col("idx") * 90.0 - 180.0).alias("value"), F.lit("longitude_modulo_360").alias("mode"))
    )
    return grid.normalise_coordinates(coords)


@query("grid_reindex", "SELECT field_id, sample, 3 - y AS y, (x + 2) % 4 AS x, value FROM grid")
def grid_reindex(t: Tables) -> DataFrame:
    out = grid.reindex(t.grid(), orders_of(t))
    return out.withColumns({"y": F.col("y").cast("int"), "x": F.col("x").cast("int")})


MAX_BLOCK = 256


@query(
    "grid_block_ids",
    f"""WITH RECURSIVE halved AS (
          SELECT max(sample) + 1 AS s, CAST(max(y) + 1 AS BIGINT) AS y, CAST(max(x) + 1 AS BIGINT) AS x FROM grid
          UNION ALL SELECT CASE WHEN s >= y AND s >= x THEN (s + 1) // 2 ELSE s END,
                 CASE WHEN NOT (s >= y AND s >= x) AND y >= x THEN (y + 1) // 2 ELSE y END,
                 CASE WHEN NOT (s >= y AND s >= x) AND NOT y >= x THEN (x + 1) // 2 ELSE x END
          FROM halved WHERE s * y * x > {MAX_BLOCK}),
        w AS (SELECT s, y, x FROM halved WHERE s * y * x <= {MAX_BLOCK})
        SELECT field_id, sample // w.s AS sample_block, g.y // w.y AS y_block, g.x // w.x AS x_block, count(*) AS cells, round(sum(value), 4) AS total
        FROM grid g, w GROUP BY 1, 2, 3, 4""",
)
def grid_block_ids(t: Tables) -> DataFrame:
    cells = t.grid()
    widths = grid.block_widths(grid.grid_sizes(cells), MAX_BLOCK)
    return grid.block_ids(cells, widths).groupBy("field_id", "sample_block", "y_block", "x_block").agg(
        F.count(F.lit(1)).alias("cells"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "select_level",
    """WITH c AS (SELECT DISTINCT p_brand AS channel, CAST(p_size AS BIGINT) AS idx, CAST(p_size AS DOUBLE) AS v, NULL AS t FROM part
         UNION ALL SELECT 'high', p_partkey, p_partkey * 1e9::DOUBLE, NULL FROM part
         UNION ALL SELECT 'text#' || p_size % 5, min(p_partkey), NULL, p_type FROM part GROUP BY p_size % 5, p_type
         UNION ALL SELECT 'scalar#' || n_nationkey, NULL, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 1e8::DOUBLE END, CASE WHEN n_nationkey % 2 = 1 THEN n_name END FROM nation),
       s AS (SELECT s_suppkey AS selector_id, 'Brand#' || (s_nationkey + 1) AS channel,
               CASE WHEN s_acctbal > 6000 THEN s_suppkey % 60 + 1e-9 WHEN s_acctbal > 4000 THEN s_suppkey % 60 + 0.5 ELSE s_suppkey % 50 END::DOUBLE AS v, NULL AS t FROM supplier
         UNION ALL SELECT 1000000 + s_suppkey, 'high', s_suppkey * 1e9::DOUBLE + CASE WHEN s_suppkey % 2 = 0 THEN 1000 ELSE 1e8 END, NULL FROM supplier
         UNION ALL SELECT 2000000 + p_partkey, 'text#' || p_partkey % 5, NULL, CASE WHEN p_partkey % 7 = 0 THEN '12' ELSE p_type END FROM part
         UNION ALL SELECT 3000000 + n_nationkey, 'scalar#' || n_nationkey, CASE WHEN n_nationkey % 3 > 0 AND n_nationkey % 2 = 0 THEN n_nationkey * 1e8::DOUBLE + 1 END,
           CASE WHEN n_nationkey % 3 = 0 THEN 'other' WHEN n_nationkey % 2 = 1 THEN n_name END FROM nation)
       SELECT selector_id, s.channel, count(c.channel) AS matches, CASE WHEN count(c.channel) = 1 THEN coalesce(min(c.idx), -1) ELSE -1 END AS idx,
              CASE WHEN s.channel NOT IN (SELECT channel FROM c) THEN 'no_axis' WHEN s.channel LIKE 'scalar%' THEN CASE WHEN count(c.channel) = 1 THEN 'scalar' ELSE 'scalar_mismatch' END
                WHEN count(c.channel) = 1 THEN 'selected' WHEN count(c.channel) = 0 THEN 'no_match' ELSE 'ambiguous' END AS status
       FROM s LEFT JOIN c ON s.channel = c.channel AND (abs(c.v - s.v) <= 1e-8 + 1e-5 * abs(s.v) OR c.t = s.t) GROUP BY 1, 2""",
)
def select_level(t: Tables) -> DataFrame:
    """Levels of a brand, of very high values, by text and of scalar coordinates."""
    part, nation, supplier = t.read("part"), t.read("nation"), t.read("supplier")
    none, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    nth, size = F.col("n_nationkey"), F.col("p_size")
    even = nth % 2 == 0
    coords = (
        part.select(F.col("p_brand").alias("channel"), size.cast("long").alias("idx"), size.cast("double").alias("value"), no_text.alias("text")).distinct()
        .unionByName(part.select(F.lit("high").alias("channel"), F.col("p_partkey").alias("idx"), (F.col("p_partkey") * 1e9).alias("value"), no_text.alias("text")))
        .unionByName(
            part.groupBy(F.concat(F.lit("text#"), size % 5).alias("channel"), F.col("p_type").alias("text"))
            .agg(F.min("p_partkey").alias("idx"), F.first(none).alias("value"))
        )
        .unionByName(
            nation.select(
                F.concat(F.lit("scalar#"), nth).alias("channel"), F.lit(None).cast("long").alias("idx"),
                F.when(even, nth * 1e8).alias("value"), F.when(~even, F.col("n_name")).alias("text"),
            )
        )
    )
    key = F.col("s_suppkey")
    low = F.when(F.col("s_acctbal") > 6000, key % 60 + F.lit(1e-9)).when(F.col("s_acctbal") > 4000, key % 60 + F.lit(0.5)).otherwise(key % 50)
    row = lambda df, i, channel, value: df.select(
        i.cast("long").alias("selector_id"), channel.alias("channel"), value.cast("string").alias("value")
    )
    exact = F.when(nth % 3 == 0, "other").when(even, (nth * 1e8 + 1).cast("string")).otherwise(F.col("n_name"))
    selectors = reduce(
        DataFrame.unionByName,
        [
            row(supplier, key, F.concat(F.lit("Brand#"), F.col("s_nationkey") + 1), low.cast("double")),
            row(supplier, 1000000 + key, F.lit("high"), key * 1e9 + F.when(key % 2 == 0, 1000.0).otherwise(1e8)),
            row(part, 2000000 + F.col("p_partkey"), F.concat(F.lit("text#"), F.col("p_partkey") % 5), F.when(F.col("p_partkey") % 7 == 0, "12").otherwise(F.col("p_type"))),
            row(nation, 3000000 + nth, F.concat(F.lit("scalar#"), nth), exact),
        ],
    )
    return selection.select_level(coords, selectors, ["channel"]).drop("value")


POLICY = "(VALUES ('ch0', 0.0::DOUBLE, 0.0::DOUBLE, true), ('ch1', 1.0::DOUBLE, 0.0::DOUBLE, true)) p(field_id, atol, rtol, same)"
GRID_DIFF = f"""
judged AS (SELECT r.field_id, r.sample, r.y, r.x, c.value AS candidate, r.value AS reference, abs(c.value - r.value) AS err,
    CASE WHEN c.value IS NULL AND r.value IS NULL THEN 'match' WHEN c.value IS NULL OR r.value IS NULL THEN 'missingness'
         WHEN abs(c.value - r.value) <= coalesce(p.atol, 1e-9::DOUBLE) + coalesce(p.rtol, 1e-6::DOUBLE) * abs(r.value) THEN 'match' ELSE 'value' END AS status
  FROM grid r JOIN grid_cand c ON r.field_id = c.field_id AND r.sample = c.sample AND r.y = c.y AND r.x = c.x
  LEFT JOIN {POLICY} ON r.field_id = p.field_id)"""
CELL = ("field_id", "sample", "y", "x")


def grid_diff_rows(t: Tables, with_policy: bool = True) -> DataFrame:
    channels = t.grid().select("field_id").distinct()
    policy = channels.filter(F.col("field_id").isin("ch0", "ch1")).select(
        "field_id",
        F.when(F.col("field_id") == "ch1", 1.0).otherwise(0.0).alias("atol"),
        F.lit(0.0).alias("rtol"),
        F.lit(True).alias("equal_missing"),
    )
    return diff.diff_values(
        t.grid_cand(), t.grid(), CELL, 1e-9, 1e-6, policy if with_policy else None, "field_id"
    )


@query(
    "grid_diff",
    f"""WITH {GRID_DIFF} SELECT field_id, count(*) AS cells, count(*) FILTER (status <> 'match') AS mismatches,
          count(*) FILTER (status = 'missingness') AS missingness, count(*) FILTER (status = 'value') AS value_mismatches,
          round(max(err), 6) AS max_abs_error FROM judged GROUP BY 1""",
)
def grid_diff(t: Tables) -> DataFrame:
    s = diff.mismatch_summary(grid_diff_rows(t), "field_id")
    return s.select(
        "field_id",
        F.col("keys_compared").alias("cells"),
        "mismatches",
        F.col("missingness_mismatches").alias("missingness"),
        "value_mismatches",
        F.round("max_abs_error", 6).alias("max_abs_error"),
    )


@query(
    "mismatch_examples",
    f"""WITH {GRID_DIFF.replace("coalesce(p.atol, 1e-9::DOUBLE)", "1e-9::DOUBLE").replace("coalesce(p.rtol, 1e-6::DOUBLE)", "1e-6::DOUBLE")}
        SELECT field_id, sample, y, x, status, candidate, reference FROM judged WHERE status <> 'match' ORDER BY field_id, sample, y, x LIMIT 20""",
)
def mismatch_examples(t: Tables) -> DataFrame:
    return diff.mismatch_examples(grid_diff_rows(t, with_policy=False), CELL, 20)


@query(
    "coord_diff",
    """WITH c AS (SELECT axis, idx, CASE WHEN axis = 'lon_MACHINERY' THEN value + CASE WHEN value > 100 THEN 0.5 ELSE 0 END ELSE value END AS value FROM axes
                  WHERE NOT (axis = 'time' AND value >= 883612800)),
       j AS (SELECT coalesce(c.axis, r.axis) AS axis, coalesce(c.idx, r.idx) AS idx, c.value AS cv, r.value AS rv FROM c FULL JOIN axes r ON c.axis = r.axis AND c.idx = r.idx)
       SELECT axis, count(cv) AS candidate_length, count(rv) AS reference_length, count(cv) = count(rv) AS same_shape,
              coalesce(min(idx) FILTER (cv IS NULL OR rv IS NULL OR abs(cv - rv) > 1e-6), -1) AS first_mismatch,
              count(*) FILTER (cv IS NULL OR rv IS NULL OR abs(cv - rv) > 1e-6) AS differing
       FROM j GROUP BY 1""",
)
def coord_diff(t: Tables) -> DataFrame:
    """Candidate: one longitude axis shifted in part, time axis cut off at 1998."""
    axes = t.axes()
    shifted = F.when(
        (F.col("axis") == "lon_MACHINERY") & (F.col("value") > 100), F.col("value") + 0.5
    ).otherwise(F.col("value"))
    cand = axes.filter(~((F.col("axis") == "time") & (F.col("value") >= 883612800))).withColumn("value", shifted)
    return diff.diff_coordinates(cand, axes, 1e-6)


@query(
    "metadata_mismatch",
    """WITH o AS (SELECT p_partkey AS channel, p_brand AS dtype, p_type AS units, CASE WHEN p_size > 40 THEN 'NaN' ELSE CAST(p_size AS VARCHAR) END AS fill_value FROM part),
       e AS (SELECT p_partkey AS channel, CASE WHEN p_size % 5 = 0 THEN 'Brand#1' ELSE p_brand END AS dtype, CASE WHEN p_size < 45 THEN p_type END AS units,
                    CASE WHEN p_size > 45 THEN 'nan' ELSE CAST(p_size AS VARCHAR) END AS fill_value FROM part),
       x AS (SELECT e.channel, u.property, u.expected, u.observed FROM e JOIN o ON e.channel = o.channel,
               LATERAL (VALUES ('dtype', e.dtype, o.dtype), ('units', e.units, o.units), ('fill_value', e.fill_value, o.fill_value)) u(property, expected, observed))
       SELECT channel, property, expected, observed, CASE WHEN property IN ('units', 'fill_value') THEN 'output_policy' ELSE 'metadata' END AS class FROM x WHERE expected IS NOT NULL AND expected <> observed AND NOT (lower(expected) = 'nan' AND lower(observed) = 'nan')""",
)
def metadata_mismatch(t: Tables) -> DataFrame:
    p = t.read("part")
    size = F.col("p_size")
    observed = p.select(
        F.col("p_partkey").alias("channel"),
        F.col("p_brand").alias("dtype"),
        F.col("p_type").alias("units"),
        F.when(size > 40, "NaN").otherwise(size.cast("string")).alias("fill_value"),
    )
    expected = p.select(
        F.col("p_partkey").alias("channel"),
        F.when(size % 5 == 0, "Brand#1").otherwise(F.col("p_brand")).alias("dtype"),
        F.when(size < 45, F.col("p_type")).alias("units"),
        F.when(size > 45, "nan").otherwise(size.cast("string")).alias("fill_value"),
    )
    return diff.check_metadata(observed, expected, ["channel"], ["dtype", "units", "fill_value"], ["units", "fill_value"])


@query(
    "grid_shape",
    """SELECT field_id, max(sample) + 1 AS n_sample, max(y) + 1 AS n_y, max(x) + 1 AS n_x, count(*) AS cells,
         count(*) = (max(sample) + 1) * (max(y) + 1) * (max(x) + 1) AS complete,
         max(y) + 1 = 4 AND max(x) + 1 = CASE WHEN field_id = 'ch3' THEN 5 ELSE 4 END AS as_expected
       FROM grid GROUP BY 1""",
)
def grid_shape(t: Tables) -> DataFrame:
    cells = t.grid()
    expected = cells.groupBy("field_id").agg((F.max("sample") + 1).alias("samples")).select(
        "field_id", "samples", F.lit(HEIGHT).alias("height"), F.when(F.col("field_id") == "ch3", 5).otherwise(WIDTH).alias("width")
    )
    return grid.shape_report(cells, expected)


@query(
    "integrity_scan",
    "SELECT field_id, count(*) AS cells, count(value) AS \"values\", count(value) AS finite_values FROM grid_cand GROUP BY 1",
)
def integrity_scan(t: Tables) -> DataFrame:
    return grid.integrity(t.grid_cand())


@query(
    "logical_bytes",
    """SELECT count(*) AS cells, (max(sample) + max(y) + max(x) + 3) * 8 AS coordinate_bytes,
         count(*) * 4 + (max(sample) + max(y) + max(x) + 3) * 8 AS total_bytes FROM grid""",
)
def logical_bytes(t: Tables) -> DataFrame:
    return grid.logical_bytes(t.grid())


BLOCK = 24  # not a divisor of a tensor's 64 places


def tensors(t: Tables) -> DataFrame:
    return grid.tensor_pack(t.grid(), CHANNELS, BLOCK)


@query(
    "tensor_pack",
    f"""SELECT vec_id AS sample, CAST(4 AS BIGINT) AS c, 4 AS h, 4 AS w, CAST(b AS BIGINT) AS block, CAST(b * {BLOCK} AS BIGINT) AS first,
          CAST(len(part) AS BIGINT) AS cells, CAST(len(part) AS BIGINT) AS filled,
          array_to_string([CAST(round(CAST(v AS DOUBLE), 5) AS DECIMAL(12, 5)) FOR v IN part], ',') AS data
        FROM (SELECT vec_id, b, embedding[b * {BLOCK} + 1:(b + 1) * {BLOCK}] AS part FROM embeddings, range(0, 3) r(b))""",
)
def tensor_pack(t: Tables) -> DataFrame:
    text = F.concat_ws(",", F.transform("data", lambda v: F.round(v.cast("double"), 5).cast("decimal(12,5)").cast("string")))
    return grid.tensor_values(tensors(t)).withColumn("data", text)


@query(
    "tensor_reduce",
    "SELECT vec_id AS sample, CAST(embedding[1] AS DOUBLE) AS marker, round(list_sum([CAST(v AS DOUBLE) FOR v IN embedding]), 6) AS total FROM embeddings",
)
def tensor_reduce(t: Tables) -> DataFrame:
    return grid.tensor_reduce(tensors(t)).withColumn("total", F.round("total", 6))


@query(
    "tensor_check",
    """SELECT vec_id AS sample, CAST(4 AS BIGINT) AS c, 4 AS h, 4 AS w, CAST(len(embedding) - lost + twice AS BIGINT) AS cells,
         len(embedding) = 64 AND lost + twice = 0 AS accepted
       FROM (SELECT *, CASE WHEN vec_id % 7 = 3 THEN 1 ELSE 0 END AS lost, CASE WHEN vec_id % 14 = 3 THEN 1 ELSE 0 END AS twice FROM embeddings)""",
)
def tensor_check(t: Tables) -> DataFrame:
    """Every seventh tensor lacks a cell; every second of these has another cell twice instead."""
    corner, next_to = (F.col("y") == 3) & (F.col("x") == 3), (F.col("y") == 3) & (F.col("x") == 2)
    last = F.col("field_id") == CHANNELS[-1]
    cells = t.grid().filter(~(last & corner & (F.col("sample") % 7 == 3)))
    twice = cells.filter(last & next_to & (F.col("sample") % 14 == 3))
    return grid.tensor_check(grid.tensor_pack(cells.unionByName(twice), CHANNELS, BLOCK), 4, HEIGHT, WIDTH)


@query(
    "grid_blocks",
    """SELECT field_id, sample, y // 4 AS y_block, min(y) AS y0, max(y) - min(y) + 1 AS height, max(x) + 1 AS width,
         CAST(count(*) AS INTEGER) AS cells, round(arg_min(value, y * 10 + x), 6) AS first_cell, round(arg_max(value, y * 10 + x), 6) AS last_cell
       FROM grid GROUP BY 1, 2, 3""",
)
def grid_blocks(t: Tables) -> DataFrame:
    path = scratch(t.spark, "blocks")
    write_grid_blocks(grid.grid_blocks(t.grid(), grid.rows_per_block(F.lit(HEIGHT), F.lit(WIDTH))), path)
    return t.spark.read.parquet(path).select(
        "field_id",
        "sample",
        F.col("y_block").cast("int").alias("y_block"),
        "y0",
        "height",
        "width",
        F.size("cells").alias("cells"),
        F.round(F.element_at("cells", 1).cast("double"), 6).alias("first_cell"),
        F.round(F.element_at("cells", -1).cast("double"), 6).alias("last_cell"),
    )


@query(
    "sample_order",
    "SELECT vec_id AS sample, row_number() OVER (ORDER BY md5(vec_id || ':11'), vec_id) - 1 AS position FROM embeddings",
)
def sample_order(t: Tables) -> DataFrame:
    return grid.sample_order(t.read("embeddings").select(F.col("vec_id").alias("sample")), seed=11)
