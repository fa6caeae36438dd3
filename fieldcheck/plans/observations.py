"""Station observation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcheck.operators import diff, fingerprint, selection, station
from fieldcheck.plans.registry import Tables, query
from fieldcheck.sinks.writers import scratch, write_cache, write_observations
from fieldcheck.sources.readers import promote_scalar, read_sources, scan_observations

ATOL, RTOL = 1e-9, 1e-6


@query(
    "obs_scan",
    """SELECT CAST(user_id AS VARCHAR) AS station_id, ts AS "timestamp", event_type AS field_id, value
       FROM events WHERE event_type IN ('error', 'purchase') AND value > 5""",
)
def obs_scan(t: Tables) -> DataFrame:
    wanted = F.col("event_type").isin("error", "purchase") & (F.col("value") > 5)
    rows = scan_observations(t.spark, t.path("events"), ("user_id", "ts", "event_type", "value"), wanted)
    return rows.select(
        F.col("user_id").cast("string").alias("station_id"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("field_id"),
        "value",
    )


@query(
    "station_scan",
    """SELECT station_id, "timestamp", field_id, value FROM obs
       WHERE station_id = '8' AND field_id = 'error'""",
)
def station_scan(t: Tables) -> DataFrame:
    """The workload a published table is measured with: one station and field, pushed to storage."""
    path = scratch(t.spark, "published")
    write_observations(t.obs(), path)
    found = station.station_scan(scan_observations(t.spark, path), "8", "error")
    return found.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query(
    "obs_write_roundtrip",
    """SELECT field_id, count(*) AS row_count, CAST(min("timestamp") AS VARCHAR) IS NOT NULL AS has_first,
              round(sum(value), 3) AS total, min("timestamp") AS first_ts, max("timestamp") AS last_ts
       FROM obs GROUP BY field_id""",
)
def obs_write_roundtrip(t: Tables) -> DataFrame:
    path = scratch(t.spark, "observations")
    write_observations(t.obs(), path)
    back = scan_observations(t.spark, path)
    ts = F.col("timestamp").cast("timestamp_ntz")
    return back.groupBy("field_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("timestamp").isNotNull().alias("has_first"),
        F.round(F.sum("value"), 3).alias("total"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )


@query(
    "source_union",
    """SELECT station, level, count(*) AS row_count, round(sum(t), 2) AS temperature, round(sum(z), 4) AS geopotential,
              round(sum(humidity), 4) AS humidity
       FROM src GROUP BY station, level""",
)
def source_union(t: Tables) -> DataFrame:
    """Low levels come as Parquet, the others as JSON with other names and one folder per level."""
    src = t.src()
    low, high = scratch(t.spark, "source-low"), scratch(t.spark, "source-high")
    src.filter("level <= 3 AND level <> 1").write.parquet(low)
    first = scratch(t.spark, "source-one-level")
    src.filter("level = 1").drop("level").write.parquet(first)  # a whole file of one level
    rest = src.filter(F.col("level") > 3).withColumnRenamed("valid_time", "time")
    rest.write.partitionBy("level").json(high)  # each folder holds one level, which its files do not name
    whole = station.rename_aliases(read_sources(t.spark, [("parquet", low)]))
    one = promote_scalar(read_sources(t.spark, [("parquet", first)]), "level", 1)
    whole = whole.unionByName(station.rename_aliases(one), allowMissingColumns=True)
    others = station.rename_aliases(read_sources(t.spark, [("json", high)], {high: rest.schema}))
    whole = whole.unionByName(others, allowMissingColumns=True)
    return whole.groupBy("station", F.col("pressure_level").alias("level")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.round(F.sum("temperature"), 2).alias("temperature"),
        F.round(F.sum("geopotential"), 4).alias("geopotential"),
        F.round(F.sum("humidity"), 4).alias("humidity"),
    )


@query(
    "cache_partition_counts",
    """SELECT field_id, CAST("timestamp" AS DATE) AS "date", count(*) AS row_count FROM obs GROUP BY 1, 2""",
)
def cache_partition_counts(t: Tables) -> DataFrame:
    path = scratch(t.spark, "cache")
    write_cache(t.obs(), path)
    return (
        t.spark.read.parquet(path)
        .groupBy("field_id", "date")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


@query(
    "station_unpivot",
    """SELECT station AS station_id, valid_time AS "timestamp", u.field_id, count(*) AS row_count, round(sum(u.value), 4) AS total
       FROM src, LATERAL (VALUES ('temperature', t), ('geopotential', z)) u(field_id, value) GROUP BY 1, 2, 3""",
)
def station_unpivot(t: Tables) -> DataFrame:
    long = station.canonicalise(t.src(), "station", "valid_time", {"t": "temperature", "z": "geopotential"})
    return long.groupBy("station_id", "timestamp", "field_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "alias_rename",
    """SELECT station, valid_time AS "time", level AS pressure_level, t AS temperature, z AS geopotential, humidity, order_no
       FROM src""",
)
def alias_rename(t: Tables) -> DataFrame:
    return station.rename_aliases(t.src())


SCOPES = """
scopes AS (SELECT n_nationkey, n_name AS dataset, make_date(1992 + n_nationkey % 7, 1, 1) AS start_date,
                  make_date(1992 + n_nationkey % 7, 3, 31) AS end_date, n_regionkey % 2 = 0 AS inclusive FROM nation),
asked AS (SELECT dataset, CAST(d AS TIMESTAMP) + to_seconds(s) AS "timestamp"
          FROM (SELECT dataset, unnest(generate_series(CAST(start_date AS TIMESTAMP),
                  CAST(CASE WHEN inclusive THEN end_date ELSE end_date - 1 END AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM scopes),
               (VALUES (0), (21600)) h(s))"""


def scopes(t: Tables) -> DataFrame:
    n = t.read("nation")
    year = F.lit(1992) + F.col("n_nationkey") % 7
    return n.select(
        F.col("n_name").alias("dataset"),
        F.make_date(year, F.lit(1), F.lit(1)).alias("start_date"),
        F.make_date(year, F.lit(3), F.lit(31)).alias("end_date"),
        (F.col("n_regionkey") % 2 == 0).alias("inclusive"),
        F.array(F.lit(0), F.lit(21600)).alias("times"),
    )


@query("requested_ts", f"""WITH {SCOPES} SELECT dataset, "timestamp" FROM asked""")
def requested_ts(t: Tables) -> DataFrame:
    return selection.requested_timestamps(scopes(t), ["dataset"])


@query(
    "select_times",
    f"""WITH {SCOPES} SELECT dataset, "timestamp", count(*) AS row_count, round(sum(value), 3) AS total FROM cells
        WHERE (dataset, "timestamp") IN (SELECT dataset, "timestamp" FROM asked) GROUP BY 1, 2""",
)
def select_times(t: Tables) -> DataFrame:
    kept = selection.select_times(t.cells(), requested_ts(t), ["dataset"])
    return kept.groupBy("dataset", "timestamp").agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.sum("value"), 3).alias("total")
    )


@query(
    "missing_ts",
    f"""WITH {SCOPES} SELECT dataset, count(*) AS missing, min("timestamp") AS first_missing FROM asked a
        WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.dataset = a.dataset AND c."timestamp" = a."timestamp") GROUP BY 1""",
)
def missing_ts(t: Tables) -> DataFrame:
    return selection.missing_times(t.cells(), requested_ts(t), ["dataset"])


@query(
    "select_area",
    """SELECT a.area, station_id, count(*) AS row_count, round(sum(value), 3) AS total FROM cells,
         (VALUES ('global', 90.0, -180.0, -90.0, 180.0), ('box', 60.0, 10.0, -30.0, 120.0), ('dateline', 80.0, 150.0, -80.0, -150.0))
         a(area, n, w, s, e)
       WHERE latitude BETWEEN s AND n AND (e - w >= 360 OR
         CASE WHEN w <= e THEN longitude BETWEEN w AND e ELSE longitude >= w OR longitude <= e END)
       GROUP BY 1, 2""",
)
def select_area(t: Tables) -> DataFrame:
    areas = {"global": (90, -180, -90, 180), "box": (60, 10, -30, 120), "dateline": (80, 150, -80, -150)}
    per_station = t.cells().groupBy("station_id", "latitude", "longitude").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("value").alias("total")
    )
    out = None
    for name, box in areas.items():
        kept = selection.select_area(per_station, *[F.lit(float(v)) for v in box]).select(
            F.lit(name).alias("area"), "station_id", "row_count", F.round("total", 3).alias("total")
        )
        out = kept if out is None else out.unionByName(kept)
    return out


@query(
    "contract_select",
    """SELECT c.dataset, station_id, "timestamp",
              c.variable || '[level=' || c.level || ']' AS field_id, value,
              coalesce(c.units, CASE c.variable WHEN 'temperature' THEN 'K' ELSE 'm2 s-2' END) AS units
       FROM cells c JOIN contract k ON c.dataset = k.dataset AND c.variable = k.variable AND c.level = k.level
       WHERE "timestamp" >= start_date AND "timestamp" < end_date + 1
         AND date_part('hour', "timestamp") IN (0, 6) AND latitude BETWEEN south AND north
         AND longitude BETWEEN west AND east""",
)
def contract_select(t: Tables) -> DataFrame:
    kinds = t.contract().select("variable").distinct()
    units = F.when(F.col("variable") == "temperature", "K").when(F.col("variable") == "geopotential", "m2 s-2").otherwise("1")
    inventory = kinds.select("variable", units.alias("units"))
    return selection.contract_select(t.cells(), t.contract(), inventory)


@query(
    "contract_faults",
    """WITH k AS (SELECT dataset, variable, level, CASE dataset WHEN 'NATION_3' THEN 200.0 ELSE west END AS west, east, north, south FROM contract
         UNION ALL SELECT n_name, 'snow', 2, -1.0, 1.0, 1.0, -1.0 FROM nation),
       l AS (SELECT DISTINCT dataset, variable, level FROM cells), v AS (SELECT DISTINCT dataset, variable FROM l)
       SELECT k.dataset, k.variable, k.level, CASE WHEN k.west > 180 THEN 'area_longitude' WHEN v.variable IS NULL THEN 'no_variable' ELSE 'no_level' END AS fault
       FROM k LEFT JOIN v ON v.dataset = k.dataset AND v.variable = k.variable
              LEFT JOIN l ON l.dataset = k.dataset AND l.variable = k.variable AND l.level = k.level
       WHERE k.west > 180 OR l.level IS NULL""",
)
def contract_faults(t: Tables) -> DataFrame:
    """One dataset asks for an impossible area, all ask for a variable that none has."""
    asked = t.contract().withColumn("west", F.when(F.col("dataset") == "NATION_3", 200.0).otherwise(F.col("west")))
    one = F.lit(1.0)
    snow = t.read("nation").select(
        F.col("n_name").alias("dataset"), F.lit("snow").alias("variable"), F.lit(2).alias("level"),
        (-one).alias("west"), one.alias("east"), one.alias("north"), (-one).alias("south"),
    )
    return selection.contract_faults(t.cells(), asked.select(snow.columns).unionByName(snow))


@query(
    "scope_violations",
    """SELECT station_id, "timestamp", field_id, value FROM obs
       WHERE "timestamp" < TIMESTAMP '2024-01-03' OR "timestamp" >= TIMESTAMP '2024-01-26'""",
)
def scope_violations(t: Tables) -> DataFrame:
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    return station.scope_violations(t.obs(), day("2024-01-03"), day("2024-01-25"))


@query(
    "key_quality",
    """WITH k AS (SELECT station_id, "timestamp", field_id, count(*) AS n FROM obs_cand GROUP BY 1, 2, 3)
       SELECT CAST(sum(n) AS BIGINT) AS row_count,
              CAST(coalesce(sum(n) FILTER (station_id IS NULL OR "timestamp" IS NULL OR field_id IS NULL), 0) AS BIGINT) AS null_key_rows,
              count(*) FILTER (n > 1) AS duplicate_keys, CAST(sum(n - 1) AS BIGINT) AS surplus_rows, sum(n) = 0 AS empty FROM k""",
)
def key_quality(t: Tables) -> DataFrame:
    return station.key_quality(t.obs_cand())


@query(
    "obs_profile",
    """SELECT 'station' AS kind, station_id AS id, count(*) AS "rows", min("timestamp") AS first_ts, max("timestamp") AS last_ts,
              CASE WHEN station_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer) THEN 'declared' ELSE 'undeclared' END AS state
       FROM obs_cand GROUP BY 2
       UNION ALL SELECT 'station', CAST(c_custkey AS VARCHAR), 0, NULL, NULL, 'absent' FROM customer
         WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT station_id FROM obs_cand)
       UNION ALL SELECT 'field', field_id, count(*), min("timestamp"), max("timestamp"), 'undeclared' FROM obs_cand GROUP BY 2""",
)
def obs_profile(t: Tables) -> DataFrame:
    expected = t.read("customer").select(F.lit("station").alias("kind"), F.col("c_custkey").cast("string").alias("id"))
    return station.profile(t.obs_cand(), expected)


def obs_diff_rows(t: Tables) -> DataFrame:
    return diff.diff_values(t.obs_cand(), t.obs(), station.KEY, ATOL, RTOL)


OBS_DIFF = """
folded AS (SELECT station_id, "timestamp", field_id, count(*) FILTER (s = 1) AS nc, count(*) FILTER (s = 2) AS nr,
             count(*) FILTER (s = 1 AND value IS NULL) AS gc, count(*) FILTER (s = 2 AND value IS NULL) AS gr,
             max(value) FILTER (s = 1) AS cand, max(value) FILTER (s = 2) AS ref
           FROM (SELECT *, 1 AS s FROM obs_cand UNION ALL SELECT *, 2 FROM obs) GROUP BY 1, 2, 3),
judged AS (SELECT *, CASE WHEN nc = 0 THEN 'missing_key' WHEN nr = 0 THEN 'extra_key' WHEN nc > 1 OR nr > 1 THEN 'repeated_key'
             WHEN gc <> gr THEN 'missingness' WHEN gc > 0 THEN 'match'
             WHEN abs(cand - ref) <= 1e-9 + 1e-6 * abs(ref) THEN 'match' ELSE 'value' END AS status,
             abs(cand - ref) AS err FROM folded)"""


@query(
    "obs_diff",
    f"""WITH {OBS_DIFF} SELECT station_id, "timestamp", field_id, nc AS candidate_rows, nr AS reference_rows,
              cand AS candidate, ref AS reference, round(err, 6) AS abs_error, status FROM judged""",
)
def obs_diff(t: Tables) -> DataFrame:
    return obs_diff_rows(t).withColumn("abs_error", F.round("abs_error", 6))


@query(
    "mismatch_summary",
    f"""WITH {OBS_DIFF} SELECT field_id, count(*) AS keys_compared, count(*) FILTER (status <> 'match') AS mismatches,
              count(*) FILTER (status = 'missing_key') AS missing_keys, count(*) FILTER (status = 'extra_key') AS extra_keys,
              count(*) FILTER (status = 'repeated_key') AS repeated_keys,
              count(*) FILTER (status = 'missingness') AS missingness_mismatches,
              count(*) FILTER (status = 'value') AS value_mismatches, round(max(err), 6) AS max_abs_error,
              round(max(err / abs(ref)) FILTER (ref <> 0), 6) AS max_rel_error,
              count(*) FILTER (ref = 0 AND err > 0) AS infinite_relative
        FROM judged GROUP BY 1""",
)
def mismatch_summary(t: Tables) -> DataFrame:
    out = diff.mismatch_summary(obs_diff_rows(t), "field_id")
    return out.withColumns({c: F.round(c, 6) for c in ("max_abs_error", "max_rel_error")})


FRAMED = "coalesce(length({0}) || ':' || {0}, '~')"
FINGERPRINT = """
SELECT {keys}{sep}count(*) AS "rows", sha256(concat_ws(':', count(*), {lanes})) AS fingerprint FROM (
  SELECT *, sha256({digest}) AS h FROM {table}) {group}"""
OBS_DIGEST = " || ".join(
    FRAMED.format(c)
    for c in ("field_id", "station_id", "strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S.%f')", "CAST(value AS VARCHAR)")
)
LANES = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS HUGEINT)) AS VARCHAR)" for i in range(4))


@query(
    "fingerprint",
    FINGERPRINT.format(keys="field_id", sep=", ", lanes=LANES, digest=OBS_DIGEST, table="obs_cand", group="GROUP BY field_id"),
)
def table_fingerprint(t: Tables) -> DataFrame:
    return fingerprint.table_fingerprint(t.obs_cand(), ["field_id"])


#: Rows of two tables that differ in what a careless digest confuses: null and a text, and where one text ends.
MARKED_SQL = """SELECT 'null' AS field_id, CASE WHEN p_size % 2 = 0 THEN p_name END AS a, p_brand AS b, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'missing' END AS a2, p_brand AS b2 FROM part
       UNION ALL SELECT 'border', p_name || chr(31) || p_type, p_brand, p_name, p_type || chr(31) || p_brand FROM part
       UNION ALL SELECT 'exact', p_name, p_brand, p_name, p_brand FROM part"""


@query(
    "rerun_equal",
    f"""SELECT o.field_id, o.n AS rows_initial, c.n AS rows_rerun, o.n = c.n AND d.n = 0 AS equal
       FROM (SELECT field_id, count(*) AS n FROM obs GROUP BY 1) o
       JOIN (SELECT field_id, count(*) AS n FROM obs_cand GROUP BY 1) c ON o.field_id = c.field_id
       JOIN (SELECT f.field_id, count(x.field_id) AS n FROM (SELECT DISTINCT field_id FROM obs) f LEFT JOIN
              (SELECT * FROM obs EXCEPT SELECT * FROM obs_cand) x ON f.field_id = x.field_id GROUP BY 1) d ON o.field_id = d.field_id
       UNION ALL SELECT field_id, count(*), count(*), count_if(a IS DISTINCT FROM a2 OR b IS DISTINCT FROM b2) = 0 FROM ({MARKED_SQL}) GROUP BY 1""",
)
def rerun_equal(t: Tables) -> DataFrame:
    """By field; and of texts that hold nulls, borders and neither, the last in another order."""
    part = t.read("part")
    even, name, brand, kind = F.col("p_size") % 2 == 0, F.col("p_name"), F.col("p_brand"), F.col("p_type")
    rows = lambda field, a, b: part.select(F.lit(field).alias("field_id"), a.alias("a"), b.alias("b"))
    border = F.lit("\x1f")
    first = rows("null", F.when(even, name), brand).unionByName(rows("border", F.concat(name, border, kind), brand))
    again = rows("null", F.when(even, name).otherwise("missing"), brand).unionByName(rows("border", name, F.concat(kind, border, brand)))
    exact = rows("exact", name, brand)
    marked = fingerprint.rerun_equal(first.unionByName(exact), again.unionByName(exact.repartition(7)), ["field_id"])
    return fingerprint.rerun_equal(t.obs(), t.obs_cand(), ["field_id"]).unionByName(marked)


@query(
    "merge_first_wins",
    """WITH u AS (SELECT 0 AS source_no, station, valid_time, level, max(t) AS t, CAST(NULL AS DOUBLE) AS humidity FROM src WHERE level <= 4 GROUP BY ALL
             UNION ALL SELECT 1, station, valid_time, level, min(t), min(humidity) FROM src WHERE level >= 3 GROUP BY ALL)
       SELECT station, valid_time, level, min(source_no) AS source_no,
              arg_min(t, source_no) FILTER (t IS NOT NULL) AS t, arg_min(humidity, source_no) FILTER (humidity IS NOT NULL) AS humidity
       FROM u GROUP BY station, valid_time, level""",
)
def merge_first_wins(t: Tables) -> DataFrame:
    key = ["station", "valid_time", "level"]
    src = t.src()
    first = src.filter(F.col("level") <= 4).groupBy(*key).agg(F.max("t").alias("t"))
    second = src.filter(F.col("level") >= 3).groupBy(*key).agg(F.min("t").alias("t"), F.min("humidity").alias("humidity"))
    return selection.first_source_wins([first, second], key)


@query(
    "field_id",
    """WITH f AS (SELECT p_partkey, p_name, p_size, p_type, p_brand FROM part)
       SELECT p_partkey, CASE WHEN p_size <= 25 THEN p_name || '[brand="' || p_brand || '",level=' || p_size || ']' ELSE p_name END AS sorted_id,
              CASE WHEN p_size <= 25 THEN p_name || '[level="' || p_size || '",brand="' || p_brand || '"]' ELSE p_name END AS runner_id FROM f""",
)
def field_ids(t: Tables) -> DataFrame:
    from fieldcheck.functions.columns import field_id

    sel = lambda dim, value, kind: F.struct(
        F.lit(dim).alias("dimension"), value.cast("string").alias("value"), F.lit(kind).alias("value_type")
    )
    both = F.array(sel("level", F.col("p_size"), "number"), sel("brand", F.col("p_brand"), "string"))
    selectors = F.when(F.col("p_size") <= 25, both).otherwise(F.slice(both, 1, 0))
    return t.read("part").select(
        "p_partkey",
        field_id(F.col("p_name"), selectors).alias("sorted_id"),
        field_id(F.col("p_name"), selectors, "contract_order_text").alias("runner_id"),
    )
