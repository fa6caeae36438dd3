"""Stand-in tables: what the operators work on, derived from the given tables.

Every stand-in covers its whole source table. `SQL` holds the same definitions for the SQL side.
Candidate defects (a changed value, a lost value, a lost or a repeated row) are placed by values
the data carries itself.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives Python workers the package, whatever folder the driver was started from."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "fieldcheck.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def _k(props: str = "props"):
    return F.get_json_object(props, "$.k").cast("int")


class StandIns:
    def obs(self) -> DataFrame:
        return self.read("events").select(
            F.col("user_id").cast("string").alias("station_id"),
            F.col("ts").alias("timestamp"),
            F.col("event_type").alias("field_id"),
            "value",
        )

    def obs_cand(self) -> DataFrame:
        e = self.read("events").withColumn("k", _k()).filter(F.col("k") != 42)
        value = F.when(F.col("k") == 7, F.col("value") + 1).when(F.col("k") != 13, F.col("value"))
        copies = F.when(F.col("k") == 77, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        return e.select(
            F.col("user_id").cast("string").alias("station_id"),
            F.col("ts").alias("timestamp"),
            F.col("event_type").alias("field_id"),
            value.alias("value"),
            F.explode(copies).alias("_copy"),
        ).drop("_copy")

    def grid(self) -> DataFrame:
        e = self.read("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "v"))
        return e.select(
            F.concat(F.lit("ch"), F.floor(F.col("pos") / 16).cast("string")).alias("field_id"),
            F.col("vec_id").alias("sample"),
            F.floor((F.col("pos") % 16) / 4).cast("int").alias("y"),
            (F.col("pos") % 4).alias("x"),
            F.col("v").cast("double").alias("value"),
        )

    def grid_cand(self) -> DataFrame:
        e = self.read("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "v"))
        bumped = (F.col("pos") == 17) & (F.col("label") == 3)
        lost = (F.col("pos") == 33) & (F.col("label") == 5)
        value = F.when(bumped, F.col("v").cast("double") + 0.5).when(~lost, F.col("v").cast("double"))
        return e.select(
            F.concat(F.lit("ch"), F.floor(F.col("pos") / 16).cast("string")).alias("field_id"),
            F.col("vec_id").alias("sample"),
            F.floor((F.col("pos") % 16) / 4).cast("int").alias("y"),
            (F.col("pos") % 4).alias("x"),
            value.alias("value"),
        )

    def axes(self) -> DataFrame:
        """Longitude axis per market segment in customer order, plus the axis of order days."""
        lon = self.read("customer").select(
            F.concat(F.lit("lon_"), F.col("c_mktsegment")).alias("axis"),
            F.col("c_custkey").alias("idx"),
            ((F.col("c_custkey") * 7) % 1440 * 0.25 - 180.0).alias("value"),
            F.lit("longitude_modulo_360").alias("mode"),
        )
        day = self.read("orders").select(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).alias("d")).distinct()
        time = day.select(
            F.lit("time").alias("axis"),
            F.col("d").cast("long").alias("idx"),
            (F.col("d") * 86400.0).alias("value"),
            F.lit("ascending").alias("mode"),
        )
        return lon.unionByName(time)

    def src(self) -> DataFrame:
        """Provider table: one wide row per line item."""
        return self.read("lineitem").select(
            F.col("l_suppkey").cast("string").alias("station"),
            F.col("l_orderkey").alias("order_no"),
            F.col("l_shipdate").alias("valid_time"),
            F.col("l_linenumber").alias("level"),
            F.col("l_quantity").alias("t"),
            F.col("l_discount").alias("z"),
            F.col("l_tax").alias("humidity"),
        )

    def cells(self) -> DataFrame:
        """Provider cells: nation of the supplier as dataset, line number as level, three variables."""
        s = self.read("supplier").select("s_suppkey", "s_nationkey")
        n = self.read("nation").select("n_nationkey", "n_name")
        wide = (
            self.read("lineitem")
            .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("n_name").alias("dataset"),
                F.col("l_suppkey").cast("string").alias("station_id"),
                F.col("l_shipdate").alias("timestamp"),
                F.col("l_linenumber").alias("level"),
                (F.col("s_nationkey") * 7.0 - 84.0).alias("latitude"),
                (F.col("l_suppkey") * 3.0 % 360.0 - 180.0).alias("longitude"),
                F.when(F.col("l_linestatus") == "F", "declared").alias("units"),
                F.col("l_quantity").alias("temperature"),
                F.col("l_discount").alias("geopotential"),
                F.col("l_tax").alias("humidity"),
            )
        )
        ids = ["dataset", "station_id", "timestamp", "level", "latitude", "longitude", "units"]
        return wide.unpivot(ids, ["temperature", "geopotential", "humidity"], "variable", "value")

    def contract(self) -> DataFrame:
        """Per nation: temperature at two levels and geopotential at one, three years, an area."""
        n = self.read("nation")
        asked = F.array(
            F.struct(F.lit("temperature").alias("variable"), (F.col("n_regionkey") + 1).cast("int").alias("level")),
            F.struct(F.lit("temperature").alias("variable"), F.lit(7).alias("level")),
            F.struct(F.lit("geopotential").alias("variable"), F.lit(1).alias("level")),
        )
        return n.select(
            F.col("n_name").alias("dataset"),
            F.explode(asked).alias("_f"),
            F.make_date(F.col("n_regionkey") + 1993, F.lit(1), F.lit(1)).alias("start_date"),
            F.make_date(F.col("n_regionkey") + 1995, F.lit(12), F.lit(31)).alias("end_date"),
            F.array(F.lit(0), F.lit(21600)).alias("times"),
            F.lit(80.0).alias("north"),
            (F.col("n_nationkey") * -5.0).alias("west"),
            F.lit(-80.0).alias("south"),
            F.lit(150.0).alias("east"),
        ).select("dataset", "_f.variable", "_f.level", "start_date", "end_date", "times", "north", "west", "south", "east")

    def checks(self) -> DataFrame:
        """Evaluation checks: customer as candidate, order priority as constraint."""
        p = F.col("o_orderpriority")
        constraint = (
            F.when(p == "1-URGENT", "contract_correctness")
            .when(p == "2-HIGH", "semantic_equivalence")
            .when(p == "3-MEDIUM", "rerun_safety")
            .otherwise("provenance_security")
        )
        price = F.col("o_totalprice")
        status = (
            F.when((F.col("o_orderstatus") == "P") & (price > 450000), "ERROR")
            .when((F.col("o_orderstatus") == "P") & (price > 400000), "FAIL")
            .when((F.col("o_orderstatus") == "O") & (price < 10000), "NOT_ASSESSED")
            .otherwise("PASS")
        )
        return self.read("orders").select(
            F.col("o_custkey").alias("candidate_id"),
            constraint.alias("constraint"),
            F.col("o_orderkey").alias("seq"),
            status.alias("status"),
            F.concat(F.lit("CODE_"), F.substring("o_orderpriority", 1, 1)).alias("feedback_code"),
            (price >= 50000).alias("required"),
        )

    def trials(self) -> DataFrame:
        """Generation trials: order priority as condition, order as repetition."""
        o = self.read("orders")
        ok = F.col("o_orderstatus") != "P"
        first = ok & (F.col("o_totalprice") > 250000)
        repairs = F.when(ok & ~first, F.pmod(F.col("o_orderkey"), F.lit(4))).otherwise(F.lit(0)).cast("int")
        final = F.when(repairs > 0, F.when(F.col("o_totalprice") > 100000, "repaired").otherwise("exhausted"))
        return o.select(
            F.col("o_orderpriority").alias("condition"),
            F.col("o_orderkey").alias("trial_id"),
            (F.floor(F.col("o_custkey") / 10) + 1).alias("repetition"),
            ok.alias("generation_succeeded"),
            F.when(ok | (F.col("o_totalprice") < 2000), F.concat(F.lit("p"), F.col("o_orderkey"))).alias("pipeline_id"),
            F.when(~ok, "generation failed").alias("generation_error"),
            first.alias("initial_passed"),
            repairs.alias("repairs_attempted"),
            final.alias("repair_status"),
            (first | (final == "repaired")).alias("_final"),
            F.when(repairs > 0, F.when(F.col("o_totalprice") > 5000, repairs).otherwise(0)).otherwise(0).alias("repair_logs"),
        ).withColumn("final_passed", F.coalesce("_final", F.lit(False))).drop("_final")

    def calls(self) -> DataFrame:
        """Model calls: order as trial, line number as call; the models come from the return flag."""
        f = F.col("l_returnflag")
        model = (
            F.when(f == "A", "gpt-5.4-2026-03-05").when(f == "N", "gpt-4o").otherwise("unlisted-model")
        )
        tokens = (F.col("l_quantity") * 8000).cast("long")
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("trial_id"),
            F.col("l_linenumber").alias("call_no"),
            F.col("l_partkey").alias("part"),
            model.alias("model"),
            F.when(F.col("l_linestatus") == "F", "judge").otherwise("agent").alias("kind"),
            tokens.alias("input_tokens"),
            (tokens * F.col("l_discount") * 10).cast("long").alias("cached_input_tokens"),
            (F.col("l_quantity") * 100).cast("long").alias("output_tokens"),
            (F.col("l_quantity") * 10).cast("long").alias("reasoning_tokens"),
            F.col("l_shipdate").alias("started_at"),
            (F.col("l_tax") > 0).alias("has_usage"),
        )

    def passes(self) -> DataFrame:
        """Timed passes: supplier and ship month as measurement, line as repetition."""
        return self.read("lineitem").select(
            F.col("l_suppkey").alias("candidate_id"),
            F.col("l_linenumber").alias("pass_no"),
            F.col("l_quantity").alias("seconds"),
            (F.lit(1000.0) / F.col("l_quantity")).alias("samples_per_second"),
            F.floor("l_extendedprice").cast("long").alias("output_bytes"),
        )

    def points(self) -> DataFrame:
        """Search nodes: one per supplier; a third of them are one run, the others go by nation. Parent: half the number."""
        s = self.read("supplier")
        sums = (
            self.read("lineitem")
            .groupBy("l_suppkey")
            .agg(
                F.sum("l_quantity").alias("q"),
                F.sum(F.floor("l_extendedprice").cast("long")).alias("b"),
                F.count(F.lit(1)).alias("n"),
            )
        )
        return s.join(sums, F.col("s_suppkey") == F.col("l_suppkey")).select(
            F.when(F.col("s_suppkey") % 3 == 0, "hot").otherwise(F.concat(F.lit("run"), F.col("s_nationkey"))).alias("run_id"),
            F.col("s_suppkey").alias("node_id"),
            F.floor(F.col("s_suppkey") / 2).alias("parent_id"),
            F.col("s_suppkey").alias("seq"),
            F.round(F.col("q") / F.col("n"), 6).alias("throughput"),
            F.col("b").cast("double").alias("bytes"),
            (F.col("s_acctbal") > 0).alias("feasible"),
        )

    def texts(self) -> DataFrame:
        """All text bodies, plus configuration lines written from customer rows."""
        d = self.read("documents").select(F.concat(F.lit("doc/"), "doc_id", F.lit(".txt")).alias("path"), "text")
        p = self.read("pages").select(F.concat(F.lit("page/"), "page_id", F.lit(".txt")).alias("path"), F.col("html").alias("text"))
        c = self.read("conversations").select(
            F.concat(F.lit("chat/"), "conv_id", F.lit("/"), "turn", F.lit(".json")).alias("path"), "text"
        )
        seg = F.col("c_mktsegment")
        line = (
            F.when(seg == "MACHINERY", F.concat(F.lit('password = "'), "c_name", F.lit('"')))
            .when(seg == "HOUSEHOLD", F.concat(F.lit("-----BEGIN PRIVATE KEY-----\n"), "c_name"))
            .when(seg == "BUILDING", F.concat(F.lit("export KEY=hunter2value "), "c_name", F.lit(" hunter2value")))
            .otherwise(F.concat(F.lit("name = "), "c_name"))
        )
        k = self.read("customer").select(
            F.concat(F.lit("config/"), "c_custkey", F.when(seg == "AUTOMOBILE", ".bin").otherwise(".toml")).alias("path"),
            line.alias("text"),
        )
        return d.unionByName(p).unionByName(c).unionByName(k)


SQL: dict[str, str] = {
    "obs": """
SELECT CAST(user_id AS VARCHAR) AS station_id, ts AS "timestamp", event_type AS field_id, value FROM events""",
    "obs_cand": """
SELECT station_id, "timestamp", field_id, value FROM (
  SELECT CAST(user_id AS VARCHAR) AS station_id, ts AS "timestamp", event_type AS field_id,
         CASE WHEN k = 7 THEN value + 1 WHEN k <> 13 THEN value END AS value,
         unnest(CASE WHEN k = 77 THEN [1, 2] ELSE [1] END) AS copy
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) WHERE k <> 42)""",
    "grid_pos": """
SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings""",
    "grid": """
SELECT 'ch' || CAST(pos // 16 AS VARCHAR) AS field_id, vec_id AS sample, CAST((pos % 16) // 4 AS INTEGER) AS y,
       CAST(pos % 4 AS INTEGER) AS x, CAST(v AS DOUBLE) AS value FROM grid_pos""",
    "grid_cand": """
SELECT 'ch' || CAST(pos // 16 AS VARCHAR) AS field_id, vec_id AS sample, CAST((pos % 16) // 4 AS INTEGER) AS y,
       CAST(pos % 4 AS INTEGER) AS x,
       CASE WHEN pos = 17 AND label = 3 THEN CAST(v AS DOUBLE) + 0.5
            WHEN NOT (pos = 33 AND label = 5) THEN CAST(v AS DOUBLE) END AS value FROM grid_pos""",
    "axes": """
SELECT 'lon_' || c_mktsegment AS axis, c_custkey AS idx, (c_custkey * 7) % 1440 * 0.25::DOUBLE - 180.0::DOUBLE AS value,
       'longitude_modulo_360' AS mode FROM customer
UNION ALL
SELECT 'time', d, d * 86400.0::DOUBLE, 'ascending' FROM
  (SELECT DISTINCT date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders)""",
    "src": """
SELECT CAST(l_suppkey AS VARCHAR) AS station, l_orderkey AS order_no, l_shipdate AS valid_time, l_linenumber AS level,
       l_quantity AS t, l_discount AS z, l_tax AS humidity FROM lineitem""",
    "cells": """
SELECT n_name AS dataset, CAST(l_suppkey AS VARCHAR) AS station_id, l_shipdate AS "timestamp", l_linenumber AS level,
       s_nationkey * 7.0::DOUBLE - 84.0::DOUBLE AS latitude, l_suppkey * 3.0::DOUBLE % 360.0::DOUBLE - 180.0::DOUBLE AS longitude,
       CASE WHEN l_linestatus = 'F' THEN 'declared' END AS units, u.variable, u.value
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey,
     LATERAL (VALUES ('temperature', l_quantity), ('geopotential', l_discount), ('humidity', l_tax)) u(variable, value)""",
    "contract": """
SELECT n_name AS dataset, f.variable, f.level, make_date(n_regionkey + 1993, 1, 1) AS start_date,
       make_date(n_regionkey + 1995, 12, 31) AS end_date, 80.0::DOUBLE AS north, n_nationkey * -5.0::DOUBLE AS west,
       -80.0::DOUBLE AS south, 150.0::DOUBLE AS east
FROM nation, LATERAL (VALUES ('temperature', n_regionkey + 1), ('temperature', 7), ('geopotential', 1)) f(variable, level)""",
    "checks": """
SELECT o_custkey AS candidate_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'contract_correctness' WHEN '2-HIGH' THEN 'semantic_equivalence'
            WHEN '3-MEDIUM' THEN 'rerun_safety' ELSE 'provenance_security' END AS "constraint",
       o_orderkey AS seq,
       CASE WHEN o_orderstatus = 'P' AND o_totalprice > 450000 THEN 'ERROR'
            WHEN o_orderstatus = 'P' AND o_totalprice > 400000 THEN 'FAIL'
            WHEN o_orderstatus = 'O' AND o_totalprice < 10000 THEN 'NOT_ASSESSED' ELSE 'PASS' END AS status,
       'CODE_' || substr(o_orderpriority, 1, 1) AS feedback_code, o_totalprice >= 50000 AS required
FROM orders""",
    "trials": """
SELECT o_orderpriority AS condition, o_orderkey AS trial_id, o_custkey // 10 + 1 AS repetition,
       ok AS generation_succeeded,
       CASE WHEN ok OR o_totalprice < 2000 THEN 'p' || o_orderkey END AS pipeline_id,
       CASE WHEN NOT ok THEN 'generation failed' END AS generation_error,
       first AS initial_passed, repairs AS repairs_attempted,
       CASE WHEN repairs > 0 THEN CASE WHEN o_totalprice > 100000 THEN 'repaired' ELSE 'exhausted' END END AS repair_status,
       CASE WHEN repairs > 0 AND o_totalprice > 5000 THEN repairs ELSE 0 END AS repair_logs,
       first OR (repairs > 0 AND o_totalprice > 100000) AS final_passed
FROM (SELECT *, CAST(CASE WHEN ok AND NOT first THEN o_orderkey % 4 ELSE 0 END AS INTEGER) AS repairs
      FROM (SELECT *, o_orderstatus <> 'P' AS ok, o_orderstatus <> 'P' AND o_totalprice > 250000 AS first FROM orders))""",
    "calls": """
SELECT l_orderkey AS trial_id, l_linenumber AS call_no, l_partkey AS part,
       CASE l_returnflag WHEN 'A' THEN 'gpt-5.4-2026-03-05' WHEN 'N' THEN 'gpt-4o' ELSE 'unlisted-model' END AS model,
       CASE WHEN l_linestatus = 'F' THEN 'judge' ELSE 'agent' END AS kind,
       CAST(trunc(l_quantity * 8000) AS BIGINT) AS input_tokens,
       CAST(trunc(CAST(trunc(l_quantity * 8000) AS BIGINT) * l_discount * 10) AS BIGINT) AS cached_input_tokens,
       CAST(trunc(l_quantity * 100) AS BIGINT) AS output_tokens, CAST(trunc(l_quantity * 10) AS BIGINT) AS reasoning_tokens,
       l_shipdate AS started_at, l_tax > 0 AS has_usage
FROM lineitem""",
    "passes": """
SELECT l_suppkey AS candidate_id, l_linenumber AS pass_no, l_quantity AS seconds,
       1000.0::DOUBLE / l_quantity AS samples_per_second, CAST(floor(l_extendedprice) AS BIGINT) AS output_bytes FROM lineitem""",
    "points": """
SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'hot' ELSE 'run' || s_nationkey END AS run_id, s_suppkey AS node_id, s_suppkey // 2 AS parent_id, s_suppkey AS seq,
       round(q / n, 6) AS throughput, CAST(b AS DOUBLE) AS bytes, s_acctbal > 0 AS feasible
FROM supplier JOIN (SELECT l_suppkey, sum(l_quantity) AS q, sum(CAST(floor(l_extendedprice) AS BIGINT)) AS b, count(*) AS n
                    FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey""",
    "texts": """
SELECT 'doc/' || doc_id || '.txt' AS path, text FROM documents
UNION ALL SELECT 'page/' || page_id || '.txt', html FROM pages
UNION ALL SELECT 'chat/' || conv_id || '/' || turn || '.json', text FROM conversations
UNION ALL SELECT 'config/' || c_custkey || CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN '.bin' ELSE '.toml' END,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'password = "' || c_name || '"'
    WHEN 'HOUSEHOLD' THEN '-----BEGIN PRIVATE KEY-----' || chr(10) || c_name
    WHEN 'BUILDING' THEN 'export KEY=hunter2value ' || c_name || ' hunter2value'
    ELSE 'name = ' || c_name END FROM customer""",
}
