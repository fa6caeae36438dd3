"""Pareto and search-order queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcheck.operators import pareto
from fieldcheck.plans.registry import Tables, query
from fieldcheck.session import pinned

OBJECTIVES = (pareto.Objective("throughput", True, 0.25, 0.005), pareto.Objective("bytes", False, 65536.0, 0.005))


def better(a: str, b: str) -> str:
    return f"({a}.throughput - {b}.throughput > greatest(0.25, abs({b}.throughput) * 0.005) OR {b}.bytes - {a}.bytes > greatest(65536, abs({b}.bytes) * 0.005))"


def worse(a: str, b: str) -> str:
    return f"({b}.throughput - {a}.throughput > greatest(0.25, abs({b}.throughput) * 0.005) OR {a}.bytes - {b}.bytes > greatest(65536, abs({b}.bytes) * 0.005))"


def beats(a: str, b: str) -> str:
    return f"({better(a, b)} AND NOT {worse(a, b)})"


@query(
    "pareto_pairs",
    f"""SELECT c.node_id, c.parent_id, CASE WHEN {better("c", "p")} AND NOT {worse("c", "p")} THEN 'dominates' WHEN {worse("c", "p")} AND NOT {better("c", "p")} THEN 'dominated'
          WHEN {better("c", "p")} THEN 'tradeoff' ELSE 'equivalent' END AS relation FROM points c JOIN points p ON c.parent_id = p.node_id WHERE c.node_id <> c.parent_id""",
)
def pareto_pairs(t: Tables) -> DataFrame:
    return pareto.parent_relations(t.points(), OBJECTIVES)


@query(
    "parent_changes",
    """SELECT c.node_id, c.parent_id, round((c.throughput - p.throughput) / greatest(abs(p.throughput), 1e-12), 9) AS throughput_change, round(-(c.bytes - p.bytes) / greatest(abs(p.bytes), 1e-12), 9) AS bytes_change
       FROM points c JOIN points p ON c.parent_id = p.node_id WHERE c.node_id <> c.parent_id""",
)
def parent_changes(t: Tables) -> DataFrame:
    out = pareto.parent_changes(t.points(), OBJECTIVES)
    return out.withColumns({f"{o.name}_change": F.round(f"{o.name}_change", 9) for o in OBJECTIVES})


def streak_nodes(t: Tables) -> DataFrame:
    return t.points().withColumn("admitted", F.col("feasible") & (F.col("throughput") > 25.5))


@query(
    "stagnation",
    """WITH n AS (SELECT *, feasible AND throughput > 25.5 AS admitted FROM points),
       m AS (SELECT policy, n.*, CASE WHEN admitted THEN 0 WHEN policy = 'archive' OR feasible THEN 1 ELSE 0 END AS miss FROM n, (VALUES ('greedy'), ('archive')) p(policy)),
       i AS (SELECT *, sum(CAST(admitted AS INTEGER)) OVER (PARTITION BY policy, run_id ORDER BY seq) AS island FROM m)
       SELECT policy, run_id, node_id, seq, CAST(sum(miss) OVER (PARTITION BY policy, run_id, island ORDER BY seq) AS BIGINT) AS streak FROM i""",
)
def stagnation(t: Tables) -> DataFrame:
    nodes = streak_nodes(t)
    greedy = pareto.stagnation(nodes, count_infeasible=False).withColumn("policy", F.lit("greedy"))
    return greedy.unionByName(pareto.stagnation(nodes, count_infeasible=True).withColumn("policy", F.lit("archive")))


@query(
    "pareto_archive",
    f"""WITH RECURSIVE n AS (SELECT run_id, node_id, throughput, bytes, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS pos FROM points),
        f AS (SELECT run_id, pos, node_id, true AS admitted, [{{'node_id': node_id, 'throughput': throughput, 'bytes': bytes}}] AS members FROM n WHERE pos = 1
          UNION ALL SELECT c.run_id, c.pos, c.node_id, len(list_filter(f.members, lambda m: NOT {better("c", "m")})) = 0,
            CASE WHEN len(list_filter(f.members, lambda m: NOT {better("c", "m")})) = 0
                 THEN list_concat(list_filter(f.members, lambda m: NOT {beats("c", "m")}), [{{'node_id': c.node_id, 'throughput': c.throughput, 'bytes': c.bytes}}]) ELSE f.members END
          FROM f JOIN n c ON c.run_id = f.run_id AND c.pos = f.pos + 1),
        l AS (SELECT run_id, list_transform(arg_max(members, pos), lambda m: m.node_id) AS ids FROM f GROUP BY 1)
        SELECT f.run_id, f.node_id, f.admitted, list_contains(l.ids, f.node_id) AS in_archive FROM f JOIN l ON f.run_id = l.run_id""",
)
def pareto_archive(t: Tables) -> DataFrame:
    return pareto.pareto_archive(t.points(), OBJECTIVES)


@query(
    "pareto_front1",
    f"""SELECT run_id, node_id FROM points b WHERE NOT EXISTS (SELECT 1 FROM points a WHERE a.run_id = b.run_id AND {beats("a", "b")})""",
)
def pareto_front1(t: Tables) -> DataFrame:
    return pareto.first_front(t.points(), OBJECTIVES)


FRONTS = f"""
dom AS (SELECT a.run_id, a.node_id AS a, b.node_id AS b FROM points a JOIN points b ON a.run_id = b.run_id AND {beats("a", "b")}),
layers AS (SELECT run_id, node_id, CAST(1 AS BIGINT) AS depth FROM points UNION SELECT l.run_id, dom.b, l.depth + 1 FROM layers l JOIN dom ON dom.run_id = l.run_id AND dom.a = l.node_id),
fronts AS (SELECT run_id, node_id, max(depth) AS front FROM layers GROUP BY 1, 2)"""


@query("pareto_fronts", f"WITH RECURSIVE {FRONTS} SELECT run_id, node_id, front FROM fronts")
def pareto_fronts(t: Tables) -> DataFrame:
    return pareto.pareto_fronts(t.points(), OBJECTIVES)


LEXI = "lexi AS (SELECT run_id, node_id, row_number() OVER (PARTITION BY run_id ORDER BY throughput DESC, bytes, node_id) AS rank FROM points)"


@query("lexi_rank", f"WITH {LEXI} SELECT run_id, node_id, rank FROM lexi")
def lexi_rank(t: Tables) -> DataFrame:
    return pareto.lexicographic_rank(t.points(), OBJECTIVES)


WIDTH = 3


def dist(a: str, b: str) -> str:
    return f"(abs({a}.throughput - {b}.throughput) / sc.st + abs({a}.bytes - {b}.bytes) / sc.sb)"


@query(
    "branch_seeds",
    f"""WITH RECURSIVE {FRONTS}, {LEXI},
        scale AS (SELECT run_id, greatest(max(throughput) - min(throughput), 1e-12) AS st, greatest(max(bytes) - min(bytes), 1e-12) AS sb FROM points GROUP BY 1),
        s1 AS (SELECT p.* FROM points p JOIN lexi l ON p.run_id = l.run_id AND p.node_id = l.node_id WHERE l.rank = 1),
        r2 AS (SELECT p.*, row_number() OVER (PARTITION BY p.run_id ORDER BY {dist("p", "s1")} DESC, front, p.node_id) AS r FROM points p JOIN s1 ON p.run_id = s1.run_id JOIN scale sc ON p.run_id = sc.run_id JOIN fronts f ON f.node_id = p.node_id AND f.run_id = p.run_id WHERE p.node_id <> s1.node_id),
        s2 AS (SELECT * FROM r2 WHERE r = 1),
        r3 AS (SELECT p.*, row_number() OVER (PARTITION BY p.run_id ORDER BY least({dist("p", "s1")}, {dist("p", "s2")}) DESC, front, p.node_id) AS r FROM points p JOIN s1 ON p.run_id = s1.run_id JOIN s2 ON p.run_id = s2.run_id JOIN scale sc ON p.run_id = sc.run_id JOIN fronts f ON f.node_id = p.node_id AND f.run_id = p.run_id WHERE p.node_id NOT IN (s1.node_id, s2.node_id))
        SELECT run_id, node_id, 1 AS step FROM s1 UNION ALL SELECT run_id, node_id, 2 FROM s2 UNION ALL SELECT run_id, node_id, 3 FROM r3 WHERE r = 1""",
)
def branch_seeds(t: Tables) -> DataFrame:
    # every step reads the points; pinned, the lines are folded once
    points = pinned(t.points())
    best = pareto.lexicographic_rank(points, OBJECTIVES).filter(F.col("rank") == 1)
    return pareto.branch_seeds(points, pareto.pareto_fronts(points, OBJECTIVES), best, OBJECTIVES, WIDTH)


@query(
    "medoid",
    """WITH m AS (SELECT run_id, median(throughput) AS mt, median(bytes) AS mb FROM points GROUP BY 1),
       d AS (SELECT p.run_id, node_id, round(abs(throughput - mt) / greatest(abs(mt), 1e-12) + abs(bytes - mb) / greatest(abs(mb), 1e-12), 12) AS distance FROM points p JOIN m ON p.run_id = m.run_id)
       SELECT run_id, node_id, round(distance, 9) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY distance, node_id) = 1""",
)
def medoid(t: Tables) -> DataFrame:
    return pareto.medoid(t.points(), [o.name for o in OBJECTIVES]).withColumn("distance", F.round("distance", 9))


@query(
    "focus_schedule",
    """WITH q AS (SELECT c_nationkey AS run_id, count(*) FILTER (c_mktsegment = 'MACHINERY') AS t, count(*) FILTER (c_mktsegment = 'BUILDING') AS f, count(*) FILTER (c_mktsegment = 'FURNITURE') AS j FROM customer GROUP BY 1),
       s AS (SELECT run_id, 'throughput' AS focus, k // 2 AS c, k % 2 * 2 AS turn FROM q, LATERAL (SELECT unnest(range(0, t)) AS k)
             UNION ALL SELECT run_id, 'footprint', k, 1 FROM q, LATERAL (SELECT unnest(range(0, f)) AS k) UNION ALL SELECT run_id, 'joint', k, 3 FROM q, LATERAL (SELECT unnest(range(0, j)) AS k))
       SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY c, turn) AS iteration, focus, CASE focus WHEN 'throughput' THEN 'consumer_samples_per_second' WHEN 'footprint' THEN 'output_bytes' ELSE 'consumer_samples_per_second,output_bytes' END AS targets FROM s""",
)
def focus_schedule(t: Tables) -> DataFrame:
    seg = F.col("c_mktsegment")
    quotas = t.read("customer").groupBy(F.col("c_nationkey").alias("run_id")).agg(
        F.count_if(seg == "MACHINERY").alias("throughput"),
        F.count_if(seg == "BUILDING").alias("footprint"),
        F.count_if(seg == "FURNITURE").alias("joint"),
    )
    return pareto.focus_schedule(quotas)
