"""Contract validation and inventory queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcheck.functions.columns import area_problem
from fieldcheck.functions.text import SENSITIVE_KEY
from fieldcheck.operators import contracts, inventory
from fieldcheck.plans.experiments import sql_flags
from fieldcheck.plans.registry import Tables, query


def selections(t: Tables) -> DataFrame:
    """Suppliers as fields of a contract: brand scope, size and colour selectors; nation as dataset."""
    s = t.read("supplier")
    picks = F.array(
        F.struct(F.lit("scope").alias("kind"), F.lit("brand").alias("dimension"), F.concat(F.lit("Brand#"), F.col("s_suppkey") % 30).alias("value")),
        F.struct(F.lit("selector").alias("kind"), F.lit("size").alias("dimension"), (F.col("s_suppkey") % 60).cast("string").alias("value")),
        F.struct(F.lit("selector").alias("kind"), F.lit("colour").alias("dimension"), F.lit("red").alias("value")),
        F.struct(F.lit("scope").alias("kind"), F.lit("shape").alias("dimension"), F.lit("round").alias("value")),
    )
    return s.select(
        F.concat(F.lit("d"), F.col("s_nationkey") % 5).alias("dataset"), F.col("s_suppkey").alias("location"), F.explode(picks).alias("_p")
    ).select("dataset", "location", "_p.kind", "_p.dimension", "_p.value")


SELECTIONS = """
sel AS (SELECT 'd' || (s_nationkey % 5) AS dataset, s_suppkey AS location, p.kind, p.dimension, p.value FROM supplier,
   LATERAL (VALUES ('scope', 'brand', 'Brand#' || (s_suppkey % 30)), ('selector', 'size', CAST(s_suppkey % 60 AS VARCHAR)), ('selector', 'colour', 'red'), ('scope', 'shape', 'round')) p(kind, dimension, value)),
opt AS (SELECT DISTINCT 'd' || (p_partkey % 5) AS dataset, o.dimension, o.value FROM part, LATERAL (VALUES ('brand', p_brand), ('size', CAST(p_size AS VARCHAR))) o(dimension, value))"""


@query(
    "option_violations",
    f"""WITH {SELECTIONS}, d AS (SELECT DISTINCT dataset, dimension FROM opt)
        SELECT s.dataset, s.dimension, s.value, s.location, s.kind, CASE WHEN d.dataset IS NOT NULL THEN 'outside_inventory' ELSE 'unsupported_dimension' END AS reason
        FROM sel s LEFT JOIN d ON s.dataset = d.dataset AND s.dimension = d.dimension
        WHERE NOT EXISTS (SELECT 1 FROM opt o WHERE o.dataset = s.dataset AND o.dimension = s.dimension AND o.value = s.value) AND (d.dataset IS NOT NULL OR s.kind = 'selector')""",
)
def option_violations(t: Tables) -> DataFrame:
    options = t.read("part").select(
        F.concat(F.lit("d"), F.col("p_partkey") % 5).alias("dataset"), F.col("p_brand").alias("brand"), F.col("p_size").cast("string").alias("size")
    ).unpivot(["dataset"], ["brand", "size"], "dimension", "value")
    return contracts.option_violations(selections(t), options)


@query(
    "dup_selectors",
    """SELECT l_orderkey AS contract, l_suppkey AS field, 'level' || l_linenumber AS dimension, count(*) AS selectors FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1""",
)
def dup_selectors(t: Tables) -> DataFrame:
    sel = t.read("lineitem").select(
        F.col("l_orderkey").alias("contract"), F.col("l_suppkey").alias("field"), F.concat(F.lit("level"), "l_linenumber").alias("dimension")
    )
    return contracts.duplicate_selectors(sel, ["contract", "field"])


def rules(t: Tables) -> DataFrame:
    """Parts as combination rules of their brand: an allowed type, and sizes where the size is small."""
    size = F.col("p_size").cast("string")
    wide = F.create_map(F.lit("variable"), F.array("p_type"), F.lit("size"), F.array(size, F.concat(size, F.lit("0"))))
    narrow = F.create_map(F.lit("variable"), F.array("p_type"))
    return t.read("part").select(F.col("p_brand").alias("dataset"), F.when(F.col("p_size") > 10, wide).otherwise(narrow).alias("rule"))


RULE_FIELDS = """
f AS (SELECT 'Brand#' || (s_suppkey % 28) AS dataset, s_suppkey AS field, CASE s_nationkey % 3 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'PROMO' ELSE 'LARGE' END AS variable,
        CAST(s_suppkey % 50 AS VARCHAR) AS size FROM supplier)"""


def rule_fields(t: Tables) -> DataFrame:
    n = F.col("s_nationkey") % 3
    variable = F.when(n == 0, "ECONOMY").when(n == 1, "PROMO").otherwise("LARGE")
    return t.read("supplier").select(
        F.concat(F.lit("Brand#"), F.col("s_suppkey") % 28).alias("dataset"),
        F.col("s_suppkey").alias("field"),
        F.create_map(F.lit("variable"), variable, F.lit("size"), (F.col("s_suppkey") % 50).cast("string")).alias("selection"),
    )


@query(
    "rule_allowed",
    f"""WITH {RULE_FIELDS}
        SELECT 'provider' AS form, dataset, field, NOT EXISTS (SELECT 1 FROM part WHERE p_brand = f.dataset) OR EXISTS (SELECT 1 FROM part WHERE p_brand = f.dataset AND p_type = variable
            AND (p_size <= 10 OR CAST(p_size AS VARCHAR) = size OR p_size || '0' = size)) AS allowed FROM f
        UNION ALL SELECT 'compact', dataset, field, EXISTS (SELECT 1 FROM part WHERE p_brand = f.dataset AND p_type = variable AND p_size > 10
            AND (CAST(p_size AS VARCHAR) = size OR p_size || '0' = size)) FROM f""",
)
def rule_allowed(t: Tables) -> DataFrame:
    both = None
    for form, wildcard in (("provider", True), ("compact", False)):
        one = contracts.rule_allowed(rule_fields(t), rules(t), wildcard).withColumn("form", F.lit(form))
        both = one if both is None else both.unionByName(one)
    return both


@query(
    "resolve_defaults",
    """WITH s AS (SELECT c_custkey AS contract, c_nationkey AS dataset, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS pt, CASE WHEN c_acctbal > 5000 THEN '50,-10,40,20' WHEN c_acctbal > 4000 THEN '90,-180,-90,180' END AS area FROM customer),
       d AS (SELECT n_nationkey AS dataset, CASE WHEN n_regionkey = 0 THEN 'a,b' ELSE n_name END AS pd, CASE n_regionkey WHEN 1 THEN '90,-180,-90,180' WHEN 2 THEN '60,0,30,40' END AS ad,
              CASE WHEN n_regionkey < 3 THEN 'n' || n_nationkey END AS grid, CASE WHEN n_regionkey <> 4 THEN n_name END AS name FROM nation)
       SELECT contract, s.dataset, coalesce(pt, pd) AS product_type, coalesce(area, ad, '') AS area, CASE WHEN coalesce(area, ad) IS NULL THEN 'none' WHEN coalesce(area, ad) = '90,-180,-90,180' THEN 'global' ELSE 'custom' END AS coverage,
         CASE WHEN area IS NOT NULL THEN 'contract' WHEN ad IS NOT NULL THEN 'default' ELSE 'none' END AS area_source,
         concat_ws(',', 'dataset_id=' || CASE WHEN contract % 5 = 0 THEN 'own' ELSE name END, 'format=' || CASE WHEN contract % 3 = 0 THEN 'grib' ELSE 'netcdf' END, 'grid=' || grid) AS advanced
       FROM s LEFT JOIN d ON s.dataset = d.dataset""",
)
def resolve_defaults(t: Tables) -> DataFrame:
    box = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    pair = lambda k, v: F.create_map(F.lit(k), v)
    key, region = F.col("c_custkey"), F.col("n_regionkey")
    own = F.when(key % 5 == 0, pair("dataset_id", F.lit("own")))
    scope = t.read("customer").select(
        key.alias("contract"),
        F.col("c_nationkey").alias("dataset"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("product_type"),
        F.when(F.col("c_acctbal") > 5000, box(50, -10, 40, 20)).when(F.col("c_acctbal") > 4000, box(90, -180, -90, 180)).alias("area"),
        F.when(key % 3 == 0, F.map_concat(pair("format", F.lit("grib")), F.coalesce(own, F.create_map().cast("map<string,string>"))))
        .otherwise(own).alias("advanced"),
    )
    values = F.map_concat(pair("format", F.lit("netcdf")), pair("grid", F.concat(F.lit("n"), "n_nationkey")), pair("area", F.lit("x")))
    defaults = t.read("nation").select(
        F.col("n_nationkey").alias("dataset"),
        F.when(region == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array("n_name")).alias("product_default"),
        F.when(region == 1, box(90, -180, -90, 180)).when(region == 2, box(60, 0, 30, 40)).alias("area_default"),
        values.alias("values"),
        F.when(region < 3, F.array(F.lit("format"), F.lit("grid"))).otherwise(F.array(F.lit("format"))).alias("options"),
        F.when(region != 4, F.col("n_name")).alias("dataset_id"),
    )
    entries = F.array_sort(F.transform(F.map_entries("advanced"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return contracts.resolve_defaults(scope, defaults).withColumn("advanced", F.concat_ws(",", entries))


@query(
    "preference_rules",
    """WITH p AS (SELECT l_orderkey AS contract, CASE WHEN l_returnflag = 'N' AND l_linenumber > 4 THEN 'descriptive' ELSE 'ordered' END AS role,
           ['consumer_samples_per_second', 'output_bytes', 'materialization_seconds', 'q_engineering'][l_partkey % 4 + 1] AS objective,
           CASE WHEN (l_partkey % 4 IN (0, 3)) = (l_tax < 0.08) THEN 'maximize' ELSE 'minimize' END AS direction, l_linenumber AS priority FROM lineitem),
       o AS (SELECT contract, objective, count(*) FILTER (role = 'ordered') AS o, count(*) FILTER (role <> 'ordered') AS d,
           count(*) FILTER (role = 'ordered' AND direction <> CASE WHEN objective IN ('consumer_samples_per_second', 'q_engineering') THEN 'maximize' ELSE 'minimize' END) AS w FROM p GROUP BY 1, 2),
       c AS (SELECT contract, CAST(sum(o) AS BIGINT) AS n, max(o) AS mo, max(d) AS md, count(*) FILTER (o > 0 AND d > 0) AS both_, sum(w) AS w FROM o GROUP BY 1),
       k AS (SELECT contract, coalesce(list_sort(list(priority) FILTER (role = 'ordered')), []) AS ps FROM p GROUP BY 1)
       SELECT c.contract, n AS objectives, """
    + sql_flags(
        ("no_objective", "n = 0"),
        ("objective_repeated", "mo > 1"),
        ("descriptive_repeated", "md > 1"),
        ("priority_gap", "n > 0 AND ps <> CAST(range(1, n + 1) AS INTEGER[])"),
        ("direction", "w > 0"),
        ("ordered_and_descriptive", "both_ > 0"),
    )
    + " AS problems FROM c JOIN k ON c.contract = k.contract",
)
def preference_rules(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(n) for n in contracts.DIRECTIONS])
    turn = (F.col("l_partkey") % 4).cast("int")
    up = turn.isin(0, 3) == (F.col("l_tax") < 0.08)
    p = t.read("lineitem").select(
        F.col("l_orderkey").alias("contract"),
        F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") > 4), "descriptive").otherwise("ordered").alias("role"),
        F.element_at(names, turn + 1).alias("objective"),
        F.when(up, "maximize").otherwise("minimize").alias("direction"),
        F.col("l_linenumber").alias("priority"),
    )
    return contracts.preference_problems(p)


@query(
    "area_valid",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'not_numeric' WHEN NOT (-90 <= c_nationkey - 20 AND c_nationkey - 20 <= c_acctbal / 90 AND c_acctbal / 90 <= 90) THEN 'latitude'
         WHEN NOT (c_nationkey * 8.0 - 30 BETWEEN -180 AND 180 AND c_acctbal / 40 BETWEEN -180 AND 180) THEN 'longitude' WHEN c_nationkey * 8.0 - 30 > c_acctbal / 40 THEN 'dateline' ELSE 'ok' END AS reason FROM customer""",
)
def area_valid(t: Tables) -> DataFrame:
    north = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal") / 90)
    return t.read("customer").select(
        "c_custkey",
        area_problem(north, F.col("c_nationkey") * 8.0 - 30, F.col("c_nationkey") - 20.0, F.col("c_acctbal") / 40).alias("reason"),
    )


@query(
    "date_options",
    """WITH r AS (SELECT o_orderkey AS contract, o_orderpriority AS dataset, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_custkey % 40 - 2 AS INTEGER) AS b FROM orders),
       d AS (SELECT contract, dataset, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM r WHERE b >= a),
       x AS (SELECT DISTINCT contract, dataset, u.dimension, u.value FROM d, LATERAL (VALUES ('year', strftime(d, '%Y')), ('month', strftime(d, '%m')), ('day', strftime(d, '%d'))) u(dimension, value)),
       opt AS (SELECT DISTINCT o_orderpriority AS dataset, 'year' AS dimension, strftime(o_orderdate, '%Y') AS value FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'
               UNION SELECT DISTINCT o_orderpriority, 'month', strftime(o_orderdate, '%m') FROM orders WHERE o_orderpriority <> '5-LOW' AND date_part('month', o_orderdate) < 12)
       SELECT contract, dimension, value, 'outside_inventory' AS reason FROM x WHERE (dataset, dimension) IN (SELECT dataset, dimension FROM opt) AND (dataset, dimension, value) NOT IN (SELECT dataset, dimension, value FROM opt)
       UNION ALL SELECT contract, 'date_range', strftime(b, '%Y-%m-%d'), 'end_before_start' FROM r WHERE b < a""",
)
def date_options(t: Tables) -> DataFrame:
    o = t.read("orders").select(
        F.col("o_orderkey").alias("contract"), F.col("o_orderpriority").alias("dataset"), F.col("o_orderdate").cast("date").alias("start_date"), "o_custkey"
    )
    ranges = o.select("contract", "dataset", "start_date", F.date_add("start_date", (F.col("o_custkey") % 40 - 2).cast("int")).alias("end_date"))
    day = F.col("start_date")
    years = o.filter(day < "1998-01-01").select("dataset", F.lit("year").alias("dimension"), F.date_format(day, "yyyy").alias("value"))
    months = o.filter((F.col("dataset") != "5-LOW") & (F.month(day) < 12)).select(
        "dataset", F.lit("month").alias("dimension"), F.date_format(day, "MM").alias("value")
    )
    return contracts.date_option_violations(ranges, years.unionByName(months))


@query(
    "lock_versions",
    """WITH f AS (SELECT c_mktsegment AS slug, md5(CAST(c_nationkey AS VARCHAR)) AS source_hash, CAST(c_acctbal > 0 AS VARCHAR) AS inventory_hash, min(c_custkey) AS first_seq, count(*) AS revisions FROM customer GROUP BY 1, 2, 3)
       SELECT *, row_number() OVER (PARTITION BY slug ORDER BY first_seq) AS version FROM f""",
)
def lock_versions(t: Tables) -> DataFrame:
    revisions = t.read("customer").select(
        F.col("c_mktsegment").alias("slug"),
        F.col("c_custkey").alias("seq"),
        F.md5(F.col("c_nationkey").cast("string")).alias("source_hash"),
        (F.col("c_acctbal") > 0).cast("string").alias("inventory_hash"),
    )
    return contracts.lock_versions(revisions, ["source_hash", "inventory_hash"])


@query(
    "content_hash",
    """SELECT c_custkey, sha256(CAST(to_json({'c_custkey': c_custkey, 'c_mktsegment': c_mktsegment, 'c_name': c_name, 'c_nationkey': c_nationkey}) AS VARCHAR)) AS content_hash FROM customer""",
)
def content_hash(t: Tables) -> DataFrame:
    c = t.read("customer")
    return c.select("c_custkey", contracts.content_hash(c, ["c_name", "c_custkey", "c_mktsegment", "c_nationkey"]).alias("content_hash"))


PROCESS = """'{"inputs":{"variable":{"title":"' || p_name || '","description":"All of ' || p_brand || '","schema":{"type":"array","minItems":1,"items":{"type":"string","maxLength":' || p_size || ',"enum":["' || p_brand || '","' || p_type || '"]}}},"size":{"description":7,"schema":{"type":"integer","default":' || p_size || ',"maximum":50}},"mode":{"schema":{"enum":["fast","' || p_size || '","safe"],"items":{"enum":["only"]}}},"free":{"title":"Free","schema":{"pattern":"^[a-z]+$","default":null}}}}'"""
FORM = """'[{"name":"variable","label":"Pick ' || p_size || '","help":"","type":"StringListWidget","required":true,"details":{"values":["other"]}},{"id":"size","required":false,"details":{"default":99}},{"name":"mode","required":"yes","details":{"default":"fast"}},{"name":"free","required":true,"details":{"values":["a",' || p_size || ']}},{"name":"free","help":"Any","required":' || CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END || '},{"name":"ghost","required":true},5]'"""


@query(
    "extract_options",
    """SELECT p_partkey AS dataset, u.*, CAST(len(string_split(u.options, '|')) AS INTEGER) * CAST(u.options <> '' AS INTEGER) AS option_count FROM part, LATERAL (VALUES
         ('variable', p_name, 'All of ' || p_brand, 'Pick ' || p_size, NULL, 'StringListWidget', true, p_brand || '|' || p_type, NULL, 'items,minItems,type',
          '{"items":{"maxLength":' || p_size || ',"type":"string"},"minItems":1,"type":"array"}', '{"maxLength":' || p_size || ',"type":"string"}'),
         ('size', '', NULL, NULL, NULL, NULL, false, '', CAST(p_size AS VARCHAR), 'maximum,type', '{"maximum":50,"type":"integer"}', NULL),
         ('mode', '', NULL, NULL, NULL, NULL, NULL, 'only', 'fast', '', '{}', NULL),
         ('free', 'Free', NULL, NULL, 'Any', NULL, p_size > 25, 'a|' || p_size, 'null', 'pattern', '{"pattern":"^[a-z]+$"}', NULL)
       ) u(input, title, description, label, help, widget, required, options, default_value, constraints, constraint_values, item_constraints)""",
)
def extract_options(t: Tables) -> DataFrame:
    docs = t.spread("part", "p_partkey").select(F.col("p_partkey").alias("dataset"), F.expr(PROCESS).alias("process"), F.expr(FORM).alias("form"))
    return inventory.extract_options(docs).withColumn("options", F.array_join("options", "|"))


LAYOUT = """'{"body":{"main":[{"type":"text","id":"t' || p_partkey || '"},{"type":"table","id":"main_variables","content":[{"name":"' || p_name || '"},{"name":"' || p_type || '"}]},{"type":"block","blocks":[{"type":"table","id":"' || p_brand || '"}]}],"secret_token":"' || CASE WHEN p_size > 25 THEN p_name ELSE '' END || '","aside":{"api_key":' || CASE WHEN p_size > 40 THEN '{"name":"ENV"}' ELSE '{}' END || ',"monkey":"x"},"deep":' || CASE WHEN p_partkey % 50 = 0 THEN repeat('{"a":', 12) || '{"type":"table","id":"deep","content":[1],"token":"t"}' || repeat('}', 12) ELSE '{}' END || '}}'"""


@query(
    "layout_tables",
    """SELECT p_partkey AS doc, u.table_id, u.path, u.content_rows FROM part, LATERAL (VALUES ('main_variables', '$.body.main[1]', 2), (p_brand, '$.body.main[2].blocks[0]', 0)) u(table_id, path, content_rows)
       UNION ALL SELECT p_partkey, 'deep', '$.body.deep' || repeat('.a', 12), 1 FROM part WHERE p_partkey % 50 = 0""",
)
def layout_tables(t: Tables) -> DataFrame:
    docs = t.spread("part", "p_partkey").select("p_partkey", F.expr(LAYOUT).alias("layout"))
    return inventory.layout_tables(docs, "p_partkey", "layout")


@query(
    "sensitive_keys",
    f"""SELECT p_partkey AS doc, n.fullkey AS path, 'sensitive' AS finding FROM (SELECT p_partkey, {LAYOUT} AS j FROM part), LATERAL (SELECT fullkey, key, CAST(value AS VARCHAR) AS v FROM json_tree(j)) n
        WHERE regexp_matches(coalesce(n.key, ''), '(?i)(^|_)(api_?key|key|token|secret|password|authorization)($|_)') AND v NOT IN ('null', '""', '', '[]', '{{}}')""",
)
def sensitive_keys(t: Tables) -> DataFrame:
    docs = t.spread("part", "p_partkey").select("p_partkey", F.expr(LAYOUT).alias("layout"))
    return inventory.sensitive_keys(docs, "p_partkey", "layout")


@query(
    "label_merge",
    """WITH f AS (SELECT p_partkey AS option, p_partkey AS pos, p_name || ' ' || p_brand AS label FROM part),
       o AS (SELECT regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') AS k, arg_max(option, pos) AS option FROM f GROUP BY 1),
       l AS (SELECT regexp_replace(lower(upper(p_name) || ' - ' || p_brand), '[^a-z0-9]+', '', 'g') AS k, arg_max(p_type, p_partkey) FILTER (p_size > 20) AS units, arg_max(p_name, p_partkey) AS description FROM part GROUP BY 1)
       SELECT f.option, f.label, l.units, l.description FROM f LEFT JOIN o ON f.option = o.option LEFT JOIN l ON o.k = l.k""",
)
def label_merge(t: Tables) -> DataFrame:
    p = t.read("part")
    form = p.select(
        F.col("p_partkey").alias("option"), F.col("p_partkey").alias("pos"), F.concat_ws(" ", "p_name", "p_brand").alias("label")
    )
    layout = p.select(
        F.col("p_partkey").alias("pos"),
        F.concat(F.upper("p_name"), F.lit(" - "), "p_brand").alias("name"),
        F.when(F.col("p_size") > 20, F.col("p_type")).otherwise("").alias("units"),
        F.col("p_name").alias("description"),
    )
    return inventory.merge_labels(form, layout)


@query(
    "availability",
    """SELECT p_brand AS dataset, count(*) AS rule_count, CASE WHEN max(p_size) > 10 THEN 'size,variable' ELSE 'variable' END AS rule_keys FROM part GROUP BY 1""",
)
def availability(t: Tables) -> DataFrame:
    return inventory.availability(rules(t))


HREF = 'href="([^"]*)"'


@query(
    "link_union",
    f"""WITH a AS (SELECT page_id, 0 AS group_no, 'nav' AS rel, unnest(regexp_extract_all(html, '{HREF}', 1)) AS href, generate_subscripts(regexp_extract_all(html, '{HREF}', 1), 1) - 1 AS pos FROM pages),
        b AS (SELECT page_id, 1 AS group_no, rel, lower(href) AS href, pos FROM a UNION ALL SELECT * FROM a)
        SELECT page_id, rel, CASE WHEN href <> '' THEN href END AS href, arg_min(group_no, group_no * 100000 + pos) AS group_no, CAST(arg_min(pos, group_no * 100000 + pos) AS INTEGER) AS pos, count(*) AS copies FROM b GROUP BY 1, 2, 3""",
)
def link_union(t: Tables) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(HREF), F.lit(1))
    first = t.read("pages").select("page_id", F.posexplode(found).alias("pos", "href")).withColumns(
        {"group_no": F.lit(0), "rel": F.lit("nav")}
    )
    second = first.withColumns({"group_no": F.lit(1), "href": F.lower("href")})
    return inventory.merge_links(first.unionByName(second), ["page_id"])


@query(
    "route_source",
    """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages)
       SELECT page_id, CASE WHEN suffix(host, '.example.com') AND regexp_matches(path, '/en/([^/?#]+)') THEN 'process_metadata' ELSE 'minimal_manual_inventory' END AS extractor,
         CASE WHEN suffix(host, '.example.com') AND regexp_matches(path, '/en/([^/?#]+)') THEN regexp_extract(path, '/en/([^/?#]+)', 1) ELSE '' END AS dataset_id FROM p""",
)
def route_source(t: Tables) -> DataFrame:
    extractor, dataset = inventory.route_source(F.col("url"), ("*.example.com",), "/en/([^/?#]+)")
    return t.read("pages").select("page_id", extractor.alias("extractor"), dataset.alias("dataset_id"))
