"""Provider metadata: option lists, defaults, labels, links, nested documents, routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcheck.functions.columns import label_key
from fieldcheck.functions.text import SENSITIVE_KEY
from fieldcheck.session import pinned

# Schema keys kept as constraints, hosts and path mark of the catalogue extractor.
CONSTRAINT_KEYS = (
    "type", "items", "minItems", "maxItems", "minimum", "maximum", "minLength", "maxLength", "format", "pattern",
)
CATALOGUE_HOSTS = ("ads.atmosphere.copernicus.eu", "cds.climate.copernicus.eu")
CATALOGUE_PATH = "/datasets/([^/?#]+)"

def _part(node: Column, path: str) -> Column:
    """What lies at a path of a variant, as a variant; null only where the key is absent."""
    return F.try_variant_get(node, path, "variant")


def _typed(node: Column, path: str, kind: str) -> Column:
    """The value at a path if it has this type by itself; a number is no text and "yes" is no flag."""
    return F.when(F.schema_of_variant(_part(node, path)) == kind.upper(), F.try_variant_get(node, path, kind))


def _bare(node: Column) -> Column:
    """Text of a variant: texts without quotes, everything else as JSON."""
    return F.when(F.schema_of_variant(node) == "STRING", F.try_variant_get(node, "$", "string")).otherwise(F.to_json(node))


def _listed(node: Column, path: str) -> Column:
    return F.transform(F.try_variant_get(node, path, "array<variant>"), _bare)


def _members(found: Column, leave_out: str) -> Column:
    """JSON text of a map of variants without one key, its keys in order; null where there is no map or nothing is left."""
    names = F.sort_array(F.filter(F.map_keys(found), lambda k: k != leave_out))
    pairs = F.transform(names, lambda k: F.concat(F.lit('"'), k, F.lit('":'), F.to_json(F.element_at(found, k))))
    return F.when(F.size(names) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))


def _last(fields: Column, take) -> Column:
    """What the last of the form's fields says that says anything."""
    return F.try_element_at(F.array_compact(F.transform(fields, take)), F.lit(-1))


def _first(fields: Column, take) -> Column:
    return F.get(F.array_compact(F.transform(fields, take)), 0)


def extract_options(docs: DataFrame) -> DataFrame:
    """One row per input of docs(dataset, process[, form]), JSON texts, with all that is declared of it.

    Options are the item enum, else the enum, else the values of the form; the default is the schema's, else the
    form's. constraints names the rules, constraint_values holds them as JSON in the order of their names;
    item_constraints is the rule of the items without its enum, which alone is no constraint. A form's field belongs to the
    input of its name (or id); of several the last one tells label, help, widget and required. Null
    documents, and those without an object of inputs, have no rows.
    """
    form = F.col("form") if "form" in docs.columns else F.lit(None).cast("string")
    parsed = docs.select("dataset", F.try_parse_json("process").alias("_p"), F.try_parse_json(form).alias("_f"))
    inputs = parsed.select(
        "dataset",
        F.try_variant_get("_f", "$", "array<variant>").alias("_f"),
        F.explode(F.try_variant_get("_p", "$.inputs", "map<string,variant>")).alias("input", "_s"),
    )
    named = lambda f: F.coalesce(F.nullif(_typed(f, "$.name", "string"), F.lit("")), _typed(f, "$.id", "string"))
    own = inputs.withColumns(
        {
            "_f": F.filter("_f", lambda f: named(f) == F.col("input")),
            "_items": F.try_variant_get("_s", "$.schema.items", "map<string,variant>"),
            "_enum": F.coalesce(_listed(F.col("_s"), "$.schema.items.enum"), _listed(F.col("_s"), "$.schema.enum")),
        }
    )
    s, fields, options = F.col("_s"), F.col("_f"), F.col("_enum")
    offered = F.get(F.filter(F.transform(fields, lambda f: _listed(f, "$.details.values")), lambda v: F.size(v) > 0), 0)
    none = F.array().cast("array<string>")
    options = F.when(F.size(options) > 0, options).otherwise(F.coalesce(offered, none))

    items = _members(F.col("_items"), "enum")
    plain = F.col("_items").isNull()
    rule = {k: F.to_json(_part(s, f"$.schema.{k}")) for k in sorted(CONSTRAINT_KEYS)}
    rule["items"] = F.when(plain, rule["items"]).otherwise(items)
    kept = lambda piece: F.array_join(F.array_compact(F.array(*[F.when(v.isNotNull(), piece(k, v)) for k, v in rule.items()])), ",")
    said = lambda path: _last(fields, lambda f: F.nullif(_typed(f, path, "string"), F.lit("")))
    default = F.coalesce(_part(s, "$.schema.default"), _first(fields, lambda f: _part(f, "$.details.default")))
    return own.select(
        "dataset",
        "input",
        F.coalesce(_typed(s, "$.title", "string"), F.lit("")).alias("title"),
        _typed(s, "$.description", "string").alias("description"),
        said("$.label").alias("label"),
        said("$.help").alias("help"),
        said("$.type").alias("widget"),
        _last(fields, lambda f: _typed(f, "$.required", "boolean")).alias("required"),
        options.alias("options"),
        F.size(options).alias("option_count"),
        _bare(default).alias("default_value"),
        kept(lambda k, v: F.lit(k)).alias("constraints"),
        F.concat(F.lit("{"), kept(lambda k, v: F.concat(F.lit(f'"{k}":'), v)), F.lit("}")).alias("constraint_values"),
        items.alias("item_constraints"),
    )


def _children(path: Column, node: Column) -> Column:
    """Direct children of a variant as (path, key, node) structs; none for a scalar."""
    child = lambda p, k, v: F.struct(p.alias("path"), k.alias("key"), v.alias("node"))
    named = F.transform(
        F.map_entries(F.try_variant_get(node, "$", "map<string,variant>")),
        lambda e: child(F.concat(path, F.lit("."), e["key"]), e["key"], e["value"]),
    )
    listed = F.transform(
        F.try_variant_get(node, "$", "array<variant>"),
        lambda v, i: child(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), F.lit(None).cast("string"), v),
    )
    return F.coalesce(named, listed)


def json_nodes(docs: DataFrame, doc: str, json: str, wanted: Column | None = None) -> DataFrame:
    """Nodes of JSON documents, the root included, as (doc, path, key, node variant): all, or those that are `wanted`.

    Round by round the open containers, and only they, give their children, until none is open: there
    is no limit of depth, and a round costs what that level holds. Each level is checkpointed once, without
    the scalars that nobody wants.
    """
    level = docs.select(
        F.col(doc).alias("doc"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("key"), F.parse_json(json).alias("node")
    )
    wanted = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    kind = F.schema_of_variant("node")
    is_open = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    out = None
    while True:
        level = pinned(level.filter(is_open | wanted))
        found = level.filter(wanted)
        out = found if out is None else out.unionByName(found)
        open_ = level.filter(is_open)
        if open_.isEmpty():
            return out
        below = open_.select("doc", F.explode(_children(F.col("path"), F.col("node"))).alias("n"))
        level = below.select("doc", "n.path", "n.key", "n.node")


def sensitive_keys(docs: DataFrame, doc: str, json: str) -> DataFrame:
    """Paths whose key looks like a credential and whose value is not empty, at any depth."""
    empty = F.to_json("node").isin("null", '""', "[]", "{}")
    named = json_nodes(docs, doc, json, F.coalesce(F.col("key"), F.lit("")).rlike(SENSITIVE_KEY) & ~empty)
    return named.select("doc", "path", F.lit("sensitive").alias("finding"))


def layout_tables(docs: DataFrame, doc: str, json: str) -> DataFrame:
    """Nodes of type 'table' with a text id at any depth, and how many rows of content they carry."""
    kind = F.try_variant_get("node", "$.type", "string")
    ident = F.try_variant_get("node", "$.id", "string")
    rows = F.coalesce(F.size(F.try_variant_get("node", "$.content", "array<variant>")), F.lit(0))
    return json_nodes(docs, doc, json, (kind == "table") & ident.isNotNull()).select(
        "doc", ident.alias("table_id"), "path", F.when(rows < 0, 0).otherwise(rows).alias("content_rows")
    )


def merge_labels(form: DataFrame, layout: DataFrame) -> DataFrame:
    """Units and descriptions of layout rows put on form options by their reduced label.

    form(pos, option, label), layout(pos, name, units, description). The last option of a label
    owns it, the last non-empty text wins; both are folded before the join.
    """
    owner = form.groupBy(label_key(F.col("label")).alias("_k")).agg(F.max_by("option", "pos").alias("option"))
    last = lambda c: F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("pos")))
    facts = layout.groupBy(label_key(F.col("name")).alias("_k")).agg(
        last("units").alias("units"), last("description").alias("description")
    )
    owned = owner.join(facts, "_k").select("option", "units", "description")
    return form.join(owned, "option", "left").select("option", "label", "units", "description")


def availability(rules: DataFrame) -> DataFrame:
    """Rule count and sorted distinct rule keys per dataset of rules(dataset, rule map)."""
    counts = rules.groupBy("dataset").agg(F.count(F.lit(1)).alias("rule_count"))
    keys = rules.select("dataset", F.explode(F.map_keys("rule")).alias("key")).distinct()
    named = keys.groupBy("dataset").agg(F.array_join(F.sort_array(F.collect_list("key")), ",").alias("rule_keys"))
    return counts.join(named, "dataset", "left").withColumn("rule_keys", F.coalesce("rule_keys", F.lit("")))


def merge_links(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First link of each (rel, href) over ordered groups; empty texts count as absent."""
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    return (
        links.withColumns({"rel": text("rel"), "href": text("href")})
        .groupBy(*keys, "rel", "href")
        .agg(F.min(F.struct("group_no", "pos")).alias("_first"), F.count(F.lit(1)).alias("copies"))
        .select(*keys, "rel", "href", "_first.group_no", "_first.pos", "copies")
    )


def route_source(url: Column, hosts: Sequence[str] = CATALOGUE_HOSTS, pattern: str = CATALOGUE_PATH) -> tuple[Column, Column]:
    """(extractor, dataset id) of a source URL; unknown sources fall back to the manual extractor."""
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    known = F.lit(False)
    for h in hosts:
        known = known | ((host == h) if not h.startswith("*") else host.endswith(h[1:]))
    known = known & path.rlike(pattern)
    return (
        F.when(known, "process_metadata").otherwise("minimal_manual_inventory"),
        F.when(known, F.regexp_extract(path, pattern, 1)).otherwise(""),
    )
