"""Contract validation against an inventory, defaults and lock versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcheck.functions.columns import flags
from fieldcheck.operators.ordered import ranked


def option_violations(selection: DataFrame, options: DataFrame) -> DataFrame:
    """Selected values outside the inventory's list.

    selection(dataset, location, kind, dimension, value), options(dataset, dimension, value). A
    dimension without a list is free for scope entries and an error for selectors. Values compare
    as text.
    """
    listed = options.select("dataset", "dimension").distinct().withColumn("_listed", F.lit(True))
    allowed = options.select("dataset", "dimension", F.col("value").cast("string").alias("value")).distinct()
    outside = selection.withColumn("value", F.col("value").cast("string")).join(
        allowed, ["dataset", "dimension", "value"], "left_anti"
    )
    marked = outside.join(listed, ["dataset", "dimension"], "left")
    reason = F.when(F.col("_listed"), "outside_inventory").when(
        F.col("kind") == "selector", "unsupported_dimension"
    )
    return marked.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("_listed")


def duplicate_selectors(selection: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dimensions that one field selects more than once."""
    return (
        selection.groupBy(*keys, "dimension")
        .agg(F.count(F.lit(1)).alias("selectors"))
        .filter(F.col("selectors") > 1)
    )


def rule_allowed(fields: DataFrame, rules: DataFrame, absent_is_wildcard: bool = True) -> DataFrame:
    """Whether some rule of the dataset allows every selected value of a field.

    fields(dataset, field, selection map<string,string>), rules(dataset, rule map<string,array>). A
    dimension absent from a rule is a wildcard for provider rules and a mismatch for compact ones; a
    dataset without provider rules allows everything, without compact rules nothing.

    Rules are indexed by (dataset, their dimensions, dimension, value). A selection is looked up once for each
    set of dimensions its dataset has, by that of its values which the fewest rules list; only these rules
    are read and compared. Selections that repeat are looked up once, and so are repeated rules.
    """
    entries = lambda c: F.array_sort(F.map_entries(c))
    known = rules.select(
        F.col("dataset").alias("_d"), F.array_sort(F.map_keys("rule")).alias("_dims"), F.xxhash64(entries("rule")).alias("_rule"), "rule"
    ).dropDuplicates(["_d", "_dims", "_rule"])
    listed = known.select("_d", "_dims", "_rule", F.explode("rule").alias("_dim", "_values"))
    listed = listed.select("_d", "_dims", "_rule", "_dim", F.explode(F.array_distinct("_values")).alias("_value"))
    sizes = listed.groupBy("_d", "_dims", "_dim", "_value").agg(F.count(F.lit(1)).alias("_n"))
    named = fields.select("dataset", "field", "selection", F.xxhash64(entries("selection")).alias("_sel"))
    asked = named.select(F.col("dataset").alias("_d"), "_sel", "selection").dropDuplicates(["_d", "_sel"])
    shapes = asked.join(known.select("_d", "_dims").distinct(), "_d").withColumn(
        "_bound", F.array_intersect(F.map_keys("selection"), "_dims")
    )
    if not absent_is_wildcard:
        shapes = shapes.filter(F.size("_bound") == F.size("selection"))
    free = shapes.filter(F.size("_bound") == 0).select("_d", "_sel")
    each = shapes.select("_d", "_sel", "_dims", "selection", F.explode("_bound").alias("_dim"))
    each = each.withColumn("_value", F.try_element_at("selection", F.col("_dim")))
    rarest = (
        each.join(sizes, ["_d", "_dims", "_dim", "_value"], "left")
        .groupBy("_d", "_sel", "_dims")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_dim", "_value")).alias("_m"), F.first("selection").alias("selection"))
        .filter("_m.n > 0")
        .select("_d", "_sel", "_dims", "selection", "_m._dim", "_m._value")
    )
    met = rarest.join(listed, ["_d", "_dims", "_dim", "_value"]).join(known, ["_d", "_dims", "_rule"])
    fits = F.forall(
        F.map_entries("selection"),
        lambda e: ~F.map_contains_key(F.col("rule"), e["key"])
        | F.coalesce(F.array_contains(F.try_element_at(F.col("rule"), e["key"]), e["value"]), F.lit(False)),
    )
    ok = met.filter(fits).select("_d", "_sel").unionByName(free).distinct()
    ok = ok.select(F.col("_d").alias("dataset"), "_sel", F.lit(True).alias("_ok"))
    ruled = rules.select("dataset").distinct().withColumn("_ruled", F.lit(True))
    return (
        named.select("dataset", "field", "_sel")
        .join(ok, ["dataset", "_sel"], "left")
        .join(ruled, "dataset", "left")
        .select(
            "dataset",
            "field",
            F.coalesce("_ok", F.col("_ruled").isNull() & F.lit(absent_is_wildcard)).alias("allowed"),
        )
    )


def resolve_defaults(scope: DataFrame, defaults: DataFrame) -> DataFrame:
    """Missing scope entries and advanced options filled from inventory defaults.

    scope(contract, dataset, product_type, area array, advanced map), defaults(dataset, product_default array,
    area_default array, values map, options array, dataset_id). A default list of one product unwraps to
    its element. Of the other defaults those that name an option of the dataset fill the advanced options; the
    inventory's dataset_id is added unless an option of that name is there. What the contract says stays.
    """
    one = F.when(F.size("product_default") == 1, F.element_at("product_default", 1)).otherwise(
        F.concat_ws(",", "product_default")
    )
    whole = F.array(*[F.lit(float(v)) for v in (90, -180, -90, 180)])
    area = F.coalesce("area", "area_default")
    none = F.create_map().cast("map<string,string>")
    filled = scope.join(defaults, "dataset", "left").withColumn("_given", F.coalesce("advanced", none))
    open_ = F.map_filter(
        F.coalesce("values", none),
        lambda k, _: F.coalesce(F.array_contains("options", k), F.lit(False)) & ~F.map_contains_key("_given", k),
    )
    filled = filled.withColumn("_options", F.map_concat("_given", open_))
    named = (F.length("dataset_id") > 0) & ~F.map_contains_key("_options", "dataset_id")
    identity = F.when(named, F.create_map(F.lit("dataset_id"), "dataset_id")).otherwise(none)
    return filled.select(
        "contract",
        "dataset",
        F.coalesce("product_type", one).alias("product_type"),
        F.concat_ws(",", F.transform(area, lambda v: v.cast("int").cast("string"))).alias("area"),
        F.when(area.isNull(), "none").when(area == whole, "global").otherwise("custom").alias("coverage"),
        F.when(F.col("area").isNotNull(), "contract")
        .when(F.col("area_default").isNotNull(), "default")
        .otherwise("none")
        .alias("area_source"),
        F.map_concat("_options", identity).alias("advanced"),
    )


# Direction each objective must have.
DIRECTIONS = {
    "consumer_samples_per_second": "maximize",
    "output_bytes": "minimize",
    "materialization_seconds": "minimize",
    "q_engineering": "maximize",
}


def by_objective(objective: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, direction in DIRECTIONS.items():
        out = F.when(objective == name, direction).otherwise(out)
    return out


def preference_problems(preferences: DataFrame) -> DataFrame:
    """Problems per contract of preferences(contract, role ordered|descriptive, objective, direction, priority).

    Folded per (contract, objective) first, so every later count is over at most four objectives.
    """
    ordered = F.col("role") == "ordered"
    per_objective = preferences.groupBy("contract", "objective").agg(
        F.count_if(ordered).alias("_o"),
        F.count_if(~ordered).alias("_d"),
        F.count_if(ordered & (F.col("direction") != by_objective(F.col("objective")))).alias("_w"),
        F.min(F.when(ordered, F.col("priority"))).alias("_lo"),
        F.max(F.when(ordered, F.col("priority"))).alias("_hi"),
        F.sum(F.when(ordered, F.col("priority"))).alias("_sum"),
        F.sum(F.when(ordered, F.col("priority") * F.col("priority"))).alias("_sq"),
    )
    n = F.col("n")
    contiguous = (
        (F.col("lo") == 1)
        & (F.col("hi") == n)
        & (F.col("total") * 2 == n * (n + 1))
        & (F.col("squares") * 6 == n * (n + 1) * (2 * n + 1))
    )
    return (
        per_objective.groupBy("contract")
        .agg(
            F.sum("_o").alias("n"),
            F.max("_o").alias("most"),
            F.max("_d").alias("most_d"),
            F.count_if((F.col("_o") > 0) & (F.col("_d") > 0)).alias("both"),
            F.sum("_w").alias("wrong"),
            F.min("_lo").alias("lo"),
            F.max("_hi").alias("hi"),
            F.sum("_sum").alias("total"),
            F.sum("_sq").alias("squares"),
        )
        .select(
            "contract",
            n.alias("objectives"),
            flags(
                ("no_objective", n == 0),
                ("objective_repeated", F.col("most") > 1),
                ("descriptive_repeated", F.col("most_d") > 1),
                ("priority_gap", (n > 0) & ~contiguous),
                ("direction", F.col("wrong") > 0),
                ("ordered_and_descriptive", F.col("both") > 0),
            ).alias("problems"),
        )
    )


def date_option_violations(ranges: DataFrame, options: DataFrame) -> DataFrame:
    """Year, month and day texts of a date range that the inventory does not list.

    Days are folded to the distinct texts within the row of their range before they meet the
    options. A range that ends before it starts is reported as such.
    """
    good = ranges.filter(F.col("end_date") >= F.col("start_date"))
    years = F.transform(
        F.sequence(F.year("start_date"), F.year("end_date")), lambda y: F.lpad(y.cast("string"), 4, "0")
    )
    each_month = F.sequence(F.trunc("start_date", "MM"), F.col("end_date"), F.expr("INTERVAL 1 MONTH"))
    months = F.array_distinct(F.transform(each_month, lambda d: F.date_format(d, "MM")))
    numbers = F.array_distinct(F.transform(F.sequence("start_date", "end_date"), lambda d: F.day(d)))
    days = F.transform(numbers, lambda d: F.lpad(d.cast("string"), 2, "0"))
    entries = lambda name, values: F.transform(
        values, lambda v: F.struct(F.lit(name).alias("dimension"), v.alias("value"))
    )
    every = F.concat(entries("year", years), entries("month", months), entries("day", days))
    texts = good.select("contract", "dataset", F.explode(every).alias("_e")).select(
        "contract", "dataset", "_e.dimension", "_e.value"
    )
    picked = texts.select(
        "dataset", F.col("contract").alias("location"), F.lit("scope").alias("kind"), "dimension", "value"
    )
    outside = option_violations(picked, options).select(
        F.col("location").alias("contract"), "dimension", "value", "reason"
    ).distinct()
    reversed_ = ranges.filter(F.col("end_date") < F.col("start_date")).select(
        "contract",
        F.lit("date_range").alias("dimension"),
        F.date_format("end_date", "yyyy-MM-dd").alias("value"),
        F.lit("end_before_start").alias("reason"),
    )
    return outside.unionByName(reversed_)


def lock_versions(revisions: DataFrame, content: Sequence[str]) -> DataFrame:
    """Version per distinct content of a slug, numbered by first appearance.

    revisions(slug, seq, content...). Repeated content reuses its version, so revisions are folded
    to (slug, content) before they are numbered.
    """
    first = revisions.groupBy("slug", *content).agg(
        F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("revisions")
    )
    return ranked(first, ["slug"], ["first_seq"], "version")


def content_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """sha256 of the row's columns as JSON in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
