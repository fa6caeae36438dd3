"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Every rule rejects texts with a value beyond a cutoff. Labelled good texts tell, for each stratum and
candidate cutoff, how many would be rejected wrongly; an exact binomial bound says whether the true
share is below the allowed risk. Bonferroni's correction over all candidates makes that hold for all of
them at once. The strictest proven cutoff is used; a rule without one rejects nothing in that stratum.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcheck.llm.common import query, table, written

#: Allowed share of good texts that a rule rejects, and the chance that any bound is wrong.
RISK, DOUBT = 0.002, 0.05
_BLANKS = r"[\x20\x09-\x0D]+"
#: Terms of the binomial tail that are summed; the rest is bounded by the last one, so the sum never falls short.
TERMS = 20_000


@dataclass(frozen=True)
class Rule:
    """Rejects value > cutoff; cutoffs go from strict to lenient."""

    name: str
    value: str
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols / n_words", (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2, 2.0, 4.0)),
    Rule("lines", "n_dup_lines / n_lines", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)),
    Rule("repeats", "n_repeat_words / n_words", (0.05, 0.08, 0.12, 0.16, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45)),
    Rule("long words", "word_chars / n_words", (6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0)),
    Rule("short words", "- word_chars / n_words", (-4.5, -4.0, -3.5, -3.0, -2.5, -2.0, -1.8, -1.6, -1.4, -1.2)),
)


def features(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns `keep` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long).

    A null text has no words. Every row stays, repeated ones too.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        *keep,
        F.array_remove(F.split(text, _BLANKS), "").alias("_words"),
        F.length(F.regexp_replace(text, _BLANKS, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    # Windows of three words by hash; the last two entries have no third word and are cut off.
    window = F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    windows = split.withColumn("_windows", F.slice(window, F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))))
    several = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    ordered = windows.withColumn("_placed", F.when(several, placed).otherwise(none))
    same = lambda x, j: F.coalesce(F.get("_placed", j)["h"] == x["h"], F.lit(False))
    twice = F.filter("_placed", lambda x, i: same(x, i + 1) | ((i > 0) & same(x, F.greatest(i - 1, F.lit(0)))))
    repeated = ordered.withColumn("_at", F.array_sort(F.transform(twice, lambda x: x["i"])))
    # A window adds three words, less those that the one before it covers.
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("sum")),
        lambda acc, i: F.struct(
            i.alias("last"), (acc["sum"] + F.least(i - acc["last"], F.lit(3)).cast("bigint")).alias("sum")
        ),
        lambda acc: acc["sum"],
    )
    return repeated.select(
        *keep,
        F.size("_words").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def _value(rule: Rule) -> Column:
    """A text without words or lines has nothing to reject."""
    return F.when((F.col("n_words") > 0) & (F.col("n_lines") > 0), F.expr(rule.value)).otherwise(F.lit(-1e9))


def _log_factorial(n: Column) -> Column:
    """ln(n!): exact up to 20, then by Stirling's series (error below 1e-13)."""
    small = F.element_at(F.array(*(F.lit(math.log(math.factorial(i))) for i in range(21))), (F.least(n, F.lit(20)) + 1).cast("int"))
    x = F.greatest(n, F.lit(1)).cast("double")
    large = x * F.log(x) - x + F.log(x * (2 * math.pi)) / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n <= 20, small).otherwise(large)


def binomial_tail(n: Column, x: Column, risk: float) -> Column:
    """P(X <= x) for X of n draws with chance `risk`, or more by less than rounding: the exact test's p-value."""
    log_x = (
        _log_factorial(n) - _log_factorial(x) - _log_factorial(n - x)
        + x * math.log(risk) + (n - x) * math.log1p(-risk)
    )
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    ratio = (1 - risk) / risk
    step = lambda acc, k: F.struct(
        (acc["term"] * (x - k + 1) / (n - x + k) * ratio).alias("term"),
        (acc["sum"] + acc["term"] * (x - k + 1) / (n - x + k) * ratio).alias("sum"),
    )
    steps = F.when(x > 0, F.sequence(F.lit(1), F.least(x, F.lit(TERMS)).cast("int"))).otherwise(F.array().cast("array<int>"))
    rest = lambda acc: acc["sum"] + F.greatest(x - TERMS, F.lit(0)) * acc["term"]
    total = F.log(F.aggregate(steps, start, step, rest)) + log_x
    # With x at the mean or above the tail is about one half: no bound to prove, and the terms may grow.
    return F.when(x >= n * risk, F.lit(1.0)).otherwise(F.least(F.exp(total), F.lit(1.0)))


def cutoffs(
    labelled: DataFrame, rules: tuple[Rule, ...] = RULES, risk: float = RISK, doubt: float = DOUBT
) -> DataFrame:
    """stratum and c0, c1, ..: the strictest proven cutoff of each rule, null where none is proven.

    labelled: features of good texts with their stratum. Counts are summed where the rows lie; a row a
    stratum goes on.
    """
    counts = [
        F.sum((_value(r) > c).cast("bigint")).alias(f"x{i}_{j}")
        for i, r in enumerate(rules)
        for j, c in enumerate(r.cutoffs)
    ]
    seen = labelled.groupBy("stratum").agg(F.count("*").alias("n"), *counts)
    strata = seen.agg(F.count("*").alias("strata"), F.lit(1).alias("one"))
    tests = F.array(
        *(
            F.struct(F.lit(i).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"x{i}_{j}").alias("x"))
            for i, r in enumerate(rules)
            for j, c in enumerate(r.cutoffs)
        )
    )
    # one row, the number of strata, meets a row a stratum and test
    tested = seen.select("stratum", "n", F.lit(1).alias("one"), F.inline(tests)).join(strata, "one")
    number = sum(len(r.cutoffs) for r in rules)
    proven = tested.filter(binomial_tail(F.col("n"), F.col("x"), risk) * number * F.col("strata") <= doubt)
    strictest = [F.min(F.when(F.col("rule") == i, F.col("cutoff"))).alias(f"c{i}") for i in range(len(rules))]
    return proven.groupBy("stratum").agg(*strictest)


def judge(
    docs: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    keep: tuple[str, ...] = ("doc_id",),
    risk: float = RISK,
) -> DataFrame:
    """The columns `keep` with the features, base_failed, failed (names of the rules) and kept, for every row.

    Good texts are those whose labels all say quality 1; their strata set the cutoffs. A null stratum is one
    of its own. Rows without doc_id have no label. Without labels no rule rejects and only the base does.
    """
    wide = tuple(dict.fromkeys((*keep, "doc_id")))
    named = docs.withColumn("stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    found = written(features(named, (*wide, "stratum")), "features")
    good = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    )
    limits = written(cutoffs(found.join(good, "doc_id"), risk=risk), "cutoffs")
    failed = [
        F.when(F.coalesce(_value(r) > F.col(f"c{i}"), F.lit(False)), F.lit(r.name)) for i, r in enumerate(RULES)
    ]
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        found.join(limits, "stratum", "left")
        .withColumn("base_failed", base)
        .withColumn("failed", F.array_compact(F.array(*failed)))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
        .drop(*(f"c{i}" for i in range(len(RULES))), *({"stratum"} - set(keep)))
    )


def _oracle() -> str:
    tests = sum(len(r.cutoffs) for r in RULES)
    grid = ", ".join(
        f"({i}, {j}, {c}::DOUBLE)" for i, r in enumerate(RULES) for j, c in enumerate(r.cutoffs)
    )
    value = " ".join(f"WHEN {i} THEN {r.value}" for i, r in enumerate(RULES))
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words) AS times
  FROM (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1),
    lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS words FROM w WHERE len(w) > 2)
), covered AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM g WHERE times > 1) GROUP BY doc_id
), f AS (
  SELECT w.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id
), grid(rule, no, cutoff) AS (VALUES {grid}),
v AS (SELECT f.*, r.rule, CASE WHEN n_words > 0 AND n_lines > 0 THEN CASE r.rule {value} END ELSE -1e9 END AS value
  FROM f CROSS JOIN (SELECT DISTINCT rule FROM grid) r),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
tested AS (
  SELECT stratum, rule, no, any_value(cutoff) AS cutoff, count(*) AS n, count(*) FILTER (value > cutoff) AS x
  FROM v JOIN grid USING (rule) WHERE doc_id IN (SELECT doc_id FROM good) GROUP BY stratum, rule, no
), passed AS (
  SELECT stratum, rule, min(cutoff) AS cutoff FROM tested WHERE x < n * {RISK} AND
    list_sum(list_transform(range(0, x + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
      + k * ln({RISK}) + (n - k) * ln(1 - {RISK})))) * {tests} * (SELECT count(DISTINCT stratum) FROM tested) <= {DOUBT}
  GROUP BY stratum, rule
), bad AS (SELECT DISTINCT doc_id FROM v JOIN passed USING (stratum, rule) WHERE value > passed.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM f
"""


@query("op10_quality_rules", _oracle())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
