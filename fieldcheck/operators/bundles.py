"""Text bundles: budgeted packing and ranking by failure terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcheck.operators.ordered import ranked, running

# Words of a log that say nothing about its source.
LOG_STOP_WORDS = ("error", "failed", "failure", "file", "line", "pipeline", "raise", "runtime", "valueerror")


def budget_pack(
    files: DataFrame, keys: Sequence[str], order: Sequence[str], file_max: int, total_max: int, text: str | None = None
) -> DataFrame:
    """Characters of each file that fit its own limit and what the earlier files left of the budget.

    With `text`, a column of the texts, the file that the budget runs out in ends before its last line end that fits;
    what is left of its line is not given to later files. Only that file's text, one a bundle, is looked at.
    """
    sized = files.select(*keys, *order, F.coalesce(F.col("n_chars").cast("long"), F.lit(0)).alias("n_chars")).withColumn(
        "_cut", F.least(F.col("n_chars"), F.lit(file_max).cast("long"))
    )
    upto = running(sized, keys, order, {"_upto": F.col("_cut")})
    left = F.lit(total_max).cast("long") - (F.col("_upto") - F.col("_cut"))
    included = F.greatest(F.least(F.col("_cut"), left), F.lit(0).cast("long"))
    fitted = upto.select(*keys, *order, "n_chars", "_cut", included.alias("included"))
    if text is not None:
        place = [*keys, *order]
        torn = fitted.filter((F.col("included") > 0) & (F.col("included") < F.col("_cut"))).select(*place, F.col("included").alias("_room"))
        fits = F.substring(F.col(text), F.lit(1), F.col("_room").cast("int"))
        whole_lines = F.length(fits) - F.length(F.substring_index(fits, "\n", -1)) - 1
        ends = files.select(*place, text).join(torn, place).select(*place, F.greatest(whole_lines, F.lit(0)).cast("long").alias("_end"))
        fitted = fitted.join(ends, place, "left").withColumn("included", F.coalesce("_end", "included"))
    state = (
        F.when(F.col("included") == 0, "excluded")
        .when(F.col("included") < F.col("n_chars"), "truncated")
        .otherwise("whole")
    )
    return fitted.select(*keys, *order, "n_chars", "included", state.alias("state"))


def pack_coverage(packed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per bundle: files found, included, truncated and excluded, and characters there are and are included."""
    state = F.col("state")
    return packed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(state != "excluded").alias("included_files"),
        F.count_if(state == "truncated").alias("truncated_files"),
        F.count_if(state == "excluded").alias("excluded_files"),
        F.sum("n_chars").alias("total_chars"),
        F.sum("included").alias("included_chars"),
    )


def log_terms(log: Column) -> Column:
    """Distinct lower case words of four and more characters that are no log stop words."""
    words = F.regexp_extract_all(log, F.lit("([A-Za-z_][A-Za-z0-9_]{3,})"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(words, F.lower), lambda w: ~w.isin(*LOG_STOP_WORDS)))


def failure_relevance(files: DataFrame, logs: DataFrame) -> DataFrame:
    """Files of a run ranked by the number of distinct log terms they contain.

    files(run_id, path, text), logs(run_id, log). Terms travel as one array per run and are tested
    inside the row of a file, so no (file, term) pairs exist. Files the log names come first, then
    more terms, Python files, shorter and smaller paths.
    """
    terms = logs.select("run_id", log_terms(F.col("log")).alias("_terms"), F.col("log").alias("_log"))
    lowered = F.lower("text")
    scored = files.join(terms, "run_id").select(
        "run_id",
        "path",
        F.size(F.filter("_terms", lambda w: F.contains(lowered, w))).alias("relevance"),
        F.contains(F.col("_log"), F.concat(F.lit('File "'), "path", F.lit('"'))).alias("referenced"),
    )
    keyed = scored.withColumns(
        {
            "_1": (~F.col("referenced")).cast("int"),
            "_2": -F.col("relevance"),
            "_3": (~F.lower("path").endswith(".py")).cast("int"),
            "_4": F.size(F.split("path", "/")),
        }
    )
    out = ranked(keyed, ["run_id"], ["_1", "_2", "_3", "_4", "path"], "rank")
    return out.select("run_id", "path", "referenced", "relevance", "rank")
