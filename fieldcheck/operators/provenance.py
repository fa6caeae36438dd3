"""Receipts, claims, recorded identities and path rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcheck.operators.diff import mismatch_names, property_mismatches


def cache_only(receipts: DataFrame) -> DataFrame:
    """Runs served from the cache alone."""
    return receipts.filter((F.col("hits") > 0) & (F.col("misses") == 0) & (F.col("acquired") == 0))


def cache_evidence(partitions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hits, misses and acquisitions per run, with a fingerprint of the keys reused and of those acquired.

    The keys themselves stay rows of `partitions`; a run may touch any number of them.
    """
    from fieldcheck.operators.fingerprint import combine_digests

    hit = F.col("state") == "hit"
    counted = partitions.groupBy(*keys).agg(
        F.count_if(hit).alias("hits"),
        F.count_if(F.col("state") == "miss").alias("misses"),
        F.count_if(F.col("state") == "acquired").alias("acquired"),
    )
    named = partitions.filter(F.col("state").isin("hit", "acquired")).withColumn("_d", F.sha2("partition_key", 256))
    prints = combine_digests(named, [*keys, "state"], "_d")
    pick = lambda state: F.max(F.when(F.col("state") == state, F.col("fingerprint")))
    both = prints.groupBy(*keys).agg(pick("hit").alias("reused_keys"), pick("acquired").alias("acquired_keys"))
    return counted.join(both, list(keys), "left")


def identity_mismatches(receipts: DataFrame, expected: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Receipts whose declared fields differ from the expected ones, with the field names."""
    return mismatch_names(property_mismatches(receipts, expected, keys, fields), keys)


def missing_identities(runs: DataFrame, recorded: DataFrame, required: Sequence[str]) -> DataFrame:
    """Required names without a recorded hash, per run."""
    want = runs.select("run_id", F.explode(F.array(*[F.lit(n) for n in required])).alias("name"))
    have = recorded.filter(F.coalesce(F.col("sha256"), F.lit("")) != "").select("run_id", "name")
    return want.join(have, ["run_id", "name"], "left_anti")


def freeze_drift(locked: DataFrame, current: DataFrame) -> DataFrame:
    """Locked sources (owner, path, sha256, meta) against the current ones."""
    a = locked.select("owner", "path", F.struct("sha256", "meta").alias("_l"))
    b = current.select("owner", "path", F.struct("sha256", "meta").alias("_c"))
    drift = (
        F.when(F.col("_c").isNull(), "missing")
        .when(F.col("_l").isNull(), "extra")
        .when(~F.col("_l.sha256").eqNullSafe(F.col("_c.sha256")), "content")
        .when(~F.col("_l.meta").eqNullSafe(F.col("_c.meta")), "metadata")
    )
    return (
        a.join(b, ["owner", "path"], "full_outer")
        .select("owner", "path", drift.alias("drift"))
        .filter(F.col("drift").isNotNull())
    )


def path_overlap(files: DataFrame, declared: DataFrame) -> DataFrame:
    """Files reachable from more than one declared path of a bundle.

    files(bundle, path), declared(bundle, prefix). Every file is turned into its own ancestor
    paths, so prefixes match by equality; the number of ancestors is the depth of the path.
    """
    steps = F.split("path", "/")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/")
    )
    up = files.select("bundle", "path", F.explode(ancestors).alias("prefix"))
    return (
        up.join(declared.distinct(), ["bundle", "prefix"])
        .groupBy("bundle", "path")
        .agg(F.count(F.lit(1)).alias("reached_from"))
        .filter(F.col("reached_from") > 1)
    )


def credential_union(*sources: DataFrame) -> DataFrame:
    """Distinct (owner, name) of all sources."""
    out = sources[0].select("owner", "name")
    for s in sources[1:]:
        out = out.unionByName(s.select("owner", "name"))
    return out.distinct()


def citation_problems(citations: DataFrame, files: DataFrame, cap: float) -> DataFrame:
    """Citations of unknown files, beyond the last line, or scored above the cap."""
    joined = citations.join(files.select("path", "line_count"), "path", "left")
    problem = (
        F.when(F.col("line_count").isNull(), "unknown_file")
        .when(F.col("line_end") > F.col("line_count"), "beyond_end")
        .when(F.col("score") > cap, "score_above_cap")
    )
    return joined.select("citation_id", "path", problem.alias("problem")).filter(F.col("problem").isNotNull())
