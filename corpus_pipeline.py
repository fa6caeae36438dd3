"""Corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir), docs with the columns of `documents`, and returns such rows; the
last one returns token ids. A stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcheck.llm import bpe, decontam, language_id, secret_ledger, tile_join
from fieldcheck.llm.common import ready, scratch, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is known and that its model explains; the predicted language becomes `lang`.

    Rejected: null texts, texts without letters, and those beyond the calibrated limit.
    """
    ready(spark)
    models = language_id.train(docs.filter(~language_id.held_out()))
    found = language_id.predict(docs, models, COLUMNS)
    return found.filter("NOT rejected").withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (word 5-grams, similarity 0.8): the one with the smallest id.

    Rows that repeat a doc_id count as one document. Rows without an id stay: nothing tells which of them
    are one document.
    """
    ready(spark)
    groups = tile_join.link(docs, n=5, percent=80)
    go = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    named = docs.select(COLUMNS).filter("doc_id IS NOT NULL")
    stay = named.join(go.hint("shuffle_hash"), "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return stay.unionByName(docs.select(COLUMNS).filter("doc_id IS NULL"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    ready(spark)
    marked = decontam.mark(docs.select(COLUMNS), table(spark, sf_dir.rstrip("/"), "benchmark"))
    return marked.filter(F.size("leaks") == 0).select(COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark of its kind; n_chars is that of the new text."""
    ready(spark)
    versions = docs.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text")
    ledger = secret_ledger.BlobLedger(spark, scratch(spark, "ledger"))
    ledger.update(versions)
    return ledger.redact(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining text as token ids, and the byte offsets of its pieces."""
    ready(spark)
    return bpe.encode(docs.select(COLUMNS), bpe.public_vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("languages", languages),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: Language models, edit distances and merges have no form in SQL; tests hold the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents; each one's rows are written and read by the next."""
    ready(spark)
    docs = table(spark, sf_dir.rstrip("/"), "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
