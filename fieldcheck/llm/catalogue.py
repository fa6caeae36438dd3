"""All llm queries; importing an operator's module registers its query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldcheck.llm import (  # noqa: F401
    bpe,
    chat_format,
    collocations,
    decontam,
    language_id,
    license_index,
    lm,
    passages,
    quality_rules,
    runs,
    secret_ledger,
    tile_join,
    warc,
)
from fieldcheck.llm.common import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
