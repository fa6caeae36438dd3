"""All registered queries; importing a plan module registers its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldcheck.plans import (  # noqa: F401
    certify,
    contracts,
    experiments,
    files,
    gates,
    grids,
    observations,
    search,
    text,
)
from fieldcheck.plans.registry import ORACLES, QUERIES, bind


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: bind(build) for name, build in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
