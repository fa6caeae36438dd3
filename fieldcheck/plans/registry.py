"""Registry of named queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcheck.plans import standins

Build = Callable[["Tables"], DataFrame]
QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}
#: Rows of a task where a table is dealt by a key.
SPREAD_ROWS = 500_000


class Tables(standins.StandIns):
    """The given tables plus the stand-ins derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def spread(self, name: str, key: str) -> DataFrame:
        """The table dealt over tasks by a key, SPREAD_ROWS at most to one, for work that makes much of a row.

        Few bytes of a file, and so one split, are many rows. The count comes from the file's footers.
        """
        rows = self.read(name)
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SPREAD_ROWS))
        return rows.repartition(parts, key)


def query(name: str, oracle: str | None = None) -> Callable[[Build], Build]:
    """Registers a query; stand-in names used in `oracle` are put in front as CTEs."""

    def add(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = with_standins(oracle)
        return build

    return add


def with_standins(sql: str) -> str:
    needed: dict[str, str] = {}

    def visit(text: str) -> None:
        for cte, body in standins.SQL.items():
            if cte not in needed and re.search(rf"\b{cte}\b", text):
                visit(body)
                needed.setdefault(cte, body)

    visit(sql)
    if not needed:
        return sql.strip()
    head = ",\n".join(f"{n} AS ({b.strip()})" for n, b in needed.items())
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def prepare(spark: SparkSession) -> None:
    """Canonical timestamps are UTC; Python workers get the package."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    standins.ship_package(spark)


def bind(build: Build) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return build(Tables(spark, sf_dir))

    return run
