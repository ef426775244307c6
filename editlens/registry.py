"""Registry of named jobs (``queries()``) and their DuckDB oracles (``oracle_sql()``).

Each job takes ``(spark, sf_dir)`` and returns a DataFrame over the whole tables.
Modules under ``editlens.plans.catalog`` register themselves on import.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .session import ensure_checkpoint_dir, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def job(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)        # the session's shared folder, or a local one in tests
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = job
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def load_all() -> None:
    from .plans import catalog  # noqa: F401  (registers on import)
