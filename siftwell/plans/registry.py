"""Where queries and the SQL that checks them are registered."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Modules that register queries as they are imported.
MODULES: tuple[str, ...] = ("siftwell.plans.corpus_queries", "siftwell.plans.scoring_queries", "siftwell.plans.metric_queries", "siftwell.plans.run_queries", "siftwell.plans.state_queries", "siftwell.plans.archive_queries", "siftwell.plans.matrix_queries", "siftwell.streaming.packing")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) under a name, with the SQL that returns the same rows."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


@lru_cache(1)
def load() -> None:
    for module in MODULES:
        importlib.import_module(module)


def all_queries() -> dict[str, Query]:
    load()
    return QUERIES


def all_oracles() -> dict[str, str]:
    load()
    return ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_queries()["select_topk_adam"](spark, sf_dir)
