"""Where queries and their oracles are put by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str = "") -> Callable:
    """Register a function of (spark, sf_dir) under a name, with its SQL where there is one."""

    def put(run: Callable) -> Callable:
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return put
