"""Query registry shared by ``__spark_entry__``, the bench and the tests."""

from __future__ import annotations

import importlib
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from chainframe.sources import fixtures as FX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_MODULES = ("q_diff", "q_lifecycle", "q_derive", "q_balances", "q_utxo", "q_prices", "q_abi",
            "q_metrics", "q_alerts")


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir)``; ``sql`` is DuckDB text over the driver views and the
    fixtures named in ``uses`` (added as CTEs)."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = FX.with_fixtures(sql, uses)
        return fn

    return deco


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(f"chainframe.plans.{m}")
