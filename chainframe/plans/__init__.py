"""Registered queries: each is (spark, sf_dir) → DataFrame over the driver tables, plus the
DuckDB SQL that computes the same result for the correctness check."""

from chainframe.plans.registry import ORACLE, QUERIES, load_all  # noqa: F401
