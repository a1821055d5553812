"""Token prices: as-of lookup at transfer time and provider reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainframe.operators.windows import asof_join
from chainframe.sources.layout import chunk_start


def price_asof(facts: DataFrame, prices: DataFrame, *, key: str = "token_address", ts: str = "block_timestamp",
               price_ts: str = "ts", values=("price_cents",), bucket_seconds: int = 86400) -> DataFrame:
    """The latest price at or before each fact's time (NULL when none).

    Skew-safe (a stablecoin may carry a third of all transfers): time-bucketed windows plus a
    carried per-bucket last price, no range join and no per-token task."""
    p = prices.select(F.col(key), F.col(price_ts).alias("__pts"), *[F.col(v) for v in values])
    return asof_join(facts, p, [key], ts, "__pts", list(values), bucket_seconds=bucket_seconds)


def compare_sources(quotes: DataFrame, *, source_col: str = "source", a: str = "cgc", b: str = "cmc",
                    key: str = "token_address", ts: str = "ts", value: str = "price_cents", bucket: str = "1 hour") -> DataFrame:
    """Average quote per (token, time bucket) from two providers side by side; one grouped
    pass (equivalent to the full outer join of the two per-provider aggregates)."""
    q = quotes.withColumn("bucket", chunk_start(ts, bucket))
    agg = q.groupBy(key, "bucket").agg(
        F.avg(F.when(F.col(source_col) == a, F.col(value))).alias(f"{a}_price"),
        F.avg(F.when(F.col(source_col) == b, F.col(value))).alias(f"{b}_price"))
    # one grouped pass replaces the full outer join of two pre-aggregated sides
    return agg.withColumn("price_diff", F.col(f"{a}_price") - F.col(f"{b}_price"))
