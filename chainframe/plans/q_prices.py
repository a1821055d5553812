"""Price queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainframe.operators import prices as PR
from chainframe.plans.registry import query
from chainframe.sources import fixtures as FX


@query("price_asof", """
SELECT l.txhash, l.logpos, l.address AS token_address, l.block_timestamp, p.price_cents, p.ts AS matched_ts
FROM logs_a l ASOF LEFT JOIN prices p ON l.address = p.token_address AND l.block_timestamp >= p.ts""", ("logs_a", "prices"))
def price_asof(spark, sf_dir):
    """Token price in force at each transfer log (latest quote at or before it)."""
    memo: dict = {}
    l = FX.load(spark, sf_dir, "logs_a", memo).select("txhash", "logpos", F.col("address").alias("token_address"),
                                                       "block_timestamp")
    p = FX.load(spark, sf_dir, "prices", memo)
    return PR.price_asof(l, p).select("txhash", "logpos", "token_address", "block_timestamp", "price_cents", "matched_ts")


@query("price_compare", """
SELECT token_address, date_trunc('hour', ts) AS bucket,
  avg(price_cents) FILTER (WHERE source = 'cgc') AS cgc_price, avg(price_cents) FILTER (WHERE source = 'cmc') AS cmc_price,
  avg(price_cents) FILTER (WHERE source = 'cgc') - avg(price_cents) FILTER (WHERE source = 'cmc') AS price_diff
FROM price_quotes GROUP BY 1, 2""", ("price_quotes",))
def price_compare(spark, sf_dir):
    """Hourly cgc vs cmc quote comparison per token."""
    return PR.compare_sources(FX.load(spark, sf_dir, "price_quotes"))
