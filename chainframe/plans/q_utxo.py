"""UTXO queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainframe.operators import utxo as UT
from chainframe.plans.q_balances import _pivot_sql, _stats_sql
from chainframe.plans.registry import query
from chainframe.sources import fixtures as FX

_LINK = """SELECT i.txhash, i.pxhash, i.vout_idx, o.address AS spent_address, o.value AS spent_value
FROM (SELECT * FROM btc_traces WHERE is_in) i LEFT JOIN (SELECT * FROM btc_traces WHERE NOT is_in) o
ON i.pxhash = o.txhash AND i.vout_idx = o.vout_idx"""


# the fixture is built once, and an output and the inputs that spend it share a key
_BY_OUTPUT = """SELECT *, count(*) FILTER (WHERE is_in) OVER (PARTITION BY CASE WHEN is_in THEN pxhash ELSE txhash END, vout_idx) AS spends
FROM btc_traces"""


@query("btc_spend_link", """WITH once AS MATERIALIZED (SELECT is_in, txhash, pxhash, vout_idx, address, value FROM btc_traces),
i AS MATERIALIZED (SELECT txhash, pxhash, vout_idx FROM once WHERE is_in),
o AS MATERIALIZED (SELECT txhash AS of_tx, vout_idx AS of_idx, address, value FROM once WHERE NOT is_in)
SELECT txhash, pxhash, vout_idx, address AS spent_address, value AS spent_value FROM i LEFT JOIN o ON pxhash = of_tx AND vout_idx = of_idx""",
       ("btc_traces",))
def btc_spend_link(spark, sf_dir):
    """Inputs linked to the outputs they spend."""
    return UT.spend_link(FX.load(spark, sf_dir, "btc_traces")).select("txhash", "pxhash", "vout_idx", "spent_address", "spent_value")


@query("btc_utxo", f"""SELECT txhash, vout_idx, address, value FROM ({_BY_OUTPUT}) WHERE NOT is_in AND spends = 0""", ("btc_traces",))
def btc_utxo(spark, sf_dir):
    """The unspent output set."""
    return UT.utxo_set(FX.load(spark, sf_dir, "btc_traces")).select("txhash", "vout_idx", "address", "value")


@query("btc_tx_totals", f"""
WITH l AS ({_LINK}),
r AS (SELECT txhash, 1 AS i, 0 AS o, COALESCE(spent_value, 0) AS iv, 0 AS ov FROM l
      UNION ALL SELECT txhash, 0, 1, 0, value FROM btc_traces WHERE NOT is_in)
SELECT txhash, CAST(sum(i) AS INTEGER) AS input_count, CAST(sum(iv) AS BIGINT) AS input_value,
  CAST(sum(o) AS INTEGER) AS output_count, CAST(sum(ov) AS BIGINT) AS output_value FROM r GROUP BY txhash""", ("btc_traces",))
def btc_tx_totals(spark, sf_dir):
    """Per-transaction input/output counts and values."""
    return UT.tx_totals(FX.load(spark, sf_dir, "btc_traces"))


_BTC_ROWS = """SELECT address, CASE WHEN is_coinbase THEN 'cnb' ELSE 'vin' END AS role, blknum, txhash, block_timestamp, value
  FROM btc_traces WHERE NOT is_in AND address IS NOT NULL
  UNION ALL SELECT o.address, 'out', i.blknum, i.txhash, i.block_timestamp, o.value
  FROM (SELECT * FROM btc_traces WHERE is_in) i JOIN (SELECT * FROM btc_traces WHERE NOT is_in) o
  ON i.pxhash = o.txhash AND i.vout_idx = o.vout_idx WHERE o.address IS NOT NULL"""


@query("btc_balances", f"""WITH s AS ({_stats_sql(_BTC_ROWS, [])})
SELECT {_pivot_sql([], ["out", "vin", "cnb"], ["cnb", "vin"], ["out"], {})} FROM s GROUP BY address""", ("btc_traces",))
def btc_balances(spark, sf_dir):
    """Bitcoin balances ``cnb + vin - out`` with per-role counts, first and last activity."""
    return UT.balances(FX.load(spark, sf_dir, "btc_traces"))


@query("btc_flatten", """
SELECT o_orderkey AS blknum, true AS is_in, CAST(o_orderkey - 1 AS VARCHAR) AS pxhash, CAST(0 AS INTEGER) AS vout_idx,
  CAST(0 AS INTEGER) AS vin_idx, CAST(1 AS INTEGER) AS vin_cnt, CAST(NULL AS VARCHAR) AS address, CAST(0 AS BIGINT) AS value
FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT l_orderkey, false, NULL,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) - 1 AS INTEGER), NULL, NULL,
  CAST(l_suppkey AS VARCHAR) || ';' || CAST(l_partkey AS VARCHAR), CAST(l_linenumber AS BIGINT)
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def btc_flatten(spark, sf_dir):
    """Transactions with input and output arrays, one row per input and output."""
    out = F.struct("l_linenumber", "l_suppkey", "l_partkey", F.array(F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).alias("addresses"),
                   F.col("l_linenumber").cast("long").alias("value"))
    vout = (FX.load_base(spark, sf_dir, "lineitem").groupBy("l_orderkey")
            .agg(F.array_sort(F.collect_list(out)).alias("vout")))  # a transaction's own outputs
    vin = F.when(F.col("o_orderstatus") != "P", F.array(F.struct(
        (F.col("o_orderkey") - 1).cast("string").alias("txid"), F.lit(0).alias("vout"), F.lit(0).alias("sequence"))))
    txs = FX.load_base(spark, sf_dir, "orders").join(vout, F.col("o_orderkey") == F.col("l_orderkey"), "left") \
        .select(F.col("o_orderkey").alias("blknum"), vin.alias("vin"), "vout")
    return UT.flatten(txs).select("blknum", "is_in", "pxhash", "vout_idx", "vin_idx", "vin_cnt", "address", "value")
