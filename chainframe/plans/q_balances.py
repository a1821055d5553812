"""Balance and aggregate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainframe.functions import u256 as U
from chainframe.operators import balances as BL
from chainframe.operators import derive as DV
from chainframe.plans.registry import query
from chainframe.plans.q_derive import TOK_SQL, dhex
from chainframe.sources import fixtures as FX

EPOCH_S = "CAST(date_diff('second', TIMESTAMP '1970-01-01', {x}) AS INTEGER)"


def _pivot_sql(keys: list[str], roles: list[str], plus: list[str], minus: list[str], firsts: dict[str, bool]) -> str:
    cols = ["address", *keys, "max(bn) AS blknum"]
    for r in roles:
        f = f"FILTER (WHERE role = '{r}')"
        if r != "fee":
            cols += [f"CAST(COALESCE(any_value(blocks) {f}, 0) AS BIGINT) AS {r}_blocks",
                     f"CAST(COALESCE(any_value(txs) {f}, 0) AS BIGINT) AS {r}_txs",
                     f"CAST(COALESCE(any_value(xfers) {f}, 0) AS BIGINT) AS {r}_xfers"]
        cols.append(f"CAST(COALESCE(any_value(v) {f}, CAST(0 AS BIGNUM)) AS VARCHAR) AS {r}_value")
        if firsts.get(r, True):
            cols += [EPOCH_S.format(x=f"any_value(t1) {f}") + f" AS {r}_1th_st",
                     EPOCH_S.format(x=f"any_value(tn) {f}") + f" AS {r}_nth_st",
                     f"any_value(b1) {f} AS {r}_1th_blknum", f"any_value(bn) {f} AS {r}_nth_blknum",
                     f"CAST(any_value(t1) {f} AS DATE) AS {r}_1th_st_day", f"CAST(any_value(tn) {f} AS DATE) AS {r}_nth_st_day"]
    net = " + ".join(f"COALESCE(any_value(v) FILTER (WHERE role = '{r}'), CAST(0 AS BIGNUM))" for r in plus)
    net += "".join(f" - COALESCE(any_value(v) FILTER (WHERE role = '{r}'), CAST(0 AS BIGNUM))" for r in minus)
    cols.append(f"CAST({net} AS VARCHAR) AS value")
    return ",\n  ".join(cols)


def _stats_sql(rows: str, keys: list[str]) -> str:
    k = ", ".join(["address", *keys, "role"])
    return f"""SELECT {k}, count(DISTINCT blknum) AS blocks, count(DISTINCT txhash) AS txs, count(*) AS xfers,
  SUM(CAST(value AS BIGNUM)) AS v, min(block_timestamp) AS t1, max(block_timestamp) AS tn,
  min(blknum) AS b1, max(blknum) AS bn FROM ({rows}) GROUP BY {k}"""


TOKEN_ROWS = """SELECT from_address AS address, token_address, 'out' AS role, blknum, txhash, block_timestamp, value FROM token_xfers
  WHERE from_address IS NOT NULL
  UNION ALL SELECT to_address, token_address, 'vin', blknum, txhash, block_timestamp, value FROM token_xfers
  WHERE to_address IS NOT NULL"""

TOKEN_BAL_SQL = f"""WITH s AS ({_stats_sql(TOKEN_ROWS, ["token_address"])}),
p AS (SELECT {_pivot_sql(["token_address"], ["out", "vin"], ["vin"], ["out"], {})} FROM s GROUP BY address, token_address)
SELECT p.*, CAST(tok.decimals AS BIGINT) AS decimals, CAST(NULL AS VARCHAR) AS balance
FROM p LEFT JOIN {TOK_SQL} tok ON p.token_address = tok.address"""


@query("token_balances", TOKEN_BAL_SQL, ("token_xfers", "token_registry"))
def token_balances(spark, sf_dir):
    """Latest token balances with per-role block/tx/transfer counts, sums, first/last."""
    memo: dict = {}
    x = FX.load(spark, sf_dir, "token_xfers", memo)
    return BL.token_balances(x, DV.tokens_latest(FX.load(spark, sf_dir, "token_registry", memo)))


@query("balances_incremental", f"SELECT * EXCLUDE (decimals, balance) FROM ({TOKEN_BAL_SQL})", ("token_xfers", "token_registry"))
def balances_incremental(spark, sf_dir):
    """State up to checkpoint block 5000 merged with the later batch = full recompute."""
    x = FX.load(spark, sf_dir, "token_xfers")
    state = BL.token_balances(x, upto=5000).drop("decimals", "balance")
    delta = BL.token_balances(x.filter(F.col("blknum") > 5000)).drop("decimals", "balance")
    return BL.merge_balances(state, delta)


NATIVE_ROWS = """SELECT from_address AS address, 'out' AS role, blknum, txhash, block_timestamp, value FROM traces_a
  WHERE status = 1 AND trace_type <> 'reward' AND COALESCE(call_type NOT IN ('delegatecall', 'callcode', 'staticcall'), true)
  UNION ALL SELECT to_address, 'vin', blknum, txhash, block_timestamp, value FROM traces_a
  WHERE status = 1 AND trace_type <> 'reward' AND COALESCE(call_type NOT IN ('delegatecall', 'callcode', 'staticcall'), true)
  UNION ALL SELECT to_address, 'cnb', blknum, txhash, block_timestamp, value FROM traces_a WHERE trace_type = 'reward'
  UNION ALL SELECT from_address, 'fee', blknum, txhash, block_timestamp,
    CAST(CAST(receipt_gas_used AS HUGEINT) * receipt_effective_gas_price AS VARCHAR) FROM txs_a"""

NATIVE_BAL_SQL = f"""WITH s AS ({_stats_sql(f"SELECT * FROM ({NATIVE_ROWS}) WHERE address IS NOT NULL", [])}),
p AS (SELECT {_pivot_sql([], ["out", "vin", "cnb", "fee"], ["cnb", "vin"], ["out", "fee"], {"fee": False})} FROM s GROUP BY address)
SELECT p.*, CAST(NULL AS VARCHAR) AS balance FROM p"""


@query("native_balances", NATIVE_BAL_SQL, ("traces_a", "txs_a"))
def native_balances(spark, sf_dir):
    """A10: native balance ``cnb + vin - out - fee`` per address with activity stats."""
    memo: dict = {}
    return BL.native_balances(FX.load(spark, sf_dir, "traces_a", memo), FX.load(spark, sf_dir, "txs_a", memo))


@query("address_first_last", f"""SELECT address, out_1th_st, out_nth_st, vin_1th_blknum, vin_nth_blknum, cnb_1th_st_day, cnb_nth_st_day
FROM ({NATIVE_BAL_SQL})""", ("traces_a", "txs_a"))
def address_first_last(spark, sf_dir):
    """first/last activity per role (epoch, block, day)."""
    return native_balances(spark, sf_dir).select("address", "out_1th_st", "out_nth_st", "vin_1th_blknum", "vin_nth_blknum",
                                                 "cnb_1th_st_day", "cnb_nth_st_day")


@query("fee_by_sender", """
SELECT from_address, CAST(SUM(CAST(receipt_gas_used AS HUGEINT) * receipt_effective_gas_price) AS VARCHAR) AS fee_value
FROM txs_a GROUP BY from_address""", ("txs_a",))
def fee_by_sender(spark, sf_dir):
    """Gas fees per sender."""
    return BL.fee_by_sender(FX.load(spark, sf_dir, "txs_a"))


@query("token_balance_history", """
WITH r AS (SELECT from_address AS address, token_address, blknum, 1 AS o, 0 AS i, -CAST(value AS BIGNUM) AS v FROM token_xfers
  UNION ALL SELECT to_address, token_address, blknum, 0, 1, CAST(value AS BIGNUM) FROM token_xfers),
b AS (SELECT address, token_address, blknum, sum(o) AS d_out, sum(i) AS d_vin, sum(v) AS d_v FROM r GROUP BY ALL)
SELECT address, token_address, blknum,
  CAST(sum(d_out) OVER w AS BIGINT) AS out_xfers, CAST(sum(d_vin) OVER w AS BIGINT) AS vin_xfers,
  CAST(sum(d_v) OVER w AS VARCHAR) AS value
FROM b WINDOW w AS (PARTITION BY address, token_address ORDER BY blknum ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
       ("token_xfers",))
def token_balance_history(spark, sf_dir):
    """Running token balance per (address, token) at each block it changed."""
    return BL.balance_history(FX.load(spark, sf_dir, "token_xfers"), width=2000)


_ROLES4 = ("out", "vin", "cnb", "fee")


@query("native_balance_history", f"""
WITH r AS (SELECT * FROM ({NATIVE_ROWS}) WHERE address IS NOT NULL),
b AS (SELECT address, blknum,
  {", ".join(f"max(CASE WHEN role = '{x}' THEN 1 ELSE 0 END) AS {x}_b, count(DISTINCT txhash) FILTER (WHERE role = '{x}') AS {x}_t, "
             f"count(*) FILTER (WHERE role = '{x}') AS {x}_n, COALESCE(SUM(CAST(value AS BIGNUM)) FILTER (WHERE role = '{x}'), CAST(0 AS BIGNUM)) AS {x}_v"
             for x in _ROLES4)} FROM r GROUP BY ALL)
SELECT address, blknum,
  {", ".join(f"CAST(sum({x}_b) OVER w AS BIGINT) AS {x}_blocks, CAST(sum({x}_t) OVER w AS BIGINT) AS {x}_txs, "
             f"CAST(sum({x}_n) OVER w AS BIGINT) AS {x}_xfers" for x in ("out", "vin", "cnb"))},
  {", ".join(f"CAST(sum({x}_v) OVER w AS VARCHAR) AS {x}_value" for x in _ROLES4)},
  CAST(sum(cnb_v + vin_v - out_v - fee_v) OVER w AS VARCHAR) AS value
FROM b WINDOW w AS (PARTITION BY address ORDER BY blknum ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", ("traces_a", "txs_a"))
def native_balance_history(spark, sf_dir):
    """Running native balance with per-role counts, coinbase and fees at each block it changed."""
    memo: dict = {}
    return BL.native_balance_history(FX.load(spark, sf_dir, "traces_a", memo), FX.load(spark, sf_dir, "txs_a", memo), width=2000)


# computed balances per supplier, and those a node reports: some differ, some exist on one side
FX.register("computed_balances", ("lineitem",), """
SELECT l_suppkey AS holder, CAST(sum(CAST(l_quantity AS BIGINT)) AS STRING) || '000000000000000000' AS value
FROM {lineitem} WHERE l_suppkey % 11 <> 5 GROUP BY l_suppkey""")
FX.register("onchain_balances", ("lineitem",), """
SELECT l_suppkey AS holder, CAST(sum(CAST(l_quantity AS BIGINT)) AS STRING)
  || CASE WHEN l_suppkey % 7 = 0 THEN '000000000000000042' ELSE '000000000000000000' END AS balance
FROM {lineitem} WHERE l_suppkey % 13 <> 6 GROUP BY l_suppkey""")


@query("balance_reconcile", """
SELECT COALESCE(c.holder, o.holder) AS holder, c.value, o.balance,
  CAST(COALESCE(CAST(o.balance AS HUGEINT), 0) - COALESCE(CAST(c.value AS HUGEINT), 0) AS VARCHAR) AS difference
FROM computed_balances c FULL JOIN onchain_balances o ON c.holder = o.holder
WHERE COALESCE(CAST(o.balance AS HUGEINT), 0) <> COALESCE(CAST(c.value AS HUGEINT), 0)""", ("computed_balances", "onchain_balances"))
def balance_reconcile(spark, sf_dir):
    """Computed against reported balances, with the exact signed difference."""
    memo: dict = {}
    return BL.reconcile(FX.load(spark, sf_dir, "computed_balances", memo), FX.load(spark, sf_dir, "onchain_balances", memo), keys=("holder",))


@query("u256_sum", """
SELECT to_address, CAST(SUM(CAST(value AS BIGNUM)) AS VARCHAR) AS total_value, CAST(count(*) AS BIGINT) AS n
FROM txs_a GROUP BY to_address""", ("txs_a",))
def u256_sum(spark, sf_dir):
    """Exact uint256 sums (values include 2^256-1) per receiver."""
    t = FX.load(spark, sf_dir, "txs_a")
    return U.sum_u256(t, ["to_address"], {"total_value": F.col("value")}, [F.count(F.lit(1)).alias("n")])


@query("hex_to_dec", f"""
SELECT txhash, logpos, {dhex("substr(regexp_replace(data, '^0[xX]', ''), 1, 64)")} AS amount FROM logs_a""", ("logs_a",))
def hex_to_dec(spark, sf_dir):
    """hex words → exact decimal strings (native Horner over 64-bit words)."""
    l = FX.load(spark, sf_dir, "logs_a")
    return l.select("txhash", "logpos", U.hex_to_u256(F.substring(F.regexp_replace("data", "^0[xX]", ""), 1, 64)).alias("amount"))
