"""Chain-shaped frames derived from the driver tables.

The reference ships no test inputs, so the chain tables used by the registered queries are
derived from the driver's parquet tables by SQL text that runs unchanged in Spark and in
DuckDB (the oracle). Each block is written with ``{table}`` placeholders: in Spark they are
bound to DataFrames through ``spark.sql(sql, **frames)`` (no global temp views, so several
scale factors can share one session); for DuckDB they become CTE names.

Two engine-specific tokens exist: ``{fanout3}`` (a 3-way row fan-out, ``explode`` vs
``unnest``) and ``{epoch_open}``; all other syntax is common to both engines. A fixture whose SQL
would put a whole key into one Spark task (a running sum) has a Spark builder instead; its SQL is
then the oracle's alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainframe.operators.windows import bucketed_running_sum

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_ADDR = "'0x' || md5('{p}' || CAST({x} AS STRING)) || substr(md5('{p}#' || CAST({x} AS STRING)), 1, 8)"


def _addr(prefix: str, expr: str) -> str:
    return _ADDR.format(p=prefix, x=expr)


def _hash64(prefix: str, expr: str) -> str:
    return (f"'0x' || md5('{prefix}' || CAST({expr} AS STRING)) || "
            f"md5('{prefix}#' || CAST({expr} AS STRING))")


MAX_U256 = "115792089237316195423570985008687907853269984665640564039457584007913129639935"
TRANSFER_TOPIC = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"

SQL: dict[str, str] = {}
DEPS: dict[str, tuple[str, ...]] = {}
BUILD: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {}
#: fixtures that join two large tables: the column that each is dealt by where the rows are many
DEAL: dict[str, dict[str, str]] = {}
ROWS_A_TASK = 250_000


def _fixture(name: str, deps: tuple[str, ...], sql: str, build: Callable[[dict[str, DataFrame]], DataFrame] | None = None) -> None:
    SQL[name] = sql
    DEPS[name] = deps
    if build is not None:
        BUILD[name] = build


_fixture("blocks_a", ("orders",), f"""
SELECT o_orderdate AS block_timestamp, o_orderkey AS blknum,
  {_hash64('blk', 'o_orderkey')} AS blkhash,
  {_hash64('blk', 'o_orderkey - 1')} AS parent_hash,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE '0x' || md5('n' || CAST(o_orderkey AS STRING)) END AS nonce,
  '0x' || md5('bloom' || CAST(o_orderkey AS STRING)) AS logs_bloom,
  {_addr('m', 'o_custkey % 50')} AS miner,
  CAST(30000000 AS BIGINT) AS gas_limit,
  CAST(o_custkey * 1000 AS BIGINT) AS gas_used,
  CAST(o_custkey % 200 AS BIGINT) AS tx_count
FROM {{orders}}""")

_fixture("blocks_b", ("blocks_a",), """
SELECT block_timestamp, blknum, blkhash, parent_hash,
  CASE WHEN blknum % 22 = 0 THEN '0xfeed' ELSE nonce END AS nonce,
  CASE WHEN blknum % 29 = 0 THEN '0xdead' ELSE logs_bloom END AS logs_bloom,
  miner, gas_limit,
  CASE WHEN blknum % 7 = 0 THEN gas_used + 1 ELSE gas_used END AS gas_used,
  CASE WHEN blknum % 17 = 0 THEN NULL ELSE tx_count END AS tx_count
FROM {blocks_a} WHERE blknum % 13 <> 0""")

_fixture("txs_a", ("events",), f"""
SELECT ts AS block_timestamp, CAST(floor(event_id / 5) AS BIGINT) AS blknum,
  {_hash64('tx', 'event_id')} AS txhash,
  CAST(event_id % 5 AS BIGINT) AS txpos,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(event_id AS BIGINT) END AS nonce,
  {_addr('u', 'user_id')} AS from_address,
  CASE WHEN event_type = 'signup' THEN NULL ELSE {_addr('u', 'user_id * 7 % 101')} END AS to_address,
  CASE WHEN event_id % 97 = 0 THEN '{MAX_U256}'
       ELSE CAST(CAST(round(value * 100) AS BIGINT) AS STRING) || '0000000000000000' END AS value,
  CAST(21000 + event_id % 1000 AS BIGINT) AS receipt_gas_used,
  CAST(1000000000 + event_id % 77 AS BIGINT) AS receipt_effective_gas_price,
  CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS INT) AS receipt_status
FROM {{events}}""")

_fixture("txs_b", ("txs_a",), """
SELECT block_timestamp, blknum, txhash, txpos, nonce, from_address, to_address,
  CASE WHEN nonce % 23 = 0 THEN '1' ELSE value END AS value,
  receipt_gas_used, receipt_effective_gas_price,
  CASE WHEN nonce % 31 = 0 THEN NULL ELSE receipt_status END AS receipt_status
FROM {txs_a} WHERE (blknum * 5 + txpos) % 13 <> 0""")

_fixture("traces_a", ("txs_a",), """
SELECT t.block_timestamp, t.blknum,
  CASE WHEN t.nonce % 41 = 0 THEN NULL ELSE t.txhash END AS txhash, t.txpos,
  t.from_address, t.to_address, t.value,
  CASE WHEN t.k = 0 THEN '' WHEN t.k = 1 THEN '0' ELSE '0,0' END AS trace_address,
  CASE WHEN t.k = 2 AND t.txpos = 0 THEN NULL WHEN t.k = 2 AND t.txpos = 1 THEN 'reward'
       WHEN t.to_address IS NULL THEN 'create' ELSE 'call' END AS trace_type,
  CASE WHEN t.to_address IS NULL THEN NULL WHEN t.k = 1 THEN 'delegatecall' ELSE 'call' END AS call_type,
  CAST(CASE WHEN t.k < 2 THEN 1 ELSE 0 END AS BIGINT) AS subtraces,
  CASE WHEN t.receipt_status = 0 THEN 'Reverted' ELSE NULL END AS error,
  t.receipt_status AS status
FROM (SELECT *, {fanout3} AS k FROM {txs_a}) t""")

_fixture("traces_b", ("traces_a",), """
SELECT block_timestamp, blknum, txhash, txpos, from_address, to_address, value, trace_address,
  CASE WHEN trace_type = 'create' THEN 'create2' ELSE trace_type END AS trace_type,
  CASE WHEN blknum % 9 = 0 THEN 'staticcall' ELSE call_type END AS call_type,
  subtraces, CASE WHEN blknum % 4 = 0 THEN 'out of gas' ELSE error END AS error, status
FROM {traces_a} WHERE NOT (blknum % 13 = 0 AND trace_address = '0,0')""")

_fixture("logs_a", ("txs_a",), f"""
SELECT block_timestamp, blknum, txhash, txpos, CAST(txpos AS INT) AS logpos,
  {_addr('tok', 'blknum % 20')} AS address,
  CAST(3 AS INT) AS n_topics,
  '[{TRANSFER_TOPIC},0x' || lpad(substr(from_address, 3), 64, '0') || ',0x' || lpad(substr(to_address, 3), 64, '0') || ']' AS topics,
  '0x' || lpad(lower(hex(receipt_gas_used * receipt_effective_gas_price)), 64, '0') AS data,
  '{TRANSFER_TOPIC}' AS topics_0
FROM {{txs_a}} WHERE to_address IS NOT NULL""")

_fixture("logs_b", ("logs_a",), """
SELECT block_timestamp, blknum, txhash, txpos, logpos, address,
  CASE WHEN blknum % 10 = 0 THEN 2 ELSE n_topics END AS n_topics, topics,
  CASE WHEN blknum % 15 = 0 THEN NULL ELSE data END AS data, topics_0
FROM {logs_a} WHERE blknum % 13 <> 0""")

_fixture("token_xfers", ("lineitem", "orders"), f"""
SELECT l.l_shipdate AS block_timestamp, l.l_orderkey AS blknum,
  '0x' || md5('lt' || CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING)) || md5('lt#' || CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING)) AS txhash,
  {_addr('tok', 'l.l_partkey % 20')} AS token_address,
  {_addr('u', 'o.o_custkey')} AS from_address,
  {_addr('u', 'l.l_suppkey')} AS to_address,
  CAST(CAST(round(l.l_extendedprice * 100) AS BIGINT) AS STRING) || '000000000000000000000000000000000000000000' AS value
FROM {{lineitem}} l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey""")


DEAL["token_xfers"] = DEAL["btc_traces"] = {"lineitem": "l_orderkey", "orders": "o_orderkey"}


def _daily_counter(frames: dict[str, DataFrame]) -> DataFrame:
    """Counters that start anew each day: a running sum in buckets of an hour."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    e = frames["events"].select(
        F.lit("requests_total").alias("name"), F.col("event_type").alias("job"), (F.col("user_id") % 4).cast("string").alias("instance"),
        "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("value"),
        F.timestamp_diff("MICROSECOND", epoch, F.col("ts")).alias("us"), F.to_date("ts").alias("day"))
    d = bucketed_running_sum(e, ["name", "job", "instance", "day"], "us", ["value"], width=3_600_000_000, tiebreak=["event_id"])
    return d.select("name", "job", "instance", "ts", F.col("cum_value").cast("long").alias("value"))


_fixture("metric_counter", ("events",), """
SELECT 'requests_total' AS name, event_type AS job, CAST(user_id % 4 AS STRING) AS instance, ts,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (
    PARTITION BY event_type, user_id % 4, date_trunc('day', ts) ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS value
FROM {events}""", _daily_counter)

_fixture("metric_gauge", ("events",), """
SELECT 'queue_length' AS name, event_type AS job, CAST(user_id % 4 AS STRING) AS instance, ts,
  CAST(round(value * 100) AS BIGINT) AS value
FROM {events}""")

_fixture("prices", ("events",), f"""
SELECT CAST(event_id AS BIGINT) AS id, ts,
  {_addr('tok', 'user_id % 20')} AS token_address,
  CAST(round(value * 100) AS BIGINT) AS price_cents
FROM {{events}} WHERE event_type IN ('view', 'purchase')""")


# token registry: every part row is one token record (20 addresses, many versions each);
# the latest version per address is the token dimension
_fixture("token_registry", ("part",), f"""
SELECT {_addr('tok', 'p_partkey % 20')} AS address, CAST(p_partkey AS BIGINT) AS blknum,
  upper(substr(p_brand, 7, 2)) || CAST(p_partkey % 20 AS STRING) AS symbol,
  p_name AS name,
  CASE WHEN p_size % 9 = 0 THEN NULL ELSE CAST(p_size % 19 AS INT) END AS decimals,
  p_size % 7 = 3 AS is_proxy,
  CASE WHEN p_size % 7 = 3 THEN {_addr('tok', '(p_partkey + 1) % 20')} ELSE NULL END AS upstream
FROM {{part}}""")

# JSON-RPC block replies landed as text, one per order (every 13th reply is empty)
_fixture("block_json", ("orders",), """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 13 = 0 THEN '{"result":null}'
  ELSE '{"result":{"number":"0x' || lower(hex(o_orderkey)) || '","timestamp":"0x'
       || lower(hex({epoch_open}o_orderdate))) || '","hash":"0x' || md5('blk' || CAST(o_orderkey AS STRING))
       || '","miner":"0x' || md5('m' || CAST(o_custkey % 50 AS STRING)) || '"}}' END AS json
FROM {orders}""")


# one trace per order; finished/open orders create contracts whose bytecode carries PUSH4
# selectors (full ERC-20 set, full ERC-721 set, a PUSH32 constant hiding selectors, none)
_ERC20_CODE = "'6318160ddd14' || '6370a0823114' || '63a9059cbb14' || '6323b872dd14' || '63095ea7b314' || '63dd62ed3e14'"
_ERC721_CODE = ("'6370a0823114' || '636352211e14' || '6342842e0e14' || '63b88d4fde14' || '6323b872dd14' || "
                "'63095ea7b314' || '63a22cb46514' || '63081812fc14' || '63e985e9c514'")
_fixture("evm_traces", ("orders",), f"""
SELECT o_orderdate AS block_timestamp, o_orderkey AS blknum, {_hash64('ctx', 'o_orderkey')} AS txhash,
  CAST(0 AS BIGINT) AS txpos, {_addr('u', 'o_custkey')} AS from_address, {_addr('c', 'o_orderkey')} AS to_address,
  '0' AS value, '0x6080604052' || lower(hex(o_custkey)) AS input,
  CASE o_custkey % 4 WHEN 0 THEN '0x6080604052' || {_ERC20_CODE} || '00'
    WHEN 1 THEN '0x6080604052' || {_ERC721_CODE} || '00'
    WHEN 2 THEN '0x6080604052' || '63a9059cbb14' || '7f' || rpad('63095ea7b363dd62ed3e6318160ddd', 64, '0') || '00'
    ELSE '0x600160020160005260206000f3' END AS output,
  CASE WHEN o_orderstatus = 'F' THEN 'create' WHEN o_orderstatus = 'O' THEN 'create2' ELSE 'call' END AS trace_type,
  '' AS trace_address,
  CAST(CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 1 END AS INT) AS status
FROM {{orders}}""")

# ERC-721 transfer logs: one per line item, token id = part key
_fixture("nft_logs", ("lineitem",), f"""
SELECT l_shipdate AS block_timestamp, l_orderkey AS blknum,
  '0x' || md5('nft' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)) || md5('nft#' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)) AS txhash,
  CAST(l_linenumber AS BIGINT) AS txpos, CAST(l_linenumber AS INT) AS logpos,
  {_addr('nftc', 'l_suppkey % 10')} AS address, CAST(4 AS INT) AS n_topics,
  '[{TRANSFER_TOPIC},0x' || lpad(substr({_addr('u', 'l_suppkey')}, 3), 64, '0') || ',0x'
    || lpad(substr({_addr('u', 'l_partkey % 150')}, 3), 64, '0') || ',0x' || lpad(lower(hex(l_partkey)), 64, '0') || ']' AS topics,
  '0x' AS data
FROM {{lineitem}}""")

TRANSFER_SINGLE = "0xc3d58168c5ae7397731d063d5bbf3d657854427343f4c083240f7aacaa2d0f62"
TRANSFER_BATCH = "0x4a39dc06d4c0dbc64b70af90fd698a233a518aa5d07e595d983b8c0526c8f7fb"
_W = "lpad(lower(hex(CAST({x} AS BIGINT))), 64, '0')"
_fixture("erc1155_logs", ("lineitem",), f"""
SELECT l_shipdate AS block_timestamp, l_orderkey AS blknum,
  '0x' || md5('mt' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)) || md5('mt#' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)) AS txhash,
  CAST(l_linenumber AS BIGINT) AS txpos, CAST(l_linenumber AS INT) AS logpos,
  {_addr('mt', 'l_partkey % 5')} AS address, CAST(4 AS INT) AS n_topics,
  '[' || CASE WHEN l_returnflag = 'N' THEN '{TRANSFER_SINGLE}' ELSE '{TRANSFER_BATCH}' END
    || ',0x' || lpad(substr({_addr('op', 'l_suppkey % 3')}, 3), 64, '0')
    || ',0x' || lpad(substr({_addr('u', 'l_suppkey')}, 3), 64, '0')
    || ',0x' || lpad(substr({_addr('u', 'l_partkey % 150')}, 3), 64, '0') || ']' AS topics,
  '0x' || CASE WHEN l_returnflag = 'N' THEN {_W.format(x='l_partkey')} || {_W.format(x='l_quantity')}
    WHEN l_orderkey % 50 = 7 AND l_linenumber = 1 THEN repeat('f', 64) || {_W.format(x='160')} || {_W.format(x='2')}
    WHEN l_orderkey % 50 = 8 AND l_linenumber = 1 THEN {_W.format(x='64')} || {_W.format(x='128')} || lpad('7fffffffffffffff', 64, '0') || {_W.format(x='1')} || lpad('7fffffffffffffff', 64, '0') || {_W.format(x='1')}
    WHEN l_orderkey % 50 = 9 AND l_linenumber = 1 THEN {_W.format(x='64')} || {_W.format(x='96')} || {_W.format(x='3')} || {_W.format(x='3')} || {_W.format(x='1')}
    WHEN l_orderkey % 50 = 10 AND l_linenumber = 1 THEN {_W.format(x='65')} || {_W.format(x='128')} || {_W.format(x='1')}
    WHEN l_orderkey % 50 = 11 AND l_linenumber = 1 THEN {_W.format(x='64')}
    ELSE {_W.format(x='64')} || {_W.format(x='160')} || {_W.format(x='2')} || {_W.format(x='l_partkey')}
      || {_W.format(x='l_suppkey')} || {_W.format(x='2')} || {_W.format(x='l_quantity')} || {_W.format(x='l_linenumber')} END AS data
FROM {{lineitem}}""")

# function signatures: one per part; selectors shared by parts of the same type
_fixture("func_signs", ("part",), """
SELECT '0x' || substr(md5(p_type), 1, 8) AS byte_sign,
  lower(replace(p_name, ' ', '_')) || '(address,uint256)' AS text_sign,
  '{"name":"' || lower(replace(p_name, ' ', '_')) || '","type":"function","inputs":[{"name":"to","type":"address"},{"name":"amount","type":"uint256"}]}' AS abi,
  CAST(p_size AS INT) AS score
FROM {part}""")

# mempool snapshot: every transaction seen 30 s before its block; mined set = second load
_fixture("txpools", ("txs_a",), """
SELECT block_timestamp - INTERVAL '30' SECOND AS block_timestamp, txhash, nonce, from_address, to_address, value,
  CASE WHEN nonce % 3 = 0 THEN 'queued' ELSE 'pending' END AS pool_type
FROM {txs_a}""")


# price quotes from two providers (views → cgc, purchases → cmc) for source reconciliation
_fixture("price_quotes", ("events",), f"""
SELECT CASE WHEN event_type = 'view' THEN 'cgc' ELSE 'cmc' END AS source, ts,
  {_addr('tok', 'user_id % 20')} AS token_address, CAST(round(value * 100) AS BIGINT) AS price_cents
FROM {{events}} WHERE event_type IN ('view', 'purchase')""")

# UTXO chain: every line item is an output of its order's transaction; every order that is
# not 'P' (coinbase) spends output 0 of the previous order's transaction
_fixture("btc_traces", ("lineitem", "orders"), f"""
SELECT o.o_orderdate AS block_timestamp, l.l_orderkey AS blknum, {_hash64('btx', 'l.l_orderkey')} AS txhash,
  o.o_orderstatus = 'P' AS is_coinbase, false AS is_in, CAST(NULL AS STRING) AS pxhash,
  CAST(l.l_linenumber - 1 AS INT) AS vout_idx, {_addr('b', 'l.l_suppkey')} AS address,
  CAST(round(l.l_extendedprice * 100) AS BIGINT) AS value
FROM {{lineitem}} l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey
UNION ALL
SELECT o_orderdate, o_orderkey, {_hash64('btx', 'o_orderkey')}, false, true, {_hash64('btx', 'o_orderkey - 1')},
  CAST(0 AS INT), CAST(NULL AS STRING), CAST(0 AS BIGINT)
FROM {{orders}} WHERE o_orderstatus <> 'P' AND o_orderkey > 0""")


# contract calls: transfer(address,uint256) payloads to the 20 token contracts; error events
# carry a truncated payload, click events a dirty address padding
_GOOD_CALL = ("'0xa9059cbb' || lpad(substr(" + _addr('u', 'user_id * 3 % 150') + ", 3), 64, '0')"
              " || lpad(lower(hex(CAST(round(value * 100) AS BIGINT))), 64, '0')")
_fixture("abi_txs", ("events",), f"""
SELECT ts AS block_timestamp, {_hash64('tx', 'event_id')} AS txhash, {_addr('tok', 'user_id % 20')} AS to_address,
  CASE WHEN event_type = 'error' THEN substr({_GOOD_CALL}, 1, 74)
       WHEN event_type = 'click' THEN '0xa9059cbb' || 'ff' || substr({_GOOD_CALL}, 13)
       ELSE {_GOOD_CALL} END AS input
FROM {{events}}""")

_TRANSFER_FN = '{"name":"transfer","type":"function","inputs":[{"name":"to","type":"address"},{"name":"amount","type":"uint256"}]}'
_TRANSFER_EV = ('{"name":"Transfer","type":"event","inputs":[{"name":"from","type":"address","indexed":true},'
                '{"name":"to","type":"address","indexed":true},{"name":"value","type":"uint256","indexed":false}]}')
# signatures known for 15 of the 20 token contracts (function and event ABIs)
_fixture("abi_sigs", ("part",), f"""
SELECT DISTINCT {_addr('tok', 'p_partkey % 20')} AS address, '0xa9059cbb' AS byte_sign,
  '{_TRANSFER_FN}' AS abi, 'transfer(address to, uint256 amount)' AS prototype
FROM {{part}} WHERE p_partkey % 20 < 15
UNION ALL
SELECT DISTINCT {_addr('tok', 'p_partkey % 20')}, '{TRANSFER_TOPIC}', '{_TRANSFER_EV}',
  'Transfer(address from, address to, uint256 value)'
FROM {{part}} WHERE p_partkey % 20 < 15""")

ENGINE_TOKENS = {
    "spark": {"fanout3": "explode(array(0, 1, 2))",
              "epoch_open": "timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', "},
    "duckdb": {"fanout3": "unnest([0, 1, 2])",
               "epoch_open": "date_diff('second', TIMESTAMP '1970-01-01 00:00:00', "},
}


def register(name: str, deps: tuple[str, ...], sql: str) -> None:
    """Add a derived frame (used by other modules for their own dual-engine inputs)."""
    _fixture(name, deps, sql)


def load_base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _dealt(frames: dict[str, DataFrame], by: dict[str, str]) -> dict[str, DataFrame]:
    """Frames dealt by their join columns to as many tasks as their rows need, so that what a task
    holds does not grow with them. The rows come from the Parquet footers; few are left as they are."""
    tasks = -(-max(frames[t].count() for t in by) // ROWS_A_TASK)
    return frames if tasks < 8 else {t: f.repartition(tasks, by[t]) if t in by else f for t, f in frames.items()}


def load(spark: SparkSession, sf_dir: str, name: str, _memo: dict | None = None) -> DataFrame:
    """Build fixture ``name`` (and its dependencies) as a lazy DataFrame."""
    memo = {} if _memo is None else _memo
    if name in memo:
        return memo[name]
    if name in BASE_TABLES:
        df = load_base(spark, sf_dir, name)
    else:
        frames = {d: load(spark, sf_dir, d, memo) for d in DEPS[name]}
        if name in BUILD:
            memo[name] = BUILD[name](frames)
            return memo[name]
        if name in DEAL:
            frames = _dealt(frames, DEAL[name])
        text = SQL[name]
        for tok, val in ENGINE_TOKENS["spark"].items():
            text = text.replace("{" + tok + "}", val)
        # spark.sql formats the text: escape literal braces, keep the frame placeholders
        text = text.replace("{", "{{").replace("}", "}}")
        for d in frames:
            text = text.replace("{{" + d + "}}", "{" + d + "}")
        df = spark.sql(text, **frames)
    memo[name] = df
    return df


def _closure(names) -> list[str]:
    order: list[str] = []

    def visit(n):
        if n in BASE_TABLES or n in order:
            return
        for d in DEPS[n]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return order


def duckdb_sql(name: str) -> str:
    """DuckDB text of one fixture with table placeholders resolved to plain names."""
    text = SQL[name]
    for tok, val in ENGINE_TOKENS["duckdb"].items():
        text = text.replace("{" + tok + "}", val)
    for d in DEPS[name]:
        text = text.replace("{" + d + "}", d)
    return text


def with_fixtures(sql: str, uses: tuple[str, ...]) -> str:
    """Prefix a DuckDB query with CTEs for every fixture it (transitively) uses."""
    ctes = [f"{n} AS ({duckdb_sql(n)}\n)" for n in _closure(uses)]
    if not ctes:
        return sql
    body = sql.lstrip()
    if body[:14].upper() == "WITH RECURSIVE":
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[14:].lstrip()
    if body[:4].upper() == "WITH":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[4:].lstrip()
    return "WITH " + ",\n".join(ctes) + "\n" + body
