"""Declared table schemas for account-based (EVM, Tron) and UTXO (Bitcoin) chains.

Nothing is inferred: every table is a fixed StructType. uint256 quantities are canonical
unsigned base-10 strings (see ``chainframe.functions.u256``); timestamps are
TIMESTAMP_NTZ (no zone), matching the reference's ``TIMESTAMP`` columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TS = T.TimestampNTZType()
S = T.StringType()
L = T.LongType()
I = T.IntegerType()  # noqa: E741
SH = T.ShortType()
B = T.BooleanType()
D = T.DateType()
U256 = T.StringType()  # canonical decimal string


def _st(*cols: tuple) -> T.StructType:
    return T.StructType([T.StructField(c[0], c[1], c[2] if len(c) > 2 else True) for c in cols])


BLOCKS = _st(
    ("block_timestamp", TS, False), ("blknum", L, False), ("blkhash", S, False), ("parent_hash", S),
    ("nonce", S), ("sha3_uncles", S), ("logs_bloom", S), ("txs_root", S), ("state_root", S),
    ("receipts_root", S), ("miner", S), ("difficulty", U256), ("total_difficulty", U256),
    ("blk_size", L), ("extra_data", S), ("gas_limit", L), ("gas_used", L), ("tx_count", L),
    ("base_fee_per_gas", U256), ("uncle_count", SH), ("uncle0_hash", S), ("uncle1_hash", S),
    ("item_id", S),
)

TXS = _st(
    ("block_timestamp", TS, False), ("blknum", L, False), ("txhash", S, False), ("txpos", L, False),
    ("nonce", L), ("from_address", S), ("to_address", S), ("value", U256), ("gas", L),
    ("gas_price", U256), ("input", S), ("max_fee_per_gas", L), ("max_priority_fee_per_gas", L),
    ("tx_type", I), ("receipt_cumulative_gas_used", L), ("receipt_gas_used", L),
    ("receipt_contract_address", S), ("receipt_root", S), ("receipt_status", I),
    ("receipt_effective_gas_price", U256), ("receipt_log_count", L), ("item_id", S),
)

# mempool rows: the first 14 transaction columns, txpos NULL until mined, plus pool_type
TXPOOLS = T.StructType(TXS.fields[:14] + [T.StructField("pool_type", S), T.StructField("item_id", S)])

TRACES = _st(
    ("block_timestamp", TS, False), ("blknum", L, False), ("txhash", S), ("txpos", L),
    ("from_address", S), ("to_address", S), ("value", U256), ("input", S), ("output", S),
    ("trace_type", S, False), ("call_type", S), ("reward_type", S), ("gas", L), ("gas_used", L),
    ("subtraces", L), ("trace_address", S), ("error", S), ("status", I), ("item_id", S),
)

LOGS = _st(
    ("block_timestamp", TS, False), ("blknum", L, False), ("txhash", S, False), ("txpos", L),
    ("logpos", I, False), ("address", S), ("n_topics", I), ("topics", S), ("data", S),
    ("topics_0", S), ("item_id", S),
)
# v2 logs drop topics_0; ClickHouse flavour keeps it
LOGS_V2 = T.StructType([f for f in LOGS.fields if f.name != "topics_0"])

CONTRACTS = _st(
    ("block_timestamp", TS, False), ("blknum", L, False), ("txhash", S), ("txpos", L),
    ("trace_type", S), ("trace_address", S), ("address", S), ("creater", S), ("initcode", S),
    ("bytecode", S), ("func_sighashes", S), ("is_erc20", B), ("is_erc721", B), ("item_id", S),
)

TOKENS = _st(
    ("block_timestamp", TS), ("blknum", L), ("txhash", S), ("txpos", L), ("trace_address", S),
    ("address", S, False), ("symbol", S), ("name", S), ("decimals", I), ("total_supply", U256),
    ("is_erc20", B), ("is_erc721", B), ("is_erc1155", B), ("source", S), ("is_proxy", B),
    ("upstream", S),
)

TOKEN_XFERS = _st(
    ("block_timestamp", TS, False), ("blknum", L, False), ("txhash", S, False), ("txpos", L),
    ("logpos", L), ("token_address", S), ("from_address", S), ("to_address", S), ("value", U256),
    ("name", S), ("symbol", S), ("decimals", L), ("item_id", S),
)

ERC721_XFERS = _st(
    ("block_timestamp", TS, False), ("blknum", L, False), ("txhash", S, False), ("txpos", L),
    ("logpos", L), ("token_address", S), ("from_address", S), ("to_address", S), ("token_id", U256),
    ("name", S), ("symbol", S), ("item_id", S),
)

ERC1155_XFERS = _st(
    ("block_timestamp", TS, False), ("blknum", L, False), ("txhash", S, False), ("txpos", L),
    ("logpos", L), ("token_address", S), ("operator", S), ("from_address", S), ("to_address", S),
    ("token_id", U256), ("value", U256), ("id_pos", L), ("id_cnt", L), ("xfer_type", S),
    ("name", S), ("symbol", S), ("item_id", S),
)

SIGNATURES = _st(("address", S), ("byte_sign", S), ("abi", S), ("prototype", S))
FUNC_SIGNS = _st(("pkey", S), ("byte_sign", S, False), ("text_sign", S, False), ("abi", S), ("score", I))
PRICES_CGC = _st(("st", I), ("cgc_id", S), ("chain", S), ("token_address", S), ("name", S),
                 ("symbol", S), ("price", T.DecimalType(38, 18), False))
PRICES_CMC = _st(("st", I), ("cmc_id", S), ("chain", S), ("token_address", S), ("name", S),
                 ("symbol", S), ("price", T.DecimalType(38, 18), False))

BTC_BLOCKS = _st(
    ("block_timestamp", TS, False), ("_st", I), ("_st_day", D), ("blknum", L), ("blkhash", S),
    ("tx_count", L), ("blk_size", L), ("miner", S), ("item_id", S),
)
BTC_TXS = _st(
    ("block_timestamp", TS, False), ("_st", I), ("_st_day", D), ("blknum", L), ("txhash", S),
    ("txpos", SH), ("is_coinbase", B), ("input_count", I), ("input_value", L),
    ("output_count", I), ("output_value", L), ("fee", L), ("item_id", S),
)
BTC_TRACES = _st(
    ("block_timestamp", TS, False), ("_st", I), ("_st_day", D), ("blknum", L), ("txhash", S),
    ("txpos", SH), ("is_coinbase", B), ("is_in", B), ("pxhash", S), ("tx_in_value", L),
    ("tx_out_value", L), ("vin_seq", L), ("vin_idx", I), ("vin_cnt", I), ("vin_type", S),
    ("vout_idx", I), ("vout_cnt", I), ("vout_type", S), ("address", S), ("value", L),
    ("script_hex", S), ("script_asm", S), ("req_sigs", I), ("txinwitness", S), ("item_id", S),
)

TRON_BLOCKS = _st(
    ("block_timestamp", TS), ("blknum", L, False), ("blkhash", S), ("parent_hash", S), ("txs_root", S),
    ("miner", S), ("version", I), ("tx_count", I), ("extra_data", S),
)
TRON_LOGS = T.StructType([f for f in LOGS.fields if f.name != "item_id"])
TRON_TOKEN_XFERS = T.StructType([f for f in TOKEN_XFERS.fields if f.name != "item_id"])
TRON_TXS = _st(
    ("block_timestamp", TS, False), ("blknum", L), ("txhash", S), ("txpos", L), ("tx_type", S),
    ("from_address", S), ("to_address", S), ("value", U256), ("input", S), ("token", S),
    ("amount", U256), ("votes", S), ("frozen_days", L), ("frozen_balance", L),
    ("account_name", S), ("token_name", S), ("total_supply", U256), ("trx_num", L),
    ("start_time", L), ("end_time", L), ("error", S),
)

METRICS = _st(("name", S, False), ("labels", T.MapType(S, S)), ("series_key", S, False),
              ("ts", TS, False), ("value", T.DoubleType()))

EVM_TABLES = {
    "blocks": BLOCKS, "txs": TXS, "txpools": TXPOOLS, "traces": TRACES, "logs": LOGS,
    "contracts": CONTRACTS, "tokens": TOKENS, "token_xfers": TOKEN_XFERS,
    "erc721_xfers": ERC721_XFERS, "erc1155_xfers": ERC1155_XFERS,
}

# column defaults applied only when a column is absent from the input (fixed values)
DEFAULTS = {
    "blocks": {"uncle_count": 0},
    "tokens": {"decimals": -1, "source": "contract"},
    "btc_traces": {"is_coinbase": False},
    "btc_txs": {"is_coinbase": False},
    "func_signs": {"score": 0},
}

# table lifecycle policies (fixed values). Chunk interval: 7 days (the hypertable default,
# and explicit for tron). Compression age per table; retention only where declared.
CHUNK_INTERVAL = "7 days"
COMPRESS_AFTER = {
    "evm": {"blocks": "60 days", "txs": "30 days", "traces": "30 days", "logs": "30 days",
            "token_xfers": "30 days", "erc721_xfers": "30 days", "erc1155_xfers": "30 days"},
    "tron": {"blocks": "10 days", "txs": "5 days", "logs": "5 days", "token_xfers": "5 days"},
    "bitcoin": {"blocks": "30 days", "txs": "30 days", "traces": "30 days"},
}
RETAIN_FOR = {
    "evm": {"txpools": "6 hours"},
    "tron": {"txs": "32 days", "logs": "32 days", "token_xfers": "32 days"},
    "metrics": {"samples": "30 days"},
}
# clustered layout of compressed chunks: segment by block number, order by item id then time
SEGMENT_BY = "blknum"
ORDER_BY = ("item_id", "block_timestamp")


# every stored table ends with these
AUDIT = (T.StructField("created_at", TS, False), T.StructField("updated_at", TS, False))


def balance_schema(roles: list[str], *, firsts: bool, token: bool = False) -> T.StructType:
    """Columns of a balance table: counts and values per role, optionally first and last activity."""
    cols = [("address", S, False), *([("token_address", S, False)] if token else []), ("blknum", L, False)]
    for r in roles:
        if r != "fee":
            cols += [(f"{r}_{m}", L) for m in ("blocks", "txs", "xfers")]
        cols.append((f"{r}_value", U256))
        if firsts and r != "fee":
            cols += [(f"{r}_1th_st", I), (f"{r}_nth_st", I), (f"{r}_1th_blknum", L), (f"{r}_nth_blknum", L),
                     (f"{r}_1th_st_day", D), (f"{r}_nth_st_day", D)]
    return _st(*cols, ("value", U256, False), ("balance", U256))


def chain_schemas(chain: str, *, flavour: str = "v1", include_optional: bool = True, audit: bool = False) -> dict[str, T.StructType]:
    """Per-chain table schemas, keyed by ``<chain>.<table>``.

    ``flavour``: ``v1`` (with ``logs.topics_0``), ``v2`` (without), ``ch`` (monthly partitions;
    same columns as v1). ``include_optional`` adds txpools and NFT transfer tables, ``audit``
    the created_at and updated_at columns that every stored table has.
    """
    tables = dict(EVM_TABLES)
    if flavour == "v2":
        tables["logs"] = LOGS_V2
    if not include_optional:
        for t in ("txpools", "erc721_xfers", "erc1155_xfers"):
            tables.pop(t)
    if chain == "bitcoin":
        tables = {"blocks": BTC_BLOCKS, "txs": BTC_TXS, "traces": BTC_TRACES}
    elif chain == "tron":
        tables = {"blocks": TRON_BLOCKS, "txs": TRON_TXS, "logs": TRON_LOGS, "tokens": TOKENS,
                  "token_xfers": TRON_TOKEN_XFERS}
    else:
        tables |= {"latest_balances": balance_schema(["out", "vin", "cnb", "fee"], firsts=True),
                   "history_balances": balance_schema(["out", "vin", "cnb", "fee"], firsts=False),
                   "token_latest_balances": balance_schema(["out", "vin"], firsts=True, token=True),
                   "token_history_balances": balance_schema(["out", "vin"], firsts=False, token=True)}
    if chain == "bitcoin":
        tables["latest_balances"] = balance_schema(["out", "vin", "cnb"], firsts=True)
    tables |= {"func_signs": FUNC_SIGNS, "signatures": SIGNATURES, "prices_cgc": PRICES_CGC, "prices_cmc": PRICES_CMC}
    if audit:
        tables = {k: T.StructType([*v.fields, *AUDIT]) for k, v in tables.items()}
    return {f"{chain}.{k}": v for k, v in tables.items()}


def chain_catalog(spark, chain: str, **options) -> DataFrame:
    """The chain's tables as rows: table_name, position, column_name, data_type, nullable."""
    rows = [(t, i, f.name, f.dataType.simpleString(), f.nullable)
            for t, s in chain_schemas(chain, **options).items() for i, f in enumerate(s.fields)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string, nullable boolean")


def conform(df: DataFrame, schema: T.StructType, *, derive_topics_0: bool = True) -> DataFrame:
    """Project ``df`` onto ``schema``: cast present columns, add absent ones as typed NULL.

    When the target has ``topics_0`` and the input does not, it is derived from ``topics``
    (first element of the bracketed list), so v2 logs can be diffed against v1.
    """
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        if f.name in have:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name == "topics_0" and derive_topics_0 and "topics" in have:
            first = F.element_at(F.split(F.regexp_replace(F.col("topics"), r"^\[|\]$", ""), ","), 1)
            cols.append(F.when(F.col("topics").isNull(), None).otherwise(first).cast(S).alias("topics_0"))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)
