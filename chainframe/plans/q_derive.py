"""Derived-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainframe.functions import evm as E
from chainframe.operators import derive as DV
from chainframe.operators import lookups as LK
from chainframe.plans.registry import query
from chainframe.sources import fixtures as FX


def dhex(e: str) -> str:
    """DuckDB hex → decimal text (exact up to 128 bits, enough for every fixture value)."""
    return f"CAST(CAST('0x' || COALESCE(NULLIF(ltrim({e}, '0'), ''), '0') AS UHUGEINT) AS VARCHAR)"


def dtopics(col: str = "topics") -> str:
    return f"string_split(regexp_replace(regexp_replace({col}, '^\\[', ''), '\\]$', ''), ',')"


def _tokens(spark, sf_dir, memo=None):
    return DV.tokens_latest(FX.load(spark, sf_dir, "token_registry", memo))


TOK_SQL = "(SELECT * FROM token_registry QUALIFY row_number() OVER (PARTITION BY address ORDER BY blknum DESC) = 1)"


@query("logs_normalize", f"""
SELECT txhash, logpos, CAST(len({dtopics()}) AS INTEGER) AS n_topics, {dtopics()}[1] AS topics_0,
  {dtopics()}[2] AS topic_1 FROM logs_b""", ("logs_b",))
def logs_normalize(spark, sf_dir):
    """Topics text → array, n_topics, topics_0."""
    l = DV.normalize_logs(FX.load(spark, sf_dir, "logs_b"))
    return l.select("txhash", "logpos", "n_topics", "topics_0", F.element_at("topic_list", 2).alias("topic_1"))


@query("tokens_latest", f"SELECT address, blknum, symbol, name, decimals FROM {TOK_SQL}", ("token_registry",))
def tokens_latest(spark, sf_dir):
    """Latest token record per address."""
    return _tokens(spark, sf_dir).select("address", "blknum", "symbol", "name", "decimals")


@query("token_transfers", f"""
SELECT l.block_timestamp, l.blknum, l.txhash, l.txpos, CAST(l.logpos AS BIGINT) AS logpos, l.address AS token_address,
  '0x' || lower(right(l.t[2], 40)) AS from_address, '0x' || lower(right(l.t[3], 40)) AS to_address,
  {dhex("substr(regexp_replace(l.data, '^0[xX]', ''), 1, 64)")} AS value,
  tok.name, tok.symbol, CAST(tok.decimals AS BIGINT) AS decimals,
  concat_ws('_', 'token_xfer', l.txhash, CAST(l.logpos AS VARCHAR)) AS item_id
FROM (SELECT *, {dtopics()} AS t FROM logs_a) l LEFT JOIN {TOK_SQL} tok ON l.address = tok.address
WHERE l.n_topics = 3 AND l.t[1] = '{E.TRANSFER_TOPIC}'""", ("logs_a", "token_registry"))
def token_transfers(spark, sf_dir):
    """D4 + J9: ERC-20 transfers decoded natively from logs, enriched with token metadata."""
    memo: dict = {}
    return DV.erc20_transfers(FX.load(spark, sf_dir, "logs_a", memo), _tokens(spark, sf_dir, memo))


@query("erc721_transfers", f"""
SELECT l.block_timestamp, l.blknum, l.txhash, l.txpos, CAST(l.logpos AS BIGINT) AS logpos, l.address AS token_address,
  '0x' || lower(right(l.t[2], 40)) AS from_address, '0x' || lower(right(l.t[3], 40)) AS to_address,
  {dhex("regexp_replace(l.t[4], '^0[xX]', '')")} AS token_id,
  CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS symbol,
  concat_ws('_', 'erc721_xfer', l.txhash, CAST(l.logpos AS VARCHAR)) AS item_id
FROM (SELECT *, {dtopics()} AS t FROM nft_logs) l WHERE l.n_topics = 4 AND l.t[1] = '{E.TRANSFER_TOPIC}'""", ("nft_logs",))
def erc721_transfers(spark, sf_dir):
    """ERC-721 transfers (token id in the third indexed topic)."""
    return DV.erc721_transfers(FX.load(spark, sf_dir, "nft_logs"))


@query("nft_history", f"""
SELECT token_id, block_timestamp, from_address, to_address, txhash FROM (
  SELECT l.block_timestamp, l.txhash, '0x' || lower(right(l.t[2], 40)) AS from_address,
    '0x' || lower(right(l.t[3], 40)) AS to_address, {dhex("regexp_replace(l.t[4], '^0[xX]', '')")} AS token_id, l.address
  FROM (SELECT *, {dtopics()} AS t FROM nft_logs) l WHERE l.n_topics = 4 AND l.t[1] = '{E.TRANSFER_TOPIC}')
WHERE address = '0x' || md5('nftc3') || substr(md5('nftc#3'), 1, 8)""", ("nft_logs",))
def nft_history(spark, sf_dir):
    """Transfer history of one collection, by (token id, time) — the NFT index path."""
    addr = F.concat(F.lit("0x"), F.md5(F.lit("nftc3")), F.substring(F.md5(F.lit("nftc#3")), 1, 8))
    return LK.nft_history(DV.erc721_transfers(FX.load(spark, sf_dir, "nft_logs")), addr)


def _small(w: str) -> str:
    """A word as BIGINT, NULL unless whole and below 2^63."""
    return (f"CASE WHEN length({w}) = 64 AND substr({w}, 1, 48) = repeat('0', 48) "
            f"THEN TRY_CAST(CAST('0x' || substr({w}, 49, 16) AS UBIGINT) AS BIGINT) END")


_ERC1155_CTE = f"""
WITH l AS (SELECT *, {dtopics()} AS t, regexp_replace(data, '^0[xX]', '') AS d FROM erc1155_logs
           WHERE n_topics = 4 AND {dtopics()}[1] IN ('{E.TRANSFER_SINGLE_TOPIC}', '{E.TRANSFER_BATCH_TOPIC}')),
o AS (SELECT *, t[1] = '{E.TRANSFER_BATCH_TOPIC}' AS is_batch, length(d) // 64 AS words,
        {_small("substr(d, 1, 64)")} AS o0, {_small("substr(d, 65, 64)")} AS o1 FROM l),
offs AS (SELECT *, CASE WHEN is_batch AND o0 % 32 = 0 AND o1 % 32 = 0 AND o0 < words * 32 AND o1 < words * 32 THEN o0 // 32 END AS a0,
        CASE WHEN is_batch AND o0 % 32 = 0 AND o1 % 32 = 0 AND o0 < words * 32 AND o1 < words * 32 THEN o1 // 32 END AS a1 FROM o),
n AS (SELECT *, {_small("substr(d, a0 * 64 + 1, 64)")} AS n0, {_small("substr(d, a1 * 64 + 1, 64)")} AS n1 FROM offs),
c AS (SELECT *, CASE WHEN NOT is_batch THEN CASE WHEN words >= 2 THEN 1 ELSE 0 END
                     WHEN n0 = n1 AND n0 <= words - 1 - a0 AND n1 <= words - 1 - a1 THEN n0 ELSE 0 END AS id_cnt FROM n)"""

_ERC1155_SQL = _ERC1155_CTE + f""",
q AS (SELECT *, unnest(range(0, id_cnt)) AS id_pos FROM c)
SELECT block_timestamp, blknum, txhash, txpos, CAST(logpos AS BIGINT) AS logpos, address AS token_address,
  '0x' || lower(right(t[2], 40)) AS operator, '0x' || lower(right(t[3], 40)) AS from_address,
  '0x' || lower(right(t[4], 40)) AS to_address, CASE WHEN is_batch THEN 'batch' ELSE 'single' END AS xfer_type,
  CAST(id_pos AS BIGINT) AS id_pos, CAST(id_cnt AS BIGINT) AS id_cnt,
  {dhex("CASE WHEN is_batch THEN substr(d, (a0 + 1 + id_pos) * 64 + 1, 64) ELSE substr(d, 1, 64) END")} AS token_id,
  {dhex("CASE WHEN is_batch THEN substr(d, (a1 + 1 + id_pos) * 64 + 1, 64) ELSE substr(d, 65, 64) END")} AS value,
  CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS symbol,
  concat_ws('_', 'erc1155_xfer', txhash, CAST(logpos AS VARCHAR), CAST(id_pos AS VARCHAR)) AS item_id
FROM q"""


@query("erc1155_transfers", _ERC1155_SQL, ("erc1155_logs",))
def erc1155_transfers(spark, sf_dir):
    """ERC-1155 single and batch transfers, one row per (log, id position)."""
    return DV.erc1155_transfers(FX.load(spark, sf_dir, "erc1155_logs"))


@query("erc1155_rejects", _ERC1155_CTE + """
SELECT address AS token_address, CAST(count(*) AS BIGINT) AS rejected FROM c WHERE id_cnt = 0 GROUP BY address""", ("erc1155_logs",))
def erc1155_rejects(spark, sf_dir):
    """Malformed ERC-1155 logs per collection (they give no transfers and no error)."""
    return DV.erc1155_rejects(FX.load(spark, sf_dir, "erc1155_logs"))


@query("contract_creations", """
SELECT block_timestamp, blknum, txhash, from_address FROM txs_a WHERE to_address IS NULL""", ("txs_a",))
def contract_creations(spark, sf_dir):
    """Contract-creating transactions (no receiver)."""
    return DV.contract_creations(FX.load(spark, sf_dir, "txs_a")).select("block_timestamp", "blknum", "txhash", "from_address")


@query("contracts", """
SELECT block_timestamp, blknum, txhash, txpos, trace_type, trace_address, to_address AS address, from_address AS creater,
  input AS initcode, output AS bytecode, concat_ws('_', 'contract', txhash, trace_address) AS item_id
FROM evm_traces WHERE trace_type IN ('create', 'create2') AND status = 1""", ("evm_traces",))
def contracts(spark, sf_dir):
    """Contracts from successful create/create2 traces."""
    return DV.contracts(FX.load(spark, sf_dir, "evm_traces"))


_ERC20 = ", ".join(f"'{s}'" for s in E.ERC20_SELECTORS)
_ERC721 = ", ".join(f"'{s}'" for s in E.ERC721_SELECTORS)


@query("contract_standards", f"""
WITH RECURSIVE c AS (
  SELECT to_address AS address, txhash, substr(output, 3) AS code FROM evm_traces
  WHERE trace_type IN ('create', 'create2') AND status = 1),
walk(txhash, code, pos, sel) AS (
  SELECT txhash, code, 0, CAST(NULL AS VARCHAR) FROM c
  UNION ALL
  SELECT txhash, code, pos + 1 + CASE WHEN op BETWEEN 96 AND 127 THEN op - 95 ELSE 0 END,
    CASE WHEN op = 99 AND 2 * pos + 10 <= length(code) THEN '0x' || lower(substr(code, 2 * pos + 3, 8)) END
  FROM (SELECT txhash, code, pos, CAST(('0x' || substr(code, 2 * pos + 1, 2)) AS INTEGER) AS op
        FROM walk WHERE 2 * pos < length(code)) s),
firsts AS (SELECT txhash, sel, min(pos) AS p FROM walk WHERE sel IS NOT NULL GROUP BY txhash, sel),
agg AS (SELECT txhash, string_agg(sel, ',' ORDER BY p) AS func_sighashes,
   count(*) FILTER (WHERE sel IN ({_ERC20})) = {len(E.ERC20_SELECTORS)} AS is_erc20,
   count(*) FILTER (WHERE sel IN ({_ERC721})) = {len(E.ERC721_SELECTORS)} AS is_erc721 FROM firsts GROUP BY txhash)
SELECT c.address, c.txhash, COALESCE(agg.func_sighashes, '') AS func_sighashes,
  COALESCE(agg.is_erc20, false) AS is_erc20, COALESCE(agg.is_erc721, false) AS is_erc721
FROM c LEFT JOIN agg ON c.txhash = agg.txhash""", ("evm_traces",))
def contract_standards(spark, sf_dir):
    """D3: PUSH4 selectors by opcode walk (once per distinct bytecode) and ERC-20/721 flags."""
    cs = DV.classify_contracts(DV.contracts(FX.load(spark, sf_dir, "evm_traces")))
    return cs.select("address", "txhash", F.coalesce("func_sighashes", F.lit("")).alias("func_sighashes"), "is_erc20", "is_erc721")


FX.register("receipts", ("txs_a",), """
SELECT txhash, receipt_gas_used + 7 AS gas_used, receipt_gas_used * 3 AS cumulative_gas_used,
  receipt_effective_gas_price + 1 AS effective_gas_price, receipt_status AS status,
  CASE WHEN to_address IS NULL THEN '0x' || substr(txhash, 27, 40) END AS contract_address
FROM {txs_a} WHERE (blknum * 5 + txpos) % 11 <> 0""")


@query("tx_receipts", """
SELECT t.txhash, CAST(COALESCE(n, 0) AS BIGINT) AS receipt_log_count, r.gas_used AS receipt_gas_used,
  r.cumulative_gas_used AS receipt_cumulative_gas_used, r.effective_gas_price AS receipt_effective_gas_price,
  r.status AS receipt_status, r.contract_address AS receipt_contract_address
FROM txs_a t LEFT JOIN (SELECT txhash, count(*) AS n FROM logs_a GROUP BY txhash) l ON t.txhash = l.txhash
LEFT JOIN receipts r ON t.txhash = r.txhash""", ("txs_a", "logs_a", "receipts"))
def tx_receipts(spark, sf_dir):
    """Transactions enriched with their receipts and log counts."""
    memo: dict = {}
    r = DV.tx_receipts(*[FX.load(spark, sf_dir, t, memo) for t in ("txs_a", "logs_a", "receipts")])
    return r.select("txhash", "receipt_log_count", *[f"receipt_{c}" for c in (
        "gas_used", "cumulative_gas_used", "effective_gas_price", "status", "contract_address")])


@query("proxy_tokens", f"""
SELECT t.address, t.is_proxy, t.upstream,
  CASE WHEN t.is_proxy AND u.address IS NOT NULL THEN u.name ELSE t.name END AS eff_name,
  CASE WHEN t.is_proxy AND u.address IS NOT NULL THEN u.symbol ELSE t.symbol END AS eff_symbol,
  CASE WHEN t.is_proxy AND u.address IS NOT NULL THEN u.decimals ELSE t.decimals END AS eff_decimals
FROM {TOK_SQL} t LEFT JOIN {TOK_SQL} u ON t.upstream = u.address""", ("token_registry",))
def proxy_tokens(spark, sf_dir):
    """Proxy tokens resolved to their upstream token's metadata."""
    return DV.proxy_tokens(_tokens(spark, sf_dir))


@query("trace_tree", """
WITH t AS (SELECT * FROM traces_a WHERE txhash IS NOT NULL AND trace_address IS NOT NULL),
k AS (SELECT block_timestamp, txhash, regexp_replace(trace_address, '(^|,)[0-9]+$', '') AS parent, count(*) AS n
      FROM t WHERE trace_address <> '' GROUP BY 1, 2, 3)
SELECT t.block_timestamp, t.txhash, t.trace_address, t.subtraces, CAST(COALESCE(k.n, 0) AS BIGINT) AS child_count,
  t.subtraces = CAST(COALESCE(k.n, 0) AS BIGINT) AS consistent
FROM t LEFT JOIN k ON t.block_timestamp = k.block_timestamp AND t.txhash = k.txhash AND t.trace_address = k.parent""", ("traces_a",))
def trace_tree(spark, sf_dir):
    """Call-tree children per trace vs declared subtraces."""
    return DV.trace_tree(FX.load(spark, sf_dir, "traces_a"))


@query("nonce_gaps", """
SELECT from_address, nonce, prev_nonce, nonce - prev_nonce - 1 AS gap, txhash FROM (
  SELECT from_address, nonce, txhash, lag(nonce) OVER (PARTITION BY from_address ORDER BY nonce, txhash) AS prev_nonce
  FROM txs_a WHERE nonce IS NOT NULL)
WHERE prev_nonce IS NOT NULL AND nonce - prev_nonce - 1 <> 0""", ("txs_a",))
def nonce_gaps(spark, sf_dir):
    """Nonce gaps / replacements per sender (bucketed lag, skew-safe)."""
    return DV.nonce_gaps(FX.load(spark, sf_dir, "txs_a"), width=500)


@query("chain_continuity", """
SELECT blknum, parent_hash, prev_blknum, prev_blkhash FROM (
  SELECT blknum, parent_hash, lag(blknum) OVER (ORDER BY blknum, blkhash) AS prev_blknum,
    lag(blkhash) OVER (ORDER BY blknum, blkhash) AS prev_blkhash FROM blocks_b)
WHERE prev_blknum IS NOT NULL AND (prev_blknum + 1 <> blknum OR parent_hash <> prev_blkhash)""", ("blocks_b",))
def chain_continuity(spark, sf_dir):
    """Parent-hash / number continuity over the global block order (bucketed)."""
    return DV.chain_continuity(FX.load(spark, sf_dir, "blocks_b"), width=1000)


@query("count_integrity", """
SELECT b.blknum, b.tx_count, CAST(COALESCE(n, 0) AS BIGINT) AS actual_tx_count,
  b.tx_count = CAST(COALESCE(n, 0) AS BIGINT) AS consistent
FROM blocks_a b LEFT JOIN (SELECT blknum, count(*) AS n FROM token_xfers GROUP BY blknum) x ON b.blknum = x.blknum""",
       ("blocks_a", "token_xfers"))
def count_integrity(spark, sf_dir):
    """Declared per-block tx_count against the transfers actually present."""
    memo: dict = {}
    return DV.block_tx_counts(FX.load(spark, sf_dir, "blocks_a", memo), FX.load(spark, sf_dir, "token_xfers", memo),
                              keys=("blknum",)).select("blknum", "tx_count", "actual_tx_count", "consistent")


@query("time_columns", """
SELECT blknum, CAST(date_diff('second', TIMESTAMP '1970-01-01', block_timestamp) AS INTEGER) AS _st,
  CAST(block_timestamp AS DATE) AS _st_day FROM blocks_a""", ("blocks_a",))
def time_columns(spark, sf_dir):
    """`_st` / `_st_day` columns."""
    return DV.time_columns(FX.load(spark, sf_dir, "blocks_a")).select("blknum", "_st", "_st_day")


@query("signature_pkey", """
SELECT byte_sign, text_sign, md5(byte_sign || text_sign || abi) AS pkey FROM func_signs""", ("func_signs",))
def signature_pkey(spark, sf_dir):
    """Signature primary key."""
    return DV.signature_pkey(FX.load(spark, sf_dir, "func_signs")).select("byte_sign", "text_sign", "pkey")


@query("best_signature", """
SELECT byte_sign, text_sign, score FROM (SELECT *, md5(byte_sign || text_sign || abi) AS pkey FROM func_signs)
QUALIFY row_number() OVER (PARTITION BY byte_sign ORDER BY score DESC, pkey) = 1""", ("func_signs",))
def best_signature(spark, sf_dir):
    """Best signature per selector by score."""
    s = DV.best_signature(DV.signature_pkey(FX.load(spark, sf_dir, "func_signs")))
    return s.select("byte_sign", "text_sign", "score")


@query("signature_by_name", """
SELECT split_part(text_sign, '(', 1) AS fn_name, CAST(count(*) AS BIGINT) AS n_signatures, min(byte_sign) AS first_byte_sign
FROM func_signs GROUP BY 1""", ("func_signs",))
def signature_by_name(spark, sf_dir):
    """Signatures indexed by function name (``split_part(text_sign, '(', 1)``)."""
    s = FX.load(spark, sf_dir, "func_signs")
    return s.groupBy(F.split_part(F.col("text_sign"), F.lit("("), F.lit(1)).alias("fn_name")).agg(
        F.count(F.lit(1)).alias("n_signatures"), F.min("byte_sign").alias("first_byte_sign"))


@query("txpool_mined", """
SELECT p.txhash, p.pool_type, m.txhash IS NOT NULL AS is_mined,
  date_diff('second', p.block_timestamp, m.block_timestamp) AS wait_seconds
FROM txpools p LEFT JOIN txs_b m ON p.txhash = m.txhash""", ("txpools", "txs_b"))
def txpool_mined(spark, sf_dir):
    """Mempool entries matched to mined transactions."""
    memo: dict = {}
    r = DV.txpool_mined(FX.load(spark, sf_dir, "txpools", memo), FX.load(spark, sf_dir, "txs_b", memo))
    return r.select("txhash", "pool_type", "is_mined", "wait_seconds")


_USER7 = "'0x' || md5('u7') || substr(md5('u#7'), 1, 8)"


@query("address_activity", f"""
SELECT block_timestamp, txhash, CASE WHEN from_address = {_USER7} THEN 'out' ELSE 'vin' END AS role FROM txs_a
WHERE (from_address = {_USER7} OR to_address = {_USER7})
  AND block_timestamp >= TIMESTAMP '2024-01-01' AND block_timestamp < TIMESTAMP '2024-02-01'""", ("txs_a",))
def address_activity(spark, sf_dir):
    """One address's transactions in a time range, with its role."""
    a = F.concat(F.lit("0x"), F.md5(F.lit("u7")), F.substring(F.md5(F.lit("u#7")), 1, 8))
    return LK.address_activity(FX.load(spark, sf_dir, "txs_a"), a, "2024-01-01", "2024-02-01").select("block_timestamp", "txhash", "role")


_TX42 = "'0x' || md5('tx42') || md5('tx#42')"


@query("tx_bundle", f"""
SELECT 'tx' AS kind, txhash, CAST(txpos AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS path FROM txs_a WHERE txhash = {_TX42}
UNION ALL SELECT 'trace', txhash, txpos, trace_address FROM traces_a WHERE txhash = {_TX42}
UNION ALL SELECT 'log', txhash, CAST(logpos AS BIGINT), NULL FROM logs_a WHERE txhash = {_TX42}""",
       ("txs_a", "traces_a", "logs_a"))
def tx_bundle(spark, sf_dir):
    """P10: a transaction with its traces and logs (hash point lookup on each table)."""
    memo: dict = {}
    h = F.concat(F.lit("0x"), F.md5(F.lit("tx42")), F.md5(F.lit("tx#42")))
    return LK.tx_bundle(*[FX.load(spark, sf_dir, t, memo) for t in ("txs_a", "traces_a", "logs_a")], h)


@query("txpool_outcome", """
WITH p AS (SELECT * FROM txpools), m AS (SELECT from_address, nonce, txhash, block_timestamp FROM txs_b)
SELECT p.txhash, m.txhash AS mined_txhash, CASE WHEN m.txhash IS NULL THEN 'expired' WHEN m.txhash = p.txhash THEN 'mined' ELSE 'replaced' END AS outcome,
  date_diff('second', p.block_timestamp, m.block_timestamp) AS wait_seconds
FROM p LEFT JOIN m ON COALESCE(p.from_address || ':' || CAST(p.nonce AS VARCHAR), p.txhash) = COALESCE(m.from_address || ':' || CAST(m.nonce AS VARCHAR), m.txhash)
  AND m.block_timestamp >= p.block_timestamp AND m.block_timestamp <= p.block_timestamp + INTERVAL 6 HOUR""", ("txpools", "txs_b"))
def txpool_outcome(spark, sf_dir):
    """Mempool entries that were mined, replaced by another transaction of their sender's
    nonce, or expired (the batch form of the stream join)."""
    memo: dict = {}
    return DV.txpool_outcome(FX.load(spark, sf_dir, "txpools", memo), FX.load(spark, sf_dir, "txs_b", memo))
