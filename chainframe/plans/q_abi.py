"""ABI decoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainframe.functions import abi as K
from chainframe.operators import abi_jobs as AJ
from chainframe.operators import derive as DV
from chainframe.plans.q_derive import TOK_SQL, dhex
from chainframe.plans.registry import query
from chainframe.sources import fixtures as FX

TRANSFER_FN = '{"name":"transfer","type":"function","inputs":[{"name":"to","type":"address"},{"name":"amount","type":"uint256"}]}'
_SIG = "(SELECT * FROM abi_sigs QUALIFY row_number() OVER (PARTITION BY address, byte_sign ORDER BY abi, prototype) = 1)"


def _decoded_inputs(spark, sf_dir, mode):
    memo: dict = {}
    return AJ.decode_inputs(FX.load(spark, sf_dir, "abi_txs", memo), FX.load(spark, sf_dir, "abi_sigs", memo), mode=mode)


@query("signature_join", f"""
SELECT t.txhash, substr(t.input, 1, 10) AS selector, s.prototype FROM abi_txs t
LEFT JOIN {_SIG} s ON t.to_address = s.address AND substr(t.input, 1, 10) = s.byte_sign""", ("abi_txs", "abi_sigs"))
def signature_join(spark, sf_dir):
    """One signature per (contract, selector) attached to every call."""
    memo: dict = {}
    t = FX.load(spark, sf_dir, "abi_txs", memo)
    j = AJ.signature_join(t, FX.load(spark, sf_dir, "abi_sigs", memo), F.col("to_address"), F.substring("input", 1, 10))
    return j.select("txhash", F.substring("input", 1, 10).alias("selector"), "prototype")


# valid: both words present and the address padding clean; JSON text of the two values
_TO = """'"0x' || lower(substr(t.input, 35, 40)) || '"'"""
_AMOUNT = dhex("substr(t.input, 75, 64)")


def _inputs_sql(method: str, aliases: bool) -> str:
    more = f""" || ', "__idx_0": ' || {_TO} || ', "__idx_1": ' || {_AMOUNT}""" if aliases else ""
    return f"""
SELECT t.txhash, CASE WHEN s.abi IS NULL OR length(t.input) < 138 OR substr(t.input, 11, 24) <> '{"0" * 24}' THEN '{{}}'
  ELSE '{{"method": "{method}", "parameter": {{"to": ' || {_TO} || ', "amount": ' || {_AMOUNT}{more} || '}}}}' END AS decoded
FROM abi_txs t LEFT JOIN {_SIG} s ON t.to_address = s.address AND substr(t.input, 1, 10) = s.byte_sign"""


@query("decode_inputs_safe", _inputs_sql("transfer(address,uint256)", False), ("abi_txs", "abi_sigs"))
def decode_inputs_safe(spark, sf_dir):
    """typed decode, any error → '{}'."""
    return _decoded_inputs(spark, sf_dir, "typed").select("txhash", "decoded")


@query("decode_inputs_indexed", _inputs_sql("transfer(address to, uint256 amount)", True), ("abi_txs", "abi_sigs"))
def decode_inputs_indexed(spark, sf_dir):
    """flat decode with ``__idx_n`` aliases."""
    return _decoded_inputs(spark, sf_dir, "indexed").select("txhash", "decoded")


@query("decode_inputs", _inputs_sql("transfer(address to, uint256 amount)", True), ("abi_txs", "abi_sigs"))
def decode_inputs(spark, sf_dir):
    """signature lookup by (address, selector), method text = stored prototype."""
    return _decoded_inputs(spark, sf_dir, "lookup").select("txhash", "decoded")


def _logs_sql(method: str) -> str:
    t = "string_split(substr(l.topics, 2, length(l.topics) - 2), ',')"
    who = [f"""'"0x' || lower(right({t}[{i}], 40)) || '"'""" for i in (2, 3)]
    value = dhex("substr(l.data, 3, 64)")
    return f"""
SELECT l.txhash, l.logpos, CASE WHEN s.abi IS NULL THEN '{{}}' ELSE
  '{{"method": "{method}", "parameter": {{"from": ' || {who[0]} || ', "to": ' || {who[1]} || ', "value": ' || {value}
  || ', "__idx_0": ' || {who[0]} || ', "__idx_1": ' || {who[1]} || ', "__idx_2": ' || {value} || '}}}}' END AS decoded
FROM logs_a l LEFT JOIN {_SIG} s ON l.address = s.address AND {t}[1] = s.byte_sign"""


@query("decode_logs", _logs_sql("Transfer(address from, address to, uint256 value)"), ("logs_a", "abi_sigs"))
def decode_logs(spark, sf_dir):
    """Event logs decoded with (address, topic0) signatures."""
    memo: dict = {}
    d = AJ.decode_logs(FX.load(spark, sf_dir, "logs_a", memo), FX.load(spark, sf_dir, "abi_sigs", memo))
    return d.select("txhash", "logpos", "decoded")


@query("decode_logs_lookup", _logs_sql("Transfer(address from, address to, uint256 value)"), ("logs_a", "abi_sigs"))
def decode_logs_lookup(spark, sf_dir):
    """F8 (fixed): lookup overload, prototype as method text, no event-type check."""
    memo: dict = {}
    d = AJ.decode_logs(FX.load(spark, sf_dir, "logs_a", memo), FX.load(spark, sf_dir, "abi_sigs", memo), lookup=True)
    return d.select("txhash", "logpos", "decoded")


@query("decode_coverage", f"""
SELECT CASE WHEN s.abi IS NULL THEN 'no_signature'
            WHEN length(t.input) < 138 OR substr(t.input, 11, 24) <> '{"0" * 24}' THEN 'empty'
            ELSE 'decoded' END AS outcome, CAST(count(*) AS BIGINT) AS rows
FROM abi_txs t LEFT JOIN {_SIG} s ON t.to_address = s.address AND substr(t.input, 1, 10) = s.byte_sign
GROUP BY 1""", ("abi_txs", "abi_sigs"))
def decode_coverage(spark, sf_dir):
    """decoded / empty / no-signature counts (oracle re-derives the ABI validity rules)."""
    return AJ.decode_coverage(_decoded_inputs(spark, sf_dir, "typed"))


@query("decode_static", f"""
SELECT txhash, CASE WHEN ok THEN '0x' || lower(substr(p, 25, 40)) END AS "to",
  CASE WHEN ok THEN {dhex("substr(p, 65, 64)")} END AS amount, ok AS decode_ok
FROM (SELECT txhash, substr(input, 11) AS p,
        length(substr(input, 11)) >= 128 AND substr(substr(input, 11), 1, 24) = '{"0" * 24}' AS ok FROM abi_txs)""",
       ("abi_txs",))
def decode_static(spark, sf_dir):
    """native static-ABI fast path for transfer(address,uint256) calls."""
    d = AJ.decode_static(FX.load(spark, sf_dir, "abi_txs"), TRANSFER_FN)
    return d.select("txhash", "to", "amount", "decode_ok")


def tron_sql(frame: str, col: str) -> str:
    """CTE text: ``tron(h, tron_address)`` of the distinct hex addresses of a frame's column.
    The 25 bytes (41, address, double SHA-256 check) are five limbs of 40 bits; three divisions
    by 58^10 leave four chunks, each written as ten base-58 digits."""
    d = 58**10
    alphabet = K.B58_ALPHABET
    steps, have = [], [f"CAST('0x' || substr(full_hex, {10 * i + 1}, 10) AS UHUGEINT)" for i in range(5)]
    src = "bytes"
    for k in range(3):
        cols = [f"l{k}_{i}" for i in range(5)]
        steps.append(f"n{k} AS (SELECT h, {', '.join(f'{e} AS {c}' for e, c in zip(have, cols))}"
                     + "".join(f", c{j}" for j in range(k)) + f" FROM {src})")
        src, rem, quotients = f"n{k}", "CAST(0 AS UHUGEINT)", []
        for i, c in enumerate(cols):  # long division, one limb a step
            steps.append(f"d{k}_{i} AS (SELECT *, ({rem}) * 1099511627776 + {c} AS x{k}_{i} FROM {src})")
            src = f"d{k}_{i}"
            quotients.append(f"x{k}_{i} // {d}")
            rem = f"x{k}_{i} % {d}"
        steps.append(f"e{k} AS (SELECT *, {rem} AS c{k} FROM {src})")
        src, have = f"e{k}", quotients
    last = f"({have[3]}) * 1099511627776 + {have[4]}"
    digits = " || ".join(f"substr('{alphabet}', CAST((c{c} // {58**i}) % 58 AS INTEGER) + 1, 1)"
                         for c in (3, 2, 1, 0) for i in range(9, -1, -1))
    return f"""hexes AS (SELECT DISTINCT {col} AS h, '41' || lower(right({col}, 40)) AS body FROM {frame} WHERE length({col}) >= 40),
bytes AS (SELECT h, body || substr(sha256(unhex(sha256(unhex(body)))), 1, 8) AS full_hex FROM hexes),
{", ".join(steps)},
tron AS (SELECT h, right({digits}, 34) AS tron_address FROM (SELECT h, c0, c1, c2, {last} AS c3 FROM {src}))"""


@query("tron_address", f"""WITH {tron_sql("token_xfers", "to_address")}
SELECT x.txhash, x.to_address, t.tron_address FROM token_xfers x LEFT JOIN tron t ON x.to_address = t.h""", ("token_xfers",))
def tron_address(spark, sf_dir):
    """base58check addresses for every receiver of the token transfer table."""
    x = FX.load(spark, sf_dir, "token_xfers").select("txhash", "to_address")
    return AJ.with_tron_address(x, "to_address")


_TRON_WHO = "(SELECT a.who FROM (SELECT unnest([from_address, to_address, token_address]) AS who FROM x) a)"


@query("tron_transfers", f"""WITH x AS (
  SELECT block_timestamp, blknum, txhash, txpos, CAST(logpos AS BIGINT) AS logpos, address AS token_address,
    '0x' || lower(right(string_split(topics, ',')[2], 40)) AS from_address,
    '0x' || lower(right(rtrim(string_split(topics, ',')[3], ']'), 40)) AS to_address,
    {dhex("substr(data, 3, 64)")} AS value FROM logs_a WHERE n_topics = 3),
{tron_sql(_TRON_WHO, "who")}
SELECT x.block_timestamp, x.blknum, x.txhash, x.txpos, x.logpos, k.tron_address AS token_address, f.tron_address AS from_address,
  t.tron_address AS to_address, x.value, tok.name, tok.symbol, CAST(tok.decimals AS BIGINT) AS decimals
FROM x LEFT JOIN tron k ON x.token_address = k.h LEFT JOIN tron f ON x.from_address = f.h LEFT JOIN tron t ON x.to_address = t.h
LEFT JOIN {TOK_SQL} tok ON x.token_address = tok.address""", ("logs_a", "token_registry"))
def tron_transfers(spark, sf_dir):
    """Token transfers of a Tron chain, with base58check addresses."""
    memo: dict = {}
    return AJ.tron_transfers(FX.load(spark, sf_dir, "logs_a", memo), DV.tokens_latest(FX.load(spark, sf_dir, "token_registry", memo)))
