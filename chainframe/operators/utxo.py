"""UTXO (Bitcoin-style) linkage: spent outputs, unspent set, per-tx totals, balances.

Inputs reference outputs by ``(pxhash, vout_idx)``; every operator is an equi-join or a
grouped aggregate on hashed keys, so no task holds a whole address or transaction chain.

Links are shuffled with hex text as bytes (``packed``), half as long, and with no column that the
result does not need; an aggregate by address keeps addresses packed to its end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainframe.functions import u256 as U
from chainframe.functions.evm import packed, unpacked
from chainframe.operators import balances as BL


def _pack(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[packed(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


def _unpack(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[unpacked(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


def flatten(txs: DataFrame) -> DataFrame:
    """Tx rows with ``vin``/``vout`` arrays (structs) → one row per input and output.

    Inputs get ``is_in=true``, ``vin_idx``/``vin_cnt``, value 0; outputs ``vout_idx``/
    ``vout_cnt``, ``address`` = addresses joined by ';'."""
    base = [c for c in txs.columns if c not in ("vin", "vout")]
    ins = txs.select(*base, F.posexplode_outer("vin").alias("vin_idx", "__i"), F.size("vin").alias("vin_cnt")) \
        .filter(F.col("__i").isNotNull()).select(
        *base, F.lit(True).alias("is_in"), F.col("__i.txid").alias("pxhash"), F.col("__i.vout").cast("int").alias("vout_idx"),
        F.col("vin_idx").cast("int"), F.col("vin_cnt").cast("int"), F.col("__i.sequence").cast("long").alias("vin_seq"),
        F.lit(None).cast("string").alias("address"), F.lit(0).cast("long").alias("value"))
    outs = txs.select(*base, F.posexplode_outer("vout").alias("vout_idx", "__o"), F.size("vout").alias("vout_cnt")) \
        .filter(F.col("__o").isNotNull()).select(
        *base, F.lit(False).alias("is_in"), F.lit(None).cast("string").alias("pxhash"), F.col("vout_idx").cast("int"),
        F.lit(None).cast("int").alias("vin_idx"), F.lit(None).cast("int").alias("vin_cnt"), F.lit(None).cast("long").alias("vin_seq"),
        F.array_join(F.col("__o.addresses"), ";").alias("address"), F.col("__o.value").cast("long").alias("value"))
    return ins.unionByName(outs)


def _outputs(traces: DataFrame) -> DataFrame:
    return traces.filter(~F.col("is_in"))


def _inputs(traces: DataFrame) -> DataFrame:
    return traces.filter(F.col("is_in"))


def _spendable(traces: DataFrame) -> DataFrame:
    return _outputs(traces).select(packed(F.col("txhash")).alias("__px"), F.col("vout_idx").alias("__vo"),
                                   packed(F.col("address")).alias("spent_address"), F.col("value").alias("spent_value"),
                                   F.col("block_timestamp").alias("spent_output_ts"))


def spend_link(traces: DataFrame) -> DataFrame:
    """Each input with the address and value of the output it spends."""
    hashes = ["txhash", "pxhash"]
    i, o = _pack(_inputs(traces), hashes), _spendable(traces)
    linked = i.join(o, (i["pxhash"] == o["__px"]) & (i["vout_idx"] == o["__vo"]), "left").drop("__px", "__vo")
    return _unpack(linked, [*hashes, "spent_address"])


def _spends(i: DataFrame, o: DataFrame) -> Column:
    """Join condition of packed inputs and ``_spendable`` outputs. They are dealt by transaction and run
    of 64 outputs: a transaction's outputs, which lie together, stay so in the shuffle, where their
    hash compresses to one. The difference is no join key to Spark, so it is tested after the keys."""
    return (i["pxhash"] == o["__px"]) & (F.shiftright(i["vout_idx"], 6) == F.shiftright(o["__vo"], 6)) & ((i["vout_idx"] - o["__vo"]) == 0)


def utxo_set(traces: DataFrame) -> DataFrame:
    """Outputs that no input spends."""
    outs = _outputs(traces)
    rest = [c for c in outs.columns if c not in ("txhash", "vout_idx")]
    made = _pack(outs, ["txhash", "address"]).withColumnsRenamed({"txhash": "__px", "vout_idx": "__vo"})
    spent = _inputs(traces).select(packed(F.col("pxhash")).alias("pxhash"), "vout_idx")
    left = made.join(spent, _spends(spent, made), "left_anti").withColumnsRenamed({"__px": "txhash", "__vo": "vout_idx"})
    return _unpack(left.select("txhash", "vout_idx", *rest), ["txhash", "address"])


def tx_totals(traces: DataFrame) -> DataFrame:
    """input/output counts and values per transaction (inputs valued via J15)."""
    linked = spend_link(traces).select("txhash", F.lit(1).alias("i"), F.lit(0).alias("o"),
                                       F.coalesce("spent_value", F.lit(0)).alias("iv"), F.lit(0).cast("long").alias("ov"))
    outs = _outputs(traces).select("txhash", F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(0).cast("long").alias("iv"),
                                   F.col("value").alias("ov"))
    return linked.unionByName(outs).groupBy("txhash").agg(
        F.sum("i").cast("int").alias("input_count"), F.sum("iv").cast("long").alias("input_value"),
        F.sum("o").cast("int").alias("output_count"), F.sum("ov").cast("long").alias("output_value"))


def balances(traces: DataFrame) -> DataFrame:
    """``cnb + vin - out`` per address: coinbase outputs (cnb), other outputs received
    (vin), outputs spent by later inputs (out), with first and last activity per role."""
    outs = _outputs(traces).filter(F.col("is_coinbase").isNotNull()).withColumn("role", F.when(F.col("is_coinbase"), "cnb").otherwise("vin"))
    made = _pack(outs.select("blknum", "txhash", "block_timestamp", "address", F.col("value").cast("string").alias("value"), "role"), ["txhash", "address"])
    inputs = _pack(_inputs(traces).select("blknum", "txhash", "block_timestamp", "pxhash", "vout_idx"), ["txhash", "pxhash"])
    o = _spendable(traces)
    spent = inputs.join(o, _spends(inputs, o)).select(
        "blknum", "txhash", "block_timestamp", F.col("spent_address").alias("address"),
        F.col("spent_value").cast("string").alias("value"), F.lit("out").alias("role"))
    # no role is on both sides, so each marks its own blocks and transactions where its rows lie
    seen = [BL.first_seen(rows.filter(F.col("address").isNotNull()), []) for rows in (made, spent)]
    roles = ["out", "vin", "cnb"]
    totals = BL.activity(seen[0].unionByName(seen[1]), [], roles)
    return _unpack(BL.balance_columns(totals, [], roles, ["cnb", "vin"], ["out"]), ["address"])
