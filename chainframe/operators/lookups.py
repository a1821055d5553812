"""Point lookups by hash and address (P9-P11) on tables written with Parquet Bloom filters.

The reference keeps B-tree indexes on these columns. Here a table is written with a Bloom filter
per row group on each lookup column; an equality with a literal is pushed to the scan, which skips
row groups whose filter does not hold the value (hashes are spread evenly, so minimum and maximum
prune nothing). Clustering by time keeps ranges prunable as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: lookup columns by table kind
LOOKUP_COLUMNS = {
    "txs": ("txhash", "from_address", "to_address"), "traces": ("txhash", "from_address", "to_address"),
    "logs": ("txhash", "address"), "btc_traces": ("txhash", "pxhash", "address"),
    "token_transfers": ("txhash", "token_address", "from_address", "to_address"),
    "nft_transfers": ("txhash", "token_address", "from_address", "to_address"),
}


def write_lookup(df: DataFrame, path: str, columns: tuple[str, ...], *, distinct: int = 1_000_000, row_group_bytes: int = 128 << 20,
                 order_by: tuple[str, ...] = ("block_timestamp",), mode: str = "overwrite") -> None:
    """Writes ``df`` with a Bloom filter on each of ``columns``; ``distinct``: values expected in a
    row group. Rows are sorted inside each file, as far as it has the columns of ``order_by``."""
    order = [c for c in order_by if c in df.columns]
    w = (df.sortWithinPartitions(*order) if order else df).write.mode(mode).option("parquet.block.size", str(row_group_bytes))
    for c in columns:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(distinct))
    w.parquet(path)


def _between(start, end, ts: str) -> Column:
    at = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("timestamp_ntz")
    out = F.lit(True)
    if start is not None:
        out = out & (F.col(ts) >= at(start))
    return out if end is None else out & (F.col(ts) < at(end))


def _value(v: str | Column) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def address_activity(txs: DataFrame, address: str | Column, start=None, end=None, ts: str = "block_timestamp") -> DataFrame:
    """An address's transactions in a time range, with its role: ``out`` where it sends (also to
    itself), else ``vin``. Two lookups, one on each side's column, so that either filter prunes."""
    own = _value(address)
    rows = txs.filter(_between(start, end, ts))
    sent = rows.filter(F.col("from_address") == own).withColumn("role", F.lit("out"))
    got = rows.filter((F.col("to_address") == own) & (F.col("from_address").isNull() | (F.col("from_address") != own)))
    return sent.unionByName(got.withColumn("role", F.lit("vin")))


def tx_bundle(txs: DataFrame, traces: DataFrame, logs: DataFrame, txhash: str | Column) -> DataFrame:
    """P10: a transaction with its traces and logs: kind, txhash, pos, path."""
    def part(df: DataFrame, kind: str, pos: str, path: Column) -> DataFrame:
        return df.filter(F.col("txhash") == _value(txhash)).select(
            F.lit(kind).alias("kind"), "txhash", F.col(pos).cast("long").alias("pos"), path.cast("string").alias("path"))

    return (part(txs, "tx", "txpos", F.lit(None)).unionByName(part(traces, "trace", "txpos", F.col("trace_address")))
            .unionByName(part(logs, "log", "logpos", F.lit(None))))


def nft_history(transfers: DataFrame, collection: str | Column, token_id: str | None = None) -> DataFrame:
    """Transfers of a collection, or of one token of it, by token and time."""
    rows = transfers.filter(F.col("token_address") == _value(collection))
    if token_id is not None:
        rows = rows.filter(F.col("token_id") == token_id)
    return rows.select("token_id", "block_timestamp", "from_address", "to_address", "txhash").orderBy("token_id", "block_timestamp")


def spends_of(btc_traces: DataFrame, txhash: str | Column) -> DataFrame:
    """The inputs that spend a transaction's outputs (lookup by ``pxhash``)."""
    return btc_traces.filter(F.col("is_in") & (F.col("pxhash") == _value(txhash)))
