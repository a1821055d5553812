"""Sources, sinks and table lifecycle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainframe.plans.registry import query
from chainframe.sources import fixtures as FX
from chainframe.sources import ingest as IN
from chainframe.sources import layout as LY
from chainframe.sources import schemas as S


@query("chunk_assign", """
SELECT time_bucket(INTERVAL '7 days', block_timestamp, TIMESTAMP '1970-01-01') AS chunk,
  CAST(count(*) AS BIGINT) AS rows, min(blknum) AS min_blknum, max(blknum) AS max_blknum
FROM blocks_a GROUP BY 1""", ("blocks_a",))
def chunk_assign(spark, sf_dir):
    """Epoch-aligned 7-day chunks of the blocks table."""
    b = LY.with_chunk(FX.load(spark, sf_dir, "blocks_a"), "block_timestamp", S.CHUNK_INTERVAL)
    return b.groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"), F.min("blknum").alias("min_blknum"),
                                  F.max("blknum").alias("max_blknum"))


@query("rechunk_counts", """
SELECT CASE WHEN block_timestamp >= TIMESTAMP '2024-01-15' THEN time_bucket(INTERVAL '1 hour', block_timestamp, TIMESTAMP '1970-01-01')
            ELSE time_bucket(INTERVAL '7 days', block_timestamp, TIMESTAMP '1970-01-01') END AS chunk,
  CAST(count(*) AS BIGINT) AS rows
FROM txs_a GROUP BY 1""", ("txs_a",))
def rechunk_counts(spark, sf_dir):
    """Chunk interval changed to 1 hour for data from 2024-01-15 on; older chunks keep 7 days."""
    t = LY.rechunk(FX.load(spark, sf_dir, "txs_a"), "block_timestamp", "7 days", "1 hour", "2024-01-15")
    return t.groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"))


@query("month_partition", """
SELECT CAST(year(block_timestamp) * 100 + month(block_timestamp) AS INTEGER) AS yyyymm,
  CAST(count(*) AS BIGINT) AS rows, CAST(sum(gas_used) AS BIGINT) AS gas_used
FROM blocks_a GROUP BY 1""", ("blocks_a",))
def month_partition(spark, sf_dir):
    """``toYYYYMM`` partition key."""
    b = FX.load(spark, sf_dir, "blocks_a")
    return b.groupBy(LY.month_key("block_timestamp").alias("yyyymm")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("gas_used").cast("long").alias("gas_used"))


_VERSIONED = """(SELECT block_timestamp, blknum, txhash, txpos, value, receipt_status, 1 AS version FROM txs_a
  UNION ALL SELECT block_timestamp, blknum, txhash, txpos, value, receipt_status, 2 AS version FROM txs_b)"""


def _versioned(spark, sf_dir):
    memo: dict = {}
    cols = ["block_timestamp", "blknum", "txhash", "txpos", "value", "receipt_status"]
    a = FX.load(spark, sf_dir, "txs_a", memo).select(*cols, F.lit(1).alias("version"))
    b = FX.load(spark, sf_dir, "txs_b", memo).select(*cols, F.lit(2).alias("version"))
    return a.unionByName(b)


@query("replacing_dedup", f"""
SELECT block_timestamp, blknum, txhash, txpos, value, receipt_status, version FROM {_VERSIONED} v
QUALIFY row_number() OVER (PARTITION BY year(block_timestamp) * 100 + month(block_timestamp), blknum, txhash, txpos
  ORDER BY version DESC, block_timestamp DESC NULLS LAST, value DESC NULLS LAST, receipt_status DESC NULLS LAST) = 1""", ("txs_a", "txs_b"))
def replacing_dedup(spark, sf_dir):
    """Last write wins per (month, key) across two loads."""
    return LY.replacing_dedup(_versioned(spark, sf_dir), ["blknum", "txhash", "txpos"], "version")


@query("upsert_merge", f"""
SELECT block_timestamp, blknum, txhash, txpos, value, receipt_status FROM txs_a a
WHERE NOT EXISTS (SELECT 1 FROM txs_b b WHERE a.block_timestamp = b.block_timestamp AND a.txhash = b.txhash AND a.txpos = b.txpos)
UNION ALL SELECT block_timestamp, blknum, txhash, txpos, value, receipt_status FROM txs_b""", ("txs_a", "txs_b"))
def upsert_merge(spark, sf_dir):
    """Upsert a batch (second load) into a target on (block_timestamp, txhash, txpos)."""
    memo: dict = {}
    cols = ["block_timestamp", "blknum", "txhash", "txpos", "value", "receipt_status"]
    t = FX.load(spark, sf_dir, "txs_a", memo).select(*cols)
    b = FX.load(spark, sf_dir, "txs_b", memo).select(*cols)
    return LY.merge_batch(t, b, ["block_timestamp", "txhash", "txpos"])


@query("cluster_layout", """
SELECT *, time_bucket(INTERVAL '7 days', block_timestamp, TIMESTAMP '1970-01-01') AS chunk FROM blocks_a""", ("blocks_a",))
def cluster_layout(spark, sf_dir):
    """Range-partitioned by (chunk, blknum) and sorted by (blknum, block_timestamp)."""
    b = LY.with_chunk(FX.load(spark, sf_dir, "blocks_a"), "block_timestamp", S.CHUNK_INTERVAL)
    return LY.cluster_layout(b, order_by=("block_timestamp",))


@query("compaction_candidates", """
SELECT chunk, CAST(count(*) AS BIGINT) AS rows FROM (
  SELECT time_bucket(INTERVAL '7 days', block_timestamp, TIMESTAMP '1970-01-01') AS chunk FROM txs_a)
WHERE chunk + INTERVAL '7 days' <= TIMESTAMP '2024-02-15' - INTERVAL '30 days' GROUP BY chunk""", ("txs_a",))
def compaction_candidates(spark, sf_dir):
    """Chunks wholly older than now − 30 days (transactions policy) at now = 2024-02-15."""
    t = FX.load(spark, sf_dir, "txs_a")
    return LY.compaction_candidates(t, "2024-02-15 00:00:00", S.COMPRESS_AFTER["evm"]["txs"])


@query("retention_prune", """
SELECT txhash, block_timestamp FROM txs_a
WHERE time_bucket(INTERVAL '1 hour', block_timestamp, TIMESTAMP '1970-01-01') + INTERVAL '1 hour'
      > TIMESTAMP '2024-01-20 12:30:00' - INTERVAL '6 hours'""", ("txs_a",))
def retention_prune(spark, sf_dir):
    """Mempool retention of 6 hours, chunk-granular (1-hour chunks), now = 2024-01-20 12:30."""
    t = FX.load(spark, sf_dir, "txs_a")
    return LY.retain(t, "2024-01-20 12:30:00", S.RETAIN_FOR["evm"]["txpools"], interval="1 hour") \
        .select("txhash", "block_timestamp")


@query("apply_defaults", """
SELECT blknum, CAST(0 AS INTEGER) AS uncle_count, tx_count FROM blocks_b""", ("blocks_b",))
def apply_defaults(spark, sf_dir):
    """Defaults only for absent columns (uncle_count absent → 0; NULL tx_count stays NULL)."""
    b = IN.apply_defaults(FX.load(spark, sf_dir, "blocks_b"), "blocks")
    return b.select("blknum", F.col("uncle_count").cast("int"), "tx_count")


@query("ch_export", """
SELECT address, blknum, COALESCE(decimals, -1) AS decimals_out,
  CASE WHEN COALESCE(decimals, -1) = -1 THEN NULL ELSE COALESCE(decimals, -1) END AS decimals_back
FROM token_registry""", ("token_registry",))
def ch_export(spark, sf_dir):
    """NULL ↔ sentinel (-1) round trip of token decimals."""
    t = FX.load(spark, sf_dir, "token_registry").select("address", "blknum", "decimals")
    out = IN.to_sentinel(t, "decimals").withColumnRenamed("decimals", "decimals_out")
    back = IN.from_sentinel(out.withColumn("decimals", F.col("decimals_out")), "decimals")
    return back.withColumnRenamed("decimals", "decimals_back").select("address", "blknum", "decimals_out", "decimals_back")


@query("constraint_audit", """
SELECT 'from_address' AS check_name, CAST(count(*) FILTER (WHERE from_address IS NULL) AS BIGINT) AS violations FROM token_xfers
UNION ALL SELECT 'to_address', CAST(count(*) FILTER (WHERE to_address IS NULL) AS BIGINT) FROM token_xfers
UNION ALL SELECT 'value', CAST(count(*) FILTER (WHERE value IS NULL) AS BIGINT) FROM token_xfers
UNION ALL SELECT 'duplicate_key', CAST(COALESCE(sum(n - 1), 0) AS BIGINT) FROM (
  SELECT txhash, count(*) AS n FROM token_xfers GROUP BY txhash HAVING count(*) > 1)""", ("token_xfers",))
def constraint_audit(spark, sf_dir):
    """NOT NULL and unique-key audit of the token transfer table."""
    x = FX.load(spark, sf_dir, "token_xfers")
    return IN.constraint_report(x, ["from_address", "to_address", "value"], ["txhash"])


@query("block_json_normalize", """
SELECT id,
  CASE WHEN json_extract_string(json, '$.result.number') IS NULL THEN 0
       ELSE CAST(('0x' || substr(json_extract_string(json, '$.result.number'), 3)) AS BIGINT) END AS blknum,
  CASE WHEN json_extract_string(json, '$.result.timestamp') IS NULL THEN 0
       ELSE CAST(('0x' || substr(json_extract_string(json, '$.result.timestamp'), 3)) AS BIGINT) END AS timestamp,
  CAST(to_timestamp(CASE WHEN json_extract_string(json, '$.result.timestamp') IS NULL THEN 0
       ELSE CAST(('0x' || substr(json_extract_string(json, '$.result.timestamp'), 3)) AS BIGINT) END) AT TIME ZONE 'UTC' AS TIMESTAMP) AS block_timestamp,
  json_extract_string(json, '$.result.hash') AS blkhash,
  json_extract_string(json, '$.result.parentHash') AS parent_hash,
  json_extract_string(json, '$.result.miner') AS miner
FROM block_json""", ("block_json",))
def block_json_normalize(spark, sf_dir):
    """JSON-RPC block replies → typed rows (empty reply → block 0 at epoch 0)."""
    return IN.normalize_block_json(FX.load(spark, sf_dir, "block_json"), "json")


@query("conform_logs", """
SELECT txhash, logpos, CAST(NULL AS VARCHAR) AS item_id,
  split_part(regexp_replace(regexp_replace(topics, '^\\[', ''), '\\]$', ''), ',', 1) AS topics_0
FROM logs_a""", ("logs_a",))
def conform_logs(spark, sf_dir):
    """v2 logs (no topics_0) projected onto the v1 schema; topics_0 derived from topics."""
    v2 = S.conform(FX.load(spark, sf_dir, "logs_a").drop("topics_0"), S.LOGS_V2)
    return S.conform(v2, S.LOGS).select("txhash", "logpos", "item_id", "topics_0")


@query("metrics_from_events", """
SELECT name, job, instance, name || '{instance=' || instance || ',job=' || job || '}' AS series_key, ts,
  CAST(value AS DOUBLE) AS value
FROM metric_gauge""", ("metric_gauge",))
def metrics_from_events(spark, sf_dir):
    """A table → long metric samples with a label map and a stable series key."""
    g = FX.load(spark, sf_dir, "metric_gauge")
    m = IN.metrics_frame(g, F.col("name"), ["job", "instance"], "ts", "value")
    return m.select("name", F.col("labels")["job"].alias("job"), F.col("labels")["instance"].alias("instance"),
                    "series_key", "ts", "value")


@query("relabel", """
SELECT ts, name || '{env=prod,instance=' || instance || ',job=' || job || ',service=' || job || '}' AS series_key
FROM metric_gauge""", ("metric_gauge",))
def relabel(spark, sf_dir):
    """Copy job → service, constant env=prod (external label, series labels win)."""
    g = FX.load(spark, sf_dir, "metric_gauge")
    m = IN.metrics_frame(g, F.col("name"), ["job", "instance"], "ts", "value")
    m = IN.relabel(m, "service", source_labels=["job"])
    m = IN.add_external_labels(m, {"env": "prod"})
    return m.select("ts", "series_key")


@query("time_range", """
SELECT block_timestamp, blknum, txhash, txpos FROM txs_a
WHERE block_timestamp >= TIMESTAMP '2024-01-10' AND block_timestamp < TIMESTAMP '2024-01-12'""", ("txs_a",))
def time_range(spark, sf_dir):
    """Half-open [st, et) range (pushed into the Parquet scan)."""
    t = FX.load(spark, sf_dir, "txs_a")
    return LY.time_filter(t, "2024-01-10 00:00:00", "2024-01-12 00:00:00").select("block_timestamp", "blknum", "txhash", "txpos")
