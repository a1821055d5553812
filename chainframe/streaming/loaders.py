"""Structured Streaming jobs: continuous upsert load, mempool window, incremental balances,
alert state. Every sink is idempotent per micro-batch (``foreachBatch`` rewrites only the
chunks a batch touches), so a restarted query replays safely from its checkpoint.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from chainframe.operators import balances as BL
from chainframe.operators import derive as DV
from chainframe.sources import layout as LY


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def upsert_chunks(spark: SparkSession, batch: DataFrame, target: str, key: list[str], *, ts: str = "block_timestamp",
                  interval: str = "7 days", epoch: int = 0, version: str | None = None) -> None:
    """Merge one batch into a chunk-partitioned Parquet table: only touched chunks are read,
    merged (batch wins on key; of several batch rows with one key the largest ``version``) and
    rewritten via a staging folder (no read/overwrite of the same files inside one job).

    A crash while the staging folder is copied over leaves some chunks new and others old; every row
    is in one of them, and running the same batch again, as the stream does from its checkpoint,
    makes all of them new."""
    b = LY.with_chunk(batch, ts, interval)
    staging = os.path.join(target, "_staging", f"epoch={epoch}")
    if _exists(spark, target) and _exists(spark, os.path.join(target, "_SUCCESS")):
        chunks = b.select("chunk").distinct()
        # prunes the table's folders at run time; Spark decides by size whether to broadcast the chunks
        current = spark.read.parquet(target).join(chunks, "chunk", "left_semi")
    else:
        current = b.drop(version).limit(0) if version else b.limit(0)
    merged = LY.merge_batch(current, b.select(*current.columns, *([version] if version else [])), key, version)
    merged.write.mode("overwrite").partitionBy("chunk").parquet(staging)
    (spark.read.parquet(staging).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("chunk").parquet(target))


def load_stream(spark: SparkSession, source: str, schema: T.StructType, target: str, key: list[str], checkpoint: str,
                *, ts: str = "block_timestamp", interval: str = "7 days", available_now: bool = True):
    """File stream → last write per key of a batch (by file time, file and row) → chunk
    upsert on ``key``."""
    src = spark.readStream.schema(schema).parquet(source)
    written_at = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index")
    src = src.select("*", written_at.alias("__written"))

    def sink(df: DataFrame, epoch: int) -> None:
        upsert_chunks(spark, df, target, key, ts=ts, interval=interval, epoch=epoch, version="__written")

    w = src.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="15 seconds")
    return w.start()


def mempool_stream(pool: DataFrame, retention: str = "6 hours") -> DataFrame:
    """Mempool rows deduplicated per hash within a 6-hour event-time watermark; state for
    older hashes is dropped, matching the table's retention."""
    return (with_event_time(pool, "block_timestamp").withWatermark("__event_time", retention)
            .dropDuplicatesWithinWatermark(["txhash"]).drop("__event_time"))


def txpool_outcome_stream(pool: DataFrame, mined: DataFrame, retention: str = "6 hours", lateness: str = "10 minutes") -> DataFrame:
    """D13 on streams: mempool rows joined to mined transactions of the same sender and nonce. A row
    leaves as soon as its match arrives, or as ``expired`` once the watermarks (``lateness`` behind
    the newest rows) have passed its retention; state is dropped with it."""
    p = pool.select("txhash", F.col("block_timestamp").alias("seen_at"), DV.txpool_key(pool).alias("__p"),
                    F.col("block_timestamp").cast("timestamp").alias("__seen")).withWatermark("__seen", lateness)
    m = mined.select(F.col("txhash").alias("mined_txhash"), F.col("block_timestamp").alias("mined_at"), DV.txpool_key(mined).alias("__m"),
                     F.col("block_timestamp").cast("timestamp").alias("__mined")).withWatermark("__mined", lateness)
    near = (F.col("__mined") >= F.col("__seen")) & (F.col("__mined") <= F.col("__seen") + F.expr(f"INTERVAL {retention}"))
    return p.join(m, (F.col("__p") == F.col("__m")) & near, "leftOuter").select(*DV.txpool_columns())


def with_event_time(df: DataFrame, col: str) -> DataFrame:
    """Watermarks need TIMESTAMP; chain times are TIMESTAMP_NTZ. The cast is a constant
    shift in a fixed-offset session zone (UTC here), so watermark delays are unchanged."""
    return df.withColumn("__event_time", F.col(col).cast("timestamp"))


_TOKEN = (["token_address"], ["out", "vin"])


def balances_stream(spark: SparkSession, xfers: DataFrame, state_path: str, checkpoint: str):
    """Incremental token balances. Each micro-batch stores its per-transaction partials in a
    folder named after its epoch, so a replay of an epoch overwrites what it wrote, and a block
    or transaction split over batches adds up when read (``streamed_balances``)."""

    def sink(df: DataFrame, epoch: int) -> None:
        store_partials(df, state_path, epoch)

    return xfers.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_partials(xfers: DataFrame, state_path: str, epoch: int) -> None:
    BL.token_partials(xfers).write.mode("overwrite").parquet(f"{state_path.rstrip('/')}/partials/epoch={epoch}")


def _partials(spark: SparkSession, state_path: str) -> DataFrame:
    return spark.read.parquet(f"{state_path.rstrip('/')}/partials").withColumn("epoch", F.col("epoch").cast("long"))


def _folded(spark: SparkSession, state_path: str) -> tuple[int, int] | None:
    """The last block and the last epoch of the newest folded state, if there is one."""
    path = f"{state_path.rstrip('/')}/folded"
    if not _exists(spark, path):
        return None
    newest = spark.read.parquet(path).agg(F.max(F.struct(F.col("upto").cast("long"), F.col("epoch").cast("long"))).alias("m")).first()["m"]
    return tuple(newest) if newest is not None else None


def fold_partials(spark: SparkSession, state_path: str, upto: int) -> None:
    """Folds what the stored epochs hold of blocks up to ``upto`` into stored balances, so that
    reads aggregate later blocks only. The state names its last block and epoch: folding the same
    epochs again changes nothing, and rows of those blocks that come in later epochs are known as
    late."""
    last, epoch = _folded(spark, state_path), _partials(spark, state_path).agg(F.max("epoch")).first()[0]
    if epoch is None or (last is not None and (upto, epoch) <= last):
        return
    merged = _merged_balances(spark, state_path, max(upto, last[0]) if last else upto)
    merged.write.mode("overwrite").parquet(f"{state_path.rstrip('/')}/folded/upto={max(upto, last[0]) if last else upto}/epoch={epoch}")


def _merged_balances(spark: SparkSession, state_path: str, upto: int | None = None) -> DataFrame:
    """Balances of all partials (of blocks up to ``upto``: with those of rows without a block number
    left for the read). A folded state stands for its blocks; keys with late rows, of folded blocks
    but later epochs, are computed anew from all their partials, so nothing is lost or counted
    twice."""
    keys, roles = _TOKEN
    names = ["address", *keys]
    parts = _partials(spark, state_path)
    if upto is not None:
        parts = parts.filter(F.col("blknum") <= upto)

    def balances(rows: DataFrame) -> DataFrame:
        return BL.balances_of(BL.merge_partials(rows.drop("epoch"), keys), keys, roles, ["vin"], ["out"])

    last = _folded(spark, state_path)
    if last is None:
        return balances(parts)
    state = (spark.read.parquet(f"{state_path.rstrip('/')}/folded").filter((F.col("upto") == last[0]) & (F.col("epoch") == last[1]))
             .drop("upto", "epoch"))
    folded = F.coalesce(F.col("blknum") <= last[0], F.lit(False))
    late = parts.filter(folded & (F.col("epoch") > last[1])).select(*names).distinct()
    rest = BL.merge_balances(state.join(late, names, "left_anti"), balances(parts.filter(~folded).join(late, names, "left_anti")))
    return rest.unionByName(balances(parts.join(late, names, "left_semi")))


def streamed_balances(spark: SparkSession, state_path: str) -> DataFrame:
    """Latest balances of all stored epochs; equals ``token_balances`` of all their transfers,
    late blocks and transfers without a block number included."""
    return _merged_balances(spark, state_path)


def over_time_stream(samples: DataFrame, fn: str, window_s: int, step_s: int, lateness_s: int = 60) -> DataFrame:
    """``avg|max|min|sum|count_over_time`` on a stream of samples (name, labels, series_key,
    ts, value), at instants that are multiples of ``step_s``. Each sample goes to the instants
    whose closed window ``[t - window, t]`` holds it, as in the batch form; an instant is emitted
    once the watermark (``lateness_s`` behind the newest sample) has passed it."""
    from chainframe.operators.metrics.ranges import entries

    aggregate = {"avg": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "count": F.count}[fn]
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    us = F.timestamp_diff("MICROSECOND", epoch, F.col("ts"))
    lo = F.ceil(us / F.lit(step_s * 1_000_000)).cast("long")
    hi = F.floor((us + F.lit(window_s * 1_000_000)) / F.lit(step_s * 1_000_000)).cast("long")
    d = entries(samples).filter(lo <= hi).withColumn("__k", F.explode(F.sequence(lo, hi)))
    d = d.withColumn("__event_time", F.timestamp_add("SECOND", F.col("__k") * step_s, epoch).cast("timestamp"))
    # the newest instant a sample reaches is up to a window ahead of it
    g = (d.withWatermark("__event_time", f"{window_s + lateness_s} seconds")
         .groupBy("series_key", "name", "__e", "__event_time").agg(aggregate("value").cast("double").alias("value")))
    return g.select("name", F.map_from_entries("__e").alias("labels"), "series_key",
                    F.col("__event_time").cast("timestamp_ntz").alias("eval_ts"), "value")


_RANGE_STATE = T.StructType([T.StructField("us", T.ArrayType(T.LongType())), T.StructField("value", T.ArrayType(T.DoubleType())),
                             T.StructField("next_us", T.LongType())])
_RANGE_OUT = T.StructType([T.StructField("name", T.StringType()), T.StructField("__l", T.StringType()),
                           T.StructField("series_key", T.StringType()), T.StructField("eval_ts", T.TimestampNTZType()),
                           T.StructField("value", T.DoubleType())])


def window_value(fn: str, t: np.ndarray, v: np.ndarray, window_s: float) -> float | None:
    """``rate``, ``increase``, ``irate``, ``deriv`` or ``changes`` of one window's samples: ``t`` in
    seconds relative to the instant, ascending. None where the batch form gives no row or NULL."""
    if fn == "changes":
        return float((np.diff(v) != 0).sum())
    if len(t) < 2:
        return None
    steps = np.diff(v)
    if fn == "irate":
        gap = t[-1] - t[-2]
        return None if gap == 0 else float((v[-1] if steps[-1] < 0 else steps[-1]) / gap)
    if fn == "deriv":
        x, y = t - t.mean(), v - v.mean()
        return None if t[-1] == t[0] else float((x * y).sum() / (x * x).sum())
    grown = float(np.where(steps >= 0, steps, v[1:]).sum())
    sampled = t[-1] - t[0]
    if sampled == 0:
        return None
    gap = sampled / (len(t) - 1)
    before, after = t[0] + window_s, -t[-1]
    if grown > 0 and v[0] >= 0:  # a counter cannot have been below zero
        before = min(before, sampled * v[0] / grown)
    covered = sampled + sum(x if x < 1.1 * gap else gap / 2 for x in (before, after))
    out = grown * covered / sampled
    return out / window_s if fn == "rate" else out


def range_stream(samples: DataFrame, fn: str, window_s: int, step_s: int, lateness_s: int = 60) -> DataFrame:
    """T6 for functions of neighbouring samples (``rate``, ``increase``, ``irate``, ``deriv``,
    ``changes``) at instants that are multiples of ``step_s``. A series' state holds the samples that
    instants to come may need, at most a window and the lateness long; an instant is computed once
    the watermark has passed it, so samples may come in any order within the lateness, and equal
    (time, value) pairs delivered again count once. Late instants are emitted by event-time timers
    even if no sample follows."""
    from chainframe.operators.metrics.ranges import entries

    step, window = step_s * 1_000_000, window_s * 1_000_000

    def run(key, pdfs, state):
        us, value, following = (list(x) if k < 2 else x for k, x in enumerate(state.get)) if state.exists else ([], [], None)
        if not state.hasTimedOut:
            pairs = set(zip(us, value))
            for pdf in pdfs:
                pairs.update(zip(pdf["us"].tolist(), pdf["value"].tolist()))
            us, value = map(list, zip(*sorted(pairs))) if pairs else ([], [])
        passed = state.getCurrentWatermarkMs() * 1000  # instants up to here are complete
        if us and following is None:
            following = -(-us[0] // step) * step
        elif us:
            following = max(following, 0) if following > 0 else following
        t, v, rows = np.array(us, np.int64), np.array(value), []
        while us and following is not None and following <= min(passed, us[-1] + window):
            a, b = np.searchsorted(t, following - window, "left"), np.searchsorted(t, following, "right")
            if a < b:
                got = window_value(fn, (t[a:b] - following) / 1e6, v[a:b], float(window_s))
                if got is not None:
                    rows.append((key[1], key[2], key[0], pd.Timestamp(following, unit="us"), got))
            following += step
        keep = t > (following if following is not None else 0) - window - 1
        us, value = t[keep].tolist(), v[keep].tolist()
        if us:
            state.update((us, value, following))
            state.setTimeoutTimestamp(max(passed // 1000 + 1, following // 1000))
        else:
            state.remove()
        yield pd.DataFrame(rows, columns=[f.name for f in _RANGE_OUT.fields])

    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    d = entries(samples).select("series_key", "name", F.to_json(F.map_from_entries("__e")).alias("__l"), F.col("value").cast("double").alias("value"),
                                F.timestamp_diff("MICROSECOND", epoch, F.col("ts")).alias("us"), F.col("ts").cast("timestamp").alias("__event_time"))
    out = (d.withWatermark("__event_time", f"{lateness_s} seconds").groupBy("series_key", "name", "__l")
           .applyInPandasWithState(run, _RANGE_OUT, _RANGE_STATE, "append", GroupStateTimeout.EventTimeTimeout))
    return out.select("name", F.from_json("__l", "map<string,string>").alias("labels"), "series_key", "eval_ts", "value")


ALERT_OUT = T.StructType([
    T.StructField("rule_id", T.StringType()), T.StructField("series_key", T.StringType()),
    T.StructField("eval_ts", T.TimestampNTZType()), T.StructField("state", T.StringType()),
    T.StructField("active_since", T.TimestampNTZType()),
])
ALERT_STATE = T.StructType([T.StructField("since_us", T.LongType()), T.StructField("last_us", T.LongType()),
                            T.StructField("fired", T.BooleanType())])


class _Episodes(StatefulProcessor):
    """Pending, firing and resolved rows of one (rule, series): the open episode is a value state,
    its end an event-time timer."""

    def __init__(self, for_us: int, step_us: int) -> None:
        self._for, self._step = for_us, step_us

    def init(self, handle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", ALERT_STATE)

    def _row(self, key, us: int, state: str, since: int) -> tuple:
        return (key[0], key[1], pd.Timestamp(us, unit="us"), state, pd.Timestamp(since, unit="us"))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        since, last, fired = self._open.get() if self._open.exists() else (None, None, False)
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        out = []
        for t in sorted(int(x.value // 1000) for pdf in rows for x in pd.to_datetime(pdf["eval_ts"])):
            if last is not None and t <= last:
                continue
            if last is None or t - last > self._step:
                if fired:
                    out.append(self._row(key, last + self._step, "resolved", since))
                since, fired = t, False
            state = "firing" if t - since >= self._for else "pending"
            fired = fired or state == "firing"
            out.append(self._row(key, t, state, since))
            last = t
        self._open.update((since, last, fired))
        # passed by the watermark without a later sample: the episode is over
        self._handle.registerTimer((last + 2 * self._step) // 1000)
        yield pd.DataFrame(out, columns=[f.name for f in ALERT_OUT.fields])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        out = []
        if self._open.exists():
            since, last, fired = self._open.get()
            if fired:
                out.append(self._row(key, last + self._step, "resolved", since))
            self._open.clear()
        yield pd.DataFrame(out, columns=[f.name for f in ALERT_OUT.fields])

    def close(self) -> None:
        pass


def alert_episodes(active: DataFrame, for_seconds: int, step_seconds: int, watermark: str = "10 minutes") -> DataFrame:
    """T4 by ``transformWithState``: the rows of ``alert_stream``, with a value state and a timer a
    (rule, series). Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    return (with_event_time(active, "eval_ts").withWatermark("__event_time", watermark).groupBy("rule_id", "series_key")
            .transformWithStateInPandas(_Episodes(for_seconds * 1_000_000, step_seconds * 1_000_000), ALERT_OUT, "Append", "EventTime"))


def alert_stream(active: DataFrame, for_seconds: int, step_seconds: int, watermark: str = "10 minutes") -> DataFrame:
    """T4/T5: streaming ``for`` state per (rule, series) with ``applyInPandasWithState``.

    Input: active samples (rule_id, series_key, eval_ts) on the step grid. A gap of more than
    one step ends the episode; ``resolved`` is emitted at the step after the last active one,
    either when a later sample arrives or by event-time timeout when the watermark passes it
    (no new sample needed)."""
    step_us = step_seconds * 1_000_000

    def fn(key, pdfs, state):
        rule, series = key
        rows = []
        if state.exists:
            since, last, fired = state.get
        else:
            since = last = None
            fired = False
        if state.hasTimedOut:
            if fired:
                rows.append((rule, series, pd.Timestamp(last + step_us, unit="us"), "resolved", pd.Timestamp(since, unit="us")))
            state.remove()
            yield pd.DataFrame(rows, columns=[f.name for f in ALERT_OUT.fields])
            return
        ts_all = sorted(int(t.value // 1000) for pdf in pdfs for t in pd.to_datetime(pdf["eval_ts"]))
        for t in ts_all:
            if last is not None and t <= last:
                continue
            if last is None or t - last > step_us:
                if last is not None and fired:
                    rows.append((rule, series, pd.Timestamp(last + step_us, unit="us"), "resolved", pd.Timestamp(since, unit="us")))
                since, fired = t, False
            st = "firing" if (t - since) >= for_seconds * 1_000_000 else "pending"
            fired = fired or st == "firing"
            rows.append((rule, series, pd.Timestamp(t, unit="us"), st, pd.Timestamp(since, unit="us")))
            last = t
        state.update((since, last, fired))
        state.setTimeoutTimestamp((last + 2 * step_us) // 1000)
        yield pd.DataFrame(rows, columns=[f.name for f in ALERT_OUT.fields])

    return (with_event_time(active, "eval_ts").withWatermark("__event_time", watermark)
            .groupBy("rule_id", "series_key")
            .applyInPandasWithState(fn, ALERT_OUT, ALERT_STATE, "append", GroupStateTimeout.EventTimeTimeout))
