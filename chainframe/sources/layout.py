"""Table lifecycle as Spark jobs: time chunks, monthly partitions, replacing (dedup) tables,
keyed upserts, clustered layout, compaction candidates and chunk-granular retention.

A chunk is a half-open interval ``[chunk_start, chunk_start + interval)`` aligned to the Unix
epoch. Chunks are the Parquet partition column, so time filters prune whole folders and
lifecycle jobs (compaction, retention, upsert) touch only the chunks they need.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNITS = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600,
          "day": 86400, "days": 86400, "week": 604800, "weeks": 604800}


def interval_seconds(interval: str) -> int:
    """'7 days' / '6 hours' / '30 minutes' → seconds."""
    n, unit = interval.strip().split()
    return int(n) * _UNITS[unit.lower()]


def _ts(v) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, str):
        v = datetime.fromisoformat(v)
    return F.lit(v).cast(T.TimestampNTZType())


_EPOCH = datetime(1970, 1, 1)


def chunk_start(ts, interval: str = "7 days") -> Column:
    """Start of the epoch-aligned chunk containing ``ts`` (TIMESTAMP_NTZ)."""
    sec = interval_seconds(interval)
    t = F.col(ts) if isinstance(ts, str) else ts
    n = F.floor(F.timestamp_diff("SECOND", _ts(_EPOCH), t) / F.lit(sec))
    return F.timestamp_add("SECOND", n * F.lit(sec), _ts(_EPOCH))


def with_chunk(df: DataFrame, ts: str = "block_timestamp", interval: str = "7 days",
               name: str = "chunk") -> DataFrame:
    return df.withColumn(name, chunk_start(ts, interval))


def rechunk(df: DataFrame, ts: str, old: str, new: str, since, name: str = "chunk") -> DataFrame:
    """Changing the chunk interval applies to new data only: rows at or after ``since`` get
    ``new``-sized chunks, older rows keep their ``old`` chunks."""
    t = F.col(ts)
    return df.withColumn(name, F.when(t >= _ts(since), chunk_start(t, new)).otherwise(chunk_start(t, old)))


def month_key(ts) -> Column:
    """``toYYYYMM``: year*100 + month as INT."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return (F.year(t) * 100 + F.month(t)).cast("int")


def time_filter(df: DataFrame, st, et, ts: str = "block_timestamp", chunk_col: str | None = None,
                interval: str = "7 days") -> DataFrame:
    """Half-open ``[st, et)`` filter; with ``chunk_col`` also a chunk predicate so Spark prunes
    partition folders (it does not derive chunk bounds from the timestamp bounds itself)."""
    cond = (F.col(ts) >= _ts(st)) & (F.col(ts) < _ts(et))
    if chunk_col:
        cond = cond & (F.col(chunk_col) >= chunk_start(_ts(st), interval)) & (F.col(chunk_col) < _ts(et))
    return df.filter(cond)


def replacing_dedup(df: DataFrame, key: list[str], version: str, *, ts: str = "block_timestamp",
                    partition: str | None = "month") -> DataFrame:
    """Last write wins per sort key within a monthly partition (a replacing table).

    ``version`` orders writes (ingest order); ties are broken by every remaining column (the
    largest wins) so the survivor is deterministic. An aggregate keyed by (month, key): Spark
    combines map-side and a hot month is split by key.
    """
    parts = list(key)
    if partition == "month":
        df = df.withColumn("__m", month_key(ts))
        parts = ["__m", *parts]
    rest = [c for c in df.columns if c not in parts and c != version]
    top = df.groupBy(*parts).agg(F.max(F.struct(version, *rest)).alias("__top"))
    return top.select(*[F.col(c) if c in parts else F.col("__top")[c].alias(c) for c in df.columns if c != "__m"])


def merge_batch(target: DataFrame, batch: DataFrame, key: list[str], version: str | None = None) -> DataFrame:
    """Upsert on a unique key: batch rows replace target rows with the same key.

    The batch is first de-duplicated (the largest ``version`` wins; without one the largest row
    by its other columns, which must be orderable), then ``target ⟕anti batch ∪ batch``. Both joins are equi-joins on the key, so Spark hash
    partitions them (or broadcasts a batch whose size estimate is small).
    """
    rest = [*([version] if version else []), *[c for c in batch.columns if c not in key and c != version]]
    names = [c for c in batch.columns if c != version]
    if rest:
        top = batch.groupBy(*key).agg(F.max(F.struct(*rest)).alias("__top"))
        batch = top.select(*[F.col(c) if c in key else F.col("__top")[c].alias(c) for c in names])
    else:
        batch = batch.distinct()
    kept = target.join(batch.select(*key), on=key, how="left_anti")
    return kept.unionByName(batch.select(*target.columns))


def touched_chunks(batch: DataFrame, ts: str = "block_timestamp", interval: str = "7 days") -> DataFrame:
    """Distinct chunks a batch writes to (the only partitions an upsert must overwrite)."""
    return batch.select(chunk_start(ts, interval).alias("chunk")).distinct()


def cluster_layout(df: DataFrame, *, chunk: str = "chunk", segment_by: str = "blknum",
                   order_by: tuple[str, ...] = ("item_id", "block_timestamp"), partitions: int | None = None) -> DataFrame:
    """Compressed-chunk layout: range partition by (chunk, segment key), sort inside each file
    by (item_id, ts) so Parquet min/max statistics prune point lookups."""
    cols = [c for c in order_by if c in df.columns]
    parted = df.repartitionByRange(partitions, chunk, segment_by) if partitions else df.repartitionByRange(chunk, segment_by)
    return parted.sortWithinPartitions(segment_by, *cols)


def write_chunked(df: DataFrame, path: str, *, ts: str = "block_timestamp", interval: str = "7 days",
                  mode: str = "overwrite", cluster: bool = True) -> None:
    """Write as Parquet partitioned by chunk; dynamic partition overwrite replaces only the
    chunks present in ``df``."""
    out = with_chunk(df, ts, interval)
    if cluster and "blknum" in out.columns:
        out = cluster_layout(out)
    (out.write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("chunk").parquet(path))


def chunk_floor(t, interval: str = "7 days") -> datetime:
    """Start of the chunk that holds an instant, as a Python value (a literal in filters)."""
    t = datetime.fromisoformat(t) if isinstance(t, str) else t
    sec = interval_seconds(interval)
    return _EPOCH + timedelta(seconds=(t - _EPOCH) // timedelta(seconds=1) // sec * sec)


def _cutoff(now, before: str, interval: str) -> datetime:
    """First instant of the first chunk that ends after ``now - before``: older rows are in
    chunks wholly before it."""
    now = datetime.fromisoformat(now) if isinstance(now, str) else now
    return chunk_floor(now - timedelta(seconds=interval_seconds(before)), interval)


def compaction_candidates(df: DataFrame, now, older_than: str, *, ts: str = "block_timestamp",
                          interval: str = "7 days") -> DataFrame:
    """Chunks wholly older than ``now - older_than`` (chunk end ≤ cutoff), with row counts. The
    cutoff is a literal, so newer row groups are not read."""
    old = df.filter(F.col(ts) < _ts(_cutoff(now, older_than, interval)))
    return with_chunk(old, ts, interval).groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"))


def compact(spark, path: str, now, older_than: str, *, interval: str = "7 days", target_rows: int = 5_000_000,
            segment_by: str = "blknum") -> DataFrame:
    """Rewrites the chunks of a chunk-partitioned table that are wholly older than
    ``now - older_than`` into few sorted files of about ``target_rows`` rows, through a staging
    folder beside them; other chunks are untouched. Returns (chunk, rows, files) of the
    rewritten chunks."""
    old = F.col("chunk") < _ts(_cutoff(now, older_than, interval))
    table = spark.read.parquet(path).filter(old)
    counts = table.groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"))
    files = counts.withColumn("files", F.ceil(F.col("rows") / target_rows))
    # a hot chunk is dealt to several files by its segment key, small chunks get one each
    dealt = table.join(files, "chunk").withColumn("__f", F.pmod(F.xxhash64(segment_by), F.col("files")))
    staging = f"{path.rstrip('/')}_compacting"
    (dealt.repartition("chunk", "__f").sortWithinPartitions("chunk", "__f", segment_by).drop("rows", "files", "__f")
     .write.mode("overwrite").partitionBy("chunk").parquet(staging))
    (spark.read.parquet(staging).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("chunk").parquet(path))
    done = spark.read.parquet(path).filter(old).select("chunk", F.input_file_name().alias("file"))
    per_file = done.groupBy("chunk", "file").agg(F.count(F.lit(1)).alias("rows"))
    return per_file.groupBy("chunk").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files"))


def retain(df: DataFrame, now, keep: str, *, ts: str = "block_timestamp", interval: str = "7 days") -> DataFrame:
    """Retention drops whole chunks whose end is at or before ``now - keep`` (not single rows).
    The filter is a literal on ``ts``, pushed into the scan."""
    return df.filter(F.col(ts) >= _ts(_cutoff(now, keep, interval)))
