"""Skew-safe ordered-window helpers.

``Window.partitionBy(key).orderBy(x)`` sends every row of a key to one task. Chain data has
keys that hold a large share of all rows (an exchange address, a stablecoin, the global block
order), so ordered operators here split each key into buckets of its ordering column:

1. the operator runs inside ``(key, bucket)`` partitions (bounded size);
2. a per-bucket summary (last row, or total) is computed — one small row per bucket;
3. a window over the summaries (one row per bucket, so tiny even for a hot key) carries the
   value across bucket boundaries, and is joined back on ``(key, bucket)``.

The result is identical to the single-window form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _bucket(order_col: str, width: int) -> Column:
    return F.floor(F.col(order_col) / F.lit(width)).cast("long")


def bucketed_lag(df: DataFrame, keys: list[str], order_col: str, cols: list[str], *, width: int,
                 tiebreak: list[str] = (), prefix: str = "prev_", keep_bucket: bool = False) -> DataFrame:
    """``lag(c) over (partition by keys order by order_col, tiebreak)`` for each ``c`` in
    ``cols``, computed in buckets of ``width`` units of the (numeric) ordering column. With
    ``keep_bucket`` the bucket stays as ``__b``: grouping by it needs no further shuffle."""
    order = [F.col(order_col)] + [F.col(t) for t in tiebreak]
    d = df.withColumn("__b", _bucket(order_col, width))
    w = Window.partitionBy(*keys, "__b").orderBy(*order)
    d = d.withColumn("__first", F.lag(F.lit(1)).over(w).isNull())
    d = d.withColumn("__end", F.lead(F.lit(1)).over(w).isNull())
    for c in cols:
        d = d.withColumn(prefix + c, F.lag(F.col(c)).over(w))
    last = d.filter("__end").select(*keys, "__b", F.struct(*[F.col(c).alias(c) for c in cols]).alias("__last"))
    d = d.drop("__end")
    wb = Window.partitionBy(*keys).orderBy("__b")
    carry = last.select(*keys, "__b", F.lag("__last").over(wb).alias("__carry"))
    d = d.join(carry, on=[*keys, "__b"], how="left")
    for c in cols:
        d = d.withColumn(prefix + c, F.when(F.col("__first"), F.col("__carry")[c]).otherwise(F.col(prefix + c)))
    return d.drop("__first", "__carry") if keep_bucket else d.drop("__b", "__first", "__carry")


def bucketed_running_sum(df: DataFrame, keys: list[str], order_col: str, cols: list[str], *, width: int,
                         tiebreak: list[str] = (), prefix: str = "cum_") -> DataFrame:
    """Running ``sum(c)`` (rows unbounded preceding → current) per key in ``order_col`` order."""
    order = [F.col(order_col)] + [F.col(t) for t in tiebreak]
    d = df.withColumn("__b", _bucket(order_col, width))
    w = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for c in cols:
        d = d.withColumn(prefix + c, F.sum(F.col(c)).over(w))
    tot = d.groupBy(*keys, "__b").agg(*[F.sum(F.col(c)).alias(f"__t_{c}") for c in cols])
    wb = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = tot.select(*keys, "__b", *[F.coalesce(F.sum(f"__t_{c}").over(wb), F.lit(0)).alias(f"__c_{c}") for c in cols])
    d = d.join(carry, on=[*keys, "__b"], how="left")
    for c in cols:
        d = d.withColumn(prefix + c, F.col(prefix + c) + F.col(f"__c_{c}"))
    return d.drop("__b", *[f"__c_{c}" for c in cols])


def _struct_of(df: DataFrame, cols: list[str]):
    return df.select(F.struct(*[F.col(c) for c in cols]).alias("s")).schema["s"].dataType


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str,
              values: list[str], *, bucket_seconds: int = 86400, tiebreak: list[str] | None = None) -> DataFrame:
    """For each left row, the ``values`` of the latest right row with the same keys and
    ``right_ts <= left_ts`` (NULL when none, and when a key is NULL). Of right rows at one
    instant the largest by ``tiebreak`` (by default ``values``) counts. No range join, no
    per-key task:

    * inside a (keys, time bucket) partition, ``last(ignorenulls)`` over the union of both
      sides ordered by time (right rows first on ties) finds the in-bucket match;
    * left rows without one take the last right row of the latest earlier bucket, found by
      the same ``last`` over per-bucket summaries (one row per bucket) and an equi-join.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    tie = list(values if tiebreak is None else tiebreak)
    for k in keys:
        right = right.filter(F.col(k).isNotNull())
    lb = F.floor(F.timestamp_diff("SECOND", epoch, F.col(left_ts)) / F.lit(bucket_seconds)).cast("long")
    rb = F.floor(F.timestamp_diff("SECOND", epoch, F.col(right_ts)) / F.lit(bucket_seconds)).cast("long")
    lcols = left.columns
    L = left.select(*[F.col(c).alias(f"__l_{c}") for c in lcols], *[F.col(k).alias(k) for k in keys],
                    F.col(left_ts).alias("__t"), lb.alias("__b"), F.lit(1).alias("__side"),
                    *[F.lit(None).cast(right.schema[v].dataType).alias(f"__r_{v}") for v in values],
                    F.lit(None).cast("timestamp_ntz").alias("__rts"), F.lit(None).cast(_struct_of(right, tie)).alias("__tie"))
    R = right.select(*[F.lit(None).cast(left.schema[c].dataType).alias(f"__l_{c}") for c in lcols],
                     *[F.col(k) for k in keys], F.col(right_ts).alias("__t"), rb.alias("__b"), F.lit(0).alias("__side"),
                     *[F.col(v).alias(f"__r_{v}") for v in values], F.col(right_ts).alias("__rts"),
                     F.struct(*[F.col(c) for c in tie]).alias("__tie"))
    u = L.unionByName(R)
    w = Window.partitionBy(*keys, "__b").orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pack = F.when(F.col("__side") == 0, F.struct(*[F.col(f"__r_{v}").alias(v) for v in values], F.col("__rts").alias("__rts")))
    u = u.withColumn("__m", F.last(pack, ignorenulls=True).over(w))
    lrows = u.filter(F.col("__side") == 1)
    # summaries: last right row per bucket, and the buckets that have unmatched left rows
    rlast = R.groupBy(*keys, "__b").agg(F.max_by(F.struct(*[F.col(f"__r_{v}").alias(v) for v in values],
                                                           F.col("__rts").alias("__rts")),
                                                 F.struct("__t", "__tie")).alias("__s"))
    need = lrows.filter(F.col("__m").isNull()).select(*keys, "__b").distinct()
    # need rows sort before the same bucket's summary, so they only see earlier buckets
    summ = need.select(*keys, "__b", F.lit(None).cast(rlast.schema["__s"].dataType).alias("__s"), F.lit(0).alias("__o")) \
        .unionByName(rlast.withColumn("__o", F.lit(1)))
    wb = Window.partitionBy(*keys).orderBy("__b", "__o").rowsBetween(Window.unboundedPreceding, -1)
    carry = summ.withColumn("__c", F.last("__s", ignorenulls=True).over(wb)) \
        .filter(F.col("__o") == 0).select(*keys, "__b", "__c")
    out = lrows.join(carry, on=[*keys, "__b"], how="left")
    m = F.coalesce(F.col("__m"), F.col("__c"))
    return out.select(*[F.col(f"__l_{c}").alias(c) for c in lcols], *[m[v].alias(v) for v in values],
                      m["__rts"].alias("matched_ts"))
