"""Dataset differ: compare two loads of the same chain table and explain every difference.

One plan for the whole time span, instead of one round trip per hourly slice:

    filter both sides to [start, end)  →  left join on key (+ block_timestamp)
      →  a_/b_ projection with NULL sentinels  →  is_same / is_diff / reason / slice_start

``diff_summary`` (per-slice counts), ``diff_detail`` (every differing row) and ``diff_reasons`` (count per first differing column) are cheap projections of that
one frame; ``run_diff`` persists it when more than one output is requested.

Three-valued logic is kept exactly: a NULL in a column that has no sentinel makes the
comparison unknown, so such a row may be neither same nor diff; NULL keys never match;
right-only rows are not reported; duplicate keys fan out (``include_unmatched='explicit'``
adds an opt-in ``missing_right`` flag without changing the counts).
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainframe.session import stored
from chainframe.sources import schemas as S


@dataclass(frozen=True)
class DiffSpec:
    """What to compare for one table kind.

    keys:      join columns besides ``block_timestamp`` (plain equality: NULL never matches)
    columns:   projected columns in output order (each becomes a_<c>, b_<c>)
    sentinels: column → literal used by COALESCE; columns absent here keep NULL
    compare:   columns in the same/diff test
    reasons:   CASE order for ``reason`` (may differ from ``compare``)
    prefilter: optional row filter applied to both sides before the join
    normalize: column → function(Column) applied before the sentinel (e.g. create2 → create)
    """

    kind: str
    schema: T.StructType
    keys: tuple[str, ...]
    columns: tuple[str, ...]
    sentinels: dict = field(default_factory=dict)
    compare: tuple[str, ...] = ()
    reasons: tuple[str, ...] = ()
    prefilter: Callable[[], Column] | None = None
    normalize: dict = field(default_factory=dict)
    ts_col: str = "block_timestamp"


# --- fixed values: NULL sentinels per column, as the reference differ defines them ---------
BLOCK_SENTINELS = {
    "parent_hash": "-parent-hash", "nonce": "-nonce", "sha3_uncles": "-sha3_uncles",
    "logs_bloom": "-logs_bloom", "txs_root": "-txs_root", "state_root": "-state_root",
    "receipts_root": "-receipts_root", "miner": "-miner", "difficulty": -1,
    "total_difficulty": -1, "blk_size": -1, "extra_data": "-extra_data", "gas_limit": -1,
    "gas_used": -1, "tx_count": -1, "base_fee_per_gas": -1, "uncle_count": -1,
    "uncle0_hash": "-uncle0_hash", "uncle1_hash": "-uncle1_hash",
}
TX_SENTINELS = {
    "from_address": "-from-address", "to_address": "-to-address", "value": -1, "gas": -1,
    "gas_price": -1, "input": "-input", "max_fee_per_gas": -1, "max_priority_fee_per_gas": -1,
    "tx_type": -1, "receipt_cumulative_gas_used": -1, "receipt_gas_used": -1,
    "receipt_contract_address": "-receipt_contract_address", "receipt_root": "-receipt_root",
    "receipt_status": -1, "receipt_effective_gas_price": -1, "receipt_log_count": -1,
}
TRACE_SENTINELS = {
    "from_address": "-from-address", "to_address": "-to-address", "value": -1, "input": "-input",
    "output": "-output", "trace_type": "-trace-type", "call_type": "-call-type",
    "reward_type": "-reward-type", "gas": -1, "gas_used": -1, "subtraces": -1,
    "trace_address": "-[]", "error": "-error", "status": -1,
}
# --------------------------------------------------------------------------------------------

_BLOCK_COLS = ("blknum", "blkhash", "parent_hash", "nonce", "sha3_uncles", "logs_bloom", "txs_root",
               "state_root", "receipts_root", "miner", "difficulty", "total_difficulty", "blk_size",
               "extra_data", "gas_limit", "gas_used", "tx_count", "base_fee_per_gas", "uncle_count",
               "uncle0_hash", "uncle1_hash")
_TX_COLS = ("blknum", "txhash", "txpos", "nonce", "from_address", "to_address", "value", "gas",
            "gas_price", "input", "max_fee_per_gas", "max_priority_fee_per_gas", "tx_type",
            "receipt_cumulative_gas_used", "receipt_gas_used", "receipt_contract_address",
            "receipt_root", "receipt_status", "receipt_effective_gas_price", "receipt_log_count")
_TRACE_COLS = ("blknum", "txhash", "txpos", "from_address", "to_address", "value", "input", "output",
               "trace_type", "call_type", "reward_type", "gas", "gas_used", "subtraces",
               "trace_address", "error", "status")
_TRACE_COMPARE = ("blknum", "txhash", "txpos", "from_address", "to_address", "value", "call_type",
                  "reward_type", "subtraces", "trace_address", "input", "gas", "gas_used", "status",
                  "trace_type", "output")
_TRACE_REASONS = ("blknum", "txhash", "txpos", "from_address", "to_address", "value", "call_type",
                  "reward_type", "subtraces", "trace_address", "input", "gas", "gas_used", "error",
                  "status", "trace_type", "output")
_LOG_COLS = ("blknum", "txhash", "txpos", "logpos", "address", "n_topics", "topics", "data", "topics_0")

BLOCK = DiffSpec(
    kind="block", schema=S.BLOCKS, keys=("blknum",), columns=_BLOCK_COLS,
    sentinels=BLOCK_SENTINELS, compare=_BLOCK_COLS,
    # logs_bloom is compared but has no reason branch: such rows report 'unknown'
    reasons=tuple(c for c in _BLOCK_COLS if c != "logs_bloom"),
)
TX = DiffSpec(
    kind="transaction", schema=S.TXS, keys=("blknum", "txhash", "txpos"), columns=_TX_COLS,
    sentinels=TX_SENTINELS, compare=_TX_COLS, reasons=_TX_COLS,
)
TRACE = DiffSpec(
    kind="trace", schema=S.TRACES, keys=("blknum", "txhash", "txpos", "trace_address"),
    columns=_TRACE_COLS, sentinels=TRACE_SENTINELS, compare=_TRACE_COMPARE, reasons=_TRACE_REASONS,
    # `<> 'reward'` also drops NULL trace types (three-valued filter)
    prefilter=lambda: F.col("trace_type") != F.lit("reward"),
    normalize={"trace_type": lambda c: F.when(c == F.lit("create2"), F.lit("create")).otherwise(c)},
)
LOG = DiffSpec(
    kind="log", schema=S.LOGS, keys=("blknum", "txhash", "logpos"), columns=_LOG_COLS,
    sentinels={}, compare=_LOG_COLS, reasons=_LOG_COLS,
)
SPECS = {"block": BLOCK, "transaction": TX, "trace": TRACE, "log": LOG}


def _as_ntz(v) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, str):
        v = datetime.fromisoformat(v)
    return F.lit(v).cast(T.TimestampNTZType())


def slice_bounds(start, end, slice_hours: int = 1) -> tuple[datetime, datetime]:
    """Whole slices starting at ``start`` and covering ``[start, end)``.

    The last slice is always complete, so the effective end may lie past ``end`` (the
    reference's hourly loop behaves the same way).
    """
    st = datetime.fromisoformat(start) if isinstance(start, str) else start
    et = datetime.fromisoformat(end) if isinstance(end, str) else end
    step = timedelta(hours=slice_hours)
    n = max(0, -(-(et - st) // step))
    return st, st + n * step


def whole_slices(df: DataFrame, slice_hours: int = 1, ts: str = "block_timestamp") -> tuple[datetime, datetime]:
    """Bounds that cover all rows of ``df``, at slice boundaries (one row from the table)."""
    lo, hi = df.agg(F.min(ts), F.max(ts)).first()
    if lo is None:
        return datetime(1970, 1, 1), datetime(1970, 1, 1)
    step = timedelta(hours=slice_hours)
    down = lambda t: datetime(1970, 1, 1) + (t - datetime(1970, 1, 1)) // step * step
    return down(lo), down(hi) + step


def _side(df: DataFrame, spec: DiffSpec, st: datetime, et: datetime, prefix: str) -> DataFrame:
    """Time-filtered side with every column renamed to ``<prefix>_<c>`` before the join, so no
    raw column is re-aliased above the join (see ``dataset_diff``)."""
    df = S.conform(df, spec.schema)
    ts = F.col(spec.ts_col)
    df = df.filter((ts >= _as_ntz(st)) & (ts < _as_ntz(et)))
    if spec.prefilter is not None:
        df = df.filter(spec.prefilter())
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in (spec.ts_col,) + spec.columns])


def _sentinel(spec: DiffSpec, c: str, dtype: T.DataType) -> Column:
    v = spec.sentinels[c]
    return F.lit(str(v) if isinstance(dtype, T.StringType) else v).cast(dtype)


def _shown(col: Column, spec: DiffSpec, c: str, dtype: T.DataType) -> Column:
    """The value the reference prints for a column: normalised, NULL replaced by the sentinel."""
    if c in spec.normalize:
        col = spec.normalize[c](col)
    if c in spec.sentinels:
        col = F.coalesce(col, _sentinel(spec, c, dtype))
    return col


def _compared(col: Column, spec: DiffSpec, c: str, dtype: T.DataType) -> Column:
    """Same value as ``_shown`` written as one CASE: the comparison predicates must not contain
    the output alias expressions, or Catalyst's constraint inference substitutes every alias
    into the filter (2^columns constraints)."""
    if c not in spec.sentinels and c not in spec.normalize:
        return col
    out = F.when(col.isNull(), _sentinel(spec, c, dtype) if c in spec.sentinels else F.lit(None).cast(dtype))
    if c in spec.normalize:
        return out.otherwise(spec.normalize[c](col))
    return out.otherwise(col)


def dataset_diff(a: DataFrame, b: DataFrame, spec: DiffSpec | str, start, end, *,
                 slice_hours: int = 1, include_unmatched: str = "reference") -> DataFrame:
    """Left-join ``a`` (reference side) to ``b`` and classify every left row.

    Output: ``slice_start``, ``a_block_timestamp``, ``b_block_timestamp``, ``a_<c>``/``b_<c>``
    for every spec column, ``is_same``, ``is_diff`` (NULL counts as not), ``reason``.
    The join is a plain equi-join on (block_timestamp, keys): Catalyst/AQE choose broadcast
    or sort-merge from the filtered sizes; both sides are pruned to the same time range.
    """
    if isinstance(spec, str):
        spec = SPECS[spec]
    st, et = slice_bounds(start, end, slice_hours)
    return _classified(_side(a, spec, st, et, "a"), _side(b, spec, st, et, "b"), spec, st, slice_hours, include_unmatched)


def _classified(left: DataFrame, right: DataFrame, spec: DiffSpec, st: datetime, slice_hours: int,
                include_unmatched: str = "reference") -> DataFrame:
    """The join of two sides (``_side``) and its classification."""
    keys = (spec.ts_col,) + spec.keys
    cond = functools.reduce(lambda x, y: x & y, [left[f"a_{k}"] == right[f"b_{k}"] for k in keys])
    j = left.join(right, cond, "left")

    types = {f.name: f.dataType for f in spec.schema.fields}

    def cmp(side, c):
        return _compared(F.col(f"{side}_{c}"), spec, c, types[c])

    ne = {c: cmp("a", c) != cmp("b", c) for c in set(spec.compare) | set(spec.reasons)}
    same = functools.reduce(lambda x, y: x & y, [cmp("a", c) == cmp("b", c) for c in spec.compare])
    diff = functools.reduce(lambda x, y: x | y, [ne[c] for c in spec.compare])
    reason = None
    for c in spec.reasons:
        reason = F.when(ne[c], F.lit(c)) if reason is None else reason.when(ne[c], F.lit(c))
    reason = reason.otherwise(F.lit("unknown"))

    hours = F.floor(F.timestamp_diff("SECOND", _as_ntz(st), F.col(f"a_{spec.ts_col}")) / F.lit(3600 * slice_hours))
    slice_start = F.timestamp_add("HOUR", hours * F.lit(slice_hours), _as_ntz(st))

    cols = [slice_start.alias("slice_start"), F.col(f"a_{spec.ts_col}"), F.col(f"b_{spec.ts_col}")]
    for c in spec.columns:
        for side in ("a", "b"):
            cols.append(_shown(F.col(f"{side}_{c}"), spec, c, types[c]).alias(f"{side}_{c}"))
    if include_unmatched == "explicit":
        cols.append(F.col(f"b_{spec.ts_col}").isNull().alias("missing_right"))
    cols += [F.coalesce(same, F.lit(False)).alias("is_same"), F.coalesce(diff, F.lit(False)).alias("is_diff"),
             F.when(diff, reason).alias("reason")]
    return j.select(*cols)


@dataclass(frozen=True)
class DigestDiff:
    """A digest-first comparison: slices' counts of equal rows, and the classified rows of the
    buckets that differ."""

    clean: DataFrame  # slice_start, same
    rows: DataFrame  # as of ``dataset_diff``

    def summary(self) -> DataFrame:
        other = diff_summary(self.rows).select("slice_start", "same", "diff")
        both = other.unionByName(self.clean.withColumn("diff", F.lit(0).cast("long")))
        return both.groupBy("slice_start").agg(F.sum("same").alias("same"), F.sum("diff").alias("diff"))


_MOST_DIRTY = 100_000  # (slice, bucket) pairs, 12 bytes each, that may be broadcast


def digest_diff(a: DataFrame, b: DataFrame, spec: DiffSpec | str, start, end, *, slice_hours: int = 1, buckets: int = 64) -> DigestDiff:
    """``dataset_diff`` of two tables whose keys are unique, without joining what is equal.

    Both sides are read once into order-free digests by slice and bucket of the key's hash (row
    count, xor of one 64-bit hash, sum of another: a few numbers a slice, combined before the
    shuffle). Where both digests agree, the rows are the same on both sides: those without a NULL
    in a compared column count as same, none differs. Only the rows of the other buckets are read
    again and joined. Equal tables cost one scan and no join. Two different buckets pass as equal
    only if count, xor and sum of their 128 bits of hashes agree by chance."""
    if isinstance(spec, str):
        spec = SPECS[spec]
    st, et = slice_bounds(start, end, slice_hours)
    types = {f.name: f.dataType for f in spec.schema.fields}
    keys = (spec.ts_col,) + spec.keys
    width = F.lit(3600 * slice_hours)

    def marked(df: DataFrame, side: str) -> DataFrame:
        d = _side(df, spec, st, et, side)
        number = F.floor(F.timestamp_diff("SECOND", _as_ntz(st), F.col(f"{side}_{spec.ts_col}")) / width).cast("int")
        bucket = F.pmod(F.xxhash64(*[F.col(f"{side}_{k}") for k in keys]), F.lit(buckets)).cast("int")
        return d.withColumn("__slice", number).withColumn("__bucket", bucket)

    def digests(d: DataFrame, side: str) -> DataFrame:
        every = tuple(dict.fromkeys((*spec.compare, *spec.reasons)))
        values = [_compared(F.col(f"{side}_{c}"), spec, c, types[c]) for c in every]
        nulls = [v.isNull().cast("int") for v in values]  # xxhash64 skips NULLs
        own = [F.col(f"{side}_{k}") for k in keys]
        d = d.select("__slice", "__bucket", F.xxhash64(*own, *values, *nulls).alias("h"),
                     F.xxhash64(F.lit(1), *nulls, *values, *own).alias("g"),
                     functools.reduce(lambda x, y: x & y, [v.isNotNull() for v in (*own, *[
                         _compared(F.col(f"{side}_{c}"), spec, c, types[c]) for c in spec.compare])]).alias("known"),
                     functools.reduce(lambda x, y: x | y, [k.isNull() for k in own]).alias("keyless"))
        return d.groupBy("__slice", "__bucket").agg(
            F.count(F.lit(1)).alias(f"{side}_n"), F.bit_xor("h").alias(f"{side}_x"),
            F.sum(F.col("g").cast("decimal(20,0)")).alias(f"{side}_s"), F.count_if("known").alias(f"{side}_known"),
            F.count_if("keyless").alias(f"{side}_keyless"))

    left, right = marked(a, "a"), marked(b, "b")
    both = stored(digests(left, "a").join(digests(right, "b"), ["__slice", "__bucket"], "left"), "diff-digests")
    equal = F.coalesce((F.col("a_n") == F.col("b_n")) & (F.col("a_x") == F.col("b_x")) & (F.col("a_s") == F.col("b_s"))
                       & (F.col("a_keyless") == 0), F.lit(False))  # a NULL key matches nothing, not even itself
    start_of = F.timestamp_add("HOUR", F.col("__slice") * F.lit(slice_hours), _as_ntz(st))
    clean = both.filter(equal).groupBy(start_of.alias("slice_start")).agg(F.sum("a_known").alias("same"))
    dirty = both.filter(~equal).select("__slice", "__bucket")
    n, lo, hi = dirty.agg(F.count(F.lit(1)), F.min("__slice"), F.max("__slice")).first()
    if not n:
        first = past = datetime(1970, 1, 1)
    else:  # the time range that holds the differing slices, for the scan
        first, past = st + timedelta(hours=lo * slice_hours), st + timedelta(hours=(hi + 1) * slice_hours)
    known = F.broadcast(dirty) if n <= _MOST_DIRTY else dirty

    def unlike(df: DataFrame, side: str) -> DataFrame:
        ts = F.col(f"{side}_{spec.ts_col}")
        d = marked(df, side).filter((ts >= _as_ntz(first)) & (ts < _as_ntz(past))).join(known, ["__slice", "__bucket"], "left_semi")
        return d.drop("__slice", "__bucket")

    return DigestDiff(clean, _classified(unlike(a, "a"), unlike(b, "b"), spec, st, slice_hours))


def diff_summary(j: DataFrame) -> DataFrame:
    """Per slice: rows that are the same and rows that differ (one pass, no second scan)."""
    return j.groupBy("slice_start").agg(
        F.count_if(F.col("is_same")).alias("same"),
        F.count_if(F.col("is_diff")).alias("diff"),
    )


def diff_detail(j: DataFrame) -> DataFrame:
    """Every differing row with its ``reason`` (a projection of the join: no further shuffle)."""
    return j.filter(F.col("is_diff")).drop("is_same", "is_diff")


def diff_reasons(j: DataFrame, spec: DiffSpec | str | None = None) -> DataFrame:
    """Count of differing rows per (slice, reason); counts non-NULL ``a_blknum`` like the reference."""
    d = j.filter(F.col("is_diff"))
    return d.groupBy("slice_start", "reason").agg(F.count("a_blknum").alias("count"))


def slice_label(slice_start: Column, slice_hours: int = 1) -> Column:
    """``YYYYmmddHHMMSS-YYYYmmddHHMMSS`` name of a slice (the CSV file name of the reference)."""
    fmt = "yyyyMMddHHmmss"
    end = F.timestamp_add("HOUR", F.lit(slice_hours), slice_start)
    return F.concat(F.date_format(slice_start, fmt), F.lit("-"), F.date_format(end, fmt))


def write_diff_csv(detail: DataFrame, path: str, slice_hours: int = 1, mode: str = "overwrite") -> None:
    """One CSV folder per slice (``slice=<st>-<et>``), header on; written by the executors.

    Rows are dealt by slice first: a slice's folder gets one file, not one from every task (slices
    times tasks files). Adaptive execution splits what is large between tasks, also within a slice."""
    (detail.withColumn("slice", slice_label(F.col("slice_start"), slice_hours))
     .drop("slice_start").hint("rebalance", F.col("slice"))
     .write.mode(mode).partitionBy("slice").option("header", True).csv(path))


def run_diff(a: DataFrame, b: DataFrame, spec: DiffSpec | str, start, end, *,
             slice_hours: int = 1, csv_path: str | None = None) -> dict[str, DataFrame]:
    """The differ CLI as one job set: summary, detail and reasons from one persisted join."""
    from pyspark import StorageLevel

    j = dataset_diff(a, b, spec, start, end, slice_hours=slice_hours).persist(StorageLevel.MEMORY_AND_DISK)
    out = {"summary": diff_summary(j), "detail": diff_detail(j), "reasons": diff_reasons(j)}
    if csv_path:
        write_diff_csv(out["detail"], csv_path, slice_hours)
    return out
