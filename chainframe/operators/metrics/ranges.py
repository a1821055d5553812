"""Selectors and range-vector functions evaluated on a fixed step grid.

Scalable form (never a grid × samples join):

1. one ``lag`` per series (bucketed by day, so a long series is not one task) gives the
   counter increment ``inc`` (reset-aware) and the change flag ``chg`` of every sample;
2. samples are folded, where they are, into *segments*: those inside a pane, and those exactly on
   its right edge (windows are closed on both sides). A pane is the greatest common divisor of
   window and step. A segment is mergeable: count, first and last sample, increase, changes, sums
   of values and of a regression, extremes;
3. each segment is exploded into the eval steps whose closed window ``[t-w, t]`` contains it
   (fan-out = w / step, of panes, however many samples they hold);
4. one ``groupBy(series, step)`` with algebraic aggregates on numbers only merges the segments, so
   Spark combines map-side and shuffles one row a series and step; name and labels are part of the
   key (labels as sorted entries), not aggregates;
5. extrapolation and the final formula are a projection.

Output frame: ``name, labels, series_key, eval_ts, value``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainframe.operators.windows import bucketed_lag

DAY_US = 86_400_000_000
_WHOLE = "decimal(18,0)"  # microseconds, for squares of them


def _ntz(v) -> Column:
    if isinstance(v, str):
        v = datetime.fromisoformat(v)
    return F.lit(v).cast("timestamp_ntz")


def seconds(spec) -> int:
    """'5m', '1h', '15s', '2d' or an int of seconds."""
    if isinstance(spec, (int, float)):
        return int(spec)
    unit = spec[-1]
    return int(spec[:-1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}[unit]


@dataclass(frozen=True)
class Grid:
    """Evaluation instants ``start + k·step`` for k = 0..n (inclusive of ``end`` when aligned)."""

    start: datetime
    end: datetime
    step: int  # seconds

    @classmethod
    def of(cls, start, end, step) -> "Grid":
        s = datetime.fromisoformat(start) if isinstance(start, str) else start
        e = datetime.fromisoformat(end) if isinstance(end, str) else end
        return cls(s, e, seconds(step))

    @property
    def n(self) -> int:
        return int((self.end - self.start).total_seconds() // self.step)

    def ts_of(self, k: Column) -> Column:
        return F.timestamp_add("SECOND", k * F.lit(self.step), _ntz(self.start))

    def offset_us(self, ts: Column) -> Column:
        return F.timestamp_diff("MICROSECOND", _ntz(self.start), ts)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The grid as rows (``k``, ``eval_ts``) — n+1 rows, for absent()/vector matching."""
        return spark.range(0, self.n + 1).select(F.col("id").alias("k"), self.ts_of(F.col("id")).alias("eval_ts"))

    def at(self, t: datetime) -> "Grid":
        return Grid(t, t, self.step)


def select(m: DataFrame, name: str | None = None, matchers: list[tuple[str, str, str]] = (),
           name_regex: str | None = None) -> DataFrame:
    """``name{l op "v", …}`` with ``=``, ``!=``, ``=~``, ``!~``; regexes are fully
    anchored and an absent label matches as the empty string."""
    cond = F.lit(True)
    if name is not None:
        cond = cond & (F.col("name") == name)
    if name_regex is not None:
        cond = cond & F.col("name").rlike(f"^(?:{name_regex})$")
    for label, op, val in matchers:
        v = F.coalesce(F.col("labels")[label], F.lit(""))
        if op == "=":
            c = v == val
        elif op == "!=":
            c = v != val
        elif op == "=~":
            c = v.rlike(f"^(?:{val})$")
        elif op == "!~":
            c = ~v.rlike(f"^(?:{val})$")
        else:
            raise ValueError(op)
        cond = cond & c
    return m.filter(cond)


def entries(m: DataFrame) -> DataFrame:
    """Labels as sorted entries, which (unlike a map) can be a grouping key."""
    return m.withColumn("__e", F.array_sort(F.map_entries("labels"))).drop("labels")


def _prepared(m: DataFrame, grid: Grid) -> DataFrame:
    """Samples with microsecond offset ``__t``, previous value (bucketed lag), inc and chg, and the
    bucket ``__b`` by which they lie together."""
    d = m.withColumn("__t", grid.offset_us(F.col("ts")))
    d = bucketed_lag(d, ["series_key"], "__t", ["value", "__t"], width=DAY_US, tiebreak=["value"], prefix="__prev_", keep_bucket=True)
    prev = F.col("__prev_value")
    d = d.withColumn("__inc", F.when(prev.isNull(), F.lit(0.0))
                     .when(F.col("value") >= prev, F.col("value") - prev).otherwise(F.col("value")))
    return d.withColumn("__chg", F.when(prev.isNull(), F.lit(0)).when(F.col("value") != prev, F.lit(1)).otherwise(F.lit(0)))


def segments(m: DataFrame, grid: Grid, pane_s: int, offset_s: int = 0) -> DataFrame:
    """One row per series, pane and edge: ``__pane`` covers the times ``((p-1)·w, p·w]``, its edge
    ``p·w`` apart. ``__x`` counts microseconds from the edge, whose sums are whole numbers, so that
    moving them to another origin loses nothing; ``__inc1`` and ``__chg1`` are the first
    sample's, which a window that begins with it leaves out."""
    pane_us = pane_s * 1_000_000
    d = entries(_prepared(m, grid)).withColumn("__t", F.col("__t") + F.lit(offset_s * 1_000_000))
    d = d.withColumn("__pane", F.ceil(F.col("__t") / F.lit(pane_us)).cast("long"))
    d = d.withColumn("__edge", F.col("__t") == F.col("__pane") * F.lit(pane_us))
    d = d.withColumn("__x", F.col("__t") - F.col("__pane") * F.lit(pane_us))
    gap = (F.col("__t") - F.lit(offset_s * 1_000_000) - F.col("__prev___t")) / F.lit(1e6)
    v, x, t = F.col("value"), F.col("__x"), F.col("__t")
    return d.groupBy("series_key", "__b", "name", "__e", "__pane", "__edge").agg(
        F.count(F.lit(1)).alias("__n"), F.min(t).alias("__t1"), F.max(t).alias("__tn"),
        F.min_by(v, t).alias("__v1"), F.max_by(v, t).alias("__vn"),
        F.sum("__inc").alias("__inc"), F.min_by("__inc", t).alias("__inc1"),
        F.sum("__chg").alias("__chg"), F.min_by("__chg", t).alias("__chg1"),
        F.max_by("__prev_value", t).alias("__pv"), F.max_by(gap, t).alias("__dt"),
        F.max(v).alias("__max"), F.min(v).alias("__min"), F.sum(v).alias("__sv"),
        F.sum(x).alias("__sx"), F.sum(x.cast(_WHOLE) * x.cast(_WHOLE)).cast("decimal(38,0)").alias("__sxx"),
        F.sum(x * v).alias("__sxv"))


def _assign_steps(d: DataFrame, grid: Grid, window_s: int, offset_s: int = 0) -> DataFrame:
    """Explode each sample into the steps k whose window [t_k - off - w, t_k - off] holds it."""
    step_us = grid.step * 1_000_000
    t = F.col("__t") + F.lit(offset_s * 1_000_000)
    lo = F.greatest(F.ceil(t / F.lit(step_us)), F.lit(0)).cast("long")
    hi = F.least(F.floor((t + F.lit(window_s * 1_000_000)) / F.lit(step_us)), F.lit(grid.n)).cast("long")
    d = d.filter(lo <= hi)  # a sample may fall between windows when w < step
    return d.withColumn("__k", F.explode(F.sequence(lo, hi)))


def _window_stats(m: DataFrame, grid: Grid, window, offset=0) -> DataFrame:
    w = seconds(window)
    pane_s = math.gcd(w, grid.step) or 1
    d = segments(m, grid, pane_s, seconds(offset))
    # the steps whose window holds the segment; one on an edge is also in the window that begins there
    at, step, wide = F.col("__pane") * F.lit(pane_s), F.lit(grid.step), F.lit(w)
    lo = F.greatest(F.ceil(at / step), F.lit(0)).cast("long")
    last = F.when(F.col("__edge"), F.floor((at + wide) / step)).otherwise(F.ceil((at + wide) / step) - 1)
    hi = F.least(last, F.lit(grid.n)).cast("long")
    d = d.filter(lo <= hi).withColumn("__k", F.explode(F.sequence(lo, hi)))
    # from the pane's edge to the eval instant: regression sums move there, for the intercept is the
    # instant's
    c = (at - F.col("__k") * step) * F.lit(1_000_000)
    n, sx, sv = F.col("__n"), F.col("__sx"), F.col("__sv")
    us = F.col("__k") * F.lit(grid.step * 1_000_000)
    moved = (F.col("__sxx") + ((2 * sx + n * c).cast(_WHOLE) * c.cast(_WHOLE))).cast("decimal(38,0)")
    d = d.withColumns({"__sxx": moved, "__sxv": F.col("__sxv") + c * sv, "__sx": sx + n * c,
                       "__x1": (F.col("__t1") - us) / F.lit(1e6), "__xn": (F.col("__tn") - us) / F.lit(1e6)})
    g = d.groupBy("series_key", "name", "__e", "__k").agg(
        F.sum("__n").alias("__n"), F.min("__x1").alias("__x1"), F.max("__xn").alias("__xn"),
        F.min_by("__v1", "__t1").alias("__v1"), F.max_by("__vn", "__tn").alias("__vn"),
        (F.sum("__inc") - F.min_by("__inc1", "__t1")).alias("__res"),
        (F.sum("__chg") - F.min_by("__chg1", "__t1")).alias("__changes"),
        F.max("__max").alias("__max"), F.min("__min").alias("__min"),
        F.max_by("__pv", "__tn").alias("__pv"), F.max_by("__dt", "__tn").alias("__dt"),
        *[F.sum(x).alias(x) for x in ("__sv", "__sx", "__sxx", "__sxv")])
    n, sx, sv = F.col("__n"), F.col("__sx"), F.col("__sv")
    spread = (n.cast(_WHOLE) * F.col("__sxx") - (sx.cast(_WHOLE) * sx.cast(_WHOLE))).cast("double")  # 0 at one instant
    slope = F.try_divide(n * F.col("__sxv") - sx * sv, F.when(spread > 0, spread))
    return (g.withColumn("__avg", sv / n).withColumn("__slope", slope * F.lit(1e6))
            .withColumn("__icpt", (sv - F.col("__slope") / F.lit(1e6) * sx) / n))


def _out(g: DataFrame, grid: Grid, value: Column, cond: Column | None = None) -> DataFrame:
    if cond is not None:
        g = g.filter(cond)
    return g.select("name", F.map_from_entries("__e").alias("labels"), "series_key", grid.ts_of(F.col("__k")).alias("eval_ts"), value.alias("value"))


def _extrapolated(g: DataFrame, window_s: int, is_counter: bool, is_rate: bool) -> Column:
    """The extrapolated delta of Prometheus 2.x (``extrapolatedRate``) as a projection."""
    range_start = F.lit(-float(window_s))
    res = F.col("__res") if is_counter else (F.col("__vn") - F.col("__v1"))
    sampled = F.col("__xn") - F.col("__x1")
    to_start = F.col("__x1") - range_start
    to_end = -F.col("__xn")
    avg_gap = F.try_divide(sampled, (F.col("__n") - 1).cast("double"))
    if is_counter:
        to_zero = sampled * F.try_divide(F.col("__v1"), res)
        to_start = F.when((res > 0) & (F.col("__v1") >= 0) & (to_zero < to_start), to_zero).otherwise(to_start)
    thr = avg_gap * F.lit(1.1)
    ext = sampled + F.when(to_start < thr, to_start).otherwise(avg_gap / 2) + F.when(to_end < thr, to_end).otherwise(avg_gap / 2)
    out = res * F.try_divide(ext, sampled)
    if is_rate:
        out = out / F.lit(float(window_s))
    return out


def rate(m: DataFrame, window, grid: Grid, offset=0) -> DataFrame:
    """Per-second reset-aware rate with edge extrapolation; <2 samples → no row."""
    g = _window_stats(m, grid, window, offset=offset)
    return _out(g, grid, _extrapolated(g, seconds(window), True, True), F.col("__n") >= 2)


def increase(m: DataFrame, window, grid: Grid, offset=0) -> DataFrame:
    """R2: ``rate × window`` (same extrapolation, not divided by the range)."""
    g = _window_stats(m, grid, window, offset=offset)
    return _out(g, grid, _extrapolated(g, seconds(window), True, False), F.col("__n") >= 2)


def irate(m: DataFrame, window, grid: Grid) -> DataFrame:
    """Per-second rate from the last two samples in the window (reset → last value)."""
    g = _window_stats(m, grid, window)
    v, pv = F.col("__vn"), F.col("__pv")
    return _out(g, grid, F.try_divide(F.when(v < pv, v).otherwise(v - pv), F.col("__dt")), F.col("__n") >= 2)


def deriv(m: DataFrame, window, grid: Grid) -> DataFrame:
    """Least-squares slope per second."""
    g = _window_stats(m, grid, window)
    return _out(g, grid, F.col("__slope"), F.col("__n") >= 2)


def predict_linear(m: DataFrame, window, seconds_ahead, grid: Grid) -> DataFrame:
    """Regression value ``seconds_ahead`` after the eval instant (x relative to it)."""
    g = _window_stats(m, grid, window)
    return _out(g, grid, F.col("__icpt") + F.col("__slope") * F.lit(float(seconds(seconds_ahead))), F.col("__n") >= 2)


def avg_over_time(m: DataFrame, window, grid: Grid) -> DataFrame:
    g = _window_stats(m, grid, window)
    return _out(g, grid, F.col("__avg"))


def max_over_time(m: DataFrame, window, grid: Grid) -> DataFrame:
    g = _window_stats(m, grid, window)
    return _out(g, grid, F.col("__max"))


def min_over_time(m: DataFrame, window, grid: Grid) -> DataFrame:
    g = _window_stats(m, grid, window)
    return _out(g, grid, F.col("__min"))


def changes(m: DataFrame, window, grid: Grid) -> DataFrame:
    """Number of value changes between consecutive samples inside the window."""
    g = _window_stats(m, grid, window)
    return _out(g, grid, F.col("__changes").cast("double"))


def instant(m: DataFrame, grid: Grid, lookback="5m", offset=0) -> DataFrame:
    """Latest sample in ``[t - offset - lookback, t - offset]`` per series and step."""
    d = entries(m).withColumn("__t", grid.offset_us(F.col("ts")))
    d = _assign_steps(d, grid, seconds(lookback), seconds(offset))
    g = d.groupBy("series_key", "name", "__e", "__k").agg(F.max_by("value", "__t").alias("__v"))
    return _out(g, grid, F.col("__v"))
