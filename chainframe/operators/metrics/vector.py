"""Instant-vector operations: binary operators with label matching, set operators,
aggregations, ``count_values``, ``absent``, ``label_replace`` and recording rules.

Frames are ``name, labels, series_key, eval_ts, value``. Matching joins are equi-joins on
(serialised label subset, eval_ts): hash-partitioned, no per-series task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainframe.operators.metrics.ranges import Grid
from chainframe.sources.ingest import series_key


def _label_key(labels: Column, on: list[str] | None = None, ignoring: list[str] | None = None) -> Column:
    """The part of a series that must be equal; ``__name__`` in ``on`` stands for the metric name."""
    name = F.lit("")
    if on is not None:
        names = [k for k in on if k != "__name__"]
        if len(names) < len(on):
            name = F.col("name")
        kept = F.map_filter(labels, lambda k, v: k.isin(*names) if names else F.lit(False))
    elif ignoring:
        kept = F.map_filter(labels, lambda k, v: ~k.isin(*ignoring))
    else:
        kept = labels
    return series_key(name, kept)


def _one_to_one(v: DataFrame, side: str) -> DataFrame:
    """``v`` (with match key ``__mk``); an error if two of its series share a key at a step."""
    many = F.count(F.lit(1)).over(Window.partitionBy("__mk", "eval_ts")) > 1
    text = F.concat(F.lit(f"many-to-many matching: duplicate series on the {side} side for "), F.col("__mk"))
    return v.withColumn("__mk", F.when(many, F.raise_error(text).cast("string")).otherwise(F.col("__mk")))


def _kept_labels(labels: Column, on: list[str] | None) -> Column:
    return F.map_filter(labels, lambda k, v: k.isin(*on)) if on is not None else labels


def safe_div(a: Column, b: Column) -> Column:
    """IEEE division (x/0 = ±Inf, 0/0 = NaN) without tripping ANSI divide-by-zero."""
    inf = F.lit(float("inf"))
    return (F.when(b != 0, a / b)
            .when(a > 0, inf).when(a < 0, -inf).otherwise(F.lit(float("nan"))))


_ARITH = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": safe_div}
_CMP = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b,
        "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def binary_op(left: DataFrame, right: DataFrame, op: str, on: list[str] | None = None,
              ignoring: list[str] | None = None) -> DataFrame:
    """One-to-one vector arithmetic or comparison on identical label sets (or ``on``/
    ``ignoring`` subsets, ``__name__`` included). Several series of one side with the same
    match key are an error. Arithmetic drops the metric name; a comparison filters and keeps
    the left sample."""
    l = left.select("name", "labels", "series_key", "eval_ts", "value",
                    _label_key(F.col("labels"), on, ignoring).alias("__mk"))
    r = right.select(_label_key(F.col("labels"), on, ignoring).alias("__mk"), "eval_ts", "value")
    if on is not None or ignoring:  # whole label sets are unique as they are
        l, r = _one_to_one(l, "left"), _one_to_one(r, "right")
    r = r.select("__mk", F.col("eval_ts").alias("__rt"), F.col("value").alias("__rv"))
    j = l.join(r, (l["__mk"] == r["__mk"]) & (l["eval_ts"] == r["__rt"]), "inner")
    if op in _CMP:
        return j.filter(_CMP[op](F.col("value"), F.col("__rv"))).select("name", "labels", "series_key", "eval_ts", "value")
    labels = _kept_labels(F.col("labels"), on)
    val = _ARITH[op](F.col("value"), F.col("__rv"))
    return j.select(F.lit("").alias("name"), labels.alias("labels"), series_key(F.lit(""), labels).alias("series_key"),
                    "eval_ts", val.alias("value"))


def scalar_op(v: DataFrame, op: str, scalar: float, scalar_left: bool = False) -> DataFrame:
    """Vector ∘ scalar arithmetic (name dropped) or comparison filter."""
    s = F.lit(float(scalar))
    if op in _CMP:
        a, b = (s, F.col("value")) if scalar_left else (F.col("value"), s)
        return v.filter(_CMP[op](a, b))
    a, b = (s, F.col("value")) if scalar_left else (F.col("value"), s)
    return v.select(F.lit("").alias("name"), "labels", series_key(F.lit(""), F.col("labels")).alias("series_key"),
                    "eval_ts", _ARITH[op](a, b).alias("value"))


def compare(v: DataFrame, op: str, scalar: float) -> DataFrame:
    return scalar_op(v, op, scalar)


def vector_and(left: DataFrame, right: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Left samples whose label set (or ``on`` subset) has a right sample at that step."""
    l = left.withColumn("__mk", _label_key(F.col("labels"), on))
    r = right.select(_label_key(F.col("labels"), on).alias("__mk"), F.col("eval_ts"))
    return l.join(r, ["__mk", "eval_ts"], "left_semi").drop("__mk")


def vector_or(left: DataFrame, right: DataFrame) -> DataFrame:
    """All left samples plus right samples whose label set is absent on the left."""
    l = left.withColumn("__mk", _label_key(F.col("labels")))
    r = right.withColumn("__mk", _label_key(F.col("labels")))
    extra = r.join(l.select("__mk", "eval_ts"), ["__mk", "eval_ts"], "left_anti")
    return l.unionByName(extra).drop("__mk")


def time_minus(v: DataFrame) -> DataFrame:
    """``time() - v``: the eval instant in epoch seconds minus the sample value."""
    now = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("eval_ts")).cast("double")
    return v.select(F.lit("").alias("name"), "labels", series_key(F.lit(""), F.col("labels")).alias("series_key"),
                    "eval_ts", (now - F.col("value")).alias("value"))


_AGG = {"sum": F.sum, "avg": F.avg, "count": lambda c: F.count(c).cast("double"), "max": F.max, "min": F.min}


def aggregate(v: DataFrame, fn: str, by: list[str] = ()) -> DataFrame:
    """``fn by (labels)`` per eval step (algebraic, combined map-side)."""
    by = list(by)
    g = v.groupBy(*[F.coalesce(F.col("labels")[b], F.lit("")).alias(b) for b in by], "eval_ts").agg(
        _AGG[fn](F.col("value")).alias("value"))
    pairs = []
    for b in by:
        pairs += [F.lit(b), F.col(b)]
    labels = F.map_filter(F.create_map(*pairs), lambda k, x: x != "") if by else F.create_map().cast("map<string,string>")
    return g.select(F.lit("").alias("name"), labels.alias("labels"), series_key(F.lit(""), labels).alias("series_key"),
                    "eval_ts", "value")


def format_value(c: Column) -> Column:
    """Sample value as text the way the metric engine prints it (integers without '.0')."""
    return F.when(F.isnan(c), F.lit("NaN")).when(c == F.floor(c), F.floor(c).cast("long").cast("string")) \
        .otherwise(c.cast("string"))


def count_values(v: DataFrame, label: str) -> DataFrame:
    """Number of samples per distinct value, the value becoming label ``label``."""
    g = v.groupBy(format_value(F.col("value")).alias("__val"), "eval_ts").agg(F.count(F.lit(1)).cast("double").alias("value"))
    labels = F.create_map(F.lit(label), F.col("__val"))
    return g.select(F.lit("").alias("name"), labels.alias("labels"), series_key(F.lit(""), labels).alias("series_key"),
                    "eval_ts", "value")


def absent(v: DataFrame, grid: Grid, spark, equal_labels: dict | None = None) -> DataFrame:
    """1 at every step where the selector has no sample; labels from ``=`` matchers."""
    present = v.select("eval_ts").distinct()
    missing = grid.frame(spark).join(present, "eval_ts", "left_anti")
    pairs = []
    for k, val in (equal_labels or {}).items():
        pairs += [F.lit(k), F.lit(val)]
    labels = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return missing.select(F.lit("").alias("name"), labels.alias("labels"), series_key(F.lit(""), labels).alias("series_key"),
                          "eval_ts", F.lit(1.0).alias("value"))


def label_replace(v: DataFrame, dst: str, replacement: str, src: str, regex: str) -> DataFrame:
    """If ``regex`` fully matches the source label (``__name__`` allowed), set ``dst``
    to the expanded replacement; an empty result removes ``dst``; otherwise unchanged."""
    anchored = f"^(?:{regex})$"
    src_val = F.col("name") if src == "__name__" else F.coalesce(F.col("labels")[src], F.lit(""))
    new = F.regexp_replace(src_val, anchored, replacement)
    matched = src_val.rlike(anchored)
    if dst == "__name__":
        name = F.when(matched, new).otherwise(F.col("name"))
        out = v.withColumn("name", name)
    else:
        rest = F.map_filter(F.col("labels"), lambda k, x: k != F.lit(dst))
        upd = F.when(new == "", rest).otherwise(F.map_concat(rest, F.create_map(F.lit(dst), new)))
        out = v.withColumn("labels", F.when(matched, upd).otherwise(F.col("labels")))
    return out.withColumn("series_key", series_key(F.col("name"), F.col("labels")))


def record(v: DataFrame, name: str, labels: dict | None = None) -> DataFrame:
    """A recording rule: the result gets metric name ``name`` (+ static labels) and
    can be appended to the samples table (``eval_ts`` becomes ``ts``)."""
    lab = F.col("labels")
    if labels:
        lab = F.map_concat(F.map_filter(lab, lambda k, x: ~k.isin(*labels.keys())),
                           F.create_map(*[x for k, val in labels.items() for x in (F.lit(k), F.lit(val))]))
    return v.select(F.lit(name).alias("name"), lab.alias("labels"), series_key(F.lit(name), lab).alias("series_key"),
                    F.col("eval_ts").alias("ts"), "value")
