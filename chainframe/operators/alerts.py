"""Alert lifecycle as Spark jobs: rule evaluation, ``for`` state machine, templating,
severity routing and digests.

* ``evaluate``: every rule's expression is a DataFrame function (no expression parser); the
  active samples of all rules are one union.
* ``alert_states``: inactive → pending → firing → resolved with gaps-and-islands computed
  without a per-series window: an island starts at an active step whose previous step is not
  active (anti-join on (rule, series, k-1)); each active step finds its island start with the
  skew-safe as-of join; ``resolved`` is emitted at the first inactive step after a firing one.
* ``render``: ``{{ $labels.x }}``, ``{{ $value }}`` and ``printf "%.Nf"`` compile to
  ``concat``/``format_string`` columns (missing label → '').
* ``route``: child routes all ``continue``, so an alert goes to every route whose anchored
  regex matches; none → the default receiver. A projection, no join.
* ``digest``: per receiver and step, firing/resolved counts and the labels common to all.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainframe.operators.metrics.ranges import Grid
from chainframe.operators.metrics.shared import Vectors
from chainframe.operators.windows import asof_join
from chainframe.session import stored
from chainframe.sources.ingest import series_key


@dataclass(frozen=True)
class Rule:
    name: str
    expr: Callable  # (metrics DataFrame or Vectors, Grid, SparkSession) -> instant vector DataFrame
    for_seconds: int = 0
    labels: dict = field(default_factory=dict)
    annotations: dict = field(default_factory=dict)
    group: str = ""
    line: int = 0

    @property
    def rule_id(self) -> str:
        """Rule identity is (group file, line): two rules may share a name."""
        return f"{self.group}:{self.line}:{self.name}"


def evaluate(rules: list[Rule], metrics: DataFrame, grid: Grid, spark) -> DataFrame:
    """Active samples of all rules: rule_id, alertname, labels, series_key, eval_ts, value,
    for_seconds. They are stored once, so that what follows does not evaluate the rules again."""
    out = None
    for r in rules:
        v = r.expr(metrics, grid, spark)
        extra = {"alertname": r.name, **r.labels}
        lab = F.map_concat(F.map_filter(F.col("labels"), lambda k, x: ~k.isin(*extra.keys())),
                           F.create_map(*[x for k, val in extra.items() for x in (F.lit(k), F.lit(val))]))
        a = v.select(F.lit(r.rule_id).alias("rule_id"), F.lit(r.name).alias("alertname"), lab.alias("labels"),
                     "eval_ts", "value", F.lit(r.for_seconds).alias("for_seconds"))
        a = a.withColumn("series_key", series_key(F.lit(r.name), F.col("labels")))
        out = a if out is None else out.unionByName(a)
    return stored(out, "active-alerts")


def evaluate_shared(rules: list[Rule], metrics: DataFrame, grid: Grid, spark) -> DataFrame:
    """``evaluate`` for rules whose expressions take ``Vectors``: what they read is computed once for
    all of them, from one scan of the metrics."""
    vectors = Vectors(metrics, grid)
    for r in rules:
        r.expr(vectors, grid, spark)  # notes what the rule reads
    return evaluate(rules, vectors.prepare(), grid, spark)


def alert_states(active: DataFrame, grid: Grid) -> DataFrame:
    """L2: per (rule, series, step): ``pending``/``firing`` while active and ``resolved`` at
    the first inactive step after firing. Columns: rule_id, series_key, eval_ts, state,
    active_since, value, labels."""
    step = F.lit(grid.step)
    keys = ["rule_id", "series_key"]
    a = active.select(*keys, "eval_ts", "value", "labels", "for_seconds")
    prev = a.select(*keys, F.timestamp_add("SECOND", step, F.col("eval_ts")).alias("eval_ts"))
    starts = a.join(prev, [*keys, "eval_ts"], "left_anti").select(*keys, F.col("eval_ts").alias("start_ts"))
    with_since = asof_join(a, starts, keys, "eval_ts", "start_ts", ["start_ts"], bucket_seconds=86400)
    held = F.timestamp_diff("SECOND", F.col("start_ts"), F.col("eval_ts"))
    states = with_since.select(*keys, "eval_ts", F.when(held >= F.col("for_seconds"), "firing").otherwise("pending").alias("state"),
                               F.col("start_ts").alias("active_since"), "value", "labels")
    firing = states.filter(F.col("state") == "firing")
    nxt = firing.select(*keys, F.timestamp_add("SECOND", step, F.col("eval_ts")).alias("eval_ts"), "active_since", "value", "labels")
    resolved = nxt.join(a.select(*keys, "eval_ts"), [*keys, "eval_ts"], "left_anti") \
        .filter(F.col("eval_ts") <= grid.ts_of(F.lit(grid.n))) \
        .select(*keys, "eval_ts", F.lit("resolved").alias("state"), "active_since", "value", "labels")
    return states.unionByName(resolved)


_TPL = re.compile(r"\{\{\s*(.*?)\s*\}\}")


def compile_template(tpl: str) -> Column:
    """Go-template subset → Column over ``labels`` and ``value``."""
    parts: list[Column] = []
    pos = 0
    for m in _TPL.finditer(tpl):
        if m.start() > pos:
            parts.append(F.lit(tpl[pos:m.start()]))
        expr = m.group(1)
        lab = re.fullmatch(r"\$labels\.([A-Za-z_][A-Za-z0-9_]*)", expr)
        fmt = re.fullmatch(r'(?:\$value\s*\|\s*printf\s+"(%[^"]+)"|printf\s+"(%[^"]+)"\s+\$value)', expr)
        if lab:
            parts.append(F.coalesce(F.col("labels")[lab.group(1)], F.lit("")))
        elif expr == "$value":
            parts.append(F.col("value").cast("string"))
        elif fmt:
            parts.append(F.format_string(fmt.group(1) or fmt.group(2), F.col("value")))
        else:
            raise ValueError(f"unsupported template expression: {expr}")
        pos = m.end()
    if pos < len(tpl):
        parts.append(F.lit(tpl[pos:]))
    return F.concat(*parts) if parts else F.lit("")


def render(states: DataFrame, annotations: dict[str, str]) -> DataFrame:
    """L3: annotation columns from templates."""
    return states.select("*", *[compile_template(t).alias(k) for k, t in annotations.items()])


# fixed values: alert routing (severity regex, receiver; every child route continues)
ROUTES = (("none", "slack_none"), ("info", "slack"), ("warning|error", "slack_warning"), ("critical", "slack_critical"))
DEFAULT_RECEIVER = "slack"


def route(states: DataFrame, routes=ROUTES, default: str = DEFAULT_RECEIVER, label: str = "severity") -> DataFrame:
    """L4: one row per (alert, receiver)."""
    sev = F.coalesce(F.col("labels")[label], F.lit(""))
    hits = F.filter(F.array(*[F.when(sev.rlike(f"^(?:{rx})$"), F.lit(recv)) for rx, recv in routes]), lambda x: x.isNotNull())
    recv = F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(default)))
    return states.withColumn("receiver", F.explode(recv))


def digest(routed: DataFrame) -> DataFrame:
    """Per (receiver, step): firing and resolved counts and the common label set
    (pairs present in every alert of the group), computed by counting, not collecting."""
    g = routed.groupBy("receiver", "eval_ts").agg(
        F.count_if(F.col("state") == "firing").alias("firing"),
        F.count_if(F.col("state") == "resolved").alias("resolved"),
        F.count(F.lit(1)).alias("__n"))
    pairs = routed.select("receiver", "eval_ts", F.explode("labels").alias("k", "v")) \
        .groupBy("receiver", "eval_ts", "k", "v").agg(F.count(F.lit(1)).alias("__c"))
    common = pairs.join(g.select("receiver", "eval_ts", "__n"), ["receiver", "eval_ts"]) \
        .filter(F.col("__c") == F.col("__n")) \
        .groupBy("receiver", "eval_ts").agg(F.array_join(F.array_sort(F.collect_list(F.concat("k", F.lit("="), "v"))), ",")
                                            .alias("common_labels"))
    return g.drop("__n").join(common, ["receiver", "eval_ts"], "left")
