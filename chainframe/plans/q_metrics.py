"""Metric (PromQL-function) queries on the driver-derived counter and gauge series.

Grid: whole days that cover the events, step 5 minutes; range windows 1 hour (the fixture has
~14 samples per hour in total). Oracles use a brute-force range join of the grid with the
samples, i.e. a different algorithm from the Spark plan.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from chainframe.operators import metrics as M
from chainframe.operators.metrics import vector as V
from chainframe.plans.registry import query
from chainframe.sources import fixtures as FX
from chainframe.sources.ingest import metrics_frame

STEP = 300
W = 3600


def grid(spark, sf_dir) -> M.Grid:
    """Whole days that cover the events, in steps of 5 minutes (one row from the table)."""
    lo, hi = FX.load_base(spark, sf_dir, "events").agg(
        F.date_trunc("day", F.min("ts")).cast("timestamp_ntz"), F.date_trunc("day", F.max("ts")).cast("timestamp_ntz")).first()
    if lo is None:
        lo = hi = datetime(1970, 1, 1)
    return M.Grid(lo, hi + timedelta(days=1), STEP)


def samples(spark, sf_dir, name: str):
    return metrics_frame(FX.load(spark, sf_dir, name), F.col("name"), ["job", "instance"], "ts", "value")


def out(v, labels=("job", "instance")):
    return v.select(*[F.col("labels")[l].alias(l) for l in labels], "eval_ts", F.round("value", 6).alias("value"))


GRID_SQL = f"""SELECT k, t0 + to_seconds(k * {STEP}) AS t FROM (SELECT t0, unnest(range(0, n + 1)) AS k FROM (
  SELECT date_trunc('day', min(ts)) AS t0,
    date_diff('second', date_trunc('day', min(ts)), date_trunc('day', max(ts)) + INTERVAL 1 DAY) // {STEP} AS n FROM events))"""


def stats_sql(table: str, window: int, where: str = "true") -> str:
    """CTE text: per (job, instance, step) window statistics by brute-force range join."""
    return f"""s0 AS (SELECT name, job, instance, ts, CAST(value AS DOUBLE) AS value FROM {table} WHERE {where}),
s1 AS (SELECT *, lag(value) OVER w AS pv, lag(ts) OVER w AS pts FROM s0
       WINDOW w AS (PARTITION BY job, instance ORDER BY ts, value)),
s2 AS (SELECT *, CASE WHEN pv IS NULL THEN 0 WHEN value >= pv THEN value - pv ELSE value END AS inc,
         CASE WHEN pv IS NULL THEN 0 WHEN value <> pv THEN 1 ELSE 0 END AS chg FROM s1),
g AS ({GRID_SQL}),
j AS (SELECT g.k, g.t, s2.*, date_diff('microsecond', g.t, s2.ts) / 1e6 AS x FROM g JOIN s2
      ON s2.ts >= g.t - to_seconds({window}) AND s2.ts <= g.t),
a AS (SELECT job, instance, t, count(*) AS n, min(x) AS x1, max(x) AS xn, arg_min(value, ts) AS v1,
   sum(inc) - arg_min(inc, ts) AS res, sum(chg) - arg_min(chg, ts) AS chs, avg(value) AS av, max(value) AS mx,
   min(value) AS mn, regr_slope(value, x) AS slope, regr_intercept(value, x) AS icpt,
   arg_max(value, ts) AS lv, arg_max(pv, ts) AS lpv, arg_max(date_diff('microsecond', pts, ts) / 1e6, ts) AS ldt
   FROM j GROUP BY job, instance, t)"""


def extrapolated_sql(window: int, is_rate: bool) -> str:
    samp = "(xn - x1)"
    avg = f"({samp} / (n - 1))"
    start = f"(CASE WHEN res > 0 AND v1 >= 0 AND {samp} * (v1 / res) < (x1 + {window}) THEN {samp} * (v1 / res) ELSE (x1 + {window}) END)"
    ext = (f"({samp} + CASE WHEN {start} < {avg} * 1.1 THEN {start} ELSE {avg} / 2 END"
           f" + CASE WHEN -xn < {avg} * 1.1 THEN -xn ELSE {avg} / 2 END)")
    e = f"res * {ext} / {samp}"
    return f"({e}) / {window}" if is_rate else e


def _significant(c, digits: int):
    """``c`` at so many significant digits."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c * scale) / scale)


def range_query(name, fixture, fn, sql_value, cond="true", window=W, significant=None):
    """Both engines round the double result: to 6 decimals, or to ``significant`` digits where
    two regression implementations differ past them."""
    rounded = f"round({sql_value}, 6)"
    if significant:
        scale = f"pow(10.0, {significant - 1} - floor(log10(abs({sql_value}))))"
        rounded = f"CASE WHEN {sql_value} = 0 THEN 0.0 ELSE round(({sql_value}) * {scale}) / {scale} END"

    @query(name, f"""WITH {stats_sql(fixture, window)}
SELECT job, instance, t AS eval_ts, {rounded} AS value FROM a WHERE {cond}""", (fixture,))
    def _q(spark, sf_dir):
        v = fn(samples(spark, sf_dir, fixture), grid(spark, sf_dir))
        value = _significant(F.col("value"), significant) if significant else F.round("value", 6)
        return v.select(F.col("labels")["job"].alias("job"), F.col("labels")["instance"].alias("instance"), "eval_ts",
                        value.alias("value"))
    _q.__doc__ = f"{name} over {fixture} (1h window, 5m grid)."
    return _q


range_query("rate", "metric_counter", lambda m, g: M.rate(m, "1h", g), extrapolated_sql(W, True), "n >= 2")
range_query("increase", "metric_counter", lambda m, g: M.increase(m, "1h", g), extrapolated_sql(W, False), "n >= 2")
range_query("irate", "metric_counter", lambda m, g: M.irate(m, "1h", g),
            "(CASE WHEN lv < lpv THEN lv ELSE lv - lpv END) / ldt", "n >= 2")
range_query("deriv", "metric_gauge", lambda m, g: M.deriv(m, "1h", g), "slope", "n >= 2")
range_query("predict_linear", "metric_gauge", lambda m, g: M.predict_linear(m, "1h", "4h", g),
            "(icpt + slope * 14400)", "n >= 2", significant=8)
range_query("avg_over_time", "metric_gauge", lambda m, g: M.avg_over_time(m, "1h", g), "av")
range_query("max_over_time", "metric_gauge", lambda m, g: M.max_over_time(m, "1h", g), "mx")
range_query("min_over_time", "metric_gauge", lambda m, g: M.min_over_time(m, "1h", g), "mn")
range_query("changes", "metric_gauge", lambda m, g: M.changes(m, "1h", g), "CAST(chs AS DOUBLE)")


def instant_sql(table: str, offset: int = 0, lookback: int = 300, where: str = "true", alias: str = "i") -> str:
    return f"""{alias} AS (SELECT s.job, s.instance, g.t, arg_max(CAST(s.value AS DOUBLE), s.ts) AS value
  FROM ({GRID_SQL}) g JOIN (SELECT * FROM {table} WHERE {where}) s
  ON s.ts >= g.t - to_seconds({offset + lookback}) AND s.ts <= g.t - to_seconds({offset})
  GROUP BY s.job, s.instance, g.t)"""


@query("instant", f"WITH {instant_sql('metric_gauge')} SELECT job, instance, t AS eval_ts, round(value, 6) AS value FROM i",
       ("metric_gauge",))
def instant(spark, sf_dir):
    """Instant selector with 5-minute lookback on the 5-minute grid."""
    return out(M.instant(samples(spark, sf_dir, "metric_gauge"), grid(spark, sf_dir)))


# one series per setting; its value changes now and then
FX.register("metric_settings", ("events",), """
SELECT 'pg_settings_' || event_type AS name, 'db0' AS instance, ts, CAST(user_id % 3 AS BIGINT) AS value FROM {events}""")


def _settings_sql(offset: int, alias: str) -> str:
    return f"""{alias} AS (SELECT s.name, s.instance, g.t, arg_max(CAST(s.value AS DOUBLE), s.ts) AS value
  FROM ({GRID_SQL}) g JOIN (SELECT * FROM metric_settings WHERE regexp_full_match(name, 'pg_settings_.*')) s
  ON s.ts >= g.t - to_seconds({offset + 300}) AND s.ts <= g.t - to_seconds({offset}) GROUP BY s.name, s.instance, g.t)"""


@query("config_changed", f"""WITH {_settings_sql(0, 'i')}, {_settings_sql(300, 'o')}
SELECT i.name, i.instance, i.t AS eval_ts, round(i.value, 6) AS value FROM i JOIN o
ON i.name = o.name AND i.t = o.t WHERE i.value <> o.value""", ("metric_settings",))
def config_changed(spark, sf_dir):
    """``{__name__=~"pg_settings_.*"} != on(__name__) {...} offset 5m`` (current value kept)."""
    m = metrics_frame(FX.load(spark, sf_dir, "metric_settings"), F.col("name"), ["instance"], "ts", "value")
    m = M.select(m, name_regex="pg_settings_.*")
    v = V.binary_op(M.instant(m, grid(spark, sf_dir)), M.instant(m, grid(spark, sf_dir), offset="5m"), "!=", on=["__name__"])
    return v.select("name", F.col("labels")["instance"].alias("instance"), "eval_ts", F.round("value", 6).alias("value"))


@query("label_replace", f"""WITH {instant_sql('metric_gauge')}
SELECT job, instance, 's-' || instance AS shard, t AS eval_ts, round(value, 6) AS value FROM i""", ("metric_gauge",))
def label_replace(spark, sf_dir):
    """``label_replace(v, "shard", "s-$1", "instance", "(\\d+)")``."""
    v = V.label_replace(M.instant(samples(spark, sf_dir, "metric_gauge"), grid(spark, sf_dir)), "shard", "s-$1", "instance", r"(\d+)")
    return out(v, ("job", "instance", "shard"))


_RATE_CTE = f"""r AS (SELECT job, instance, t, {extrapolated_sql(W, True)} AS value FROM a WHERE n >= 2)"""


@query("vector_ratio", f"""WITH {stats_sql('metric_counter', W)}, {_RATE_CTE}, {instant_sql('metric_gauge')}
SELECT i.job, i.instance, i.t AS eval_ts,
  round(CASE WHEN r.value <> 0 THEN i.value / r.value WHEN i.value > 0 THEN 'inf'::DOUBLE
             WHEN i.value < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END, 6) AS value
FROM i JOIN r ON i.job = r.job AND i.instance = r.instance AND i.t = r.t""", ("metric_counter", "metric_gauge"))
def vector_ratio(spark, sf_dir):
    """One-to-one ``gauge / rate(counter[1h])`` on identical label sets."""
    g = M.instant(samples(spark, sf_dir, "metric_gauge"), grid(spark, sf_dir))
    r = M.rate(samples(spark, sf_dir, "metric_counter"), "1h", grid(spark, sf_dir))
    return out(V.binary_op(g, r, "/"))


@query("vector_and", f"""WITH {stats_sql('metric_counter', W)}, {_RATE_CTE}, {instant_sql('metric_gauge')}
SELECT i.job, i.instance, i.t AS eval_ts, round(i.value, 6) AS value FROM i
WHERE i.value > 1000 AND EXISTS (SELECT 1 FROM r WHERE r.job = i.job AND r.instance = i.instance AND r.t = i.t AND r.value > 0)""",
       ("metric_counter", "metric_gauge"))
def vector_and(spark, sf_dir):
    """``gauge > 1000 and rate(counter[1h]) > 0``."""
    g = V.compare(M.instant(samples(spark, sf_dir, "metric_gauge"), grid(spark, sf_dir)), ">", 1000)
    r = V.compare(M.rate(samples(spark, sf_dir, "metric_counter"), "1h", grid(spark, sf_dir)), ">", 0)
    return out(V.vector_and(g, r))


@query("vector_or", f"""WITH {stats_sql('metric_counter', W)}, {_RATE_CTE}, {instant_sql('metric_gauge')},
l AS (SELECT job, instance, t, value FROM i WHERE value < 100),
rr AS (SELECT job, instance, t, value FROM r WHERE value < 0.05)
SELECT job, instance, t AS eval_ts, round(value, 6) AS value FROM l
UNION ALL SELECT job, instance, t, round(value, 6) FROM rr
WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.job = rr.job AND l.instance = rr.instance AND l.t = rr.t)""",
       ("metric_counter", "metric_gauge"))
def vector_or(spark, sf_dir):
    """``gauge < 100 or rate(counter[1h]) < 0.05`` (name dropped on the rate side)."""
    g = V.compare(M.instant(samples(spark, sf_dir, "metric_gauge"), grid(spark, sf_dir)), "<", 100)
    r = V.compare(M.rate(samples(spark, sf_dir, "metric_counter"), "1h", grid(spark, sf_dir)), "<", 0.05)
    return out(V.vector_or(g, r))


@query("sum_by", f"""WITH {instant_sql('metric_gauge')}
SELECT job, t AS eval_ts, round(sum(value), 6) AS value FROM i GROUP BY job, t""", ("metric_gauge",))
def sum_by(spark, sf_dir):
    """``sum by (job) (gauge)``."""
    return out(V.aggregate(M.instant(samples(spark, sf_dir, "metric_gauge"), grid(spark, sf_dir)), "sum", ["job"]), ("job",))


@query("avg_by", f"""WITH {stats_sql('metric_counter', W)}, {_RATE_CTE}
SELECT job, t AS eval_ts, round(avg(value), 6) AS value FROM r GROUP BY job, t""", ("metric_counter",))
def avg_by(spark, sf_dir):
    """``avg by (job) (rate(counter[1h]))``."""
    return out(V.aggregate(M.rate(samples(spark, sf_dir, "metric_counter"), "1h", grid(spark, sf_dir)), "avg", ["job"]), ("job",))


@query("count_by", f"""WITH {instant_sql('metric_gauge')}
SELECT job, t AS eval_ts, round(CAST(count(*) AS DOUBLE), 6) AS value FROM i GROUP BY job, t""", ("metric_gauge",))
def count_by(spark, sf_dir):
    """``count by (job) (gauge)``."""
    return out(V.aggregate(M.instant(samples(spark, sf_dir, "metric_gauge"), grid(spark, sf_dir)), "count", ["job"]), ("job",))


@query("count_values", f"""WITH {stats_sql('metric_gauge', W)}
SELECT CAST(chs AS VARCHAR) AS changes, t AS eval_ts, round(CAST(count(*) AS DOUBLE), 6) AS value FROM a GROUP BY chs, t""",
       ("metric_gauge",))
def count_values(spark, sf_dir):
    """``count_values("changes", changes(gauge[1h]))``."""
    v = V.count_values(M.changes(samples(spark, sf_dir, "metric_gauge"), "1h", grid(spark, sf_dir)), "changes")
    return out(v, ("changes",))


@query("absent", f"""WITH {instant_sql('metric_gauge', where="job = 'signup'")}
SELECT 'signup' AS job, g.t AS eval_ts, CAST(1 AS DOUBLE) AS value FROM ({GRID_SQL}) g WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.t = g.t)""",
       ("metric_gauge",))
def absent(spark, sf_dir):
    """``absent(queue_length{job="signup"})`` — steps with no sample in the lookback."""
    v = M.instant(M.select(samples(spark, sf_dir, "metric_gauge"), "queue_length", [("job", "=", "signup")]), grid(spark, sf_dir))
    return out(V.absent(v, grid(spark, sf_dir), spark, {"job": "signup"}), ("job",))


@query("label_match", """
SELECT job, instance, ts, CAST(value AS DOUBLE) AS value FROM metric_gauge
WHERE regexp_full_match(job, 'sign.*|error') AND instance <> '0' AND NOT regexp_full_match(instance, '3')""", ("metric_gauge",))
def label_match(spark, sf_dir):
    """``queue_length{job=~"sign.*|error", instance!="0", instance!~"3"}``."""
    m = M.select(samples(spark, sf_dir, "metric_gauge"), "queue_length",
                 [("job", "=~", "sign.*|error"), ("instance", "!=", "0"), ("instance", "!~", "3")])
    return m.select(F.col("labels")["job"].alias("job"), F.col("labels")["instance"].alias("instance"), "ts", "value")


@query("name_regex", """
SELECT name, CAST(count(*) AS BIGINT) AS samples FROM (SELECT name FROM metric_gauge UNION ALL SELECT name FROM metric_counter)
WHERE regexp_full_match(name, 'queue_.*|requests_t.*') GROUP BY name""", ("metric_gauge", "metric_counter"))
def name_regex(spark, sf_dir):
    """``{__name__=~"queue_.*|requests_t.*"}`` over the union of metric tables."""
    m = samples(spark, sf_dir, "metric_gauge").unionByName(samples(spark, sf_dir, "metric_counter"))
    return M.select(m, name_regex="queue_.*|requests_t.*").groupBy("name").agg(F.count(F.lit(1)).alias("samples"))


@query("record_ratio", f"""WITH {stats_sql('metric_counter', W)}, {_RATE_CTE}
SELECT 'job:requests:rate1h' AS name, job, t AS ts, round(sum(value), 6) AS value FROM r GROUP BY job, t""", ("metric_counter",))
def record_ratio(spark, sf_dir):
    """Recording rule ``job:requests:rate1h = sum by (job) (rate(requests_total[1h]))``."""
    v = V.record(V.aggregate(M.rate(samples(spark, sf_dir, "metric_counter"), "1h", grid(spark, sf_dir)), "sum", ["job"]), "job:requests:rate1h")
    return v.select("name", F.col("labels")["job"].alias("job"), "ts", F.round("value", 6).alias("value"))


@query("net_saturation", f"""WITH {stats_sql('metric_counter', W)}, {_RATE_CTE}
SELECT job, instance, t AS eval_ts, round(value, 6) AS value FROM r WHERE value > 0.8 AND value < 10000""", ("metric_counter",))
def net_saturation(spark, sf_dir):
    """Chained comparison ``rate(counter[1h]) > 0.8 < 10000``."""
    r = M.rate(samples(spark, sf_dir, "metric_counter"), "1h", grid(spark, sf_dir))
    return out(V.compare(V.compare(r, ">", 0.8), "<", 10000))


@query("dead_tuple_ratio", f"""WITH {stats_sql('metric_counter', W)}, {_RATE_CTE}, {instant_sql('metric_gauge')}
SELECT i.job, i.instance, i.t AS eval_ts,
  round(CASE WHEN r.value <> 0 THEN i.value / r.value WHEN i.value > 0 THEN 'inf'::DOUBLE
             WHEN i.value < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END, 6) AS value
FROM i JOIN r ON i.job = r.job AND i.instance = r.instance AND i.t = r.t WHERE i.value > 3000""",
       ("metric_counter", "metric_gauge"))
def dead_tuple_ratio(spark, sf_dir):
    """A filter inside arithmetic: ``(gauge > 3000) / rate(counter[1h])``."""
    g = V.compare(M.instant(samples(spark, sf_dir, "metric_gauge"), grid(spark, sf_dir)), ">", 3000)
    return out(V.binary_op(g, M.rate(samples(spark, sf_dir, "metric_counter"), "1h", grid(spark, sf_dir)), "/"))


# a counter that only every third user moves, so that it stalls now and then
FX.register("metric_dump", ("events",), """
SELECT 'chain_dump_lag' AS name, event_type AS job, CAST(user_id % 4 AS STRING) AS instance, ts,
  CAST(sum(CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END) OVER (
    PARTITION BY event_type, user_id % 4, CAST(ts AS DATE) ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS value
FROM {events}""")


@query("dump_stalled", f"""WITH {stats_sql('metric_dump', W)}, {_RATE_CTE}, {instant_sql('metric_dump', where="job <> 'signup'")},
l AS (SELECT i.job, i.instance, i.t, i.value FROM i WHERE EXISTS (
        SELECT 1 FROM r WHERE r.job = i.job AND r.instance = i.instance AND r.t = i.t AND r.job <> 'signup' AND r.value <= 0)),
rr AS (SELECT job, instance, t, value FROM r WHERE job = 'signup' AND value <= 0)
SELECT job, instance, t AS eval_ts, round(value, 6) AS value FROM l
UNION ALL SELECT job, instance, t, round(value, 6) FROM rr
WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.job = rr.job AND l.instance = rr.instance AND l.t = rr.t)""", ("metric_dump",))
def dump_stalled(spark, sf_dir):
    """P20: ``x{job!="signup"} and rate(x{job!="signup"}[1h]) <= 0 or rate(x{job="signup"}[1h]) <= 0``
    (``and`` binds tighter than ``or``)."""
    m = samples(spark, sf_dir, "metric_dump")
    not_signup = M.select(m, "chain_dump_lag", [("job", "!=", "signup")])
    signup = M.select(m, "chain_dump_lag", [("job", "=", "signup")])
    left = V.vector_and(M.instant(not_signup, grid(spark, sf_dir)), V.compare(M.rate(not_signup, "1h", grid(spark, sf_dir)), "<=", 0))
    return out(V.vector_or(left, V.compare(M.rate(signup, "1h", grid(spark, sf_dir)), "<=", 0)))


@query("metric_age", f"""WITH {instant_sql('metric_gauge')}
SELECT job, instance, t AS eval_ts,
  round(CAST(date_diff('second', TIMESTAMP '1970-01-01', t) AS DOUBLE) - value, 6) AS value FROM i""", ("metric_gauge",))
def metric_age(spark, sf_dir):
    """``time() - x``."""
    return out(V.time_minus(M.instant(samples(spark, sf_dir, "metric_gauge"), grid(spark, sf_dir))))


@query("metric_retention", """
SELECT job, instance, ts, CAST(value AS DOUBLE) AS value FROM metric_gauge
WHERE time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') + INTERVAL '1 day' > TIMESTAMP '2024-02-15 12:30:00' - INTERVAL '30 days'""",
       ("metric_gauge",))
def metric_retention(spark, sf_dir):
    """Metric samples kept for 30 days in day chunks, at now = 2024-02-15 12:30."""
    from chainframe.sources import layout as LY
    from chainframe.sources import schemas as S

    m = LY.retain(samples(spark, sf_dir, "metric_gauge"), "2024-02-15 12:30:00", S.RETAIN_FOR["metrics"]["samples"], ts="ts", interval="1 day")
    return m.select(F.col("labels")["job"].alias("job"), F.col("labels")["instance"].alias("instance"), "ts", "value")


@query("chain_lag", f"""
WITH h AS (SELECT block_timestamp AS ts FROM txs_a),
g AS ({GRID_SQL})
SELECT g.t AS eval_ts, round(CAST(date_diff('second', TIMESTAMP '1970-01-01', g.t) AS DOUBLE)
  - max(CAST(date_diff('second', TIMESTAMP '1970-01-01', h.ts) AS DOUBLE)), 6) AS value
FROM g JOIN h ON h.ts >= g.t - to_seconds(3600) AND h.ts <= g.t GROUP BY g.t""", ("txs_a",))
def chain_lag(spark, sf_dir):
    """Dump freshness — ``time() - max_over_time(chain_head_timestamp[1h])`` per step."""
    t = FX.load(spark, sf_dir, "txs_a")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    head = t.select(F.col("block_timestamp").alias("ts"),
                    F.timestamp_diff("SECOND", epoch, F.col("block_timestamp")).cast("double").alias("v"))
    m = metrics_frame(head, "chain_head_timestamp", [], "ts", "v")
    mx = M.max_over_time(m, "1h", grid(spark, sf_dir))
    now = F.timestamp_diff("SECOND", epoch, F.col("eval_ts")).cast("double")
    return mx.select("eval_ts", F.round(now - F.col("value"), 6).alias("value"))
