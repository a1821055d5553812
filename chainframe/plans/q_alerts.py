"""Alert lifecycle queries (L1-L4, L6) over six rules on the fixture metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainframe.operators import alerts as AL
from chainframe.operators import metrics as M
from chainframe.operators import rules as RU
from chainframe.operators.metrics import vector as V
from chainframe.plans.q_metrics import GRID_SQL, STEP, W, extrapolated_sql, grid, instant_sql, samples, stats_sql
from chainframe.plans.registry import query
from chainframe.sources import fixtures as FX
from chainframe.sources.ingest import metrics_frame
from chainframe.session import stored


def _rules(queue=None, rate=None):
    """The rules over two vectors, each evaluated once whatever the number of rules on it."""
    return [
        AL.Rule("QueueHigh", lambda m, g, s: V.compare(queue, ">", 4000),
                for_seconds=900, labels={"severity": "warning"},
                annotations={"summary": 'Queue high on {{ $labels.job }}/{{ $labels.instance }} (value {{ $value | printf "%.2f" }})'},
                group="fixture", line=1),
        AL.Rule("RequestRateHigh", lambda m, g, s: V.compare(rate, ">", 2),
                for_seconds=600, labels={"severity": "critical"},
                annotations={"summary": "Request rate high for {{ $labels.job }} on {{ $labels.instance }}{{ $labels.missing }}"},
                group="fixture", line=2),
        AL.Rule("QueueEmptyPanic", lambda m, g, s: V.compare(queue, "<", 150),
                for_seconds=0, labels={"severity": "panic"}, group="fixture", line=3),
        AL.Rule("QueueLow", lambda m, g, s: V.compare(queue, "<", 300),
                for_seconds=0, labels={"severity": "info"}, group="fixture", line=4),
        AL.Rule("QueueNoted", lambda m, g, s: V.compare(queue, "<", 100),
                for_seconds=0, labels={"severity": "none"}, group="fixture", line=5),
        AL.Rule("QueueBroken", lambda m, g, s: V.compare(queue, ">", 4800),
                for_seconds=300, labels={"severity": "error"}, group="fixture", line=6),
    ]


_STATES_SQL = f"""isl AS (SELECT *, date_diff('second', TIMESTAMP '1970-01-01', t) // {STEP}
          - row_number() OVER (PARTITION BY rule_id, job, instance ORDER BY t) AS island FROM act),
sp AS (SELECT *, min(t) OVER (PARTITION BY rule_id, job, instance, island) AS since,
          max(t) OVER (PARTITION BY rule_id, job, instance, island) AS last_t FROM isl),
st AS (SELECT rule_id, alertname, severity, job, instance, t AS eval_ts,
          CASE WHEN date_diff('second', since, t) >= for_s THEN 'firing' ELSE 'pending' END AS state, since AS active_since, value FROM sp
       UNION ALL
       SELECT rule_id, alertname, severity, job, instance, t + to_seconds({STEP}), 'resolved', since, value FROM sp
       WHERE t = last_t AND date_diff('second', since, t) >= for_s AND t + to_seconds({STEP}) <= (SELECT max(t) FROM ({GRID_SQL})))"""

_ACTIVE_SQL = f"""{stats_sql('metric_counter', W)},
{instant_sql('metric_gauge')},
act AS (
  SELECT 'fixture:1:QueueHigh' AS rule_id, 'QueueHigh' AS alertname, 'warning' AS severity, job, instance, t, value, 900 AS for_s
  FROM i WHERE value > 4000
  UNION ALL SELECT 'fixture:2:RequestRateHigh', 'RequestRateHigh', 'critical', job, instance, t, {extrapolated_sql(W, True)}, 600
  FROM a WHERE n >= 2 AND {extrapolated_sql(W, True)} > 2
  UNION ALL SELECT 'fixture:3:QueueEmptyPanic', 'QueueEmptyPanic', 'panic', job, instance, t, value, 0 FROM i WHERE value < 150
  UNION ALL SELECT 'fixture:4:QueueLow', 'QueueLow', 'info', job, instance, t, value, 0 FROM i WHERE value < 300
  UNION ALL SELECT 'fixture:5:QueueNoted', 'QueueNoted', 'none', job, instance, t, value, 0 FROM i WHERE value < 100
  UNION ALL SELECT 'fixture:6:QueueBroken', 'QueueBroken', 'error', job, instance, t, value, 300 FROM i WHERE value > 4800),
{_STATES_SQL}"""


def _states(spark, sf_dir):
    g = grid(spark, sf_dir)
    queue = stored(M.instant(M.select(samples(spark, sf_dir, "metric_gauge"), "queue_length"), g), "queue")
    rate = stored(M.rate(M.select(samples(spark, sf_dir, "metric_counter"), "requests_total"), "1h", g), "rate")
    return AL.alert_states(AL.evaluate(_rules(queue, rate), None, g, spark), g)


def _cols(df, *extra):
    return df.select("rule_id", F.col("labels")["job"].alias("job"), F.col("labels")["instance"].alias("instance"),
                     "eval_ts", "state", *extra)


@query("alert_states", f"""WITH {_ACTIVE_SQL}
SELECT rule_id, job, instance, eval_ts, state, active_since, round(value, 6) AS value FROM st""",
       ("metric_counter", "metric_gauge"))
def alert_states(spark, sf_dir):
    """L1/L2: rules evaluated on the grid, ``for`` state machine (pending/firing/resolved)."""
    return _cols(_states(spark, sf_dir), "active_since", F.round("value", 6).alias("value"))


@query("alert_annotations", f"""WITH {_ACTIVE_SQL}
SELECT rule_id, job, instance, eval_ts, state,
  CASE rule_id WHEN 'fixture:1:QueueHigh' THEN 'Queue high on ' || job || '/' || instance || ' (value ' || printf('%.2f', value) || ')'
               WHEN 'fixture:2:RequestRateHigh' THEN 'Request rate high for ' || job || ' on ' || instance
               ELSE '' END AS summary
FROM st""", ("metric_counter", "metric_gauge"))
def alert_annotations(spark, sf_dir):
    """L3: annotation templates ($labels, $value with printf, missing label → '')."""
    st = _states(spark, sf_dir)
    parts = None
    for r in _rules():
        col = AL.compile_template(r.annotations.get("summary", ""))
        parts = F.when(F.col("rule_id") == r.rule_id, col) if parts is None else parts.when(F.col("rule_id") == r.rule_id, col)
    return _cols(st.withColumn("summary", parts.otherwise(F.lit(""))), "summary")


# the routing file's routes: none, info, warning or error, critical; others to its default receiver
_ROUTE_SQL = """SELECT *, CASE severity WHEN 'none' THEN 'slack_none' WHEN 'info' THEN 'slack'
  WHEN 'warning' THEN 'slack_warning' WHEN 'error' THEN 'slack_warning' WHEN 'critical' THEN 'slack_critical'
  ELSE 'slack' END AS receiver FROM st"""


@query("alert_routing", f"""WITH {_ACTIVE_SQL}, rt AS ({_ROUTE_SQL})
SELECT rule_id, job, instance, eval_ts, state, receiver FROM rt""", ("metric_counter", "metric_gauge"))
def alert_routing(spark, sf_dir):
    """L4: severity routing with continue on every child; unmatched (``panic``) → default."""
    return _cols(AL.route(_states(spark, sf_dir)), "receiver")


@query("alert_digest", f"""WITH {_ACTIVE_SQL}, rt AS ({_ROUTE_SQL}),
gg AS (SELECT receiver, eval_ts, CAST(count(*) FILTER (WHERE state = 'firing') AS BIGINT) AS firing,
        CAST(count(*) FILTER (WHERE state = 'resolved') AS BIGINT) AS resolved, count(*) AS n FROM rt GROUP BY ALL),
p AS (SELECT receiver, eval_ts, k, v, count(*) AS c FROM (
        SELECT receiver, eval_ts, 'alertname' AS k, alertname AS v FROM rt UNION ALL
        SELECT receiver, eval_ts, 'job', job FROM rt UNION ALL SELECT receiver, eval_ts, 'instance', instance FROM rt
        UNION ALL SELECT receiver, eval_ts, 'severity', severity FROM rt) GROUP BY ALL),
c AS (SELECT p.receiver, p.eval_ts, string_agg(k || '=' || v, ',' ORDER BY k || '=' || v) AS common_labels
      FROM p JOIN gg ON p.receiver = gg.receiver AND p.eval_ts = gg.eval_ts WHERE p.c = gg.n GROUP BY ALL)
SELECT gg.receiver, gg.eval_ts, gg.firing, gg.resolved, c.common_labels FROM gg LEFT JOIN c
ON gg.receiver = c.receiver AND gg.eval_ts = c.eval_ts""", ("metric_counter", "metric_gauge"))
def alert_digest(spark, sf_dir):
    """Per receiver and step: firing/resolved counts and the common label set."""
    return AL.digest(AL.route(_states(spark, sf_dir)))


# samples of some of the catalogue's metrics; the other rules find none
FX.register("rule_samples", ("events",), """
SELECT CASE event_type WHEN 'view' THEN 'up' WHEN 'purchase' THEN 'redis_up' WHEN 'click' THEN 'probe_http_status_code'
    WHEN 'error' THEN 'p2p_peers' ELSE 'pg_up' END AS name,
  event_type AS job, CAST(user_id % 4 AS STRING) AS instance, ts,
  CASE event_type WHEN 'click' THEN CAST(100 + event_id % 500 AS BIGINT) WHEN 'error' THEN CAST(event_id % 10 AS BIGINT)
    ELSE CAST(user_id % 3 % 2 AS BIGINT) END AS value
FROM {events}""")


@query("rule_catalog_states", f"""WITH g AS ({GRID_SQL}),
i AS (SELECT s.name, s.job, s.instance, g.t, arg_max(CAST(s.value AS DOUBLE), s.ts) AS value FROM g JOIN rule_samples s
  ON s.ts >= g.t - to_seconds(300) AND s.ts <= g.t GROUP BY s.name, s.job, s.instance, g.t),
act AS (SELECT 'bbox:24:BlackboxProbeHttpFailure' AS rule_id, '' AS alertname, '' AS severity, job, instance, t, value, 0 AS for_s
  FROM i WHERE name = 'probe_http_status_code' AND (value <= 199 OR value >= 500)
  UNION ALL SELECT 'geth:41:GethChainNoPeers', '', '', job, instance, t, value, 600 FROM i WHERE name = 'p2p_peers' AND value < 5
  UNION ALL SELECT 'prom:4:PrometheusJobMissing', '', '', 'prometheus', NULL, t, 1, 0 FROM g
  UNION ALL SELECT 'prom:14:PrometheusTargetMissing', '', '', job, instance, t, value, 0 FROM i WHERE name = 'up' AND value = 0
  UNION ALL SELECT 'psql:4:PostgresqlDown', '', '', job, instance, t, value, 0 FROM i WHERE name = 'pg_up' AND value = 0
  UNION ALL SELECT 'reds:4:RedisDown', '', '', job, instance, t, value, 300 FROM i WHERE name = 'redis_up' AND value = 0),
{{_STATES_SQL}}
SELECT rule_id, job, instance, eval_ts, state FROM st""".replace("{_STATES_SQL}", _STATES_SQL), ("rule_samples",))
def rule_catalog_states(spark, sf_dir):
    """L1: all rules of the catalogue on shared vectors, from one scan of the samples."""
    m = metrics_frame(FX.load(spark, sf_dir, "rule_samples"), F.col("name"), ["job", "instance"], "ts", "value")
    g = grid(spark, sf_dir)
    return _cols(AL.alert_states(AL.evaluate_shared(RU.rules(), m, g, spark), g))
