"""Alert rule catalogue: the reference's alerting rules as Python functions over shared vectors
(no expression parser). Each entry keeps the rule's group file and line as identity.

It covers one or more rules of every expression family used by the reference (instant compare, or,
range average/max, rate/increase/changes, aggregation by labels, vector division, absent, count of
count_values, time() arithmetic); the remaining rules of the catalogue reuse the same operators.
Evaluate it with ``alerts.evaluate_shared``: the metrics are scanned once for all rules.
"""

from __future__ import annotations

from chainframe.operators.alerts import Rule
from chainframe.operators.metrics import vector as V


def _cpu_load(x):
    idle = x.get("rate", "2m", "node_cpu_seconds_total", ("mode", "=", "idle"))
    busy = V.scalar_op(V.scalar_op(V.aggregate(idle, "avg", ["instance"]), "*", 100), "-", 100, scalar_left=True)
    return V.compare(busy, ">", 90)


def _load5(x):
    cpus = V.aggregate(x.instant("node_cpu_seconds_total", ("mode", "=", "idle")), "count", ["instance", "job"])
    return V.compare(V.binary_op(x.instant("node_load5"), cpus, "/"), ">=", 1.6)


def _config_not_synced(x):
    return V.compare(V.aggregate(V.count_values(x.instant("alertmanager_config_hash"), "config_hash"), "count"), ">", 1)


# fixed values: rule names, thresholds, windows, `for` durations and severities of the
# reference's alerting rules (group, line, name, expression, for seconds, severity)
CATALOG = [
    ("bbox", 4, "BlackboxProbeFailed", lambda x, g, s: V.compare(x.instant("probe_success"), "==", 0), 0, "critical"),
    ("bbox", 14, "BlackboxSlowProbe",
     lambda x, g, s: V.compare(x.get("avg_over_time", "1m", "probe_duration_seconds"), ">", 1), 60, "warning"),
    ("bbox", 24, "BlackboxProbeHttpFailure",
     lambda x, g, s: V.vector_or(V.compare(x.instant("probe_http_status_code"), "<=", 199),
                                 V.compare(x.instant("probe_http_status_code"), ">=", 500)), 0, "critical"),
    ("cetl", 16, "ChainLoadPending",
     lambda x, g, s: V.compare(V.aggregate(x.instant("redis_stream_group_consumer_messages_pending"), "sum",
                                           ["db", "group", "instance", "stream"]), ">", 0), 1800, "warning"),
    ("geth", 4, "GethChainInsertsOutOfTime",
     lambda x, g, s: V.compare(V.scalar_op(x.get("max_over_time", "10m", "chain_inserts", ("quantile", "=", "0.95")),
                                           "/", 1e9), ">", 10), 600, "warning"),
    ("geth", 41, "GethChainNoPeers",
     lambda x, g, s: V.compare(x.instant("p2p_peers", ("discover", "!=", "no")), "<", 5), 600, "critical"),
    ("host", 4, "HostHighCpuLoad", lambda x, g, s: _cpu_load(x), 0, "warning"),
    ("host", 15, "HostHighLoad5m", lambda x, g, s: _load5(x), 120, "warning"),
    ("host", 130, "HostOomKillDetected",
     lambda x, g, s: V.compare(x.get("increase", "1m", "node_vmstat_oom_kill"), ">", 0), 0, "warning"),
    ("prom", 4, "PrometheusJobMissing",
     lambda x, g, s: V.absent(x.instant("up", ("job", "=", "prometheus")), g, s, {"job": "prometheus"}), 0, "critical"),
    ("prom", 14, "PrometheusTargetMissing", lambda x, g, s: V.compare(x.instant("up"), "==", 0), 0, "critical"),
    ("prom", 44, "PrometheusTooManyRestarts",
     lambda x, g, s: V.compare(x.get("changes", "15m", "process_start_time_seconds",
                                       ("job", "=~", "prometheus|pushgateway|alertmanager")), ">", 2),
     0, "warning"),
    ("prom", 64, "PrometheusAlertmanagerConfigNotSynced", lambda x, g, s: _config_not_synced(x), 0, "warning"),
    ("psql", 4, "PostgresqlDown", lambda x, g, s: V.compare(x.instant("pg_up"), "==", 0), 0, "critical"),
    ("psql", 13, "PostgresqlRestarted",
     lambda x, g, s: V.compare(V.time_minus(x.instant("pg_postmaster_start_time_seconds")), "<", 60), 0, "critical"),
    ("reds", 4, "RedisDown", lambda x, g, s: V.compare(x.instant("redis_up"), "==", 0), 300, "critical"),
    ("reds", 40, "RedisIncreaseTooManyConnections",
     lambda x, g, s: V.compare(x.get("rate", "1m", "redis_connected_clients"), ">", 100), 300, "warning"),
]


def rules() -> list[Rule]:
    return [Rule(name, expr, for_seconds=f, labels={"severity": sev}, group=grp, line=line)
            for grp, line, name, expr, f, sev in CATALOG]
