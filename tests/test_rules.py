"""Catalogue rules evaluate on a small sample set and drive the state machine."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from chainframe.operators import alerts as AL
from chainframe.operators import metrics as M
from chainframe.operators import rules as R
from chainframe.operators.metrics.ranges import Grid
from chainframe.sources.ingest import metrics_frame

T0 = datetime(2024, 1, 1)


def test_catalog_evaluates(spark):
    rows = []
    for i in range(0, 40):
        t = T0 + timedelta(seconds=15 * i)
        rows += [("up", "node", "a", t, 0.0), ("up", "prometheus", "p", t, 1.0), ("redis_up", "redis", "r", t, 0.0),
                 ("redis_stream_group_consumer_messages_pending", "redis", "r", t, 5.0), ("p2p_peers", "geth", "g", t, 3.0), ("probe_http_status_code", "bb", "x", t, 503.0)]
    df = spark.createDataFrame(rows, "name string, job string, instance string, ts timestamp_ntz, value double")
    m = metrics_frame(df, F.col("name"), ["job", "instance"], "ts", "value")
    grid = Grid.of("2024-01-01 00:01:00", "2024-01-01 00:09:00", "1m")
    states = AL.alert_states(AL.evaluate_shared(R.rules(), m, grid, spark), grid)
    got = {(r.rule_id.split(":")[2], r.state) for r in states.collect()}
    assert ("PrometheusTargetMissing", "firing") in got
    assert ("RedisDown", "pending") in got and ("RedisDown", "firing") in got
    assert ("GethChainNoPeers", "pending") in got
    assert ("BlackboxProbeHttpFailure", "firing") in got
    assert not any(n == "PrometheusJobMissing" for n, _ in got)
    assert ("ChainLoadPending", "pending") in got  # needs 30 minutes to fire
    routed = {r.receiver for r in AL.route(states).collect()}
    assert routed == {"slack_critical", "slack_warning"}


def test_routes_by_severity(spark):
    severities = ["none", "info", "warning", "error", "critical", "panic", "informal"]
    df = spark.createDataFrame([(s,) for s in severities], "s string").select(F.create_map(F.lit("severity"), "s").alias("labels"))
    got = {r.labels["severity"]: r.receiver for r in AL.route(df).collect()}
    assert got == {"none": "slack_none", "info": "slack", "warning": "slack_warning", "error": "slack_warning",
                   "critical": "slack_critical", "panic": "slack", "informal": "slack"}


def test_each_vector_is_computed_once_for_all_rules(spark, monkeypatch):
    from chainframe.operators.metrics import shared

    names, real = [], shared.stored
    monkeypatch.setattr(shared, "stored", lambda df, name: names.append(name) or real(df, name))
    rows = [("up", "node", "a", T0 + timedelta(seconds=15 * i), float(i % 2)) for i in range(20)]
    m = metrics_frame(spark.createDataFrame(rows, "name string, job string, instance string, ts timestamp_ntz, value double"),
                      F.col("name"), ["job", "instance"], "ts", "value")
    grid = Grid.of("2024-01-01 00:01:00", "2024-01-01 00:04:00", "1m")
    v = shared.Vectors(m, grid)
    for r in R.rules():
        r.expr(v, grid, spark)
    asked = {k: set(x) for k, x in v.wanted.items()}
    assert len(R.rules()) == 17 and {"up", "pg_up", "redis_up", "node_load5"} < asked["instant", "5m"]
    v.prepare()
    assert names.count("rule-metrics") == 1 and len(names) == 1 + len(asked)  # one scan, one table a function and window
    up = shared.Vectors(m, grid)
    up.instant("up")
    want = {(r.eval_ts, r.value) for r in M.instant(M.select(m, "up"), grid).collect()}
    assert {(r.eval_ts, r.value) for r in up.prepare().instant("up").collect()} == want
