"""Streaming jobs run with availableNow and equal their batch counterparts."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from chainframe.operators import alerts as AL
from chainframe.operators import balances as BL
from chainframe.operators import derive as DV
from chainframe.operators.metrics import ranges as R
from chainframe.operators.metrics.ranges import Grid
from chainframe.sources import layout as LY
from chainframe.sources import schemas as S
from chainframe.sources.ingest import metrics_frame
from chainframe.streaming import loaders as ST

T0 = datetime(2024, 1, 1)
SCHEMA = "block_timestamp timestamp_ntz, txhash string, txpos long, value string"


def test_load_stream_upsert_equals_batch(spark, tmp_dir):
    first = [(T0 + timedelta(days=i), f"h{i}", 0, str(i)) for i in range(20)]
    second = [(T0 + timedelta(days=i), f"h{i}", 0, str(100 + i)) for i in range(10, 30)]
    src = os.path.join(tmp_dir, "src")
    spark.createDataFrame(first, SCHEMA).write.parquet(os.path.join(src, "b1"))
    spark.createDataFrame(second, SCHEMA).write.parquet(os.path.join(src, "b2"))
    target, ckpt = os.path.join(tmp_dir, "target"), os.path.join(tmp_dir, "ckpt")
    schema = spark.createDataFrame([], SCHEMA).schema
    for sub in ("b1", "b2"):  # two runs = two micro-batch sets
        q = ST.load_stream(spark, os.path.join(src, sub), schema, target, ["block_timestamp", "txhash", "txpos"],
                           ckpt + sub)
        q.awaitTermination()
    got = sorted((r.txhash, r.value) for r in spark.read.parquet(target).collect())
    batch = LY.merge_batch(spark.createDataFrame(first, SCHEMA), spark.createDataFrame(second, SCHEMA),
                           ["block_timestamp", "txhash", "txpos"])
    assert got == sorted((r.txhash, r.value) for r in batch.collect())


def test_mempool_dedup_within_watermark(spark, tmp_dir):
    rows = [(T0 + timedelta(minutes=i), f"h{i % 5}", 0, "1") for i in range(20)]
    src = os.path.join(tmp_dir, "pool")
    spark.createDataFrame(rows, SCHEMA).write.parquet(src)
    stream = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).parquet(src)
    q = (ST.mempool_stream(stream).writeStream.format("memory").queryName("pool_out")
         .option("checkpointLocation", os.path.join(tmp_dir, "c")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.sql("SELECT count(*) FROM pool_out").first()[0] == 5


def test_alert_stream_equals_batch(spark, tmp_dir):
    grid = Grid.of("2024-01-01 00:00:00", "2024-01-01 05:00:00", "5m")
    steps = [1, 2, 3, 4, 5, 6, 10, 11, 20, 21, 22, 23, 24]
    rows = [("r1", "s1", T0 + timedelta(minutes=5 * k), 1.0, 600) for k in steps]
    cols = "rule_id string, series_key string, eval_ts timestamp_ntz, value double, for_seconds int"
    active = spark.createDataFrame(rows, cols).withColumn("labels", F.create_map())
    batch = AL.alert_states(active, grid).select("eval_ts", "state").collect()
    src = os.path.join(tmp_dir, "act")
    spark.createDataFrame(rows, cols).write.parquet(src)
    stream = spark.readStream.schema(spark.createDataFrame([], cols).schema).parquet(src)
    q = (ST.alert_stream(stream, 600, 300).writeStream.format("memory").queryName("alert_out").outputMode("append")
         .option("checkpointLocation", os.path.join(tmp_dir, "c2")).trigger(availableNow=True).start())
    q.awaitTermination()
    streamed = spark.sql("SELECT eval_ts, state FROM alert_out").collect()
    # the final episode's 'resolved' needs the watermark to pass it; all earlier rows agree
    last = max(r.eval_ts for r in batch if r.state != "resolved")
    assert sorted(r for r in streamed if r.eval_ts <= last) == sorted(r for r in batch if r.eval_ts <= last)


XFER = "block_timestamp timestamp_ntz, blknum long, txhash string, token_address string, from_address string, to_address string, value string"


def _xfers():
    rows = []
    for b in range(1, 7):
        for k in range(4):
            rows.append((T0 + timedelta(minutes=b), b, f"t{b}-{k // 2}", f"tok{k % 2}", f"a{k % 3}", f"a{(k + b) % 3}", str(10 ** 30 + 7 * b + k)))
    return rows


def _sorted(df):
    cols = sorted(c for c in df.columns if c not in ("decimals", "balance"))
    return sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())


def test_streamed_balances_survive_replay_and_split_blocks(spark, tmp_dir):
    rows = _xfers()
    batches = [rows[:7], rows[7:15], rows[15:]]  # blocks and a transaction are split over them
    want = _sorted(BL.token_balances(spark.createDataFrame(rows, XFER)))
    state = os.path.join(tmp_dir, "state")
    for epoch, b in enumerate(batches):
        ST.store_partials(spark.createDataFrame(b, XFER), state, epoch)
        ST.store_partials(spark.createDataFrame(b, XFER), state, epoch)  # replayed before its commit
    assert _sorted(ST.streamed_balances(spark, state)) == want
    ST.fold_partials(spark, state, 3)
    ST.fold_partials(spark, state, 3)
    assert _sorted(ST.streamed_balances(spark, state)) == want
    ST.fold_partials(spark, state, 5)
    assert _sorted(ST.streamed_balances(spark, state)) == want


def test_balances_stream_equals_batch(spark, tmp_dir):
    rows = _xfers()
    src, state = os.path.join(tmp_dir, "x"), os.path.join(tmp_dir, "s")
    schema = spark.createDataFrame([], XFER).schema
    for k, part in enumerate((rows[:9], rows[9:])):
        spark.createDataFrame(part, XFER).coalesce(1).write.mode("append").parquet(src)
        q = ST.balances_stream(spark, spark.readStream.schema(schema).parquet(src), state, os.path.join(tmp_dir, "c"))
        q.awaitTermination()
    assert _sorted(ST.streamed_balances(spark, state)) == _sorted(BL.token_balances(spark.createDataFrame(rows, XFER)))


def test_load_stream_keeps_the_last_write_of_a_batch(spark, tmp_dir):
    src, target = os.path.join(tmp_dir, "src"), os.path.join(tmp_dir, "target")
    rows = [(T0, "h1", 0, str(i)) for i in range(50)] + [(T0, "h2", 0, "x")]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(src)
    schema = spark.createDataFrame([], SCHEMA).schema
    ST.load_stream(spark, src, schema, target, ["block_timestamp", "txhash", "txpos"], os.path.join(tmp_dir, "c")).awaitTermination()
    assert sorted((r.txhash, r.value) for r in spark.read.parquet(target).collect()) == [("h1", "49"), ("h2", "x")]


def test_over_time_stream_equals_batch(spark, tmp_dir):
    rows = [("m", "a", T0 + timedelta(seconds=17 * i), float(i * i % 23)) for i in range(120)]
    rows += [("m", "b", T0 + timedelta(seconds=30 * i), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "name string, job string, ts timestamp_ntz, value double")
    m = metrics_frame(df, F.col("name"), ["job"], "ts", "value")
    src = os.path.join(tmp_dir, "m")
    m.write.parquet(src)
    stream = spark.readStream.schema(m.schema).parquet(src)
    q = (ST.over_time_stream(stream, "avg", 300, 60, 0).writeStream.format("memory").queryName("over_time").outputMode("append")
         .option("checkpointLocation", os.path.join(tmp_dir, "c")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.series_key, r.eval_ts): r.value for r in spark.sql("SELECT * FROM over_time").collect()}
    grid = Grid.of("2024-01-01 00:00:00", "2024-01-01 01:00:00", "1m")
    want = {(r.series_key, r.eval_ts): r.value for r in R.avg_over_time(m, "5m", grid).collect()}
    assert len(got) > 30 and all(abs(want[k] - v) < 1e-9 for k, v in got.items())
    # everything the watermark has passed is there
    last = max(t for _, t in got)
    assert {k for k in want if k[1] <= last} == set(got)


def test_late_and_unnumbered_blocks_after_a_fold(spark, tmp_dir):
    rows, state = _xfers(), os.path.join(tmp_dir, "late")
    none = (T0, None, "tn", "tok0", "a0", "a2", "100")
    late = [(T0 + timedelta(minutes=2), 2, "t2-0", "tok0", "a0", "a1", "7"), (T0 + timedelta(minutes=2), 2, "t2-9", "tok1", "new", "a1", "5"), none]
    df = lambda r: spark.createDataFrame(r, XFER)
    ST.store_partials(df(rows[:16] + [none]), state, 0)
    ST.fold_partials(spark, state, 3)
    assert _sorted(ST.streamed_balances(spark, state)) == _sorted(BL.token_balances(df(rows[:16] + [none])))
    ST.store_partials(df(rows[16:] + late), state, 1)  # a known transaction, a new one, and a row without a block
    want = _sorted(BL.token_balances(df(rows + [none] + late)))
    assert _sorted(ST.streamed_balances(spark, state)) == want
    ST.fold_partials(spark, state, 3)  # the late rows are folded now
    assert _sorted(ST.streamed_balances(spark, state)) == want
    ST.store_partials(df(late), state, 2)
    ST.fold_partials(spark, state, 5)
    assert _sorted(ST.streamed_balances(spark, state)) == _sorted(BL.token_balances(df(rows + [none] + late * 2)))


def _stream(spark, rows, cols, path, parts):
    """A stream that reads the rows in ``parts`` batches, in their order."""
    for k in range(parts):
        own = rows[len(rows) * k // parts : len(rows) * (k + 1) // parts]
        spark.createDataFrame(own, cols).coalesce(1).write.parquet(os.path.join(path, f"part={k:02d}"))
    schema = spark.createDataFrame([], cols).schema
    return schema


def test_range_functions_on_a_disordered_stream_equal_batch(spark, tmp_dir):
    import random

    rng = random.Random(3)
    rows, v = [], 0.0
    for i in range(240):
        v = rng.random() * 5 if rng.random() < 0.05 else v + rng.randint(0, 9)  # resets
        rows.append(("m", "a", T0 + timedelta(seconds=15 * i), v))
        if i % 3 == 0:
            rows.append(("m", "b", T0 + timedelta(seconds=15 * i), float(i % 7)))
    cols = "name string, job string, ts timestamp_ntz, value double"
    m = metrics_frame(spark.createDataFrame(rows, cols), F.col("name"), ["job"], "ts", "value")
    mixed = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.randint(0, 100)))  # out of order, within the lateness
    mixed = [x for k, r in enumerate(mixed) for x in ([r, r] if k % 10 == 0 else [r])]  # some delivered twice
    src = os.path.join(tmp_dir, "r")
    schema = _stream(spark, mixed, cols, src, 4)
    grid = Grid.of("2024-01-01 00:00:00", "2024-01-01 01:00:00", "1m")
    batch = {"rate": lambda: R.rate(m, "5m", grid), "changes": lambda: R.changes(m, "5m", grid), "deriv": lambda: R.deriv(m, "5m", grid),
             "irate": lambda: R.irate(m, "5m", grid), "increase": lambda: R.increase(m, "5m", grid)}
    for fn in ("rate", "irate", "deriv", "changes"):
        raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))
        stream = metrics_frame(raw, F.col("name"), ["job"], "ts", "value")
        q = (ST.range_stream(stream, fn, 300, 60, 120).writeStream.format("memory").queryName(f"range_{fn}").outputMode("append")
             .option("checkpointLocation", os.path.join(tmp_dir, f"c_{fn}")).trigger(availableNow=True).start())
        q.awaitTermination()
        got = {(r.series_key, r.eval_ts): r.value for r in spark.sql(f"SELECT * FROM range_{fn}").collect()}
        want = {(r.series_key, r.eval_ts): r.value for r in batch[fn]().collect() if r.value is not None}
        last = max(t for _, t in got)
        assert last >= T0 + timedelta(minutes=50)
        due = {k: x for k, x in want.items() if k[1] <= last}
        assert set(got) == set(due), fn
        assert all(abs(got[k] - x) < 1e-9 * max(1, abs(x)) for k, x in due.items()), fn


POOL = "block_timestamp timestamp_ntz, txhash string, from_address string, nonce long"


def test_mempool_outcomes_on_streams_equal_batch(spark, tmp_dir):
    at = lambda m: T0 + timedelta(minutes=m)
    pool = [(at(0), "mined", "a", 1), (at(1), "replaced", "a", 2), (at(2), "expired", "a", 3), (at(3), "late", "b", 1),
            (at(4), "by hash", None, None), (at(5), "too late", "b", 2), (at(900), "newest", "z", 1)]
    mined = [(at(10), "mined", "a", 1), (at(12), "other", "a", 2), (at(20), "late", "b", 1), (at(15), "by hash", None, None),
             (at(5 + 361), "too late", "b", 2), (at(1), "before", "a", 3), (at(900), "unrelated", "q", 1)]
    want = sorted(tuple(r) for r in DV.txpool_outcome(spark.createDataFrame(pool, POOL), spark.createDataFrame(mined, POOL)).collect())
    assert {r[0]: r[2] for r in want} == {"mined": "mined", "replaced": "replaced", "expired": "expired", "late": "mined", "by hash": "mined",
                                          "too late": "expired", "newest": "expired"}
    ps, ms = os.path.join(tmp_dir, "p"), os.path.join(tmp_dir, "m")
    schema = spark.createDataFrame([], POOL).schema
    for k, (p, m) in enumerate(((pool[:6], [mined[0], mined[5]]), ([], [mined[1], mined[3], mined[2]]), ([], [mined[4]]), (pool[6:], mined[6:]))):
        for path, own in ((ps, p), (ms, m)):
            if own:
                spark.createDataFrame(own, POOL).coalesce(1).write.mode("append").parquet(path)
        read = lambda path: spark.readStream.schema(schema).parquet(path)
        q = (ST.txpool_outcome_stream(read(ps), read(ms)).writeStream.format("parquet").option("path", os.path.join(tmp_dir, "out"))
             .option("checkpointLocation", os.path.join(tmp_dir, "cj")).trigger(availableNow=True).start())
        q.awaitTermination()
    got = sorted((tuple(r) for r in spark.read.parquet(os.path.join(tmp_dir, "out")).collect()))
    assert got == [r for r in want if r[0] != "newest"]  # its retention has not passed


def test_episodes_by_timers_equal_batch_under_restart(spark, tmp_dir):
    grid = Grid.of("2024-01-01 00:00:00", "2024-01-01 08:00:00", "5m")
    steps = [1, 2, 3, 4, 5, 6, 10, 11, 20, 21, 22, 23, 24]
    rows = [("r1", "s1", T0 + timedelta(minutes=5 * k)) for k in steps] + [("r1", "s2", T0 + timedelta(minutes=5 * k)) for k in (2, 3, 4, 90)]
    rows.sort(key=lambda r: r[2])
    cols = "rule_id string, series_key string, eval_ts timestamp_ntz"
    full = spark.createDataFrame([(*r, 1.0, 600) for r in rows], cols + ", value double, for_seconds int").withColumn("labels", F.create_map())
    batch = sorted((r.series_key, r.eval_ts, r.state, r.active_since) for r in AL.alert_states(full, grid).collect())
    src, out = os.path.join(tmp_dir, "e"), os.path.join(tmp_dir, "eo")
    schema = spark.createDataFrame([], cols).schema
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (rows[:5], rows[5:12], rows[12:]):  # each run goes on from the checkpoint
            spark.createDataFrame(part, cols).coalesce(1).write.mode("append").parquet(src)
            q = (ST.alert_episodes(spark.readStream.schema(schema).parquet(src), 600, 300).writeStream.format("parquet").option("path", out)
                 .outputMode("append").option("checkpointLocation", os.path.join(tmp_dir, "ce")).trigger(availableNow=True).start())
            q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r.series_key, r.eval_ts, r.state, r.active_since) for r in spark.read.parquet(out).collect())
    newest = ("s2", T0 + timedelta(minutes=450))  # its episode is still open
    assert got == [r for r in batch if (r[0], r[1]) <= newest or r[0] != "s2"]
    assert ("s1", T0 + timedelta(minutes=125), "resolved", T0 + timedelta(minutes=100)) in got  # by a timer


def test_a_batch_run_again_repairs_half_copied_chunks(spark, tmp_dir):
    import shutil

    target, before = os.path.join(tmp_dir, "t"), os.path.join(tmp_dir, "before")
    rows = lambda tag: spark.createDataFrame([(T0 + timedelta(days=8 * i), f"h{i}", 0, f"{tag}{i}") for i in range(4)], SCHEMA)
    key = ["txhash", "txpos"]
    ST.upsert_chunks(spark, rows("old"), target, key, epoch=0)
    shutil.copytree(target, before)
    ST.upsert_chunks(spark, rows("new"), target, key, epoch=1)
    chunk = sorted(x for x in os.listdir(target) if x.startswith("chunk="))[1]
    shutil.copytree(os.path.join(before, chunk), os.path.join(target, chunk, "..", f"{chunk}-old"))  # as if this one was not copied
    shutil.rmtree(os.path.join(target, chunk))
    os.rename(os.path.join(target, f"{chunk}-old"), os.path.join(target, chunk))
    read = lambda: sorted(r.value for r in spark.read.parquet(target).select("txhash", "value").collect())
    spark.catalog.clearCache()
    assert sum(v.startswith("old") for v in read()) == 1
    ST.upsert_chunks(spark, rows("new"), target, key, epoch=1)
    assert read() == [f"new{i}" for i in range(4)]
