"""Lifecycle jobs, matching rules and schemas on small frames."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chainframe.functions import u256 as U
from chainframe.operators import derive as DV
from chainframe.operators import prices as PR
from chainframe.operators.metrics import vector as V
from chainframe.operators.windows import asof_join
from chainframe.sources import layout as LY
from chainframe.sources import schemas as S

T0 = datetime(2024, 1, 1)


def test_compaction_rewrites_old_chunks_only(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    df = spark.range(4000).select((F.lit(T0).cast("timestamp_ntz") + F.expr("make_dt_interval(int(id % 40))")).alias("block_timestamp"),
                                  F.col("id").alias("blknum"))
    for k in range(3):
        LY.write_chunked(df.filter(F.col("blknum") % 3 == k), path, mode="append", cluster=False)
    before = sorted(map(tuple, spark.read.parquet(path).select("blknum", "chunk").collect()))
    done = LY.compact(spark, path, "2024-02-10 00:00:00", "10 days", target_rows=100_000).collect()
    assert done and all(r.files == 1 for r in done)
    assert all(r.chunk + timedelta(days=7) <= datetime(2024, 1, 31) for r in done)
    assert sorted(map(tuple, spark.read.parquet(path).select("blknum", "chunk").collect())) == before


def test_retention_is_a_pushed_literal(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    spark.range(100).select((F.lit(T0).cast("timestamp_ntz") + F.expr("make_dt_interval(0, int(id))")).alias("block_timestamp")).write.parquet(path)
    kept = LY.retain(spark.read.parquet(path), "2024-01-03 12:30:00", "6 hours", interval="1 hour")
    assert kept.agg(F.min("block_timestamp")).first()[0] == datetime(2024, 1, 3, 6)
    assert "GreaterThanOrEqual(block_timestamp" in kept._jdf.queryExecution().executedPlan().toString()


def test_asof_ties_take_the_largest_and_null_keys_match_nothing(spark):
    left = spark.createDataFrame([("a", T0 + timedelta(days=3)), (None, T0 + timedelta(days=3))], "k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", T0, 5), ("a", T0, 9), ("a", T0, 7), (None, T0, 1), (None, T0 + timedelta(days=3), 2)],
                                  "k string, u timestamp_ntz, v int")
    got = {r.k: r.v for r in asof_join(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert got == {"a": 9, None: None}


def test_price_buckets_of_six_hours(spark):
    q = spark.createDataFrame([("cgc", "t", T0 + timedelta(hours=h), h) for h in (0, 5, 6, 13)], "source string, token_address string, ts timestamp_ntz, price_cents long")
    got = {r.bucket: r.cgc_price for r in PR.compare_sources(q, bucket="6 hours").collect()}
    assert got == {T0: 2.5, T0 + timedelta(hours=6): 6.0, T0 + timedelta(hours=12): 13.0}


def test_many_to_many_matching_is_an_error(spark):
    v = spark.createDataFrame([("m", {"job": "a", "i": str(k)}, f"m{k}", T0, 1.0) for k in range(2)],
                              "name string, labels map<string,string>, series_key string, eval_ts timestamp_ntz, value double")
    with pytest.raises(Exception, match="many-to-many"):
        V.binary_op(v, v, "+", on=["job"]).collect()
    assert V.binary_op(v, v, "+").count() == 2
    by_name = V.binary_op(v.limit(1), v.limit(1), "==", on=["__name__"])
    assert by_name.count() == 1


def test_numbers_too_long_for_the_limbs_are_null(spark):
    r = spark.range(1).select(U.canonical(F.lit("1" * 91)).alias("a"), U.canonical(F.lit("0" * 60 + "7")).alias("b"),
                              U.order_key(F.lit("1" * 79)).alias("c")).first()
    assert (r.a, r.b, r.c) == (None, "7", None)


def test_latest_token_and_best_signature(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "address string, blknum long, symbol string")
    assert sorted(map(tuple, DV.tokens_latest(t).collect())) == [("a", 3, "z"), ("b", 1, None)]
    g = spark.createDataFrame([("s", "p2", 5), ("s", "p1", 5), ("s", "p0", None), ("u", "q", None)], "byte_sign string, pkey string, score int")
    assert sorted(map(tuple, DV.best_signature(g).collect())) == [("s", "p1", 5), ("u", "q", None)]


def test_hostile_erc1155_payloads_give_no_rows(spark):
    word = lambda x: f"{x:064x}"
    topics = "[" + ",".join([DV.E.TRANSFER_BATCH_TOPIC] + ["0x" + word(k) for k in (1, 2, 3)]) + "]"
    good = word(64) + word(128) + word(1) + word(5) + word(1) + word(9)
    bad = ["f" * 64 + good[64:], word(64) + word(128) + "f" * 64 + good[192:], word(64) + word(128) + word(40) + word(5) + word(40) + word(9),
           "", word(1), "zz" * 32, word(64) + word(64), word(33) + good[64:]]
    rows = [(T0, 1, f"t{i}", 0, i, "0xc", 4, topics, "0x" + d) for i, d in enumerate([good, *bad])]
    logs = spark.createDataFrame(rows + [(T0, 1, "n", 0, 99, "0xc", 4, topics, None)],
                                 "block_timestamp timestamp_ntz, blknum long, txhash string, txpos long, logpos int, address string, "
                                 "n_topics int, topics string, data string")
    assert [(r.txhash, r.token_id, r.value) for r in DV.erc1155_transfers(logs).collect()] == [("t0", "5", "9")]
    assert DV.erc1155_rejects(logs).first().rejected == len(bad) + 1


def test_catalog_lists_every_table(spark):
    tron = {(r.table_name, r.column_name) for r in S.chain_catalog(spark, "tron").collect()}
    assert {c for t, c in tron if t == "tron.blocks"} == {"block_timestamp", "blknum", "blkhash", "parent_hash", "txs_root",
                                                          "miner", "version", "tx_count", "extra_data"}
    assert ("tron.logs", "topics_0") in tron and ("tron.logs", "item_id") not in tron
    evm = {(r.table_name, r.column_name) for r in S.chain_catalog(spark, "ethereum", audit=True).collect()}
    assert ("ethereum.blocks", "created_at") in evm and ("ethereum.history_balances", "fee_value") in evm
    assert ("ethereum.func_signs", "pkey") in evm
