"""Point lookups prune row groups by Bloom filters."""

import os

from pyspark.sql import functions as F

from chainframe.operators import lookups as LK


def _read_rows(df):
    """Rows that the scans of a plan without exchanges gave to it."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().get("numOutputRows").get().value() for k in range(leaves.size()))


def _txs(spark, n=40_000):
    return spark.range(n).select(
        F.timestamp_add("SECOND", F.col("id"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("block_timestamp"),
        F.sha2(F.col("id").cast("string"), 256).alias("txhash"), (F.col("id") % 7).alias("txpos"),
        F.md5((F.col("id") % 9000).cast("string")).alias("from_address"), F.md5((F.col("id") % 7000).cast("string")).alias("to_address"))


def test_hash_and_address_lookups_read_few_row_groups(spark, tmp_dir):
    path, plain = os.path.join(tmp_dir, "txs"), os.path.join(tmp_dir, "plain")
    t = _txs(spark).repartition(8, "txhash")
    LK.write_lookup(t, path, LK.LOOKUP_COLUMNS["txs"], distinct=6000)
    t.write.parquet(plain)
    h = _txs(spark, 1).first()
    for where, most in ((path, 6000), (plain, None)):
        found = spark.read.parquet(where).filter(F.col("txhash") == h.txhash)
        assert found.count() == 1
        read = _read_rows(found)
        assert read <= most if most else read == 40_000
    activity = LK.address_activity(spark.read.parquet(path), h.from_address)
    assert activity.count() == sum(k % 9000 == 0 or k % 7000 == 0 for k in range(40_000))
    assert _read_rows(activity) < 80_000  # of two scans of 40,000
    missing = LK.address_activity(spark.read.parquet(path), "0xnone")
    assert _read_rows(missing) < 20_000 and missing.count() == 0


def test_activity_roles_and_time_range(spark):
    rows = [("2024-01-01", "a", "b"), ("2024-01-02", "b", "a"), ("2024-01-03", "a", "a"), ("2024-01-04", None, "a"), ("2024-01-05", "a", None)]
    t = spark.createDataFrame(rows, "d string, from_address string, to_address string").select("*", F.col("d").cast("timestamp_ntz").alias("block_timestamp"))
    got = sorted((r.d, r.role) for r in LK.address_activity(t, "a", "2024-01-01", "2024-01-05").collect())
    assert got == [("2024-01-01", "out"), ("2024-01-02", "vin"), ("2024-01-03", "out"), ("2024-01-04", "vin")]


def test_bundle_and_history(spark):
    tx = spark.createDataFrame([("h", 1), ("x", 2)], "txhash string, txpos long")
    tr = spark.createDataFrame([("h", 1, "0,1"), ("h", 1, ""), ("x", 2, "")], "txhash string, txpos long, trace_address string")
    lg = spark.createDataFrame([("h", 7)], "txhash string, logpos int")
    got = sorted(map(tuple, LK.tx_bundle(tx, tr, lg, "h").collect()), key=str)
    assert got == [("log", "h", 7, None), ("trace", "h", 1, ""), ("trace", "h", 1, "0,1"), ("tx", "h", 1, None)]
