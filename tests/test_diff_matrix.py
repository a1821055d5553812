"""Three-valued-logic edge cases of the differ on hand-built rows."""

from datetime import datetime, timedelta

from chainframe.operators import diff as D

T0 = datetime(2024, 1, 1, 0, 10)


def _blocks(spark, rows):
    return spark.createDataFrame(rows, "block_timestamp timestamp_ntz, blknum long, blkhash string, parent_hash string, "
                                       "nonce string, logs_bloom string, gas_used long")


def test_block_semantics(spark):
    a = _blocks(spark, [
        (T0, 1, "h1", "p1", "n1", "b1", 10),      # identical
        (T0, 2, "h2", "p2", "n2", "b2", 10),      # logs_bloom only → unknown
        (T0, 3, "h3", None, "n3", "b3", -1),      # NULL parent on both, -1 vs NULL gas → same
        (T0, 4, None, "p4", "n4", "b4", 10),      # NULL blkhash (no sentinel) → neither
        (T0, 5, "h5", "p5", "n5", "b5", 10),      # unmatched → diff, parent_hash
    ])
    b = _blocks(spark, [
        (T0, 1, "h1", "p1", "n1", "b1", 10),
        (T0, 2, "h2", "p2", "n2", "zz", 10),
        (T0, 3, "h3", None, "n3", "b3", None),
        (T0, 4, "h4", "p4", "n4", "b4", 10),
        (T0, 6, "h6", "p6", "n6", "b6", 10),      # right-only → never reported
    ])
    j = D.dataset_diff(a, b, "block", "2024-01-01 00:00:00", "2024-01-01 01:00:00")
    got = {r.a_blknum: (r.is_same, r.is_diff, r.reason) for r in j.collect()}
    assert got == {1: (True, False, None), 2: (False, True, "unknown"), 3: (True, False, None),
                   4: (False, False, None), 5: (False, True, "parent_hash")}
    s = D.diff_summary(j).first()
    assert (s.same, s.diff) == (2, 2)


def test_trace_reward_and_create2(spark):
    cols = "block_timestamp timestamp_ntz, blknum long, txhash string, txpos long, trace_address string, trace_type string, error string"
    a = spark.createDataFrame([(T0, 1, "t", 0, "", "create", None), (T0, 1, "t", 0, "0", "reward", None),
                               (T0, 1, "t", 0, "1", None, None), (T0, 1, "t", 0, "2", "call", "x")], cols)
    b = spark.createDataFrame([(T0, 1, "t", 0, "", "create2", None), (T0, 1, "t", 0, "2", "call", "y")], cols)
    j = D.dataset_diff(a, b, "trace", "2024-01-01 00:00:00", "2024-01-01 01:00:00")
    got = {r.a_trace_address: (r.is_same, r.is_diff, r.reason) for r in j.collect()}
    # reward and NULL types dropped; create2 == create; error differs but is not compared
    assert got == {"": (True, False, None), "2": (True, False, None)}


def test_detail_keeps_every_difference_of_a_slice(spark):
    n = 10_500  # all in one hourly slice
    ids = spark.range(n)
    side = lambda gas: ids.selectExpr("timestamp_ntz '2024-01-01 00:10:00' AS block_timestamp", "id AS blknum",
                                      "concat('h', id) AS blkhash", "'p' AS parent_hash", "'n' AS nonce", "'b' AS logs_bloom",
                                      f"cast({gas} AS long) AS gas_used")
    j = D.dataset_diff(side(1), side(2), "block", "2024-01-01 00:00:00", "2024-01-01 01:00:00")
    d = D.diff_detail(j)
    assert d.count() == n
    assert d.select("a_blknum").distinct().count() == n


def test_digest_first_equals_the_plain_join(spark):
    rows = []
    for k in range(300):
        at = T0 + timedelta(minutes=7 * k)
        rows.append((at, k, None if k % 50 == 7 else f"h{k}", None if k % 9 == 0 else f"p{k}", f"n{k}", "b", k))
    changed = [(*r[:6], -5) if r[1] in (3, 150) else r for r in rows if r[1] not in (40, 41)] + [(T0, 9999, "h", "p", "n", "b", 1)]
    keyless = (T0 + timedelta(hours=20), None, "h", "p", "n", "b", 1)
    end = "2024-01-03 00:00:00"
    for left, right in ((rows, changed), (rows, rows), ([*rows, keyless], [*rows, keyless]), (rows, rows[:0])):
        a, b = _blocks(spark, left), _blocks(spark, right)
        plain = D.dataset_diff(a, b, "block", "2024-01-01 00:00:00", end)
        fast = D.digest_diff(a, b, "block", "2024-01-01 00:00:00", end, buckets=4)
        key = lambda df: sorted(map(tuple, df.collect()), key=str)
        assert key(fast.summary().select("slice_start", "same", "diff")) == key(D.diff_summary(plain))
        assert key(D.diff_detail(fast.rows)) == key(D.diff_detail(plain))
        assert key(D.diff_reasons(fast.rows)) == key(D.diff_reasons(plain))
    assert D.digest_diff(_blocks(spark, rows), _blocks(spark, rows), "block", "2024-01-01 00:00:00", end).rows.count() == 0
