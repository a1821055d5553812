"""Findings of round 3: steps that were copied into each other, kept whole or dealt by one key."""

import contextlib
import datetime as dt
import io

from pyspark.sql import functions as F

from chainframe.functions import evm as E
from chainframe.functions import u256 as U
from chainframe.operators import derive as DV

T0 = dt.datetime(2024, 1, 1)
LOGS = ("block_timestamp timestamp_ntz, blknum long, txhash string, txpos long, logpos int, address string, n_topics int, topics string, data string")


def _plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def _word(v: int) -> str:
    return f"{v:064x}"


def _batch(n: int, ids, values) -> str:
    return _word(64) + _word(64 + 32 * (n + 1)) + _word(n) + "".join(map(_word, ids)) + _word(n) + "".join(map(_word, values))


def _topics(*t) -> str:
    return "[" + ",".join(t) + "]"


def test_erc1155_payload_steps_are_not_copied_into_a_filter(spark):
    topics = _topics(E.TRANSFER_BATCH_TOPIC, *["0x" + "0" * 24 + c * 40 for c in "abc"])
    big = [2**256 - 1, 2**200 + 7, 2**64, 2**63, 2**64 - 1, 0]
    rows = [(T0, 1, "t0", 0, 0, "0xc", 4, topics, "0x" + _batch(6, big, range(6))),
            (T0, 1, "t1", 0, 0, "0xc", 4, topics, "0x" + _word(64)), (T0, 1, "t2", 0, 0, None, 4, topics, None),
            (T0, 1, "t3", 0, 0, "0xd", 4, topics, "0x" + _batch(1, [5], [6]) + "é" * 3)]
    logs = spark.createDataFrame(rows, LOGS)
    logs = logs.withColumn("data", F.concat(F.lower(F.substring("data", 1, 2)), F.expr("substring(data, 3)")))
    rejects = DV.erc1155_rejects(logs)
    assert sorted(map(tuple, rejects.collect()), key=repr) == sorted([("0xc", 1), (None, 1)], key=repr)
    x = DV.erc1155_transfers(logs)
    got = sorted((r.txhash, r.id_pos, r.id_cnt, r.token_id, r.value) for r in x.collect())
    assert got == [("t0", i, 6, str(v), str(i)) for i, v in enumerate(big)] + [("t3", 0, 1, "5", "6")]
    assert _plan(rejects).count("conv(") <= 16  # formerly 24
    assert "regexp_extract_all" not in _plan(rejects)


def test_topics_split_as_before(spark):
    t = E.TRANSFER_TOPIC
    texts = ["", "[", "]", "[]", "[a,b]", "a,b", "[a,b", "a,b]", "[a,]", "[[a]]", ",", "[,]", "[a]\n", "a]\n", None, t, f"[{t}]", f"[{t},x]", f"{t},x", f"[{t}x]"]
    df = spark.createDataFrame([(x,) for x in texts], "topics string")
    body = F.regexp_replace(F.regexp_replace("topics", r"^\[", ""), r"\]$", "")
    old = F.when(F.col("topics").isNull(), None).when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, ","))
    for r in df.select("topics", E.split_topics(F.col("topics")).alias("new"), old.alias("old"), DV._first_topic_is(F.col("topics"), t).alias("is")).collect():
        assert r.new == r.old and r["is"] == (None if r.topics is None else r.old[:1] == [t])


def test_clean_words_need_no_regular_expression(spark):
    values = [0, 1, 2**63, 2**64 - 1, 2**64, 2**123, 2**124, 2**256 - 1]
    texts = [f(v) for v in values for f in (lambda v: f"{v:064x}", lambda v: f"{v:064X}", lambda v: f"0x{v:x}")]
    odd = ["g" * 64, "0" * 63 + "g", " " + "0" * 63, "", "0x", None, "0" * 65]
    df = spark.createDataFrame([(x,) for x in [*texts, *odd]], "h string")
    assert [r[0] for r in df.select(U.hex_to_u256("h")).collect()] == [str(v) for v in values for _ in range(3)] + [None, None, "0", None, None, None, None]


def test_limbs_are_carried_once_a_number(spark):
    b, rows = U.BASE, []
    for v in (0, 1, -1, b, -b, b * b - 1, 1 - b * b, b * b, 10**37 - 1, 1 - 10**37, U.MAX_U256, -U.MAX_U256, 7 * U.MAX_U256):
        rows.append((str(v), *[(abs(v) // b**k % b) * (1 if v >= 0 else -1) for k in range(5)]))
    rows += [(str(3 * b**4 - 5 * b + 10**36), 10**36, -5, 0, 0, 3), (str(-b - 1 + 2), 1, -1, 0, 0, 0), (str(b**2 * -1 + 9 * b * b), 9 * 10**36, 0, -1, 0, 0), (None, None, 1, 2, 3, 4)]
    df = spark.createDataFrame([tuple(None if x is None else str(x) for x in r) for r in rows], "v string, l0 string, l1 string, l2 string, l3 string, l4 string")
    df = df.select("v", *[F.col(f"l{k}").cast(U.DEC) for k in range(5)])
    out = df.select("v", U.limbs_to_string([f"l{k}" for k in range(5)]).alias("s"))
    assert all(r.v == r.s for r in out.collect())
    assert _plan(out.select("s")).count("aggregate(") <= 2  # once for either sign; formerly 8


def test_diff_csv_has_one_file_a_slice(spark, tmp_dir):
    import glob

    from chainframe.operators import diff as D

    rows = spark.range(4000).repartition(8).select(
        F.timestamp_add("HOUR", F.pmod("id", F.lit(40)).cast("int"), F.lit(T0).cast("timestamp_ntz")).alias("slice_start"),
        F.col("id").alias("a_blknum"), F.lit("nonce").alias("reason"))
    D.write_diff_csv(rows, tmp_dir + "/csv")
    assert len(glob.glob(tmp_dir + "/csv/*/*.csv")) == 40  # formerly a file from every task
    assert spark.read.option("header", True).csv(tmp_dir + "/csv").count() == 4000


def test_selectors_join_as_a_table(spark):
    code = ["0x6318160ddd00", "0x63a9059cbb00", None]
    cs = spark.createDataFrame([(f"0x{i}", code[0] if i % 3 else code[1 + i % 2]) for i in range(60)], "address string, bytecode string")
    out = DV.classify_contracts(cs)
    assert "EvalPython" not in _plan(out)  # an aggregate and a walk between shuffle and join kept a hot code in one task
    got = {r.address: r.func_sighashes for r in out.collect()}
    assert len(got) == 60 and got["0x1"] == "0x18160ddd" and got["0x0"] == "0xa9059cbb" and got["0x3"] is None


XFER = "block_timestamp timestamp_ntz, blknum long, txhash string, token_address string, from_address string, to_address string, value string"
TRACE = "block_timestamp timestamp_ntz, blknum long, txhash string, is_coinbase boolean, is_in boolean, pxhash string, vout_idx int, address string, value long"


def _stats(rows, key) -> dict:
    """Per key and role: blocks, txs, xfers, value, first and last time and block, by plain Python."""
    out: dict = {}
    for r in rows:
        out.setdefault(key(r), []).append(r)
    return {k: (len({r["b"] for r in v} - {None}), len({(r["b"], r["x"]) for r in v if r["x"] is not None}), len(v), str(sum(int(r["v"] or 0) for r in v)),
                min((r["b"] for r in v if r["b"] is not None), default=None), max((r["b"] for r in v if r["b"] is not None), default=None)) for k, v in out.items()}


def _of(got, role) -> tuple:
    return tuple(got[f"{role}_{c}"] for c in ("blocks", "txs", "xfers", "value", "1th_blknum", "nth_blknum"))


def test_token_balances_keep_no_transaction_in_a_hash_map(spark):
    import random

    from chainframe.operators import balances as BL

    rnd = random.Random(3)
    values = ["0", "1", "+5", "-7", None, str(2**256 - 1), str(10**18), str(10**9 - 1), "9" * 90, "1" * 91]
    rows = [(T0 + dt.timedelta(hours=i % 50), rnd.choice([None, 1, 2, 3, 70]), rnd.choice([None, "a", "b", f"t{i}"]), rnd.choice(["k", "l", None]),
             rnd.choice(["x", "y", None]), rnd.choice(["x", "z"]), rnd.choice(values)) for i in range(600)]
    df = spark.createDataFrame(rows, XFER)
    out = BL.token_balances(df)
    want = _stats([{"a": r[c], "t": r[3], "role": role, "b": r[1], "x": r[2], "v": None if r[6] and len(r[6]) > 90 else r[6]} for r in rows for role, c in (("out", 4), ("vin", 5)) if r[c]],
                  lambda r: (r["a"], r["t"], r["role"]))
    got = {(r.address, r.token_address): r for r in out.collect()}
    assert set(got) == {k[:2] for k in want}
    for (a, t), r in got.items():
        for role in ("out", "vin"):
            assert _of(r, role) == want.get((a, t, role), (0, 0, 0, "0", None, None))
        assert int(r.value) == int(r.vin_value) - int(r.out_value)
    keys = [l for l in _plan(out).splitlines() if l.startswith("Keys")]
    assert keys and not any("txhash" in k or "blknum" in k for k in keys)  # formerly in six of ten
    dealt = _plan(BL.token_balances(df.repartition(4, "blknum")).drop("decimals"))
    assert dealt.count("hashpartitioning(") == 2  # by block, by address and token; formerly two more


def test_packed_text_is_one_to_one(spark):
    from chainframe.operators import utxo as UT

    texts = [None, "", "0x", "0", "0x0", "0x00", "0xab", "0xAB", "0Xab", "ab", "\x00ab", "0xag", "0x" + "0f" * 32, "0x" + "0f" * 31 + "0F", "bc1q", "é", "0xé", "1;2"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", UT.packed(F.col("t")).alias("p"), UT.unpacked(UT.packed(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u for r in rows) and len({None if r.p is None else bytes(r.p) for r in rows}) == len(texts)
    assert len(next(r.p for r in rows if r.t == "0x" + "0f" * 32)) == 33


def test_utxo_links_shuffle_bytes_dealt_by_transaction(spark):
    from chainframe.operators import utxo as UT

    h = lambda i: None if i == 99 else f"0x{i:064x}"
    rows = [(T0, i % 7, h(i), i % 3 == 0 if i % 11 else None, False, None, k, None if (i + k) % 13 == 0 else f"0x{(i + k) % 5:040x}" if k % 2 else "bc1", 10 * i + k)
            for i in [*range(40), 3, 99] for k in [0, 1, 63, 64, 200]]
    rows += [(T0, i % 9, h(i), False, True, p, k, None, 0) for i in range(40) for p, k in ((h(i - 1) if i else None, i % 2), (h(i + 2), 64), ("gone", 0), (h(i + 2), 65), (h(i), None))]
    df = spark.createDataFrame(rows, TRACE)
    spent = {(r[5], r[6]) for r in rows if r[4] and None not in r[5:7]}
    left = UT.utxo_set(df).select("txhash", "vout_idx", "address", "value")
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, left.collect()), key=key) == sorted(((r[2], r[6], r[7], r[8]) for r in rows if not r[4] and (r[2], r[6]) not in spent), key=key)
    moves = [{"a": r[7], "role": "cnb" if r[3] else "vin", "b": r[1], "x": r[2], "v": r[8]} for r in rows if not r[4] and r[3] is not None and r[7] is not None]
    moves += [{"a": o[7], "role": "out", "b": i[1], "x": i[2], "v": o[8]} for i in rows if i[4] and i[5] and i[6] is not None for o in rows if not o[4] and (o[2], o[6]) == (i[5], i[6]) and o[7]]
    want = _stats(moves, lambda r: (r["a"], r["role"]))
    got = {r.address: r for r in UT.balances(df).collect()}
    assert set(got) == {a for a, _ in want}
    for a, r in got.items():
        assert all(_of(r, role) == want.get((a, role), (0, 0, 0, "0", None, None)) for role in ("out", "vin", "cnb"))
        assert int(r.value) == int(r.cnb_value) + int(r.vin_value) - int(r.out_value)
    dealt = [l for l in _plan(UT.utxo_set(df)).splitlines() if "hashpartitioning(" in l]
    assert len(dealt) == 2 and all("shiftright(" in l for l in dealt)  # formerly by hash text and output


def test_large_fixture_joins_are_dealt_by_rows(spark, tmp_dir, monkeypatch):
    from chainframe.sources import fixtures as FX

    orders = spark.range(100).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "IF(id % 3 = 0, 'P', 'F') AS o_orderstatus", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS o_orderdate")
    lines = spark.range(900).selectExpr("IF(id % 50 = 9, NULL, id % 120) AS l_orderkey", "id % 31 AS l_partkey", "id % 5 AS l_suppkey", "CAST(id % 4 AS INT) AS l_linenumber",
                                        "CAST(id AS DOUBLE) AS l_extendedprice", "TIMESTAMP_NTZ '2024-01-02 00:00:00' AS l_shipdate")
    orders.write.parquet(tmp_dir + "/orders.parquet")
    lines.write.parquet(tmp_dir + "/lineitem.parquet")
    for name in ("token_xfers", "btc_traces"):
        monkeypatch.setattr(FX, "ROWS_A_TASK", 250_000)
        few = FX.load(spark, tmp_dir, name)
        monkeypatch.setattr(FX, "ROWS_A_TASK", 90)
        many = FX.load(spark, tmp_dir, name)
        assert "REPARTITION_BY_NUM" in _plan(many) and "REPARTITION_BY_NUM" not in _plan(few)  # formerly never
        assert sorted(map(repr, many.collect())) == sorted(map(repr, few.collect()))
