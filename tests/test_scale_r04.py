"""Findings of round 4: rows that were shuffled and stored again and again."""

import datetime as dt
import random

from chainframe.functions import u256 as U
from chainframe.operators import balances as BL

T0 = dt.datetime(2024, 1, 1)
XFER = "block_timestamp timestamp_ntz, blknum long, txhash string, token_address string, from_address string, to_address string, value string"


def _history(rows) -> list:
    """Running totals at each block, by plain Python; none without a token or a block."""
    moves: dict = {}
    for r in rows:
        n = int(r[6] or 0) if len(r[6] or "") <= U.WIDTH else 0
        for a, into in ((r[4], 0), (r[5], 1)):
            if a is not None:
                moves.setdefault((a, r[3]), {}).setdefault(r[1], []).append((into, n if into else -n))
    out = []
    for (a, t), blocks in moves.items():
        outs = ins = value = 0
        for b in sorted(blocks, key=lambda x: (x is not None, x)):
            ins += sum(into for into, _ in blocks[b])
            outs += sum(1 - into for into, _ in blocks[b])
            value += sum(v for _, v in blocks[b])
            out.append((a, t, b, *((None,) * 3 if t is None or b is None else (outs, ins, str(value)))))
    return sorted(out, key=repr)


def _final_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_balance_history_shuffles_its_rows_once_and_stores_none(spark, monkeypatch):
    rnd = random.Random(4)
    values = ["0", "1", "+5", "-7", None, "", "007", str(2**256 - 1), str(10**18), "9" * 90, "1" * 91, "123" + "0" * 42]
    hexed = ["0x" + f"{i:040x}" for i in range(30)]
    rows = [(T0, rnd.choice([None, *range(40)]), f"t{i}", rnd.choice(["0xaa", "0xAA", "", "tok", None]), hexed[0] if i % 3 else rnd.choice([*hexed, None, "x", ""]),
             rnd.choice([*hexed, None, "é"]), rnd.choice(values)) for i in range(900)]
    rows += [(T0, 7, f"s{i}", "0xaa", hexed[1], hexed[1], "3") for i in range(5)]
    df, want, stored = spark.createDataFrame(rows, XFER), _history(rows), []
    monkeypatch.setattr(BL, "stored", lambda out, name: stored.append(name) or out)
    for most, hot in ((BL.HOT_BYTES, False), (15_000, True), (0, True)):  # no key is hot, one address's are, all are
        monkeypatch.setattr(BL, "HOT_BYTES", most)
        out = BL.balance_history(df, width=6)
        assert sorted(map(tuple, out.collect()), key=repr) == want
        assert ("LeftSemi" in _final_plan(out)) == hot
        if not hot:
            assert _final_plan(out).count("Exchange hashpartitioning(") == 1  # formerly three, after what was stored
        assert "isnotnull(coalesce(" not in out._jdf.queryExecution().toString()  # a filter that keeps equal shuffles of the input apart
    assert not stored  # formerly block-stats
