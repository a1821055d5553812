"""Dataset-diff queries: {blocks, txs, traces, logs} × {summary, detail, reasons}.

Time bounds come from the table and cover all of it; slices are one hour as in the reference.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chainframe.operators import diff as D
from chainframe.plans.registry import query
from chainframe.plans.sqltext import conform_select, duck_type
from chainframe.sources import fixtures as FX

# (spec, left fixture, right fixture, columns each fixture has)
CASES = {
    "blocks": (D.BLOCK, "blocks_a", "blocks_b",
               ("block_timestamp", "blknum", "blkhash", "parent_hash", "nonce", "logs_bloom", "miner",
                "gas_limit", "gas_used", "tx_count")),
    "txs": (D.TX, "txs_a", "txs_b",
            ("block_timestamp", "blknum", "txhash", "txpos", "nonce", "from_address", "to_address",
             "value", "receipt_gas_used", "receipt_effective_gas_price", "receipt_status")),
    "traces": (D.TRACE, "traces_a", "traces_b",
               ("block_timestamp", "blknum", "txhash", "txpos", "from_address", "to_address", "value",
                "trace_address", "trace_type", "call_type", "subtraces", "error", "status")),
    "logs": (D.LOG, "logs_a", "logs_b",
             ("block_timestamp", "blknum", "txhash", "txpos", "logpos", "address", "n_topics", "topics",
              "data", "topics_0")),
}


def joined(spark, sf_dir, case):
    spec, fa, fb, _ = CASES[case]
    memo: dict = {}
    a = FX.load(spark, sf_dir, fa, memo)
    b = FX.load(spark, sf_dir, fb, memo)
    return D.dataset_diff(a, b, spec, *D.whole_slices(a))


# ---- oracle text: the reference's same/diff/CASE semantics written as plain SQL ----------

def _lit(v) -> str:
    return f"'{v}'" if isinstance(v, str) else str(v)


def _oracle_ab(case: str) -> str:
    spec, fa, fb, have = CASES[case]
    types = {f.name: f.dataType for f in spec.schema.fields}
    wanted = (spec.ts_col,) + spec.columns
    side_filter = "block_timestamp IS NOT NULL" + " AND trace_type <> 'reward'" * (spec.kind == "trace")
    aaa = f"SELECT * FROM ({conform_select(fa, have, spec.schema, wanted)}) WHERE {side_filter}"
    bbb = f"SELECT * FROM ({conform_select(fb, have, spec.schema, wanted)}) WHERE {side_filter}"
    proj = ["a.block_timestamp AS a_block_timestamp", "b.block_timestamp AS b_block_timestamp"]
    for c in spec.columns:
        for s in ("a", "b"):
            expr = f"{s}.{c}"
            if c in spec.sentinels:
                sen = spec.sentinels[c]
                if duck_type(types[c]) == "VARCHAR":
                    sen = f"'{sen}'"
                else:
                    sen = f"CAST({sen} AS {duck_type(types[c])})"
                if c == "trace_type":
                    expr = f"CASE {expr} WHEN 'create2' THEN 'create' ELSE COALESCE({expr}, {sen}) END"
                else:
                    expr = f"COALESCE({expr}, {sen})"
            proj.append(f"{expr} AS {s}_{c}")
    on = " AND ".join(f"a.{k} = b.{k}" for k in (spec.ts_col,) + spec.keys)
    same = " AND ".join(f"a_{c} = b_{c}" for c in spec.compare)
    diff = " OR ".join(f"a_{c} <> b_{c}" for c in spec.compare)
    case_ = " ".join(f"WHEN a_{c} <> b_{c} THEN '{c}'" for c in spec.reasons)
    return f"""WITH aaa AS ({aaa}), bbb AS ({bbb}),
ab AS (SELECT {', '.join(proj)} FROM aaa a LEFT JOIN bbb b ON {on}),
cls AS (SELECT time_bucket(INTERVAL '1 hour', a_block_timestamp, TIMESTAMP '1970-01-01') AS slice_start, *,
  COALESCE({same}, false) AS is_same, COALESCE({diff}, false) AS is_diff,
  CASE {case_} ELSE 'unknown' END AS reason FROM ab)
"""


def _oracle_summary(case):
    return _oracle_ab(case) + """SELECT slice_start, CAST(count(*) FILTER (WHERE is_same) AS BIGINT) AS same,
  CAST(count(*) FILTER (WHERE is_diff) AS BIGINT) AS diff FROM cls GROUP BY slice_start"""


def _oracle_detail(case):
    return _oracle_ab(case) + "SELECT * EXCLUDE (is_same, is_diff) FROM cls WHERE is_diff"


def _oracle_reasons(case):
    return _oracle_ab(case) + """SELECT slice_start, reason, CAST(count(a_blknum) AS BIGINT) AS count
FROM cls WHERE is_diff GROUP BY slice_start, reason"""


def _register(case: str):
    fixtures = (CASES[case][1], CASES[case][2])

    @query(f"diff_{case}_summary", _oracle_summary(case), fixtures)
    def _summary(spark, sf_dir):
        return D.diff_summary(joined(spark, sf_dir, case))

    @query(f"diff_{case}_detail", _oracle_detail(case), fixtures)
    def _detail(spark, sf_dir):
        return D.diff_detail(joined(spark, sf_dir, case))

    @query(f"diff_{case}_reasons", _oracle_reasons(case), fixtures)
    def _reasons(spark, sf_dir):
        return D.diff_reasons(joined(spark, sf_dir, case))


    @query(f"diff_{case}_digest", _oracle_summary(case), fixtures)
    def _digest(spark, sf_dir):
        """The summary, digest first: only buckets that differ are joined."""
        spec, fa, fb, _ = CASES[case]
        memo: dict = {}
        a, b = FX.load(spark, sf_dir, fa, memo), FX.load(spark, sf_dir, fb, memo)
        return D.digest_diff(a, b, spec, *D.whole_slices(a)).summary()


for _c in CASES:
    _register(_c)


@query("scan_blocks", """SELECT block_timestamp, blknum, blkhash, miner, gas_used
FROM blocks_a WHERE block_timestamp >= TIMESTAMP '1990-01-01' AND block_timestamp < TIMESTAMP '2010-01-01'""",
       ("blocks_a",))
def scan_blocks(spark, sf_dir):
    """Scan a chain table with a half-open time range (pushed to the parquet scan)."""
    b = FX.load(spark, sf_dir, "blocks_a")
    ts = F.col("block_timestamp")
    return b.filter((ts >= F.lit("1990-01-01").cast("timestamp_ntz")) & (ts < F.lit("2010-01-01").cast("timestamp_ntz"))) \
        .select("block_timestamp", "blknum", "blkhash", "miner", "gas_used")


@query("diff_csv_roundtrip", _oracle_ab("blocks") + """SELECT strftime(slice_start, '%Y%m%d%H%M%S') || '-'
  || strftime(slice_start + INTERVAL 1 HOUR, '%Y%m%d%H%M%S') AS slice, a_blknum, reason FROM cls WHERE is_diff""",
       ("blocks_a", "blocks_b"))
def diff_csv_roundtrip(spark, sf_dir):
    """S3: the block diff detail written as one CSV folder per slice (header on) under the
    shared checkpoint folder, then read back."""
    import uuid

    from chainframe.session import scratch_path

    path = scratch_path(spark, f"diff_csv/{uuid.uuid4().hex}")
    D.write_diff_csv(D.diff_detail(joined(spark, sf_dir, "blocks")), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col("slice").cast("string").alias("slice"), F.col("a_blknum").cast("long").alias("a_blknum"), "reason")
