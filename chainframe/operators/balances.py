"""Address balances and activity statistics (token and native), latest and historical.

Plan shape (no ``count(DISTINCT …)`` Expand, no per-address task):

    role fan-out (explode out/vin[/cnb/fee])
      → window (block, address, token, role) by txhash  marks the first row of a block and of a tx
      → group (address, token)                          counts, sums, first and last of each role
      → carry pass → exact decimal strings

The window holds the rows of one address in one block, and needs no shuffle of its own where the
input is dealt by block. Marks, counts and sums are algebraic, so Spark combines them map-side
before the one shuffle, and an address holding a third of all transfers costs one row per task.
Sums are kept as ten longs a role (``U.to_parts``). No hash map has a transaction or a block as its
key: those are almost unique, and would keep nearly every row of a task.

Streaming stores per-transaction partials (``tx_partials``), which later loads can add to.

``value = vin - out`` (tokens) and ``cnb + vin - out - fee`` (native) are exact signed
256-bit results. ``balance`` (fetched from a node) is not computed here and stays NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainframe.functions import u256 as U
from chainframe.functions.evm import packed, unpacked
from chainframe.operators.windows import bucketed_running_sum
from chainframe.session import stored

NL = U.NLIMBS


def _epoch_s(ts: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts).cast("int")


def _fan_out(df: DataFrame, roles: dict[str, str], keys: list[str]) -> DataFrame:
    """One row per (transfer, role): address = the role's column."""
    arr = F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("address")) for r, c in roles.items()])
    base = [c for c in {*keys, "blknum", "txhash", "block_timestamp", "value"} if c in df.columns]
    return df.select(*base, F.explode(arr).alias("__r")).select(*base, "__r.role", "__r.address") \
        .filter(F.col("address").isNotNull())


def tx_partials(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(address, *keys, role, blknum, txhash) partials of role rows: the number of transfers
    ``n``, limb sums ``v<k>`` and first and last time. Partials of any split of the input add up,
    so they can be stored and merged."""
    limbs = U.to_limbs(F.col("value"))
    flat = rows.select("address", *keys, "role", "blknum", "txhash", "block_timestamp",
                       *[F.coalesce(l, F.lit(0).cast(U.DEC)).alias(f"__v{k}") for k, l in enumerate(limbs)])
    return flat.groupBy("address", *keys, "role", "blknum", "txhash").agg(
        F.count(F.lit(1)).alias("n"), F.min("block_timestamp").alias("t1"), F.max("block_timestamp").alias("tn"),
        *[F.sum(f"__v{k}").cast(U.DEC).alias(f"v{k}") for k in range(NL)])


def merge_partials(partials: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (address, *keys, role, blknum, txhash) of partials that several loads hold."""
    return partials.groupBy("address", *keys, "role", "blknum", "txhash").agg(
        F.sum("n").alias("n"), F.min("t1").alias("t1"), F.max("tn").alias("tn"),
        *[F.sum(f"v{k}").cast(U.DEC).alias(f"v{k}") for k in range(NL)])


def block_stats(partials: DataFrame, keys: list[str]) -> DataFrame:
    """(address, *keys, role, blknum): blocks (1, or 0 without a number), txs, xfers, limb sums,
    times."""
    return partials.groupBy("address", *keys, "role", "blknum").agg(
        F.count("txhash").alias("txs"), F.sum("n").alias("xfers"), F.min("t1").alias("t1"), F.max("tn").alias("tn"),
        *[F.sum(f"v{k}").cast(U.DEC).alias(f"v{k}") for k in range(NL)]) \
        .withColumn("blocks", F.when(F.col("blknum").isNotNull(), 1).otherwise(0))


def _totals(partials: DataFrame, keys: list[str], roles: list[str]) -> DataFrame:
    by_role = block_stats(partials, keys).groupBy("address", *keys, "role").agg(
        *[F.sum(m).alias(m) for m in ("blocks", "txs", "xfers")], F.min("t1").alias("t1"), F.max("tn").alias("tn"),
        F.min("blknum").alias("b1"), F.max("blknum").alias("bn"), *[F.sum(f"v{k}").cast(U.DEC).alias(f"v{k}") for k in range(NL)])
    aggs = [F.max("bn").alias("blknum")]
    for r in roles:
        mine = lambda c: F.max(F.when(F.col("role") == r, F.col(c)))  # noqa: E731, B023  one row a role
        aggs += [F.coalesce(mine(m), F.lit(0)).alias(f"{r}_{m}") for m in ("blocks", "txs", "xfers")]
        aggs += [F.coalesce(mine(f"v{k}"), F.lit(0).cast(U.DEC)).alias(f"__{r}_v{k}") for k in range(NL)]
        aggs += [mine("t1").alias(f"__{r}_t1"), mine("tn").alias(f"__{r}_tn"),
                 mine("b1").alias(f"{r}_1th_blknum"), mine("bn").alias(f"{r}_nth_blknum")]
    return by_role.groupBy("address", *keys).agg(*aggs)


def first_seen(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Role rows with ``new_block`` and ``new_tx``: 1 on one row of each block and of each
    transaction that (address, *keys, role) has, else 0."""
    # rows without a block number are no block: their transactions are dealt by hash
    spread = F.when(F.col("blknum").isNull(), F.pmod(F.xxhash64("txhash"), F.lit(1024)))
    w = Window.partitionBy("blknum", "address", *keys, "role", spread).orderBy("txhash")
    one = lambda c: F.when(c, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    return rows.select("address", *keys, "role", "blknum", "block_timestamp", "value",
                       one(F.col("blknum").isNotNull() & (F.row_number().over(w) == 1)).alias("new_block"),
                       one(F.col("txhash").isNotNull() & ~F.col("txhash").eqNullSafe(F.lag("txhash").over(w))).alias("new_tx"))


def activity(seen: DataFrame, keys: list[str], roles: list[str]) -> DataFrame:
    """One row per (address, *keys) of ``first_seen`` rows, with each role's counts, sums, first and last."""
    parts = [f"__p{k}" for k in range(2 * NL)]
    flat = seen.select("address", *keys, "role", "blknum", "block_timestamp", "new_block", "new_tx",
                       *[p.alias(c) for c, p in zip(parts, U.to_parts(F.col("value")))])
    aggs = [F.max("blknum").alias("blknum")]
    for r in roles:
        mine = lambda c: F.when(F.col("role") == r, F.col(c))  # noqa: E731, B023  used at once
        aggs += [F.sum(mine("new_block")).alias(f"{r}_blocks"), F.sum(mine("new_tx")).alias(f"{r}_txs"), F.count_if(F.col("role") == r).alias(f"{r}_xfers"),
                 *[F.sum(mine(c)).alias(f"__{r}{c}") for c in parts],
                 F.min(mine("block_timestamp")).alias(f"__{r}_t1"), F.max(mine("block_timestamp")).alias(f"__{r}_tn"),
                 F.min(mine("blknum")).alias(f"{r}_1th_blknum"), F.max(mine("blknum")).alias(f"{r}_nth_blknum")]
    g, zero, cols = flat.groupBy("address", *keys).agg(*aggs), F.lit(0).cast("long"), ["address", *keys, "blknum"]
    for r in roles:
        limbs = U.limbs_of_parts([F.coalesce(F.col(f"__{r}{c}"), zero) for c in parts])
        cols += [*[F.coalesce(F.col(f"{r}_{m}"), zero).alias(f"{r}_{m}") for m in ("blocks", "txs", "xfers")], *[v.alias(f"__{r}_v{k}") for k, v in enumerate(limbs)],
                 f"__{r}_t1", f"__{r}_tn", f"{r}_1th_blknum", f"{r}_nth_blknum"]
    return g.select(*cols)


def balances_of(partials: DataFrame, keys: list[str], roles: list[str], plus: list[str], minus: list[str]) -> DataFrame:
    """Latest balances and activity from per-transaction partials (one row per transaction)."""
    return balance_columns(_totals(partials, keys, roles), keys, roles, plus, minus)


def balance_columns(totals: DataFrame, keys: list[str], roles: list[str], plus: list[str], minus: list[str]) -> DataFrame:
    """Balances, times and counts of ``activity`` (or of stored partials' totals)."""
    cols = [F.col("address"), *[F.col(k) for k in keys], F.col("blknum")]
    for r in roles:
        cols += [F.col(f"{r}_blocks").cast("long"), F.col(f"{r}_txs").cast("long"), F.col(f"{r}_xfers").cast("long"),
                 U.limbs_to_string([F.col(f"__{r}_v{k}") for k in range(NL)]).alias(f"{r}_value"),
                 _epoch_s(F.col(f"__{r}_t1")).alias(f"{r}_1th_st"), _epoch_s(F.col(f"__{r}_tn")).alias(f"{r}_nth_st"),
                 F.col(f"{r}_1th_blknum"), F.col(f"{r}_nth_blknum"),
                 F.to_date(F.col(f"__{r}_t1")).alias(f"{r}_1th_st_day"), F.to_date(F.col(f"__{r}_tn")).alias(f"{r}_nth_st_day")]
    net = [sum((F.col(f"__{r}_v{k}") for r in plus), F.lit(0).cast(U.DEC)) -
           sum((F.col(f"__{r}_v{k}") for r in minus), F.lit(0).cast(U.DEC)) for k in range(NL)]
    cols.append(U.limbs_to_string(net).alias("value"))
    return totals.select(*cols)


def _token_rows(xfers: DataFrame) -> DataFrame:
    return _fan_out(xfers, {"out": "from_address", "vin": "to_address"}, ["token_address"])


def token_partials(xfers: DataFrame) -> DataFrame:
    return tx_partials(_token_rows(xfers), ["token_address"])


def token_balances(xfers: DataFrame, tokens: DataFrame | None = None, *, upto: int | None = None) -> DataFrame:
    """Latest token balance and activity per (address, token_address).

    ``blknum`` is the checkpoint (last block seen); ``upto`` restricts to blocks ≤ upto."""
    if upto is not None:
        xfers = xfers.filter(F.col("blknum") <= upto)
    keys, roles = ["token_address"], ["out", "vin"]
    out = balance_columns(activity(first_seen(_token_rows(xfers), keys), keys, roles), keys, roles, ["vin"], ["out"])
    if tokens is not None:
        t = tokens.select(F.col("address").alias("__a"), F.col("decimals").cast("long").alias("decimals"))
        out = out.join(t, out["token_address"] == t["__a"], "left").drop("__a")
    else:
        out = out.withColumn("decimals", F.lit(None).cast("long"))
    return out.withColumn("balance", F.lit(None).cast("string"))


NATIVE_ROLES = ["out", "vin", "cnb", "fee"]
NO_VALUE_CALLS = ("delegatecall", "callcode", "staticcall")


def native_roles(traces: DataFrame, txs: DataFrame) -> DataFrame:
    """Native value movements as (role, address, value) rows.

    Ours (the reference documents only the aggregates): value moves in successful traces
    that are not reward traces and not delegatecall/callcode/staticcall; ``cnb`` = reward
    traces' receiver; ``fee`` = gas used × effective gas price charged to the sender."""
    ok = (F.col("status") == 1)
    moving = ok & (F.col("trace_type") != "reward") & ~F.coalesce(F.col("call_type").isin(*NO_VALUE_CALLS), F.lit(False))
    t = traces.filter(moving)
    base = ["blknum", "txhash", "block_timestamp", "value"]
    out = t.select(*base, F.lit("out").alias("role"), F.col("from_address").alias("address"))
    vin = t.select(*base, F.lit("vin").alias("role"), F.col("to_address").alias("address"))
    cnb = traces.filter(F.col("trace_type") == "reward").select(*base, F.lit("cnb").alias("role"),
                                                                 F.col("to_address").alias("address"))
    fee = (F.col("receipt_gas_used").cast("decimal(38,0)") * F.col("receipt_effective_gas_price").cast("decimal(38,0)"))
    fees = txs.select("blknum", "txhash", "block_timestamp", fee.cast("decimal(38,0)").cast("string").alias("value"),
                      F.lit("fee").alias("role"), F.col("from_address").alias("address"))
    return out.unionByName(vin).unionByName(cnb).unionByName(fees).filter(F.col("address").isNotNull())


def native_balances(traces: DataFrame, txs: DataFrame) -> DataFrame:
    """A10: ``value = cnb + vin - out - fee`` per address, with per-role activity stats."""
    out = balance_columns(activity(first_seen(native_roles(traces, txs), []), [], NATIVE_ROLES), [], NATIVE_ROLES, ["cnb", "vin"], ["out", "fee"])
    keep = [c for c in out.columns if not c.startswith("fee_") or c == "fee_value"]
    return out.select(*keep).withColumn("balance", F.lit(None).cast("string"))


def fee_by_sender(txs: DataFrame) -> DataFrame:
    """Total gas fee paid per sender (fits DECIMAL(38,0))."""
    fee = F.col("receipt_gas_used").cast("decimal(38,0)") * F.col("receipt_effective_gas_price").cast("decimal(38,0)")
    return txs.groupBy("from_address").agg(F.sum(fee).cast("decimal(38,0)").cast("string").alias("fee_value"))


def _running(per_block: DataFrame, keys: list[str], cols: list[str], width: int) -> DataFrame:
    # the carry reads these rows a second time: store them instead of aggregating twice
    per_block = stored(per_block.select("address", *keys, "blknum", *cols), "block-stats")
    return bucketed_running_sum(per_block, ["address", *keys], "blknum", cols, width=width)


def _limbs(names: list[str]) -> list[Column]:
    return [F.col(c) for c in names]


#: a key's history is summed in one task while its rows, with those of the keys in its hash bucket, have fewer bytes
HOT_BYTES = 64 * 2 ** 20
KEY_BUCKETS = 65_536
#: stands for NULL among packed tokens, which have a byte at least: a key that can't be NULL gets no filters
NO_TOKEN = b""


def _moves(xfers: DataFrame) -> DataFrame:
    """One row per (transfer, side) in few bytes: packed address and token_address, ``move`` (1 for
    receipts or 0, then the value: 1 and two digits a byte, or 0 and its text) and blknum; ``__h`` is
    the hash bucket of (address, token_address)."""
    value = F.coalesce(F.col("value"), F.lit("0"))
    number = F.coalesce(F.concat(F.unhex(F.lit("01")), F.unhex(value)), F.concat(F.unhex(F.lit("00")), value.cast("binary")))
    t = xfers.select(packed(F.col("from_address")).alias("from_address"), packed(F.col("to_address")).alias("to_address"),
                     F.coalesce(packed(F.col("token_address")), F.lit(NO_TOKEN)).alias("token_address"), number.alias("__number"), "blknum")
    side = lambda c, tag: F.struct(F.col(c).alias("address"), F.concat(F.unhex(F.lit(tag)), F.col("__number")).alias("move"))
    rows = t.select("token_address", "blknum", F.explode(F.array(side("from_address", "00"), side("to_address", "01"))).alias("__r")) \
        .select("__r.address", "token_address", "__r.move", "blknum").filter(F.col("address").isNotNull())
    return rows.withColumn("__h", F.pmod(F.xxhash64("address", "token_address"), F.lit(KEY_BUCKETS)).cast("int"))


def _net_parts(rows: DataFrame) -> DataFrame:
    """Rows of ``_moves`` with ``inward`` and the signed value as long parts ``net<k>``."""
    body, zero = F.substring("move", 3, 2 ** 31 - 1), F.lit(0).cast("long")
    value = F.when(F.substring("move", 2, 1) == F.unhex(F.lit("01")), F.hex(body)).otherwise(body.cast("string"))
    rows = rows.select("address", "token_address", "blknum", (F.substring("move", 1, 1) == F.unhex(F.lit("01"))).alias("inward"), value.alias("value"))
    parts = [F.coalesce(p, zero) for p in U.to_parts(F.col("value"))]
    return rows.select("address", "token_address", "blknum", "inward",
                       *[F.when(F.col("inward"), p).otherwise(-p).alias(f"net{k}") for k, p in enumerate(parts)])


def balance_history(xfers: DataFrame, *, width: int = 1_000_000) -> DataFrame:
    """Running totals per (address, token) at every block where it changed.

    Rows are shuffled once, packed, to the task of their (address, token), which sorts and sums
    them; the last row of a block has the block's totals. Nothing is stored. Rows of hot keys, whose
    hash buckets hold over ``HOT_BYTES``, go another way: per-block sums, combined map-side, then
    bucketed running sums, so a hot key is split by ranges of ``width`` blocks. Which buckets are
    hot is counted first; their numbers are broadcast (at most all bytes / ``HOT_BYTES``)."""
    keys, parts = ["address", "token_address"], [f"net{k}" for k in range(2 * NL)]
    cols = ["out_xfers", "vin_xfers", *parts]
    rows = _moves(xfers)
    size = F.lit(128) + F.length("move")
    hot = F.broadcast(rows.groupBy("__h").agg(F.sum(size).alias("__bytes")).filter(F.col("__bytes") > HOT_BYTES).select(F.col("__h").alias("__hot")))
    is_hot = F.col("__h") == F.col("__hot")
    count = lambda into: F.count_if(F.col("inward") if into else ~F.col("inward"))

    cold = _net_parts(rows.join(hot, is_hot, "left_anti").drop("__h").repartition(*keys).sortWithinPartitions(*keys, "blknum"))
    w = Window.partitionBy(*keys).orderBy("blknum")  # up to the last row of the block
    ends = F.lead(F.lit(1)).over(w).isNull() | ~F.col("blknum").eqNullSafe(F.lead("blknum").over(w))
    cold = cold.select(*keys, "blknum", ends.alias("__ends"), count(False).over(w).alias("cum_out_xfers"), count(True).over(w).alias("cum_vin_xfers"),
                       *[F.sum(c).over(w).alias(f"cum_{c}") for c in parts]).filter("__ends").drop("__ends")

    per_block = _net_parts(rows.join(hot, is_hot, "left_semi")).groupBy(*keys, "blknum").agg(
        count(False).alias("out_xfers"), count(True).alias("vin_xfers"), *[F.sum(c).alias(c) for c in parts])
    split = bucketed_running_sum(per_block, keys, "blknum", cols, width=width).select(cold.columns)

    token = F.when(F.col("token_address") != F.lit(NO_TOKEN), F.col("token_address"))
    known = token.isNotNull() & F.col("blknum").isNotNull()  # rows without a token or block have no totals
    value = U.limbs_to_string(U.limbs_of_parts([f"cum_{c}" for c in parts]))
    return cold.unionByName(split).select(
        unpacked(F.col("address")).alias("address"), unpacked(token).alias("token_address"), "blknum",
        *[F.when(known, F.col(f"cum_{c}")).cast("long").alias(c) for c in cols[:2]], F.when(known, value).alias("value"))


def native_balance_history(traces: DataFrame, txs: DataFrame, *, width: int = 1_000_000) -> DataFrame:
    """Running native balance per address at every block where it changed: blocks, txs and
    transfers of out, vin and cnb, the value of each and of fees, and
    ``value = cnb + vin - out - fee``."""
    per_role = block_stats(tx_partials(native_roles(traces, txs), []), [])
    counted, zero = [f"{r}_{m}" for m in ("blocks", "txs", "xfers") for r in ("out", "vin", "cnb")], F.lit(0).cast(U.DEC)
    limbs = {r: [f"{r}_v{k}" for k in range(NL)] for r in NATIVE_ROLES}
    of = lambda c: F.max(F.when(F.col("role") == c.split("_")[0], F.col(c.split("_")[1])))  # noqa: E731  one row a role and block
    per_block = per_role.groupBy("address", "blknum").agg(
        *[F.coalesce(of(c), F.lit(0)).alias(c) for c in counted], *[F.coalesce(of(c), zero).alias(c) for own in limbs.values() for c in own])
    run = _running(per_block, [], [*counted, *[c for own in limbs.values() for c in own]], width)
    cum = {r: _limbs([f"cum_{c}" for c in own]) for r, own in limbs.items()}
    net = [cum["cnb"][k] + cum["vin"][k] - cum["out"][k] - cum["fee"][k] for k in range(NL)]
    return run.select("address", "blknum", *[F.col(f"cum_{c}").cast("long").alias(c) for c in counted],
                      *[U.limbs_to_string(cum[r]).alias(f"{r}_value") for r in ("out", "fee", "vin", "cnb")],
                      U.limbs_to_string(net).alias("value"))


def merge_balances(state: DataFrame, delta: DataFrame, keys=("address", "token_address"), roles=("out", "vin"),
                   plus=("vin",), minus=("out",)) -> DataFrame:
    """Fold a later block batch into stored latest balances.

    Block batches are disjoint, so counts add (including distinct-block counts); first/last
    take min/max; values add in limb space. Equals a full recompute."""
    keys = list(keys)
    s = state.alias("s")
    d = delta.alias("d")
    j = s.join(d, keys, "full")

    def c(side, name):
        return F.col(f"{side}.{name}")

    cols = [*[F.col(k) for k in keys], F.greatest(c("s", "blknum"), c("d", "blknum")).alias("blknum")]
    limb_sums = {}
    for r in roles:
        for m in ("blocks", "txs", "xfers"):
            cols.append((F.coalesce(c("s", f"{r}_{m}"), F.lit(0)) + F.coalesce(c("d", f"{r}_{m}"), F.lit(0))).cast("long").alias(f"{r}_{m}"))
        ls = [F.coalesce(a, F.lit(0).cast(U.DEC)) + F.coalesce(b, F.lit(0).cast(U.DEC))
              for a, b in zip(U.to_limbs(c("s", f"{r}_value")), U.to_limbs(c("d", f"{r}_value")))]
        limb_sums[r] = ls
        cols.append(U.limbs_to_string(ls).alias(f"{r}_value"))
        for m in ("1th_st", "1th_blknum", "1th_st_day"):
            cols.append(F.least(c("s", f"{r}_{m}"), c("d", f"{r}_{m}")).alias(f"{r}_{m}"))
        for m in ("nth_st", "nth_blknum", "nth_st_day"):
            cols.append(F.greatest(c("s", f"{r}_{m}"), c("d", f"{r}_{m}")).alias(f"{r}_{m}"))
    net = [sum((limb_sums[r][k] for r in plus), F.lit(0).cast(U.DEC)) - sum((limb_sums[r][k] for r in minus), F.lit(0).cast(U.DEC))
           for k in range(NL)]
    cols.append(U.limbs_to_string(net).alias("value"))
    return j.select(*cols)


def reconcile(computed: DataFrame, onchain: DataFrame, keys=("address", "token_address")) -> DataFrame:
    """Computed ``value`` vs fetched ``balance``; rows whose numbers disagree, with the
    exact signed difference."""
    keys = list(keys)
    j = computed.select(*keys, "value").join(onchain.select(*keys, "balance"), keys, "full")
    diff = U.sub(F.coalesce(F.col("balance"), F.lit("0")), F.coalesce(F.col("value"), F.lit("0")))
    return j.select(*keys, "value", "balance", diff.alias("difference")).filter(F.col("difference") != "0")
