"""Derived chain tables, all native Catalyst except the opcode walk of ``classify_contracts``.

Decisions where the reference leaves the producer out (flagged as ours): contracts come from
successful (``status = 1``) create/create2 traces; ERC-1155 ``id_pos`` starts at 0; item ids
are ``<table>_<hash>[_<pos>]``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainframe.functions import evm as E
from chainframe.functions import u256 as U
from chainframe.operators.windows import bucketed_lag
from chainframe.session import stored


def item_id(table: str, *parts: str) -> Column:
    return F.concat_ws("_", F.lit(table), *[F.col(p).cast("string") for p in parts])


def normalize_logs(logs: DataFrame) -> DataFrame:
    """Topics text → ``topic_list`` array, ``n_topics`` (its size), ``topics_0``."""
    arr = E.split_topics(F.col("topics"))
    return logs.withColumn("topic_list", arr).withColumn("n_topics", F.size(arr).cast("int")) \
        .withColumn("topics_0", F.element_at(arr, 1))


def tokens_latest(registry: DataFrame, key: str = "address", version: str = "blknum") -> DataFrame:
    """One row per token address, the latest version (CREATE2 may reuse an address). An
    aggregate, so a hot address leaves each map task as one row."""
    rest = [c for c in registry.columns if c not in (key, version)]
    top = registry.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("__m"))
    return top.select(*[F.col(key) if c == key else F.col("__m")[c].alias(c) for c in registry.columns])


def with_token_meta(xfers: DataFrame, tokens: DataFrame | None, cols=("name", "symbol", "decimals")) -> DataFrame:
    """Token metadata by address. A plain left join: Spark broadcasts the dimension when
    its size estimate is under the broadcast threshold, and shuffles otherwise."""
    if tokens is None:
        for c in cols:
            xfers = xfers.withColumn(c, F.lit(None).cast("string" if c != "decimals" else "long"))
        return xfers
    t = tokens.select(F.col("address").alias("__taddr"), *[F.col(c).alias(c) for c in cols])
    out = xfers.join(t, xfers["token_address"] == t["__taddr"], "left").drop("__taddr")
    if "decimals" in cols:
        out = out.withColumn("decimals", F.col("decimals").cast("long"))
    return out


def _first_topic_is(topics: Column, topic0: str) -> Column:
    """``split_topics(topics)[0] = topic0`` without splitting: a plain prefix test for the scan."""
    alone = [topic0, f"[{topic0}", f"{topic0}]", f"[{topic0}]"]
    return topics.startswith(f"[{topic0},") | topics.startswith(f"{topic0},") | topics.isin(*alone)


def _log_base(logs: DataFrame, topic0: str, n_topics: int) -> DataFrame:
    return (logs.filter((F.col("n_topics") == n_topics) & _first_topic_is(F.col("topics"), topic0))
            .withColumn("__t", E.split_topics(F.col("topics"))))


def erc20_transfers(logs: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Transfer(address indexed, address indexed, uint256) logs with 3 topics."""
    b = _log_base(logs, E.TRANSFER_TOPIC, 3)
    x = b.select(
        "block_timestamp", "blknum", "txhash", "txpos", F.col("logpos").cast("long").alias("logpos"),
        F.col("address").alias("token_address"),
        E.topic_address(F.element_at("__t", 2)).alias("from_address"),
        E.topic_address(F.element_at("__t", 3)).alias("to_address"),
        F.col("data").alias("__d"),
    )
    x = x.withColumn("__w", E.word(E.strip0x(F.col("__d")), 0)).withColumn("value", U.hex_to_u256(F.col("__w"))).drop("__d", "__w")
    x = with_token_meta(x, tokens)
    return x.withColumn("item_id", item_id("token_xfer", "txhash", "logpos"))


def erc721_transfers(logs: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Transfer with 4 topics: the token id is the third indexed argument."""
    b = _log_base(logs, E.TRANSFER_TOPIC, 4)
    x = b.select(
        "block_timestamp", "blknum", "txhash", "txpos", F.col("logpos").cast("long").alias("logpos"),
        F.col("address").alias("token_address"),
        E.topic_address(F.element_at("__t", 2)).alias("from_address"),
        E.topic_address(F.element_at("__t", 3)).alias("to_address"),
        F.element_at("__t", 4).alias("__t4"),
    )
    x = x.withColumn("__w", E.strip0x(F.col("__t4"))).withColumn("token_id", U.hex_to_u256(F.col("__w"))).drop("__t4", "__w")
    x = with_token_meta(x, tokens, ("name", "symbol"))
    return x.withColumn("item_id", item_id("erc721_xfer", "txhash", "logpos"))


def _small_int(w: Column) -> Column:
    """An offset or length: the word as BIGINT, NULL unless it is a whole word below 2^63."""
    digits = F.conv(F.substring(w, 49, 16), 16, 10)
    return F.when((F.length(w) == 64) & w.startswith("0" * 48), digits.try_cast("long"))


def _erc1155_logs(logs: DataFrame) -> DataFrame:
    """Transfer logs with topics ``__t``, payload ``__d`` (no 0x), and for batches the word
    positions of both arrays and their length. ``id_cnt`` is 0 where the payload is malformed:
    an offset or length that is no small number, is not a multiple of 32 bytes or leads beyond
    the payload, or arrays of different lengths."""
    topic0 = F.substring("topics", 2, 66)
    hexed = F.col("data")
    b = logs.filter((F.col("n_topics") == 4) & topic0.isin(E.TRANSFER_SINGLE_TOPIC, E.TRANSFER_BATCH_TOPIC)).select(
        "block_timestamp", "blknum", "txhash", "txpos", F.col("logpos").cast("long").alias("logpos"),
        F.col("address").alias("token_address"), F.split(F.expr("substring(topics, 2, length(topics) - 2)"), ",").alias("__t"),
        (topic0 == F.lit(E.TRANSFER_BATCH_TOPIC)).alias("__batch"),
        F.when(F.lower(F.substring(hexed, 1, 2)) == "0x", F.expr("substring(data, 3)")).otherwise(hexed).alias("__d"))
    d = F.col("__d")
    b = b.withColumn("__words", F.floor(F.coalesce(F.length(d), F.lit(0)) / 64).cast("long"))
    # one column a step: each value is computed once a row, by plain expressions
    words = F.col("__words")
    for k in (0, 1):
        b = b.withColumn(f"__w{k}", E.word(d, k)).withColumn(f"__o{k}", F.when(F.col("__batch"), _small_int(F.col(f"__w{k}")))).drop(f"__w{k}")
    fits = [(F.col(o) % 32 == 0) & (F.col(o) < words * 32) for o in ("__o0", "__o1")]
    b = b.withColumn("__fits", F.coalesce(fits[0] & fits[1], F.lit(False)))
    for k in (0, 1):
        b = b.withColumn(f"__a{k}", F.when(F.col("__fits"), F.shiftright(f"__o{k}", 5)))
        b = b.withColumn(f"__w{k}", E.word_at(d, F.col(f"__a{k}"))).withColumn(f"__n{k}", _small_int(F.col(f"__w{k}"))).drop(f"__w{k}")
    whole = [F.col(f"__n{k}") <= words - 1 - F.col(f"__a{k}") for k in (0, 1)]
    n = F.when(whole[0] & whole[1] & (F.col("__n0") == F.col("__n1")), F.col("__n0"))
    single = F.when(words >= 2, F.lit(1)).otherwise(F.lit(0)).cast("long")
    b = b.withColumn("id_cnt", F.coalesce(F.when(~F.col("__batch"), single).otherwise(n), F.lit(0).cast("long")))
    return b.drop("__o0", "__o1", "__fits", "__n0", "__n1")


def erc1155_transfers(logs: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """TransferSingle / TransferBatch (operator, from, to indexed).

    Batch payloads hold two dynamic arrays addressed by byte offsets. Offsets and lengths are
    checked against the payload first (chain data is hostile: malformed logs give no rows, see
    ``erc1155_rejects``), then the words of both arrays are paired and exploded and converted once
    per output row; all native, no Python. ``id_pos`` is 0-based."""
    b = _erc1155_logs(logs)
    # words are cut from a payload's bytes, wherever they lie, in the generated code that fans a log out: a
    # batch of n ids costs n words, not n payloads. Text beyond ASCII (malformed) is cut by characters.
    d = F.col("__d")
    b = b.withColumn("__bytes", F.when(F.octet_length(d) == F.length(d), d.cast("binary")))
    b = b.withColumn("__cut", F.when(F.col("__bytes").isNull(), F.regexp_extract_all("__d", F.lit(r"([\s\S]{64})"), 1)))
    for k in (0, 1):
        b = b.withColumn(f"__s{k}", F.when(F.col("__batch"), F.col(f"__a{k}") + 1).otherwise(F.lit(k).cast("long")))
    base = ["block_timestamp", "blknum", "txhash", "txpos", "logpos", "token_address", "__t", "__batch", "id_cnt"]
    places = F.when(F.col("id_cnt") >= 1, F.sequence(F.lit(0).cast("long"), F.col("id_cnt") - 1))
    # the outer form: Spark would filter the others by a copy of ``places`` below all of its steps
    x = b.select(*base, "__bytes", "__cut", "__s0", "__s1", F.explode_outer(places).alias("__p")).filter(F.col("__p").isNotNull())

    def cut(k: int) -> Column:
        at = F.col(f"__s{k}") + F.col("__p")
        own = F.substr("__bytes", (at * 64 + 1).cast("int"), F.lit(64)).cast("string")
        return F.when(F.col("__cut").isNull(), own).otherwise(F.get("__cut", at.cast("int")))

    x = x.select(*base, "__p", cut(0).alias("__id"), cut(1).alias("__value"))
    pos = F.col("__p")
    x = x.select(
        "block_timestamp", "blknum", "txhash", "txpos", "logpos", "token_address",
        E.topic_address(F.element_at("__t", 2)).alias("operator"),
        E.topic_address(F.element_at("__t", 3)).alias("from_address"),
        E.topic_address(F.element_at("__t", 4)).alias("to_address"),
        F.when(F.col("__batch"), F.lit("batch")).otherwise(F.lit("single")).alias("xfer_type"),
        pos.alias("id_pos"), "id_cnt", U.hex_to_u256(F.col("__id")).alias("token_id"), U.hex_to_u256(F.col("__value")).alias("value"))
    x = with_token_meta(x, tokens, ("name", "symbol"))
    return x.withColumn("item_id", item_id("erc1155_xfer", "txhash", "logpos", "id_pos"))


def erc1155_rejects(logs: DataFrame) -> DataFrame:
    """Transfer logs per collection whose payload gives no rows (malformed or empty batches)."""
    # counted, not filtered: a filter on id_cnt would be pushed below its steps, each of them copied into it many times
    found = _erc1155_logs(logs).groupBy("token_address").agg(F.count_if(F.col("id_cnt") == 0).alias("rejected"))
    return found.filter("rejected > 0")


def contracts(traces: DataFrame) -> DataFrame:
    """Successful create/create2 traces → contracts (address=to, creater=from,
    initcode=input, bytecode=output)."""
    c = traces.filter(F.col("trace_type").isin("create", "create2") & (F.col("status") == 1))
    return c.select(
        "block_timestamp", "blknum", "txhash", "txpos", "trace_type", "trace_address",
        F.col("to_address").alias("address"), F.col("from_address").alias("creater"),
        F.col("input").alias("initcode"), F.col("output").alias("bytecode"),
    ).withColumn("item_id", item_id("contract", "txhash", "trace_address"))


def classify_contracts(cs: DataFrame) -> DataFrame:
    """D3: ``func_sighashes`` (PUSH4 operands, code order, distinct) and ERC-20/721 flags.

    The opcode walk is the only Python: it runs once per *distinct* bytecode (clones and
    proxies share code) in Arrow batches, and is joined back on the code hash. The selectors are
    stored first, so that the join knows their size: few are broadcast, and where both sides are
    shuffled, adaptive execution splits the contracts of a hot code between tasks."""
    code = cs.select(F.md5(F.col("bytecode")).alias("code_hash"), "bytecode").filter(F.col("bytecode").isNotNull())
    distinct_code = code.groupBy("code_hash").agg(F.first("bytecode").alias("bytecode"))
    sels = distinct_code.select("code_hash", F.array_distinct(E.push4_selectors(F.col("bytecode"))).alias("selectors"))
    sels = stored(sels, "selectors")
    out = cs.withColumn("code_hash", F.md5(F.col("bytecode"))).join(sels, "code_hash", "left").drop("code_hash")

    def has_all(ss):
        return F.forall(F.array(*[F.lit(s) for s in ss]), lambda s: F.array_contains(F.col("selectors"), s))

    return out.select(*[c for c in cs.columns],
                      F.array_join(F.col("selectors"), ",").alias("func_sighashes"),
                      F.coalesce(has_all(E.ERC20_SELECTORS), F.lit(False)).alias("is_erc20"),
                      F.coalesce(has_all(E.ERC721_SELECTORS), F.lit(False)).alias("is_erc721"))


def tx_receipts(txs: DataFrame, logs: DataFrame, receipts: DataFrame | None = None) -> DataFrame:
    """Receipt enrichment. ``receipt_log_count`` comes from the logs (pre-aggregated per tx,
    so the join carries one row per transaction); with ``receipts`` (txhash, gas_used,
    cumulative_gas_used, effective_gas_price, status, contract_address) the receipt columns of
    a transaction are theirs, NULL where it has none."""
    counts = logs.groupBy("txhash").agg(F.count(F.lit(1)).alias("__n"))
    out = txs.join(counts, "txhash", "left")
    out = out.withColumn("receipt_log_count", F.coalesce(F.col("__n"), F.lit(0)).cast("long")).drop("__n")
    if receipts is None:
        return out
    names = ("gas_used", "cumulative_gas_used", "effective_gas_price", "status", "contract_address")
    r = receipts.select("txhash", *[F.col(c).alias(f"receipt_{c}") for c in names])
    return out.drop(*[f"receipt_{c}" for c in names]).join(r, "txhash", "left")


def contract_creations(txs: DataFrame) -> DataFrame:
    """Transactions that create a contract: those without a receiver."""
    return txs.filter(F.col("to_address").isNull())


def proxy_tokens(tokens: DataFrame) -> DataFrame:
    """Proxies take name/symbol/decimals from their upstream token when present."""
    up = tokens.select(F.col("address").alias("__u"), F.col("name").alias("__un"),
                       F.col("symbol").alias("__us"), F.col("decimals").alias("__ud"))
    j = tokens.join(up, tokens["upstream"] == up["__u"], "left")
    prox = F.col("is_proxy") & F.col("__u").isNotNull()
    return j.select("address", "is_proxy", "upstream",
                    F.when(prox, F.col("__un")).otherwise(F.col("name")).alias("eff_name"),
                    F.when(prox, F.col("__us")).otherwise(F.col("symbol")).alias("eff_symbol"),
                    F.when(prox, F.col("__ud")).otherwise(F.col("decimals")).alias("eff_decimals"))


def parent_path(trace_address: Column) -> Column:
    """'0,1,2' → '0,1'; '0' → ''; '' (root) → NULL."""
    return F.when(trace_address == "", None).otherwise(F.regexp_replace(trace_address, r"(^|,)[0-9]+$", ""))


def trace_tree(traces: DataFrame) -> DataFrame:
    """Children per trace (by path prefix inside the tx) against the declared
    ``subtraces``. Keyed by (block_timestamp, txhash, path): no per-tx task."""
    t = traces.filter(F.col("txhash").isNotNull() & F.col("trace_address").isNotNull())
    kids = (t.select("block_timestamp", "txhash", parent_path(F.col("trace_address")).alias("trace_address"))
            .filter(F.col("trace_address").isNotNull())
            .groupBy("block_timestamp", "txhash", "trace_address").agg(F.count(F.lit(1)).alias("child_count")))
    out = t.select("block_timestamp", "txhash", "trace_address", "subtraces") \
        .join(kids, ["block_timestamp", "txhash", "trace_address"], "left")
    cc = F.coalesce(F.col("child_count"), F.lit(0)).cast("long")
    return out.select("block_timestamp", "txhash", "trace_address", "subtraces", cc.alias("child_count"),
                      (F.col("subtraces") == cc).alias("consistent"))


def nonce_gaps(txs: DataFrame, *, width: int = 1_000_000) -> DataFrame:
    """Per sender, nonce gaps (``gap > 0``) and replacements (``gap < 0``: the same nonce
    seen again). Bucketed lag: a sender with a third of all txs is split by nonce range."""
    t = txs.filter(F.col("nonce").isNotNull()).select("from_address", "nonce", "txhash", "block_timestamp")
    lagged = bucketed_lag(t, ["from_address"], "nonce", ["nonce"], width=width, tiebreak=["txhash"])
    gap = F.col("nonce") - F.col("prev_nonce") - 1
    return lagged.filter(F.col("prev_nonce").isNotNull() & (gap != 0)) \
        .select("from_address", "nonce", "prev_nonce", gap.alias("gap"), "txhash")


def chain_continuity(blocks: DataFrame, *, width: int = 100_000) -> DataFrame:
    """Blocks whose parent hash or number does not follow the previous block (global
    order, computed per block-number bucket plus one carried row per bucket)."""
    b = blocks.select("blknum", "blkhash", "parent_hash")
    lagged = bucketed_lag(b, [], "blknum", ["blknum", "blkhash"], width=width, tiebreak=["blkhash"])
    broken = (F.col("prev_blknum").isNotNull() &
              ((F.col("prev_blknum") + 1 != F.col("blknum")) | (F.col("parent_hash") != F.col("prev_blkhash"))))
    return lagged.filter(broken).select("blknum", "parent_hash", "prev_blknum", "prev_blkhash")


def block_tx_counts(blocks: DataFrame, txs: DataFrame, keys=("block_timestamp", "blknum")) -> DataFrame:
    """Declared ``tx_count`` vs transactions present per block (txs pre-aggregated)."""
    keys = list(keys)
    n = txs.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual_tx_count"))
    out = blocks.select(*{*keys, "blknum", "tx_count"}).join(n, keys, "left")
    actual = F.coalesce(F.col("actual_tx_count"), F.lit(0)).cast("long")
    return out.select("blknum", "tx_count", actual.alias("actual_tx_count"),
                      (F.col("tx_count") == actual).alias("consistent"))


def time_columns(df: DataFrame, ts: str = "block_timestamp") -> DataFrame:
    """``_st`` epoch seconds (INT) and ``_st_day`` (DATE)."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return df.withColumn("_st", F.timestamp_diff("SECOND", epoch, F.col(ts)).cast("int")) \
        .withColumn("_st_day", F.to_date(F.col(ts)))


def signature_pkey(sigs: DataFrame) -> DataFrame:
    """``pkey = md5(byte_sign || text_sign || abi)``."""
    return sigs.withColumn("pkey", F.md5(F.concat(F.col("byte_sign"), F.col("text_sign"), F.col("abi"))))


def best_signature(sigs: DataFrame) -> DataFrame:
    """Best text signature per selector by ``score`` (ties by ``pkey``)."""
    rest = [c for c in sigs.columns if c not in ("byte_sign", "pkey")]
    first = F.struct(F.col("score").isNull().alias("__none"), (-F.col("score")).alias("__down"), "pkey", *rest)
    top = sigs.groupBy("byte_sign").agg(F.min(first).alias("__m"))
    return top.select(*[F.col(c) if c == "byte_sign" else F.col("__m")[c].alias(c) for c in sigs.columns])


def txpool_mined(pool: DataFrame, txs: DataFrame) -> DataFrame:
    """Match mempool entries to mined transactions by hash; wait time when mined."""
    m = txs.select(F.col("txhash").alias("__h"), F.col("block_timestamp").alias("mined_at"), F.col("blknum").alias("mined_blknum"))
    j = pool.join(m, pool["txhash"] == m["__h"], "left").drop("__h")
    return j.withColumn("is_mined", F.col("mined_at").isNotNull()) \
        .withColumn("wait_seconds", F.timestamp_diff("SECOND", F.col("block_timestamp"), F.col("mined_at")))


def txpool_key(df: DataFrame) -> Column:
    """What a sender may use once: sender and nonce, or the hash where either is missing."""
    return F.coalesce(F.concat("from_address", F.lit(":"), F.col("nonce").cast("string")), F.col("txhash"))


def txpool_columns() -> list[Column]:
    """Outcome of a joined mempool row: ``mined``, ``replaced`` (its sender's nonce was mined under
    another hash) or ``expired``."""
    mined = F.col("mined_txhash")
    return [F.col("txhash"), mined, F.when(mined.isNull(), "expired").when(mined == F.col("txhash"), "mined").otherwise("replaced").alias("outcome"),
            F.timestamp_diff("SECOND", F.col("seen_at"), F.col("mined_at")).alias("wait_seconds")]


def txpool_outcome(pool: DataFrame, txs: DataFrame, retention: str = "6 hours") -> DataFrame:
    """What became of each mempool row within the retention: txhash, mined_txhash, outcome,
    wait_seconds. Streams: ``streaming.loaders.txpool_outcome_stream``."""
    p = pool.select("txhash", F.col("block_timestamp").alias("seen_at"), txpool_key(pool).alias("__p"))
    m = txs.select(F.col("txhash").alias("mined_txhash"), F.col("block_timestamp").alias("mined_at"), txpool_key(txs).alias("__m"))
    near = (F.col("mined_at") >= F.col("seen_at")) & (F.col("mined_at") <= F.col("seen_at") + F.expr(f"INTERVAL {retention}"))
    return p.join(m, (F.col("__p") == F.col("__m")) & near, "left").select(*txpool_columns())
