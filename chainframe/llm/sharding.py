"""Sharding by vector bin packing over bytes, tokens and rows.

Equal texts form a group that stays together, unless it holds more than 1/``PIECES`` of a
shard's bytes: then its rows are dealt by the hash of a stored row number to as many pieces as needed (fewer than
``PIECES`` times the number of shards such groups can exist, so their list may be broadcast).
Groups are dealt by hash to partitions of about ``per_partition`` rows. Groups and pieces over
1/``FINE`` of a partition's share of a shard are placed before, largest sizes first, in levels:
the first has a bounded number and one task, later ones tasks of about ``per_partition``, none
of whose units is near a shard's share. After each level the loads of the shards (one row each)
say how much every shard may take of what remains. Each partition fills the shards to that
share of its own totals: groups in descending size, each to the shard where the dot product of
the group's vector with the residual capacity is highest. The smallest
groups, the last ``TAIL`` of a partition's bytes, weigh bytes alone, so that the law `bytes`
holds to about the size of a small text in every partition, and partitions start at different
shards, so that what is left over does not add up.

Texts do not travel: only their length, check sum, hash and word count do.

Defined results: a null or empty text has 8 bytes (its row); rows with equal ids and texts are
one group of several rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainframe.llm.text import whole_text, written

PIECES = 64
FINE = 8
TAIL = 0.1
#: weights of bytes, tokens and rows
WEIGHTS, TAIL_WEIGHTS = (1.0, 0.25, 0.25), (1.0, 0.0, 0.0)


def shares(load: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Of what remains (``rest``), the share of each shard that levels ``load``, by column."""
    low = np.sort(load, axis=0)
    level = (rest + np.cumsum(low, axis=0)) / np.arange(1, len(load) + 1)[:, None]  # with the k lowest filled
    last = len(load) - 1 - (level >= low)[::-1].argmax(axis=0)
    fill = np.maximum(level[last, np.arange(load.shape[1])] - load, 0)
    total = fill.sum(axis=0)
    return np.where(total > 0, fill / np.maximum(total, 1e-300), 1 / len(load))


def place(units: np.ndarray, shards: int, first: int, share: np.ndarray | None = None) -> np.ndarray:
    """The shard of each unit; ``units`` has its bytes, tokens and rows, ``share`` what part of
    each a shard is to take (default: equal parts)."""
    capacity = units.sum(axis=0) / shards
    vectors = units / np.maximum(capacity, 1)
    left = np.ones((shards, units.shape[1])) if share is None else np.roll(share * shards, -first, axis=0)
    order = np.argsort(-units[:, 0], kind="stable")
    tail = units[:, 0].sum() * (1 - TAIL)
    weights, seen, out = np.array(WEIGHTS), 0, np.empty(len(units), np.int32)
    for i in order.tolist():
        if seen >= tail:
            weights = np.array(TAIL_WEIGHTS)
        v = vectors[i]
        score = left @ (weights * v)
        fits = left[:, 0] >= v[0]
        if fits.any():
            score[~fits] = -np.inf
        else:
            score = left[:, 0]
        s = int(score.argmax())
        left[s] -= v
        seen += units[i, 0]
        out[i] = (s + first) % shards
    return out


def _placer(shards: int, share: np.ndarray):
    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [("h", "ascending"), ("text_crc32", "ascending"), ("size", "ascending"),
                                       ("chunk", "ascending"), ("row", "ascending")]))
        keys = np.stack([t.column(c).to_numpy() for c in ("h", "text_crc32", "size", "chunk")])
        new = np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))
        unit = np.cumsum(new) - 1
        size, tokens = t.column("size").to_numpy(), t.column("tokens").to_numpy()
        units = np.stack([np.bincount(unit, size), np.bincount(unit, tokens), np.bincount(unit)], axis=1)
        of_unit = pc.fill_null(t.column("placed"), -1).to_numpy()[new]  # -1: not placed before
        free = of_unit < 0
        of_unit[free] = place(units[free], shards, 7 * t.column("bucket")[0].as_py() % shards, share)
        shard = of_unit[unit]
        t = t.drop_columns(["placed"])
        order = np.argsort(shard, kind="stable")
        slot = np.empty(len(shard), np.int64)
        count = np.bincount(shard, minlength=shards)
        slot[order] = np.arange(len(shard)) - np.repeat(np.cumsum(count) - count, count)
        return t.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(slot))

    return run


def _unit_placer(shards: int, share: np.ndarray):
    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [(c, "ascending") for c in ("h", "text_crc32", "size", "chunk")]))
        units = np.stack([t.column(c).to_numpy() for c in ("bytes", "words", "rows")], axis=1).astype(float)
        first = 7 * t.column("part")[0].as_py() % shards
        return t.append_column("placed", pa.array(place(units, shards, first, share), pa.int32()))

    return run


def _place_heavy(heavy: DataFrame, cuts: list[int], totals: np.ndarray, shards: int, per_partition: int) -> tuple[list[DataFrame], np.ndarray]:
    """The units of each level (those over a cut and not over the one before) with their shard,
    and the share of each shard in the rest."""
    load, out, most = np.zeros((shards, 3)), [], None
    for cut in cuts:
        own = heavy.filter(F.col("bytes") > cut)
        own = own if most is None else own.filter(F.col("bytes") <= most)
        width = 1 if most is None else max(1, -(-own.count() // per_partition))
        own = own.withColumn("part", F.pmod(F.xxhash64("h", "text_crc32", "size", "chunk"), F.lit(width)))
        schema = T.StructType([*own.schema.fields, T.StructField("placed", T.IntegerType())])
        placed = written(own.groupBy("part").applyInArrow(_unit_placer(shards, shares(load, totals - load.sum(axis=0))), schema), "sharding-heavy")
        for r in placed.groupBy("placed").agg(F.sum("bytes").alias("b"), F.sum("words").alias("w"), F.sum("rows").alias("r")).collect():
            load[r["placed"]] += (r["b"], r["w"], r["r"])
        out.append(placed.select("h", "text_crc32", "size", "chunk", "placed"))
        most = cut
    return out, shares(load, totals - load.sum(axis=0))


def shard_documents(docs: DataFrame, shards: int = 24, per_partition: int = 16384) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    t = whole_text(docs)
    light = written(t.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("h"),
        (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).cast("long").alias("tokens")), "sharding")
    total = light.agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).first()
    limit = max(1, (total["bytes"] or 0) // (shards * PIECES))
    group = ["h", "text_crc32", "size"]
    large = (light.groupBy(*group).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
             .filter((F.col("bytes") > limit) & (F.col("rows") > 1))
             .select(*group, F.ceil(F.col("bytes") / limit).alias("pieces")))
    large = written(large, "sharding-large")  # each holds over 1/(shards * PIECES) of all bytes
    chunk = F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("row"), F.col("pieces")))
    dealt = light.join(F.broadcast(large), group, "left").withColumn("chunk", chunk.cast("long")).drop("pieces")
    width = max(1, -(-total["n"] // per_partition))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64(*group, "chunk"), F.lit(width)))
    schema = T.StructType([*dealt.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    unit, share = [*group, "chunk"], np.full((shards, 3), 1 / shards)
    if width == 1:  # one partition sees all units
        dealt = dealt.withColumn("placed", F.lit(None).cast("int"))
    else:
        fine = max(1, total["bytes"] // (width * shards * FINE))
        cuts = [max(fine, limit // 8)]  # fewer than 8 * shards * PIECES units are over the first
        while cuts[-1] > fine:
            cuts.append(max(fine, cuts[-1] // 64))
        heavy = written(dealt.groupBy(*unit).agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("words"), F.count(F.lit(1)).alias("rows"))
                        .filter(F.col("bytes") > fine), "sharding-units")
        levels, share = _place_heavy(heavy, cuts, np.array([total["bytes"], total["tokens"], total["n"]], float), shards, per_partition)
        known = levels[0]
        for level in levels[1:]:
            known = known.unionByName(level)
        dealt = dealt.join(known, unit, "left")
    placed = written(dealt.groupBy("bucket").applyInArrow(_placer(shards, share), schema), "sharded")
    # slots: rows of the shard in the partitions before (one row a partition and shard)
    upto = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
              .select("shard", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before")))
    return placed.join(before, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("before")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
