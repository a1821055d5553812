"""Shared text rules and table access of the ``llm`` operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainframe.session import ensure_checkpoint_dir

#: ASCII white space: \x20 and \x09-\x0D.
SPACES = (" ", "\n", "\r", "\t", "\x0b", "\x0c")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` only; a null text is the empty text."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def without_spaces(c: Column) -> Column:
    """The text with every ASCII white-space character deleted."""
    for ch in SPACES:
        c = F.replace(c, F.lit(ch), F.lit(""))
    return c


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts the lineage, and
    a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: a key that holds more than this part of all rows is hot; there are fewer such keys
HOT_SHARE = 1000


def spread_join(rows: DataFrame, small: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``rows`` left-joined to ``small`` (unique in ``key``). ``hot`` lists the keys of many rows,
    fewer than ``HOT_SHARE`` of them: their part of ``small`` is broadcast, so a hot key stays dealt
    over the tasks that hold it."""
    tagged = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("_hot"))), key, "left")
    large = F.broadcast(small.join(F.broadcast(hot), key, "left_semi"))
    return (tagged.filter("_hot").drop("_hot").join(large, key, "left")
            .unionByName(tagged.filter("_hot is null").drop("_hot").join(small, key, "left")))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, after underscores if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class IdFilter:
    """A bitmap of hashed ids, of a fixed size (8 MB) however many there are, for a broadcast.

    It keeps every id of ``ids`` (column id) and few others: rows that cannot be wanted are left
    out where they are read, instead of shuffling every text for a join. As ids grow it fills
    and merely filters less."""

    SLOTS = 1 << 26

    def __init__(self, ids: DataFrame) -> None:
        slot = self.slot(F.col("id")) + 1
        parts = (ids.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("part"))
                 .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect())
        bits = np.zeros(self.SLOTS >> 3, np.uint8)
        for r in parts:
            own = np.frombuffer(r["bits"], np.uint8)
            bits[(r["part"] - 1) * len(own) :][: len(own)] = own
        self._bits = ids.sparkSession.sparkContext.broadcast(bits)

    @classmethod
    def slot(cls, c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(cls.SLOTS))

    def test(self, slots: np.ndarray) -> np.ndarray:
        return (self._bits.value[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0
