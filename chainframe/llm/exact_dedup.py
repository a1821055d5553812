"""Exact dedup: skew-safe combining of equal texts, native Spark only.

Texts are equal when identical after deleting ASCII white space. Four steps:

1. one pass writes a light row per document (id, length, digest of the normalised text);
2. digests that hold more than 1/``HOT_SHARE`` of all rows are *hot*; there are fewer than
   ``HOT_SHARE`` of them, whatever the input, so that list may be broadcast;
3. local dedup and salted merge: one ``groupBy(digest, salt, normalised text)``. Spark's
   map-side combine keeps one row per distinct content and input task, so a hot text leaves
   each task once; hot digests are spread over ``salts`` reducers, others use salt 0;
4. the salt winners of hot digests are combined globally, again by digest and full content
   (other groups are complete after step 3).

Grouping keys hold the whole normalised text at each stage, so two texts that share a digest
are never merged. The winner is the largest of one fixed-width number (code points, then the
smallest ``doc_id``), which keeps the aggregation in Spark's hash map. Membership is joined
back by (digest, xxhash64, length); should two contents ever share all three, the job stops
with an error instead of mixing them. Rows have stored numbers: of several rows with the
winner's length and id, the first stays, so exactly one row of each group is ``kept``, and
``drop_copies`` selects rows by number, not by id.

Defined results: a null id is worse than any other; null text counts as empty; empty texts form
one group; each of repeated rows gets a row, one of them kept at most; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainframe.llm.order import numbered_rows
from chainframe.llm.text import free_name, without_spaces, written

HOT_SHARE = 1000
#: fixed: 2^63, above any doc_id, and 2^65, above any ``2^63 - doc_id``
_TOP, _SCALE = "9223372036854775808", "36893488147419103232"


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def _rank() -> Column:
    """n_chars * 2^65 + (2^63 - doc_id, or 0 without an id): larger is the better row to keep."""
    wide = "decimal(38,0)"
    by_id = F.coalesce(F.lit(_TOP).cast("decimal(20,0)") - F.col("doc_id").cast("decimal(20,0)"), F.lit(0)).cast(wide)
    return ((F.col("n").cast("decimal(12,0)") * F.lit(_SCALE).cast("decimal(20,0)")).cast(wide) + by_id).cast(wide)


def _kept_id(rank: Column) -> Column:
    left = (rank % F.lit(_SCALE).cast("decimal(20,0)")).cast("decimal(20,0)")
    return F.when(left > 0, (F.lit(_TOP).cast("decimal(20,0)") - left).cast("long"))


def _members(docs: DataFrame, row: Column, salts: int, digest: Callable[[Column], Column]) -> DataFrame:
    """One row per document: its number, doc_id, digest, the rank and size of its group, kept."""
    text = F.coalesce("text", F.lit(""))
    norm = docs.select(row.alias("row"), "doc_id", F.length(text).alias("n"), without_spaces(text).alias("norm"))
    light = written(norm.select("row", "doc_id", "n", F.unhex(digest(F.col("norm"))).alias("digest"),
                                F.xxhash64("norm").alias("h"), F.octet_length("norm").alias("b")), "exact-dedup")
    total = light.count()
    hot = (light.groupBy("digest").agg(F.count(F.lit(1)).alias("c"))
           .filter(F.col("c") > F.lit(max(16, total // HOT_SHARE))).select("digest", F.lit(True).alias("hot")))
    hot = written(hot, "exact-dedup-hot")  # fewer than HOT_SHARE rows

    local = (norm.withColumn("digest", F.unhex(digest(F.col("norm"))))
             .join(F.broadcast(hot), "digest", "left")
             .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(salts))).otherwise(F.lit(-1)))
             .groupBy("digest", "salt", "norm")
             .agg(F.max(_rank()).alias("rank"), F.count(F.lit(1)).alias("size")))
    whole = local.filter("salt < 0").select("digest", "norm", "rank", "size")
    combined = (local.filter("salt >= 0").groupBy("digest", "norm")
                .agg(F.max("rank").alias("rank"), F.sum("size").alias("size")))

    def keyed(df):
        return df.select("digest", F.xxhash64("norm").alias("h"), F.octet_length("norm").alias("b"), "rank", "size")

    def one_content(df):
        """One row per membership key; an error if two contents share it."""
        return (df.groupBy("digest", "h", "b")
                .agg(F.max("rank").alias("rank"), F.max("size").alias("size"), F.count(F.lit(1)).alias("contents"))
                .withColumn("rank", F.when(F.col("contents") == 1, F.col("rank")).otherwise(
                    F.raise_error(F.lit("two contents share digest, hash and length")).cast("decimal(38,0)")))
                .drop("contents"))

    tagged = light.join(F.broadcast(hot), "digest", "left")
    rest = tagged.filter("hot is null").join(one_content(keyed(whole)), ["digest", "h", "b"])
    # the groups of hot digests: fewer than HOT_SHARE digests, so this side may be broadcast
    of_hot = tagged.filter("hot").join(F.broadcast(one_content(keyed(combined))), ["digest", "h", "b"])
    out = written(rest.unionByName(of_hot), "exact-dedup-members")
    first = out.filter(_rank() == F.col("rank")).groupBy("digest", "h", "b").agg(F.min("row").alias("row"))
    return (out.join(first.select("row", F.lit(True).alias("first")), "row", "left")
            .select("row", "doc_id", "digest", "rank", "size", F.coalesce("first", F.lit(False)).alias("kept")))


def exact_groups(docs: DataFrame, salts: int = 32, digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    out = _members(docs, F.monotonically_increasing_id(), salts, digest)
    return out.select("doc_id", _kept_id(F.col("rank")).alias("keep_id"), F.col("size").alias("group_size"), "kept",
                      F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, salts: int = 32) -> DataFrame:
    """The documents that stay, one row of each group, with all their columns."""
    name = free_name(docs, "row")
    numbered = numbered_rows(docs, "exact-dedup-docs", name)
    kept = _members(numbered, F.col(name), salts, sha256_hex).filter("kept").select(F.col("row").alias(name))
    return numbered.join(kept, name, "left_semi").select(*docs.columns)
