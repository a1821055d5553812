"""Document fingerprints: a Merkle tree over paragraphs and sections, native Spark only.

* A section ends after a blank line, a paragraph after a line feed; separators stay with the
  piece before them, so the pieces of a text always concatenate to the text.
* Below the paragraphs lie phrases of a few words, the tree's leaves, cut where content says so
  (after a word that does not end in a-r), so an inserted word moves no later boundary. A leaf is the
  64-bit hash of its bytes, a paragraph's digest the SHA-256 of its bytes, a section's that of its
  paragraphs' digests, the root that of its sections'. Equal roots mean equal texts; where roots
  differ, ``locate`` descends into the first differing section and paragraph.
* ``likeness`` is the Dice share of the distinct leaves of two trees (1 for equal ones). Where a
  tree has fewer than ``FEW`` of them, or one for over ``COARSE`` code points, as in texts without
  spaces, both texts are compared by their windows of ``WINDOW`` code points instead.

``with_next`` attaches each document's successor by ascending ``doc_id`` without a global sort:
ids are dealt to buckets of about ``per_bucket`` rows, the successor is a window inside the
bucket, and only the first row of each bucket travels to the bucket before it. Buckets that hold
over 16 times as many rows (missing, repeated or clustered ids) are cut by the places of their
rows, which light rows (id, hash, row number) give by a range partitioning.

Defined results: a null text is the empty text (one empty section); rows without a ``doc_id``
come before all others; repeated ids are ordered by the hash of their text; an empty table gives
no rows; a single document is its own successor; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainframe.llm.order import numbered_rows, ranked
from chainframe.llm.text import whole_text, written

SECTION_END = r"(?<=\n\n)"
PARAGRAPH_END = r"(?<=\n)"
PHRASE_END = r"(?<=[^a-rA-R][ \n])|(?<=\n)"
FEW, COARSE, WINDOW = 8, 256, 5
_MOST_HOT = 10_000  # hot buckets up to this number (16 bytes each) may be broadcast


def _paragraphs(section: Column) -> Column:
    return F.transform(F.split(section, PARAGRAPH_END), lambda p: F.struct(
        F.sha2(p, 256).alias("digest"), F.transform(F.split(p, PHRASE_END), lambda x: F.xxhash64(x)).alias("leaves")))


def merkle_tree(text: Column) -> Column:
    """array<struct<digest, paragraphs: array<struct<digest, leaves: array<long>>>>>, one entry
    per section."""
    with_paragraphs = F.transform(F.split(text, SECTION_END), _paragraphs)
    return F.transform(with_paragraphs, lambda ps: F.struct(
        F.sha2(F.concat_ws("", ps["digest"]), 256).alias("digest"), ps.alias("paragraphs")))


def root(tree: Column) -> Column:
    return F.sha2(F.concat_ws("", tree["digest"]), 256)


def leaves(tree: Column) -> Column:
    """The distinct leaves of a tree."""
    return F.array_distinct(F.flatten(F.flatten(tree["paragraphs"])["leaves"]))


def _windows(text: Column) -> Column:
    """Hashes of a text's distinct windows of code points (a shorter text: of the whole)."""
    every = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{WINDOW}}}))"), 1)  # matches of no length, so they overlap
    return F.array_distinct(F.transform(F.when(F.size(every) > 0, every).otherwise(F.array(text)), lambda w: F.xxhash64(w)))


def _dice(a: Column, b: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def likeness(text_a: Column, a: Column, text_b: Column, b: Column) -> Column:
    """Dice share of two trees' leaves, 0 to 1; ``a`` and ``b`` are their ``leaves``."""
    thin = lambda t, x: (F.size(x) < FEW) | (F.size(x) * COARSE < F.length(t))
    return F.when(thin(text_a, a) | thin(text_b, b), _dice(_windows(text_a), _windows(text_b))).otherwise(_dice(a, b))


def _first_difference(a: Column, b: Column) -> Column:
    """Index from 0 of the first place where two arrays differ; -1 if none."""
    return F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True) - 1


def locate(a: Column, b: Column) -> Column:
    """struct<section, paragraph> where two trees first differ; (-1, -1) for equal trees. A
    section that only one tree has differs from its paragraph 0 on."""
    s = _first_difference(a["digest"], b["digest"])
    none = F.array().cast("array<string>")
    at = lambda t: F.coalesce(F.get(t, s)["paragraphs"]["digest"], none)
    p = F.when(s < 0, F.lit(-1).cast("long")).otherwise(_first_difference(at(a), at(b)))
    return F.struct(s.cast("int").alias("section"), p.cast("int").alias("paragraph"))


def _ring(keys: DataFrame) -> DataFrame:
    """(bucket, sub, next_bucket, next_sub) in a ring over the distinct keys (bucket, sub)."""
    keys = written(keys, "fingerprint-keys").withColumn("all", F.lit(0))
    placed = written(ranked(keys, "all", [F.col("bucket"), F.col("sub")], "fingerprint-ring").select("bucket", "sub", "pos", "n"), "fingerprint-ring")
    after = placed.select(F.pmod(F.col("pos") - 1, F.col("n")).alias("pos"), F.col("bucket").alias("next_bucket"), F.col("sub").alias("next_sub"))
    return placed.join(after, "pos").select("bucket", "sub", "next_bucket", "next_sub")


def _cut(t: DataFrame, counts: DataFrame, per_bucket: int) -> DataFrame:
    """``t`` with ``sub``: in a bucket of too many rows the number of a row's run of about
    ``per_bucket``, by id, text hash and row number; else 0."""
    most = F.lit(16 * per_bucket)
    if not (counts.agg(F.max("c")).first()[0] or 0) > 16 * per_bucket:
        return t.withColumn("sub", F.lit(0).cast("long")).withColumn("row", F.lit(0).cast("long"))
    t = numbered_rows(t, "fingerprint-docs")
    hot = written(counts.filter(F.col("c") > most).select("bucket"), "fingerprint-hot")
    hot = F.broadcast(hot) if hot.count() <= _MOST_HOT else hot
    light = written(t.select("bucket", "doc_id", "hash", "row").join(hot, "bucket", "left_semi"), "fingerprint-light")
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]
    runs = ranked(light, "bucket", order, "fingerprint-order").select("row", F.floor(F.col("pos") / per_bucket).alias("sub"))
    own = t.join(hot, "bucket", "left_semi").join(runs, "row")
    return own.unionByName(t.join(hot, "bucket", "left_anti").withColumn("sub", F.lit(0).cast("long")))


def with_next(docs: DataFrame, per_bucket: int = 256) -> DataFrame:
    """doc_id, text, next_text: the text of the next document, after the last that of the first."""
    t = whole_text(docs)
    ids = t.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, span = float(ids["lo"] or 0), float(ids["hi"] or 0) - float(ids["lo"] or 0) + 1
    width = max(1.0, span / max(1, ids["n"]) * per_bucket)
    number = F.coalesce(F.floor((F.col("doc_id").cast("double") - lo) / width), F.lit(-1).cast("long"))
    counts = t.select(number.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))
    t = _cut(t.withColumn("bucket", number).withColumn("hash", F.xxhash64("text")), counts, per_bucket)
    w = Window.partitionBy("bucket", "sub").orderBy(F.col("doc_id").asc_nulls_first(), "hash", "row")
    seen = t.withColumn("next_text", F.lead("text").over(w)).withColumn("place", F.row_number().over(w))
    inside = seen.filter("next_text is not null").select("doc_id", "text", "next_text")
    firsts = seen.filter("place = 1").select(F.col("bucket").alias("next_bucket"), F.col("sub").alias("next_sub"), F.col("text").alias("first_text"))
    lasts = (seen.filter("next_text is null").select("doc_id", "text", "bucket", "sub")
             .join(_ring(t.select("bucket", "sub").distinct()), ["bucket", "sub"])
             .join(firsts, ["next_bucket", "next_sub"]).select("doc_id", "text", F.col("first_text").alias("next_text")))
    return inside.unionByName(lasts)


def edited_fingerprints(docs: DataFrame, per_bucket: int = 256) -> DataFrame:
    """Fingerprints of every text and of its edit: the last half (rounded down) of its code
    points replaced by as many first ones (or all) of the next document."""
    d = with_next(docs, per_bucket).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half),
                                        F.substring("next_text", F.lit(1), half)))
    d = d.select("*", F.sha2("edited", 256).alias("edited_sha256"), merkle_tree(F.col("text")).alias("tree"),
                 merkle_tree(F.col("edited")).alias("edited_tree"), merkle_tree(F.col("next_text")).alias("next_tree"))
    d = d.select("*", leaves(F.col("tree")).alias("own"), leaves(F.col("edited_tree")).alias("of_edited"),
                 leaves(F.col("next_tree")).alias("of_next"))
    at = locate(F.col("tree"), F.col("edited_tree"))
    return d.select("doc_id", "n_chars", "edited_sha256", root(F.col("tree")).alias("fingerprint"),
                    root(F.col("edited_tree")).alias("edited_fingerprint"),
                    likeness(F.col("text"), F.col("own"), F.col("edited"), F.col("of_edited")).alias("near_edited"),
                    likeness(F.col("text"), F.col("own"), F.col("next_text"), F.col("of_next")).alias("near_next"),
                    at["section"].alias("edit_section"), at["paragraph"].alias("edit_paragraph"))
