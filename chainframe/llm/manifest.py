"""Merkle manifest of a dataset by a slot pivot, native Spark only.

Each row is a leaf: the sha256 of its fields, each ``-`` if null, else byte count, ``:`` and
value. Per ``tree`` value (a language) leaves stand in the order of their id; every ``fanout``
consecutive nodes of a level become one node of the next, the sha256 of their digests (lowercase
hex text, concatenated), until one is left, the subroot. Subroots in the order of their tree
(null first, then bytewise) are the leaves of one more tree, whose end is the root.

*Slot pivot*: a level is one ``groupBy(tree, parent)`` whose conditional aggregates spread the
children into ``fanout`` columns by their slot. Concatenating the columns and hashing gives the
parent; concatenating them without a child's own column gives its siblings, before and after it.

Leaves get their places by a range partitioning, so a tree that holds most rows is dealt over
many tasks. Levels shrink ``fanout``-fold and are stored. Paths are built from the top down:
each pivot row is joined to its own path (keys are unique on both sides) and hands it to its
children, so leaves are never joined again.

Defined results: leaves with one id stand in the order of their digests, then of reading; a
null id comes first; a null tree is a tree of its own; a tree of one row has that leaf as its
subroot, a table of one tree that subroot as its root; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainframe.llm.order import numbered_rows, ranked
from chainframe.llm.text import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: list[Column]) -> Column:
    """Lowercase hex sha256 of the fields of a row."""

    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return F.sha2(F.concat(*[part(c) for c in fields]), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda node, run: F.sha2(F.concat(run["before"], node, run["after"]), 256))


def siblings(path: Column) -> Column:
    """The digests of ``path``, level by level, left to right, in one string."""
    return F.array_join(F.transform(path, lambda run: F.concat(run["before"], run["after"])), "")


def _slots(fanout: int) -> list[str]:
    return [f"slot{k}" for k in range(fanout)]


def _pivoted(nodes: DataFrame, payload: list[str], fanout: int, name: str) -> DataFrame:
    """One row per parent: its children in columns ``slot0``, ..., its digest and place."""
    slot = F.pmod("pos", F.lit(fanout))
    spread = [F.max(F.when(slot == k, F.struct("digest", *payload))).alias(c) for k, c in enumerate(_slots(fanout))]
    rows = (nodes.filter("n > 1").withColumn("parent", F.floor(F.col("pos") / fanout)).groupBy("tree", "parent", "n")
            .agg(*spread))
    own = F.concat(*[F.coalesce(F.col(f"{c}.digest"), F.lit("")) for c in _slots(fanout)])
    return written(rows.withColumn("digest", F.sha2(own, 256)), name)


def _climbed(leaves: DataFrame, payload: list[str], fanout: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The pivoted levels from the leaves (tree, pos, n, digest, payload) up, and the node that is
    left of each tree: (tree, level, digest)."""
    ends = [leaves.filter("n = 1").select("tree", F.lit(0).alias("level"), "digest")]
    levels: list[DataFrame] = []
    nodes, most = leaves, leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(_pivoted(nodes, [] if levels else payload, fanout, f"{name}-{len(levels)}"))
        nodes = levels[-1].select("tree", F.col("parent").alias("pos"), "digest", F.ceil(F.col("n") / fanout).alias("n"))
        ends.append(nodes.filter("n = 1").select("tree", F.lit(len(levels)).alias("level"), "digest"))
        most = -(-most // fanout)
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    return levels, written(out, f"{name}-ends")


def _children(fanout: int, payload: list[str]) -> Column:
    """The children of a pivot row with the digests before and after them in their run."""
    digest = [F.coalesce(F.col(f"{c}.digest"), F.lit("")) for c in _slots(fanout)]
    empty = F.lit("")
    return F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull(), F.struct(
            (F.col("parent") * fanout + k).alias("pos"), F.col(f"{c}.digest").alias("digest"),
            *[F.col(f"{c}.{p}").alias(p) for p in payload],
            F.concat(empty, *digest[:k]).alias("before"), F.concat(empty, *digest[k + 1 :]).alias("after")))
        for k, c in enumerate(_slots(fanout))]))


def _descended(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, payload: list[str], fanout: int) -> DataFrame:
    """(payload, digest, path, attributes of the tree) of each leaf. ``tops``: the path of each
    tree's end (tree, level, path, attributes)."""
    more = [c for c in tops.columns if c not in ("tree", "level", "path")]
    at = lambda level: tops.filter(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("pos"), "path", *more)
    known = at(len(levels))
    for level in reversed(range(len(levels))):
        keep = payload if level == 0 else []
        above = known.withColumnRenamed("pos", "parent").withColumnRenamed("path", "above")
        rows = levels[level].drop("digest").join(above, ["tree", "parent"])
        rows = rows.select("tree", "above", *more, F.explode(_children(fanout, keep)).alias("child"))
        path = F.concat(F.array(F.struct(F.col("child.before").alias("before"), F.col("child.after").alias("after"))), F.col("above"))
        known = rows.select("tree", "child.pos", path.alias("path"), *more, *([F.col("child.digest")] if level == 0 else []),
                            *[F.col(f"child.{p}") for p in keep])
        if level:
            known = known.unionByName(at(level))
    lone = leaves.filter("n = 1").join(at(0).drop("pos"), "tree").select("tree", "pos", "path", *more, "digest", *payload)
    return known.unionByName(lone) if levels else lone


def dataset_proofs(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", order: str = "doc_id",
                   carry: dict[str, Column] | None = None, fanout: int = 8) -> DataFrame:
    """One row per document: ``order``'s column, leaf, subroot, root, the columns of ``carry``
    (expressions over ``docs``) and path, an array from the leaf to the root of the digests
    (before, after) a node in its run. ``folded(leaf, path)`` is the root."""
    carry = carry or {}
    light = numbered_rows(docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("")).alias("tree"), F.col(order).alias("id"),
        leaf_digest([F.col(c) for c in fields]).alias("digest"), *[c.alias(f"carry_{k}") for k, c in carry.items()]), "manifest-leaves")
    payload = ["id", *[f"carry_{k}" for k in carry]]
    leaves = ranked(light, "tree", [F.col("id").asc_nulls_first(), F.col("digest"), F.col("row")], "manifest-order").select(
        "tree", "pos", "n", "digest", *payload)
    levels, ends = _climbed(leaves, payload, fanout, "manifest")

    # the trees' own tree: its leaves are the subroots, in the order of their trees
    subroots = ends.withColumnRenamed("tree", "name").withColumn("tree", F.lit("root"))
    subroots = ranked(subroots, "tree", [F.col("name")], "manifest-subroots")
    upper, top = _climbed(subroots, ["name", "level"], fanout, "manifest-root")
    start = top.select("tree", "level", F.col("digest").alias("root"),
                       F.array().cast("array<struct<before:string,after:string>>").alias("path"))
    tops = _descended(subroots, upper, start, ["name", "level"], fanout).select(
        F.col("name").alias("tree"), "level", "path", "root", F.col("digest").alias("subroot"))
    tops = written(tops, "manifest-tops")

    out = _descended(leaves, levels, tops, payload, fanout)
    return out.select(F.col("id").alias(order), F.col("digest").alias("leaf"), "subroot", "root",
                      *[F.col(f"carry_{k}").alias(k) for k in carry], "path")


def tampered_proofs(docs: DataFrame) -> DataFrame:
    """Each document's proof, and its check after a third of the texts (by the crc32 of the id)
    had their A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = [F.translate("text", upper, upper.lower()) if c == "text" else F.col(c) for c in FIELDS]
    out = dataset_proofs(docs, carry={"tampered": F.when(hit, leaf_digest(changed))})
    checked = out.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return checked.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
                          "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
