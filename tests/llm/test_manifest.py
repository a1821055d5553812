"""The dataset manifest against a plain Merkle tree."""

import hashlib
import random
import zlib

import pytest

from chainframe.llm import manifest
from chainframe.llm.text import documents

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, Path int"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def _lower(t):
    return t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def _tree(digests):
    """(top, [[(before, after), ...] per leaf])"""
    paths = [[] for _ in digests]
    owners = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        above, above_owners = [], []
        for at in range(0, len(digests), 8):
            run = digests[at : at + 8]
            for k in range(len(run)):
                for leaf in owners[at + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(_h(*run))
            above_owners.append([leaf for o in owners[at : at + 8] for leaf in o])
        digests, owners = above, above_owners
    return digests[0], paths


def _expected(rows):
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    per = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        per[lang] = (own, *_tree([_leaf(r) for r in own]))
    root, tops = _tree([per[lang][1] for lang in langs])
    out = []
    for lang, top in zip(langs, tops):
        own, sub, paths = per[lang]
        for r, p in zip(own, paths):
            path = p + top
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = _leaf((*r[:4], _lower(r[4]))) if hit else _leaf(r)
            for before, after in path:
                node = _h(before, node, after)
            out.append((r[0], _leaf(r), sub, root, _h(*[b + a for b, a in path]), node, node == root))
    return out


def _check(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS).repartition(3)
    got = [tuple(r) for r in manifest.tampered_proofs(df).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(_expected(rows), key=key)
    return got


def test_many_trees_against_a_plain_tree(spark):
    rng = random.Random(1)
    langs = [None, "", "de", "en", "é", "fr", "ü", "zz", "日本", "a"]
    rows = [(i * 7 - 50, rng.choice(["s", None, ""]), langs[0 if rng.random() < 0.4 else rng.randrange(10)], rng.choice([None, 3]),
             rng.choice([None, "", "Abc É x", "no capitals", "Q" * 5000])) for i in range(700)]
    got = _check(spark, rows)
    assert len({r[3] for r in got}) == 1 and 0 < sum(not r[6] for r in got) < len(got) / 3


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_sizes_around_the_fanout(spark, n):
    _check(spark, [(i, "s", "en", 1, f"T{i}") for i in range(n)])


def test_repeated_rows_and_missing_ids(spark):
    rows = [(None, "s", "en", 1, "same")] * 30 + [(4, "s", "en", 1, "same")] * 30 + [(4, None, "de", None, None)] * 3 + [(5, "s", "en", 1, "B")]
    _check(spark, rows)


def test_an_empty_table_and_an_edit(spark):
    assert manifest.tampered_proofs(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(i, "s", "en", 1, f"t{i}") for i in range(20)]
    root = {r[3] for r in _check(spark, rows)}
    assert root != {r[3] for r in _check(spark, [*rows[:-1], (19, "s", "en", 1, "t19!")])}


def test_a_hot_tree_lies_in_many_tasks(spark):
    from chainframe.llm.order import numbered_rows, ranked

    rows = numbered_rows(spark.range(20_000).selectExpr("if(id % 3 = 0, 'b', 'a') tree", "cast(null as long) id"), "hot")
    from pyspark.sql import functions as F

    out = ranked(rows, "tree", [F.col("id"), F.col("row")], "hot", per_task=1000)
    got = out.groupBy("tree").agg(F.count("pos").alias("c"), F.countDistinct("pos").alias("d"), F.max("pos").alias("m"), F.max("n").alias("n")).collect()
    assert all(r.c == r.d == r.m + 1 == r.n for r in got) and sum(r.c for r in got) == 20_000
    assert out.rdd.getNumPartitions() > 1


def test_registered_query(spark):
    from chainframe.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in documents(spark, sf).collect()]
    assert sorted(tuple(r) for r in QUERIES["op11_manifest"](spark, sf).collect()) == sorted(_expected(rows))
