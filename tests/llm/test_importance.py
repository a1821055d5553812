"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from chainframe.llm import importance
from chainframe.llm.text import documents

DOCS = "doc_id long, text string, importance string, score int"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text):
    words = WORD.findall((text or "").encode().lower())
    return words, words + [a + b" " + b for a, b in zip(words, words[1:])]


def _expected(rows, target, percent=25, min_words=20, buckets=10_000, seed=7):
    corpus, wanted = Counter(), Counter()
    for _, t in rows:
        corpus.update(zlib.crc32(f) % buckets for f in _features(t)[1])
    for t in target:
        wanted.update(zlib.crc32(f) % buckets for f in _features(t)[1])
    s_all, t_all = sum(corpus.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((corpus[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, t in rows:
        words, own = _features(t)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(words), len(own), weight, score, None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = place
    return sorted((tuple(r) for r in out), key=str)


def _target(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id long, text string")


def _text(rng, n, vocabulary):
    return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "-", "\n", ". ", "\t"]) for _ in range(n))


def test_draw_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["the", "The", "Éa", "été", "a1", "9", "日本語テキスト" * 2, "x" * 31, "y" * 32, "z" * 70, "q" * 15, "ÀB"] + [f"w{k}" for k in range(300)]
    rows = [(i, _text(rng, rng.randint(0, 90), vocabulary)) for i in range(300)] + [
        (300, None), (301, ""), (302, " -- \x00\x7f"), (303, "word"), (None, "no id " * 20), (7, "repeated id " * 15), (304, "same " * 5000)]
    target = [_text(rng, 40, vocabulary[:60]) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOCS).repartition(3)
    got = sorted((tuple(r) for r in importance.drawn(df, _target(spark, target)).collect()), key=str)
    assert got == _expected(rows, target)
    few = importance.drawn(df, _target(spark, target), percent=60, min_words=3, buckets=50, seed=1).collect()
    assert sorted((tuple(r) for r in few), key=str) == _expected(rows, target, 60, 3, 50, 1)


def test_ties_empty_tables_and_columns(spark):
    rows = [(5, "a b " * 20)] * 3 + [(2, "a b " * 20)] * 2
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOCS)
    got = importance.drawn(df, _target(spark, []), percent=80).collect()
    assert sorted((r.doc_id, r.rank or 0) for r in got) == sorted((i, r or 0) for i, *_, r in _expected(rows, [], 80))
    assert importance.drawn(spark.createDataFrame([], DOCS), _target(spark, ["x"])).count() == 0
    assert importance.importance_scores(df, _target(spark, ["a"])).columns == ["doc_id", "text", "importance", "score", "_importance"]


@pytest.mark.parametrize("most", [8, 64, 1000])
def test_runs_of_a_long_text_keep_every_feature(most):
    rng = random.Random(most)
    text = _text(rng, 400, ["ab", "c", "word" * 30, "é" * 5, "k9"])
    texts = ["", text, "tail end", text[:50]]
    words, features = Counter(), Counter()
    for table, entry, owner, single in importance.interned(pa.array(texts), 997, most):
        features.update(zip(owner.tolist(), table.bucket[entry].tolist()))
        words.update(owner[single].tolist())
    want = Counter((k, zlib.crc32(f) % 997) for k, t in enumerate(texts) for f in _features(t)[1])
    assert features == want
    assert all(words[k] == len(_features(t)[0]) for k, t in enumerate(texts))


def test_hashes_equal_the_libraries():
    rng = random.Random(0)
    for size in range(1, 32):
        own = [bytes(rng.randrange(256) for _ in range(size)) for _ in range(5)]
        lanes = [np.array([int.from_bytes(t[8 * k : 8 * k + 8], "little") for t in own], np.uint64) for k in range(-(-size // 8))]
        assert importance.short_xxhash64(lanes, size).tolist() == [xxhash.xxh64_intdigest(t) for t in own]
        assert importance.short_crc32(lanes, size).tolist() == [zlib.crc32(t) for t in own]


def test_equal_hashes_of_different_strings_stay_apart(monkeypatch):
    monkeypatch.setattr(importance, "short_xxhash64", lambda lanes, size: np.full(len(lanes[0]), 5, np.uint64))
    monkeypatch.setattr(importance.xxhash, "xxh64_intdigest", lambda t: 5)
    strings = [b"a", b"b", b"a", b"abcdefgh", b"abcdefgi", b"x" * 40, b"x" * 41, b"x" * 40, b"y" * 40]
    data = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    table = importance.Interner(1 << 20, len(strings))
    entry = table.add(data, np.cumsum(sizes) - sizes, sizes)
    assert len(set(entry.tolist())) == table.n == len(set(strings))
    by = dict(zip(entry.tolist(), strings))
    assert all(by[e] == s for e, s in zip(entry.tolist(), strings))
    assert {by[k]: int(table.count[k]) for k in range(table.n)} == Counter(strings)


def test_registered_query(spark):
    from chainframe.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = sorted(((i, f, w, s, r) for i, _, f, w, s, r in _expected(rows, target)), key=str)
    assert sorted((tuple(r) for r in QUERIES["op12_importance"](spark, sf).collect()), key=str) == want
