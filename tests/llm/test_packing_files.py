"""Packing, sharding and token files against the library's own ids and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chainframe.llm import packing, sharding, token_files

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, size int, shard string"


def _frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def ids_of():
    tok = Tokenizer.from_file(VOCABULARY)
    tok.encode_special_tokens = True
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def _rows(seed=0):
    rng = random.Random(seed)
    words = ["the", "wörld", "of", "thinking", "日本", "!!", "a\n", "<|endoftext|>"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 20, 70, 300])))) for i in range(60)]
    return rows + [(100, None), (101, ""), (103, "twin"), (105, "twin"), (104, "long " * 700), (-3, "negative")]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("per_partition", [7, 16384])
def test_packing(spark, ids_of, per_partition):
    rows, capacity = _rows(), 64
    got = packing.pack_documents(_frame(spark, rows), VOCABULARY, public_tokenizers.PATTERN, capacity, 0, per_partition).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == {i for i, _ in rows}
    for i, t in rows:
        ids, at = [*ids_of(t), 0], 0
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        for k, r in enumerate(own):
            assert r.start == at and (r.length == capacity or k == 0) and 0 < r.length <= capacity
            assert r.ids_crc32 == _crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // capacity) + 2


def test_lower_bounds_hold_and_reach_small_optima():
    rng = random.Random(4)

    def optimum(sizes, cap):
        best = [len(sizes)]

        def place(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(sizes):
                best[0] = len(bins)
                return
            for b in sorted(set(bins)):
                if b + sizes[k] <= cap:
                    i = bins.index(b)
                    place(k + 1, bins[:i] + [b + sizes[k]] + bins[i + 1 :])
            place(k + 1, bins + [sizes[k]])

        place(0, [])
        return best[0]

    certified = 0
    for _ in range(60):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 8))), reverse=True)
        lengths = np.array(sizes)
        bound, bins = packing.lower_bound(lengths, 20), len(packing.best_fit_decreasing(lengths, 20)[2])
        assert bound <= optimum(sizes, 20) <= bins
        certified += bound == bins
    assert certified > 50
    assert packing.lower_bound(np.array([], np.int64), 20) == 0
    assert packing.lower_bound(np.array([11, 11, 11]), 20) == 3  # by thresholds, the volume says 2


def test_shards(spark):
    rng = random.Random(1)
    rows = [(i, "w" * rng.randint(0, 400) + " x" * rng.randint(0, 9)) for i in range(600)]
    rows += [(1000 + i, "a hot text that holds a third of all rows") for i in range(400)] + [(2000, None), (2001, "")]
    for per_partition in (200, 16384):
        got = sharding.shard_documents(_frame(spark, rows), 6, per_partition).collect()
        assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
        texts = dict(rows)
        by = {}
        for r in got:
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
            by.setdefault(r.shard, []).append(r)
        assert set(by) == set(range(6))
        for own in by.values():
            assert sorted(r.slot for r in own) == list(range(len(own)))
        loads = [sum(r.size for r in own) for own in by.values()]
        assert max(loads) - min(loads) <= 0.02 * max(loads)
    # small groups of equal texts stay together
    twins = [(i, f"text number {i // 3} of some") for i in range(6000)]
    shards = {}
    for r in sharding.shard_documents(_frame(spark, twins), 4).collect():
        shards.setdefault(r.doc_id // 3, set()).add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_shards_are_equal_where_pieces_exceed_a_partitions_share(spark):
    rng = random.Random(2)
    rows = [(i, "w" * rng.randint(0, 400)) for i in range(24_000)]  # 360 partitions of 100 rows
    rows += [(100_000 + i, "hot" * 66) for i in range(12_000)] + [(200_000 + i, "long" * 9_000 + str(i)) for i in range(5)]
    loads = {}
    for r in sharding.shard_documents(_frame(spark, rows), 4, 100).collect():
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert sum(loads.values()) == sum(len(t) + 8 for _, t in rows)
    assert max(loads.values()) - min(loads.values()) <= 0.005 * max(loads.values())


def test_copies_under_one_id_are_split_like_others(spark):
    rng = random.Random(7)
    rows = [(i, f"{i} " + "w" * rng.randint(0, 200)) for i in range(6_000)] + [(77, "a hot text under one id " * 4)] * 3_000 + [(None, "no id")] * 500
    got = sharding.shard_documents(_frame(spark, rows), 6, 500).collect()
    loads = {}
    for r in got:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert len(got) == len(rows) and max(loads.values()) - min(loads.values()) <= 0.005 * max(loads.values())


def test_placing_follows_the_dot_product_rule():
    rng = np.random.default_rng(4)
    units = np.stack([rng.integers(8, 500, 300), rng.integers(1, 90, 300), rng.integers(1, 4, 300)], axis=1).astype(float)
    shards, got = 5, sharding.place(units, 5, 2)
    capacity = [sum(u[k] for u in units) / shards for k in range(3)]
    left = [[1.0] * 3 for _ in range(shards)]
    seen, total, want = 0.0, sum(u[0] for u in units), {}
    for i in sorted(range(300), key=lambda i: -units[i][0]):
        v = [units[i][k] / max(capacity[k], 1) for k in range(3)]
        w = sharding.WEIGHTS if seen < total * (1 - sharding.TAIL) else sharding.TAIL_WEIGHTS
        fits = [s for s in range(shards) if left[s][0] >= v[0]]
        if fits:
            best = max(fits, key=lambda s: (sum(w[k] * v[k] * left[s][k] for k in range(3)), -s))
        else:
            best = max(range(shards), key=lambda s: (left[s][0], -s))
        for k in range(3):
            left[best][k] -= v[k]
        seen += units[i][0]
        want[i] = (best + 2) % shards
    assert [want[i] for i in range(300)] == got.tolist()


def test_many_rows_without_id_are_dealt_over_tasks(spark, ids_of):
    rows = [(None, f"text {k}") for k in range(300)] + [(k, "other") for k in range(300)]
    got = packing.pack_documents(_frame(spark, rows), VOCABULARY, public_tokenizers.PATTERN, 64, 0, 50).collect()
    assert sum(r.length for r in got) == sum(len(ids_of(t)) + 1 for _, t in rows) and len(got) == len(rows)
    bound = -(-sum(r.length for r in got) // 64)
    assert len({r.sequence_id for r in got}) <= bound + 2
    whole = token_files.token_files(_frame(spark, rows), VOCABULARY, public_tokenizers.PATTERN).collect()
    assert sorted(r.start for r in whole)[0] == 0 and sum(r.n_tokens for r in whole) == sum(len(ids_of(t)) + 1 for _, t in rows)
    spans = sorted((r.start, r.n_tokens) for r in whole)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert max(r.start for r in whole if r.doc_id is None) < min(r.start for r in whole if r.doc_id is not None)


@pytest.mark.parametrize("n,most", [(0, 9), (1, 9), (127, 4), (128, 0), (129, 50257), (70_000, 50257), (5_000, 2 ** 32 - 1)])
def test_token_file_round_trip(n, most):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, most + 1, n, dtype=np.uint32)
    if n > 1000:
        ids[::97] = most  # outliers
        ids[1 : n // 2] %= 300
    f = token_files.TokenFile(token_files.encode_file(ids, [None, -(2 ** 62)], np.array([n // 3, n - n // 3])))
    assert (f.ids() == ids).all() and f.doc_ids == [None, -(2 ** 62)] and f.counts.tolist() == [n // 3, n - n // 3]
    for k in range(len(f.low)):
        assert (f.read_block(k) == ids[128 * k : 128 * k + 128]).all()
    if n == 70_000:
        assert f.outliers.sum() > 0 and len(f.body) < 2 * n


def test_token_file_checks_its_magic():
    with pytest.raises(ValueError):
        token_files.TokenFile(b"something else entirely, of forty bytes..")


@pytest.mark.parametrize("file_ids", [50, 1 << 18])
def test_files_in_ascending_order(spark, ids_of, file_ids, tmp_path):
    rows = _rows(2)
    path = str(tmp_path / "files")
    got = {r.doc_id: r for r in token_files.token_files(_frame(spark, rows), VOCABULARY, public_tokenizers.PATTERN, 2, file_ids, path).collect()}
    at = 0
    for i, t in sorted(rows):
        ids = [*ids_of(t), 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), _crc(ids))
        at += len(ids)
    files = spark.read.parquet(path)
    order = [d for r in files.orderBy("part", "seq").collect() for d in token_files.TokenFile(r.payload).doc_ids]
    assert order == sorted(order) and len(order) == len(rows)
    assert files.agg(F.sum("n_ids")).first()[0] == at
    whole = {r.doc_id: list(r.ids) for r in token_files.read_tokens(spark, path, with_ids=True).collect()}
    assert whole == {i: [*ids_of(t), 2] for i, t in rows}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.pack_documents(empty, VOCABULARY, public_tokenizers.PATTERN).count() == 0
    assert sharding.shard_documents(empty).count() == 0
    assert token_files.token_files(empty, VOCABULARY, public_tokenizers.PATTERN).count() == 0
