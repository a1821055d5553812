"""Fingerprints and byte-level BPE against plain Python and the public library."""

import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from chainframe.llm import bpe, fingerprint
from chainframe.llm.chunks import ChunkEncoder, library_encode, slices

SCHEMA = "doc_id long, text string, lang string, bucket string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash") for i, t in rows], SCHEMA).repartition(3)


def _edit(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))  # one row an id
    out = {}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out[i] = (len(t), t[: len(t) - half] + nxt[:half])
    return out


def _texts(n, seed=0):
    rng = random.Random(seed)
    words = [f"wörd{k}" for k in range(60)] + ["the", "of", "日本", "x."]
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 6))]
        rows.append((i * 7 + rng.randint(0, 3), "\n\n".join(lines) if i % 4 == 0 else "\n".join(lines)))
    return rows


def test_edits_and_roots(spark):
    rows = _texts(70) + [(900, None), (901, ""), (902, "same"), (903, "same"), (2 ** 62, "far"), (None, "no id")]
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(_frame(spark, rows), per_bucket=4).collect()}
    want = _edit(rows)
    assert set(got) == set(want)
    for i, (n, edited) in want.items():
        assert got[i].n_chars == n
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[902].fingerprint == got[903].fingerprint and got[902].near_next == 1.0
    assert got[900].fingerprint == got[901].fingerprint
    texts = {t or "" for _, t in rows}
    assert len({r.fingerprint for r in got.values()}) == len(texts)
    by_edit = {}
    for i, (_, edited) in want.items():
        assert by_edit.setdefault(edited, got[i].edited_fingerprint) == got[i].edited_fingerprint
    near = [r for i, r in got.items() if want[i][0] > 60]
    assert sum(r.near_edited > r.near_next for r in near) > 0.95 * len(near)


def test_a_text_of_one_document_follows_itself(spark):
    r = fingerprint.edited_fingerprints(_frame(spark, [(5, "abcdef")])).collect()
    assert len(r) == 1 and r[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


def test_differences_are_located(spark):
    a = "one\ntwo\n\nthree\nfour\n\nfive"
    b = "one\ntwo\n\nthree\nFOUR\n\nfive"
    df = spark.createDataFrame([(a, b), (a, a), (a, a + "\nsix"), (a, a + "\n\nsix")], "a string, b string")
    at = fingerprint.locate(fingerprint.merkle_tree(F.col("a")), fingerprint.merkle_tree(F.col("b")))
    assert [tuple(r[0]) for r in df.select(at).collect()] == [(1, 1), (-1, -1), (2, 0), (2, 0)]


def _plain_root(text):
    import re

    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    def cut(t, ends):
        out = re.split(ends, t)
        return out
    sections = []
    for s in cut(text, r"(?<=\n\n)"):
        sections.append(h(*[h(p) for p in cut(s, r"(?<=\n)")]))
    return h(*sections)


def test_roots_and_likeness_of_texts_without_spaces(spark):
    rng = random.Random(12)
    chinese = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(400))
    rows = [(1, chinese), (2, "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(400))), (3, "QUJD" * 3 + "x" * 900), (4, "one two.\n\nthree")]
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(_frame(spark, rows)).collect()}
    assert 0.3 < got[1].near_edited < 0.7 and got[1].near_next < 0.05
    for i, t in rows:
        assert got[i].fingerprint == _plain_root(t)
        assert got[i].edited_fingerprint == _plain_root(_edit(rows)[i][1])


def test_many_rows_without_id_or_with_one_are_cut(spark):
    rows = [(None, f"none {k % 40}") for k in range(150)] + [(7, f"seven {k}") for k in range(150)] + [(10 ** 15, "far")] + [(20 + k, f"t{k}") for k in range(150)]
    got = fingerprint.with_next(_frame(spark, rows), per_bucket=4)
    pairs = sorted((r.doc_id is not None, r.doc_id or 0, r.text, r.next_text) for r in got.collect())
    # successors of an id's rows are one cycle through all rows: each text follows as often as it occurs
    assert sorted(t for *_, t in pairs) == sorted(t for _, t in rows)
    hashed = {r.t: r.h for r in spark.createDataFrame([(t,) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
    want = sorted((i is not None, i or 0, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    assert pairs == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fingerprint.edited_fingerprints(empty).count() == 0
    assert bpe.encode_documents(empty, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _odd_texts():
    rng = random.Random(3)
    letters = "ab c\n\t   é日本'sll'd 12!<|endoftext|>\x1f\x85 　😀"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [
        "", " ", "  ", "a" * 5000, "ab" * 3000, " \n ", "\n\n  x", "aaa " * 100, "<|endoftext|> hi", "don't  stop", "x\n  y", "tail \n"]


def test_encoding_and_round_trip(spark, reference):
    texts = _odd_texts()
    rows = list(enumerate(texts)) + [(9000, None), (0, texts[0])]
    df = bpe.encode_documents(_frame(spark, rows), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        text = "" if r.doc_id == 9000 else texts[r.doc_id]
        ids = reference.encode_ordinary(text)
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()


def test_a_lower_rank_that_a_merge_opens_comes_first():
    # "b"+"c" (2) makes "abc" (1) possible, which must precede the second "b"+"c"
    ranks = {bytes([k]): 100 + k for k in range(256)} | {b"abc": 1, b"bc": 2, b"abca": 0}
    queue = bpe.RankQueue(400)

    def plain(piece):
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while True:
            best = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    rng = random.Random(1)
    for _ in range(2000):
        piece = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 14)))
        assert bpe.bpe(piece, ranks, queue) == plain(piece), piece
        assert queue.pop() is None


def test_rank_queue_gives_ranks_in_order():
    q, rng = bpe.RankQueue(300_000), random.Random(2)
    ranks = [rng.randrange(300_000) for _ in range(500)]
    for k, r in enumerate(ranks):
        q.push(r, 1000 - k)
    out = []
    while (x := q.pop()) is not None:
        assert x[1] == sorted(x[1])
        out += [x[0]] * len(x[1])
    assert out == sorted(ranks)


def test_caches_start_anew_without_changing_results(reference):
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        encode = library_encode(f.read())
    encoder = ChunkEncoder(encode, public_tokenizers.PATTERN, most_bytes=500_000)  # starts anew now and then
    texts = _odd_texts()
    for k in range(0, len(texts), 40):
        ids, counts = encoder.ids(pa.array(texts[k : k + 40]))
        at = 0
        for t, n in zip(texts[k : k + 40], counts.tolist()):
            assert ids[at : at + n].tolist() == reference.encode_ordinary(t)
            at += n


def test_runs_of_rows_are_bounded_and_whole():
    texts = ["a" * n for n in (5, 500, 1, 0, 99, 100, 3)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["doc_id", "text"])
    parts = list(slices(batch, most_bytes=100))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 100 for p in parts)
