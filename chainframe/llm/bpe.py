"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

For one pattern match, each merge rank has a bucket of linked-list positions (the left part of
a pair); three levels of 64-bit words mark which buckets hold anything, so find-first-set gives
the next rank in three steps whatever the match's length. An entry whose pair has changed since
is stale and skipped. Positions of one rank are merged from the left; a merge that opens a
lower rank puts the rest of the bucket back. The result is that of merging, again and again,
the leftmost pair of the lowest rank.

Spark deals the texts to tasks; inside a task equal matches are encoded once (``chunks``).

Defined results: a null or empty text has no ids; every byte decodes to itself, so decoding
returns the text's UTF-8; rows are independent, so repeated rows get equal results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chainframe.llm.chunks import ChunkEncoder, slices, worker_encoder
from chainframe.llm.text import whole_text


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file's lines of base64 and number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class RankQueue:
    """Merge ranks 0 to n-1, each with a bucket of positions."""

    def __init__(self, n: int) -> None:
        self.low = [0] * ((n >> 6) + 1)
        self.mid = [0] * ((n >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank in use, with its positions from left to right."""
        top = self.top
        if not top:
            return None
        b = (top & -top).bit_length() - 1
        word = self.mid[b]
        a = (b << 6) + (word & -word).bit_length() - 1
        bits = self.low[a]
        rank = (a << 6) + (bits & -bits).bit_length() - 1
        self.low[a] = bits = bits & (bits - 1)
        if not bits:
            self.mid[b] = word = word & (word - 1)
            if not word:
                self.top = top & (top - 1)
        bucket = self.buckets.pop(rank)
        if len(bucket) > 1:
            bucket.sort()
        return rank, bucket


def bpe(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """Ids of one pattern match; ``queue`` is empty before and after."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after = list(range(1, n + 1))  # start of the next part; n: none
    before = list(range(-1, n - 1))
    pair = [-1] * n  # rank of the part at a position with the next one; -1: none
    get, push = ranks.get, queue.push
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            pair[i] = r
            push(r, i)
    while (found := queue.pop()) is not None:
        rank, bucket = found
        for k, i in enumerate(bucket):
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            end = after[j]
            after[i] = end
            pair[j] = -1
            lower = False
            pair[i] = -1
            if end < n:
                before[end] = i
                r = get(piece[i : after[end]])
                if r is not None:
                    pair[i] = r
                    push(r, i)
                    lower = r < rank
            p = before[i]
            if p >= 0:
                r = get(piece[p:end])
                pair[p] = -1 if r is None else r
                if r is not None:
                    push(r, p)
                    lower = lower or r < rank
            if lower:
                for left in bucket[k + 1 :]:
                    push(rank, left)
                break
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


def bpe_encoder(ranks: dict[bytes, int], pattern: str) -> ChunkEncoder:
    queue = RankQueue(max(ranks.values()) + 1)

    def encode(matches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = [bpe(m.encode("utf-8"), ranks, queue) for m in matches]
        lens = np.fromiter(map(len, own), np.int64, len(own))
        return np.arange(len(own)), np.fromiter((i for ids in own for i in ids), np.int32, int(lens.sum())), lens

    return ChunkEncoder(encode, pattern)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit),
    decoded_sha256 (bytes decoded from the ids), and with ``with_ids`` the ids themselves."""
    with open(rank_file, "rb") as f:  # under a megabyte
        data = f.read()
    key = ("bpe", hashlib.sha256(data).hexdigest(), pattern)
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(shared.value)
        token = {r: b for b, r in ranks.items()}.__getitem__
        encoder = worker_encoder(key, lambda: bpe_encoder(ranks, pattern))
        for batch in batches:
            for part in slices(batch):
                ids, counts = encoder.ids(part.column("text"))
                ends = np.cumsum(counts)
                own = [ids[e - c : e] for e, c in zip(ends, counts)]
                cols = [part.column("doc_id"), pa.array(counts, pa.int64()),
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own]),
                        pa.array([hashlib.sha256(b"".join(map(token, x.tolist()))).hexdigest() for x in own])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return whole_text(docs).mapInArrow(run, schema)
