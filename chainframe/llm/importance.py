"""Resampling of documents towards a target distribution by hashed n-gram importance weights.

Texts are lower-cased (A-Z) and split into words of ASCII letters and digits and of all other
characters above 7F. Features are the runs of one and two consecutive words, joined by one
space; a feature's bucket is its crc32 modulo ``buckets``. With t of T target features and s of S
corpus features in a bucket, its gain is floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))); a
document's weight is the floored mean gain of its features. A Gumbel number from the sha256 of
its id makes the draw of the highest scores a sample without replacement.

*Open-addressed NumPy table* (``Interner``): a task reads texts in bounded runs of words. Every
occurrence of a feature is hashed with xxhash64 (by vectors of equal length; features of 32 bytes
or more one by one), probed linearly in a table of entry numbers, and taken as equal only if all
its bytes are. An entry holds its bucket and its count, so crc32 is computed once a distinct
feature. The first pass sums counts by bucket, per task and then by one small ``groupBy``; the
second gathers each occurrence's gain through its entry.

Two passes over the texts, no shuffle of features; what is collected and broadcast are
``buckets`` numbers. The draw ranks light rows (id, score) by a range partitioning.

Defined results: a null text has no words, a document without words weight 0; a null id hashes
as the empty string and loses ties; rows with one id are separate documents with one Gumbel
number; ties of score and id go by reading order; an empty target gives T = 0; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainframe.llm.chunks import release_encoder, slices
from chainframe.llm.order import numbered_rows, ranked

#: The primes of xxhash64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_SHORT = 32  # shorter features are hashed and compared as four 8-byte lanes
_RUN_BYTES = 1 << 20


def _lowered() -> np.ndarray:
    """A byte's lower-case form, a space for bytes that are in no word."""
    out = np.full(256, 0x20, np.uint8)
    out[0x80:] = np.arange(0x80, 0x100)
    for low, high in ((0x30, 0x3A), (0x61, 0x7B)):
        out[low:high] = np.arange(low, high)
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    return out


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_LOWER, _CRC = _lowered(), _crc_table()


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def short_xxhash64(lanes: list[np.ndarray], size: int) -> np.ndarray:
    """xxhash64 (seed 0) of byte strings of one ``size`` under 32, given as little-endian 8-byte
    lanes with zeros behind the end."""
    h = np.full(len(lanes[0]), _P5 + np.uint64(size), np.uint64)
    for k in range(size // 8):
        h ^= _rotated(lanes[k] * _P2, 31) * _P1
        h = _rotated(h, 27) * _P1 + _P4
    left = size % 8
    tail = lanes[size // 8] if left else None
    if left >= 4:
        h ^= (tail & np.uint64(0xFFFFFFFF)) * _P1
        h = _rotated(h, 23) * _P2 + _P3
        tail, left = tail >> np.uint64(32), left - 4
    for _ in range(left):
        h ^= (tail & np.uint64(0xFF)) * _P5
        h = _rotated(h, 11) * _P1
        tail = tail >> np.uint64(8)
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    return h ^ (h >> np.uint64(32))


def short_crc32(lanes: list[np.ndarray], size: int) -> np.ndarray:
    crc = np.full(len(lanes[0]), 0xFFFFFFFF, np.uint32)
    for k in range(size):
        byte = (lanes[k // 8] >> np.uint64(8 * (k % 8))).astype(np.uint32)
        crc = _CRC[(crc ^ byte) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return ~crc


class Interner:
    """An open-addressed table of byte strings: equal strings get one entry, which holds their
    bucket and count. ``add`` returns the entry of each occurrence."""

    def __init__(self, buckets: int, most: int) -> None:
        """``most``: an upper bound of the occurrences to come."""
        self._buckets = buckets
        size = 1 << max(4, (2 * most - 1).bit_length())
        self._mask = np.uint64(size - 1)
        self._slots = np.full(size, -1, np.int32)
        self._claims = np.empty(size, np.int32)
        self._keys = np.empty(most, np.uint64)
        self._lanes = [np.empty(most, np.uint64) for _ in range(_SHORT // 8)]
        self._sizes = np.empty(most, np.int32)
        self._long: dict[int, bytes] = {}  # entry to bytes, where these exceed the lanes
        self.bucket, self.count = np.empty(most, np.int32), np.zeros(most, np.int64)
        self.n = 0

    def _probe(self, keys: np.ndarray, size: int, lanes: list[np.ndarray], texts: list[bytes] | None) -> np.ndarray:
        """Entries of strings of one ``size`` (or of ``texts``, where that is -1)."""
        out = np.empty(len(keys), np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), (keys & self._mask).astype(np.int64)
        while len(left):
            entry = self._slots[slot]
            free = np.flatnonzero(entry < 0)
            if len(free):
                at, who = slot[free], left[free]
                self._claims[at] = who  # of several, the last stays
                won = self._claims[at] == who
                self._slots[at[won]] = self._added(keys, size, lanes, texts, who[won])
                entry = self._slots[slot]
            same = (self._keys[entry] == keys[left]) & (self._sizes[entry] == size)
            if texts is None:
                for k in range(-(-size // 8)):
                    same &= self._lanes[k][entry] == lanes[k][left]
            else:
                for k in np.flatnonzero(same):
                    same[k] = self._long[int(entry[k])] == texts[left[k]]
            out[left[same]] = entry[same]
            left, slot = left[~same], (slot[~same] + 1) & np.int64(self._mask)
        return out

    def _added(self, keys: np.ndarray, size: int, lanes: list[np.ndarray], texts: list[bytes] | None, who: np.ndarray) -> np.ndarray:
        new = np.arange(self.n, self.n + len(who), dtype=np.int32)
        self._keys[new], self._sizes[new] = keys[who], size
        if texts is None:
            own = [lane[who] for lane in lanes]
            for k, lane in enumerate(own):
                self._lanes[k][new] = lane
            crc = short_crc32(own, size)
        else:
            own = [texts[k] for k in who]
            self._long.update(zip(new.tolist(), own))
            crc = np.array([zlib.crc32(t) for t in own], np.uint32)
        self.bucket[new] = crc % np.uint32(self._buckets)
        self.n += len(who)
        return new

    def add(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Entries of the strings ``data[start : start + size]`` (sizes above 0)."""
        out = np.empty(len(starts), np.int32)
        padded = np.concatenate([data, np.zeros(_SHORT, np.uint8)])
        # the eight bytes from each place on, as one number
        wide = np.ndarray(len(data) + _SHORT - 7, "<u8", padded, 0, (1,)).copy()
        capped = np.minimum(sizes, _SHORT).astype(np.uint8)
        order = np.argsort(capped, kind="stable")
        bounds = np.searchsorted(capped[order], np.arange(_SHORT + 2))
        for size in range(1, _SHORT):
            rows = order[bounds[size] : bounds[size + 1]]
            if not len(rows):
                continue
            at = starts[rows]
            lanes = [wide[at + 8 * k] for k in range(-(-size // 8))]
            if size % 8:
                lanes[-1] &= np.uint64((1 << 8 * (size % 8)) - 1)
            out[rows] = self._probe(short_xxhash64(lanes, size), size, lanes, None)
        rows = order[bounds[_SHORT] :]
        if len(rows):
            view = data.tobytes()
            texts = [view[a : a + s] for a, s in zip(starts[rows].tolist(), sizes[rows].tolist())]
            keys = np.fromiter((xxhash.xxh64_intdigest(t) for t in texts), np.uint64, len(texts))
            out[rows] = self._probe(keys, -1, [], texts)
        self.count[: self.n] += np.bincount(out, minlength=self.n)
        return out


def _words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts (``raw[bounds[i] : bounds[i + 1]]``): lower-cased bytes in which
    neighbours of one text stand a space apart, each word's start and size there, its text."""
    low = _LOWER[raw]
    inside = low != 0x20
    first = np.zeros(len(raw) + 1, bool)
    first[bounds] = True
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    before &= ~first[:-1]
    starts = np.flatnonzero(inside & ~before)
    keep = inside | before  # a word's bytes and the byte after it
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    after &= ~first[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    places = np.cumsum(keep, dtype=np.int64)
    owner = np.searchsorted(bounds, starts, side="right") - 1
    return low[keep], places[starts] - 1, ends - starts, owner


def _parts(text: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, int]]:
    """A long text in parts of about ``most`` bytes, cut between words. Each part but the first
    begins with the last word of the one before; the second item tells (0 or 1 words)."""
    at, lead = 0, 0
    while at < len(text):
        end = min(len(text), at + most)
        while end < len(text) and _LOWER[text[end]] != 0x20:
            step = np.flatnonzero(_LOWER[text[end : end + most]] == 0x20)
            end = end + int(step[0]) if len(step) else min(len(text), end + most)
        yield text[at:end], lead
        if end == len(text):
            return
        inside = _LOWER[text[at:end]] != 0x20
        last = np.flatnonzero(inside)
        if len(last):  # back to the start of the last word
            gaps = np.flatnonzero(~inside[: last[-1]])
            begin = at + (int(gaps[-1]) + 1 if len(gaps) else 0)
            if end - begin > most // 2:  # a word of nearly a part's size: take it along whole
                most = 2 * (end - begin) + most
            at, lead = begin, 1
        else:
            at, lead = end, 0


def interned(texts: pa.Array, buckets: int, most_bytes: int = _RUN_BYTES) -> Iterator[tuple[Interner, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of the texts' words: the run's table, the entry of each feature's occurrence, the
    number of its text, and whether it is one word."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1)
        end = min(end, len(texts))
        own, bounds = raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        parts = [(own, bounds, 0)] if end > at + 1 or len(own) <= most_bytes else (
            (p, np.array([0, len(p)]), lead) for p, lead in _parts(own, most_bytes))
        for data, edges, lead in parts:
            low, starts, sizes, owner = _words(data, edges)
            if len(starts) <= lead:
                continue
            pair = np.flatnonzero(owner[1:] == owner[:-1])
            all_starts = np.concatenate([starts[lead:], starts[pair]])
            all_sizes = np.concatenate([sizes[lead:], starts[pair + 1] + sizes[pair + 1] - starts[pair]])
            table = Interner(buckets, len(all_starts))
            entry = table.add(low, all_starts, all_sizes)
            yield table, entry, at + np.concatenate([owner[lead:], owner[pair]]), np.arange(len(entry)) < len(starts) - lead
        at = end


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket, over all texts of ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoder()
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, most_bytes=_RUN_BYTES):
                for table, *_ in interned(pc.fill_null(part.column("text"), ""), buckets):
                    total += np.bincount(table.bucket[: table.n], table.count[: table.n], buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "c"])

    sums = rows.select("text").mapInArrow(run, "bucket int, c long").groupBy("bucket").agg(F.sum("c").alias("c")).collect()
    out = np.zeros(buckets, np.int64)
    for r in sums:
        out[r["bucket"]] = r["c"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+n) / ((s+1)(T+n)))) of each of n buckets."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t + 1) * float(s_all + n)) / (float(s + 1) * float(t_all + n))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """floor(1000 G) of the Gumbel number G of an id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def importance_scores(docs: DataFrame, target: DataFrame, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """``docs`` (all columns) with a struct of n_words, n_features, weight and score, named
    ``importance`` (after underscores, where ``docs`` has such a column)."""
    name = "importance"
    while name in docs.columns:
        name = f"_{name}"
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    bound = docs.sparkSession.sparkContext.broadcast(gains)
    names = ("n_words", "n_features", "weight", "score")
    kind = T.StructType([T.StructField(c, T.LongType()) for c in names])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoder()
        for batch in batches:
            for part in slices(batch, most_bytes=_RUN_BYTES):
                n = part.num_rows
                words, features, total = (np.zeros(n, np.int64) for _ in range(3))
                for table, entry, owner, single in interned(pc.fill_null(part.column("text"), ""), buckets):
                    gain = bound.value[table.bucket[: table.n]][entry]
                    words += np.bincount(owner[single], minlength=n)
                    features += np.bincount(owner, minlength=n)
                    total += np.bincount(owner, gain, n).astype(np.int64)
                weight = total // np.maximum(features, 1)
                noise = np.fromiter((gumbel(i, seed) for i in part.column("doc_id").to_pylist()), np.int64, n)
                own = pa.StructArray.from_arrays([pa.array(x) for x in (words, features, weight, weight + noise)], names=names)
                yield pa.RecordBatch.from_arrays([*part.columns, own], names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def drawn(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, and rank, the place in the
    draw of floor(percent * N / 100) of the N documents with at least ``min_words`` words."""
    scores = importance_scores(docs.select("doc_id", "text"), target, buckets, seed)
    light = numbered_rows(scores.select("doc_id", "importance.*"), "importance")
    able = light.filter(F.col("n_words") >= min_words)
    most = percent * able.count() // 100
    placed = ranked(able.withColumn("all", F.lit(0)), "all", [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")], "importance-order")
    rank = F.when(F.col("pos") < most, F.col("pos") + 1)
    cols = ["doc_id", "n_words", "n_features", "weight", "score"]
    rest = light.filter(F.col("n_words") < min_words).select(*cols, F.lit(None).cast("long").alias("rank"))
    return placed.select(*cols, rank.alias("rank")).unionByName(rest)
