"""Best-fit packing of token sequences with bound-certified repacking.

1. ``token_pieces``: each text's ids and an end id; only documents longer than ``capacity`` are
   cut, into pieces of ``capacity`` ids (the first may be shorter).
2. ``pack``: pieces are dealt by the hash of a stored row number to partitions of about ``per_partition``; each runs
   best-fit decreasing and computes lower bounds by dual-feasible functions. A partition whose
   bin count meets its bound is certified and gives up only its few emptiest bins; one with a
   gap gives up more. What is given up from ``fan_in`` partitions meets in one, is packed again
   by best-fit decreasing, and the new bins are taken if they are fewer. This repeats until one
   partition is left, so the share of badly filled bins falls by
   ``fan_in`` each time while every task keeps a bounded number of rows.

Only lengths and check sums travel; the ids stay where they were made.

Defined results: a null or empty text is its end id alone; rows with equal content, with one id
or without an id are packed like any others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainframe.llm.chunks import ChunkEncoder, library_encode, slices, worker_encoder
from chainframe.llm.order import numbered_rows
from chainframe.llm.text import whole_text, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each document, and the new counts."""
    out = np.empty(len(ids) + len(counts), np.uint32)
    number = np.arange(len(counts))
    out[np.arange(len(ids)) + np.repeat(number, counts)] = ids
    out[np.cumsum(counts) + number] = end_id
    return out, counts + 1


def cut(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of each piece, in order."""
    k = -(-counts // capacity)
    doc = np.repeat(np.arange(len(counts)), k)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
    first = counts - capacity * (k - 1)
    start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, first[doc], capacity)


def library_tokens(spark, vocabulary: str, pattern: str):
    """A function for tasks that returns the worker's encoder of a tokenizers file."""
    with open(vocabulary, "rb") as f:  # a megabyte or two
        data = f.read()
    key = ("library", hashlib.sha256(data).hexdigest(), pattern)
    shared = spark.sparkContext.broadcast(data)
    return lambda: worker_encoder(key, lambda: ChunkEncoder(library_encode(shared.value), pattern))


def token_pieces(docs: DataFrame, vocabulary: str, pattern: str, capacity: int, end_id: int) -> DataFrame:
    encoder_of = library_tokens(docs.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of()
        for batch in batches:
            for part in slices(batch):
                ids, counts = with_end(*encoder.ids(part.column("text")), end_id)
                doc, piece, start, length = cut(counts, capacity)
                at = (np.cumsum(counts) - counts)[doc] + start
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return whole_text(docs).mapInArrow(run, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length (given in descending order) and the bins' free space."""
    room = [[] for _ in range(capacity + 1)]  # bins by free space
    used = 0  # bit r: some bin has r free
    bins, offsets, free = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, n in enumerate(lengths.tolist()):
        fits = used >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                used &= ~(1 << r)
        else:
            r, b = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        free[b] = r - n
        if r > n:
            room[r - n].append(b)
            used |= 1 << (r - n)
    return bins, offsets, np.array(free, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int, most_k: int = 20) -> int:
    """Bins that any packing needs: the best of the volume bound, the threshold functions
    f_p (items over capacity - p fill a bin, those under p vanish) and the rounding functions
    u_k (x to floor((k+1)x)/k, kept where (k+1)x is whole), all dual feasible."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    volume, number = np.append(0, np.cumsum(count * size)), np.append(0, np.cumsum(count))
    best = -(-int(volume[-1]) // capacity)
    p = np.arange(1, capacity // 2 + 1)
    f = capacity * (number[-1] - number[capacity - p + 1]) + volume[capacity - p + 1] - volume[p]
    best = max(best, -(-int(f.max(initial=0)) // capacity))
    for k in range(1, most_k + 1):
        scaled = (k + 1) * size
        u = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * u).sum()) // (capacity * k)))
    return best


def _packer(round_no: int, capacity: int, last: bool):
    """Packs one partition's rows; bins given up are marked ``open``."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [("length", "descending"), ("row", "ascending")]))
        lengths = t.column("length").to_numpy()
        bins, offsets, free = best_fit_decreasing(lengths, capacity)
        base = (round_no << 56) + (t.column("bucket")[0].as_py() << 24)
        if round_no:
            old, again = np.unique(t.column("sequence_id").to_numpy(), return_inverse=True)
            if len(old) <= len(free):  # not fewer bins: keep the old ones
                bins, offsets, base = again, t.column("offset").to_numpy(), None
                free = capacity - np.bincount(bins, lengths, len(old)).astype(np.int64)
        ids = old[bins] if base is None else base + bins
        gap = len(free) - lower_bound(lengths, capacity)
        given_up = np.zeros(len(free), bool)
        if not last:
            given_up[np.argsort(-free, kind="stable")[: 4 * (gap + 1)]] = True
        t = t.drop_columns(["sequence_id", "offset", "open"])
        for name, values in (("sequence_id", ids), ("offset", offsets), ("open", given_up[bins])):
            t = t.append_column(name, pa.array(values))
        return t

    return pack


def pack(pieces: DataFrame, capacity: int, per_partition: int = 16384, fan_in: int = 16) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` is a stored table with a number per
    row, ``row``, that the result leaves out."""
    n = pieces.count()
    width = max(1, -(-n // per_partition))
    todo = (pieces.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(width)))
            .withColumn("sequence_id", F.lit(-1).cast("long")).withColumn("offset", F.lit(-1).cast("long"))
            .withColumn("open", F.lit(True)))
    done, last = [], False
    while not last:
        last = width == 1
        packed = written(todo.groupBy("bucket").applyInArrow(_packer(len(done), capacity, last), todo.schema), "packed")
        done.append(packed.filter("not open"))
        width = -(-width // fan_in)
        todo = packed.filter("open").withColumn("bucket", F.floor(F.col("bucket") / fan_in))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("bucket", "open", "row")


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 2048, end_id: int = 0,
                   per_partition: int = 16384) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = numbered_rows(token_pieces(docs, vocabulary, pattern, capacity, end_id), "pieces")
    return pack(pieces, capacity, per_partition)
