"""Token-ID output in patched frame-of-reference blocks.

A token file is one byte string, little-endian throughout:

    8 bytes   magic ``TOKPFOR1``
    uint64 x3 number of ids, of documents, of blocks
    uint8     bytes of an outlier's value (2 or 4)
    int64[]   doc_id of each document; uint8[] 1 where the doc_id is null; uint64[] its ids
    uint32[]  block minimum; uint8[] block width; uint8[] block outliers; uint64[] block start
    bytes     blocks, each ``16 * width`` bytes of packed values, then the positions (uint8)
              and full values of its outliers

Blocks hold 128 ids. A block's values are its ids less its minimum; its width is that of the
percentile of its values, among ``PERCENTILES``, that makes the block smallest, and values
beyond it are outliers. The index of block starts lets ``read_block`` decode one block alone.

``write_tokens`` range-partitions the texts by ``doc_id``, so that files, in the order of
(part, seq), hold the documents in ascending order, and stores each file as a row of a Parquet
table: a container that every store Spark can write to accepts. A file closes at the first
document end after ``file_ids`` ids, which bounds a task's memory by that and its longest text.

Defined results: a null or empty text is its end id alone; rows without doc_id come first;
repeated ids are ordered by the hash of their text; an empty table gives no files and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainframe.llm.chunks import slices
from chainframe.llm.packing import library_tokens, with_end
from chainframe.llm.text import shared_folder, whole_text

MAGIC = b"TOKPFOR1"
BLOCK = 128
PERCENTILES = (75, 90, 95, 98, 100)
FILES = "part int, seq int, n_docs long, n_ids long, payload binary"


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """uint64 values under 2^width, 128 a row, to ``16 * width`` bytes a row."""
    lanes = np.ascontiguousarray(values.reshape(-1, 64).T)
    words = np.zeros((width, lanes.shape[1]), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        words[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8", copy=False).view(np.uint8).reshape(len(values), 16 * width)


def _unpack(data: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(data.reshape(-1).view("<u8").reshape(-1, width).T).astype(np.uint64, copy=False)
    lanes = np.empty((64, words.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        v = words[word] >> np.uint64(shift)
        if shift + width > 64:
            v |= words[word + 1] << np.uint64(64 - shift)
        lanes[i] = v & mask
    return np.ascontiguousarray(lanes.T).reshape(-1, BLOCK)


def encode_file(ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray) -> bytes:
    """One token file of the documents' ids (unsigned 32-bit), one document after another."""
    n_blocks = -(-len(ids) // BLOCK)
    full = np.empty(n_blocks * BLOCK, np.uint32)
    full[: len(ids)] = ids
    if len(ids):
        full[len(ids) :] = ids[-1]
    full = full.reshape(-1, BLOCK)
    low = full.min(axis=1, initial=0xFFFFFFFF) if n_blocks else np.zeros(0, np.uint32)
    values = (full - low[:, None]).astype(np.uint64)
    ranked = np.sort(full - low[:, None], axis=1)
    outlier_bytes = 2 if not n_blocks or int(ranked[:, -1].max()) < 1 << 16 else 4
    width = np.zeros(n_blocks, np.int64)
    smallest = np.full(n_blocks, np.iinfo(np.int64).max)
    for p in PERCENTILES:
        at = -(-BLOCK * p // 100) - 1
        w = np.ceil(np.log2(ranked[:, at].astype(np.float64) + 1)).astype(np.int64)
        size = 16 * w + (1 + outlier_bytes) * (BLOCK - 1 - at)
        better = size < smallest
        width[better], smallest[better] = w[better], size[better]
    is_out = values >> width[:, None].astype(np.uint64) != 0
    outliers = is_out.sum(axis=1)
    size = 16 * width + outliers * (1 + outlier_bytes)
    start = np.cumsum(size) - size
    body = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            packed = _pack(values[rows] & np.uint64((1 << int(w)) - 1), int(w))
            body[start[rows][:, None] + np.arange(16 * w)] = packed
    row, position = np.nonzero(is_out)
    if len(row):
        rank = np.arange(len(row)) - np.repeat(np.cumsum(outliers) - outliers, outliers)
        base = start[row] + 16 * width[row]
        body[base + rank] = position
        exact = values[row, position].astype(f"<u{outlier_bytes}").view(np.uint8).reshape(-1, outlier_bytes)
        body[(base + outliers[row] + outlier_bytes * rank)[:, None] + np.arange(outlier_bytes)] = exact
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([
        MAGIC, np.array([len(ids), len(doc_ids), n_blocks], "<u8").tobytes(), bytes([outlier_bytes]),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), counts.astype("<u8").tobytes(),
        low.astype("<u4").tobytes(), width.astype(np.uint8).tobytes(), outliers.astype(np.uint8).tobytes(),
        start.astype("<u8").tobytes(), body.tobytes()])


class TokenFile:
    """Reads a token file's bytes."""

    def __init__(self, payload: bytes) -> None:
        if payload[:8] != MAGIC:
            raise ValueError("not a token file")
        self.n_ids, n_docs, n_blocks = (int(x) for x in np.frombuffer(payload, "<u8", 3, 8))
        self.outlier_bytes, at = payload[32], 33

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        ids, null = column("<i8", n_docs), column("u1", n_docs)
        self.doc_ids = [None if z else d for d, z in zip(ids.tolist(), null.tolist())]
        self.counts = column("<u8", n_docs).astype(np.int64)
        self.low, self.width = column("<u4", n_blocks), column("u1", n_blocks).astype(np.int64)
        self.outliers, self.start = column("u1", n_blocks).astype(np.int64), column("<u8", n_blocks).astype(np.int64)
        self.body = np.frombuffer(payload, np.uint8, -1, at)

    def _blocks(self, rows: np.ndarray) -> np.ndarray:
        values = np.zeros((len(rows), BLOCK), np.uint64)
        width, start, outliers = self.width[rows], self.start[rows], self.outliers[rows]
        for w in np.unique(width):
            if w:
                own = np.flatnonzero(width == w)
                values[own] = _unpack(self.body[start[own][:, None] + np.arange(16 * w)], int(w))
        row = np.repeat(np.arange(len(rows)), outliers)
        if len(row):
            rank = np.arange(len(row)) - np.repeat(np.cumsum(outliers) - outliers, outliers)
            base = start[row] + 16 * width[row]
            at = (base + outliers[row] + self.outlier_bytes * rank)[:, None] + np.arange(self.outlier_bytes)
            values[row, self.body[base + rank]] = np.ascontiguousarray(self.body[at]).view(f"<u{self.outlier_bytes}").ravel()
        return values.astype(np.uint32) + self.low[rows][:, None]

    def read_block(self, k: int) -> np.ndarray:
        """The ids of block ``k`` alone."""
        return self._blocks(np.array([k]))[0][: self.n_ids - k * BLOCK]

    def ids(self) -> np.ndarray:
        return self._blocks(np.arange(len(self.low))).ravel()[: self.n_ids]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, pattern: str, end_id: int, file_ids: int = 1 << 18) -> None:
    """Writes the container of token files at ``path``."""
    encoder_of = library_tokens(docs.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = encoder_of(), TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        n_held = 0

        def closed() -> pa.RecordBatch:
            nonlocal seq, n_held
            names = [d for h in held for d in h[0]]
            ids, counts = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            held.clear()
            n_held = 0
            seq += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq - 1], pa.int32()), pa.array([len(names)], pa.int64()),
                 pa.array([len(ids)], pa.int64()), pa.array([encode_file(ids, names, counts)], pa.binary())],
                names=["part", "seq", "n_docs", "n_ids", "payload"])

        for batch in batches:
            for rows in slices(batch):
                ids, counts = with_end(*encoder.ids(rows.column("text")), end_id)
                names, ends = rows.column("doc_id").to_pylist(), np.append(0, np.cumsum(counts))
                at = 0
                while at < len(names):  # up to the document that fills the file
                    end = min(len(names), int(np.searchsorted(ends, ends[at] + file_ids - n_held, side="left")))
                    held.append((names[at:end], ids[ends[at] : ends[end]], counts[at:end]))
                    n_held += int(ends[end] - ends[at])
                    at = end
                    if n_held >= file_ids:
                        yield closed()
        if held:
            yield closed()

    # rows with one id or without any go by the hash of their text, then by their row number, so
    # that many of them are dealt over several tasks
    order = ["doc_id", "hash", "row"]
    rows = whole_text(docs).select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(run, FILES).write.option("parquet.block.size", str(16 << 20)).option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files at ``path``: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32, and with ``with_ids`` its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, payload in zip(*(batch.column(c) for c in ("part", "seq", "payload"))):
                f = TokenFile(payload.as_py())
                ids = f.ids()
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                ends = np.cumsum(f.counts)
                begins = ends - f.counts
                n = len(f.counts)
                cols = [pa.array([part.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int32()),
                        pa.array(f.doc_ids, pa.int64()), pa.array(begins, pa.int64()), pa.array(f.counts, pa.int64()),
                        pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())], pa.int64())]
                names = ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    files = spark.read.schema(FILES).parquet(path)
    docs = files.select("part", "seq", "payload").mapInArrow(
        run, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    # ids before each file: those of the parts before (a row a part), and in its part
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("parts_before"))
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (files.select("part", "seq", F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("files_before"))
               .join(parts, "part").select("part", "seq", (F.col("parts_before") + F.col("files_before")).alias("before")))
    return docs.join(offsets, ["part", "seq"]).select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_files(docs: DataFrame, vocabulary: str, pattern: str, end_id: int = 2, file_ids: int = 1 << 18,
                path: str | None = None) -> DataFrame:
    """Writes the files (below the shared folder unless ``path`` is given) and reads them back."""
    spark = docs.sparkSession
    path = path or shared_folder(spark, "token-files")
    write_tokens(docs, path, vocabulary, pattern, end_id, file_ids)
    return read_tokens(spark, path)
