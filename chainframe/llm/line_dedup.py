"""Line dedup by a segment-partition edit join.

Two different lines link when their edit distance, on UTF-8 bytes, is at most ``tau`` and both
have at least ``min_bytes`` bytes; equal lines are one line. Classes are the components of the
links, and of each class the first occurrence (smallest doc_id, then line number) stays.

* A line of length l is cut into ``tau + 1`` even segments. ``tau`` edits leave one segment of
  the shorter line whole, at a shift that the edits left and right of it allow, so the longer
  line need only be probed with a few substrings for each length from l - tau to l.
* Segments and substrings are keyed by length, segment number and a rolling hash, taken from
  prefix sums over a whole run of text.
* Keys with one line only are dropped by a window over the key (one row a key and line, never
  pairs). The rest are joined in two steps: first each line with its neighbour at each key, a
  linear number of pairs; then, between different components only, all index rows with all
  probe rows of a key. A 64-bit parity sketch of byte pairs, which one edit changes in at most
  four bits, drops pairs before the join gives them out; it loses no link.
* Pairs are verified by banded bit-parallel edit distance, a column at a time over many pairs.

Defined results: null and empty texts have no lines; white-space lines are left alone and not
counted; shorter lines than ``min_bytes`` are only compared for equality; rows without doc_id
share one id, ordered first; repeated rows hold the same lines, so only the first keeps them
(rows with one doc_id are one document here); an empty table gives no rows. Lines are known by
a 62-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainframe.llm.chunks import release_encoder, slices
from chainframe.llm.components import components, joined
from chainframe.llm.text import HOT_SHARE, IdFilter, spread_join, written

_RUN = 2 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_NO_ID = -(1 << 63)
INDEX, PROBE = 1, 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lines:
    """The lines of a run of texts: raw bytes, and each line's place, owner and number."""

    def __init__(self, texts: pa.Array) -> None:
        lists = pc.split_pattern(texts.cast(pa.large_string()), "\n")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten().cast(pa.large_binary())
        if isinstance(flat, pa.ChunkedArray):
            flat = flat.combine_chunks()
        offsets = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, 8 * flat.offset)
        blank = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(lists.flatten())), 0).to_numpy(zero_copy_only=False)
        keep = np.flatnonzero(~blank)
        self.raw = np.frombuffer(flat.buffers()[2] or b"", np.uint8)
        self.start, self.end = offsets[:-1][keep], offsets[1:][keep]
        self.owner = np.repeat(np.arange(len(texts)), np.diff(bounds))[keep]
        self.number = (np.arange(len(flat)) - np.repeat(bounds[:-1] - bounds[0], np.diff(bounds)))[keep]
        data = self.raw.tobytes()
        self.id = np.fromiter((xxhash.xxh64_intdigest(data[a:b]) >> 2 for a, b in zip(self.start.tolist(), self.end.tolist())),
                              np.int64, len(keep))

    def bytes(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]].tobytes()

    def sketches(self) -> np.ndarray:
        """Per line, the parity of its byte pairs in 64 classes."""
        out = np.zeros(len(self.id), np.int64)
        if len(self.raw) < 2:
            return out
        r = self.raw.astype(np.uint64)
        bit = np.uint64(1) << (_mix(r[:-1] * np.uint64(256) + r[1:]) & np.uint64(63))
        upto = np.append(np.uint64(0), np.bitwise_xor.accumulate(bit))
        some = self.end - self.start >= 2
        out[some] = (upto[self.end[some] - 1] ^ upto[self.start[some]]).view(np.int64)
        return out


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for name, b in (("up", _BASE), ("down", inverse)):
            powers = np.full(max(n, _RUN + 1), b, np.uint64)
            powers[0] = 1
            _POWERS[name] = np.multiply.accumulate(powers)
    return _POWERS["up"], _POWERS["down"]


def segment_keys(lines: Lines, rows: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, role) of the segments and substrings of lines ``rows``. A substring of the
    line's own length without shift is its segment: one row in both roles."""
    up, down = _powers(len(lines.raw) + 1)
    before = np.append(np.uint64(0), np.cumsum((lines.raw.astype(np.uint64) + np.uint64(1)) * up[: len(lines.raw)], dtype=np.uint64))
    start, size = lines.start[rows], lines.end[rows] - lines.start[rows]
    keys, owners, roles = [], [], []

    def add(own: np.ndarray, at: np.ndarray, n: np.ndarray, length: np.ndarray, segment: int, role: int) -> None:
        h = (before[at + n] - before[at]) * down[at]
        tag = length.astype(np.uint64) * np.uint64(64) + np.uint64(segment)
        keys.append(_mix(h + _mix(tag)).view(np.int64))
        owners.append(own)
        roles.append(np.full(len(own), role, np.int64))

    for delta in range(tau + 1):
        length = size - delta  # of the indexed line
        for i in range(tau + 1):
            low, high = i * length // (tau + 1), (i + 1) * length // (tau + 1)
            for shift in range(max(-i, delta - (tau - i)), min(i, delta + (tau - i)) + 1):
                at = low + shift
                own = np.flatnonzero((at >= 0) & (at + (high - low) <= size) & (length > 0))
                role = INDEX | PROBE if delta == 0 and shift == 0 else PROBE
                add(rows[own], start[own] + at[own], (high - low)[own], length[own], i, role)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(roles)


def banded_distance(a: list[bytes], b: list[bytes], tau: int) -> np.ndarray:
    """Edit distances of pairs, exact up to ``tau``, larger than it otherwise. Bit k of a band
    word is row j + k - tau of column j; the score is kept on the diagonal that ends at the
    last cell, whose steps cost 1 where the diagonal-zero bit is unset."""
    swap = [len(x) > len(y) for x, y in zip(a, b)]
    a, b = [y if s else x for x, y, s in zip(a, b, swap)], [x if s else y for x, y, s in zip(a, b, swap)]
    m, n = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    out = np.maximum(n - m, 0)
    todo = np.flatnonzero(out <= tau)
    if not len(todo):
        return out
    width, longest = 2 * tau + 1, int(n[todo].max())
    rows = np.full((longest + width + 1, len(todo)), 256, np.int16)
    cols = np.full((longest, len(todo)), 257, np.int16)
    for k, i in enumerate(todo.tolist()):
        rows[tau : tau + m[i], k] = np.frombuffer(a[i], np.uint8)
        cols[: n[i], k] = np.frombuffer(b[i], np.uint8)
    m, n = m[todo], n[todo]
    apart = n - m
    diagonal = (tau - apart).astype(np.uint64)
    mask = np.uint64((1 << width) - 1)
    vp = np.full(len(todo), ((1 << width) - 1) & ~((1 << tau) - 1), np.uint64)
    vn = np.zeros(len(todo), np.uint64)
    score = apart.astype(np.int64)
    one = np.uint64(1)
    for j in range(1, longest + 1):
        match = np.zeros(len(todo), np.uint64)
        for k in range(width):
            match |= (rows[j - 1 + k] == cols[j - 1]).astype(np.uint64) << np.uint64(k)
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        score += ((j > apart) & (j <= n) & (((d0 >> diagonal) & one) == 0)).astype(np.int64)
        vp = (hn | ~((d0 >> one) | hp)) & mask
        vn = (d0 >> one) & hp
    out[todo] = score
    return out


# --- jobs ------------------------------------------------------------------------------------

def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, lines: array<struct<number, id>> of each text's lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoder()
        for batch in batches:
            for part in slices(batch, most_bytes=_RUN):
                own = Lines(part.column("text"))
                ends = np.append(0, np.cumsum(np.bincount(own.owner, minlength=part.num_rows))).astype(np.int32)
                lines = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
                    [pa.array(own.number.astype(np.int32)), pa.array(own.id)], names=["number", "id"]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lines], names=["doc_id", "lines"])

    return docs.mapInArrow(run, "doc_id long, lines array<struct<number: int, id: long>>")


def keyed_lines(docs: DataFrame, tau: int, min_bytes: int) -> DataFrame:
    """(key, line): one row for each segment or substring of the distinct lines of a run; the
    two low bits of ``line`` hold the role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoder()
        for batch in batches:
            for part in slices(batch, most_bytes=_RUN):
                own = Lines(part.column("text"))
                _, first = np.unique(own.id, return_index=True)
                first = first[own.end[first] - own.start[first] >= min_bytes]
                if not len(first):
                    continue
                key, row, role = segment_keys(own, first, tau)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array((own.id[row] << 2) | role)], names=["key", "line"])

    return docs.select("text").mapInArrow(run, "key long, line long")


def _line_bytes(docs: DataFrame, wanted: IdFilter) -> DataFrame:
    """line, size, sketch, spelled of every line of the documents that ``wanted`` keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(wanted.test(batch.column("slot").to_numpy())))
            for part in slices(batch, most_bytes=_RUN):
                own = Lines(part.column("text"))
                _, first = np.unique(own.id, return_index=True)
                sketch = own.sketches()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.id[first]), pa.array((own.end - own.start)[first].astype(np.int32)), pa.array(sketch[first]),
                     pa.array([own.bytes(i) for i in first.tolist()], pa.binary())], names=["line", "size", "sketch", "spelled"])

    return docs.select(IdFilter.slot(F.col("doc_id")).alias("slot"), "text").mapInArrow(
        run, "line long, size int, sketch long, spelled binary")


def _verified(pairs: DataFrame, spelled: DataFrame, tau: int) -> DataFrame:
    """The pairs (a, b) within ``tau`` edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("x", "y"))
            order = np.argsort([len(x) for x in a], kind="stable").tolist()
            near = np.zeros(len(a), bool)
            k = 0
            while k < len(order):  # runs of like length, of bounded size
                most, end = len(a[order[k]]), k
                while end < len(order) and (end == k or (len(a[order[end]]) + 1) * (end - k + 1) <= 1 << 21) and end - k < 4096:
                    end += 1
                own = order[k:end]
                near[own] = banded_distance([a[i] for i in own], [b[i] for i in own], tau) <= tau
                k = end
            yield batch.select(["a", "b"]).filter(pa.array(near))

    text = spelled.select("line", "spelled")
    # neither side has a bounded size: no broadcast
    both = (pairs.hint("merge").join(text.select(F.col("line").alias("a"), F.col("spelled").alias("x")), "a").hint("merge")
            .join(text.select(F.col("line").alias("b"), F.col("spelled").alias("y")), "b"))
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _near(p: str, q: str, tau: int) -> Column:
    apart = F.bit_count(F.col(f"{p}.sketch").bitwiseXOR(F.col(f"{q}.sketch")))
    return (F.abs(F.col(f"{p}.size") - F.col(f"{q}.size")) <= tau) & (apart <= 4 * tau)


def line_classes(docs: DataFrame, lines: DataFrame, tau: int, min_bytes: int) -> DataFrame:
    """(line, root) of every line that is linked with others and is not its class's root."""
    seen = Window.partitionBy("key")
    line = F.shiftrightunsigned("line", 2)
    # a key stays if it has different lines, one of them indexed
    # (copies of a common line are combined first, where they are read)
    live = (keyed_lines(docs, tau, min_bytes).select("key", line.alias("line"), F.col("line").bitwiseAND(3).alias("role")).distinct()
            .withColumn("least", F.min("line").over(seen)).withColumn("most", F.max("line").over(seen))
            .withColumn("roles", F.expr("bit_or(role) over (partition by key)"))
            .filter("least <> most and roles = 3").select("key", "line", "role"))
    live = written(live, "line-keys")
    linked = live.select("line").distinct()
    where = (lines.select("doc_id", F.explode("lines.id").alias("line")).join(linked, "line", "left_semi")
             .groupBy("line").agg(F.min("doc_id").alias("id")))
    spelled = _line_bytes(docs, IdFilter(where.select("id").distinct())).join(linked, "line", "left_semi")
    spelled = written(spelled.dropDuplicates(["line"]), "line-bytes")
    rows = written(live.join(spelled.select("line", "size", "sketch"), "line"), "line-rows")

    near = Window.partitionBy("key").orderBy("size", F.xxhash64("key", "line"))
    me = F.struct("line", "size", "sketch")
    chained = (rows.select("key", me.alias("q"), F.lag(me).over(near).alias("p"))
               .filter("p is not null and p.line <> q.line").filter(_near("p", "q", tau))
               .select(F.least("p.line", "q.line").alias("a"), F.greatest("p.line", "q.line").alias("b")).distinct())
    roots = components(_verified(chained, spelled, tau))
    tagged = rows.join(roots.withColumnRenamed("id", "line"), "line", "left").withColumn("root", F.coalesce("root", "line"))
    index, probe = tagged.filter(F.col("role").bitwiseAND(INDEX) != 0), tagged.filter(F.col("role").bitwiseAND(PROBE) != 0)
    rest = (index.alias("p").join(probe.alias("q"), (F.col("p.key") == F.col("q.key")) & (F.col("p.line") != F.col("q.line"))
                                  & (F.col("p.root") != F.col("q.root")) & (F.col("p.size") <= F.col("q.size")) & _near("p", "q", tau))
            .select(F.least("p.line", "q.line").alias("a"), F.greatest("p.line", "q.line").alias("b")).distinct())
    return joined(roots, _verified(rest, spelled, tau)).select(F.col("id").alias("line"), "root")


def line_decisions(docs: DataFrame, tau: int = 2, min_bytes: int = 16) -> DataFrame:
    """Per doc_id: n_lines, n_kept, n_near (dropped lines without an equal one before them),
    kept (their line numbers) and class_docs (per line, the document its class begins in)."""
    texts = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lines = written(line_table(texts), "lines")
    classes = line_classes(texts, lines, tau, min_bytes)
    at = lines.select("doc_id", F.explode("lines").alias("l")).select("doc_id", F.col("l.number").alias("number"), F.col("l.id").alias("line"))
    # one row a distinct line: where it and its class begin, and how often it occurs
    place = F.struct("doc_id", "number")
    per_line = written(at.groupBy("line").agg(F.min(place).alias("equal"), F.count(F.lit(1)).alias("c")), "line-first")
    per_line = per_line.join(classes, "line", "left").withColumn("root", F.coalesce("root", "line"))
    facts = written(per_line.join(per_line.groupBy("root").agg(F.min("equal").alias("first")), "root")
                    .select("line", "equal", "first", "c"), "line-facts")
    total = facts.agg(F.sum("c")).first()[0] or 0
    hot = facts.filter(F.col("c") > max(16, total // HOT_SHARE)).select("line")
    judged = spread_join(at, facts.drop("c"), "line", hot).select(
        "doc_id", "number", (place == F.col("first")).alias("keep"), (place == F.col("equal")).alias("new"),
        F.col("first.doc_id").alias("class_doc"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    per_doc = judged.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), count(F.col("keep")).alias("n_kept"), count(F.col("new") & ~F.col("keep")).alias("n_near"),
        F.array_sort(F.collect_list(F.struct("number", "keep", "class_doc"))).alias("all"))
    out = texts.select("doc_id").distinct().join(per_doc, "doc_id", "left")
    none = F.array().cast("array<int>")
    zero = F.lit(0).cast("long")
    return out.select(
        F.when(F.col("doc_id") != F.lit(_NO_ID), F.col("doc_id")).alias("doc_id"),
        *[F.coalesce(c, zero).alias(c) for c in ("n_lines", "n_kept", "n_near")],
        F.coalesce(F.transform(F.filter("all", lambda x: x["keep"]), lambda x: x["number"]), none).alias("kept"),
        F.coalesce(F.transform("all", lambda x: x["class_doc"]), F.array().cast("array<long>")).alias("class_docs"))


def dedup_lines(docs: DataFrame, tau: int = 2, min_bytes: int = 16) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``; all other columns as they were."""
    d = line_decisions(docs, tau, min_bytes).select(F.col("doc_id").alias("_id"), F.col("kept").alias("_kept"))
    joined = docs.join(d, docs["doc_id"].eqNullSafe(d["_id"]))
    blank = lambda x: F.length(F.trim(F.translate(x, "\t\r\x0b\x0c", "    "))) == 0
    text = F.array_join(F.filter(F.split(docs["text"], "\n"), lambda x, i: blank(x) | F.array_contains(d["_kept"], i)), "\n")
    return joined.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])
