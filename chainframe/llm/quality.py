"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1, the unlabelled set is web text whose labels
are not looked at, and the class prior is estimated as the share of quality 1 among the
labelled training rows. A small network on text statistics is trained to minimise the
non-negative unbiased risk (Kiryo et al. 2017)

    R = prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),

stepping against the clipped part whenever it is below zero. With the logistic loss its output is
the probability of quality 1.

Features come from the text alone: shares of byte-class pairs (letters by case, digits, marks,
symbols, white space, UTF-8 lead and tail bytes), repeated neighbouring words, distinct words
and lines, word and line lengths, and size. Those of the training rows are computed over whole
texts once and stored, about a kilobyte a row.

Every step is a full batch: risk and gradient over *all* unlabelled training rows are summed in
tasks, one row of some fifty kilobytes a task, and above ``_FAN_IN`` tasks summed again in groups
of as many before they reach the driver. Only the labelled positives are bounded: at most about
``max_fit_rows``, the first by a hash of doc_id. The weights are broadcast each step, and to score
every row.

Defined results: a null or empty text has the features of no bytes and gets a score; without
labelled positives every score is the prior (0.5 without any label); a null label is no label;
with several labels for one doc_id, it is positive if all of them are 1; repeated rows are
scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainframe.llm.chunks import release_encoder, slices
from chainframe.llm.text import written

#: Byte classes, each the bytes of a string, then ranges.
_MARKS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\x0b\x0c",
          ".", ",", "!?", "'\"-", "|", "#$%&*@^~+=<>/\\_`", ":;()[]{}")
_N_CLASSES = 16


def _byte_classes() -> np.ndarray:
    out = np.full(256, 15, np.uint8)
    for k, chars in enumerate(_MARKS):
        out[list(chars.encode())] = k
    out[0xC0:] = 13
    out[0x80:0xC0] = 14
    return out


_CLASS = _byte_classes()
N_FEATURES = _N_CLASSES**2 + 9


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``N_FEATURES`` numbers per text (without nulls)."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    out = np.zeros((n, N_FEATURES), np.float32)
    if len(raw):
        kind = _CLASS[raw]
        pair = np.repeat(np.arange(n, dtype=np.int64) * _N_CLASSES**2, size)[:-1] + (kind[:-1] * np.int64(_N_CLASSES) + kind[1:])
        ends = np.cumsum(size)
        inside = np.ones(len(raw), bool)
        inside[ends[size > 0] - 1] = False  # the last byte of a text starts no pair
        pairs = np.bincount(pair[inside[:-1]], minlength=n * _N_CLASSES**2).reshape(n, -1)
        out[:, : _N_CLASSES**2] = np.sqrt(pairs / np.maximum(size - 1, 1)[:, None])

    def pieces(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bounds = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten().dictionary_encode()
        length = pc.binary_length(flat.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
        code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(n), np.diff(bounds))
        real = length[code] > 0
        return code[real], owner[real], length

    def distinct(code: np.ndarray, owner: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.bincount(np.unique(owner * max(1, len(length)) + code) // max(1, len(length)), minlength=n)

    k = _N_CLASSES**2
    for lists in (pc.ascii_split_whitespace(texts), pc.split_pattern(texts, "\n")):
        code, owner, length = pieces(lists)
        count = np.bincount(owner, minlength=n)
        some = np.maximum(count, 1)
        same = (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
        out[:, k] = np.bincount(owner[1:][same], minlength=n) / some
        out[:, k + 1] = distinct(code, owner, length) / some
        out[:, k + 2] = np.log1p(np.bincount(owner, length[code], n) / some)
        out[:, k + 3] = np.log1p(count)
        k += 4
    out[:, k] = np.log1p(size)
    return out


@dataclass
class Network:
    """One hidden layer on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-(h @ self.w2 + self.b2)))

    def sums(self, x: np.ndarray, of_output: bool = False) -> np.ndarray:
        """Over the rows of x: their number, the losses of calling them negative, and the gradient of
        those losses by ``weights``; with ``of_output`` also the gradient of the output."""
        n = self.weights().size
        out = np.zeros(2 + n * (1 + of_output))
        mean, scale, w1 = (a.astype(np.float32) for a in (self.mean, self.scale, self.w1))
        for k in range(0, len(x), 4096):
            s = np.clip((x[k : k + 4096] - mean) / scale, -6, 6)
            h = np.tanh(s @ w1 + self.b1)
            z = h @ self.w2 + self.b2
            p = 1 / (1 + np.exp(-z))
            parts = [np.array([len(s), np.logaddexp(0, z).sum()])]
            for g in (p, np.ones_like(p))[: 1 + of_output]:  # the loss's derivative by the output is p
                gh = g[:, None] * self.w2 * (1 - h * h)
                parts += [(s.T @ gh.astype(np.float32)).ravel(), gh.sum(axis=0), h.T @ g, [g.sum()]]
            out += np.concatenate(parts)
        return out

    def weights(self) -> np.ndarray:
        return np.concatenate([self.w1.ravel(), self.b1, self.w2, [self.b2]])

    def with_weights(self, w: np.ndarray) -> Network:
        a = self.w1.size
        b = a + self.b1.size
        c = b + self.w2.size
        return Network(self.mean, self.scale, w[:a].reshape(self.w1.shape), w[a:b], w[b:c], float(w[c]))


def fit_nnpu(positive: np.ndarray, unlabelled: Callable[[Network], np.ndarray], prior: float,
             moments: tuple[np.ndarray, np.ndarray], hidden: int = 24, steps: int = 32, rate: float = 0.05,
             decay: float = 1e-3, seed: int = 7) -> Network:
    """Minimises the non-negative unbiased risk by full-batch Adam. ``unlabelled``: the network's
    ``sums`` over all unlabelled rows; ``moments``: mean and standard deviation of their features."""
    rng = np.random.default_rng(seed)
    mean, scale = moments[0], moments[1] + 1e-3
    net = Network(mean, scale, rng.normal(0, mean.size**-0.5, (mean.size, hidden)), np.zeros(hidden),
                  rng.normal(0, 0.1, hidden), float(np.log(prior / (1 - prior))))
    w = net.weights()
    m, v, n = np.zeros_like(w), np.zeros_like(w), w.size
    decayed = np.ones(n)
    decayed[net.w1.size : net.w1.size + hidden] = decayed[-1] = 0.0  # not the offsets
    for step in range(1, steps + 1):
        net = net.with_weights(w)
        p, u = net.sums(positive, of_output=True), unlabelled(net)
        negative_risk = u[1] / u[0] - prior * p[1] / p[0]
        if negative_risk >= 0:  # of a positive: prior * ((p - 1) - p)
            grad = u[2:] / u[0] - prior * p[2 + n :] / p[0]
        else:
            grad = prior * p[2 : 2 + n] / p[0] - u[2:] / u[0]
        grad = grad + decay * decayed * w
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        w = w - lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net.with_weights(w)


def feature_table(rows: DataFrame) -> DataFrame:
    """The features of the rows' texts, stored: x, the numbers of some texts one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoder()
        for batch in batches:
            for part in slices(batch, most_bytes=2 << 20):
                yield pa.RecordBatch.from_arrays([pa.array([features(part.column("text")).tobytes()], pa.binary())], names=["x"])

    return written(rows.select("text").mapInArrow(run, "x binary"), "quality-features")


def _matrix(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.float32).reshape(-1, N_FEATURES)


_FAN_IN = 64


def summed(table: DataFrame, tasks: int, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``of`` (a vector of ``size``) over the matrices of a feature table."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column("x"):
                total += of(_matrix(x))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def together(t: pa.Table) -> pa.Table:
        t = t.sort_by("v")  # in one order, however they arrive
        return pa.table({"g": t.column("g")[:1], "v": pa.array([sum(np.frombuffer(v.as_buffer()) for v in t.column("v")).tobytes()], pa.binary())})

    rows = table.mapInArrow(one, "v binary")
    groups = tasks
    while groups > _FAN_IN:
        groups = -(-groups // _FAN_IN)
        rows = rows.select(F.pmod(F.xxhash64("v"), F.lit(groups)).alias("g"), "v").groupBy("g").applyInArrow(together, "g long, v binary").select("v")
    return sum((np.frombuffer(r["v"]) for r in sorted(rows.collect(), key=lambda r: bytes(r["v"]))), np.zeros(size))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _moments(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, max_fit_rows: int = 30_000, steps: int = 32) -> Network | float:
    """The network, or the prior alone where there is no positive. Rows of fold 0 are not used."""
    train = F.coalesce(fold_of(F.col("doc_id"), folds) != 0, F.lit(False))
    known = (labels.filter(train & F.col("quality").isNotNull()).groupBy("doc_id")
             .agg(F.min("quality").cast("int").alias("quality")))
    stats = known.agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("p")).first()
    if not stats["n"]:
        return 0.5
    prior = min(0.99, max(0.01, stats["p"] / stats["n"]))
    # about max_fit_rows of the labelled positives, by a hash of the id
    share = min(1.0, max_fit_rows / max(1, stats["p"] or 0))
    chosen = known.filter("quality = 1").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("doc_id")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = feature_table(texts.join(F.broadcast(chosen), "doc_id", "left_semi")).toArrow().column("x")
    positive = np.concatenate([np.zeros((0, N_FEATURES), np.float32), *[_matrix(x) for x in found]])
    table = feature_table(texts.filter(train))
    tasks = table.rdd.getNumPartitions()
    total = summed(table, tasks, _moments, 1 + 2 * N_FEATURES)
    if not len(positive) or not total[0]:
        return prior
    mean = total[1 : 1 + N_FEATURES] / total[0]
    std = np.sqrt(np.maximum(total[1 + N_FEATURES :] / total[0] - mean * mean, 0.0))

    def unlabelled(net: Network) -> np.ndarray:
        return summed(table, tasks, net.sums, 2 + net.weights().size)  # weights go with the tasks

    return fit_nnpu(positive, unlabelled, prior, (mean, std), steps=steps)


def scored(docs: DataFrame, model: Network | float, name: str = "quality_score") -> DataFrame:
    """``docs`` (all columns) with a score from 0 to 1 in column ``name``."""
    bound = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoder()
        net = bound.value
        for batch in batches:
            for part in slices(batch, most_bytes=2 << 20):
                x = features(pc.fill_null(part.column("text"), ""))
                p = np.full(len(x), net) if isinstance(net, float) else net.probability(x)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.clip(p, 0.0, 1.0))],
                                                 names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, max_fit_rows: int = 30_000) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, folds, max_fit_rows)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out"),
                      F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, max_fit_rows: int = 30_000) -> DataFrame:
    """The documents scored at least ``threshold``, with all their columns."""
    name = "quality_score"
    while name in docs.columns:
        name = f"_{name}"
    out = scored(docs, fit(docs, labels, folds, max_fit_rows), name)
    return out.filter(F.col(name) >= threshold).select(*docs.columns)
