"""Language-model scoring by prediction by partial matching over a byte-context trie.

The model predicts each byte of a text (A-Z lower-cased), then an end symbol, from the longest
context of at most ``ORDER`` preceding bytes that the trie holds. In a context seen T times with
D distinct symbols, a seen symbol has c/(T+D) and the escape D/(T+D) (method C); after an escape
the next shorter context is used with every symbol of the longer one excluded. Order 0 escapes
to a uniform choice among the 256 symbols (255 bytes that UTF-8 can hold, and the end) not
excluded. Text begins and ends with byte FF, which UTF-8 never holds.

``fit`` counts, over all training documents, every word and every (ORDER+1)-gram, combining per
task before the shuffle; both tables grow with the corpus and stay in Spark. Shorter contexts'
counts are sums of longer ones'. The trie given to the tasks is a cache of bounded size: the
``max_contexts`` most frequent contexts of each order, with their exact probabilities; likewise
the ``max_words`` most frequent words. What a document has besides (words, and symbols after
contexts of ``ORDER`` bytes that the cache lacks) is looked up by joins to the stored counts, so
every score is that of the whole model, whatever the bounds.

``score`` adds log10 probabilities per document; ``adaptive_scores`` gives the code length of a
trie that starts empty and learns as it reads (one document at a time, plain Python).

Words are keyed by a 64-bit hash. Defined results: a null or empty text has one token, its end;
an empty training set gives every symbol 1/256 and N = 0; repeated rows are scored alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainframe.llm.chunks import release_encoder, slices
from chainframe.llm.text import written

ORDER = 4
END = 0xFF
_RUN = 2 << 20  # bytes of text handled at once
_HELD = 2_000_000  # counts a task holds of each kind
_CTX = (1 << (8 * ORDER)) - 1


# --- tokens and bytes of a batch -------------------------------------------------------------

def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct word, index into those of each word, words of each text)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    ends = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    spelled = flat.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, spelled), np.uint64, len(spelled)).view(np.int64)
    at = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = np.fromiter(map(len, spelled), np.int64, len(spelled))[at] > 0
    upto = np.append(0, np.cumsum(real))[ends - ends[0]]
    return hashes, at[real], np.diff(upto)


def padded_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, which of them are predicted, predicted symbols of each text): before the texts
    and between them stand ``ORDER`` bytes FF, of which the first is the end of a text."""
    lower = pc.ascii_lower(texts.cast(pa.large_string()))
    offsets = np.frombuffer(lower.buffers()[1], np.int64, len(lower) + 1, 8 * lower.offset)
    raw = np.frombuffer(lower.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    lens = np.diff(offsets)
    out = np.full(len(raw) + ORDER * (len(lens) + 1), END, np.uint8)
    own = np.repeat(np.arange(len(lens)), lens)
    out[np.arange(len(raw)) + ORDER * (own + 1)] = raw
    scored = np.ones(len(out), bool)
    scored[:ORDER] = False
    after = np.cumsum(lens) + ORDER * (np.arange(len(lens)) + 1)  # each text's end symbol
    for k in range(1, ORDER):
        scored[after + k] = False
    return out, scored, lens + 1


def contexts(data: np.ndarray, scored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ORDER bytes before, the symbol) at each predicted place; the last byte is lowest."""
    at = np.flatnonzero(scored)
    ctx = np.zeros(len(at), np.uint32)
    for k in range(ORDER, 0, -1):
        ctx = (ctx << np.uint32(8)) | data[at - k]
    return ctx, data[at]


# --- the pruned trie as tables ---------------------------------------------------------------

@dataclass
class Trie:
    """Rows of log10 probabilities by symbol; a context's row is found by hash probing."""

    log_p: np.ndarray  # [rows, symbols], float32
    symbol: np.ndarray  # byte to column
    short: np.ndarray  # two-byte context to row (that of its longest known suffix)
    keys: list[np.ndarray]  # for 3 to ORDER bytes: open-addressing table of contexts,
    rows: list[np.ndarray]  # and of their rows (-1: free)
    longest: int  # rows from here on are of contexts of ORDER bytes

    def row_of(self, ctx: np.ndarray) -> np.ndarray:
        row = np.full(len(ctx), -1, np.int32)
        todo = np.arange(len(ctx))
        for length in range(ORDER, 2, -1):
            keys, rows = self.keys[length - 3], self.rows[length - 3]
            want = ctx[todo] & np.uint32((1 << (8 * length)) - 1 if length < 4 else _CTX)
            found = np.full(len(todo), -1, np.int32)
            slot, open_ = _slot(want, len(keys)), np.arange(len(todo))
            while len(open_):
                r = rows[slot]
                hit = (keys[slot] == want[open_]) & (r >= 0)
                found[open_[hit]] = r[hit]
                more = ~hit & (r >= 0)
                open_, slot = open_[more], (slot[more] + 1) % len(keys)
            row[todo] = found
            todo = todo[found < 0]
        row[todo] = self.short[ctx[todo] & np.uint32(0xFFFF)]
        return row

    def log10(self, ctx: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        return self.log_p[self.row_of(ctx), self.symbol[symbols]]


def _slot(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys * np.uint32(2654435761)) >> np.uint32(32 - (n.bit_length() - 1))).astype(np.int64)


def _probing_table(keys: np.ndarray, first_row: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << max(10, int(4 * len(keys)).bit_length())
    table, rows = np.zeros(n, np.uint32), np.full(n, -1, np.int32)
    row = first_row + np.arange(len(keys), dtype=np.int32)
    slot = _slot(keys, n)
    left = np.arange(len(keys))
    while len(left):
        free = left[rows[slot[left]] < 0]
        _, one = np.unique(slot[free], return_index=True)  # one key a free slot at a time
        won = free[one]
        table[slot[won]], rows[slot[won]] = keys[won], row[won]
        left = np.setdiff1d(left, won)
        taken = left[(rows[slot[left]] >= 0)]
        slot[taken] = (slot[taken] + 1) % n
    return table, rows


class _Order:
    """The kept contexts of one order with their symbols' counts, as sorted sparse rows."""

    def __init__(self, ctx: np.ndarray, column: np.ndarray, count: np.ndarray) -> None:
        by = np.lexsort((column, ctx))
        ctx, self.column, self.count = ctx[by], column[by], count[by]
        first = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1])) if len(ctx) else np.zeros(0, np.int64)
        self.keys, self.starts = ctx[first], np.append(first, len(ctx))

    def dense(self, rows: np.ndarray, n: int) -> np.ndarray:
        """Counts by symbol of some contexts."""
        lens = self.starts[rows + 1] - self.starts[rows]
        at = np.repeat(self.starts[rows] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        out = np.zeros((len(rows), n))
        out[np.repeat(np.arange(len(rows)), lens), self.column[at]] = self.count[at]
        return out


def build_trie(by_order: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Trie:
    """From (context, symbol, count) of each order 0 to ORDER. The contexts of an order must
    include the suffixes of those of the next. Orders are read one by one; counts stay sparse,
    and rows are made in runs, so little but the finished rows is held."""
    bases, known, above = [], [], None
    for order, (ctx, sym, count) in enumerate(by_order):
        if order == 0:
            seen = np.unique(sym)
            n = len(seen) + 1  # the last column: any symbol never seen
            symbol = np.full(256, n - 1, np.int16)
            symbol[seen] = np.arange(len(seen))
            log_p = np.empty((0, n), np.float32)
        own = _Order(ctx, symbol[sym], count)
        if order == 0 and not len(own.keys):  # nothing seen: one row all the same
            own.keys, own.starts = np.zeros(1, np.uint64), np.zeros(2, np.int64)
        base = len(log_p)
        finished, log_p = log_p, np.empty((base + len(own.keys), n), np.float32)
        log_p[:base] = finished
        for k in range(0, len(own.keys), 8192):
            rows = np.arange(k, min(k + 8192, len(own.keys)))
            c = own.dense(rows, n)
            here = c > 0
            total, distinct = c.sum(axis=1), here.sum(axis=1)
            denominator = np.maximum(total + distinct, 1)[:, None]
            escape = np.where(total > 0, distinct / denominator[:, 0], 1.0)[:, None]
            # after an escape from this context, the probability of each symbol not seen in it
            if order == 0:
                after = 1.0 / max(1, 256 - len(seen))
            else:
                parent = np.searchsorted(above.keys, own.keys[rows] & np.uint64((1 << (8 * (order - 1))) - 1))
                counts = above.dense(parent, n)
                all_total, all_distinct = counts.sum(axis=1), (counts > 0).sum(axis=1)
                beyond = np.where(all_total > 0, all_distinct / np.maximum(all_total + all_distinct, 1), 1.0)[:, None]
                # what the parent gives to symbols unseen in it, without its own escape
                lower = 10.0 ** log_p[bases[-1] + parent].astype(np.float64) / beyond
                left_total = (counts * ~here).sum(axis=1)
                left_distinct = ((counts > 0) & ~here).sum(axis=1)
                whole = np.maximum(left_total + left_distinct, 1)[:, None]
                further = np.where(left_distinct == 0, 1.0, left_distinct / whole[:, 0])[:, None]
                after = np.where(counts > 0, counts / whole, further * lower)
            log_p[base + rows] = np.log10(np.maximum(np.where(here, c / denominator, escape * after), 1e-300))
        above = own
        known.append(own.keys)
        bases.append(base)
    pairs = np.arange(65536, dtype=np.uint64)
    short = np.zeros(65536, np.int32)
    for order in (1, 2):
        want = pairs & np.uint64((1 << (8 * order)) - 1)
        at = np.searchsorted(known[order], want)
        hit = (at < len(known[order])) & (np.take(known[order], at, mode="clip") == want if len(known[order]) else False)
        short[hit] = bases[order] + at[hit]
    tables = [_probing_table(known[o].astype(np.uint32), bases[o]) for o in range(3, ORDER + 1)]
    return Trie(log_p, symbol, short, [t[0] for t in tables], [t[1] for t in tables], bases[ORDER])


# --- counting --------------------------------------------------------------------------------

WORD, GRAM = 0, 1


class _Sums:
    """Counts by key, combined now and then."""

    def __init__(self) -> None:
        self.keys, self.counts, self.pending = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.pending += len(keys)
        if self.pending > _HELD and len(self.keys) > 1:
            self.combine()

    def combine(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k, c = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        k, c = k[first], np.add.reduceat(c, first) if len(k) else c
        self.keys, self.counts, self.pending = [k], [c], len(k)
        return k, c


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release_encoder()
    sums = {WORD: _Sums(), GRAM: _Sums()}

    def rows(kind: int) -> Iterator[pa.RecordBatch]:
        keys, counts = sums[kind].combine()
        for k in range(0, len(keys), 1 << 18):
            part = slice(k, k + (1 << 18))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys[part]), kind, np.int8)), pa.array(keys[part]), pa.array(counts[part])],
                names=["kind", "key", "n"])
        sums[kind] = _Sums()

    for batch in batches:
        for part in slices(batch, most_bytes=_RUN):
            hashes, at, _ = words_of(part.column("text"))
            own = np.bincount(at, minlength=len(hashes)).astype(np.int64)
            sums[WORD].add(hashes[own > 0], own[own > 0])
            ctx, sym = contexts(*padded_bytes(part.column("text"))[:2])
            grams, n = np.unique((ctx.astype(np.int64) << 8) | sym, return_counts=True)
            sums[GRAM].add(grams, n.astype(np.int64))
            for kind in (WORD, GRAM):
                if sums[kind].pending > _HELD:
                    yield from rows(kind)
    for kind in (WORD, GRAM):
        yield from rows(kind)


def _least_of_largest(counts: DataFrame, most: int) -> int:
    """A count n such that at most ``most`` rows have at least n: from the histogram of counts,
    read from the top in steps of powers of 1.1."""
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(1.1)).cast("int")
    bins = counts.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("w")).collect()  # some hundred rows
    left, at = most, None
    for r in sorted(bins, key=lambda r: -r["b"]):
        if r["w"] > left:
            break
        left, at = left - r["w"], r["b"]
    if at is None:
        return 1 << 62
    n = max(1, math.ceil(1.1**at) - 1)
    while math.floor(math.log(n) / math.log(1.1)) < at:
        n += 1
    return n


@dataclass
class Model:
    words: DataFrame  # key, n: every training word
    tokens: int  # all training tokens, ends included
    distinct: int  # distinct training tokens
    documents: int
    frequent: tuple[np.ndarray, np.ndarray]  # sorted hashes and counts of the most frequent words
    least: int  # words counted at least so often are in ``frequent``
    trie: Trie
    orders: list[DataFrame]  # ctx, sym, c of each order
    chains: list[DataFrame] | None  # see ``_chains``; None where the trie has every context


def _suffix(ctx: str, order: int) -> Column:
    return F.expr(f"{ctx} & {(1 << (8 * order)) - 1}L")


def _chains(orders: list[DataFrame]) -> list[DataFrame]:
    """Of each order 0 to ORDER, per context: ctx, total, distinct and what follows its escape.

    ``tail[j + 1]`` is log10 of the escapes from the suffixes longer than j over the whole of
    suffix j, each less the symbols of the next longer one, so that a symbol first seen in suffix
    j has ``tail[j + 1] + log10(count there)``; ``tail[0]`` is for a symbol seen in none. All
    suffixes of a context seen in training were seen, so its tail extends its suffix's. A join
    here has at most 256 rows of a key: the bytes before a suffix."""
    spark = orders[0].sparkSession
    none = orders[0].agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    chains = [spark.range(1).select(
        F.col("id").alias("ctx"), F.lit(none["total"] or 0).cast("long").alias("total"),
        F.lit(none["distinct"]).cast("long").alias("distinct"),
        F.array(F.lit(-math.log10(max(1, 256 - none["distinct"])))).alias("tail"))]
    for k in range(1, ORDER + 1):
        own = orders[k].withColumn("parent", _suffix("ctx", k - 1))
        above = orders[k - 1].select(F.col("ctx").alias("parent"), "sym", F.col("c").alias("above"))
        stats = (own.join(above, ["parent", "sym"]).groupBy("ctx", "parent")
                 .agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("distinct"), F.sum("above").alias("covered")))
        parents = chains[-1].select(F.col("ctx").alias("parent"), F.col("total").alias("all_total"),
                                    F.col("distinct").alias("all_distinct"), "tail")
        left = F.col("all_distinct") - F.col("distinct")
        whole = F.greatest(F.col("all_total") - F.col("covered") + left, F.lit(1))
        escape = F.when(left > 0, F.log10(left / whole)).otherwise(F.lit(0.0))
        chains.append(written(
            stats.join(parents, "parent").withColumn("escape", escape).withColumn("whole", whole).select(
                "ctx", "total", "distinct",
                F.concat(F.transform("tail", lambda x: x + F.col("escape")), F.array(-F.log10("whole"))).alias("tail")),
            f"ppm-chain{k}"))
    return chains


def _looked_up(wanted: DataFrame, model: Model) -> DataFrame:
    """key, log_p of distinct keys (context of ORDER bytes << 8 | symbol) by the whole model."""
    w = wanted.select("key", F.expr("key & 255L").alias("sym"),
                      *[F.expr(f"shiftright(key, 8) & {(1 << (8 * k)) - 1}L").alias(f"x{k}") for k in range(ORDER + 1)])
    for k in range(ORDER, -1, -1):
        counts = model.orders[k].select(F.col("ctx").alias(f"x{k}"), "sym", F.col("c").alias(f"c{k}"))
        w = w.join(F.broadcast(counts) if k < 2 else counts, [f"x{k}", "sym"], "left")  # under 65,536 rows of order 1
        chain = model.chains[k].select(F.col("ctx").alias(f"x{k}"), F.struct(F.lit(k).alias("top"), "total", "distinct", "tail").alias(f"m{k}"))
        w = w.join(F.broadcast(chain) if k < 3 else chain, f"x{k}", "left")  # at most 65,536 contexts of order 2
    down = range(ORDER, -1, -1)
    w = w.select("key", F.coalesce(*[f"m{k}" for k in down]).alias("m"), F.coalesce(*[f"c{k}" for k in down]).alias("c"),
                 F.coalesce(*[F.when(F.col(f"c{k}").isNotNull(), k) for k in down], F.lit(-1)).alias("at"))
    whole = F.col("m.total") + F.col("m.distinct")
    after = F.log10(F.col("m.distinct") / whole) + F.get("m.tail", F.col("at") + 1)
    return w.select("key", F.when(F.col("at") == F.col("m.top"), F.log10(F.col("c") / whole))
                    .otherwise(after + F.coalesce(F.log10("c"), F.lit(0.0))).alias("log_p"))


def fit(training: DataFrame, max_contexts: int = 60_000, max_words: int = 1_000_000) -> Model:
    """``training`` has a text column without nulls. At most ``max_contexts`` contexts of each
    order go into the trie, the most frequent ones, and at most ``max_words`` words to tasks; the
    others stay in stored tables, where ``score`` looks them up."""
    n_docs = training.count()
    raw = training.select("text").mapInArrow(_count, "kind byte, key long, n long")
    table = written(raw.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ppm-counts")
    words = table.filter(F.col("kind") == WORD).select("key", "n")
    stats = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    least = _least_of_largest(words, max_words)
    top = words.filter(F.col("n") >= least).toArrow()
    order = np.argsort(top.column("key").to_numpy())
    frequent = top.column("key").to_numpy()[order], top.column("n").to_numpy()[order]

    own = table.filter(F.col("kind") == GRAM).select(
        F.shiftright("key", 8).alias("ctx"), F.expr("key & 255L").alias("sym"), F.col("n").alias("c"))
    orders = [own]
    for k in range(ORDER - 1, -1, -1):
        own = written(own.groupBy(_suffix("ctx", k).alias("ctx"), "sym").agg(F.sum("c").alias("c")), f"ppm-order{k}")
        orders.insert(0, own)
    least_of = [1] * len(orders)
    for k in range(2, len(orders)):  # orders 0 and 1 have at most 257 contexts
        totals = orders[k].groupBy("ctx").agg(F.sum("c").alias("n"))
        # a rising threshold keeps the suffixes of kept contexts
        least_of[k] = max(least_of[k - 1], _least_of_largest(totals, max_contexts))

    def kept() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for k, own in enumerate(orders):
            if least_of[k] > 1:
                totals = own.groupBy("ctx").agg(F.sum("c").alias("n")).filter(F.col("n") >= least_of[k])
                own = own.join(totals.select("ctx"), "ctx", "left_semi")
            t = own.toArrow()  # at most max_contexts contexts of at most 256 symbols
            yield (t.column("ctx").to_numpy().astype(np.uint64), t.column("sym").to_numpy().astype(np.uint8), t.column("c").to_numpy())

    return Model(words, (stats["n"] or 0) + n_docs, stats["v"] + (n_docs > 0), n_docs, frequent, least, build_trie(kept()),
                 orders, _chains(orders) if n_docs and least_of[-1] > 1 else None)


# --- scoring ---------------------------------------------------------------------------------

def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs`` (doc_id, text without nulls, held_out): n_tokens, n_known,
    train_tokens, base_score (unigram with add-one counts) and score, both log10."""
    spark = docs.sparkSession
    bound = spark.sparkContext.broadcast((model.frequent, model.trie))
    whole = model.tokens + model.distinct + 1
    ends, n_train, least = model.documents, model.tokens, model.least
    partial = model.chains is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoder()
        (keys, counts), trie = bound.value
        for batch in batches:
            for part in slices(batch, most_bytes=_RUN):
                texts = part.column("text")
                hashes, at, n_words = words_of(texts)
                where = np.searchsorted(keys, hashes)
                hit = np.take(keys, where, mode="clip") == hashes if len(keys) else np.zeros(len(hashes), bool)
                c = np.where(hit, np.take(counts, where, mode="clip"), 0) if len(keys) else np.zeros(len(hashes), np.int64)
                doc = np.repeat(np.arange(len(n_words)), n_words)
                frequent = hit[at]
                log = np.log10((c + 1) / whole)
                base = np.bincount(doc[frequent], log[at[frequent]], len(n_words)) + math.log10((ends + 1) / whole)
                known = np.bincount(doc[frequent], minlength=len(n_words)) + (ends > 0)
                # the other words of each document, with how often it has them
                rare = _lists(doc[~frequent], at[~frequent], hashes, len(n_words))
                data, scored, n_symbols = padded_bytes(texts)
                ctx, sym = contexts(data, scored)
                row = trie.row_of(ctx)
                p = trie.log_p[row, trie.symbol[sym]].astype(np.float64)
                # the symbols after contexts the trie lacks, likewise
                missed = np.flatnonzero(row < trie.longest) if partial else np.zeros(0, np.int64)
                p[missed] = 0.0
                grams, own = np.unique((ctx[missed].astype(np.int64) << 8) | sym[missed], return_inverse=True)
                beyond = _lists(np.searchsorted(np.cumsum(n_symbols), missed, "right"), own, grams, len(n_words))
                total = np.add.reduceat(p, np.cumsum(n_symbols) - n_symbols)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(n_words + 1),
                     pa.array(known.astype(np.int64)), pa.array(base), pa.array(total), rare, beyond],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "beyond"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    first = written(numbered.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, "
                                             "base double, score double, rare array<struct<key: long, times: long>>, "
                                             "beyond array<struct<key: long, times: long>>"), "ppm-scores")
    bound.destroy()  # the scores are stored
    rare = first.select("row", F.explode("rare").alias("w")).select("row", "w.key", "w.times")
    infrequent = model.words.filter(F.col("n") < F.lit(least))
    looked_up = (rare.join(infrequent, "key", "left")
                 .groupBy("row").agg(F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(whole)))).alias("more"),
                                     F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known")))
    joined, total, zero = first.join(looked_up, "row", "left"), F.col("score"), F.lit(0)
    if partial:
        beyond = first.select("row", F.explode("beyond").alias("g")).select("row", "g.key", "g.times")
        log_p = _looked_up(beyond.select("key").distinct(), model)
        added = beyond.join(log_p, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("log_p")).alias("more_score"))
        joined, total = joined.join(added, "row", "left"), total + F.coalesce("more_score", F.lit(0.0))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        total.alias("score"))


def _pairs(doc: np.ndarray, word: np.ndarray, n_words: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Distinct (document, word) in order, and how often each occurs."""
    both, times = np.unique(doc * max(1, n_words) + word, return_counts=True)
    return np.divmod(both, max(1, n_words)), times.astype(np.int64)


def _lists(doc: np.ndarray, at: np.ndarray, keys: np.ndarray, n_docs: int) -> pa.ListArray:
    """Per document its distinct keys (given by index) and how often it has each."""
    pair, times = _pairs(doc, at, len(keys))
    ends = np.append(0, np.cumsum(np.bincount(pair[0], minlength=n_docs))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
        [pa.array(keys[pair[1]]), pa.array(times)], names=["key", "times"]))


def held_out_split(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, text (null: empty), held_out: crc32 of the doc_id as text leaves ``held``."""
    left = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce(left == held, F.lit(False)).alias("held_out"))


def score_documents(docs: DataFrame, max_contexts: int = 60_000, max_words: int = 1_000_000) -> DataFrame:
    split = held_out_split(docs)
    return score(split, fit(split.filter("not held_out").select("text"), max_contexts, max_words))


# --- adaptive, and the model in plain form ---------------------------------------------------

class ContextTrie:
    """The same model without pruning or tables, updated as it goes."""

    def __init__(self, order: int = ORDER) -> None:
        self.order = order
        self.counts: dict[bytes, dict[int, int]] = {}

    def learn(self, context: bytes, symbol: int) -> None:
        for k in range(self.order + 1):
            own = self.counts.setdefault(context[self.order - k :], {})
            own[symbol] = own.get(symbol, 0) + 1

    def log10(self, context: bytes, symbol: int) -> float:
        out, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            seen = self.counts.get(context[self.order - k :])
            if not seen:
                continue
            left = {s: c for s, c in seen.items() if s not in excluded}
            whole = sum(left.values()) + len(left)
            if symbol in left:
                return out + math.log10(left[symbol] / whole)
            if left:
                out += math.log10(len(left) / whole)
            excluded = set(seen)
        return out - math.log10(256 - len(excluded))

    def text(self, text: str, learn: bool) -> float:
        """log10 probability of a text and its end; with ``learn``, each symbol is learnt after it is predicted."""
        data = bytes([END]) * self.order + text.encode("utf-8").lower() + bytes([END])
        total = 0.0
        for i in range(self.order, len(data)):
            context = data[i - self.order : i]
            total += self.log10(context, data[i])
            if learn:
                self.learn(context, data[i])
        return total


def adaptive_scores(docs: DataFrame) -> DataFrame:
    """doc_id, score: the log10 probability by a trie that starts empty for each text. A plain
    reference, a row and byte at a time, for small tables; no registered query uses it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([ContextTrie().text(t.as_py() or "", True) for t in texts], pa.float64())],
                names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
