"""N-gram Jaccard join by grouped prefixes, and its components.

A document's set holds its distinct word shingles; two documents link when their sets' Jaccard
similarity reaches ``num``/``den`` exactly. Sets are ordered by one global order, rare shingles
first, so that linked sets must share a token among their first
``size - ceil(t * size) + 1`` ones (the prefix).

1. ``sketch``: shingles are counted into 2^20 slots; a token's class, the logarithm of its
   slot's count, leads its 64-bit id. Any such order is right; this one keeps common passages
   out of prefixes. The broadcast class table has a fixed size of 1 MB.
2. ``described``: one row per document with size, prefix, the set's digest, and a 512-bit
   parity sketch of the set. Equal sets, and then equal (size, prefix), collapse into groups.
3. Group filter: prefix tokens of groups are joined with themselves; a semi join by size and
   position keeps the live ones, one row each, never the pairs.
4. Live groups expand to their distinct sets, of which another semi join keeps those that could
   link by their sketches: the Hamming distance of two parity sketches never exceeds the sets'
   symmetric difference, so no link is lost.
5. For these a longer sketch, of at least four bits a shingle (of small sets: the set), is made
   in the tasks that read the texts. ``judged`` takes pairs by it: too far apart for a link; a link,
   known from both whole sets; nearly sure, where more colliding bits than a chance of 1e-18
   allows would be needed for there to be none; or unsure. First every set is judged against its
   neighbour at each token (a linear number of pairs) and components are formed; then all remaining
   pairs *between* components are judged.
6. ``spanned`` verifies members: of the nearly sure links it takes, round by round, one for each
   component that reaches a smaller one, compares the two full sets, and joins components only by
   links that hold. At most one link fewer than there are sets needs verifying, besides those that
   fail. Unsure pairs that still join different components are verified likewise, all at once. A
   family of near copies thus costs about its size, not its square, and few full sets travel.
7. Components of all links, mapped back to every copy.

There is no cap on candidates. Rejections lose no link, and no link is taken that the full sets
don't confirm (shingles have 57-bit and sets 64-bit hashes).

Defined results: null, empty and white-space texts have an empty set, link with nothing and are
their own component; fewer words than the shingle size make one shingle of all of them; rows
without doc_id share one id, ordered before all others; repeated rows are rows of their own, of
which ``keep_one_of_each`` keeps one; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainframe.llm.chunks import release_encoder, slices
from chainframe.llm.components import components, joined
from chainframe.llm.ppm import words_of
from chainframe.llm.order import numbered_rows
from chainframe.llm.text import HOT_SHARE, IdFilter, free_name, spread_join, written

SLOTS = 1 << 20
_PART = 1 << 14
_NO_ID = -(1 << 63)
LANES = tuple(f"s{k}" for k in range(1, 9))  # a 512-bit sketch
NEVER = 1e-18
EXACT = 512  # sets of at most so many shingles travel whole instead of a longer sketch


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle of each text in order, shingles of each text)."""
    hashes, at, n_words = words_of(texts)
    words = hashes.view(np.uint64)[at]
    rolled = _mix(np.concatenate([words, np.zeros(width, np.uint64)]) + np.uint64(width))
    out = np.zeros(len(words), np.uint64)
    for k in range(width):
        out = _mix(out * np.uint64(3) + rolled[k : k + len(words)])
    ends = np.cumsum(n_words)
    place = np.arange(len(words)) - np.repeat(ends - n_words, n_words)
    left = np.repeat(n_words, n_words) - place
    keep = left >= width
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    for d in short.tolist():  # fewer words: the whole sequence
        a = ends[d] - n_words[d]
        h = np.uint64(n_words[d])
        with np.errstate(over="ignore"):
            for w in words[a : ends[d]]:
                h = _mix(np.array([h * np.uint64(5) + w]))[0]
        out[a], keep[a] = h, True
    return out[keep], np.where(n_words < width, np.minimum(n_words, 1), n_words - width + 1)


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def _slot_of(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SLOTS - 1)).astype(np.int64)


def sketch(docs: DataFrame, width: int) -> np.ndarray:
    """The class (0 to 63) of each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoder()
        count = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in slices(batch, most_bytes=2 << 20):
                count += np.bincount(_slot_of(shingles(part.column("text"), width)[0]), minlength=SLOTS)
        rows = count.reshape(-1, _PART).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([r.tobytes() for r in rows])],
                                         names=["part", "counts"])

    def total(t: pa.Table) -> pa.Table:
        count = sum(np.frombuffer(c, np.uint32).astype(np.int64) for c in t.column("counts").to_pylist())
        kind = np.ceil(np.log2(count + 1)).astype(np.uint8)
        return pa.table({"part": t.column("part")[:1], "classes": pa.array([kind.tobytes()])})

    parts = (docs.select("text").mapInArrow(run, "part int, counts binary").groupBy("part")
             .applyInArrow(total, "part int, classes binary").collect())  # 64 rows, 1 MB in all
    out = np.zeros((SLOTS // _PART, _PART), np.uint8)
    for r in parts:
        out[r["part"]] = np.frombuffer(r["classes"], np.uint8)
    return out.ravel()


def _sets(part: pa.RecordBatch, width: int, classes: np.ndarray) -> Iterator[np.ndarray]:
    """The ordered set of token ids of each text."""
    h, n = shingles(part.column("text"), width)
    ids = (classes[_slot_of(h)].astype(np.uint64) << np.uint64(57)) | (h >> np.uint64(7))
    ends = np.cumsum(n)
    for a, b in zip((ends - n).tolist(), ends.tolist()):
        yield np.unique(ids[a:b]).view(np.int64)


def _digest(ids: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(ids.tobytes(), seed=len(ids)) - (1 << 63)


def _parity(ids: np.ndarray, bits: int) -> np.ndarray:
    """For each class of ids modulo ``bits``, whether it has an odd number; packed."""
    return np.packbits((np.bincount(ids & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little")


def _long_bits(n: int) -> int:
    """Bits of a set's longer sketch: at least four a shingle."""
    return 4 << max(6, (n - 1).bit_length())


def compact(ids: np.ndarray) -> bytes:
    """What pairs are judged by: a small set's ids, a large one's longer sketch."""
    return (ids if len(ids) <= EXACT else _parity(ids, _long_bits(len(ids)))).tobytes()


def described(docs: DataFrame, width: int, classes, num: int, den: int) -> DataFrame:
    """row, doc_id, n, sid (digest of the set), gid (of size and prefix), s1 to s8 (parity), prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoder()
        table = classes.value
        for batch in batches:
            for part in slices(batch, most_bytes=2 << 20):
                n, sid, gid, lanes, prefix = [], [], [], [], []
                for ids in _sets(part, width, table):
                    size = len(ids)
                    first = ids[: size - _ceil(num * size, den) + 1]
                    n.append(size)
                    sid.append(_digest(ids))
                    gid.append(xxhash.xxh64_intdigest(first.tobytes(), seed=size) - (1 << 63))
                    lanes.append(_parity(ids, 512).view(np.int64))
                    prefix.append(first)
                ends = np.append(0, np.cumsum([len(p) for p in prefix])).astype(np.int32)
                flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array(n, pa.int32()), pa.array(sid, pa.int64()), pa.array(gid, pa.int64()),
                     *[pa.array(x) for x in np.array(lanes).T.copy()], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["row", "doc_id", "n", "sid", "gid", *LANES, "prefix"])

    lane_types = ", ".join(f"{c} long" for c in LANES)
    return docs.mapInArrow(run, f"row long, doc_id long, n int, sid long, gid long, {lane_types}, prefix array<long>")


def _sets_of(docs: DataFrame, wanted: IdFilter, width: int, classes, as_compact: bool) -> DataFrame:
    """(sid, n, compact) or (sid, ids) of the documents that ``wanted`` keeps, made where they
    are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoder()
        table = classes.value
        for batch in batches:
            batch = batch.filter(pa.array(wanted.test(batch.column("slot").to_numpy())))
            for part in slices(batch, most_bytes=2 << 20):
                own = list(_sets(part, width, table))
                sid = pa.array([_digest(s) for s in own], pa.int64())
                if as_compact:
                    yield pa.RecordBatch.from_arrays(
                        [sid, pa.array([len(s) for s in own], pa.int32()),
                         pa.array([compact(s) for s in own], pa.binary())], names=["sid", "n", "compact"])
                else:
                    ends = np.append(0, np.cumsum([len(s) for s in own])).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [sid, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own)))], names=["sid", "ids"])

    return docs.select(IdFilter.slot(F.col("doc_id")).alias("slot"), "text").mapInArrow(
        run, "sid long, n int, compact binary" if as_compact else "sid long, ids array<long>")


def verdict(n: int, m: int, x: bytes, y: bytes, num: int, den: int) -> int:
    """Of two sets by size and compact form: 0 not linked, 1 linked, 2 unsure. With k more
    elements apart than odd bits, k / 2 pairs of them share a bit; how many do is Poisson with
    mean apart^2 / (2 * bits), of which the upper tail is bounded (Chernoff)."""
    if n <= EXACT and m <= EXACT:
        common = len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True))
        return int(common * (den + num) >= (n + m) * num)
    a, b = (_parity(np.frombuffer(z, np.int64), _long_bits(k)) if k <= EXACT else np.frombuffer(z, np.uint8) for k, z in ((n, x), (m, y)))
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    odd = int(np.bitwise_count(a ^ b).sum())
    most = (n + m) * (den - num) // (den + num)  # elements that linked sets may differ in
    if odd > most:
        return 0
    pairs, mean = (most + 1 - odd) / 2, (most + 1) ** 2 / (16 * len(a))
    if pairs > mean and pairs - mean + pairs * math.log(mean / pairs) < math.log(NEVER):
        return 1
    return 2


def judged(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, sure, exact) of the pairs (a, b) that are or may be links; exact: known from both sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array([verdict(*(c.as_py() for c in row), num, den) for row in zip(*(batch.column(c) for c in ("n", "m", "x", "y")))], int)
            whole = (batch.column("n").to_numpy() <= EXACT) & (batch.column("m").to_numpy() <= EXACT)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(v == 1), pa.array((v == 1) & whole)],
                                             names=["a", "b", "sure", "exact"])
            yield out.filter(pa.array(v > 0))

    # neither side has a bounded size: no broadcast
    both = (pairs.hint("merge").join(sketches.select(F.col("sid").alias("a"), "n", F.col("compact").alias("x")), "a").hint("merge")
            .join(sketches.select(F.col("sid").alias("b"), F.col("n").alias("m"), F.col("compact").alias("y")), "b"))
    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long, sure boolean, exact boolean")


def _could_link(a: str, b: str, num: int, den: int, sketches: bool) -> Column:
    """Lossless filters on two rows that share a token: size, position and, optionally, parity;
    and that the tokens before it differ, for else the pair shares an earlier token, where it is
    found already (of a run of common tokens only the first gives the pair)."""
    n1, n2 = F.col(f"{a}.n"), F.col(f"{b}.n")
    both = n1 + n2
    # den * I >= num * U  <=>  (den + num) * I >= num * (n1 + n2)
    most = F.least(n1 - F.col(f"{a}.pos"), n2 - F.col(f"{b}.pos"))
    ok = (n1 * den >= n2 * num) & (n2 * den >= n1 * num) & (most * (den + num) >= both * num)
    ok = ok & F.coalesce(F.col(f"{a}.prev") != F.col(f"{b}.prev"), F.lit(True))
    if sketches:
        apart = sum(F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in LANES)
        ok = ok & (((both - apart) * (den + num)) >= both * (2 * num))
    return ok


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets link. Neither side has a bounded size: no broadcast."""
    common = F.size(F.array_intersect("x", "y"))
    return (pairs.hint("merge").join(sets.select(F.col("sid").alias("a"), F.col("ids").alias("x")), "a").hint("merge")
            .join(sets.select(F.col("sid").alias("b"), F.col("ids").alias("y")), "b")
            .filter(common * (den + num) >= (F.size("x") + F.size("y")) * num).select("a", "b"))


def _between(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The links (a, b) whose ends lie in different components, with these (low, high)."""
    of = lambda side: roots.select(F.col("id").alias(side), F.col("root").alias(f"root_{side}"))
    both = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    x, y = F.coalesce("root_a", "a"), F.coalesce("root_b", "b")
    return both.filter(x != y).select("a", "b", F.least(x, y).alias("low"), F.greatest(x, y).alias("high"))


def spanned(roots: DataFrame, links: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``roots`` joined by those links (a, b) that hold on the full sets. Each round verifies one
    link of every component that has one to a smaller component; what these leave between
    components goes on to the next."""
    while True:
        links = written(_between(roots, links), "ngram-between")
        if links.isEmpty():
            return roots
        one = links.groupBy("high").agg(F.min(F.struct("low", "a", "b")).alias("l")).select("l.a", "l.b")
        roots = joined(roots, written(_verified(one, sets, num, den), "ngram-verified"))
        links = links.select("a", "b").join(one, ["a", "b"], "left_anti")


def _hot_keys(rows: DataFrame, key: str, total: int) -> DataFrame:
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > max(16, total // HOT_SHARE))
    return written(counts.select(key), "ngram-hot")


def _placed(docs: DataFrame, row: Column, width: int, num: int, den: int) -> DataFrame:
    """Per row: its number, doc_id, n (set size), least (doc_id of its component), kept (one row of
    each component)."""
    spark = docs.sparkSession
    texts = docs.select(row.alias("row"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    classes = spark.sparkContext.broadcast(sketch(texts, width))
    d = written(described(texts, width, classes, num, den), "ngram-sets")
    sets_of = written(d.filter("n > 0").groupBy("gid", "sid")
                      .agg(F.min("doc_id").alias("rep"), F.min("row").alias("first"), F.min("n").alias("n"), *[F.min(c).alias(c) for c in LANES]),
                      "ngram-distinct")
    groups = sets_of.groupBy("gid").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("members"))

    # group filter
    tokens = (d.join(groups.select(F.col("first").alias("row"), "gid"), ["row", "gid"], "left_semi")
              .select("gid", "n", "prefix", F.posexplode("prefix").alias("pos", "token"))
              .select("token", "gid", "n", "pos", F.get("prefix", F.col("pos") - 1).alias("prev")))
    live = written(tokens.alias("a").join(
        tokens.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.gid") != F.col("b.gid"))
        & _could_link("a", "b", num, den, sketches=False), "left_semi").distinct(), "ngram-live")

    # expansion to distinct sets; a group of several is a token of its own
    several = groups.filter("members > 1").select(F.xxhash64("gid").alias("token"), "gid", F.lit(0).alias("pos"), F.lit(None).cast("long").alias("prev"))
    rows = written(live.select("token", "gid", "pos", "prev").unionByName(several).join(sets_of, "gid")
                   .select("token", "sid", "n", "pos", "prev", *LANES), "ngram-rows")
    linkable = (F.col("a.token") == F.col("b.token")) & (F.col("a.sid") != F.col("b.sid")) & _could_link("a", "b", num, den, sketches=True)
    rows = written(rows.alias("a").join(rows.alias("b"), linkable, "left_semi"), "ngram-near")

    def made(sids: DataFrame, as_compact: bool) -> DataFrame:
        """Sketches or full sets of some sets, one row each, stored."""
        reps = sets_of.join(sids, "sid", "left_semi").select(F.col("rep").alias("id"))
        rows = _sets_of(texts, IdFilter(reps), width, classes, as_compact)
        return written(rows.join(sids, "sid", "left_semi").dropDuplicates(["sid"]), "ngram-sketches" if as_compact else "ngram-full")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()

    sketches = made(rows.select("sid").distinct(), True)

    near = Window.partitionBy("token").orderBy("n", F.xxhash64("token", "sid"))
    me = F.struct("sid", "n", "pos", "prev", *LANES)
    chained = rows.select(me.alias("q"), F.lag(me).over(near).alias("p")).filter("p is not null and p.sid <> q.sid")
    first = (chained.filter(_could_link("p", "q", num, den, sketches=True))
             .select(F.least("q.sid", "p.sid").alias("a"), F.greatest("q.sid", "p.sid").alias("b")).distinct())
    found = written(judged(first, sketches, num, den), "ngram-first")
    roots = components(found.filter("exact"))
    near_sure = written(_between(roots, found.filter("sure and not exact")), "ngram-near-sure")
    if not near_sure.isEmpty():
        roots = spanned(roots, near_sure, made(ends(near_sure), False), num, den)
    tagged = (rows.join(roots.withColumnRenamed("id", "sid"), "sid", "left")
              .withColumn("root", F.coalesce("root", "sid")))
    rest = (tagged.alias("p").join(
        tagged.alias("q"), (F.col("p.token") == F.col("q.token")) & (F.col("p.sid") < F.col("q.sid"))
        & (F.col("p.root") != F.col("q.root")) & _could_link("p", "q", num, den, sketches=True))
        .select(F.col("p.sid").alias("a"), F.col("q.sid").alias("b")).distinct())
    found = written(judged(rest, sketches, num, den), "ngram-judged")
    exact = found.filter("exact").select("a", "b")
    if not exact.isEmpty():
        roots = joined(roots, exact)

    # what isn't known from whole sets and still between components: full sets
    left = written(_between(roots, found.filter("not exact")), "ngram-left")
    if not left.isEmpty():
        sets = made(ends(left), False)
        roots = spanned(roots, found.filter("sure and not exact").select("a", "b"), sets, num, den)
        unsure = _between(roots, found.filter("not sure")).select("a", "b")
        roots = joined(roots, written(_verified(unsure, sets, num, den), "ngram-verified"))

    total = d.count()
    light = d.select("row", "doc_id", "n", "sid")
    placed = spread_join(light, roots.withColumnRenamed("id", "sid"), "sid", _hot_keys(light, "sid", total))
    placed = written(placed.withColumn("root", F.coalesce("root", "sid")), "ngram-placed")
    some = placed.filter("n > 0")
    least = some.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("l")).select("root", F.col("l.doc_id").alias("least"), F.col("l.row").alias("first"))
    some = spread_join(some, least, "root", _hot_keys(some, "root", total))
    none = placed.filter("n = 0").withColumn("least", F.col("doc_id")).withColumn("first", F.col("row"))
    return some.unionByName(none).select("row", "doc_id", "n", "least", (F.col("row") == F.col("first")).alias("kept"))


def linked_components(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    out = _placed(docs, F.monotonically_increasing_id(), width, num, den)
    id_of = lambda c: F.when(F.col(c) != F.lit(_NO_ID), F.col(c))
    return out.select(id_of("doc_id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), id_of("least").alias("component_id"))


def keep_one_of_each(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """The document with the smallest doc_id of each component, one row of it, with all columns."""
    name = free_name(docs, "row")
    numbered = numbered_rows(docs, "ngram-docs", name)
    kept = _placed(numbered, F.col(name), width, num, den).filter("kept").select(F.col("row").alias(name))
    return numbered.join(kept, name, "left_semi").select(*docs.columns)
