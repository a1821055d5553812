"""Quality rules by robust multivariate outliers: minimum covariance determinant estimates.

Base rules fail documents with fewer than ``min_words`` words or with too many of their words in
repeated runs of eight. The others get a vector of five transformed statistics (in thousandths):
log mean word length; square roots of the shares of symbols among word characters, of repeated
lines, of words in repeated runs; log words a line. Per *cell*, a language and source, the centre
and scatter of the vectors are estimated by the minimum covariance determinant: of all subsets of
``share`` of the rows, the one whose scatter has the least determinant. A document is rejected if
its squared Mahalanobis distance exceeds the chi-square quantile of ``1 - tail``.

The subset is found by concentration steps (Rousseeuw and Van Driessen 1999) from three
deterministic starts (Hubert et al. 2012): scaled medians, tanh correlation and spatial signs.
A step is one ``groupBy(cell, distance bucket)`` of integer sums over the whole light table of
vectors; the buckets (16 an octave, under 1,000 a cell) that hold the nearest ``share`` of rows
give the next estimate, so a cell of any size takes one pass, combined before the shuffle, and
results don't depend on how rows are dealt. Steps end when no cell's determinant falls. The last
estimate takes the rows within the 0.975 quantile. Scatter matrices are regularised by adding
``FLOORS`` squared (Boudt et al. 2020), since most documents have no symbols and no repeats at
all; deviations within a few floors are never outliers.

Cells with fewer than ``min_cell`` rows are joined by language, and those languages' rest in one
cell; if that has fewer too, its rows are not judged and stay. Estimates travel to the rows by a
broadcast up to 20,000 (5 MB), beyond that by a salted join.

Defined results: a null or empty text has no words and fails; a null language or source is a
value of its own; rows with one id are separate documents, repeated rows get one verdict; an
empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainframe.llm.chunks import release_encoder, slices
from chainframe.llm.text import written
from chainframe.llm.text_stats import STATS, text_stats

#: The least standard deviation of each statistic, in thousandths.
FLOORS = (50, 50, 200, 200, 500)
_D = len(FLOORS)
_PAIRS = [(i, j) for i in range(_D) for j in range(i, _D)]
_X = [f"x{i}" for i in range(_D)]
_OCTAVE = 16
_MOST_BROADCAST = 20_000
_SALTS = 16
_ESTIMATE = ("cell long, start int, n long, logdet double, " + ", ".join(f"m{i} double" for i in range(_D)) + ", "
             + ", ".join(f"p{i}_{j} double" for i, j in _PAIRS))


def chi2_share(x: float, d: int) -> float:
    """The chi-square distribution function with d degrees of freedom."""
    if x <= 0:
        return 0.0
    a, half = d / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= half / k
        total += term
    return min(1.0, total * math.exp(-half + a * math.log(half) - math.lgamma(a)))


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 10.0 * d + 500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_share(mid, d) < p else (low, mid)
    return high


def consistency(share: float) -> float:
    """What the scatter of the nearest ``share`` of normal rows is multiplied by."""
    if share >= 1:
        return 1.0
    return share / chi2_share(chi2_quantile(share, _D), _D + 2)


def bucket_of(d2: Column) -> Column:
    return F.floor(_OCTAVE * F.log2(1 + 64 * d2)).cast("int")


def bucket_number(d2: float) -> int:
    return math.floor(_OCTAVE * math.log2(1 + 64 * d2))


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and ``STATS`` of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoder()
        for batch in batches:
            for part in slices(batch, most_bytes=1 << 20):
                got = text_stats(pc.fill_null(part.column("text"), ""))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in ("doc_id", "lang", "source")], *[pa.array(got[c].astype(np.int64)) for c in STATS]],
                    names=["doc_id", "lang", "source", *STATS])

    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in STATS))


def _vector() -> list[Column]:
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    log = lambda a, b: F.log(F.greatest(ratio(a, b), F.lit(1e-3)))
    return [F.round(1000 * x).cast("long").alias(c) for c, x in zip(_X, (
        log("word_chars", "n_words"), F.sqrt(ratio("n_symbols", "word_chars")), F.sqrt(ratio("n_dup_lines", "n_lines")),
        F.sqrt(ratio("n_repeat_words", "n_words")), log("n_words", "n_lines")))]


def with_small(rows: DataFrame, small: DataFrame, keys: list[str], size: int | None = None) -> DataFrame:
    """``rows`` left-joined to a table with unique ``keys``, of ``size`` rows (counted if not given):
    broadcast while that is bounded, else salted, so that a key of many rows is dealt over several
    tasks."""
    if (small.count() if size is None else size) > _MOST_BROADCAST:
        rows = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)))
        small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
        keys = [*keys, "_salt"]
    else:
        small = F.broadcast(small)
    right = small.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(right[f"_key_{k}"])
    return rows.join(right, on, "left").drop(*[f"_key_{k}" for k in keys], "_salt")


def _cells(pairs: DataFrame, min_cell: int) -> DataFrame:
    """(lang, source, cell) of the pairs (lang, source, n); cell is null where rows are too few."""
    pairs = written(pairs.withColumn("pid", F.monotonically_increasing_id()), "outlier-pairs")
    rare = pairs.filter(F.col("n") < min_cell)
    langs = written(rare.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.min("pid").alias("lang_cell")), "outlier-languages")
    rest = langs.filter(F.col("lang_n") < min_cell).agg(F.sum("lang_n"), F.min("lang_cell")).first()
    last = F.lit(rest[1] if (rest[0] or 0) >= min_cell else None).cast("long")
    cell = (F.when(F.col("n") >= min_cell, F.col("pid")).when(F.col("lang_n") >= min_cell, F.col("lang_cell")).otherwise(last))
    return with_small(pairs, langs, ["lang"]).select("lang", "source", cell.alias("cell"))


def _estimate(cell: int, start: int, n: int, centre: np.ndarray, scatter: np.ndarray) -> list:
    inverse = np.linalg.inv(scatter)
    return [cell, start, n, float(np.linalg.slogdet(scatter)[1]), *centre.tolist(),
            *[float(inverse[i, j] * (1 if i == j else 2)) for i, j in _PAIRS]]


def _frame(rows: list[list]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _ESTIMATE.split(", ")])


def _square(upper: np.ndarray) -> np.ndarray:
    out = np.zeros((_D, _D))
    for (i, j), v in zip(_PAIRS, upper):
        out[i, j] = out[j, i] = v
    return out


def _scales(vectors: DataFrame) -> DataFrame:
    """(cell, med0.., s0..): medians and scaled deviations from exact histograms; a histogram has
    one row a distinct value, some ten thousand at most."""
    flat = vectors.select("cell", F.posexplode(F.array(*_X)).alias("j", "x")).groupBy("cell", "j", "x").agg(F.count(F.lit(1)).alias("c"))

    def median(x: np.ndarray, c: np.ndarray) -> float:
        order = np.argsort(x, kind="stable")
        upto = np.cumsum(c[order])
        return float(x[order][np.searchsorted(upto, (upto[-1] + 1) // 2)])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, c = rows["x"].to_numpy(), rows["c"].to_numpy()
        med = median(x, c)
        mad = median(np.abs(x - med), c)
        return pd.DataFrame([[key[0], key[1], med, math.hypot(1.4826 * mad, FLOORS[key[1]])]], columns=["cell", "j", "med", "s"])

    each = flat.groupBy("cell", "j").applyInPandas(run, "cell long, j int, med double, s double")
    pick = lambda c, k: F.max(F.when(F.col("j") == k, F.col(c))).alias(f"{c}{k}")
    return written(each.groupBy("cell").agg(*[pick(c, k) for c in ("med", "s") for k in range(_D)]), "outlier-scales")


def _starts(vectors: DataFrame, scales: DataFrame, size: int) -> DataFrame:
    """Three estimates a cell, of ``size`` cells."""
    z = [(F.col(x) - F.col(f"med{k}")) / F.col(f"s{k}") for k, x in enumerate(_X)]
    norm = F.sqrt(sum((e * e for e in z), F.lit(1e-9)))
    rows = with_small(vectors, scales, ["cell"], size)
    whole = lambda e: F.round(1000 * e).cast("long")  # noqa: E731  integers: sums in any order agree
    rows = rows.select("*", *[whole(F.tanh(e)).alias(f"t{k}") for k, e in enumerate(z)], *[whole(e / norm).alias(f"u{k}") for k, e in enumerate(z)])
    sums = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"t{k}").alias(f"t{k}") for k in range(_D)], *[
        F.sum(F.col(f"{c}{i}") * F.col(f"{c}{j}")).alias(f"{c}{i}_{j}") for c in "tu" for i, j in _PAIRS])

    def correlation(m: np.ndarray) -> np.ndarray:
        d = np.sqrt(np.diag(m))
        some = d > 1e-9
        out = np.eye(_D)
        both = np.outer(some, some)
        out[both] = (m / np.outer(np.where(some, d, 1), np.where(some, d, 1)))[both]
        np.fill_diagonal(out, 1.0)
        return 0.99 * out + 0.01 * np.eye(_D)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                centre, s = (np.array([r[f"{c}{k}"] for k in range(_D)]) for c in ("med", "s"))
                mean = np.array([r[f"t{k}"] for k in range(_D)]) / r["n"]
                tanh = _square(np.array([r[f"t{i}_{j}"] for i, j in _PAIRS]) / r["n"]) - np.outer(mean, mean)
                sign = _square(np.array([r[f"u{i}_{j}"] for i, j in _PAIRS]) / r["n"])
                for start, m in enumerate((np.eye(_D), correlation(tanh), correlation(sign))):
                    out.append(_estimate(r["cell"], start, r["n"], centre, m * np.outer(s, s)))
            yield _frame(out)

    return written(sums.join(scales, "cell").mapInPandas(run, _ESTIMATE), "outlier-starts")


def distance(rows: DataFrame) -> Column:
    """Squared Mahalanobis distance by the estimate's columns."""
    e = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(_X)]
    return sum((F.col(f"p{i}_{j}") * e[i] * e[j] for i, j in _PAIRS[1:]), F.col("p0_0") * e[0] * e[0])


def _concentrated(vectors: DataFrame, estimates: DataFrame, size: int, share: float, within: float | None = None) -> DataFrame:
    """The estimates from each cell's nearest ``share`` of rows, or from those whose squared
    distance is ``within`` a bound; ``was`` is the log determinant before. ``estimates`` has one
    row for each of ``size`` cells, or an array of them."""
    rows = with_small(vectors, estimates, ["cell"], size)
    if "each" in estimates.columns:
        rows = rows.select("cell", *_X, F.explode("each").alias("e")).select("cell", *_X, "e.*")
    sums = rows.withColumn("bucket", bucket_of(F.greatest(distance(rows), F.lit(0.0)))).groupBy("cell", "start", "bucket").agg(
        F.count(F.lit(1)).alias("c"), F.max("logdet").alias("was"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(_X)],
        *[F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"q{i}_{j}") for i, j in _PAIRS])
    most = None if within is None else bucket_number(within)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bucket")
        c = part["c"].to_numpy()
        if most is None:
            end = int(np.searchsorted(np.cumsum(c), math.ceil(share * int(c.sum())))) + 1
            held = int(c[:end].sum()) / int(c.sum())
        else:
            end = max(1, int((part["bucket"].to_numpy() <= most).sum()))
            held = chi2_share(within, _D)
        n = int(c[:end].sum())
        mean = part[[f"s{i}" for i in range(_D)]].to_numpy()[:end].sum(axis=0) / n
        cross = part[[f"q{i}_{j}" for i, j in _PAIRS]].to_numpy()[:end].sum(axis=0) / n
        scatter = (_square(cross) - np.outer(mean, mean)) * consistency(held) + np.diag(np.square(FLOORS))
        return _frame([_estimate(key[0], key[1], int(c.sum()), mean, scatter)]).assign(was=part["was"].max())

    return written(sums.groupBy("cell", "start").applyInPandas(run, f"{_ESTIMATE}, was double"), "outlier-estimates")


def mcd_estimates(vectors: DataFrame, share: float = 0.75, most_steps: int = 20, least_fall: float = 1e-3) -> DataFrame:
    """One estimate a cell of ``vectors`` (cell, x0..): n, logdet, centre m0.. and the inverse
    scatter's terms p0_0... . Steps end when no log determinant falls by ``least_fall``."""
    scales = _scales(vectors)
    size = scales.count()
    names = [c.split()[0] for c in _ESTIMATE.split(", ") if not c.startswith(("cell", "start", "logdet"))]
    found = _starts(vectors, scales, size)
    for _ in range(2):
        each = F.collect_list(F.struct("start", "logdet", *names)).alias("each")
        found = _concentrated(vectors, written(found.groupBy("cell").agg(each), "outlier-three"), size, share)
    best = found.groupBy("cell").agg(F.min(F.struct("logdet", "start", *names)).alias("b"))
    found = written(best.select("cell", F.lit(0).alias("start"), "b.logdet", *[f"b.{c}" for c in names]), "outlier-best")
    for _ in range(most_steps):
        after = _concentrated(vectors, found, size, share)
        if (after.agg(F.max(F.col("was") - F.col("logdet"))).first()[0] or 0) < least_fall:
            break
        found = after.drop("was")
    return _concentrated(vectors, found, size, share, within=chi2_quantile(0.975, _D)).drop("was")


def judged(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, tail: float = 1e-4, share: float = 0.75,
           min_cell: int = 50) -> DataFrame:
    """One row per document: doc_id, lang, source, ``STATS``, base_failed, cell, distance (null where
    not judged) and kept."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    stats = written(document_stats(docs).withColumn("base_failed", failed), "outlier-stats")
    pairs = stats.filter(~F.col("base_failed")).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    cells = written(_cells(pairs, min_cell), "outlier-cells")
    rows = written(with_small(stats, cells, ["lang", "source"]).select("*", *_vector()), "outlier-vectors")
    vectors = rows.filter(~F.col("base_failed") & F.col("cell").isNotNull()).select("cell", *_X)
    estimates = mcd_estimates(vectors, share).drop("start", "n", "logdet")
    out = with_small(rows, estimates, ["cell"])
    d2 = F.when(~F.col("base_failed"), distance(out))
    limit = chi2_quantile(1 - tail, _D)
    return out.withColumn("distance", d2).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True))).select(
        "doc_id", "lang", "source", *STATS, "base_failed", "cell", "distance", "kept")


def keep_regular(docs: DataFrame, **params) -> DataFrame:
    """The documents that stay, with all their columns: judged row by row, by a stored row number."""
    name = "_row"
    while name in docs.columns:
        name = f"_{name}"
    numbered = written(docs.withColumn(name, F.monotonically_increasing_id()), "outlier-docs")
    verdicts = judged(numbered.select(F.col(name).alias("doc_id"), "lang", "source", "text"), **params)
    stay = verdicts.filter("kept").select(F.col("doc_id").alias(name))
    return numbered.join(stay, name, "left_semi").select(*docs.columns)
