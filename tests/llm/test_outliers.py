"""Robust outliers against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from chainframe.llm import outliers
from chainframe.llm.text import documents
from chainframe.llm.text_stats import text_stats

DOCS = "doc_id long, text string, lang string, source string, distance string, x0 int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _stats(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines))


def _texts(rng, n):
    out = []
    for _ in range(n):
        kind = rng.random()
        words = [rng.choice(["stone", "été", "a", "日本語", "x|y", "the", "of", "river"]) for _ in range(rng.randint(0, 120))]
        if kind < 0.3 and words:
            words = words[:12] * rng.randint(1, 5) + words
        out.append("".join(w + rng.choice([" ", " ", "\n", "\t\x0b", "\r\n", " ", "\x1c", "\x85"]) for w in words))
    return out


def test_stats_against_plain_python():
    texts = _texts(random.Random(2), 400) + ["", " \n\n ", "a\na\n\na", "w " * 8, "w " * 9, "#*$%&|<> []", "same line\n" * 30, "x" * 9000]
    got = text_stats(pa.array(texts))
    for k, t in enumerate(texts):
        assert tuple(int(got[c][k]) for c in outliers.STATS) == _stats(t), repr(t[:80])


def test_runs_with_equal_sums_are_compared_exactly(monkeypatch):
    from chainframe.llm import text_stats as module

    real = np.sort
    monkeypatch.setattr(module.np, "sort", lambda a: real(np.concatenate([a, a])))  # every sum looks repeated
    got = text_stats(pa.array(["one two three four five six seven eight nine ten", "a b c d e f g h " * 2]))
    assert got["n_repeat_words"].tolist() == [0, 16]


# --- the estimates, in plain numpy -----------------------------------------------------------

F2 = np.diag(np.square(np.array(outliers.FLOORS, float)))


def _plain_mcd(x, share=0.75):
    """The same search with one row at a time."""
    x = np.asarray(x, float)

    def median(v):
        return np.sort(v)[(len(v) + 1) // 2 - 1]

    med = np.array([median(c) for c in x.T])
    s = np.array([math.hypot(1.4826 * median(np.abs(c - m)), f) for c, m, f in zip(x.T, med, outliers.FLOORS)])
    z = (x - med) / s
    t = np.rint(1000 * np.tanh(z))
    u = np.rint(1000 * z / np.sqrt((z * z).sum(axis=1) + 1e-9)[:, None])

    def correlation(m):
        d = np.sqrt(np.diag(m))
        out = np.eye(5)
        for i in range(5):
            for j in range(5):
                if i != j and d[i] > 1e-9 and d[j] > 1e-9:
                    out[i, j] = m[i, j] / d[i] / d[j]
        return 0.99 * out + 0.01 * np.eye(5)

    def distances(e):
        c, m = e
        d = x - c
        return np.einsum("ni,ij,nj->n", d, np.linalg.inv(m), d)

    def step(e, within=None):
        bucket = np.array([outliers.bucket_number(max(0.0, v)) for v in distances(e)])
        if within is None:
            near = bucket <= np.sort(bucket)[math.ceil(share * len(x)) - 1]
            held = near.mean()
        else:
            near = bucket <= outliers.bucket_number(within)
            held = outliers.chi2_share(within, 5)
        own = x[near]
        return own.mean(axis=0), np.cov(own.T, bias=True) * outliers.consistency(held) + F2

    n = len(x)
    found = []
    for m in (np.eye(5), correlation(t.T @ t / n - np.outer(t.mean(0), t.mean(0))), correlation(u.T @ u / n)):
        found.append(step(step((med, m * np.outer(s, s)))))
    logdet = lambda e: np.linalg.slogdet(e[1])[1]
    best = min(found, key=logdet)
    for _ in range(20):
        after = step(best)
        if logdet(best) - logdet(after) < 1e-3:
            break
        best = after
    return distances(step(best, outliers.chi2_quantile(0.975, 5)))


def _vector(s):
    n_words, chars, symbols, dups, repeats, lines = s
    rounded = lambda v: int(math.floor(abs(v) + 0.5) * (1 if v >= 0 else -1))
    return [rounded(1000 * v) for v in (math.log(chars / n_words), math.sqrt(symbols / chars), math.sqrt(dups / lines),
                                         math.sqrt(repeats / n_words), math.log(n_words / lines))]


def _expected(rows, min_cell=50):
    stats = [_stats(t) for _, t, _, _ in rows]
    failed = [s[0] < 20 or 100 * s[4] > 30 * s[0] for s in stats]
    pairs = Counter((r[2], r[3]) for r, f in zip(rows, failed) if not f)
    langs = Counter()
    for (lang, _), n in pairs.items():
        langs[lang] += n if n < min_cell else 0
    rest = sum(n for n in langs.values() if n < min_cell)
    cells = defaultdict(list)
    for k, (r, f) in enumerate(zip(rows, failed)):
        if not f:
            pair = (r[2], r[3])
            cells[pair if pairs[pair] >= min_cell else (r[2], "rest of it") if langs[r[2]] >= min_cell else "rest" if rest >= min_cell else None].append(k)
    distance = [None] * len(rows)
    for cell, own in cells.items():
        if cell is not None:
            # one search per cell, which never sees more than these few rows in a test
            for k, d in zip(own, _plain_mcd([_vector(stats[k]) for k in own])):
                distance[k] = d
    limit = outliers.chi2_quantile(1 - 1e-4, 5)
    return stats, failed, distance, [not f and (d is None or d <= limit) for f, d in zip(failed, distance)]


def _clean(rng, n=None):
    return " ".join(rng.choice(["stone", "river", "the", "of", "lightly", "walks", "under", "a"]) + rng.choice(["", "", "", ",", ".\n"])
                    for _ in range(n or rng.randint(25, 90)))


def _corpus(rng, n):
    rows = []
    for k in range(n):
        lang, source = rng.choice([("en", "a"), ("en", "a"), ("en", "b"), (None, None), ("de", f"s{k % 40}"), ("fr", f"s{k}")])
        t = _clean(rng)
        if k % 9 == 0:
            t = " ".join(w + "***" for w in t.split())
        if k % 13 == 0:
            t = "\n".join([t, t])
        rows.append((k, t, lang, source))
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS).repartition(3)


def test_verdicts_against_plain_numpy(spark):
    rng = random.Random(5)
    rows = _corpus(rng, 600) + [(600, None, "en", "a"), (601, "", None, "a"), (602, "word " * 20, "xx", "yy"), (603, _clean(rng, 9000), "en", "a")]
    stats, failed, distance, kept = _expected(rows)
    got = {r.doc_id: r for r in outliers.judged(_frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for (i, *_), s, f, d, k in zip(rows, stats, failed, distance, kept):
        r = got[i]
        assert tuple(r[c] for c in outliers.STATS) == s and r.base_failed == f and r.kept == k
        assert (r.distance is None) == (d is None) and (d is None or math.isclose(r.distance, d, rel_tol=1e-6, abs_tol=1e-9))
    judged = [k for k, f in zip(range(600), failed) if not f]
    assert all(not kept[k] for k in judged if k % 9 == 0)
    assert all(kept[k] for k in judged if k % 9 and k % 13)


def test_copies_repeated_ids_few_rows_and_empty_tables(spark):
    rng = random.Random(6)
    text = _clean(rng, 60)
    rows = [(7, text, "en", "a")] * 120 + [(None, _clean(rng), "en", "a") for _ in range(60)] + [(9, _clean(rng), "de", "b")] * 3
    got = outliers.judged(_frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.kept for r in got)
    assert all(r.distance is None for r in got if r.doc_id == 9)
    assert outliers.judged(spark.createDataFrame([], DOCS)).count() == 0
    assert outliers.judged(_frame(spark, [(1, None, None, None)])).collect()[0].kept is False
    kept = outliers.keep_regular(_frame(spark, rows + [(7, "too short", "en", "a")]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "distance", "x0"] and kept.count() == len(rows)


def test_estimates_do_not_follow_a_quarter_of_outliers(spark):
    rng = random.Random(8)
    rows = [(k, _clean(rng) if k % 5 else " ".join("<" + w + "|||>" for w in _clean(rng).split()), "en", "a") for k in range(300)]
    got = {r.doc_id: r.kept for r in outliers.judged(_frame(spark, rows)).collect()}
    assert all(got[k] == bool(k % 5) for k in got)


def test_salted_join_equals_the_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(None if k % 3 else "a", k) for k in range(200)], "lang string, v int")
    small = spark.createDataFrame([(None, 1), ("b", 2)], "lang string, w int")
    want = sorted(map(tuple, outliers.with_small(rows, small, ["lang"]).collect()), key=str)
    monkeypatch.setattr(outliers, "_MOST_BROADCAST", 0)
    assert sorted(map(tuple, outliers.with_small(rows, small, ["lang"]).collect()), key=str) == want
    assert sum(w is not None for *_, w in want) == sum(k % 3 > 0 for k in range(200))


@pytest.mark.parametrize("p, d, x", [(0.95, 1, 3.841459), (0.975, 5, 12.832502), (0.5, 2, 1.386294), (0.9999, 5, 25.744832)])
def test_chi_square(p, d, x):
    assert math.isclose(outliers.chi2_quantile(p, d), x, rel_tol=1e-5)


def test_registered_query(spark):
    from chainframe.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in QUERIES["op13_outliers"](spark, sf).collect()}
    for r in documents(spark, sf).collect():
        got = out[r.doc_id]
        want = _stats(r.text)
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == want[:5]
        assert got.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    judged = [(x.quality, out[x.doc_id].kept) for x in labels if not out[x.doc_id].base_failed]
    assert all(k for q, k in judged if q == 1)
    assert sum(not k for q, k in judged if q == 0) > 0.8 * sum(q == 0 for q, _ in judged)
