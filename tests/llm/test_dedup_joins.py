"""Exact dedup, the n-gram join and line dedup against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chainframe.llm import exact_dedup, line_dedup, ngram_join
from chainframe.llm.components import components

SCHEMA = "doc_id long, text string, h string, norm int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(parts)


def _groups(rows):
    by = {}
    for i, t in rows:
        by.setdefault(re.sub(r"[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g)) for g in by.values() for _, i in g}


def _copies(seed=0):
    rng = random.Random(seed)
    rows, i = [], 0
    for k in range(30):
        t = "".join(rng.choice("ab é\n") for _ in range(rng.randint(1, 12)))
        for _ in range(rng.choice([1, 1, 2, 5])):
            rows.append((i, t.replace(" ", rng.choice([" ", "  ", "\t"]))))
            i += 1
    for _ in range(200):  # one text holds a third of all rows and more
        rows.append((i, "hot text" + " " * rng.randint(0, 3)))
        i += 1
    return rows + [(i, None), (i + 1, ""), (i + 2, " \n"), (-5, "negative"), (-6, "negative")]


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda c: F.substring(F.sha2(c, 256), 1, 2)], ids=["sha256", "colliding"])
def test_exact_groups(spark, digest):
    rows = _copies()
    got = {r.doc_id: r for r in exact_dedup.exact_groups(_frame(spark, rows), salts=4, digest=digest).collect()}
    want = _groups(rows)
    assert {i: (r.keep_id, r.group_size) for i, r in got.items()} == want
    assert all(r.kept == (r.keep_id == i) for i, r in got.items())


def test_the_longest_original_stays_and_all_columns_with_it(spark):
    kept = exact_dedup.drop_copies(_frame(spark, [(3, "a b"), (1, "ab"), (2, "a  b"), (4, "a  b"), (None, "z")])).collect()
    assert sorted((r.doc_id or 0, r.h, r.norm) for r in kept) == [(0, "clash", 1), (2, "clash", 1)]


def test_one_row_of_each_class_stays_whatever_the_ids(spark):
    rows = [(0, "other  "), (1, "aaaa"), (1, "other"), (5, "x y"), (5, "x y"), (5, "xy "), (None, "n"), (None, "n"), (None, " m "), (None, "m")]
    got = exact_dedup.exact_groups(_frame(spark, rows)).collect()
    kept = sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id if r.keep_id is not None else -1, r.group_size) for r in got if r.kept)
    assert len(got) == len(rows) and kept == [(-1, -1, 2), (-1, -1, 2), (0, 0, 2), (1, 1, 1), (5, 5, 3)]
    stay = sorted((str(r.doc_id), r.text) for r in exact_dedup.drop_copies(_frame(spark, rows)).collect())
    assert [i for i, _ in stay] == ["0", "1", "5", "None", "None"] and {t for _, t in stay} - {"x y", "xy "} == {"other  ", "aaaa", "n", " m "}


def test_one_document_of_each_component_stays_whatever_the_ids(spark):
    words = [f"w{k}" for k in range(60)]
    near = " ".join([*words[:30], "changed", *words[31:]])
    rows = [(5, " ".join(words)), (5, " ".join(words)), (7, near), (5, "another text altogether " * 9), (None, near), (None, ""), (None, None), (9, "a b")]
    for parts in (1, 4):
        kept = ngram_join.keep_one_of_each(_frame(spark, rows, parts), width=3, num=80, den=100).collect()
        assert sorted((str(r.doc_id), r.text) for r in kept if r.text) == [("5", "another text altogether " * 9), ("9", "a b"), ("None", near)]
        assert sum(not r.text for r in kept) == 2 and kept[0].h == "clash"


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_groups(empty).count() == 0
    assert ngram_join.linked_components(empty).count() == 0
    assert line_dedup.line_decisions(empty).count() == 0


def _near_rows(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    common = [rng.choice(words) for _ in range(20)]
    rows, i = [], 0
    for _ in range(22):
        base = [rng.choice(words) for _ in range(rng.choice([4, 5, 30, 60, 120, 400]))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((i, " ".join(w + common * (rng.random() < 0.3)).replace("w1", "W1")))
            i += 1
    for t in (None, "", "  ", "a", "a", "a b", "A  b", "a b c", "a\tb\nc"):
        rows.append((i, t))
        i += 1
    return rows


def _linked(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed,width,num,den", [(1, 3, 90, 100), (2, 5, 80, 100)])
def test_ngram_components(spark, seed, width, num, den):
    rows = _near_rows(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(_frame(spark, rows), width, num, den).collect()}
    assert got == _linked(rows, width, num, den)


def test_rows_without_id_and_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    got = ngram_join.linked_components(_frame(spark, [(None, text), (4, text), (4, text), (9, "other words here now")])).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.component_id or 0) for r in got) == [
        (False, 0, 0), (True, 4, 0), (True, 4, 0), (True, 9, 9)]


def _large_family(seed, num, den):
    """Sets of 500 to 5,000 shingles with pairs around the threshold."""
    rng = random.Random(seed)
    rows, i = [], 0
    for size in (510, 900, 2000, 5000):
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(size)]
        for k in range(5):
            w = list(base)
            most = int(size * (den - num) / (den + num) / 3)  # each change is three shingles of either set
            for at in rng.sample(range(0, size, 4), min(size // 4, max(1, most + rng.randint(-6, 6) if k % 2 else rng.randint(0, 9)))):
                w[at] = f"x{rng.randrange(10 ** 9)}"
            rows.append((i, " ".join(w)))
            i += 1
    return rows


def test_large_sets_around_the_threshold(spark):
    rows = _large_family(3, 90, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(_frame(spark, rows)).collect()}
    assert got == _linked(rows, 3, 90, 100)
    assert min(n for n, _ in got.values()) > 500 and len({c for _, c in got.values()}) > 4


def test_links_that_only_the_sketches_claim_are_not_taken(spark, monkeypatch):
    rows = _large_family(4, 90, 100)
    monkeypatch.setattr(ngram_join, "verdict", lambda n, m, x, y, num, den: 1)  # claims every link
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(_frame(spark, rows)).collect()}
    assert got == _linked(rows, 3, 90, 100)


def test_verdicts_are_never_wrong():
    rng = np.random.default_rng(0)
    seen = set()
    for _ in range(400):
        n = int(rng.integers(1, 1500))
        apart = int(rng.integers(0, max(2, n // 5)) * rng.integers(0, 2))
        base = rng.integers(0, 2 ** 62, n)
        x, y = base, np.concatenate([base[apart // 2 :], rng.integers(0, 2 ** 62, apart - apart // 2)])
        if not len(y):
            continue
        common = len(np.intersect1d(x, y))
        linked = 100 * common >= 90 * (len(x) + len(y) - common)
        v = ngram_join.verdict(len(x), len(y), ngram_join.compact(x), ngram_join.compact(y), 90, 100)
        seen.add(v)
        assert v == 2 or v == linked
    assert seen == {0, 1, 2}


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 50)] + [(7, 7)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, **{1000 + k: 1000 for k in range(1, 50)}}


# --- lines -----------------------------------------------------------------------------------

def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _edited(rng, s, k):
    s = list(s)
    for _ in range(k):
        at, kind = rng.randrange(len(s) + 1), rng.random()
        if kind < 0.34 or not s:
            s.insert(at, rng.choice("abc"))
        elif kind < 0.67:
            del s[min(at, len(s) - 1)]
        else:
            s[min(at, len(s) - 1)] = rng.choice("abc")
    return "".join(s)


@pytest.mark.parametrize("tau", [0, 1, 2, 3, 5])
def test_banded_distance(tau):
    rng = random.Random(tau)
    a = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    b = [_edited(rng, x, rng.randint(0, tau + 2)) for x in a]
    got = line_dedup.banded_distance([x.encode() for x in a], [x.encode() for x in b], tau)
    for x, y, d in zip(a, b, got.tolist()):
        want = _distance(x, y)
        assert d == want if want <= tau else d > tau


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_every_near_pair_shares_a_key(tau):
    rng = random.Random(10 + tau)
    a = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(10, 60))) for _ in range(300)]
    pairs = [(x, _edited(rng, x, rng.randint(1, tau))) for x in a]
    lines = line_dedup.Lines(pa.array([x for p in pairs for x in p]))
    keys = {}
    for k, row, role in zip(*(x.tolist() for x in line_dedup.segment_keys(lines, np.arange(len(lines.id)), tau))):
        for r in (line_dedup.INDEX, line_dedup.PROBE):
            if role & r:
                keys.setdefault((row, r), set()).add(k)
    sketches = lines.sketches()
    for i, (x, y) in enumerate(pairs):
        s, l = (2 * i, 2 * i + 1) if len(x) <= len(y) else (2 * i + 1, 2 * i)
        assert keys[s, line_dedup.INDEX] & keys[l, line_dedup.PROBE]
        assert (int(sketches[s]) ^ int(sketches[l])).bit_count() <= 4 * tau or (int(sketches[s]) ^ int(sketches[l])) < 0 and \
            ((int(sketches[s]) ^ int(sketches[l])) & (2 ** 64 - 1)).bit_count() <= 4 * tau


def _line_rows(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh éß") for _ in range(rng.randint(18, 70))).strip() for _ in range(30)]
    rows = []
    for i in range(50):
        rows.append((i, "\n".join(_edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 6])) if rng.random() < 0.8
                                  else rng.choice(["short", "", "  ", "x" * 20]) for _ in range(rng.randint(0, 6)))))
    return rows + [(60, None), (61, ""), (62, "\n\n"), (63, "hot line of this table\n" * 40)]


def _line_classes(rows, tau, least):
    seen = [(i, k, l.encode()) for i, t in sorted(rows) for k, l in enumerate((t or "").split("\n")) if l.strip(" \t\r\x0b\x0c")]
    lines = list(dict.fromkeys(l for _, _, l in seen))
    root = {l: l for l in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= tau and find(a) != find(b) and _distance(a, b) <= tau:
                root[find(a)] = find(b)
    first, equal = {}, {}
    for i, k, l in seen:
        first.setdefault(find(l), (i, k))
        equal.setdefault(l, (i, k))
    out = {i: [0, 0, 0, [], []] for i, _ in rows}
    for i, k, l in seen:
        keep = first[find(l)] == (i, k)
        out[i][0] += 1
        out[i][1] += keep
        out[i][2] += equal[l] == (i, k) and not keep
        out[i][3] += [k] * keep
        out[i][4].append(first[find(l)][0])
    return out


def test_line_decisions_and_the_texts_left(spark):
    rows = _line_rows(5)
    want = _line_classes(rows, 2, 16)
    got = {r.doc_id: [r.n_lines, r.n_kept, r.n_near, list(r.kept), list(r.class_docs)]
           for r in line_dedup.line_decisions(_frame(spark, rows), tau=2, min_bytes=16).collect()}
    assert got == want
    left = {r.doc_id: r.text for r in line_dedup.dedup_lines(_frame(spark, rows), tau=2, min_bytes=16).collect()}
    for i, t in rows:
        lines = [l for k, l in enumerate((t or "").split("\n")) if k in want[i][3] or not l.strip(" \t\r\x0b\x0c")]
        assert (left[i] or "") == "\n".join(lines)
