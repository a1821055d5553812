"""Counts of words, lines and symbols over whole texts, in vectors (used inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed values.
_SYMBOLS = b"#*$%&|<>"
_WINDOW = 8

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _flags(members: np.ndarray) -> np.ndarray:
    out = np.zeros(256, bool)
    out[members] = True
    return out


_SPACE = _flags(np.array([0x20, *range(0x09, 0x0E)]))
_CHAR_START = ~_flags(np.arange(0x80, 0xC0)) & ~_SPACE  # bytes that begin a code point other than a space
_SYMBOL = _flags(np.frombuffer(_SYMBOLS, np.uint8))


def _codes(lists: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Per piece a number (equal pieces, equal numbers) and its text; and the distinct pieces."""
    bounds = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    return (flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(n), np.diff(bounds)),
            flat.dictionary)


def repeated_words(code: np.ndarray, owner: np.ndarray, n: int, window: int = _WINDOW) -> np.ndarray:
    """Per text, its words that lie in a run of ``window`` words found twice or more in it.

    Runs are compared by a 64-bit sum first; those whose sum occurs again are compared exactly."""
    runs = len(code) - window + 1
    if runs < 2:
        return np.zeros(n, np.int64)
    key = (owner[:runs] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    odd = np.uint64(0xD6E8FEB86659FD93)
    word = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
    word ^= word >> np.uint64(32)
    for k in range(window):
        key = key * odd + word[k : k + runs]
    whole = np.flatnonzero(owner[:runs] == owner[window - 1 :])
    key = key[whole]
    ordered = np.sort(key)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return np.zeros(n, np.int64)
    place = np.minimum(np.searchsorted(again, key), len(again) - 1)
    some = whole[again[place] == key]
    rows = np.stack([owner[some], *[code[some + k] for k in range(window)]], axis=1)
    order = np.lexsort(rows.T[::-1])
    same = (rows[order[1:]] == rows[order[:-1]]).all(axis=1)
    twice = np.zeros(len(some), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(code) + 1, np.int64)
    np.add.at(step, some[twice], 1)
    np.add.at(step, some[twice] + window, -1)
    return np.bincount(owner[np.cumsum(step[:-1]) > 0], minlength=n)


def text_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """``STATS`` of each text (without nulls): words ``[^\\x20\\x09-\\x0D]+``; code points in words;
    characters of ``[#*$%&|<>]``; lines with a word equal to an earlier line; words in repeated runs
    of eight words; lines with a word."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)

    def count(kind: np.ndarray) -> np.ndarray:
        return np.fromiter((np.count_nonzero(kind[raw[a:b]]) for a, b in zip(offsets[:-1], offsets[1:])), np.int64, n)

    code, owner, distinct = _codes(pc.ascii_split_whitespace(texts), n)
    real = pc.binary_length(distinct).to_numpy(zero_copy_only=False)[code] > 0
    code, owner = code[real], owner[real]
    line, line_owner, lines = _codes(pc.split_pattern(texts, "\n"), n)
    real = pc.binary_length(pc.ascii_trim_whitespace(lines)).to_numpy(zero_copy_only=False)[line] > 0
    line, line_owner = line[real], line_owner[real]
    n_lines = np.bincount(line_owner, minlength=n)
    wide = max(1, len(lines))
    kinds = np.bincount(np.unique(line_owner * wide + line) // wide, minlength=n)
    return {"n_words": np.bincount(owner, minlength=n), "word_chars": count(_CHAR_START), "n_symbols": count(_SYMBOL),
            "n_dup_lines": n_lines - kinds, "n_repeat_words": repeated_words(code, owner, n), "n_lines": n_lines}
