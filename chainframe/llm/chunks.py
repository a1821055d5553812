"""Token ids of whole texts, batch by batch, from ids of their distinct pieces.

Byte-level BPE never merges across the matches of its splitting pattern, and no match crosses a
space that follows a non-space. A text may therefore be cut before such spaces, and equal
chunks (and, inside them, equal matches) always get equal ids. ``ChunkEncoder`` keeps the ids
of the chunks and matches a Python worker has met, keyed by 128 bits in open-addressed numpy
tables: strings of up to 15 bytes by themselves and their length, longer ones by their 128-bit
xxh3 hash. No strings are held. Each table has at most ``most_bytes``; beyond that it starts anew
(nothing is skipped). A batch's ids are gathered with numpy.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash

_CUT = re.compile(r"(?<=\S)(?= )")
#: strings to (their numbers in some order, all their ids in that order, number of ids of each)
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]
_SHORT = 16  # shorter strings are their own keys
_SPACED, _LONG = np.uint64(1 << 60), np.uint64(1 << 63)  # in a key's high half, above the length
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class _Ragged:
    """Growing table of integer sequences."""

    def __init__(self) -> None:
        self.starts, self.lens = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids = np.zeros(8192, np.int32)
        self.n = self.used = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        b = np.zeros(max(n, 2 * len(a)), a.dtype)
        b[: len(a)] = a
        return b

    def add(self, ids: np.ndarray, lens: np.ndarray) -> None:
        n, used = self.n + len(lens), self.used + len(ids)
        self.starts, self.lens, self.ids = self._room(self.starts, n), self._room(self.lens, n), self._room(self.ids, used)
        self.lens[self.n : n] = lens
        self.starts[self.n : n] = self.used + np.cumsum(lens) - lens
        self.ids[self.used : used] = ids
        self.n, self.used = n, used

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of ``codes`` one after another, and each one's length."""
        lens = self.lens[codes]
        at = np.repeat(self.starts[codes] - (np.cumsum(lens) - lens), lens)
        at += np.arange(len(at))
        return self.ids[at], lens

    @property
    def nbytes(self) -> int:
        return self.starts.nbytes + self.lens.nbytes + self.ids.nbytes


def keys_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The low and high half of each string's key; bits 60 to 62 of the high half are free."""
    strings = strings.cast(pa.large_string())
    n = len(strings)
    offsets = np.frombuffer(strings.buffers()[1], np.int64, n + 1, 8 * strings.offset)
    first = int(offsets[0])
    raw = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[first : offsets[-1]]
    padded = np.concatenate([raw, np.zeros(24, np.uint8)])
    wide = np.ndarray(len(raw) + 17, "<u8", padded, 0, (1,)).copy()  # the eight bytes from each place on
    at, size = offsets[:-1] - first, np.diff(offsets)
    low = wide[at] & _FIRST_BYTES[np.minimum(size, 8)]
    high = (wide[at + 8] & _FIRST_BYTES[np.clip(size - 8, 0, 7)]) | (size.astype(np.uint64) << np.uint64(56))
    data = None
    for k in np.flatnonzero(size >= _SHORT).tolist():
        data = data or memoryview(raw)
        digest = xxhash.xxh3_128_intdigest(data[at[k] : at[k] + size[k]])
        low[k], high[k] = digest & 0xFFFFFFFFFFFFFFFF, (digest >> 64) & 0x0FFFFFFFFFFFFFFF | 1 << 63
    return low, high


class _Codes:
    """An open-addressed table of keys, numbered 0, 1, ... as they are added."""

    def __init__(self) -> None:
        self._slots = np.full(1 << 14, -1, np.int32)
        self._low, self._high = np.empty(1 << 13, np.uint64), np.empty(1 << 13, np.uint64)
        self.n = 0

    @property
    def nbytes(self) -> int:
        return self._slots.nbytes + self._low.nbytes + self._high.nbytes

    def _first_slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15) + (high ^ (high >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return ((h >> np.uint64(32)) & np.uint64(len(self._slots) - 1)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for unknown ones."""
        out = np.full(len(low), -1, np.int64)
        left, slot, last = np.arange(len(low)), self._first_slots(low, high), len(self._slots) - 1
        while len(left):
            code = self._slots[slot]
            used = code >= 0
            left, slot, code = left[used], slot[used], code[used]
            same = (self._low[code] == low[left]) & (self._high[code] == high[left])
            out[left[same]] = code[same]
            left, slot = left[~same], (slot[~same] + 1) & last
        return out

    def add(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Numbers of keys that are new and differ from one another."""
        upto = self.n + len(low)
        if upto > len(self._low):
            room = max(upto, 2 * len(self._low))
            self._low, self._high = (np.concatenate([a[: self.n], np.empty(room - self.n, np.uint64)]) for a in (self._low, self._high))
        new = np.arange(self.n, upto)
        self._low[new], self._high[new] = low, high
        self.n = upto
        if 2 * upto > len(self._slots):
            self._slots = np.full(1 << (4 * upto - 1).bit_length(), -1, np.int32)
            self._place(np.arange(upto))
        else:
            self._place(new)
        return new

    def _place(self, codes: np.ndarray) -> None:
        slot, last = self._first_slots(self._low[codes], self._high[codes]), len(self._slots) - 1
        while len(codes):
            free = self._slots[slot] < 0
            self._slots[slot[free]] = codes[free]  # of several, the last stays
            lost = self._slots[slot] != codes
            codes, slot = codes[lost], (slot[lost] + 1) & last


class ChunkEncoder:
    def __init__(self, encode: Encode, pattern: str, most_bytes: int = 64 << 20) -> None:
        self._encode, self._pattern, self._most_bytes = encode, regex.compile(pattern), most_bytes
        self._chunk_codes, self._chunks = _Codes(), _Ragged()
        self._match_codes, self._matches = _Codes(), _Ragged()

    def _bound(self) -> None:
        if self._chunk_codes.nbytes + self._chunks.nbytes > self._most_bytes:
            self._chunk_codes, self._chunks = _Codes(), _Ragged()
        if self._match_codes.nbytes + self._matches.nbytes > self._most_bytes:
            self._match_codes, self._matches = _Codes(), _Ragged()

    def _codes_of_matches(self, matches: pa.Array) -> np.ndarray:
        flat = matches.dictionary_encode()
        low, high = keys_of(flat.dictionary)
        codes = self._match_codes.find(low, high)
        new = np.flatnonzero(codes < 0)
        if len(new):
            order, ids, lens = self._encode(flat.dictionary.take(pa.array(new)).to_pylist())
            self._matches.add(ids, lens)
            codes[new[order]] = self._match_codes.add(low[new[order]], high[new[order]])
        return codes[flat.indices.to_numpy(zero_copy_only=False)]

    def _learn(self, chunks: list[str], plain: np.ndarray) -> np.ndarray:
        """Adds the ids of new chunks and tells in what order. Plain ones, of one leading space and
        no other white space at their ends, are matched in one go: each of their first matches
        starts with a space."""
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        matches = self._pattern.findall("".join([chunks[k] for k in np.flatnonzero(plain).tolist()]))
        n_plain, counts = len(matches), []
        for k in np.flatnonzero(~plain).tolist():
            own = self._pattern.findall(chunks[k])
            matches += own
            counts.append(len(own))
        matches = pa.array(matches, pa.large_string())
        first = np.flatnonzero(pc.starts_with(matches[:n_plain], " ").to_numpy(zero_copy_only=False))
        counts = np.concatenate([np.diff(np.append(first, n_plain)), np.array(counts, np.int64)])
        ids, lens = self._matches.gather(self._codes_of_matches(matches))
        ends = np.cumsum(counts)
        upto = np.append(0, np.cumsum(lens))
        self._chunks.add(ids, upto[ends] - upto[ends - counts])
        return order

    def _codes(self, words: pa.Array, low: np.ndarray, high: np.ndarray, before: str) -> np.ndarray:
        """Codes of the chunks ``before + word`` of distinct words."""
        if before:
            high = high | _SPACED
        codes = self._chunk_codes.find(low, high)
        new = np.flatnonzero(codes < 0)
        if len(new):
            own = words.take(pa.array(new))
            size, trimmed = (pc.binary_length(x).to_numpy() for x in (own, pc.utf8_trim_whitespace(own)))
            plain = (size == trimmed) & (size > 0) & (before == " ")
            order = self._learn([before + w for w in own.to_pylist()], plain)
            codes[new[order]] = self._chunk_codes.add(low[new[order]], high[new[order]])
        return codes

    def _codes_of(self, chunks: list[str]) -> np.ndarray:
        flat = pa.array(chunks, pa.large_string()).dictionary_encode()
        return self._codes(flat.dictionary, *keys_of(flat.dictionary), "")[flat.indices.to_numpy(zero_copy_only=False)]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each) of texts without nulls."""
        self._bound()
        n = len(texts)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        pieces = pc.split_pattern(texts.cast(pa.large_string()), " ")
        ends = pieces.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        flat = pieces.flatten().dictionary_encode()
        at, words = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
        low, high = keys_of(words)
        codes = self._codes(words, low, high, " ")[at]
        firsts = ends[:-1]
        some, own = np.unique(at[firsts], return_inverse=True)
        codes[firsts] = self._codes(words.take(pa.array(some)), low[some], high[some], "")[own]
        # a cut before a space is safe only after a non-space
        size = pc.binary_length(words).to_numpy()
        trimmed = pc.binary_length(pc.utf8_rtrim_whitespace(words)).to_numpy()
        empty = (size == 0)[at]
        open_end = (trimmed < size)[at] | empty
        open_end[ends[1:] - 1] = False
        open_end[firsts] &= ~empty[firsts]
        if open_end.any():
            owner = np.repeat(np.arange(n), np.diff(ends))
            slow = set(np.unique(owner[open_end]).tolist())
            runs = [self._codes_of(_CUT.split(texts[i].as_py())) if i in slow else codes[ends[i] : ends[i + 1]] for i in range(n)]
            codes = np.concatenate(runs)
            ends = np.append(0, np.cumsum([len(r) for r in runs]))
        ids, lens = self._chunks.gather(codes)
        upto = np.append(0, np.cumsum(lens))[ends]
        return ids, np.diff(upto)


def slices(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of at most ``most_bytes`` of text (a longer text alone). Runs are
    copies: some string kernels misread arrays whose first offset is not 0."""
    if not batch.num_rows:
        return
    size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(size)
    at = 0
    while at < len(size):
        done = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + most_bytes, side="right")))
        yield batch.take(pa.array(np.arange(at, end)))
        at = end


def library_encode(data: bytes) -> Encode:
    """Encodes pattern matches with the tokenizers library: those without a line feed are
    joined by line feeds (each a match, and a token, of its own) and encoded in one call."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(data.decode("utf-8"))
    tok.encode_special_tokens = True  # special tokens' strings in a text are ordinary text
    mark = tok.encode("\n", add_special_tokens=False).ids
    assert len(mark) == 1

    def encode(matches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        apart = np.fromiter(("\n" in m or m.isspace() for m in matches), bool, len(matches))
        order = np.concatenate([np.flatnonzero(~apart), np.flatnonzero(apart)])
        joined, other = ([matches[k] for k in np.flatnonzero(own).tolist()] for own in (~apart, apart))
        all_ids, all_lens = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        blocks = ["\n".join(joined[k : k + 20_000]) for k in range(0, len(joined), 20_000)]
        for e in tok.encode_batch_fast(blocks, add_special_tokens=False):
            ids = np.array(e.ids, np.int32)
            marks = np.flatnonzero(ids == mark[0])
            all_ids.append(np.delete(ids, marks))
            all_lens.append(np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1)
        for e in tok.encode_batch(other, add_special_tokens=False):
            all_ids.append(np.array(e.ids, np.int32))
            all_lens.append(np.array([len(e.ids)]))
        return order, np.concatenate(all_ids), np.concatenate(all_lens)

    return encode


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def worker_encoder(key: tuple, make: Callable[[], ChunkEncoder]) -> ChunkEncoder:
    """One encoder a Python worker, kept between its tasks."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = make()
    return _ENCODERS[key]


def release_encoder() -> None:
    """Gives up the worker's encoder; called by tasks of operators that need the memory."""
    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
