"""Vectorised text kernels used inside Arrow tasks.

Everything here works on the UTF-8 buffer of a whole block of texts at once, so
no Python loop runs per word or per character.  Blocks are cut by bytes
(``text_blocks``); one text is never cut, but its bytes are worked through in
chunks, so beyond the text itself a kernel holds eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Odd multiplier and its inverse modulo 2**64: prefix sums of weighted terms
#: give the hash of any run of terms by one subtraction and one product.
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_CODE = mix64(np.arange(1, 257, dtype=_U) * _U(_BASE))

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Words are runs of anything but ASCII white space.
WORD_BY_SPACE = ~_SPACE
_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = True
_ALNUM[0x61:0x7B] = True
_ALNUM[0x80:] = True
#: Words are runs of lower-case ASCII letters, digits and non-ASCII characters.
WORD_BY_ALNUM = _ALNUM

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


#: Lead bytes of kana and Han characters (U+3000 to U+9FFF), which are written without spaces.
_UNSPACED = np.zeros(256, bool)
_UNSPACED[0xE3:0xEA] = True

#: Bytes that are worked on at once.
CHUNK = 1 << 20
_MASK = (1 << 64) - 1


def _powers(base: int) -> np.ndarray:
    steps = np.full(CHUNK + 1, base, _U)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_POWERS, _POWERS_INV = _powers(_BASE), _powers(_BASE_INV)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their n+1 offsets, from 0; a null is an empty text."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_blocks(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about ``max_bytes`` of text each, one row at least."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = buffer_of(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1
        end = min(n, max(end, at + 1))
        yield batch.slice(at, end - at)
        at = end


class Words:
    """The words of a block of texts.

    ``hash``: 64-bit word hashes in order; ``first``: n+1 offsets of each text's
    words; ``counts``: words of each text.  ``lower``: A-Z count as a-z;
    ``unspaced``: each kana or Han character is a word of its own.
    ``start`` and ``end``: bytes of each word, for ``words_at``.
    """

    def __init__(self, texts: pa.Array, is_word: np.ndarray, lower: bool = True, unspaced: bool = False, places: bool = False):
        raw, offsets = buffer_of(texts)
        hashes, first, seen = [], [], 0
        starts, ends = [], []
        held: tuple[int, int] | None = None  # hash and bytes of a word that reached the end of the chunk
        a = 0
        while a < len(raw):
            b = min(a + CHUNK, len(raw))
            while b < len(raw) and b > a + 1 and raw[b] & 0xC0 == 0x80:  # no character is cut
                b -= 1
            part = _LOWER[raw[a:b]] if lower else raw[a:b]
            inside = is_word[part]
            joined = np.zeros(b - a + 1, bool)  # this byte continues a word
            joined[1:-1] = inside[1:] & inside[:-1]
            own = slice(*np.searchsorted(offsets, [a, b]))
            cut = offsets[own] - a
            joined[cut] = False  # a word ends where its text ends
            alone = np.flatnonzero(_UNSPACED[part]) if unspaced else cut[:0]
            joined[alone] = False
            joined[np.minimum(alone + 3, b - a)] = False
            start = np.flatnonzero(inside & ~joined[:-1])
            end = np.flatnonzero(inside & ~joined[1:]) + 1
            sums = np.zeros(b - a + 1, _U)
            np.cumsum(_BYTE_CODE[part] * _POWERS[: b - a], out=sums[1:])
            value = (sums[end] - sums[start]) * _POWERS_INV[start]
            size = (end - start).astype(_U)
            goes_on = int(held is not None and bool(inside[0]) and 0 not in cut[:1] and not (len(alone) and alone[0] == 0))
            if held and goes_on:
                value[0] = (held[0] + pow(_BASE, held[1], 1 << 64) * int(value[0])) & _MASK
                size[0] += _U(held[1])
            elif held:
                hashes.append(_word_hash(*np.array([[held[0]], [held[1]]], _U)))
            first.append(seen + np.searchsorted(start, cut) - goes_on)
            if places:
                starts.append(start[goes_on:] + a)
                if goes_on:
                    ends[-1] = ends[-1][:-1]
                ends.append(end + a)
            seen += len(start) - goes_on
            held = None
            if len(end) and end[-1] == b - a and not (len(alone) and alone[-1] + 3 == b - a):
                held = int(value[-1]), int(size[-1])
                value, size = value[:-1], size[:-1]
            hashes.append(_word_hash(value, size))
            a = b
        if held:
            hashes.append(_word_hash(*np.array([[held[0]], [held[1]]], _U)))
        self.hash = np.concatenate([np.zeros(0, _U), *hashes])
        rest = len(offsets) - sum(map(len, first))
        self.first = np.concatenate([*first, np.full(rest, seen)]).astype(np.int64)
        self.counts = np.diff(self.first)
        if places:
            self.raw = raw
            self.start, self.end = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (starts, ends))

    def words_at(self, word: int, k: int) -> str:
        """k words from this one on, a-z for A-Z, with one space between."""
        spans = zip(self.start[word : word + k].tolist(), self.end[word : word + k].tolist())
        return b" ".join(self.raw[a:b].tobytes() for a, b in spans).lower().decode()

    def text_of(self, word: np.ndarray) -> np.ndarray:
        """The text that each word stands in."""
        return np.searchsorted(self.first, word, "right") - 1

    def grams(self, k: int, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First word (in the block) and hash of every run of k words inside one text that begins at words low to high."""
        high = min(len(self.hash) - k + 1, len(self.hash) if high is None else high)
        if high <= low:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        value = np.zeros(high - low, _U)
        for j in range(k):
            value = value * _U(_BASE) + self.hash[low + j : high + j]
        inside = np.ones(high - low, bool)
        for j in range(1, k):  # runs that would cross into the next text
            over = self.first[1:-1] - j - low
            inside[over[(over >= 0) & (over < high - low)]] = False
        at = np.flatnonzero(inside)
        return at + low, mix64(value[at] ^ _U(k))


def _word_hash(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix64(value ^ size)
