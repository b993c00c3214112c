"""Windows of texts that may be one of many sought byte strings, told by a sieve of bounded size.

Hashes of windows follow from running sums, so one of any length costs the same.  A window passes if its beginnings of
..., 4, 8, ... bytes (from the shortest string on) and then the whole of it are in the sieve: a string that is sought always
does, others rarely, and those an equality of the bytes must drop.  Work is done on pieces of ``PIECE`` bytes, however long a text is.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: How a string is sought: as a word of the text, anywhere in the text, or anywhere in the text without separators.
WORD, PART, BARE = range(3)
LEAST = 4  # a string sought without separators has at least as many characters, a word has less
LOG2_SLOTS = 24
PIECE = 1 << 20
ROWS = 1 << 18
_BASE, _MIX, _SALT = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD6E8FEB86659FD93)


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_OF_WORD = _class(b"abcdefghijklmnopqrstuvwxyz0123456789")
_SEPARATOR = _class(b" \t\n\x0b\f\r_/\\-")


@functools.lru_cache(4)
def _powers(base: int, log2: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full((1 << log2) - 1, base, np.uint64))), dtype=np.uint64)


class _Sums:
    """Hashes of the windows of ``data`` by their places and lengths."""

    def __init__(self, data: np.ndarray) -> None:
        log2 = max(len(data).bit_length(), PIECE.bit_length())
        self.back = _powers(pow(_BASE, -1, 1 << 64), log2)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * _powers(_BASE, log2)[: len(data)], dtype=np.uint64)))

    def slots(self, at: np.ndarray | range, n: int | np.ndarray, use: int) -> np.ndarray:
        """Slots of the windows of ``n`` bytes; strings and their beginnings have slots of their own."""
        first, last = (slice(at.start, at.stop), slice(at.start + n, at.stop + n)) if isinstance(at, range) else (at, at + n)
        h = (self.sums[last] - self.sums[first]) * self.back[first]
        salt = np.atleast_1d(n * 8 + use).astype(np.uint64) * _SALT + _MIX | np.uint64(1)  # a factor, as slots of equal summands fall together
        return ((h * salt) >> np.uint64(64 - LOG2_SLOTS)).view(np.int64)


def _groups(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts of about ``PIECE`` bytes at once: the first one's number, their bytes, and where each begins, with the end."""
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    cut = np.flatnonzero(np.diff(bounds[:-1] // PIECE, prepend=-1))
    for i, j in zip(cut, [*cut[1:], len(texts)], strict=True):
        yield int(i), data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]


def slots(keys: pa.Array, kinds: np.ndarray) -> Iterator[np.ndarray]:
    """Slots that the sought strings set: their own and those of their beginnings."""
    for i, data, bounds in _groups(keys):
        at, n, kind, sums = bounds[:-1], np.diff(bounds), kinds[i : i + len(bounds) - 1], _Sums(data)
        for k in (PART, BARE):
            own, size, q = at[kind == k], n[kind == k], 1
            yield sums.slots(own, size, 2 * k + 1)
            while len(own := own[size >= q]):
                size = size[size >= q]
                yield sums.slots(own, q, 2 * k)
                q *= 2


def _words(data: np.ndarray, bounds: np.ndarray, lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Texts, places and length of the words."""
    inside = _OF_WORD[data]
    joined = inside[1:] & inside[:-1]
    joined[bounds[(bounds > 0) & (bounds < len(data))] - 1] = False
    first, last = (np.flatnonzero(inside & ~x) for x in (np.append(False, joined), np.append(joined, False)))
    for n in lengths:
        some = first[last - first == n - 1]
        yield np.searchsorted(bounds, some, "right") - 1, some, n


def _set(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


def _windows(data: np.ndarray, bounds: np.ndarray, lengths: list[int], kind: int, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Texts, places and length of the windows that pass."""
    if not lengths:
        return
    longest, least = max(lengths), 1 << (min(lengths).bit_length() - 1)
    for a in range(0, len(data), PIECE):
        b = min(a + PIECE, len(data))
        sums = _Sums(data[a : b + longest - 1])
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(np.clip(bounds, a, b)))
        room = bounds[1:][text] - np.arange(a, b)
        at = np.flatnonzero(_set(bits, sums.slots(range(max(0, min(b, len(data) - least + 1) - a)), least, 2 * kind)))
        q = least
        while q <= longest and len(at := at[room[at] >= q]):
            if q > least:
                at = at[_set(bits, sums.slots(at, q, 2 * kind))]
            for n in lengths:
                if q <= n < 2 * q:
                    some = at[room[at] >= n]
                    some = some[_set(bits, sums.slots(some, n, 2 * kind + 1))]
                    yield text[some], a + some, n
            q *= 2


def _distinct(data: np.ndarray, text: np.ndarray, place: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Texts and bytes of the windows of ``n`` bytes, equal ones of a text once for each piece."""
    step = max(1, PIECE // n)
    for a in range(0, len(place), step):
        windows = np.lib.stride_tricks.sliding_window_view(data, n)[place[a : a + step]]
        coded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(n), len(windows), [None, pa.py_buffer(windows)]).dictionary_encode()
        k = len(coded.dictionary)
        pairs = pc.unique(pa.array(text[a : a + step] * k + coded.indices.to_numpy())).to_numpy()
        yield pairs // k, coded.dictionary.take(pa.array(pairs % k)).cast(pa.binary())


def found(texts: pa.Array, lengths: dict[int, list[int]], bits: np.ndarray) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Numbers of the texts (lower case) and the strings in them that are sought, and few others.

    ``lengths``: those of the sought strings in bytes, by kind.  ``bits``: the sieve, as bytes.
    """
    rows, keys, held = [], [], 0
    for i, data, bounds in _groups(texts):
        gone = np.flatnonzero(_SEPARATOR[data])
        bare, bare_bounds = np.delete(data, gone), bounds - np.searchsorted(gone, bounds)
        for over, hits in (
            (data, _words(data, bounds, lengths.get(WORD, []))),
            (data, _windows(data, bounds, lengths.get(PART, []), PART, bits)),
            (bare, _windows(bare, bare_bounds, lengths.get(BARE, []), BARE, bits)),
        ):
            for text, place, n in hits:
                for row, key in _distinct(over, text, place, n):
                    rows.append(row + i)
                    keys.append(key)
                    held += len(row)
                    if held >= ROWS:
                        yield pa.array(np.concatenate(rows)), pa.concat_arrays(keys)
                        rows, keys, held = [], [], 0
    if rows:
        yield pa.array(np.concatenate(rows)), pa.concat_arrays(keys)
