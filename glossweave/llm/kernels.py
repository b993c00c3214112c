"""Numpy kernels over the bytes of one text at a time: word hashes and window hashes.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; in UTF-8 these bytes never occur inside
another character, so words of bytes are words of text.  Hashes are 64-bit polynomial prefix hashes
over random byte values, finished by an avalanche step.  Work runs in blocks, so memory beside
the text itself is bounded, however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
BLOCK = 1 << 19
LONG_WORD = 4096
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240229)
PLAIN = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
FOLDED = PLAIN.copy()
FOLDED[65:91] = PLAIN[97:123]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
_POWERS: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for name, base in (("pow", _BASE), ("inv", pow(_BASE, -1, 2**64))):
            p = np.full(BLOCK + 2 * LONG_WORD + 2, U(base))
            p[0] = U(1)
            _POWERS[name] = np.cumprod(p)
    return _POWERS["pow"], _POWERS["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def byte_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each row; null as empty."""
    c = column.cast(pa.large_binary())
    _, at, data = c.buffers()
    offsets = np.frombuffer(at, np.int64)[c.offset : c.offset + len(c) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    empty = raw[:0]
    valid = c.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(c)):
        yield raw[offsets[i] : offsets[i + 1]] if valid[i] else empty


def word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word."""
    edge = np.zeros(len(b) + 2, np.int8)
    edge[1:-1] = (b != 32) & ((b < 9) | (b > 13))
    d = np.diff(edge)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def word_hashes(b: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each word; ``fold`` takes A-Z as a-z."""
    start, end = word_spans(b)
    power, inverse = _powers()
    values = FOLDED if fold else PLAIN
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        lo = start[i]
        j = max(i + 1, int(np.searchsorted(end, lo + BLOCK, "right")))
        hi = min(end[j - 1], lo + BLOCK)
        h = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[b[lo:hi]] * power[: hi - lo], out=h[1:])
        s, e = start[i:j] - lo, np.minimum(end[i:j] - lo, hi - lo)
        out[i:j] = (h[e] - h[s]) * inverse[s]
        i = j
    for k in np.flatnonzero(end - start > LONG_WORD):
        word = b[start[k] : end[k]]
        out[k] = xxhash.xxh64_intdigest((_LOWER[word] if fold else word).tobytes())
    return mix(out)


def sequence_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive 64-bit values (mixed values, so any base will do)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers()
    out = np.empty(n, np.uint64)
    step = BLOCK
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        part = values[lo : hi + width - 1]
        h = np.zeros(len(part) + 1, np.uint64)
        if len(part) <= len(power):
            np.cumsum(part * power[: len(part)], out=h[1:])
        else:
            raise ValueError("width is larger than a block")
        k = np.arange(hi - lo)
        out[lo:hi] = (h[k + width] - h[k]) * inverse[k]
    return mix(out)
