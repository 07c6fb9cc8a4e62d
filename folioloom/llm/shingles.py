"""Word shingles of whole texts as sorted 64-bit hashes, worked out for many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_CHUNK = 1 << 21  # bytes of text that are hashed at once
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (shift, xor and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = np.uint64(pow(int(_P), -1, 2**64))
        _POWERS[size] = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, _P)]), np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, inverse)])
    return _POWERS[size]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts data[bounds[i]:bounds[i + 1]] and the number of its text. A-Z count as a-z;
    words end at ASCII white space and at the ends of texts."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    inside = ~((low == 32) | ((low >= 9) & (low <= 13)))
    cut = np.zeros(len(low) + 1, bool)
    cut[bounds] = True
    before = np.r_[False, inside[:-1]] & ~cut[:-1]
    after = np.r_[inside[1:], False] & ~cut[1:]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    power, inverse = _powers(len(low))
    total = np.r_[np.uint64(0), np.cumsum(_BYTES[low] * power[: len(low)], dtype=np.uint64)]
    h = (total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)
    return mixed(h), np.searchsorted(bounds, start, side="right") - 1


def sets(data: np.ndarray, bounds: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text, end to end, and each text's place among them. A
    text with fewer words is one shingle, one without words has none."""
    h, of = word_hashes(data, bounds)
    texts = len(bounds) - 1
    count = np.bincount(of, minlength=texts)
    at = np.r_[0, np.cumsum(count)]
    full = np.flatnonzero(of[: max(0, len(of) - n + 1)] == of[n - 1 :]) if len(of) >= n else np.zeros(0, np.int64)
    s = np.zeros(len(full), np.uint64)
    for k in range(n):
        s = s * _Q + h[full + k]
    short = np.flatnonzero((count > 0) & (count < n))
    s = np.r_[s, np.zeros(len(short), np.uint64)]
    for i, t in enumerate(short):
        value = int(count[t]) * int(_P)
        for w in h[at[t] : at[t + 1]]:
            value = value * int(_Q) + int(w)
        s[len(full) + i] = value % 2**64
    s, of = mixed(s), np.r_[of[full], short]
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (of[1:] != of[:-1])] if len(s) else np.zeros(0, bool)
    s, of = s[new], of[new]
    return s, np.r_[0, np.cumsum(np.bincount(of, minlength=texts))]


def text_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A binary column in chunks of whole texts: number of the first text, bytes, bounds. Null counts as empty."""
    k = 0
    while k < len(column):
        held, size = [], 0
        while k + len(held) < len(column) and (not held or size < _CHUNK):
            held.append(column[k + len(held)].as_py() or b"")
            size += len(held[-1])
        yield k, np.frombuffer(b"".join(held), np.uint8), np.r_[0, np.cumsum([len(x) for x in held])]
        k += len(held)


def signatures(s: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """16 bytes that stand for each set; None for empty sets."""
    a, b = (np.r_[np.uint64(0), np.cumsum(x, dtype=np.uint64)] for x in (mixed(s ^ _P), mixed(s ^ _Q)))
    n = np.diff(bounds)
    both = np.c_[mixed(a[bounds[1:]] - a[bounds[:-1]] + n.astype(np.uint64)), mixed(b[bounds[1:]] - b[bounds[:-1]])]
    return [row.tobytes() if k else None for row, k in zip(both, n)]
