"""Words, shingles and packed arrays, flat in numpy.

A word's hash adds up its pieces of eight bytes, each mixed with a key of its place; it is not linear in
the letters, so no family of words is known to share one. Hashes of runs of words come from prefix sums
of powers of odd numbers modulo 2^64, so any run's hash is one subtraction and one product, whatever
its length. Where a hash decides a result, two are compared (128 bits), built on word hashes of two
independent keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Odd multipliers of the prefix sums, keys of word hashes.
RUN_BASE, RUN_BASE_2 = 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
KEYS, MASK = (0x9E3779B97F4A7C15, 0xA0761D6478BD642F), (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below count."""
    if base not in _powers or len(_powers[base][0]) < count:
        size = max(1 << 16, 1 << (count - 1).bit_length() if count > 1 else 1)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            full = np.ones(size, np.uint64)
            full[1:] = np.uint64(b)
            out.append(np.multiply.accumulate(full))
        _powers[base] = (out[0], out[1])
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums that ``runs`` reads."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def runs(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the runs [start, end)."""
    return mix((prefix[ends] - prefix[starts]) * powers(base, len(prefix))[1][starts])


def spans(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a text, and where its words start and end; white space is space and \\t to \\r."""
    raw = np.frombuffer(data, np.uint8)
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return raw, edge[::2], edge[1::2]


def _places(count: int, key: int) -> np.ndarray:
    """Keys of the places of pieces in a word."""
    return mix((np.arange(count, dtype=np.uint64) + np.uint64(1)) * np.uint64(KEYS[key]))


def word_hashes(data: bytes, lower: bool = False, key: int = 0) -> np.ndarray:
    """One 64-bit hash per word of a text, under one of two independent keys."""
    raw, starts, ends = spans(data, lower)
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    pieces = (size + 7) >> 3
    first = np.cumsum(pieces) - pieces
    place = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    at = np.repeat(starts, pieces) + 8 * place
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))[at]
    left = np.minimum(np.repeat(ends, pieces) - at, 8).astype(np.uint64)
    eight = eight & (np.uint64(MASK) >> (np.uint64(64) - left * np.uint64(8)))
    keyed = mix(eight ^ _places(int(pieces.max()), key)[place])
    return mix(np.add.reduceat(keyed, first) ^ mix(size.astype(np.uint64) + np.uint64(KEYS[key])))


def shingles(data: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one shingle, an empty one none."""
    both = [word_hashes(data, lower=True, key=k) for k in (0, 1)]
    count = len(both[0])
    if not count:
        return both[0]
    starts = np.arange(max(1, count - size + 1))
    ends = np.minimum(starts + size, count)
    a, b = (runs(sums(w, base), starts, ends, base) for w, base in zip(both, (RUN_BASE, RUN_BASE_2), strict=True))
    return np.unique(mix(a + (b << np.uint64(1))) + np.uint64(count < size) * np.uint64(count))


def dealt(rows: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Rows of a record array, packed by part."""
    if not len(rows):
        return
    by = np.argsort(part, kind="stable")
    rows, part = rows[by], part[by]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
        yield int(part[a]), rows[a:b].tobytes()


def unpacked(cells, dtype: np.dtype) -> np.ndarray:
    """The rows of packed cells."""
    return np.frombuffer(b"".join(bytes(c) for c in cells), dtype)
