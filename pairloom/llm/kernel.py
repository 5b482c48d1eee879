"""Vectorised hashing of words, shingles and byte n-grams over Arrow string columns.

Every function takes whole texts; a batch is cut into runs of rows of about CHUNK bytes so that
the working arrays stay small, whatever the number of rows of an Arrow batch.
Words are maximal runs of bytes outside space, tab, LF, VT, FF and CR, with A-Z lower-cased.
Null and empty texts have no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LETTER = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_LOWER = _LETTER.copy()
_LOWER[65:91] = _LETTER[97:123]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK, 1 << (n - 1).bit_length()) if n else CHUNK
    if size not in _powers:
        made = []
        for base in (_BASE, _INV):
            steps = np.full(size, base, _U)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if size > CHUNK:
            return tuple(made)
        _powers[size] = tuple(made)
    return _powers[size]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, one after another, and where each begins and the last ends."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(texts: pa.Array):
    """Cut into (first row, rows) so that each run holds about CHUNK bytes, or one longer text."""
    _, at = buffers(texts)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK, "right")) - 1)
        yield first, texts.slice(first, last - first)
        first = last


def _words(data: np.ndarray, at: np.ndarray, prefix: int) -> tuple[np.ndarray, ...]:
    solid = ~SEPARATORS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], solid[:-1]))
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate((solid[1:], [False]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_LOWER[data] * up[: len(data)], out=total[1:])
    whole = mix((total[ends] - total[starts]) * down[starts])
    if not prefix:
        return whole, starts
    short = starts + prefix
    if len(data) and data.max() > 127:  # by the bytes that begin a code point
        first = np.flatnonzero((data & 0xC0) != 0x80)
        short = np.append(first, np.full(prefix + 1, len(data)))[np.searchsorted(first, starts) + prefix]
    short = np.minimum(ends, short)
    return whole, starts, mix((total[short] - total[starts]) * down[starts])


def words(texts: pa.Array, prefix: int = 0) -> tuple[np.ndarray, ...]:
    """(bounds, hashes): text i has the words hashes[bounds[i]:bounds[i+1]], in order.

    With prefix, also the hashes of the words' first code points.
    A text longer than CHUNK is hashed piece by piece, cut between words.
    """
    data, at = buffers(texts)
    if len(at) == 2 and len(data) > 2 * CHUNK:
        parts, here = [], 0
        gaps = np.flatnonzero(SEPARATORS[data])
        while here < len(data):
            k = int(np.searchsorted(gaps, here + CHUNK, "left"))
            end = int(gaps[k]) + 1 if k < len(gaps) else len(data)
            parts.append(_words(data[here:end], np.array([0, end - here]), prefix))
            here = end
        out = [np.concatenate([p[i] for p in parts]) for i in ((0, 2) if prefix else (0,))]
        return (np.array([0, len(out[0])]), *out)
    found = _words(data, at, prefix)
    bounds = np.searchsorted(found[1], at)
    return (bounds, found[0], *found[2:])


def shingles(bounds: np.ndarray, hashes: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's distinct hashes of k words in a row, sorted; of all its words if it has fewer than k."""
    joined = np.zeros(max(0, len(hashes) - k + 1), _U)
    for j in range(k if len(joined) else 0):
        joined = joined * _U(_BASE) + hashes[j : j + len(joined)]
    joined = mix(joined)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.sort(joined[a : b - k + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            h = _U(b - a)
            with np.errstate(over="ignore"):
                for w in hashes[a:b]:
                    h = h * _U(_BASE) + w
            out.append(mix(np.array([h], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def grams(data: np.ndarray, n: int, letters: np.ndarray = _LETTER) -> np.ndarray:
    """Hashes of the n bytes from each position (those that reach over a text's end included)."""
    if len(data) < n:
        return np.zeros(0, _U)
    v = letters[data]
    joined = v[: len(v) - n + 1]
    for j in range(1, n):
        joined = joined * _U(_BASE) + v[j : len(v) - n + 1 + j]
    return joined
