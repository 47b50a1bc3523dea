"""Vectorised tokenising and hashing of Arrow text columns with numpy.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
Its 64-bit hash comes from prefix sums over the whole buffer, so that no Python
code runs per word:  sum(T[b_i] * P**i) over the word, times P**-start, mixed.
Memory is bounded by WINDOW, not by the batch: a longer text is hashed in
windows cut at white space.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 20
_U = np.uint64
_M64 = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values, so that all bits depend on all bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x = x * _U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> _U(27))
        x = x * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, dtype=_U)
        out[0] = 1
        return np.multiply.accumulate(out)


_BYTES = np.arange(256)
IS_SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)
_TABLE = mix((_LOWER.astype(_U) + _U(1)) * _U(_P))
_POW = _powers(_P, WINDOW + 1)
_INV = _powers(_P_INV, WINDOW + 1)
_GRAM = mix(np.arange(1, 65, dtype=_U) * _U(0xD6E8FEB86659FD93)) | _U(1)


class Words(NamedTuple):
    """Words of the rows first..last-1 of a batch; word i of row r is at [offsets[r-first] + i]."""

    first: int
    last: int
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    data: np.ndarray
    bounds: np.ndarray


def _hash_window(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words in at most WINDOW bytes; no word crosses a bound."""
    n = len(data)
    if not n:
        return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)
    solid = ~IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, _U)
        np.cumsum(_TABLE[data] * _POW[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * _INV[starts] + (ends - starts).astype(_U)
    return mix(h), starts, ends


def _hash_long(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One text of more than WINDOW bytes, in windows that end at white space."""
    out, at, n = [], 0, len(data)
    while at < n:
        stop = min(n, at + WINDOW)
        if stop < n:
            gaps = np.flatnonzero(IS_SPACE[data[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:  # a single word longer than the window
                while stop < n and not IS_SPACE[data[stop : stop + WINDOW]].any():
                    stop = min(n, stop + WINDOW)
                if stop < n:
                    stop += int(np.flatnonzero(IS_SPACE[data[stop : stop + WINDOW]])[0])
                h = hashlib.blake2b(_LOWER.astype(np.uint8)[data[at:stop]].tobytes(), digest_size=8).digest()
                out.append((np.array([int.from_bytes(h, "little")], _U), np.array([at]), np.array([stop])))
                at = stop
                continue
        h, s, e = _hash_window(data[at:stop], np.empty(0, np.int64))
        out.append((h, s + at, e + at))
        at = stop
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, off, data = column.buffers()
    bounds = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if off else np.zeros(len(column) + 1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(column: pa.Array | pa.ChunkedArray):
    """Words of all rows, a few rows at a time."""
    data, bounds = text_buffer(column)
    n, i = len(bounds) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + WINDOW, "right")) - 1)
        part, own = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        h, s, e = _hash_long(part) if len(part) > WINDOW else _hash_window(part, own)
        yield Words(i, j, h, s, e, np.searchsorted(s, own, "left"), part, own)
        i = j


def combine(parts: list[np.ndarray], salt: int = 0) -> np.ndarray:
    """Hash of tuples given column-wise."""
    with np.errstate(over="ignore"):
        total = np.full(len(parts[0]), salt, dtype=_U)
        for k, p in enumerate(parts):
            total = total + p * _GRAM[k]
    return mix(total)


def shingles(h: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words in each row and their row offsets.

    A row of fewer words gives its whole sequence as one run, a row without
    words none. Repeats are kept.
    """
    n = np.diff(offsets)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    total = int(out[-1])
    if not total:
        return np.empty(0, _U), out
    at = np.repeat(offsets[:-1] - out[:-1], counts) + np.arange(total)
    size = np.repeat(np.minimum(n, k), counts)
    padded = np.concatenate([h, np.zeros(k, _U)])
    with np.errstate(over="ignore"):
        acc = size.astype(_U)
        short = bool((size < k).any())
        for j in range(k):
            term = padded[at + j] * _GRAM[j]
            acc = acc + (np.where(j < size, term, _U(0)) if short else term)
    return mix(acc), out


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words of one text."""
    return next(words(pa.array([text], pa.large_string()))).hashes
