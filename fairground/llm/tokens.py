"""Texts of an Arrow column as one byte array: words, their hashes and windows of them, without a loop over words.

Everything works on UTF-8 bytes. Separators are ASCII, so bytes beyond ASCII are always part of a word. Hashes are 64
bits wide and depend on the bytes of a word alone, never on where it stands or how the work was cut up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
GROUP = 1 << 21  # bytes of text worked on at a time; one longer text is a group of its own
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(PIECE, _BASE)]), dtype=np.uint64)
_UNPOWER = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(PIECE, np.uint64(pow(int(_BASE), -1, 1 << 64)))]), dtype=np.uint64)
_PLACE = np.random.default_rng(12).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def separators(pattern: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(pattern)] = True
    return out


SPACE = separators(b"\x20\x09\x0a\x0b\x0c\x0d")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array (nulls are empty) and the n + 1 offsets of its values."""
    array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of consecutive texts of about GROUP bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + GROUP, side="right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, is_space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~is_space[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[first] = inside[first]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    closes[last] = inside[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte range; ranges in order, without overlap."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        at = starts[i]
        j = int(np.searchsorted(ends, at + PIECE, side="right"))
        if j <= i:  # longer than a piece: the hashes of its pieces, chained
            h = np.zeros(1, np.uint64)
            for s in range(int(at), int(ends[i]), PIECE):
                part = _BYTE[data[s : min(s + PIECE, int(ends[i]))]]
                h = mix(h * _BASE + (part * _POWER[: len(part)]).sum(dtype=np.uint64))
            out[i] = h[0]
            i += 1
            continue
        part = _BYTE[data[at : ends[j - 1]]]
        part *= _POWER[: len(part)]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        a, b = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix((total[b] - total[a]) * _UNPOWER[a] + (b - a).astype(np.uint64) * _M1)
        i = j
    return out


def windows(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` words inside a text, and the number of each one's first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = h[:m] * _PLACE[0]
    for k in range(1, n):
        total += h[k : k + m] * _PLACE[k]
    at = np.flatnonzero(doc[:m] == doc[n - 1 : n - 1 + m])
    return mix(total[at] + np.uint64(n)), at


def short_windows(h: np.ndarray, doc: np.ndarray, n_texts: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """One hash for each text of 1 to ``n - 1`` words, over all its words; and the text's number."""
    count = np.bincount(doc, minlength=n_texts)
    few = np.flatnonzero((count > 0) & (count < n))
    first = np.cumsum(count) - count
    total = np.zeros(len(few), np.uint64)
    for k in range(n - 1):
        has = count[few] > k
        total[has] += h[first[few[has]] + k] * _PLACE[k]
    return mix(total + count[few].astype(np.uint64)), few
