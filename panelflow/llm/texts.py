"""Whole texts of an Arrow column as bytes, and hashes of their words and shingles, in numpy.

A text is held by one task, like every value of a row; arrays made from it take about fifty
times its bytes, so texts are worked on in blocks of about one MiB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
BLOCK = 1 << 20

_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANK)] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[:128] = True
_IS_MARK[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the bounds of its rows; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)), bounds


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, bytes and bounds (from 0) of runs of rows of about ``limit`` bytes."""
    data, bounds = buffers(column)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        end = min(end, len(column))
        yield first, end, data[bounds[first] : bounds[end]], bounds[first : end + 1] - bounds[first]
        first = end


_LONG = 512  # bytes; longer runs are hashed one by one


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of bytes: blocks of eight are mixed in one after the other, the length first."""
    sizes = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    out = mix(sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x2545F4914F6CDD1D))
    short = sizes <= _LONG
    rows = None if short.all() else np.flatnonzero(short)
    done = 0
    while True:
        left = (sizes if rows is None else sizes[rows]) - done
        if not (go := left > 0).any():
            break
        if not go.all():
            rows, left = (np.flatnonzero(go) if rows is None else rows[go]), left[go]
        block = at[(starts if rows is None else starts[rows]) + done]
        block &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * np.maximum(0, 8 - left).astype(np.uint64))
        block = mix(block + np.uint64(0xD6E8FEB86659FD93))
        if rows is None:
            out = mix(out ^ block)
        else:
            out[rows] = mix(out[rows] ^ block)
        done += 8
    for k in np.flatnonzero(~short).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_hashes(data: np.ndarray, bounds: np.ndarray, letters: bool = False, prefix: int = 0, places: bool = False) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the words of several texts, A-Z lower-cased, and each text's bounds among them.

    A word is a run of bytes without ASCII white space, with ``letters`` one without any other
    ASCII sign than letters and digits.  With ``prefix``, third are hashes of the words' first bytes.
    With ``places``, third to fifth are where words begin and end, and the lower-cased bytes.
    """
    n = len(data)
    if n == 0 and places:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), np.zeros(len(bounds), np.int64), none, none, data
    if n == 0:
        return (np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64), *[np.zeros(0, np.uint64)] * bool(prefix))
    inside = ~(_IS_MARK if letters else _IS_BLANK)[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[bounds[:-1][bounds[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    lower = _LOWER[data]
    rows = np.searchsorted(starts, bounds)
    whole = run_hashes(lower, starts, ends)
    if places:
        return whole, rows, starts, ends, lower
    return (whole, rows, run_hashes(lower, starts, np.minimum(ends, starts + prefix))) if prefix else (whole, rows)


_ODD = mix(np.arange(11, 75, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the distinct shingles of one text, sorted; a text of fewer words is one shingle."""
    if len(words) == 0:
        return words
    if len(words) < size:
        return mix(np.array([(words * _ODD[: len(words)]).sum() + np.uint64(len(words))], np.uint64))
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += words[k : k + n] * _ODD[k]
    return np.unique(mix(total + np.uint64(size)))


def squeezed(column: pa.Array) -> pa.Array:
    """The texts' UTF-8 bytes, each as its size and a zstd frame; null counts as empty."""
    codec = pa.Codec("zstd", 3)
    raw = column.cast(pa.large_binary()).fill_null(b"").to_pylist()
    return pa.array([len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in raw], pa.binary())


def stretched(column: pa.Array) -> pa.Array:
    """The texts again."""
    codec = pa.Codec("zstd", 3)
    raw = [codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) if int.from_bytes(x[:8], "little") else b"" for x in column.to_pylist()]
    return pa.array(raw, pa.large_binary()).cast(pa.large_string())
