"""Golomb-Rice codes of sorted 64-bit numbers, in numpy.

Numbers are coded as differences: the quotient by 2**k in unary in one stream of bits, the k
remaining bits in another, so that both are decoded without a loop.
"""

from __future__ import annotations

import numpy as np


def encode(numbers: np.ndarray, start: int, span: int) -> tuple[int, bytes, bytes]:
    """k, unary bits and remainder bits of sorted ``numbers`` within [start, start + span)."""
    if len(numbers) == 0:
        return 0, b"", b""
    gaps = np.diff(numbers, prepend=np.uint64(start)).astype(np.uint64)
    k = max(0, (max(1, span // len(numbers))).bit_length() - 1)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.ones(int(ends[-1]), bool)
    unary[ends - 1] = False
    shifts = np.arange(k, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(bool) if k else np.zeros((len(gaps), 0), bool)
    return k, np.packbits(unary).tobytes(), np.packbits(rest.ravel()).tobytes()


def decode(n: int, start: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    if n == 0:
        return np.zeros(0, np.uint64)
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)) == 0)[:n]
    gaps = (np.diff(stops, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * k).reshape(n, k)
        for j in range(k):
            gaps |= bits[:, j].astype(np.uint64) << np.uint64(j)
    return np.cumsum(gaps) + np.uint64(start)
