"""Plain, quadratic versions of the operators."""

from __future__ import annotations

import hashlib
import re

import numpy as np


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def shingles(text: str | None) -> set[tuple[str, ...]]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def components(sets: list[set], ids: list) -> list:
    """The smallest id that each row reaches; rows are linked by Jaccard of 0.8 and more."""
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    out = []
    for k in range(len(sets)):
        group = [ids[j] for j in range(len(sets)) if label[j] == label[k] and ids[j] is not None]
        out.append(min(group) if group and sets[k] else ids[k])
    return out


def repeats(rows: list[tuple[int | None, bytes]], width: int = 50) -> list[np.ndarray]:
    """For each (id, bytes) which bytes go."""
    first: dict[bytes, float] = {}
    order = [float("inf") if i is None else i for i, _ in rows]
    for i, body in zip(order, (b for _, b in rows)):
        for k in range(len(body) - width + 1):
            window = body[k : k + width]
            first[window] = min(first.get(window, i), i)
    out = []
    for i, (_, body) in zip(order, rows):
        gone = np.zeros(len(body), bool)
        for k in range(len(body) - width + 1):
            if first[body[k : k + width]] < i:
                gone[k : k + width] = True
        out.append(gone)
    return out


def runs(mask: np.ndarray) -> int:
    return int((np.diff(np.concatenate([[0], mask.astype(int), [0]])) == 1).sum())
