"""Suffix arrays by Larsson-Sadakane refinement and Kasai's common prefixes, in numpy."""

from __future__ import annotations

import numpy as np


def head_keys(text: np.ndarray) -> np.ndarray:
    """The first eight bytes of every suffix as one number; beyond the end there are zeros."""
    wide = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    keys = np.zeros(len(text), np.uint64)
    for j in range(8):
        keys |= wide[j : j + len(text)] << np.uint64(56 - 8 * j)
    return keys


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by at least their first ``depth`` bytes.

    Suffixes are sorted by eight bytes; a suffix's rank is the last place of its group.  Each round
    sorts the members of groups that are not single by the rank of the suffix as far on as has been
    compared, which doubles that distance.  Single suffixes are never looked at again.
    """
    n = len(text)
    keys = head_keys(text)
    order = np.argsort(keys, kind="stable")
    ranks = np.empty(n, np.int64)

    def last_places(new_group: np.ndarray, places: np.ndarray) -> np.ndarray:
        """For each of the sorted members, the place of its group's last one."""
        ends = np.append(np.flatnonzero(new_group)[1:] - 1, len(new_group) - 1)
        return places[ends][np.cumsum(new_group) - 1]

    ordered = keys[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.zeros(0, bool)
    places = np.arange(n)
    if n:
        ranks[order] = last_places(fresh, places)
    done = 8
    while n and done < depth:
        alone = fresh & np.append(fresh[1:], True)
        places, members = places[~alone], order[places[~alone]]
        if not len(members):
            break
        beyond = members + done
        further = np.where(beyond < n, ranks[np.minimum(beyond, n - 1)], -1)
        groups = ranks[members]
        by = np.lexsort((further, groups))
        members, further, groups = members[by], further[by], groups[by]
        order[places] = members
        fresh = np.concatenate([[True], (groups[1:] != groups[:-1]) | (further[1:] != further[:-1])])
        ranks[members] = last_places(fresh, places)
        done *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """By place in ``order``, the length of the common prefix with the suffix before it.

    Kasai's observation in bulk: walking the text, the common prefix with the preceding suffix falls
    by one from a position to the next as long as the byte before both is the same.  Only the other
    positions are compared, eight bytes at a time.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    same_left = np.zeros(n, bool)
    inner = (at > 0) & (before > 0)
    i = at[inner]
    same_left[inner] = (text[i - 1] == text[before[i] - 1]) & (before[i - 1] == before[i] - 1)
    starts = np.flatnonzero(~same_left)
    keys = head_keys(text)
    length = np.zeros(len(starts), np.int64)
    other = before[starts]
    live = np.flatnonzero(other >= 0)
    room = np.where(other >= 0, n - np.maximum(starts, other), 0)
    while len(live):
        a, b = starts[live] + length[live], other[live] + length[live]
        differ = keys[np.minimum(a, n - 1)] ^ keys[np.minimum(b, n - 1)]
        bits = np.where(differ == 0, 64, 63 - np.floor(np.log2(np.maximum(differ, 1).astype(np.longdouble))).astype(np.int64))
        step = bits // 8
        length[live] = np.minimum(length[live] + step, room[live])
        live = live[(step == 8) & (length[live] < room[live])]
    along = np.zeros(n, np.int64)
    owner = np.cumsum(~same_left) - 1
    along = np.maximum(length[owner] - (at - starts[owner]), 0)
    return along[order]
