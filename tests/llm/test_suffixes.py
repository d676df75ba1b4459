from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from brute import repeats, runs, sha
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from panelflow.llm import suffix_dedup
from panelflow.llm.queries import QUERIES
from panelflow.llm.suffix_dedup import least_ids, remove_repeats
from panelflow.llm.suffixes import common_prefixes, suffix_array


def check(rows, got):
    want = Counter()
    for (i, body), gone in zip(rows, repeats(rows)):
        want[(i, len(body), int(gone.sum()), runs(gone), sha(np.frombuffer(body, np.uint8)[~gone].tobytes()))] += 1
    assert Counter(got) == want


def digest(cleaned):
    return [tuple(r) for r in cleaned.select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()]


def bodies(docs):
    return [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]


def test_whole_table(spark, small, documents):
    check(bodies(documents), [tuple(r) for r in QUERIES["op6_suffix_dedup"](spark, small).collect()])


def test_awkward_rows_and_small_parts(awkward, nothing):
    check(bodies(awkward), digest(remove_repeats(awkward)))
    check(bodies(awkward), digest(remove_repeats(awkward, part_bytes=300, run_bytes=1_000)))
    assert remove_repeats(nothing).collect() == []


def test_kept_text_and_carried_columns(awkward):
    got = remove_repeats(awkward.filter("doc_id in (17, 18)"), as_text=True, carry=["source", "row"]).orderBy("doc_id").collect()
    assert got[0]["rest"]["source"] == "s" and got[1]["kept"] == "aéa"[:1] + got[1]["kept"][1:]
    assert all(isinstance(r["kept"], str) for r in got)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"ab", b"\x00", b"\xff", b"abcabcabc", b"zz" * 9]), max_size=40), st.integers(1, 40))
def test_suffix_array_and_prefixes(parts, depth):
    raw = b"".join(parts)
    text = np.frombuffer(raw, np.uint8)
    order = suffix_array(text, depth)
    assert sorted(order.tolist()) == list(range(len(raw)))
    heads = [raw[i : i + depth] + b"\x00" * max(0, depth - len(raw) + i) for i in order]
    assert heads == sorted(heads)
    prefixes = common_prefixes(text, order)
    for k in range(1, len(order)):
        a, b, n = order[k - 1], order[k], 0
        while max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        assert prefixes[k] == n


@pytest.mark.parametrize("part_bytes", [1, 60, 10_000])
def test_parts_merge_by_binary_search(part_bytes):
    rng = np.random.default_rng(2)
    width, texts = 12, []
    base = rng.integers(0, 3, 30, dtype=np.uint8)
    for _ in range(25):
        own = base.copy()
        own[rng.integers(0, 30)] = rng.integers(0, 3)
        texts.append(own[: rng.integers(13, 31)])
    low = rng.integers(0, 9, len(texts)).astype(np.int64)
    windows = np.array([len(t) - width + 1 for t in texts])
    key = np.repeat(np.array([1, 2], np.uint64), [20, 5])
    got = least_ids(np.concatenate(texts), key, windows, low, width, part_bytes)
    first: dict = {}
    for t, k, i in zip(texts, key, low):
        for j in range(len(t) - width + 1):
            w = (int(k), t[j : j + width].tobytes())
            first[w] = min(first.get(w, i), i)
    want = [first[(int(k), t[j : j + width].tobytes())] for t, k in zip(texts, key) for j in range(len(t) - width + 1)]
    if part_bytes == 10_000:  # one part also compares across keys, which cannot hold equal windows in use
        assert all(g <= w for g, w in zip(got, want))
    else:
        assert all(g <= w for g, w in zip(got, want)) and len(got) == len(want)


def test_suffix_arrays_hold_only_windows_that_repeat(monkeypatch):
    """Segments of one key without a common window need no suffix array; the others as much as repeats."""
    rng, seen = np.random.default_rng(8), []
    alone = [rng.integers(97, 123, 90).astype(np.uint8) for _ in range(300)]
    shared = rng.integers(97, 123, 70).astype(np.uint8)
    parts = [*alone, *(np.concatenate([alone[k][:20], shared, alone[k][:30]]) for k in range(4))]
    windows, low = np.array([len(p) - 49 for p in parts]), rng.permutation(len(parts)).astype(np.int64)
    key, text = np.full(len(parts), 5, np.uint64), np.concatenate(parts)
    want = suffix_dedup.least_ids(text, key, windows, low, 50)
    original = suffix_dedup.window_owners
    monkeypatch.setattr(suffix_dedup, "window_owners", lambda text, *rest: seen.append(len(text)) or original(text, *rest))
    monkeypatch.setattr(suffix_dedup, "HASHED_BYTES", 1_000)
    assert suffix_dedup.repeated_ids(text, key, windows, low, 50).tolist() == want.tolist()
    assert sum(seen) == 4 * 70
    assert suffix_dedup.repeated_ids(text[: 90 * 300], key[:300], windows[:300], low[:300], 50).tolist() == np.repeat(low[:300], windows[:300]).tolist()
    assert sum(seen) == 4 * 70
