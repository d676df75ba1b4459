from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import sha
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from panelflow.llm import golomb
from panelflow.llm.exact_dedup import exact_dedup
from panelflow.llm.packing import CAPACITIES, best_fit, cost, pack


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**40 - 1), max_size=60), st.integers(0, 2**24 - 2))
def test_golomb_round_trip(numbers, high):
    start = high << 40
    values = np.sort(np.array([start + n for n in numbers], np.uint64))
    k, unary, rest = golomb.encode(values, start, 1 << 40)
    assert (golomb.decode(len(values), start, k, unary, rest) == values).all()


def test_golomb_codes_are_short():
    values = np.sort(np.random.default_rng(1).integers(0, 2**40, 50_000).astype(np.uint64))
    _, unary, rest = golomb.encode(values, 0, 1 << 40)
    assert (len(unary) + len(rest)) * 8 / len(values) < 27


@pytest.mark.parametrize("owner_rows", [1, 1 << 20])
def test_exact_awkward_rows(awkward, owner_rows):
    rows = [(r["doc_id"], r["text"] or "") for r in awkward.collect()]
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append((-len(text), i is None, i))
    want = Counter()
    for i, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        keep = min(groups[body], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        want[(i, keep, len(groups[body]), i == keep, sha(body))] += 1
    got = Counter(tuple(r) for r in exact_dedup(awkward, owner_rows=owner_rows).collect())
    assert got == want


def test_exact_empty_table(nothing):
    assert exact_dedup(nothing).collect() == []


def valid(rows, lengths, capacities):
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append(r)
    for group in bins.values():
        filled = sum(r["n_tokens"] for r in group)
        assert {r["filled"] for r in group} == {filled}
        assert {r["capacity"] for r in group} == {min(c for c in capacities if c >= filled)}
        at = 0
        for r in sorted(group, key=lambda r: (r["position"], r["n_tokens"])):
            assert r["position"] == at
            at += r["n_tokens"]
    placed = Counter()
    for r in rows:
        placed[r["doc_id"]] += r["n_tokens"]
    want = Counter()
    for i, n in lengths:
        want[i] += max(0, n or 0)
    assert placed == want


def test_packing_awkward_rows(awkward, nothing, spark):
    lengths = [(r["doc_id"], len((r["text"] or "").encode())) for r in awkward.collect()]
    for group_pieces in (4, 50_000):
        rows = pack(awkward, F.octet_length("text"), group_pieces=group_pieces).collect()
        valid(rows, lengths, CAPACITIES)
        assert {r["doc_id"] for r in rows} == {i for i, _ in lengths}
    assert pack(nothing, F.octet_length("text")).collect() == []
    odd = spark.createDataFrame([(1, -5), (2, None), (3, 16384), (4, 16385), (5, 40000)], "doc_id long, n long")
    rows = pack(odd, F.col("n")).collect()
    valid(rows, [(1, 0), (2, 0), (3, 16384), (4, 16385), (5, 40000)], CAPACITIES)
    assert Counter(r["doc_id"] for r in rows) == {1: 1, 2: 1, 3: 1, 4: 2, 5: 3}


def test_packing_of_the_table_wastes_little(documents):
    rows = pack(documents, F.octet_length("text")).collect()
    valid(rows, [(r["doc_id"], len((r["text"] or "").encode())) for r in documents.collect()], CAPACITIES)
    space = {r["bin_id"]: r["capacity"] for r in rows}
    assert sum(r["n_tokens"] for r in rows) > 0.97 * sum(space.values())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=40))
def test_best_fit_against_one_bin_each(sizes):
    sizes = sorted(sizes, reverse=True)
    capacities = (8, 16, 32, 64)
    bins, final = best_fit(sizes, capacities)
    filled = [sum(s for s, b in zip(sizes, bins) if b == k) for k in range(len(final))]
    assert all(c == min(x for x in capacities if x >= f) for c, f in zip(final, filled))
    alone = sum(cost(min(c for c in capacities if c >= s)) for s in sizes)
    assert sum(map(cost, final)) <= alone + 1e-9
