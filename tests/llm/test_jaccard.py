from __future__ import annotations

import os
import random
import uuid
from collections import Counter

import numpy as np
from brute import components as plain_components, shingles
from pyspark.sql import functions as F

from panelflow.llm import jaccard
from panelflow.llm.components import components
from panelflow.llm.jaccard import Tree, jaccard_components
from panelflow.llm.queries import QUERIES


def check(rows, got):
    sets = [shingles(t) for _, t in rows]
    want = plain_components(sets, [i for i, _ in rows])
    expected = Counter((i, len(s), c) for (i, _), s, c in zip(rows, sets, want))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == expected


def test_whole_table(spark, small, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    check(rows, QUERIES["op1_jaccard_join"](spark, small).collect())


def test_awkward_rows(awkward):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    check(rows, jaccard_components(awkward).collect())


def test_empty_table(nothing):
    assert jaccard_components(nothing).collect() == []


def test_clusters_over_many_blocks(spark):
    """Families whose members drift, in blocks of a few sets: pivots and visits must find every link."""
    rng, rows = random.Random(5), []
    for family in range(3):
        words = [f"f{family}w{k}" for k in range(120)]
        for _ in range(40):
            copy = list(words)
            for k in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4])):
                copy[k] = f"n{rng.random()}"
            rows.append((len(rows), " ".join(copy)))
            if rng.random() < 0.3:
                words = copy
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, jaccard_components(frame, block_tokens=500).collect())


def test_threshold_is_exact(spark):
    """40 of 50 shingles in common is a link, 39 of 50 is none."""
    def pair(base, same):
        left = [f"{base}{k}" for k in range(49)]  # 45 shingles
        right = left[:same] + [f"{base}z{k}" for k in range(49 - same)]
        return " ".join(left), " ".join(right)

    rows = []
    for n, same in enumerate((44, 45)):
        rows += [(10 * n, pair(f"p{n}", same)[0]), (10 * n + 1, pair(f"p{n}", same)[1])]
    check(rows, jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_tree_links_what_brute_force_links():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(12):
        base = np.unique(rng.integers(0, 2**63, 90, dtype=np.uint64))
        for _ in range(12):
            keep = base[rng.random(len(base)) > rng.choice([0.02, 0.08, 0.2])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64)])))
    tree = Tree(sets, np.arange(len(sets)))
    tree.join(80)
    found = {int(tree.order[k]): int(tree.order[tree.root(k)]) for k in range(len(sets))}
    want = plain_components([set(s.tolist()) for s in sets], list(range(len(sets))))
    groups = lambda label: sorted(sorted(i for i in range(len(sets)) if label[i] == v) for v in set(label))
    assert groups([found[i] for i in range(len(sets))]) == groups(want)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(1000, k) for k in range(1001, 1060)]
    links = spark.createDataFrame(chain + star + [(7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 1000 for k in range(1000, 1060)}
    assert components(links.filter("false")).collect() == []


def test_counts_as_spark_sees_them(documents):
    got = jaccard_components(documents.select("doc_id", "text", F.lit(1).alias("component_id"), F.lit(2).alias("n")))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]


def test_many_unlinked_sets_come_in_chunks(spark, monkeypatch, tmp_path):
    """A cluster of templated texts without links: all visit all blocks, but no task holds more than a block and a chunk."""
    rng, original, folder = random.Random(6), jaccard._join_block, str(tmp_path)

    def measured(percent):
        join = original(percent)

        def run(rows):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                out.write(str(sum(len(t) // 8 for t in rows["tokens"])))
            return join(rows)

        return run

    monkeypatch.setattr(jaccard, "_join_block", measured)
    template = [" ".join(f"p{p}w{k}" for k in range(40)) for p in range(14)]
    rows = [(i, " ".join(template[p] for p in rng.sample(range(14), 5))) for i in range(70)]
    rows += [(1_000 + i, f"{text} tail") for i, text in rows[:5]]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, jaccard_components(frame, block_tokens=1_000).collect())
    sizes = [int(open(f"{folder}/{name}").read()) for name in os.listdir(folder)]
    assert len(sizes) > 20 and max(sizes) <= 6_000


def test_keys_are_the_rarest_shared_hashes(spark):
    """By exact counts, also of hashes that agree in all of their first bits; hashes of one set alone are no keys."""
    own = lambda k, n: [10_000 * (k + 1) + i for i in range(n)]
    common, pair = list(range(1, 31)), [500 + i for i in range(60)]
    sets = {b"a": common + pair + own(0, 10), b"b": common + pair + own(1, 10)} | {bytes([c]): common + own(c, 5) for c in range(48, 60)}
    rows = [(k, name, np.array(sorted(x), np.uint64).tobytes()) for k, (name, x) in enumerate(sets.items())]
    frame = spark.createDataFrame([(k // 2 if k > 1 else 90 + k, *r) for k, *r in rows], "run long, node binary, tokens binary")
    got = {bytes(r["node"]): r for r in jaccard.keyed(frame, 3, 80).collect()}
    assert set(got) == set(sets)
    for name in (b"a", b"b"):
        keys = np.frombuffer(got[name]["keys"], np.uint64).tolist()
        assert got[name]["n"] == 100 and len(keys) == 11 and set(keys) <= set(pair)
    assert {len(got[bytes([c])]["keys"]) // 8 for c in range(48, 60)} == {3}
