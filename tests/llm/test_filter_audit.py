from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

from panelflow.llm.filter_audit import failure_masks, interaction_audit, removal_intervals


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
def test_intervals_say_every_removal(k):
    found = defaultdict(dict)
    for mask, step, begin, end in removal_intervals(k):
        for rank in range(begin, end):
            assert rank not in found[mask]
            found[mask][rank] = step
    for mask in range(1 << k):
        want = {r: next(i for i, f in enumerate(order, 1) if mask >> f & 1) for r, order in enumerate(permutations(range(k)))} if mask else {}
        assert found[mask] == want


def test_intervals_do_not_touch():
    found = removal_intervals(5)
    assert len(found) < 840 and len({(m, s, b) for m, s, b, _ in found}) == len(found)
    assert not {(m, s, e) for m, s, _, e in found} & {(m, s, b) for m, s, b, _ in found}


def masks(rows, labels):
    """Part, mask, good, toxic of each row, by reading the conditions aloud."""
    ids = defaultdict(list)
    for i, text, _ in rows:
        if i is not None:
            ids[text or ""].append(i)
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            any(c in "#$%&*|" for c in text), i is not None and any(j < i for j in ids[text]),
        ]
        yield part or "", sum(f << k for k, f in enumerate(fails)), any(q == 1 for j, q, _ in labels if j == i is not None), any(t == 1 for j, _, t in labels if j == i is not None)


def brute(rows, labels):
    out = {}
    seen = list(masks(rows, labels))
    for part in {p for p, *_ in seen}:
        docs = [d[1:] for d in seen if d[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                bit = 1 << ord(f) - 65
                gone, left = [d for d in left if d[0] & bit], [d for d in left if not d[0] & bit]
                shapley[f] += len(gone)
                fails = sum(bool(m & bit) for m, *_ in docs)
                out[part, "".join(order), step] = [
                    len(left), len(gone), fails - len(gone), sum(m == bit for m, *_ in docs), sum(g for _, g, _ in gone), sum(t for _, _, t in gone), f,
                ]
        for key, values in out.items():
            if key[0] == part and isinstance(values[-1], str):
                values[-1] = shapley[values[-1]]
    return out


def test_awkward_rows(spark, awkward):
    more = [(100 + k, t, p) for k, (t, p) in enumerate([
        ("good words " * 40, "b"), (" ".join(f"w{j}" for j in range(60)), "b"), (" ".join(f"w{j}" for j in range(60)), None), (" ".join(f"W{j}" for j in range(60)) + " # |", ""),
        ("A B", "s"), ("x" * 49 + " " * 3, "s"), (" ".join(f"v{j}" for j in range(70)), "b"),
    ])]
    docs = awkward.select("doc_id", "text", "source", "kept", "run").unionByName(
        spark.createDataFrame(more, "doc_id long, text string, source string"), allowMissingColumns=True
    )
    labels = [(101, 1, 0), (101, 0, 1), (102, 1, None), (7, None, 1), (None, 1, 1), (999, 1, 1), (100, 1, 1), (10, 1, 0)]
    marks = spark.createDataFrame([(*r, "x", 1) for r in labels], "doc_id long, quality int, toxic int, text string, mask int")
    got = interaction_audit(failure_masks(docs, marks)).collect()
    want = brute([tuple(r) for r in docs.select("doc_id", "text", "source").collect()], labels)
    assert len(got) == len(want) == 600 * 3
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got} == want


def test_no_rows(nothing, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction_audit(failure_masks(nothing, labels)).collect() == []


def test_other_numbers_of_filters(spark):
    rows = spark.createDataFrame([("p", m, 1 + m, m, None) for m in range(8)] + [("p", 3, None, 5, 1)], "part string, mask int, n int, good long, toxic int").withColumn("rank", F.lit(9))
    got = interaction_audit(rows, "XYZ").collect()
    assert len(got) == factorial(3) * 3
    first = {r["step"]: r for r in got if r["filter_order"] == "ZXY"}
    assert (first[1]["removed"], first[2]["removed"], first[3]["kept"]) == (5 + 6 + 7 + 8, 2 + 4, 1)
    with pytest.raises(ValueError):
        interaction_audit(rows, "BA")


def test_a_hot_part_and_text_are_spread(spark, plan):
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.lit("one text").alias("text"), F.lit("hot").alias("source"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    shown = plan(failure_masks(docs, labels))
    assert "CartesianProduct" not in shown and "NestedLoop" not in shown
    [row] = interaction_audit(failure_masks(docs, labels)).where("filter_order = 'EABCD' AND step = 1").collect()
    assert (row["removed"], row["kept"]) == (2_999, 1)
