from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelflow.llm.queries import QUERIES
from panelflow.llm.toxicity import index, known_terms, score_toxicity, term_counts


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_held_out_accuracy(spark, tables):
    got = QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.01").join(tables[1], "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)
    pairs = [(a["score"], b["score"]) for a in held if a["toxic"] for b in held if not b["toxic"]]
    assert np.mean([(a > b) + 0.5 * (a == b) for a, b in pairs]) > 0.8
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.92
    assert not any(r["predicted"] for r in held if not r["toxic"])


def test_held_out_labels_and_other_columns_are_not_read(spark, tables):
    docs, labels = tables
    some = docs.filter("doc_id < 400")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    moved = some.withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "score": F.lit(1.0), "toxic": F.lit(1)})
    a = {r["doc_id"]: r["score"] for r in score_toxicity(some, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in score_toxicity(moved, flipped).collect()}
    assert a == b


def test_neighbours_are_exact():
    rng = np.random.default_rng(4)
    terms, n = 40, 700
    def vector():
        at = np.sort(rng.choice(terms, rng.integers(0, 6), replace=False))
        return at, rng.integers(1, 4, len(at)), int(rng.integers(0, 60) + 10)

    vectors = [vector() for _ in range(n)] + [(np.zeros(0, np.int64), np.zeros(0, np.int64), 9)] * 60
    ids = rng.permutation(len(vectors)) * 3
    made = index(ids, rng.integers(0, 2, len(vectors)), vectors, rng.integers(1, 300, terms), 1_000, k=7)
    dense = np.zeros((len(vectors), terms + 1))
    for k, v in enumerate(vectors):
        at, w = made.vector(*v)
        dense[k, at] = w
    for _ in range(60):
        at, w = made.vector(*vector())
        rows, sims = made.nearest(at, w, 7)
        q = np.zeros(terms + 1)
        q[at] = w
        every = np.round(dense @ q, 9)
        best = np.lexsort((ids, -every))[:7]
        assert made.ids[rows].tolist() == ids[best].tolist()
        assert np.allclose(sims, every[best])


def test_lexicon_terms_are_found():
    column = pa.array(["An Idiot, an IDIOT! no-one", None, "", "idiotic words"])
    words = [t for t, _, _ in term_counts(column)]
    lexicon = np.unique(np.concatenate(words))
    for (terms, counts, n), (places, found, m) in zip(term_counts(column), known_terms(column, lexicon)):
        assert (lexicon[places] == terms).all() and (counts == found).all() and n == m


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(4, 1, 1), (7, 0, 0), (7, 1, 0), (None, 1, 1), (9, None, 1), (99, 1, 0)], "doc_id long, toxic int, quality int")
    got = score_toxicity(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 for r in got)
    assert score_toxicity(nothing, labels).collect() == []
    assert {r["score"] for r in score_toxicity(awkward, labels.limit(0)).collect()} == {0.0}


def test_neighbours_are_those_of_whole_vectors(spark):
    """Against dense vectors of all terms of all documents; copies of toxic examples made of rare words are found."""
    rng, rows = np.random.default_rng(8), []
    common = [f"common{k}" for k in range(60)]
    for i in range(240):
        words = list(rng.choice(common, 12)) + [f"zq{i}x{k}" for k in range(6)]
        rows.append((i, " ".join(words + ["nasty"] * (i % 5 == 0 and i < 100))))
    learnt = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 != 1]
    rare = [i for i in learnt if i >= 100][:8]
    rows = [(i, " ".join(f"odd{i}w{k}" for k in range(20)) if i in rare else text) for i, text in rows]
    texts = dict(rows)
    rows += [(1_000 + i, texts[i]) for i in rare] + [(2_000 + i, texts[i] + " unheard word0f") for i in rare]
    rows += [(3_000, "nothing0 known1 here2"), (3_001, " .. "), (3_002, None)]
    labels = [(i, int(i in rare or (i % 5 == 0 and i < 100)), 0) for i in learnt]
    got = {r["doc_id"]: r for r in score_toxicity(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    ).collect()}
    bags = {i: dict(zip(t.tolist(), c.tolist())) for (i, _), (t, c, _) in zip(rows, term_counts(pa.array([t for _, t in rows])))}
    terms = {t: k for k, t in enumerate(sorted({t for b in bags.values() for t in b}))}
    df = np.zeros(len(terms))
    for b in bags.values():
        df[[terms[t] for t in b]] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    toxic = dict((i, t) for i, t, _ in labels)
    uses = lambda t, c: sum(t in bags[i] for i in learnt if toxic[i] == c)
    n1 = sum(toxic.values())
    n0 = len(learnt) - n1
    for t, k in terms.items():
        a, c = uses(t, 1), uses(t, 0)
        cells = [(a, n1 * (a + c)), (c, n0 * (a + c)), (n1 - a, n1 * (n1 + n0 - a - c)), (n0 - c, n0 * (n1 + n0 - a - c))]
        g = 2 * sum(o * np.log(o * (n1 + n0) / e) for o, e in cells if o)
        idf[k] *= 4 if a + c >= 3 and a / n1 > 2 * c / n0 and g >= 10.83 else 1

    def unit(i):
        v = np.zeros(len(terms))
        for t, c in bags[i].items():
            v[terms[t]] = (1 + np.log(c)) * idf[terms[t]]
        return v / (np.linalg.norm(v) or 1)

    examples = np.stack([unit(i) for i in learnt])
    for i, _ in rows:
        if not bags[i]:
            assert got[i]["neighbours"] == []
            continue
        every = np.round(examples @ unit(i), 9)
        best = np.lexsort((learnt, -every))[:15]
        assert np.allclose(got[i]["similarities"], every[best], atol=2e-9), i
        assert np.allclose(every[[learnt.index(j) for j in got[i]["neighbours"]]], every[best], atol=2e-9), i
    for i in rare:
        assert got[1_000 + i]["neighbours"][0] == i and got[1_000 + i]["similarities"][0] == 1.0
        assert got[2_000 + i]["neighbours"][0] == i and 0.8 < got[2_000 + i]["similarities"][0] < 1
        assert got[1_000 + i]["score"] > got[3_001]["score"]
    assert got[3_000]["similarities"] == [0.0] * 15 and got[3_000]["neighbours"] == learnt[:15]
