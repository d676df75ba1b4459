from __future__ import annotations

import re
from collections import defaultdict

import corpus_pipeline
import numpy as np
from brute import components, repeats, shingles

from panelflow.llm.toxicity import score_toxicity


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def rows_of(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_every_stage_against_brute_force(spark, small, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "suffix_dedup", "packing"]
    before = rows_of(documents)
    frame = documents
    scores = {r["doc_id"]: r["predicted"] for r in score_toxicity(documents, spark.read.parquet(f"{small}/labels.parquet")).collect()}
    frame = stage("toxicity")(spark, frame, small)
    now = rows_of(frame)
    assert frame.columns == documents.columns and set(now) == {i for i in before if not scores[i]}

    before, frame = now, stage("exact_dedup")(spark, frame, small)
    now = rows_of(frame)
    groups = defaultdict(list)
    for i, r in before.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append((-len(r["text"] or ""), i))
    assert set(now) == {min(g)[1] for g in groups.values()} and frame.columns == documents.columns

    before, frame = now, stage("jaccard_join")(spark, frame, small)
    now, ids = rows_of(frame), sorted(before)
    labels = components([shingles(before[i]["text"]) for i in ids], ids)
    assert set(now) == {i for i, c in zip(ids, labels) if i == c} and frame.columns == documents.columns

    before, frame = now, stage("suffix_dedup")(spark, frame, small)
    now, ids = rows_of(frame), sorted(before)
    bodies = [(i, (before[i]["text"] or "").encode()) for i in ids]
    for (i, body), gone in zip(bodies, repeats(bodies)):
        left = np.frombuffer(body, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        if gone.any() and not left.strip(" \t\n\x0b\x0c\r"):
            assert i not in now
        else:
            assert now[i]["text"] == left and (now[i]["lang"], now[i]["source"]) == (before[i]["lang"], before[i]["source"])
            assert now[i]["n_chars"] == (len(left) if gone.any() else before[i]["n_chars"])
    assert frame.columns == documents.columns

    packed = stage("packing")(spark, frame, small).collect()
    size = defaultdict(int)
    for r in packed:
        size[r["doc_id"]] += r["n_tokens"]
    assert size == {i: len((r["text"] or "").encode()) for i, r in now.items()}
    whole = corpus_pipeline.run(spark, small).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, packed))


def test_awkward_rows_and_empty_tables(spark, small, awkward, nothing):
    for docs in (awkward.selectExpr("doc_id", "text", "source", "label as lang", "cast(length(text) as long) n_chars"), nothing.selectExpr("doc_id", "text", "source", "label as lang", "cast(0 as long) n_chars")):
        frame = docs
        for name, step in corpus_pipeline.STAGES[:-1]:
            after = step(spark, frame, small)
            assert after.columns == docs.columns, name
            frame = after
        corpus_pipeline.STAGES[-1][1](spark, frame, small).collect()
        if docs.count():
            assert frame.filter("doc_id is null").count() == 1  # the other row's bytes all stand in documents with ids
            assert frame.filter("doc_id = 4 or doc_id = 6").count() == 2
