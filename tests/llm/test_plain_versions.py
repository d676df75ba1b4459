"""Packing, fingerprints and votes against plain versions that share no code with the operators."""

from __future__ import annotations

import glob
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from panelflow.llm.fingerprints import BAND, DRAWS, RATES, fingerprint_documents
from panelflow.llm.packing import pack
from panelflow.llm.toxicity import score_toxicity
from panelflow.llm.warc import capture_history
from panelflow.operators.sized import scratch, shared_folder

FULL = (1 << 64) - 1


def packed(sizes, permitted):
    """Bins as lists of sizes, with their capacity: best fit by looking at every open bin."""
    cost = lambda c: c + 64 + c * c / 65_536
    best = None
    for top in sorted(permitted):
        if sizes and top < sizes[0]:
            continue
        bins = []  # [opened as, contents]
        for k, size in enumerate(sizes):
            fits = [(room - sum(held) - size, n) for n, (room, held) in enumerate(bins) if room - sum(held) >= size and room > sum(held)]
            if fits:
                bins[min(fits)[1]][1].append(size)
            else:
                left = sum(sizes[k:])
                room = min((c for c in permitted if size <= c <= top), key=lambda c: (cost(c) / max(1, min(c, left)), c))
                bins.append([room, [size]])
        final = [(min(c for c in permitted if c >= sum(held)), sorted(held)) for _, held in bins]
        total = sum(cost(c) for c, _ in final)
        if best is None or total < best[0]:
            best = total, final
    return Counter((c, tuple(held)) for c, held in best[1])


@pytest.mark.parametrize("permitted", [(8, 16, 64), (10,), (5, 7, 100)])
def test_packing_equals_the_plain_one(spark, permitted):
    lengths = [int(7 * math.sin(k) ** 2 * (k % 9)) + k % 3 for k in range(120)] + [3 * max(permitted) + 2]
    docs = spark.createDataFrame([(k if k % 10 else None, n) for k, n in enumerate(lengths)], "doc_id long, n int")
    rows = pack(docs, F.col("n"), capacities=permitted).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin_id"], r["capacity"]].append(r["n_tokens"])
    pieces = sorted((p for n in lengths for p in [max(permitted)] * ((max(n, 1) - 1) // max(permitted)) + [n - (max(n, 1) - 1) // max(permitted) * max(permitted)]), reverse=True)
    assert Counter((c, tuple(sorted(held))) for (_, c), held in bins.items()) == packed(pieces, permitted)


def mix(x):
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        x = (x ^ x >> shift) * factor & FULL
    return x


def word_hash(word):
    out = mix((len(word) * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & FULL)
    for k in range(0, len(word), 8):
        out = mix(out ^ mix((int.from_bytes(word[k : k + 8], "little") + 0xD6E8FEB86659FD93) & FULL))
    return out


def terms(text):
    return {word_hash(re.sub(b"[A-Z]", lambda m: m[0].lower(), w)) for w in text.encode().split()}


def prints(found, band):
    kept = found & band or found
    out = []
    for d in range(DRAWS):
        draws = [mix(t ^ mix(101 + d)) for t in kept]
        row = []
        for rate in RATES:
            some = [x for x in draws if x < int(rate * 2.0**64)]
            row.append(mix((sum(mix((x + 1) & FULL) for x in some) + len(some)) & FULL) % 65535 + 1 if some else 0)
        out.append(row)
    return out


def likeness(a, b):
    columns = [[(x, y) for x, y in zip(p, q) if x or y] for p, q in zip(zip(*a), zip(*b))]
    if not any(columns):
        return 1.0
    same = lambda c: sum(x == y for x, y in c)
    use = [c for c in columns if 2 * len(c) >= DRAWS]
    return max(same(c) / len(c) for c in use) if use else sum(map(same, columns)) / sum(map(len, columns))


def test_fingerprints_equal_the_plain_ones(spark):
    words = [f"w{k}" for k in range(400)] + ["The", "the", "x" * 30, "été"]
    texts = [" ".join(words[(k * k + j * (3 + k % 5)) % len(words)] for j in range(5 + 13 * k % 90)) for k in range(60)] + [None, "", " \n", "the the"]
    docs = spark.createDataFrame([(3 * k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, fingerprint string").repartition(4)
    texts = [t or "" for t in texts]
    df = Counter(t for text in texts for t in terms(text))
    least, most = len(texts) ** (1 - BAND[1]), len(texts) ** (1 - BAND[0])
    band = {t for t, n in df.items() if least <= n <= most}
    own = [prints(terms(t), band) for t in texts]
    hexed = lambda p: "".join(f"{v & 255:02x}{v >> 8:02x}" for row in p for v in row)
    got = {r["doc_id"]: r for r in fingerprint_documents(docs).collect()}
    for k, text in enumerate(texts):
        following = texts[(k + 1) % len(texts)]
        quarter = len(text) // 4
        changed = text[: len(text) - quarter] + following[:quarter] if quarter else text
        other = prints(terms(changed), band)
        row = got[3 * k]
        assert (row["fingerprint"], row["edited_fingerprint"]) == (hexed(own[k]), hexed(other))
        assert abs(row["near_edited"] - likeness(own[k], other)) < 1e-12 and abs(row["near_next"] - likeness(own[k], own[(k + 1) % len(texts)])) < 1e-12


def test_votes_and_scores_follow_from_the_neighbours(spark, documents, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    seen = []
    for r in score_toxicity(documents, labels).collect():
        if r["neighbours"]:
            near = [1 / (1.02 - min(s, 1)) for s in r["similarities"]]
            seen.append((sum(w * toxic[i] for w, i in zip(near, r["neighbours"])) / sum(near), r["score"]))
            assert r["similarities"] == sorted(r["similarities"], reverse=True) and len(r["neighbours"]) <= 15
            assert r["predicted"] == (r["score"] >= 0.7)
    (v0, s0), (v1, s1) = min(seen), max(seen)
    log = lambda s: math.log(s / (1 - s))
    slope = (log(s1) - log(s0)) / (v1 - v0)
    assert slope > 0 and all(abs(log(s) - log(s0) - slope * (v - v0)) < 1e-6 for v, s in seen)


def test_nothing_stays_after_a_scope(spark):
    import corpus_pipeline

    root = shared_folder(spark).removeprefix("file:")
    left = lambda: {p for kind in ("warc", "pipeline", "table") for p in glob.glob(f"{root}/{kind}-*")}
    before = left()
    pages = spark.createDataFrame([(2**53 + 1, "http://a/x", "<p>"), (2**53 + 3, "http://a/y", "<p>"), (None, "http://a/z", "<q>"), (7, None, None)], "page_id long, url string, html string")
    with scratch(spark):
        got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in capture_history(pages).collect()}
        assert got == {2**53 + 1: ("revisit", 2**53 + 3), 2**53 + 3: ("response", None), None: ("response", None), 7: ("response", None)}
    assert left() == before
    with pytest.raises(Exception, match="PATH_NOT_FOUND"), scratch(spark):
        corpus_pipeline.run(spark, "/nowhere")
    assert left() == before
