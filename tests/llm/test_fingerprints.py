from __future__ import annotations

from collections import Counter

import numpy as np
from brute import sha

from panelflow.llm.fingerprints import band_of_lexicon, edited, fingerprint, fingerprint_documents, likeness
from panelflow.llm.queries import QUERIES
from panelflow.llm.texts import word_hashes


def check(rows, got):
    rows = sorted(rows)
    got = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    prints: dict[str, str] = {}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        r, n = got[i], len(text)
        changed = text[: n - n // 4] + after[: n // 4]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha(changed))
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert prints.setdefault(changed, r["edited_fingerprint"]) == r["edited_fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        as_array = lambda h: np.frombuffer(bytes.fromhex(h), np.uint16).reshape(16, -1)
        assert r["near_edited"] == likeness(as_array(r["fingerprint"]), as_array(r["edited_fingerprint"]))
    for (i, text), (j, _) in zip(rows, rows[1:] + rows[:1]):
        assert got[i]["near_next"] == likeness(as_array(got[i]["fingerprint"]), as_array(got[j]["fingerprint"]))


def test_whole_table(spark, small, documents):
    got = QUERIES["op3_fingerprints"](spark, small).collect()
    check([(r["doc_id"], r["text"] or "") for r in documents.collect()], got)
    near = np.mean([r["near_edited"] for r in got]), np.mean([r["near_next"] for r in got])
    assert near[0] > 0.4 and near[1] < 0.15


def test_awkward_rows(awkward, nothing, spark):
    rows = awkward.select("doc_id", "text", "label", "row").dropDuplicates(["doc_id"]).filter("doc_id is not null")
    check([(r["doc_id"], r["text"] or "") for r in rows.collect()], fingerprint_documents(rows).collect())
    assert fingerprint_documents(awkward).count() == awkward.count()
    assert fingerprint_documents(nothing).collect() == []
    one = fingerprint_documents(spark.createDataFrame([(5, "just one text of some words")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == sha(edited("just one text of some words", "just one text of some words"))


def test_band_and_fingerprints_with_many_more_terms_than_slots(spark):
    """1.6 million terms of one document each are out of the band, however many there are; 2**20 slots would let them in."""
    n, own = 400, 4_000
    texts = [" ".join([f"mid{i % 20}a", f"mid{i % 25}b", "every", *(f"rare{i}x{k}" for k in range(own))]) for i in range(n)]
    texts[7] = texts[7].replace("rare7x0 ", "typo7 ")
    rows = list(enumerate(texts)) + [(n, "mid7a mid7b every unlike words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = lambda text: [*word_hashes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))][0]
    df = Counter(w for _, text in rows for w in set(text.split()))
    low, high = len(rows) ** 0.15, len(rows) ** 0.88
    want = sorted({w for w, c in df.items() if low <= c <= high})
    inside, documents = band_of_lexicon(docs)
    assert documents == len(rows) and inside.tolist() == sorted(int(hashes(w)[0]) for w in want)
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint_documents(docs).collect()}
    for i, text in [rows[7], rows[8], rows[107], rows[n]]:
        kept = " ".join(sorted(set(text.split()) & set(want)))
        alone = fingerprint(hashes(kept), np.sort(hashes(kept)))
        assert got[i] == alone.tobytes().hex()
    assert got[7] == got[107] == got[n] and got[7] != got[8]
