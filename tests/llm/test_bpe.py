from __future__ import annotations

from collections import Counter

import public_tokenizers
import pytest
from brute import sha
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from panelflow.llm.bpe import Codec, chunk_ends, encode_decode
from panelflow.llm.queries import QUERIES, TOKENIZER

import numpy as np

PATH = public_tokenizers.path(TOKENIZER)


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def expected(plain, text):
    ids = plain.encode(text or "", add_special_tokens=False).ids
    return ids, plain.decode(ids, skip_special_tokens=False)


def test_whole_table(spark, small, documents, plain):
    got = {r["doc_id"]: r for r in QUERIES["op2_bpe"](spark, small).collect()}
    rows = documents.collect()
    assert len(got) == len(rows)
    for row in rows:
        ids, text = expected(plain, row["text"])
        r = got[row["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(text))


def test_awkward_rows(awkward, nothing, plain):
    got = Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in encode_decode(awkward, PATH).collect())
    want = Counter()
    for r in awkward.collect():
        ids, text = expected(plain, r["text"])
        want[(r["doc_id"], tuple(ids), text)] += 1
    assert got == want
    assert encode_decode(nothing, PATH).collect() == []


@pytest.fixture(scope="module")
def codec():
    return Codec(PATH, keep=50)


pieces = st.sampled_from(["don't", "It's", " ", "  ", "\n", "\t", "<|endoftext|>", "<|startoftext|>", "İstanbul", "ΟΔΟΣ", "é", "é", "́", "ß", "ﬁ", "１２", "½", "漢字", " ", " ", "'s", "'S", "A1b2", "…", "\U0001f600", "a" * 40, "--==", "Ǆ", "\x00", "\x85", "‍"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(pieces, st.text(max_size=6)), max_size=14))
def test_any_text(codec, plain, parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    raw = text.encode()
    cuts = chunk_ends(np.frombuffer(raw, np.uint8), 2)
    ids = np.frombuffer(codec.encode(raw, [*cuts[cuts < len(raw)].tolist(), len(raw)]), np.int32).tolist()
    assert ids == expected(plain, text)[0]


def test_chunks_are_encoded_once(monkeypatch):
    import public_tokenizers

    codec = Codec(public_tokenizers.path("word_bpe_49k.json"))
    calls = []
    own = codec.chunk
    monkeypatch.setattr(codec, "chunk", lambda raw: calls.append(raw) or own(raw))
    raw = b"once upon a time "
    for _ in range(3):
        codec.encode(raw, [5, 10, 12, len(raw)])
    assert len(calls) == 4


def test_cuts_depend_on_content_alone():
    body = np.frombuffer(b"many words make one stretch of text that is cut the same way wherever it stands " * 4, np.uint8)
    for offset in (1, 7, 64):
        moved = np.concatenate([np.full(offset, 120, np.uint8), body])
        inner = chunk_ends(moved) - offset
        assert set(chunk_ends(body).tolist()) - set(range(6)) == set(inner[inner > 5].tolist())
