from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelflow.llm import attention, lm_scoring as lm
from panelflow.llm.texts import word_hashes


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def held(i, n=7):
    return i is not None and zlib.crc32(str(i).encode()) % n == 2


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\n"]


def base_of(rows):
    counts = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    size = math.log10(counts.total() + len(counts) + 1)
    return counts, lambda text: sum(math.log10(counts[t] + 1) - size for t in tokens(text))


def apart():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def test_awkward_rows(awkward, path):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    counts, base = base_of(rows)
    got = lm.score_texts(awkward, path, apart(), learn_one_in=2).collect()
    want = Counter((i, held(i), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), counts.total(), round(base(t), 6)) for i, t in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(-math.inf < r["score"] < 0 for r in got)
    same = [r["score"] for r in got if r["n_tokens"] == 1]
    assert max(same) - min(same) < 1e-4


def test_empty_tables_and_no_training_rows(nothing, awkward, path):
    assert lm.score_texts(nothing, path, apart()).collect() == []
    got = lm.score_texts(awkward, path, F.lit(True)).collect()
    assert all(r["base_score"] == 0 and r["train_tokens"] == 0 and r["n_known"] == 0 and r["held_out"] for r in got)
    assert all(math.isfinite(r["score"]) for r in got)


def test_held_out_texts_are_likelier_than_by_the_base(documents, path):
    got = lm.score_texts(documents, path, apart(), learn_one_in=1, rounds=2).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert got[2] > 10 and got[0] > got[1]


def test_every_id_of_every_training_text_is_learned_once(documents, awkward, path):
    packed = ("held_out", "ends", "stream", "hashes", "trained", "sizes", "ids", "lessons")
    schema = pa.schema([("run", pa.int64()), ("words", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in packed]])
    kinds = f"run long, words long, doc_ids array<long>, {', '.join(f'{c} binary' for c in packed)}"
    for table in (documents, awkward):
        plain = table.select("doc_id", "text", F.coalesce(apart(), F.lit(False)).alias("held_out"))
        learned, there = np.zeros(lm.PAD, np.int64), np.zeros(lm.PAD, np.int64)
        for r in plain.mapInArrow(lm._tokenise(path, lm.LEARN_ONE_IN, schema), kinds).collect():
            targets = lm.unpack(r["lessons"], "u2").reshape(-1, attention.WINDOW + 1)[:, 1:]
            learned += np.bincount(targets[targets != lm.PAD], minlength=lm.PAD)
            there += np.bincount(lm.unpack(r["ids"], "u2"), weights=np.repeat(lm.unpack(r["trained"], "u4"), lm.unpack(r["sizes"], "u4")), minlength=lm.PAD).astype(np.int64)
        assert there.sum() > 1_000 and (learned == there).all()


def plain_shares(p, ids):
    """Class shares after each prefix of one window, in double precision, position by position."""
    q = {k: v.astype(np.float64) for k, v in p.items()}
    x = q["embed"][ids] + q["place"][: len(ids)]
    w = attention.WIDTH
    out = []
    for t in range(len(ids)):
        mixed = x[: t + 1] @ q["mix"]
        query, keys, values, own = mixed[t, :w], mixed[:, w : 2 * w], mixed[:, 2 * w : 3 * w], mixed[t, 3 * w :]
        attend = np.exp(keys @ query / np.sqrt(w))
        hidden = np.maximum(0, (attend / attend.sum()) @ values @ q["back"] + own + q["lift"])
        logits = hidden @ q["out"][:-1] + q["out"][-1]
        out.append(logits - np.log(np.exp(logits).sum()))
    return np.array(out) / np.log(10)


def some_model(classes=9):
    draw = np.random.default_rng(5)
    model = lm.Model.of({3: 50, 4: 20, 5: 9, 6: 4, 2: 7}, 40, classes)
    for name, values in model.params.items():
        model.params[name] = (values + draw.normal(0, 0.4, values.shape)).astype(np.float32)
    return model


@pytest.mark.parametrize("lengths", [[1], [31, 32, 33], [5, 24, 56, 57, 200], [1, 1, 400]])
def test_windows_score_each_id_once_as_an_unbatched_pass_does(lengths):
    model, draw = some_model(), np.random.default_rng(1)
    texts = [draw.integers(2, 40, n) for n in lengths]
    run = lm.lay_out(np.arange(sum(lengths)), np.cumsum(lengths), np.ones(sum(lengths), np.int64), np.concatenate(texts).astype(np.uint16))
    got = np.split(lm.log10_attention(model, run), np.cumsum(lengths)[:-1])
    step = attention.WINDOW - attention.OVERLAP
    for text, scores in zip(texts, got):
        assert len(scores) == len(text)
        given = np.concatenate([[lm.BEGIN], text[:-1]])
        for k in range(len(text)):
            number = 0 if k < attention.WINDOW else 1 + (k - attention.WINDOW) // step
            first = min(number * step, max(0, len(text) - attention.WINDOW))
            assert k == first + (k - first) and (k - first >= attention.OVERLAP or first == 0)
            shares = plain_shares(model.params, model.row_of[given[first : k + 1]])[-1]
            assert abs(shares[model.class_of[text[k]]] + model.within[text[k]] - scores[k]) < 1e-3


def test_shares_of_all_ids_add_up_to_one():
    model = some_model()
    ids = np.arange(40)
    shares = plain_shares(model.params, model.row_of[[lm.BEGIN, 3, 4]])[-1]
    assert abs((10 ** (shares[model.class_of[ids]] + model.within[ids])).sum() - 1) < 1e-9


def test_gradients_are_those_of_the_loss():
    p, draw = attention.fresh(20, 8), np.random.default_rng(2)
    given, wanted, real = draw.integers(0, 20, (3, 32)), draw.integers(0, 8, (3, 32)), draw.random((3, 32)) < 0.7
    _, grads, rows = attention.gradients(p, given, wanted, real)
    for name, grad in grads.items():
        for _ in range(4):
            at = tuple(draw.integers(0, n) for n in grad.shape)
            spot = (rows[at[0]], *at[1:]) if name == "embed" else at
            old, ends = p[name][spot], []
            for move in (0.01, -0.01):
                p[name][spot] = old + move
                ends.append(attention.gradients(p, given, wanted, real)[0])
            p[name][spot] = old
            assert abs((ends[0] - ends[1]) / 0.02 - grad[at]) < 2e-3


def test_learning_lowers_the_loss():
    draw = np.random.default_rng(3)
    ids = np.cumsum(draw.integers(1, 3, (600, 33)), axis=1) % 12
    learner = attention.Learner(attention.fresh(12, 12))
    real = np.ones((600, 32), bool)
    before = attention.gradients(learner.params, ids[:50, :-1], ids[:50, 1:], real[:50])[0]
    learner.learn(ids[:, :-1], ids[:, 1:], real)
    assert attention.gradients(learner.params, ids[:50, :-1], ids[:50, 1:], real[:50])[0] < before - 0.8


def test_positions_of_context_alone_are_not_worked_out(monkeypatch):
    model, draw, rows = some_model(), np.random.default_rng(4), []
    whole = attention.forward
    monkeypatch.setattr(attention, "forward", lambda *a: rows.append(len((done := whole(*a)).hidden)) or done)
    ids = draw.integers(2, 40, 320).astype(np.uint16)
    run = lm.lay_out(np.arange(320), np.array([320]), np.ones(320, np.int64), ids)
    windows = len(attention.starts_of(run.lengths)[0])
    got = lm.log10_attention(model, run)
    assert len(got) == 320 and sum(rows) == 32 + (windows - 1) * (attention.WINDOW - attention.OVERLAP)
    given, wanted = draw.integers(0, 9, (5, 32)), draw.integers(0, 9, (5, 32))
    scored = draw.random((5, 32)) < 0.8
    scored[:, :8] = False
    assert np.allclose(attention.log_shares(model.params, given, wanted, scored), attention.log_shares(model.params, given, wanted, scored, skip=8), atol=1e-5)


def test_values_beyond_the_range_of_exp_are_moved_down():
    model, draw = some_model(), np.random.default_rng(6)
    for name, by in (("out", 16), ("mix", 6)):
        p = {k: v * np.float32(by if k == name else 1) for k, v in model.params.items()}
        given, wanted = draw.integers(0, 6, (7, 32)), draw.integers(0, 9, (7, 32))
        got = attention.log_shares(p, given, wanted, np.ones((7, 32), bool)).reshape(7, 32)
        want = np.stack([plain_shares(p, g)[np.arange(32), w] for g, w in zip(given, wanted)])
        near = want > -25  # shares below 1e-30 count as that
        assert near.sum() > 50 and np.isfinite(got).all() and np.allclose(got[near], want[near], rtol=1e-2, atol=1e-2)


def test_learning_takes_the_steps_of_adam():
    draw = np.random.default_rng(8)
    given, wanted, real = draw.integers(0, 30, (70, 32)), draw.integers(0, 8, (70, 32)), draw.random((70, 32)) < 0.9
    p = attention.fresh(30, 8)
    learner = attention.Learner(p)
    learner.learn(given, wanted, real)
    mean, square = ({k: np.zeros(v.shape) for k, v in p.items()} for _ in range(2))
    for step, k in enumerate(range(0, 70, learner.size), 1):
        _, grads, rows = attention.gradients(p, *(x[k : k + learner.size] for x in (given, wanted, real)))
        for name, g in grads.items():
            at = rows if name == "embed" else slice(None)
            mean[name][at] = 0.9 * mean[name][at] + 0.1 * g
            square[name][at] = 0.99 * square[name][at] + 0.01 * g * g
            scale = learner.rate * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
            p[name][at] -= (scale * mean[name][at] / (np.sqrt(square[name][at]) + 1e-8)).astype(np.float32)
    assert learner.windows == 70 and set(learner.params) == set(p)
    for name, values in learner.params.items():
        assert (np.abs(values - p[name]) < 2e-3).mean() > 0.99  # a gradient that is all rounding may point either way


@pytest.mark.parametrize("values", [[], [5], [7, 7, 7], [3, 1, 3, 2, 1, 2**64 - 1, 0]])
def test_distinct_values_and_their_places(values):
    values = np.array(values, np.uint64)
    found, places, back = lm.distinct(values)
    assert (found == np.unique(values)).all() and (values[places] == found).all() and (found[back] == values).all()


def test_words_that_sums_of_powers_confuse_have_different_hashes():
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    raw = f"{word} {word.translate(str.maketrans('ab', 'ba'))} {word[:600]} {word[:600]} x{'y' * 8} x{'y' * 9}".encode()
    hashes, rows = word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert len(hashes) == 6 and len(set(hashes.tolist())) == 5 and hashes[2] == hashes[3]


def test_packing_round_trip():
    for values in (np.zeros(0, np.uint32), np.arange(1000, dtype=np.uint32)):
        assert (lm.unpack(lm.pack(values), "u4") == values).all()
    assert lm.ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
