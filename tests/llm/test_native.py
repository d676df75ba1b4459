from __future__ import annotations

from collections import Counter

import pytest
from oracle import compare, connect

from panelflow.llm.preferences import final_turn_pairs, format_preferences
from panelflow.llm.queries import ORACLES, QUERIES
from panelflow.llm.sharding import SHARDS, fill, place


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    assert compare(QUERIES[name](spark, small), connect(small), ORACLES[name]) is None


@pytest.mark.parametrize("name", ["op5_preference_formatting", "op7_sharding"])
def test_no_python_in_native_plans(spark, small, plan, name):
    text = plan(QUERIES[name](spark, small))
    assert not any(word in text for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_shares_are_even_and_growth_moves_little():
    before, after = fill(SHARDS), fill([*SHARDS, "new"])
    counts = Counter(before)
    assert max(counts.values()) - min(counts.values()) <= 1
    moved = sum(a != b and b != len(SHARDS) for a, b in zip(before, after))
    assert moved < 0.1 * len(before)
    with pytest.raises(ValueError):
        fill(["a", "a"])
    with pytest.raises(ValueError):
        fill(["a"], 100)


def test_place_awkward_rows(awkward, nothing):
    got = place(awkward).collect()
    assert len(got) == awkward.count()
    assert len({r["shard"] for r in got if r["doc_id"] == 10}) == 1 and len({r["shard"] for r in got if r["doc_id"] is None}) == 1
    assert place(nothing).collect() == []


def test_preferences_by_hand(spark):
    rows = [
        (1, True, 0, "user", "q"), (1, True, 1, "assistant", "good"), (1, False, 0, "user", "q"), (1, False, 1, "assistant", "bäd"),
        (2, True, 0, "user", None), (2, False, 0, None, None),
        (3, True, 0, "user", "only"),
        (4, True, 0, "user", "x"), (4, False, 0, "user", "x"),
        (5, True, 1, "user", "tie"), (5, True, 1, "assistant", "tie"), (5, False, None, "user", ""),
        (None, True, 0, "user", "n"),
    ]
    turns = spark.createDataFrame([(*r, 1, "z") for r in rows], "pair_id long, is_chosen boolean, turn long, role string, text string, n int, p string")
    got = {r["pair_id"]: r for r in format_preferences(turns).collect()}
    say = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert tuple(got[1])[1:] == (1, say("user", "q"), say("assistant", "good"), say("assistant", "bäd"), "22:37", "22:36")
    assert "22:37" == f"{len('<|im_start|>assistant') + 1}:{len(say('assistant', 'good'))}"
    assert tuple(got[2])[1:] == (0, "", say("user", ""), say("", ""), "", "")
    assert tuple(got[3])[1:] == (0, "", say("user", "only"), "", "", "")
    assert tuple(got[4])[1:] == (1, say("user", "x"), "", "", "", "")
    assert got[5]["chosen"] == say("assistant", "tie") + say("user", "tie") and got[5]["chosen_loss"] == "22:36"
    assert got[None]["chosen"] == say("user", "n")
    assert format_preferences(turns.limit(0)).collect() == []


def test_turns_without_a_conversation_are_in_no_pair(spark):
    rows = [(None, 0, "user", "lost"), (4, 0, "user", "q"), (4, 1, "assistant", "a"), (5, 0, "user", "x"), (5, 0, "user", "x"), (5, 7, None, None)]
    turns = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, pair_id string, at int")
    [pair] = format_preferences(final_turn_pairs(turns)).collect()
    assert (pair["pair_id"], pair["prefix_turns"]) == (2, 1) and "lost" not in pair["prompt"] + pair["chosen"] + pair["rejected"]
    assert format_preferences(final_turn_pairs(turns.limit(0))).collect() == []
