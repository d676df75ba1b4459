from __future__ import annotations

import heapq
import re
import zlib

import pytest
from brute import sha
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from panelflow.llm.repair import CUT_OFF, MUST_GO, Plan, conversation_audit, damage, repair_turns

GOOD = re.compile(r"(s?(ua)+)?")
INITIALS = "uaso"


def cheapest(codes):
    """(cost, edits) by trying edit sequences in order of cost and letters, on strings of initials."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, edits, at, text = heapq.heappop(heap)
        if at == len(codes) and GOOD.fullmatch(text):
            return cost, edits
        state = (at, text if len(text) < 2 else ("s" if text[0] == "s" else "") + text[-1] + str(len(text)))
        if (state, edits) in seen or not re.fullmatch(r"s?(ua)*u?", text):
            continue
        seen.add((state, edits))
        for role in "ua":
            heapq.heappush(heap, (cost + 2, edits + "I", at, text + role))
        if at < len(codes):
            code = codes[at]
            more = 1 if code & CUT_OFF else 0
            heapq.heappush(heap, (cost + 3, edits + "D", at + 1, text))
            if not code & MUST_GO:
                heapq.heappush(heap, (cost + more, edits + "K", at + 1, text + INITIALS[code & 3]))
                for role in "ua":
                    heapq.heappush(heap, (cost + 2 + more, edits + "R", at + 1, text + role))


def edits_of(codes):
    plan = Plan(bytes(codes))
    found = [e for _ in codes for e in plan.turn()]
    found += plan.rest()
    return plan.cost, "".join(e[0] for e in found), found


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3).flatmap(lambda i: st.sampled_from([i, i, i, i | MUST_GO, i | CUT_OFF])), max_size=5))
def test_plans_are_cheapest_and_ascii_least(codes):
    cost, edits, found = edits_of(codes)
    assert (cost, edits) == cheapest(codes)
    assert sum(e[2] for e in found) == cost


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 0, 1, 2, 3, 4, 9, 8]), min_size=30, max_size=400))
def test_checkpoints_do_not_change_the_plan(codes):
    cost, edits, found = edits_of(codes)
    plan = Plan(bytes(codes))
    assert len(plan.checkpoints) <= 2 * len(codes) ** 0.5 + 3
    whole = Plan.__new__(Plan)
    Plan.__init__(whole, bytes(codes))
    whole.block = len(codes)
    whole._enter()
    assert [e for _ in codes for e in whole.turn()] + list(whole.rest()) == found
    assert cost == sum(e[2] for e in found)


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of the turns (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, codes, faults, lines = set(), [], [], []
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        initial = INITIALS.index(role[0]) if role[:1] and role[0] in "uas" else 3
        codes.append(initial | (MUST_GO if fault in ("blank", "duplicate") else 0) | (CUT_OFF if fault == "truncated" else 0))
    cost, audit = cheapest(codes)
    at = 0
    for edit in audit:
        role = "user" if not lines or not lines[-1].startswith("u") else "assistant"
        if edit == "I":
            lines.append(f"{role}:")
        else:
            if edit != "D":
                lines.append(f"{rows[at][1] if edit == 'K' else role}:{rows[at][2]}")
            at += 1
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(lines))


def damaged(conversations):
    out = {}
    for conv, turn, role, text in conversations:
        kept = out.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(name.encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        kept += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


ROWS = [
    (1, 0, "system", "Be nice."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes."), (1, 3, "user", "Go on."),
    (2, 0, "assistant", "First."), (2, 5, "assistant", "é!"), (2, 6, "tool", "x."), (2, 7, None, None),
    (3, None, "user", "no turn."), (3, None, "user", "no turn."), (3, 4, "", "no role"), (3, 4, "user", "same turn."), (3, 4, "user", "Same turn."),
    (None, 1, "user", "null conversation."), (None, 2, "assistant", "yes! \n"), (None, None, None, "x?"),
    (4, 2, "user", " \t\n"), (5, 2**53 + 1, "user", "large."), (5, 2**53 + 3, "assistant", "numbers."),
    (2**53 + 1, 0, "user", "large id."), (2**53 + 3, 0, "user", "another large id."), (6, 1, "system", "x" * 200_000 + "."), (6, 2, "system", "a."),
    *[(7, t, "user" if t % 3 else "assistant", f"turn {t % 50}.") for t in range(300)],
]


@pytest.fixture(scope="module")
def turns(spark):
    shape = "conv_id long, turn long, role string, text string, gone string, edit int, step string"
    return spark.createDataFrame([(*r, "g", 5, "s") for r in ROWS], shape).repartition(4)


def test_damaged_conversations_against_brute_force(turns):
    got = {r["conv_id"]: tuple(r)[1:] for r in conversation_audit(repair_turns(damage(turns), gone_col="gone")).collect()}
    want = damaged(ROWS)
    assert got.keys() == want.keys()
    for conv, rows in want.items():
        if len(rows) < 20:
            assert got[conv] == repaired(rows), conv


def test_repaired_turns_are_whole_conversations(turns):
    rows = repair_turns(turns).where("step >= 0").collect()
    for conv in {r["conv_id"] for r in rows}:
        own = sorted((r for r in rows if r["conv_id"] == conv), key=lambda r: r["step"])
        left = [r for r in own if r["edit"] != "D"]
        assert GOOD.fullmatch("".join(r["role"][0] for r in left)) and [r["step"] for r in own] == list(range(len(own)))
        assert sum(r["edit"] in "KRD" for r in own) == sum(c == conv for c, *_ in ROWS)
        assert all(r["text"] == "" and r["turn"] is None for r in own if r["edit"] == "I")


def test_conversations_of_which_nothing_is_left_and_empty_tables(turns, spark):
    gone = turns.withColumn("lost", F.lit(True))
    rows = conversation_audit(repair_turns(gone, gone_col="lost")).collect()
    assert len(rows) == len({r[0] for r in ROWS})
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", sha("")) for r in rows)
    assert conversation_audit(repair_turns(turns.limit(0))).collect() == []


def test_one_shuffle(spark, plan):
    plain = spark.createDataFrame(ROWS[:5], "conv_id long, turn long, role string, text string")
    shown = plan(conversation_audit(repair_turns(plain)))
    assert shown.split("== Physical Plan ==")[1].split("\n\n")[0].count("Exchange") == 1
