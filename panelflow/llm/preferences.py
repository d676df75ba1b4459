"""Paired preference examples from chosen and rejected conversations, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, END = "<|im_start|>", "<|im_end|>\n"


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(END))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: turn_text(t["role"], t["text"])), "")


def _mask(turns: Column, role: str) -> Column:
    """"start:end" code-point offsets, within the rendered turns, of what carries loss.

    That is the text and the end mark of each turn of ``role``; everything else is masked.
    """
    head = F.lit(len(OPEN) + 1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        begin = state["at"] + head + F.length(turn["role"])
        end = begin + F.length(turn["text"]) + F.lit(len(END))
        span = F.concat_ws(":", begin.cast("string"), end.cast("string"))
        spans = F.when(turn["role"] == role, F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.array_join(F.aggregate(turns, start, step)["spans"], ",")


def format_preferences(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per pair: pair_id, prefix_turns, prompt, chosen, rejected, chosen_loss, rejected_loss.

    ``turns`` has pair_id, is_chosen, turn, role, text.  The turns that both sides begin with are
    rendered once, as the prompt; the completions are what each side has after them, with the
    spans that carry loss.  Turns are ordered by (turn, role, text), so ties and repeated rows have
    a defined place; a null role or text counts as empty and a null turn comes first.  A side without turns is empty; rows
    without a pair_id are one pair of their own.  The unit of work is a pair: both its
    conversations are one row of the result, so they are gathered in one task, and no key larger
    than a pair is ever gathered.
    """
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    sides = turns.groupBy("pair_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("is_chosen"), turn))).alias("c"),
        F.sort_array(F.collect_list(F.when(~F.col("is_chosen"), turn))).alias("r"),
    )
    same = lambda i: (F.get("c", i)["role"] == F.get("r", i)["role"]) & (F.get("c", i)["text"] == F.get("r", i)["text"])
    shorter = F.least(F.size("c"), F.size("r"))
    differing = F.filter(F.sequence(F.lit(0), shorter), lambda i: ~F.coalesce(same(i), F.lit(False)))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    cut = sides.withColumn("n", F.array_min(differing)).select(
        "pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r")
    )
    return cut.select(
        "pair_id",
        F.col("n").alias("prefix_turns"),
        _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"),
        _rendered(F.col("r")).alias("rejected"),
        _mask(F.col("c"), learn).alias("chosen_loss"),
        _mask(F.col("r"), learn).alias("rejected_loss"),
    )


def final_turn_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs out of plain conversations: ids 2k and 2k + 1 make pair k.

    Chosen is the even conversation.  Rejected is the same one with its last turn put in place by
    the last turn of the odd one.  A missing even conversation leaves an empty chosen side, a missing odd
    one leaves the rejected side without an ending.  Turns are ordered by (turn, role, text); repeated ones all
    count.  Rows without a conv_id belong to no conversation that could be paired, and are in no pair.  Other columns play no
    part; texts may be of any length, as long as a pair fits one row.  Without rows there are no pairs.
    """
    base = conversations.select(
        F.floor(F.col("conv_id") / 2).alias("pair_id"), (F.col("conv_id") % 2 == 0).alias("even"), "turn", "role", "text"
    )
    key = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    both = base.groupBy("pair_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("even"), key))).alias("a"),
        F.sort_array(F.collect_list(F.when(~F.col("even"), key))).alias("b"),
    )
    stem = F.slice("a", F.lit(1), F.greatest(F.size("a") - 1, F.lit(0)))
    tail = F.slice("b", F.greatest(F.size("b"), F.lit(1)), F.lit(1))
    sides = both.select(
        "pair_id",
        F.explode(
            F.concat(
                F.transform("a", lambda t, i: F.struct(F.lit(True).alias("is_chosen"), i.alias("at"), t.alias("t"))),
                F.transform(F.concat(stem, tail), lambda t, i: F.struct(F.lit(False).alias("is_chosen"), i.alias("at"), t.alias("t"))),
            )
        ).alias("x"),
    )
    return sides.select("pair_id", "x.is_chosen", F.col("x.at").alias("turn"), "x.t.role", "x.t.text")
