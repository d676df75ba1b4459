"""What each of several filters removes, in every order in which they could run.

A document fails a set of filters, its mask.  In a given order it is removed at the step of the first filter
of the mask.  Orders are numbered lexicographically by their Lehmer rank, so all orders that begin alike
are one interval of ranks: those in which filters that pass come first and then one that fails.
Counts per mask are added where such an interval begins and taken off where it ends; running sums over
the ranks then are the removals of every order.  The table of intervals depends on the number of
filters alone, and the documents are read once, whatever the number of orders.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, Window, functions as F

from panelflow.operators.sized import written

NAMES = "ABCDE"
SUMS = ("n", "good", "toxic")


def removal_intervals(filters: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, begin, end): documents with this mask are removed at this step in orders begin to end - 1."""
    found: list[tuple[int, int, int, int]] = []

    def walk(mask: int, left: list[int], rank: int, step: int) -> None:
        size = factorial(len(left) - 1) if left else 0
        for digit, f in enumerate(left):
            begin = rank + digit * size
            if mask >> f & 1:
                if found and found[-1][:2] == (mask, step) and found[-1][3] == begin:
                    found[-1] = (mask, step, found[-1][2], begin + size)
                else:
                    found.append((mask, step, begin, begin + size))
            else:
                walk(mask, left[:digit] + left[digit + 1 :], begin, step + 1)

    for mask in range(1, 1 << filters):
        walk(mask, list(range(filters)), 0, 1)
    return found


def interaction_audit(masks: DataFrame, names: str = NAMES) -> DataFrame:
    """One row per part, order of the filters and step, from rows (part, mask, n, good, toxic).

    Bit k of ``mask`` says that filter ``names[k]`` fails; ``names`` are distinct letters in ascending
    order, at most seven.  ``n``, ``good`` and ``toxic`` are counts and may be spread over any number of rows.
    Columns: part, filter_order, step int, and the counts kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (the filter's removals summed over all orders), zeros included.
    Rows are summed per part and mask before anything else, so a hot part costs nothing; from then on
    a part is at most 2^k rows, and k! in its window.  Other columns play no part; without rows there is no result.
    """
    spark, k = masks.sparkSession, len(names)
    if not 0 < k <= 7 or list(names) != sorted(set(names)):
        raise ValueError("names must be one to seven distinct letters in ascending order")
    orders, steps = factorial(k), range(1, k + 1)
    counts = written(masks.groupBy("part", "mask").agg(*[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in SUMS]))

    intervals = spark.createDataFrame(removal_intervals(k), "mask int, step int, begin int, end int")
    ends = (
        counts.join(F.broadcast(intervals), "mask")  # k alone bounds the intervals: 840 before adjacent ones are joined, for k = 5
        .withColumn("at", F.explode(F.array(F.struct(F.col("begin").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("end").alias("rank"), F.lit(-1).alias("sign")))))
        .select("part", F.col("at.rank").alias("rank"), "step", *[(F.col(c) * F.col("at.sign")).alias(c) for c in SUMS])
        .filter(F.col("rank") < orders)
    )
    zeros = counts.select("part").distinct().select(
        "part", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("rank"), F.lit(0).alias("step"), *[F.lit(0).cast("long").alias(c) for c in SUMS]
    )
    changes = ends.unionByName(zeros).groupBy("part", "rank").agg(
        *[F.sum(F.when(F.col("step") == s, F.col(c)).otherwise(0)).alias(f"{c}{s}") for c in SUMS for s in steps]
    )
    up_to = Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    removals = changes.select(
        "part",
        F.split(F.lit(" ".join("".join(p) for p in permutations(names))), " ")[F.col("rank")].alias("filter_order"),
        *[F.array(*[F.sum(f"{c}{s}").over(up_to) for s in steps]).alias(c) for c in SUMS],
    )
    whole = Window.partitionBy("part")
    removals = removals.withColumn("by_filter", F.array(*[F.sum(F.element_at("n", F.instr("filter_order", f))).over(whole) for f in names]))
    failing = [F.col("mask").bitwiseAND(1 << f) != 0 for f in range(k)]
    totals = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.array(*[F.sum(F.when(fails, F.col("n")).otherwise(0)) for fails in failing]).alias("fails"),
        F.array(*[F.sum(F.when(F.col("mask") == 1 << f, F.col("n")).otherwise(0)) for f in range(k)]).alias("alone"),
    )
    rows = removals.join(totals, "part").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    this = F.instr(F.lit(names), F.substring("filter_order", F.col("step"), F.lit(1)))
    removed = F.element_at("n", F.col("step"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.aggregate(F.slice("n", F.lit(1), F.col("step")), F.lit(0).cast("long"), lambda a, x: a + x)).alias("kept"),
        removed.alias("removed"),
        (F.element_at("fails", this) - removed).alias("redundant"),
        F.element_at("alone", this).alias("unique_fails"),
        F.element_at("good", F.col("step")).alias("good_lost"),
        F.element_at("toxic", F.col("step")).alias("toxic_lost"),
        F.element_at("by_filter", this).alias("shapley"),
    )


def failure_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Rows (part, mask, n, good, toxic) of documents, for the five filters ``ABCDE``.

    A: under 50 words; B: fewer than 65 distinct words in 100; C: more than 5 capitals A-Z in 100
    characters; D: one of ``#$%&*|``; E: the text of a smaller id, anywhere in the table.  Null texts
    count as empty (they fail A, and E beside a smaller id whose text is empty), null parts as ''.  Rows that share an id and a text
    are no copies of each other; a null id has no smaller one and is none.  A document is good or
    toxic if any label of its id says so.  Whole texts are read, of any length; other columns play no part.

    Texts are known by their SHA-256.  The smallest id of each is joined back on (id, digest), so the
    copies of one text spread over all tasks.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    thin = written(
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"))
    )
    first = thin.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col(id_col).alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return thin.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left").select(
        "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"), F.lit(1).alias("n"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    )
