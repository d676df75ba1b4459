"""The paths taken when sides are too large to broadcast and keys are hot."""

from __future__ import annotations

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from panelflow.operators.reshape import keep_last, long_to_wide
from panelflow.operators.sheets import take_while
from panelflow.registry import ORACLES, QUERIES


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(
    "name",
    ["box_stats", "take_while", "skip_until_header", "assemble_pages", "panel_inner_join", "left_join_context",
     "merge_subdimensions", "ols_within_category", "histogram_40", "describe_columns"],
)
def test_shuffle_joins_give_the_same_rows(spark, small, no_broadcast, name):
    assert compare(QUERIES[name](spark, small), connect(small), ORACLES[name]) is None


def test_large_sides_are_not_broadcast(spark, small, no_broadcast, plan):
    text = plan(QUERIES["take_while"](spark, small))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def hot(spark, n=30_000):
    """A third of the rows under one key."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500)
    return spark.range(n, numPartitions=12).select(key.alias("k"), F.col("id").alias("o"), (F.col("id") % 7).cast("double").alias("v"))


def test_hot_key_in_dedup_and_pivot(spark):
    rows = [(r["k"], r["o"], r["v"]) for r in hot(spark).collect()]
    last, sums = {}, {}
    for k, o, v in rows:
        last[k] = max(last.get(k, (-1, 0.0)), (o, v))
        code = "AM" if o % 2 else "CC"
        s = sums.setdefault((k, code), [0.0, 0])
        s[0] += v
        s[1] += 1
    got = {r["k"]: (r["o"], r["v"]) for r in keep_last(hot(spark), ["k"], ["o"]).collect()}
    assert got == last
    coded = hot(spark).withColumn("ind", F.when(F.col("o") % 2 == 1, "AM").otherwise("CC"))
    wide = long_to_wide(coded, ["k"], "ind", "v", {"am": "a", "cc": "c"}, ["o"], ["o"])
    for r in wide.collect():
        for code, name in (("AM", "a"), ("CC", "c")):
            s = sums.get((r["k"], code))
            assert r[name] == (pytest.approx(s[0] / s[1]) if s else None)


def test_hot_sheet_is_cut_without_a_window(spark, no_broadcast, plan):
    cut = take_while(hot(spark), ["k"], "o", F.col("o") == 29_000)
    assert "Window" not in plan(cut)
    key = next(r["k"] for r in hot(spark).where("o = 29000").collect())
    want = hot(spark).where((F.col("k") != key) | (F.col("o") < 29_000)).count()
    assert cut.count() == want


def test_adaptive_skew_join_splits_a_hot_partition(spark, no_broadcast):
    """The large side of a join with a written side may be split; results stay whole."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        cut = take_while(hot(spark), ["k"], "o", F.col("o") >= 27_000)
        rows = cut.collect()
        text = cut._sc._jvm.PythonSQLUtils.explainString(cut._jdf.queryExecution(), "simple")
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert sorted(r["o"] for r in rows) == list(range(27_000))
    assert "skew=true" in text
