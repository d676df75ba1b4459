from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from panelflow.operators import cleaning, columns, reshape
from panelflow.operators.modelling import one_hot, top_effects
from panelflow.operators.profiling import correlations, distinct_values, histogram, null_counts

CODES = {"am": "m", "aa": "m", "cc": "c"}


def test_melted_wide_data_comes_back(spark):
    wide = [(i, float(i), float(-i)) for i in range(50)]
    df = spark.createDataFrame(wide, "k int, m double, c double")
    long = df.select("k", F.explode(F.array(
        F.struct(F.lit("AM").alias("ind"), F.col("m").alias("prom")), F.struct(F.lit("CC").alias("ind"), F.col("c").alias("prom"))
    )).alias("p")).select("k", "p.*")
    back = reshape.long_to_wide(long, ["k"], "ind", "prom", CODES).select("k", "m", "c")
    assert sorted(tuple(r) for r in back.collect()) == wide


def test_pivot_rules(spark):
    rows = [
        (1, "AM", 1.0, None, 1), (1, "aa ", 3.0, "late", 3), (1, "CC", None, "early", 2), (1, "zz", 9.0, "unmapped", 0),
        (2, "AM", None, "gone", 1), (None, "AM", 5.0, "null key", 1), (3, "cc", 4.0, None, 1),
    ]
    df = spark.createDataFrame(rows, "k int, ind string, prom double, ctx string, o int").repartition(3)
    out = reshape.long_to_wide(df, ["k"], "ind", "prom", CODES, ["ctx"], ["o"])
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2.0, None, "early"), (3, None, 4.0, None)]
    with pytest.raises(ValueError):
        reshape.long_to_wide(df, ["k"], "ind", "prom", CODES, ["ctx"])


def test_wide_frames_pass_and_text_codes_win(spark):
    wide = spark.createDataFrame([(1, 2.0)], "k int, m double")
    assert reshape.widen(wide, ["k"], CODES, {}, [], []) is wide
    odd = spark.createDataFrame([(1, 2.0)], "k int, prom double")
    assert reshape.widen(odd, ["k"], CODES, {}, [], []) is odd
    both = spark.createDataFrame([(1, "cc", "1", 2.0)], "k int, ind string, id_indicador string, prom double")
    assert reshape.widen(both, ["k"], CODES, {"1": "m"}, [], []).first()["c"] == 2.0


def test_keep_last_is_idempotent_and_ignores_partitions(spark):
    random.seed(2)
    rows = [(random.choice([1, 1, 1, 2, None]), i, f"v{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "k int, o int, v string")
    want = {}
    for k, _, v in rows:
        want[k] = v
    for n in (1, 7):
        once = reshape.keep_last(df.repartition(n), ["k"], ["o"])
        assert {r["k"]: r["v"] for r in once.collect()} == want
        assert reshape.keep_last(once, ["k"], ["o"]).count() == len(want)


def test_keep_last_cuts_hot_keys_before_the_shuffle(spark, plan):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"))
    text = plan(reshape.keep_last(df, ["k"], ["o"]))
    assert text.count("WindowGroupLimit") >= 2


def test_panel_join_takes_the_left_value_then_the_right(spark):
    left = spark.createDataFrame([(1, "a", None), (2, None, 5)], "k int, ctx string, x int")
    right = spark.createDataFrame([(1, "b", 7), (2, "c", 8), (3, "d", 9)], "k int, ctx string, y int")
    out = reshape.panel_join(left, right, ["k"])
    assert out.columns == ["k", "ctx", "x", "y"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", None, 7), (2, "c", 5, 8)]
    for twice, check in (([left, right.unionAll(right)], "right"), ([left.unionAll(left), right], "left")):
        with pytest.raises(Exception, match="more than one row for"):
            reshape.panel_join(*twice, ["k"]).collect()
        other = "left" if check == "right" else "right"
        assert reshape.panel_join(*twice, ["k"], check=[other]).count() == 4


def test_the_audit_of_keys_shares_the_shuffle_of_the_join(spark, small, plan):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        orders = spark.read.parquet(f"{small}/orders.parquet").select("o_orderkey", "o_totalprice")
        other = spark.read.parquet(f"{small}/orders.parquet").select("o_orderkey", "o_custkey")
        text = plan(reshape.panel_join(orders, other, ["o_orderkey"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert (text.count("Exchange ("), text.count("Scan parquet")) in ((2, 2), (2, 4), (4, 4)) and text.count("\n+- Exchange") <= 2


def test_detail_columns(spark):
    rows = [(1, "am", "aa", 2.0), (1, "am", "aa", 4.0), (1, "am", "me", 1.0), (2, "cc", "zz", 9.0)]
    df = spark.createDataFrame(rows, "k int, ind string, dim string, prom double")
    details = reshape.detail_to_wide(df, ["k"], "ind", "dim", "prom", [("am", "aa"), ("am", "me")])
    main = spark.createDataFrame([(1,), (2,)], "k int")
    got = [tuple(r) for r in reshape.merge_details(main, details, ["k"]).orderBy("k").collect()]
    assert got == [(1, 3.0, 1.0), (2, None, None)]


def test_settled_names(spark):
    df = spark.createDataFrame([("1", "2", "3")], "a string, b string, c string")
    out = columns.settle_names(df, ["﻿X ", "ÑAME", "x"], columns.by_alias({"ñame": "n"}))
    assert out.columns == ["x", "n"] and tuple(out.first()) == ("1", "2")
    rename = columns.by_regex({r"prom_mate\w+_rbd": "prom_mate_rbd"})
    assert [rename(n) for n in ("prom_mate2m_rbd", "PROM_MATE4B_RBD", "prom_mate_rbd", "xprom_mate2m_rbd")] == [
        "prom_mate_rbd", "prom_mate_rbd", "prom_mate_rbd", "xprom_mate2m_rbd"]
    assert columns.missing_columns(out, ["x", "z"]) == ["z"]


def test_long_ids_keep_their_digits(spark):
    from panelflow.functions.text import to_integer

    df = spark.createDataFrame([("9007199254740993",), ("12.0",), ("1.5",), ("x",), (None,)], "v string")
    got = [r[0] for r in df.select(to_integer("v", "bigint")).collect()]
    assert got == [9007199254740993, 12, None, None, None]


def test_audit_counts_null_tests_as_failed(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    got = [tuple(r) for r in cleaning.cleaning_audit(df, [("a", F.col("x") > 0), ("b", F.col("x") > 2)]).collect()]
    assert got == [(1, "a", 3, 2, 1), (2, "b", 2, 1, 1)]


def test_histogram_equals_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    for values in (rng.integers(0, 41, 5000).astype(float) / 10, rng.normal(size=3000), np.full(9, 3.0), np.array([0.1 * i for i in range(41)])):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        got = histogram(df, "x", 40).orderBy("bin").collect()
        counts, edges = np.histogram(values, bins=40)
        assert [r["rows"] for r in got] == counts.tolist()
        np.testing.assert_allclose([r["bin_lo"] for r in got], edges[:-1], atol=1e-12)


def test_correlations_drop_nulls_by_pair(spark):
    import pandas as pd

    pdf = pd.DataFrame({"a": [1.0, 2, 3, 5, None], "b": [2.0, 1, None, 9, 4], "c": [1.0, 1, 1, 1, 1], "d": [5.0, 3, 2, 2, 0]})
    rows = [tuple(None if v != v else v for v in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    want = pdf.corr()
    got = {(r["var_a"], r["var_b"]): r["r"] for r in correlations(df, list("abcd"), pairs_per_pass=2).collect()}
    assert len(got) == 16
    for (a, b), r in got.items():
        w = want.loc[a, b]
        assert (r is None or r != r) if w != w else r == pytest.approx(w)


def test_null_counts_and_values(spark):
    df = spark.createDataFrame([("a", 1), (None, 1), ("a", None)], "s string, n int")
    assert {tuple(r) for r in null_counts(df).collect()} == {("s", 1), ("n", 1)}
    assert [tuple(r) for r in distinct_values(df, ["s"]).collect()] == [("s", None, 1), ("s", "a", 2)]


def test_one_hot_of_an_unseen_label(spark):
    df = spark.createDataFrame([("a", False), ("b", False), ("z", True), (None, True)], "g string, t boolean")
    got = sorted(tuple(r) for r in one_hot(df, "g", ~F.col("t")).select("g_a", "g_b").collect())
    assert got == [(0.0, 0.0), (0.0, 0.0), (0.0, 1.0), (1.0, 0.0)]


def test_top_effects_are_ordered_by_size(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", -5.0), ("c", 5.0), ("d", 0.5), ("e", 2.0), ("f", -3.0)], "term string, coefficient double")
    got = [(r["term"], r["sign"]) for r in top_effects(df).collect()]
    assert got == [("b", "negative"), ("c", "positive"), ("f", "negative"), ("e", "positive"), ("a", "positive")]


def test_flags_and_stamps(spark):
    import datetime

    from panelflow.functions.text import significance_flag, stamp_to_date

    df = spark.createDataFrame([("No significativa", "20171024"), ("-1", "2017"), ("Positiva y significativa", "20171024.0"), ("?", None)], "f string, d string")
    got = [tuple(r) for r in df.select(significance_flag("f"), stamp_to_date("d")).collect()]
    day = datetime.date(2017, 10, 24)
    assert got == [(0, day), (-1, None), (1, day), (None, None)]
