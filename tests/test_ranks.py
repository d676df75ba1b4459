from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelflow.operators import ranks
from panelflow.operators.profiling import box_stats, correlations, describe


def frame(spark, values, schema="x double"):
    return spark.createDataFrame([(v,) for v in values], schema).repartition(7)


def hard_columns():
    rng = np.random.default_rng(3)
    skewed = np.exp(rng.normal(0, 6, 20_000))
    hot = np.concatenate([np.full(9_000, 5.0), rng.normal(5, 3, 11_000)])
    few = rng.integers(0, 4, 20_000).astype(float)
    return {"skewed": skewed, "hot": hot, "few": few, "all_same": np.full(20_000, 2.5), "normal": rng.normal(size=20_000)}


PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("one_task_rows", [10, 1_000_000])
def test_bracketed_quantiles_equal_numpy(spark, one_task_rows):
    columns = hard_columns()
    rows = list(zip(*[c.tolist() for c in columns.values()]))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(7)
    found = ranks.exact_quantiles(df, list(columns), PROBS, percentile_rows=0, one_task_rows=one_task_rows)
    got = {r["variable"]: r for r in found.collect()}
    for name, values in columns.items():
        assert got[name]["n"] == len(values)
        np.testing.assert_allclose(got[name]["q"], np.quantile(values, PROBS), rtol=1e-12, atol=1e-12)


def test_percentile_path_equals_bracketed_path(spark):
    rng = np.random.default_rng(5)
    rows = [(f"g{int(g)}", float(v)) for g, v in zip(rng.integers(0, 5, 3000) ** 2 // 5, rng.normal(size=3000))]
    df = spark.createDataFrame([*rows, (None, 1.0), ("g0", None), ("g0", float("nan"))], "g string, x double")
    quick = ranks.exact_quantiles(df, ["x"], PROBS, by=["g"])
    slow = ranks.exact_quantiles(df, ["x"], PROBS, by=["g"], percentile_rows=0, one_task_rows=20)
    key = lambda r: r["g"]
    a, b = sorted(quick.collect(), key=key), sorted(slow.collect(), key=key)
    assert [(r["g"], r["n"]) for r in a] == [(r["g"], r["n"]) for r in b]
    for x, y in zip(a, b):
        np.testing.assert_allclose(x["q"], y["q"], rtol=1e-12)


def test_ranks_beyond_the_sketch(spark):
    """Neighbouring ranks on both sides of a hot value, many rounds of narrowing."""
    values = [1.0] * 5000 + [2.0] + [3.0] * 5000 + [float(v) for v in range(4, 3000)]
    df = frame(spark, values)
    probs = [4999 / (len(values) - 1), 5000 / (len(values) - 1), 5001 / (len(values) - 1)]
    row = ranks.exact_quantiles(df, ["x"], probs, percentile_rows=0, one_task_rows=1).first()
    np.testing.assert_allclose(row["q"], np.quantile(values, probs), atol=1e-9)


@pytest.mark.parametrize("n,folds", [(23, 5), (25, 5), (7, 5), (3, 5), (100, 3)])
def test_folds_are_contiguous_and_sized_like_array_splits(spark, n, folds):
    df = spark.range(n).select((F.col("id") * 7 - 30).alias("k")).repartition(4)
    got = [r["fold"] for r in ranks.contiguous_folds(df, ["k"], folds).orderBy("k").collect()]
    sizes = [n // folds + (i < n % folds) for i in range(folds)]
    assert got == [i for i, s in enumerate(sizes) for _ in range(s)]


def test_folds_by_two_columns(spark):
    rows = [(i // 10, i % 10) for i in range(57)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    got = ranks.contiguous_folds(df, ["a", "b"], 5).orderBy("a", "b").collect()
    assert [r["fold"] for r in got] == [i for i, part in enumerate(np.array_split(range(57), 5)) for _ in part]


@pytest.mark.parametrize("one_task_rows", [4, 1000])
def test_folds_by_number_date_and_text(spark, one_task_rows):
    rows = [(i // 20, i // 4, "dcba"[i % 4]) for i in range(117)]
    df = spark.createDataFrame(rows, "a int, b int, c string").repartition(5)
    want = {r: i for i, part in enumerate(np.array_split(np.arange(117), 5)) for r in part}
    place = {r: i for i, r in enumerate(sorted(rows))}
    got = ranks.contiguous_folds(df, ["a", "b", "c"], 5, one_task_rows=one_task_rows).collect()
    assert all(r["fold"] == want[place[(r["a"], r["b"], r["c"])]] for r in got)


def test_folds_by_text_alone(spark):
    df = spark.createDataFrame([(f"n{i:03}",) for i in range(23)], "name string").repartition(3)
    got = [r["fold"] for r in ranks.contiguous_folds(df, ["name"], 5).orderBy("name").collect()]
    assert got == [i for i, part in enumerate(np.array_split(range(23), 5)) for _ in part]


@pytest.mark.parametrize("one_task_rows", [1, 10, 1_000_000])
def test_folds_with_text_first_or_as_a_hot_tie_breaker(spark, one_task_rows):
    rows = [("abc"[i % 3] if i % 2 else "hot", i // 50, f"t{(i * 37) % 211:03}") for i in range(211)]
    df = spark.createDataFrame(rows, "a string, b int, c string").repartition(5)
    want = {r: i for i, part in enumerate(np.array_split(np.arange(len(rows)), 5)) for r in part}
    for order in (["a", "c"], ["b", "c"], ["c"], ["a", "b", "c"]):
        at = [["a", "b", "c"].index(c) for c in order]
        place = {r: i for i, r in enumerate(sorted(rows, key=lambda r: [r[k] for k in at]))}
        got = ranks.contiguous_folds(df, order, 5, one_task_rows=one_task_rows).collect()
        assert all(r["fold"] == want[place[(r["a"], r["b"], r["c"])]] for r in got)


def test_a_null_in_an_order_column_is_named(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, None)], "x int, name string")
    with pytest.raises(ValueError, match="order column x holds 1 nulls"):
        ranks.contiguous_folds(df, ["x"], 2)
    with pytest.raises(ValueError, match="order column name holds 1 nulls"):
        ranks.contiguous_folds(df, ["name", "x"], 2)


def same(a, b):
    return a == b or (a is not None and b is not None and ((a != a and b != b) or abs(a - b) <= 1e-12 * max(1, abs(a))))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_are_the_same_rows_on_every_path(spark, by):
    inf, nan = float("inf"), float("nan")
    rng = np.random.default_rng(8)
    rows = [("hot", float(v), None, nan) for v in rng.normal(size=400)] + [("hot", 5.0, 1.0, nan)] * 300
    rows += [("small", v, w, None) for v, w in [(1.0, -inf), (2.0, inf), (inf, nan), (inf, 3.0), (inf, None)]]
    rows += [("empty", None, None, None), ("empty", nan, None, None), ("one", 7.0, 7.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double, void double").repartition(5)
    found = []
    for percentile_rows, one_task_rows in ((100_000, 1_000_000), (0, 1), (0, 10), (10, 10), (1, 1_000_000)):
        got = ranks.exact_quantiles(df, ["x", "y", "void"], PROBS, by, percentile_rows, one_task_rows).collect()
        found.append({(*[r[c] for c in by], r["variable"]): (r["n"], r["q"]) for r in got})
        assert len(got) == len(found[0]) == 3 * (4 if by else 1)
    for other in found[1:]:
        for key, (n, q) in found[0].items():
            assert other[key][0] == n and (q is None) == (other[key][1] is None), key
            assert q is None or all(same(a, b) for a, b in zip(q, other[key][1])), (key, q, other[key][1])


@pytest.mark.parametrize("percentile_rows", [0, 100_000])
def test_statistics_skip_nan_and_keep_empty_columns(spark, percentile_rows):
    rows = [(1.0, None, 2.0), (2.0, None, 4.5), (float("nan"), None, 6.0), (4.0, None, float("nan")), (None, None, 1.0)]
    df = spark.createDataFrame(rows, "x double, void double, y double")
    got = {r["variable"]: r for r in describe(df, ["x", "void"], percentile_rows=percentile_rows).collect()}
    assert tuple(got["x"])[1:] == (3, 2.33, 1.53, 1.0, 1.5, 2.0, 3.0, 4.0)
    assert tuple(got["void"])[1:] == (0, *[None] * 7)
    box = box_stats(df.selectExpr("'g' as g", "x"), "g", "x", percentile_rows=percentile_rows).first()
    assert (box["rows"], box["outliers"], box["median"]) == (3, 0, 2.0)
    pair = {(r["var_a"], r["var_b"]): r["r"] for r in correlations(df, ["x", "y", "void"]).collect()}
    assert abs(pair["x", "y"] - 1.0) < 1e-12 and pair["void", "void"] is None


def test_ties_that_start_a_fold_are_fine(spark):
    got = ranks.contiguous_folds(frame(spark, [0.0, 0.5, 1.0, 1.0]), ["x"], 2).orderBy("x").collect()
    assert [r["fold"] for r in got] == [0, 0, 1, 1]


def test_an_order_that_ties_at_a_cut_is_refused(spark):
    with pytest.raises(ValueError, match="not total"):
        ranks.contiguous_folds(frame(spark, [1.0] * 10), ["x"], 5)


def test_folds_do_not_shuffle_the_rows(spark, plan):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert "Exchange" not in plan(ranks.contiguous_folds(df, ["k"], 5))


def test_describe_equals_pandas(spark):
    import pandas as pd

    columns = hard_columns()
    pdf = pd.DataFrame({k: v for k, v in columns.items() if k != "skewed"})
    pdf.loc[::9, "normal"] = None
    rows = [tuple(None if v != v else float(v) for v in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pdf.columns))
    got = {r["variable"]: r for r in describe(df, list(pdf.columns)).collect()}
    want = pdf.describe().round(2)
    for c in pdf.columns:
        have = [got[c][k] for k in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")]
        np.testing.assert_allclose(have, want[c].to_numpy(), atol=1e-9)


@pytest.mark.parametrize("percentile_rows", [0, 100_000])
def test_box_whiskers_stop_at_points_and_never_inside_the_box(spark, percentile_rows):
    rows = [("a", float(v)) for v in [1, 2, 3, 4, 5, 100, -60]] + [("b", 7.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r for r in box_stats(df, "g", "x", percentile_rows=percentile_rows).collect()}
    a = got["a"]
    q1, q3 = np.quantile([1, 2, 3, 4, 5, 100, -60], [0.25, 0.75])
    assert (a["q1"], a["q3"], a["whisker_lo"], a["whisker_hi"], a["outliers"]) == (q1, q3, 1.0, 5.0, 2)
    assert (got["b"]["whisker_lo"], got["b"]["whisker_hi"], got["b"]["outliers"]) == (7.0, 7.0, 0)


def sent_rows(spark, work):
    """What the jobs of ``work`` collect through DataFrames, in rows."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen, own = [], DataFrame.collect

    def collect(self):
        rows = own(self)
        seen.append(len(rows))
        return rows

    DataFrame.collect = collect
    try:
        work()
    finally:
        DataFrame.collect = own
    return seen


def test_a_large_range_is_dealt_again(spark, plan, monkeypatch):
    rows = spark.range(100_000).select(F.lit("hot").alias("a"), F.sha2(F.col("id").cast("string"), 256).alias("b"))
    names = sorted(r["b"] for r in rows.collect())
    shown = []
    own = ranks._numbered

    def numbered(dealt, *rest):
        shown.append(dealt)
        return own(dealt, *rest)

    monkeypatch.setattr(ranks, "_numbered", numbered)
    cuts = []
    seen = sent_rows(spark, lambda: cuts.extend(ranks.fold_cuts(rows, ["a", "b"], 5, one_task_rows=1_000)))
    assert cuts == [("hot", names[k]) for k in (20_000, 40_000, 60_000, 80_000)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(seen) <= parts and len(shown) >= 4
    assert all("TakeOrderedAndProject" not in plan(d) for d in shown)


def test_few_different_keys_are_peeled(spark):
    rows = spark.range(4_000).select(F.when(F.col("id") < 3_990, "m").otherwise(F.concat(F.lit("z"), F.col("id").cast("string"))).alias("k"))
    with pytest.raises(ValueError, match="not total"):
        ranks.fold_cuts(rows, ["k"], 2, one_task_rows=10)
    assert ranks._range_cuts(rows, ["k"], [0, 3_990, 3_991], 10) == [("m",), ("z3990",), ("z3991",)]
