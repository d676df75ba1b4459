from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelflow.operators.absorbed import fit_absorbed
from panelflow.operators import modelling as op
from panelflow.plans.analysis import fit_and_compare

NUMERIC, CATEGORICAL, TARGETS = ["a", "b"], ["g", "h"], ["y", "w"]


def rows_of(n=600, seed=1, rare=True):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(50, 9, n), rng.normal(1000, 3, n)
    g = rng.choice(["p", "q", "r"], n, p=[0.6, 0.3, 0.1]).astype(object)
    h = rng.choice(["u", "v"], n).astype(object)
    if rare:
        g[-1] = "only"
    y = 200 + 2.5 * a - 0.7 * b + (g == "q") * 12 + (h == "u") * 4 + rng.normal(0, 5, n)
    w = 100 - 1.5 * a + (g == "r") * 30 + rng.normal(0, 2, n)
    return [(i, float(a[i]), float(b[i]), g[i], h[i], float(y[i]), float(w[i])) for i in range(n)]


SCHEMA = "id bigint, a double, b double, g string, h string, y double, w double"


def design(rows, train):
    """Full one-hot, scaled by the train rows: numpy's view of the same model."""
    col = lambda i, rs: np.array([r[i] for r in rs], dtype=object)
    blocks, names = [], []
    for name, i in (("a", 1), ("b", 2)):
        t = col(i, train).astype(float)
        sd = t.std() or 1.0
        blocks.append((col(i, rows).astype(float) - t.mean()) / sd)
        names.append(name)
    for name, i in (("g", 3), ("h", 4)):
        for label in sorted(set(col(i, train))):
            blocks.append((col(i, rows) == label).astype(float))
            names.append(f"{name}_{label}")
    return np.column_stack(blocks), names


def reference(rows, train, target):
    x, names = design(train, train)
    y = np.array([r[target] for r in train])
    coef, *_ = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)
    intercept = y.mean() - x.mean(0) @ coef
    return names, coef, intercept, design(rows, train)[0] @ coef + intercept


def test_fit_is_the_least_norm_solution(spark):
    rows = rows_of()
    models = op.fit(spark.createDataFrame(rows, SCHEMA).repartition(5), NUMERIC, CATEGORICAL, TARGETS)
    for model, column in zip(models, (5, 6)):
        names, coef, intercept, _ = reference(rows, rows, column)
        assert [t for t, _ in model.terms()] == names
        np.testing.assert_allclose([c for _, c in model.terms()], coef, rtol=1e-7, atol=1e-7)
        assert model.intercept == pytest.approx(intercept, abs=1e-7)


def test_constant_and_repeated_columns(spark):
    rows = [(i, float(i % 13), 4.0, "p", "uv"[i % 2], float(3 * (i % 13) + (i % 2)), 1.0 * i) for i in range(200)]
    models = op.fit(spark.createDataFrame(rows, SCHEMA), NUMERIC, CATEGORICAL, ["y"])
    names, coef, intercept, _ = reference(rows, rows, 5)
    np.testing.assert_allclose([c for _, c in models[0].terms()], coef, atol=1e-8)
    assert models[0].intercept == pytest.approx(intercept)


def test_a_column_constant_in_training_has_no_effect(spark):
    """The last fold alone varies, so the fit on the others sees a constant far from the mean."""
    rng = np.random.default_rng(9)
    rows = [(i, 0.1 if i < 400 else float(rng.normal(7, 2)), float(rng.normal()), "p", "uv"[i % 2], float(rng.normal(i % 5)), 1.0) for i in range(500)]
    scores = op.cross_validate(spark.createDataFrame(rows, SCHEMA), NUMERIC, CATEGORICAL, ["y"], ["id"], 5).collect()
    last = next(s["r2"] for s in scores if s["fold"] == 4)
    train, test = [(r[0], 0.0, *r[2:]) for r in rows[:400]], [(r[0], 0.0, *r[2:]) for r in rows[400:]]
    assert last == pytest.approx(r2(np.array([r[5] for r in test]), reference(test, train, 5)[3]), abs=1e-8)


def test_unseen_label_predicts_without_an_effect(spark):
    rows = rows_of(300, rare=False)
    [model] = op.fit(spark.createDataFrame(rows, SCHEMA), NUMERIC, CATEGORICAL, ["y"])
    new = [(0, 51.0, 999.0, "unseen", "u", 0.0, 0.0)]
    got = model.predict(spark.createDataFrame(new, SCHEMA)).first()["predicted_y"]
    assert got == pytest.approx(reference(new, rows, 5)[3][0])


def test_residuals_are_orthogonal_to_the_design(spark):
    rows = rows_of(500)
    df = spark.createDataFrame(rows, SCHEMA)
    [model] = op.fit(df, NUMERIC, CATEGORICAL, ["y"])
    e = np.array([r["y"] - r["predicted_y"] for r in model.predict(df).orderBy("id").collect()])
    x, _ = design(rows, rows)
    assert np.abs(x.T @ e).max() < 1e-6 and abs(e.sum()) < 1e-6


def r2(y, p):
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_fold_scores_refit_scale_and_labels(spark):
    rows = rows_of(503)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    scores = op.cross_validate(df, NUMERIC, CATEGORICAL, TARGETS, ["id"], 5).collect()
    parts = np.array_split(np.arange(len(rows)), 5)
    for s in scores:
        test = [rows[i] for i in parts[s["fold"]]]
        train = [r for i, r in enumerate(rows) if i not in set(parts[s["fold"]])]
        column = 5 if s["target"] == "y" else 6
        predicted = reference(test, train, column)[3]
        assert s["r2"] == pytest.approx(r2(np.array([t[column] for t in test]), predicted), abs=1e-9)
    assert len(scores) == 10


def test_comparison_of_two_targets(spark):
    rows = rows_of(900)
    df = spark.createDataFrame(rows, SCHEMA)
    done = fit_and_compare(df, NUMERIC, CATEGORICAL, TARGETS, "id", ["id"], salt="42/")
    is_test = {r["id"]: r["is_test"] for r in op.holdout_split(df, "id", salt="42/").collect()}
    train, test = [r for r in rows if not is_test[r[0]]], [r for r in rows if is_test[r[0]]]
    table = {r["metric"]: r for r in done.comparison.collect()}
    for name, column in (("y", 5), ("w", 6)):
        y = np.array([r[column] for r in test])
        p = reference(test, train, column)[3]
        assert table["MAE"][name] == pytest.approx(np.abs(y - p).mean())
        assert table["RMSE"][name] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
        assert table["R2"][name] == pytest.approx(r2(y, p))
    folds = done.fold_scores.groupBy("target").agg(F.avg("r2").alias("r2")).collect()
    assert {f["target"]: f["r2"] for f in folds} == pytest.approx({t: table["R2_CV"][t] for t in TARGETS})
    assert done.coefficients.count() == 2 * (1 + 2 + 4 + 2)


def test_split_does_not_depend_on_partitions_and_has_the_asked_share(spark):
    df = spark.range(20_000)
    one = op.holdout_split(df.repartition(3), "id", salt="s").where("is_test").select("id")
    two = op.holdout_split(df.repartition(11), "id", salt="s").where("is_test").select("id")
    ids = {r["id"] for r in one.collect()}
    assert ids == {r["id"] for r in two.collect()}
    assert abs(len(ids) / 20_000 - 0.2) < 0.01


def test_scaling_without_spread_divides_by_one(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = op.zscore(df, ["a", "b"]).orderBy("a").collect()
    assert [(r["z_a"], r["z_b"]) for r in got] == [(-1.0, 0.0), (1.0, 0.0)]


def test_large_offsets_keep_their_digits(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=400)
    rows = [(i, 1e9 + float(v), 0.0, "p", "u", 1e9 + 3 * float(v), 0.0) for i, v in enumerate(x)]
    [model] = op.fit(spark.createDataFrame(rows, SCHEMA), ["a"], [], ["y"])
    mean, scale, coef = model.numeric["a"]
    assert coef / scale == pytest.approx(3.0, abs=1e-5)


def test_too_many_labels_are_refused_by_name(spark):
    from panelflow.operators.modelling import TooManyLabels, collect_moments, one_hot

    df = spark.range(400).select((F.col("id") % 40).cast("string").alias("many"), F.lit("a").alias("few"), F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    with pytest.raises(TooManyLabels, match="column many has more than 39 labels"):
        one_hot(df, "many", max_labels=39)
    assert len(one_hot(df, "many", max_labels=40).columns) == 44
    for most in (5, 39):
        with pytest.raises(TooManyLabels, match="column many"):
            collect_moments(df, ["x"], ["few", "many"], ["y"], max_labels=most)
    assert len(collect_moments(df, ["x"], ["few", "many"], ["y"], max_labels=40).blocks) == 1


def dense(rows, numeric, factors, target):
    """Least-norm solution on centred columns: numeric coefficients, intercept, effects by factor and label."""
    columns = [[float(r[c]) for r in rows] for c in numeric]
    names = [(f, label) for f in factors for label in sorted({str(r[f]) for r in rows})]
    columns += [[float(str(r[f]) == label) for r in rows] for f, label in names]
    x, y = np.array(columns).T, np.array([float(r[target]) for r in rows])
    found = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)[0]
    return found[: len(numeric)], y.mean() - x.mean(0) @ found, dict(zip(names, found[len(numeric) :])), x @ found + y.mean() - x.mean(0) @ found


@pytest.mark.parametrize("factors", [["a"], ["a", "b"], ["a", "b", "c"]])
def test_absorbed_labels_equal_the_dense_solution(spark, factors):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(rng.integers(12)) ** 2 // 9, "pqr"[rng.integers(3)], int(rng.integers(5)), float(rng.normal()), float(rng.normal(3, 2)), float(rng.normal(50, 9))) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a int, b string, c int, x double, z double, y double").repartition(5)
    model = fit_absorbed(df, ["x", "z"], factors, "y")
    beta, intercept, effects, fitted = dense(df.collect(), ["x", "z"], factors, "y")
    np.testing.assert_allclose([model.numeric["x"], model.numeric["z"]], beta, atol=1e-8)
    assert abs(model.intercept - intercept) < 1e-8
    got = {(r["factor"], r["label"][1:]): r["effect"] for r in model.effects.collect()}
    assert got.keys() == effects.keys() and max(abs(got[k] - effects[k]) for k in got) < 1e-8
    predicted = np.array([r["predicted"] for r in model.predict(df).orderBy("id").collect()])
    order = {r["id"]: i for i, r in enumerate(df.collect())}
    np.testing.assert_allclose(predicted, fitted[[order[i] for i in range(400)]], atol=1e-8)


def test_absorbed_nulls_unseen_labels_and_determined_numbers(spark):
    rows = [("a", 1.0, 1.0, 3.0), ("a", 1.0, 2.0, 5.0), (None, 7.0, 1.0, 4.0), (None, 7.0, 4.0, 10.0), ("b", 2.0, None, 1.0), ("b", 2.0, 3.0, float("nan"))]
    df = spark.createDataFrame(rows, "g string, same double, x double, y double")
    model = fit_absorbed(df, ["same", "x"], ["g"], "y")
    assert abs(model.numeric["same"]) < 1e-9 and abs(model.numeric["x"] - 2) < 1e-9
    assert {r["label"] for r in model.effects.collect()} == {"=a", ""}
    new = spark.createDataFrame([("a", 1.0, 0.0), ("new", 1.0, 1.0), ("a", 1.0, None)], "g string, same double, x double")
    got = [r["predicted"] for r in model.predict(new).orderBy("x").collect()]
    assert got[0] is None and abs(got[1] - 1) < 1e-9 and abs(got[2] - (model.intercept + 2)) < 1e-9
    with pytest.raises(ValueError):
        fit_absorbed(df.limit(0), ["x"], ["g"], "y")


def test_a_hundred_thousand_labels(spark, plan):
    rows = spark.range(300_000).select(
        (F.col("id") % 100_000).alias("many"), (F.col("id") % 7).alias("few"), F.rand(3).alias("x"),
    ).withColumn("y", 2 * F.col("x") + F.col("many") % 13 + 5 * F.col("few"))
    model = fit_absorbed(rows, ["x"], ["many", "few"], "y", tolerance=1e-9)
    assert abs(model.numeric["x"] - 2) < 1e-6 and model.effects.count() == 100_007
    off = model.predict(rows).agg(F.max(F.abs(F.col("predicted") - F.col("y")))).first()[0]
    assert off < 1e-5 and "=100000" not in plan(model.predict(rows))
