"""Linear regression from sufficient statistics.

Everything a least-squares fit needs is a table of sums.  One aggregation groups the rows by
fold and category cell and sums the centred numeric columns, targets and their products; a
second, tiny one folds the cells into the entries of the Gram matrix.  All targets and all
folds share that one scan.  Only the p x p matrix (p = number of terms) reaches the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations, combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelflow.functions.text import as_col
from panelflow.operators.ranks import contiguous_folds
from panelflow.operators.sized import written

ALL = ("", "")


# ------------------------------------------------------------------ split, scale, encode


def holdout_bucket(key: Column | str, salt: str = "") -> Column:
    """0-99, a fixed function of the key: no row moves when the table is partitioned anew."""
    text = as_col(key).cast("string")
    digest = F.md5(F.concat(F.lit(salt), text) if salt else text)
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100).alias("bucket")


def holdout_split(
    df: DataFrame, key: Column | str, percent: int = 20, salt: str = "", name: str = "is_test"
) -> DataFrame:
    return df.withColumn(name, holdout_bucket(key, salt) < percent)


def zscore(df: DataFrame, columns: Sequence[str], train: Column | None = None) -> DataFrame:
    """Centre and scale by mean and population deviation of the train rows; no spread scales by 1."""
    fitted = df if train is None else df.where(train)
    stats = fitted.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(columns)],
        ).alias("stats")
    )
    ready = df.withColumn("_stats", stats.scalar())
    scaled = {}
    for i, c in enumerate(columns):
        sd = F.col(f"_stats.s_{i}")
        scaled[f"z_{c}"] = (F.col(c) - F.col(f"_stats.m_{i}")) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)
    return ready.withColumns(scaled).drop("_stats")


#: Labels become columns, literals of the plan and sides of a dense matrix on the driver.
MAX_LABELS = 1000


class TooManyLabels(ValueError):
    def __init__(self, column: str, most: int):
        super().__init__(f"column {column} has more than {most} labels; fold rare ones or raise max_labels")


def categories(df: DataFrame, column: str, max_labels: int = MAX_LABELS) -> list[str]:
    """Sorted distinct labels; more than ``max_labels`` are refused, never cut."""
    labels = df.select(F.col(column).cast("string").alias("v")).where("v is not null").distinct()
    rows = labels.limit(max_labels + 1).collect()
    if len(rows) > max_labels:
        raise TooManyLabels(column, max_labels)
    return sorted(r["v"] for r in rows)


def one_hot(df: DataFrame, column: str, train: Column | None = None, max_labels: int = MAX_LABELS) -> DataFrame:
    """One 0/1 column per train label; a label unseen in training gives zeros throughout."""
    labels = categories(df if train is None else df.where(train), column, max_labels)
    value = F.col(column).cast("string")
    hot = {f"{column}_{v}": F.coalesce((value == v).cast("double"), F.lit(0.0)) for v in labels}
    return df.withColumns(hot)


# ------------------------------------------------------------------ one feature, in SQL terms


def simple_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope and intercept of y on x, one row."""
    return df.agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"),
    )


def simple_predict(df: DataFrame, fit: DataFrame, x: str, name: str = "predicted") -> DataFrame:
    line = fit.select(F.struct("slope", "intercept").alias("line")).scalar()
    ready = df.withColumn("_line", line)
    return ready.withColumn(name, F.col("_line.intercept") + F.col("_line.slope") * F.col(x)).drop("_line")


def within_category_fit(df: DataFrame, x: str, y: str, category: str) -> DataFrame:
    """Common slope of y on x with one effect per category, from one grouped pass.

    ``effect`` is the level of the category, ``coefficient`` its distance from the plain mean of
    all levels.  The grouped pass is written, so the pooled slope reads one row per category.
    """
    rows = F.count(F.lit(1))
    cells = written(
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(category).isNotNull())
        .groupBy(category)
        .agg(
            rows.alias("n"),
            F.avg(x).alias("mean_x"),
            F.avg(y).alias("mean_y"),
            (F.covar_pop(x, y) * rows).alias("sxy"),
            (F.var_pop(x) * rows).alias("sxx"),
        )
    )
    slope = (F.sum("sxy") / F.nullif(F.sum("sxx"), F.lit(0.0))).alias("slope")
    pooled = cells.agg(F.struct(slope, F.avg("mean_x").alias("x"), F.avg("mean_y").alias("y")).alias("pooled"))
    effect = F.col("mean_y") - F.col("pooled.slope") * F.col("mean_x")
    middle = F.col("pooled.y") - F.col("pooled.slope") * F.col("pooled.x")
    return cells.withColumn("pooled", pooled.scalar()).select(
        category,
        "n",
        F.col("pooled.slope").alias("slope"),
        effect.alias("effect"),
        (effect - middle).alias("coefficient"),
    )


# ------------------------------------------------------------------ metrics


def _scores(actual: str, predicted: str) -> dict[str, Column]:
    e = F.col(actual) - F.col(predicted)
    total = F.var_pop(actual) * F.count(F.lit(1))
    return {
        "MAE": F.avg(F.abs(e)),
        "RMSE": F.sqrt(F.avg(e * e)),
        "R2": F.lit(1.0) - F.sum(e * e) / F.nullif(total, F.lit(0.0)),
    }


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE and R2 (not the squared correlation; below zero for a poor fit) in one pass."""
    s = _scores(actual, predicted)
    return df.agg(
        F.count(F.lit(1)).alias("n"), s["MAE"].alias("mae"), s["RMSE"].alias("rmse"), s["R2"].alias("r2")
    )


def metric_lines(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Metrics of several targets in one pass: (metric, target, value)."""
    cells = [
        F.struct(F.lit(metric).alias("metric"), F.lit(target).alias("target"), value.alias("value"))
        for target, (actual, predicted) in pairs.items()
        for metric, value in _scores(actual, predicted).items()
    ]
    row = df.agg(*[c.alias(f"cell_{i}") for i, c in enumerate(cells)])
    return row.select(F.explode(F.array(*row.columns)).alias("cell")).select("cell.*")


def compare_targets(lines: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(metric, target, value) to one row per metric and one column per target."""
    return lines.groupBy("metric").agg(
        *[F.max(F.when(F.col("target") == t, F.col("value"))).alias(t) for t in targets]
    )


def residuals(df: DataFrame, actual: str, predicted: str, name: str = "residual") -> DataFrame:
    return df.withColumn(name, F.col(actual) - F.col(predicted))


# ------------------------------------------------------------------ coefficients


def rank_by_abs(df: DataFrame, column: str, tie: str) -> DataFrame:
    return df.orderBy(F.abs(F.col(column)).desc(), F.col(tie).asc())


def top_effects(df: DataFrame, column: str = "coefficient", tie: str = "term", k: int = 5) -> DataFrame:
    """The k largest coefficients by size, with their sign class."""
    sign = F.when(F.col(column) > 0, F.lit("positive")).otherwise(F.lit("negative"))
    return rank_by_abs(df, column, tie).limit(k).withColumn("sign", sign)


@dataclass
class LinearModel:
    """A fitted line for one target: scaled numeric terms and one effect per category label."""

    target: str
    intercept: float
    numeric: dict[str, tuple[float, float, float]] = field(default_factory=dict)  # mean, scale, coefficient
    effects: dict[str, dict[str, float]] = field(default_factory=dict)

    def terms(self) -> list[tuple[str, float]]:
        named = [(name, coef) for name, (_, _, coef) in self.numeric.items()]
        for column, levels in self.effects.items():
            named += [(f"{column}_{level}", coef) for level, coef in sorted(levels.items())]
        return named

    def prediction(self) -> Column:
        out = F.lit(self.intercept)
        for name, (mean, scale, coef) in self.numeric.items():
            out = out + (F.col(name).cast("double") - F.lit(mean)) / F.lit(scale) * F.lit(coef)
        for column, levels in self.effects.items():
            table = F.create_map(*[v for level, coef in levels.items() for v in (F.lit(level), F.lit(coef))])
            out = out + F.coalesce(F.try_element_at(table, F.col(column).cast("string")), F.lit(0.0))
        return out

    def predict(self, df: DataFrame, name: str | None = None) -> DataFrame:
        return df.withColumn(name or f"predicted_{self.target}", self.prediction())


def coefficient_table(spark: SparkSession, models: Sequence[LinearModel]) -> DataFrame:
    """(target, position, term, coefficient): numeric terms first, then ``column_label``."""
    rows = [
        (m.target, i, term, float(coef))
        for m in models
        for i, (term, coef) in enumerate([("(intercept)", m.intercept), *m.terms()])
    ]
    return spark.createDataFrame(rows, "target string, position int, term string, coefficient double")


# ------------------------------------------------------------------ sufficient statistics


@dataclass
class Gram:
    """Sums of one block of rows over the columns [1, numeric..., label indicators..., targets...].

    Numeric columns and targets are centred on fixed values (the same for every block), so
    blocks add up: train = total - fold.
    """

    terms: list[tuple[str, str]]
    matrix: np.ndarray

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.terms, self.matrix + other.matrix)

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.terms, self.matrix - other.matrix)


@dataclass
class Moments:
    numeric: list[str]
    categorical: list[str]
    targets: list[str]
    centre: dict[str, float]
    blocks: dict[int, Gram]

    def total(self) -> Gram:
        grams = list(self.blocks.values())
        return sum(grams[1:], grams[0])


def collect_moments(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    targets: Sequence[str],
    block: str | None = None,
    max_labels: int = MAX_LABELS,
) -> Moments:
    """Gram matrices of the blocks of a frame: two scans, p x p numbers per block.

    Labels are estimated in the first scan, so a column with far more than ``max_labels`` is refused before anything
    is collected by label, and counted exactly afterwards.

    The first scan takes the means the columns are centred on (raw sums of squares lose
    digits), the second the sums.  Rows with a null in any of the columns are left out.
    """
    values = [*numeric, *targets]
    ready = df.select(
        (F.col(block).cast("int") if block else F.lit(0)).alias("_block"),
        *[F.col(c).cast("string").alias(c) for c in categorical],
        *[F.col(c).cast("double").alias(c) for c in values],
    ).dropna()
    sizes = [F.approx_count_distinct(c, 0.03).alias(f"labels_{i}") for i, c in enumerate(categorical)]
    means = ready.agg(*[F.avg(c).alias(c) for c in values], *sizes).first()
    for i, column in enumerate(categorical):
        if means[f"labels_{i}"] > 1.2 * max_labels:
            raise TooManyLabels(column, max_labels)
    if means[values[0]] is None:
        raise ValueError("no complete rows to fit")
    centre = {c: float(means[c]) for c in values}

    shifted = {c: F.col(c) - F.lit(centre[c]) for c in values}
    products = list(combinations_with_replacement(range(len(values)), 2))
    sums = [F.sum(shifted[c]).alias(f"s_{i}") for i, c in enumerate(values)] + [
        F.sum(shifted[values[i]] * shifted[values[j]]).alias(f"p_{i}_{j}") for i, j in products
    ]
    names = [f"s_{i}" for i in range(len(values))] + [f"p_{i}_{j}" for i, j in products]
    cells = ready.groupBy("_block", *categorical).agg(F.count(F.lit(1)).cast("double").alias("n"), *sums)

    # Each cell contributes to: the whole block, each of its labels, each pair of its labels.
    label = lambda c: (F.lit(c) if c else F.lit(""), F.col(c) if c else F.lit(""))
    entry = lambda a, b: F.struct(
        label(a)[0].alias("c1"), label(a)[1].alias("l1"), label(b)[0].alias("c2"), label(b)[1].alias("l2")
    )
    entries = [entry("", ""), *[entry(c, "") for c in categorical], *[entry(a, b) for a, b in combinations(categorical, 2)]]
    gram_rows = (
        cells.withColumn("e", F.explode(F.array(*entries)))
        .groupBy("_block", "e")
        .agg(*[F.sum(c).alias(c) for c in ["n", *names]])
        .collect()
    )

    labels = sorted({(r["e"]["c1"], r["e"]["l1"]) for r in gram_rows if r["e"]["c1"]},
                    key=lambda t: (list(categorical).index(t[0]), t[1]))
    for column in categorical:
        if sum(c == column for c, _ in labels) > max_labels:
            raise TooManyLabels(column, max_labels)
    terms = [ALL, *[("#", c) for c in numeric], *labels, *[("=", c) for c in targets]]
    place = {t: i for i, t in enumerate(terms)}
    value_place = [place[("#", c)] for c in numeric] + [place[("=", c)] for c in targets]
    blocks: dict[int, Gram] = {}
    for r in gram_rows:
        if r["_block"] not in blocks:
            blocks[r["_block"]] = Gram(terms, np.zeros((len(terms), len(terms))))
        m, e = blocks[r["_block"]].matrix, r["e"]
        a, b = place[(e["c1"], e["l1"])], place[(e["c2"], e["l2"])]
        m[a, b] = m[b, a] = r["n"]
        if b != 0:
            continue
        if a != 0:
            m[a, a] = r["n"]
        for k, at in enumerate(value_place):
            m[a, at] = m[at, a] = r[f"s_{k}"]
        if a == 0:
            for i, j in products:
                m[value_place[i], value_place[j]] = m[value_place[j], value_place[i]] = r[f"p_{i}_{j}"]
    return Moments(list(numeric), list(categorical), list(targets), centre, blocks)


def least_norm(gram: np.ndarray, rhs: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """Least-squares solution of smallest norm from normal equations.

    Columns are scaled to unit length before rank is judged, so a rare label is not taken for
    a dependent one; the part of the solution that lies in the null space is then removed.
    """
    diagonal = np.diag(gram)
    used = diagonal > 0
    out = np.zeros(len(rhs))
    if not used.any():
        return out
    scale = 1.0 / np.sqrt(diagonal[used])
    eigen, vectors = np.linalg.eigh(gram[np.ix_(used, used)] * np.outer(scale, scale))
    real = eigen > tolerance * eigen.max()
    coefficients = scale * (vectors[:, real] @ ((vectors[:, real].T @ (scale * rhs[used])) / eigen[real]))
    if not real.all():
        null, _ = np.linalg.qr(scale[:, None] * vectors[:, ~real])
        coefficients = coefficients - null @ (null.T @ coefficients)
    out[used] = coefficients
    return out


def solve(moments: Moments, train: Gram) -> list[LinearModel]:
    """Fit every target: numeric terms scaled on the train rows, all labels kept."""
    terms, m = train.terms, train.matrix
    n = m[0, 0]
    mean = m[0] / n
    centred = m - n * np.outer(mean, mean)
    # What is left of a constant column after centring is rounding, not spread.
    spread = np.diag(centred) > 1e-12 * np.diag(m)
    x = [i for i, t in enumerate(terms) if t[0] not in ("", "=") and (t[0] == "#" or m[i, i] > 0)]
    scale = np.array([np.sqrt(centred[i, i] / n) if t[0] == "#" and spread[i] else 1.0 for i, t in enumerate(terms)])
    centred[~spread, :] = 0.0
    centred[:, ~spread] = 0.0
    gram = centred[np.ix_(x, x)] / np.outer(scale[x], scale[x])
    models = []
    for target in moments.targets:
        y = terms.index(("=", target))
        beta = least_norm(gram, centred[x, y] / scale[x])
        model = LinearModel(target, 0.0)
        intercept = mean[y] + moments.centre[target]
        for i, coef in zip(x, beta):
            kind, name = terms[i]
            if kind == "#":
                model.numeric[name] = (moments.centre[name] + mean[i], scale[i], float(coef))
            else:
                intercept -= mean[i] * coef
                model.effects.setdefault(kind, {})[name] = float(coef)
        model.intercept = float(intercept)
        models.append(model)
    return models


def block_r2(moments: Moments, model: LinearModel, block: Gram) -> float:
    """R2 of a model on a block, from the block's sums alone."""
    terms, m = block.terms, block.matrix
    weights = np.zeros(len(terms))
    weights[0] = model.intercept - moments.centre[model.target]
    for i, (kind, name) in enumerate(terms):
        if kind == "#":
            mean, scale, coef = model.numeric[name]
            weights[i] = coef / scale
            weights[0] -= coef / scale * (mean - moments.centre[name])
        elif kind not in ("", "="):
            weights[i] = model.effects.get(kind, {}).get(name, 0.0)
    y = terms.index(("=", model.target))
    weights[y] = -1.0
    error = float(weights @ m @ weights)
    total = float(m[y, y] - m[0, y] ** 2 / m[0, 0])
    return 1.0 - error / total if total > 0 else float("nan")


def fit(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], targets: Sequence[str]
) -> list[LinearModel]:
    moments = collect_moments(df, numeric, categorical, targets)
    return solve(moments, moments.total())


def fold_scores(moments: Moments, folds: Mapping[int, Gram]) -> list[tuple[int, str, float]]:
    """(fold, target, R2): every fold scored by the fit on the others, all from sums."""
    grams = list(folds.values())
    total = sum(grams[1:], grams[0])
    return [
        (fold, model.target, float(block_r2(moments, model, gram)))
        for fold, gram in sorted(folds.items())
        for model in solve(moments, total - gram)
    ]


FOLD_SCORES = "fold int, target string, r2 double"


def cross_validate(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    targets: Sequence[str],
    order_by: Sequence[str],
    folds: int = 5,
) -> DataFrame:
    """R2 per fold and target over contiguous folds, refitting scale and labels each time.

    After the fold cuts are found, one pass gives the sums of every fold; training on the
    others is a subtraction and scoring is arithmetic on sums.
    """
    numbered = contiguous_folds(df, order_by, folds, "_fold")
    moments = collect_moments(numbered, numeric, categorical, targets, "_fold")
    return df.sparkSession.createDataFrame(fold_scores(moments, moments.blocks), FOLD_SCORES)


def fit_holdout_and_folds(
    df: DataFrame,
    is_test: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    targets: Sequence[str],
    order_by: Sequence[str],
    folds: int = 5,
) -> tuple[list[LinearModel], DataFrame]:
    """Models of the train rows and the fold scores of all rows, from the same pass.

    Rows are summed by fold and by side of the split; either grouping is a sum of those blocks.
    """
    numbered = contiguous_folds(df, order_by, folds, "_fold")
    blocked = numbered.withColumn("_side", F.col("_fold") * 2 + F.col(is_test).cast("int"))
    moments = collect_moments(blocked, numeric, categorical, targets, "_side")
    train = [gram for block, gram in moments.blocks.items() if block % 2 == 0]
    by_fold: dict[int, Gram] = {}
    for block, gram in moments.blocks.items():
        by_fold[block // 2] = by_fold[block // 2] + gram if block // 2 in by_fold else gram
    models = solve(moments, sum(train[1:], train[0]))
    return models, df.sparkSession.createDataFrame(fold_scores(moments, by_fold), FOLD_SCORES)
