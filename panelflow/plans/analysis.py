"""Joined panel to cleaned table, profile, fitted models and their comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelflow.functions.text import rank_of
from panelflow.operators.cleaning import drop_outliers, nullify, recode_columns
from panelflow.operators.columns import alias_rename, conform, normalize_names
from panelflow.operators.modelling import (
    LinearModel,
    coefficient_table,
    compare_targets,
    fit_holdout_and_folds,
    holdout_split,
    metric_lines,
    residuals,
    top_effects,
)
from panelflow.operators.profiling import box_stats, correlations, describe, histogram, joint_range, scatter
from panelflow.operators.reshape import panel_join
from panelflow.operators.sized import written
from panelflow.presets import (
    ANALYSIS_LEVEL,
    ANALYSIS_NUMERIC,
    ANALYSIS_RENAMES,
    ANALYSIS_SCHEMA,
    ANALYSIS_TARGETS,
    DEPENDENCY_LABELS,
    GROUP_LABELS,
    GROUP_ORDER,
    PANEL_KEYS,
    RURAL_LABELS,
)

LABELS = {"cod_grupo": GROUP_LABELS, "cod_depe2": DEPENDENCY_LABELS, "cod_rural_rbd": RURAL_LABELS}


def join_panel(scores: DataFrame, indicators: DataFrame) -> DataFrame:
    """Scores with their indicators, on entity, year and level."""
    return panel_join(scores, indicators, PANEL_KEYS)


def analysis_table(joined: DataFrame, level: str = ANALYSIS_LEVEL) -> DataFrame:
    """The rows of one level under the names of the analysis table."""
    named = alias_rename(joined.where(F.col("curso") == level), ANALYSIS_RENAMES)
    return conform(named, ANALYSIS_SCHEMA)


def read_analysis_table(spark: SparkSession, path: str) -> DataFrame:
    """The analysis table from a comma file with a header, in its declared types."""
    texts = normalize_names(spark.read.option("escape", '"').csv(path, header=True))
    return conform(nullify(texts, stripped=False), ANALYSIS_SCHEMA)


def clean_panel(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Labels for codes, complete rows only, outlying targets out.

    The complete rows are written once: every fence reads them there, and so does what follows.
    """
    return drop_outliers(written(recode_columns(df, LABELS).dropna()), targets)


@dataclass
class Profile:
    """What the charts of the cleaned table show."""

    summary: DataFrame
    histograms: dict[str, DataFrame]
    boxes: dict[tuple[str, str], DataFrame]
    correlations: DataFrame
    scatter: dict[str, DataFrame]


def profile_panel(
    df: DataFrame,
    targets: Sequence[str] = ANALYSIS_TARGETS,
    numeric: Sequence[str] = ANALYSIS_NUMERIC,
    categorical: Sequence[str] = ("cod_grupo", "cod_depe2"),
    orders: Mapping[str, Sequence[str]] = {"cod_grupo": GROUP_ORDER},
    bins: int = 40,
) -> Profile:
    """Descriptive statistics, distributions and correlations of a cleaned panel.

    The frame is read many times: write it first if joins stand behind it.  Categories with a
    declared order come with their ``place`` in it.
    """

    def boxes(category: str, target: str) -> DataFrame:
        table = box_stats(df, category, target)
        if category not in orders:
            return table
        return table.withColumn("place", rank_of(category, orders[category])).orderBy("place")

    return Profile(
        describe(df, [*targets, *numeric]),
        {t: histogram(df, t, bins) for t in targets},
        {(c, t): boxes(c, t) for c in categorical for t in targets},
        correlations(df, [*targets, *numeric]),
        {t: scatter(df, numeric, t) for t in targets},
    )


@dataclass
class Fitted:
    models: list[LinearModel]
    coefficients: DataFrame
    scored: DataFrame
    fold_scores: DataFrame
    comparison: DataFrame


def fit_and_compare(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    targets: Sequence[str],
    key: Column | str,
    order_by: Sequence[str],
    percent: int = 20,
    salt: str = "",
    folds: int = 5,
) -> Fitted:
    """Fit every target on the train rows, score the hold-out, cross-validate, compare.

    The columns in use are written once, so the joins behind the panel run once; the fold cuts,
    the means, the sums and the hold-out metrics each scan that narrow table.  All targets, the
    train rows and the folds share one pass of sums.
    """
    needed = list(dict.fromkeys([*order_by, *numeric, *categorical, *targets]))
    panel = written(holdout_split(df, key, percent, salt, "is_test").select("is_test", *needed))
    models, fold_scores = fit_holdout_and_folds(panel, "is_test", numeric, categorical, targets, order_by, folds)
    scored = panel.where("is_test")
    for model in models:
        scored = model.predict(scored)
    lines = metric_lines(scored, {t: (t, f"predicted_{t}") for t in targets})
    cv = fold_scores.groupBy("target").agg(F.avg("r2").alias("value"))
    all_lines = lines.unionByName(cv.select(F.lit("R2_CV").alias("metric"), "target", "value"))
    return Fitted(
        models, coefficient_table(df.sparkSession, models), scored, fold_scores, compare_targets(all_lines, targets)
    )


@dataclass
class Interpretation:
    """What the charts of a fitted target show."""

    top: DataFrame
    points: DataFrame
    line: DataFrame
    residuals: DataFrame


def interpret(fitted: Fitted, target: str, bins: int = 40, k: int = 5) -> Interpretation:
    """Largest effects, hold-out points with their identity line, and residual histogram."""
    predicted = f"predicted_{target}"
    points = written(residuals(fitted.scored.select(target, predicted), target, predicted))
    effects = fitted.coefficients.where((F.col("target") == target) & (F.col("position") > 0))
    return Interpretation(
        top_effects(effects.select("term", "coefficient"), k=k),
        points,
        joint_range(points, target, predicted),
        histogram(points, "residual", bins),
    )
