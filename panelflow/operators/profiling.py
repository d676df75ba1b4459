"""Descriptive statistics.  Each function is one or two passes with partial aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from panelflow.functions.numbers import round_to
from panelflow.operators.ranks import PERCENTILE_ROWS, exact_quantiles, missing
from panelflow.operators.sized import join_written


def _lines(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn the structs of a one-row aggregate into rows."""
    named = [s.alias(f"line_{i}") for i, s in enumerate(structs)]
    row = df.agg(*named)
    return row.select(F.explode(F.array(*row.columns)).alias("line")).select("line.*")


def null_counts(df: DataFrame) -> DataFrame:
    return _lines(
        df, [F.struct(F.lit(c).alias("variable"), F.count_if(F.col(c).isNull()).alias("nulls")) for c in df.columns]
    )


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every value of every column with its row count, null included."""
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(F.explode(pairs).alias("pair"))
        .select("pair.*")
        .groupBy("variable", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy("variable", "value")
    )


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def describe(df: DataFrame, columns: Sequence[str], digits: int = 2, percentile_rows: int = PERCENTILE_ROWS) -> DataFrame:
    """count, mean, sample std, min, quartiles and max of each column, rounded.

    NaN is a missing value throughout.  A column without values is a row with count 0.
    """
    x = missing
    basics = _lines(
        df,
        [
            F.struct(
                F.lit(c).alias("variable"),
                F.count(x(c)).alias("count"),
                F.avg(x(c)).alias("mean"),
                F.stddev_samp(x(c)).alias("std"),
                F.min(x(c)).alias("min"),
                F.max(x(c)).alias("max"),
            )
            for c in columns
        ],
    )
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75], percentile_rows=percentile_rows)
    joined = basics.join(quartiles.select("variable", "q"), "variable", "left")
    cell = lambda c: round_to(c, digits)
    return joined.select(
        "variable",
        "count",
        cell(F.col("mean")).alias("mean"),
        cell(F.col("std")).alias("std"),
        cell(F.col("min")).alias("min"),
        cell(F.get("q", F.lit(0))).alias("p25"),
        cell(F.get("q", F.lit(1))).alias("p50"),
        cell(F.get("q", F.lit(2))).alias("p75"),
        cell(F.col("max")).alias("max"),
    )


def pearson(a: Column, b: Column) -> Column:
    """Aggregate: correlation over the rows that have both values, null if either is constant.

    ``corr`` itself fails on a constant column in ANSI mode.
    """
    return F.try_divide(F.regr_sxy(a, b), F.sqrt(F.regr_sxx(a, b) * F.regr_syy(a, b)))


def correlations(df: DataFrame, columns: Sequence[str], pairs_per_pass: int = 8) -> DataFrame:
    """Pearson matrix in long form; a null or NaN leaves only the pairs of its column.

    A few pairs share one aggregation: with many, the generated code grows past what the JVM
    compiles and runs ten times slower than a second scan of the few columns.
    """
    x = missing
    pairs = list(combinations(columns, 2))
    varies = lambda c: F.when(F.min(x(c)) < F.max(x(c)), F.lit(1.0))
    parts = [_lines(df, [F.struct(F.lit(c).alias("var_a"), F.lit(c).alias("var_b"), varies(c).alias("r")) for c in columns])]
    for start in range(0, len(pairs), pairs_per_pass):
        some = pairs[start : start + pairs_per_pass]
        half = _lines(
            df, [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), pearson(x(a), x(b)).alias("r")) for a, b in some]
        )
        both = F.explode(F.array(
            F.struct(F.col("a").alias("var_a"), F.col("b").alias("var_b"), "r"),
            F.struct(F.col("b").alias("var_a"), F.col("a").alias("var_b"), "r"),
        ))
        parts.append(half.select(both.alias("p")).select("p.*"))
    return reduce(DataFrame.unionByName, parts)


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Equal-width counts over [min, max], the last bin closed, empty bins present.

    A value is placed by division and then checked against the bin edges, so that counts do
    not depend on how the division rounds.  The range is a one-row scalar subquery; a single
    distinct value gets a range of one around it.
    """
    x = F.col(column).cast("double")
    values = df.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("x"))
    flat = F.min("x") == F.max("x")
    ends = values.agg(
        F.struct(
            F.when(flat, F.min("x") - 0.5).otherwise(F.min("x")).alias("lo"),
            F.when(flat, F.max("x") + 0.5).otherwise(F.max("x")).alias("hi"),
        ).alias("ends")
    )
    ranged = values.withColumn("e", ends.scalar())
    lo, width = F.col("e.lo"), F.col("e.hi") - F.col("e.lo")
    step = width / bins
    guess = ranged.withColumn("b", F.least(F.floor((F.col("x") - lo) / width * bins), F.lit(bins - 1)))
    below = F.col("x") < lo + F.col("b") * step
    above = (F.col("x") >= lo + (F.col("b") + 1) * step) & (F.col("b") < bins - 1)
    placed = guess.select(F.when(below, F.col("b") - 1).when(above, F.col("b") + 1).otherwise(F.col("b")).alias("bin"))
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("rows"))
    all_bins = df.sparkSession.range(bins).withColumnRenamed("id", "bin").withColumn("e", ends.scalar())
    edge = lambda b: F.col("e.lo") + b * ((F.col("e.hi") - F.col("e.lo")) / bins)
    return all_bins.join(counts, "bin", "left").select(
        (F.col("bin") + 1).alias("bin"),
        edge(F.col("bin")).alias("bin_lo"),
        F.when(F.col("bin") == bins - 1, F.col("e.hi")).otherwise(edge(F.col("bin") + 1)).alias("bin_hi"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )


def box_stats(
    df: DataFrame, category: str, column: str, reach: float = 1.5, percentile_rows: int = PERCENTILE_ROWS
) -> DataFrame:
    """Quartiles, whiskers and outlier count per category; NaN is a missing value.

    Whiskers end at the most extreme value within ``reach`` quartile distances, and never
    inside the box.
    """
    points = df.where(F.col(category).isNotNull()).select(category, missing(column).alias("x")).where(F.col("x").isNotNull())
    quartiles = exact_quantiles(points, ["x"], [0.25, 0.5, 0.75], by=[category], percentile_rows=percentile_rows)
    q = lambda i: F.get("q", F.lit(i))
    boxes = quartiles.select(category, q(0).alias("q1"), q(1).alias("median"), q(2).alias("q3"))
    reachable = F.col("x").between(
        F.col("q1") - reach * (F.col("q3") - F.col("q1")), F.col("q3") + reach * (F.col("q3") - F.col("q1"))
    )
    return (
        join_written(points, boxes, [category])
        .groupBy(category, "q1", "median", "q3")
        .agg(
            F.min(F.when(reachable, F.col("x"))).alias("low"),
            F.max(F.when(reachable, F.col("x"))).alias("high"),
            F.count_if(~reachable).alias("outliers"),
            F.count(F.lit(1)).alias("rows"),
        )
        .select(
            category,
            "rows",
            "q1",
            "median",
            "q3",
            F.least("low", "q1").alias("whisker_lo"),
            F.greatest("high", "q3").alias("whisker_hi"),
            "outliers",
        )
    )


def joint_range(df: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest and largest value over two columns."""
    return df.agg(
        F.least(F.min(a), F.min(b)).alias("lo"),
        F.greatest(F.max(a), F.max(b)).alias("hi"),
    )


def spread(df: DataFrame, column: str) -> DataFrame:
    """Mean and population standard deviation."""
    return df.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))


def scatter(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(indicator, x, y) points, one row per row and feature."""
    points = F.array(*[
        F.struct(F.lit(c).alias("indicator"), F.col(c).cast("double").alias("x")) for c in features
    ])
    return df.select(F.explode(points).alias("p"), F.col(target).cast("double").alias("y")).select(
        "p.indicator", "p.x", "y"
    )


def scatter_cells(df: DataFrame, features: Sequence[str], target: str, x_width: dict[str, float], y_width: float) -> DataFrame:
    """Scatter points counted in a grid of declared cell sizes: what a chart of a large table needs."""
    widths = F.create_map(*[v for c in features for v in (F.lit(c), F.lit(float(x_width[c])))])
    points = scatter(df, features, target).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return (
        points.select(
            "indicator",
            F.floor(F.col("x") / F.element_at(widths, F.col("indicator"))).alias("x_cell"),
            F.floor(F.col("y") / float(y_width)).alias("y_cell"),
        )
        .groupBy("indicator", "x_cell", "y_cell")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
