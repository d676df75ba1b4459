"""Least squares with label columns of any number of labels.

The normal equations of the labels are solved by conjugate gradients on the table of cells (one row for each combination of labels),
for the target and every numeric column at once; what is left of these gives the numeric
coefficients.  Effects stay a table with one row per label; no matrix has their number as a side, and
the driver sees a few numbers per round.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from panelflow.operators.sized import join_written, written


@dataclass
class Absorbed:
    """A fitted model; ``effects`` has factor, label and effect, of each factor with the mean 0 over its labels."""

    numeric: dict[str, float]
    intercept: float
    effects: DataFrame
    factors: tuple[str, ...]
    rounds: int

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        """The rows with their prediction; a label without effect adds nothing, a null number gives null."""
        total: Column = F.lit(self.intercept)
        for column, coefficient in self.numeric.items():
            total = total + F.col(column) * F.lit(coefficient)
        for k, factor in enumerate(self.factors):
            side = self.effects.where(F.col("factor") == factor).select(F.col("label").alias(f"_label{k}"), F.col("effect").alias(f"_effect{k}"))
            df = join_written(df.withColumn(f"_label{k}", _label(factor)), side, [f"_label{k}"], "left")
            total = total + F.coalesce(F.col(f"_effect{k}"), F.lit(0.0))
        return df.withColumn(name, total).drop(*[f"_{what}{k}" for what in ("label", "effect") for k in range(len(self.factors))])


def _label(column: str) -> Column:
    """Labels are compared as text; null is a label of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _dot(a: str, b: str, width: int) -> list[Column]:
    return [F.sum(F.col(a)[j] * F.col(b)[j]) for j in range(width)]


def _arrays(width: int, of) -> Column:
    return F.array(*[of(j) for j in range(width)])


def fit_absorbed(
    df: DataFrame, numeric: Sequence[str], factors: Sequence[str], target: str, tolerance: float = 1e-12, most_rounds: int = 500
) -> Absorbed:
    """Ordinary least squares on numeric columns, an intercept, and one column per label of each factor.

    Rows with a null number are left out; null labels are a label.  Of the solutions that fit equally well it is the one whose
    effects have the mean 0 within each factor: the one of least norm, if the labels are connected by rows (else
    the predictions are still the same).  A numeric column that the labels determine has the coefficient 0.
    A round is a join and a grouping of the cells per factor; rounds follow how unevenly labels meet, not how many there are.
    """
    spark, width, names = df.sparkSession, len(numeric) + 1, [*numeric, target]
    for c in names:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    labels = [f"l{k}" for k in range(len(factors))]
    plain = df.select(*[_label(f).alias(k) for f, k in zip(factors, labels)], *[F.col(c).cast("double").alias(f"v{j}") for j, c in enumerate(names)])
    first = plain.agg(F.count(F.lit(1)), *[F.avg(f"v{j}") for j in range(width)]).first()
    rows, means = first[0], list(first)[1:]
    if not rows:
        raise ValueError("no rows without nulls")
    centred = [F.col(f"v{j}") - F.lit(means[j]) for j in range(width)]
    cells = written(plain.groupBy(*labels).agg(F.count(F.lit(1)).cast("double").alias("n"), F.array(*[F.sum(c) for c in centred]).alias("s")))
    squares = plain.agg(*[F.sum(centred[a] * centred[b]) for a in range(width) for b in range(width)]).first()
    gram = np.array(list(squares), float).reshape(width, width)

    def by_label(table: DataFrame, values: Column, extra: Sequence[Column] = ()) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(k).alias("factor"), F.col(c).alias("label")) for k, c in enumerate(labels)])
        long = table.select(F.explode(pairs).alias("p"), values.alias("x"), *extra).select("p.*", "x", *[e for e in ("n",) if extra])
        sums = [_arrays(width, lambda j: F.sum(F.col("x")[j])).alias("q")] + ([F.sum("n").alias("n")] if extra else [])
        return long.groupBy("factor", "label").agg(*sums)

    def spread(vector: DataFrame, column: str) -> DataFrame:
        """Cells with the sum of their labels' entries as ``t``."""
        table = cells
        for k, c in enumerate(labels):
            side = vector.where(F.col("factor") == k).select(F.col("label").alias(c), F.col(column).alias(f"e{k}"))
            table = table.join(side, c)
        total = lambda j: sum((F.col(f"e{k}")[j] for k in range(1, len(labels))), F.col("e0")[j])
        return table.withColumn("t", _arrays(width, total))

    zero = F.array(*[F.lit(0.0)] * width)
    scaled = F.transform("r", lambda x: x / F.col("n"))
    state = by_label(cells, F.col("s"), [F.col("n")]).select("factor", "label", "n", zero.alias("e"), F.col("q").alias("r"))
    state = written(state.withColumn("d", scaled))
    size = np.array(list(state.agg(*_dot("r", "d", width)).first()), float)
    start, rounds = size.copy(), 0
    while rounds < most_rounds and (size > tolerance**2 * np.maximum(start, 1e-300)).any():
        rounds += 1
        moved = by_label(spread(state, "d"), F.transform("t", lambda x: x * F.col("n")))
        stepped = written(state.join(moved, ["factor", "label"]))
        along = np.array(list(stepped.agg(*_dot("d", "q", width)).first()), float)
        live = (size > tolerance**2 * np.maximum(start, 1e-300)) & (along > 0)
        step = np.where(live, size / np.where(live, along, 1), 0)
        moved_on = stepped.select(
            "factor", "label", "n", "d",
            _arrays(width, lambda j: F.col("e")[j] + F.lit(float(step[j])) * F.col("d")[j]).alias("e"),
            _arrays(width, lambda j: F.col("r")[j] - F.lit(float(step[j])) * F.col("q")[j]).alias("r"),
        ).withColumn("z", scaled)
        after = np.array(list(moved_on.agg(*_dot("r", "z", width)).first()), float)
        share = np.where(live, after / np.maximum(size, 1e-300), 0)
        state = written(moved_on.select(
            "factor", "label", "n", "e", "r", _arrays(width, lambda j: F.col("z")[j] + F.lit(float(share[j])) * F.col("d")[j]).alias("d")
        ))
        size = np.where(live, after, size * live)

    effects = state.select("factor", "label", "n", "e")
    left = spread(effects, "e")
    explained = left.agg(*[F.sum(F.col("s")[a] * F.col("t")[b]) for a in range(width) for b in range(width)]).first()
    rest = gram - np.array(list(explained), float).reshape(width, width)
    own = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    inner = (rest + rest.T) / 2 / np.outer(own, own)
    beta = np.linalg.lstsq(inner[:-1, :-1], inner[:-1, -1], rcond=1e-10)[0] * own[-1] / own[:-1] if numeric else np.zeros(0)
    effect = sum((F.lit(-float(b)) * F.col("e")[j] for j, b in enumerate(beta)), F.col("e")[width - 1])
    found = written(effects.select("factor", "label", "n", effect.alias("effect")))
    middles = {r["factor"]: (r["plain"], r["weighed"]) for r in found.groupBy("factor").agg(F.avg("effect").alias("plain"), (F.sum(F.col("effect") * F.col("n")) / rows).alias("weighed")).collect()}
    shift = F.create_map(*[x for k, (plain_mean, _) in middles.items() for x in (F.lit(k), F.lit(plain_mean))])
    name = F.element_at(F.array(*[F.lit(f) for f in factors]), F.col("factor") + 1)
    centred_effects = found.select(name.alias("factor"), "label", (F.col("effect") - shift[F.col("factor")]).alias("effect"))
    # centred numbers: the mean of the target is met where every column has its mean
    intercept = means[-1] - float(np.dot(beta, means[:-1])) - sum(w - p for p, w in middles.values())
    return Absorbed(dict(zip(numeric, map(float, beta))), intercept, written(centred_effects), tuple(factors), rounds)
