"""Row filters, recodes and the audit of cleaning steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelflow.functions.text import canonical_code, lower_strip, null_tokens, recode
from panelflow.operators.ranks import PERCENTILE_ROWS, exact_quantiles


def nullify(df: DataFrame, columns: Sequence[str] | None = None, stripped: bool = True) -> DataFrame:
    """Turn the texts for "missing" into null, in all (string) columns or the given ones."""
    texts = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    chosen = texts if columns is None else set(columns)
    return df.select(*[null_tokens(c, stripped=stripped).alias(c) if c in chosen else F.col(c) for c in df.columns])


def recode_columns(df: DataFrame, maps: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Codes, in any spelling, to labels; labels and unknown codes stay."""
    return df.withColumns({c: recode(canonical_code(c), labels) for c, labels in maps.items()})


def drop_blank_texts(df: DataFrame, column: str) -> DataFrame:
    """Normalise a text column and drop rows where nothing (or ``nan``) is left."""
    return df.withColumn(column, lower_strip(column)).where(~F.col(column).isin("", "nan"))


def tukey_fence(
    df: DataFrame, column: str, reach: float = 1.5, percentile_rows: int = PERCENTILE_ROWS
) -> tuple[float | None, float | None]:
    """(low, high) bounds: quartiles stretched by ``reach`` times their distance."""
    rows = exact_quantiles(df, [column], [0.25, 0.75], percentile_rows=percentile_rows).collect()
    if not rows or rows[0]["q"] is None:
        return None, None
    q1, q3 = rows[0]["q"]
    return q1 - reach * (q3 - q1), q3 + reach * (q3 - q1)


def within(column: str, fence: tuple[float | None, float | None]) -> Column:
    low, high = fence
    return F.col(column).between(F.lit(low).cast("double"), F.lit(high).cast("double"))


def drop_outliers(
    df: DataFrame, columns: Sequence[str], reach: float = 1.5, percentile_rows: int = PERCENTILE_ROWS
) -> DataFrame:
    """Tukey fences, one column after the other.

    The fence of each column is taken on what the columns before left.  A fence is two numbers
    on the driver; as literals they reach the scan.  Every fence reads the input about twice, so
    give it a table, not a chain of joins.
    """
    for column in columns:
        df = df.where(within(column, tukey_fence(df, column, reach, percentile_rows)))
    return df


def cleaning_audit(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows before and after each step, all steps counted in one pass."""
    passed = F.lit(True)
    counts = [F.count(F.lit(1)).alias("kept_0")]
    for i, (_, keep) in enumerate(steps, 1):
        passed = passed & F.coalesce(keep, F.lit(False))
        counts.append(F.count_if(passed).alias(f"kept_{i}"))
    lines = [
        F.struct(
            F.lit(i).alias("step_no"),
            F.lit(name).alias("step"),
            F.col(f"kept_{i - 1}").alias("rows_in"),
            F.col(f"kept_{i}").alias("rows_out"),
            (F.col(f"kept_{i - 1}") - F.col(f"kept_{i}")).alias("removed"),
        )
        for i, (name, _) in enumerate(steps, 1)
    ]
    return df.agg(*counts).select(F.explode(F.array(*lines)).alias("line")).select("line.*")


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many rows have all the columns filled, and how many rows there are."""
    full = F.lit(True)
    for c in columns:
        full = full & F.col(c).isNotNull()
    return df.agg(F.count_if(full).alias("complete"), F.count(F.lit(1)).alias("total"))
