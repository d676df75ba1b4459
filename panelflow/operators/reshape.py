"""Long to wide, dedup, union and joins of panel tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from panelflow.functions.text import as_col, lower_strip, map_code, to_number, whole_number


def code_of(c: Column | str, codes: Iterable[str] = ()) -> Column:
    """Indicator code as the maps spell it; only maps with numeric codes need ``1.0`` to be ``1``."""
    text = lower_strip(c)
    return whole_number(text) if any(code.isdigit() for code in codes) else text


def first_filled(c: Column | str, order_by: Sequence[Column | str]) -> Column:
    """Aggregate: the first non-null value in the declared order."""
    c = as_col(c)
    return F.min_by(c, F.when(c.isNotNull(), F.struct(*[as_col(o) for o in order_by])))


def first_valid(c: Column | str, order_by: Sequence[Column | str], default: str) -> Column:
    """Aggregate: the first text that is neither null nor empty, else the default."""
    filled = F.nullif(as_col(c), F.lit(""))
    return F.coalesce(first_filled(filled, order_by), F.lit(default))


def sorted_distinct(c: Column | str, separator: str = ", ") -> Column:
    """Aggregate: the distinct texts in code-point order, joined."""
    return F.array_join(F.sort_array(F.collect_set(as_col(c))), separator)


def long_to_wide(
    df: DataFrame,
    keys: Sequence[str],
    code: str,
    value: str,
    targets: Mapping[str, str],
    context: Sequence[str] = (),
    order_by: Sequence[Column | str] = (),
    may_be_null: Sequence[str] = (),
) -> DataFrame:
    """One row per key: the mean of each target, and the first filled context values.

    One aggregation does both.  Codes that map to one target are averaged together; unmapped
    codes, null keys (but for those that may be null) and keys without a single number drop out.
    """
    if context and not order_by:
        raise ValueError("context values need a declared row order")
    names = list(dict.fromkeys(targets.values()))
    number = F.col("_value")
    coded = df.withColumns({
        "_target": map_code(code_of(code, targets), targets),
        "_value": to_number(value) if df.schema[value].dataType.simpleString() == "string" else F.col(value),
    }).where(F.col("_target").isNotNull())
    coded = reduce(lambda d, k: d.where(F.col(k).isNotNull()), [k for k in keys if k not in may_be_null], coded)
    means = [F.avg(F.when(F.col("_target") == t, number)).alias(t) for t in names]
    firsts = [first_filled(c, order_by).alias(c) for c in context]
    wide = coded.groupBy(*keys).agg(*means, *firsts)
    return wide.where(F.coalesce(*[F.col(t) for t in names]).isNotNull())


def widen(
    df: DataFrame,
    keys: Sequence[str],
    text_codes: Mapping[str, str],
    numeric_codes: Mapping[str, str],
    context: Sequence[str],
    order_by: Sequence[Column | str],
    may_be_null: Sequence[str] = (),
    value: str = "prom",
    text_column: str = "ind",
    numeric_column: str = "id_indicador",
) -> DataFrame:
    """Pivot a frame that is in long form; pass one that is wide already."""
    have = set(df.columns)
    if value not in have:
        return df
    for column, codes in ((text_column, text_codes), (numeric_column, numeric_codes)):
        if column in have:
            present = [c for c in context if c in have]
            return long_to_wide(df, [k for k in keys if k in have], column, value, codes, present, order_by, may_be_null)
    return df


def mean_by_key(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(name))


def keep_last(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key: the last in the declared order.

    Spark cuts each key to one row per input partition before the shuffle (partial group
    limit), so a key with a third of all rows reaches its task as a handful.
    """
    last_first = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order_by])
    return df.withColumn("_place", F.row_number().over(last_first)).where(F.col("_place") == 1).drop("_place")


def stack_tables(frames: Sequence[DataFrame], spark: SparkSession | None = None, schema: StructType | None = None) -> DataFrame:
    """Bag union by name; columns a frame lacks are null.  Of no frames it is the empty table of ``schema``."""
    if not frames and spark is not None and schema is not None:
        return spark.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def duplicate_keys(df: DataFrame, keys: Sequence[str], name: str = "copies") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)


REPEATED = "more than one row for "


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows; the job that reads them fails on the second row of a key.

    Rows are numbered within their key in the partitioning and order that a join on the keys
    needs anyway, so the audit costs no shuffle of its own and holds no group in memory.
    """
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    key = F.to_json(F.struct(*keys))
    once = F.when(F.col("_copy") > 1, F.raise_error(F.concat(F.lit(REPEATED), key)).cast("boolean")).otherwise(F.lit(True))
    return df.withColumn("_copy", number).where(once).drop("_copy")


def panel_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    check: Sequence[str] = ("left", "right"),
) -> DataFrame:
    """Join two keyed panels one to one.

    Other columns that both sides have come from the left side, and from the right where the
    left has null.  A repeated key would multiply rows, so the sides named in ``check`` are audited on the way; leave
    out a side that is grouped by the keys.
    """
    if "left" in check:
        left = require_unique(left, keys)
    if "right" in check:
        right = require_unique(right, keys)
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in shared})
    joined = left.join(renamed, list(keys), how)
    picked = [
        F.coalesce(F.col(c), F.col(f"_right_{c}")).alias(c) if c in shared else F.col(c)
        for c in left.columns
        if c not in keys
    ]
    added = [F.col(c) for c in right.columns if c not in shared and c not in keys]
    return joined.select(*keys, *picked, *added)


def attach_context(df: DataFrame, context: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of context columns; Spark broadcasts the context side if its files are small."""
    return df.join(context, list(keys), "left")


def detail_to_wide(
    df: DataFrame, keys: Sequence[str], code: str, detail: str, value: str, pairs: Sequence[tuple[str, str]]
) -> DataFrame:
    """Means of a finer-grained file, one column ``dim_<code>_<detail>`` per declared pair."""
    is_pair = lambda a, b: (F.col(code) == a) & (F.col(detail) == b)
    wanted = reduce(lambda acc, ab: acc | is_pair(*ab), pairs, F.lit(False))
    means = [F.avg(F.when(is_pair(a, b), F.col(value))).alias(f"dim_{a}_{b}") for a, b in pairs]
    return df.where(wanted).groupBy(*keys).agg(*means)


def merge_details(main: DataFrame, details: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the detail columns to the main table; keys without details keep nulls."""
    return main.join(details, list(keys), "left")
