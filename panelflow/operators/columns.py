"""Schema work: names are settled on the driver, rows see one projection."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelflow.functions.text import to_integer, to_number


def clean_name(name: str) -> str:
    return name.removeprefix("﻿").strip().lower()


def first_of_each(names: Sequence[str]) -> list[int]:
    """Positions of the first column of each name."""
    seen: dict[str, int] = {}
    for position, name in enumerate(names):
        seen.setdefault(name, position)
    return list(seen.values())


def settle_names(
    df: DataFrame, names: Sequence[str], rename: Callable[[str], str] = lambda name: name
) -> DataFrame:
    """Name the columns by position, rename them, and keep the first column of each name."""
    final = [rename(clean_name(n)) for n in names]
    plain = df.toDF(*[f"_{i}" for i in range(len(final))])
    return plain.select(*[F.col(f"_{i}").alias(final[i]) for i in first_of_each(final)])


def normalize_names(df: DataFrame) -> DataFrame:
    return settle_names(df, df.columns)


def by_alias(aliases: Mapping[str, str]) -> Callable[[str], str]:
    return lambda name: aliases.get(name, name)


def by_regex(patterns: Mapping[str, str]) -> Callable[[str], str]:
    """Renamer: the first pattern that covers the whole name gives the new one."""
    compiled = [(re.compile(p, re.IGNORECASE), new) for p, new in patterns.items()]

    def rename(name: str) -> str:
        return next((new for pattern, new in compiled if pattern.fullmatch(name)), name)

    return rename


def alias_rename(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    return settle_names(df, df.columns, by_alias(aliases))


def regex_rename(df: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    return settle_names(df, df.columns, by_regex(patterns))


def missing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in wanted if c not in have]


def default_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column only where the frame lacks it."""
    return df if name in df.columns else df.withColumn(name, value)


def coerce(c: Column, source: T.DataType, target: T.DataType) -> Column:
    """Cast that never fails: text goes through the guarded parsers."""
    if source == target:
        return c
    if isinstance(source, T.StringType):
        if isinstance(target, (T.DoubleType, T.FloatType)):
            return to_number(c).cast(target)
        if isinstance(target, (T.IntegerType, T.LongType)):
            return to_integer(c, target.simpleString())
    return c.try_cast(target)


def conform(df: DataFrame, schema: T.StructType, extra: Sequence[str] = ()) -> DataFrame:
    """Exactly the declared columns, in order and type; missing ones are null."""
    have = {f.name: f.dataType for f in df.schema}
    declared = [
        (coerce(F.col(f.name), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(
            f.name
        )
        for f in schema
    ]
    return df.select(*declared, *extra)
