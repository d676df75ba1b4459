"""Glossary sheets as a cell table: (origin, file, sheet, [sheet_idx,] row_idx, col_idx, value).

``sheet_idx`` is the place of the sheet in its workbook; without it sheets go by their name.  The table is dense: a blank cell is a row with a null value, so that a blank line is seen.

Finding the header of a sheet and cutting it at the first blank are per-sheet minima, so each
is an aggregate with one row per sheet, joined back to the cells.  No sheet is ever gathered in
one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelflow import presets
from panelflow.functions.filenames import file_facts
from panelflow.functions.text import (
    classify_by_words,
    contains_any,
    contains_ignore_case,
    lower_strip,
    override_by_words,
    template,
)
from panelflow.operators.reshape import first_valid
from panelflow.operators.sized import join_written, written

SHEET = ["origin", "file", "sheet"]


def melt_cells(df: DataFrame, keys: Sequence[str], row: str, cells: Sequence[Column]) -> DataFrame:
    """A table as cells: one row per (key, row, column position)."""
    each = F.posexplode(F.array(*[c.cast("string") for c in cells])).alias("col_idx", "value")
    return df.select(*keys, F.col(row).alias("row_idx"), each)


def drop_index_sheets(cells: DataFrame) -> DataFrame:
    """Leave out lock files and sheets that only list other sheets."""
    return cells.where(
        ~F.col("file").startswith(presets.LOCK_FILE_PREFIX)
        & ~contains_ignore_case("sheet", presets.INDEX_SHEET_MARK)
    )


def skip_until(rows: DataFrame, keys: Sequence[str], row: str, is_header: Column) -> DataFrame:
    """Rows after the first header row of their group; groups without one drop out."""
    heads = rows.where(is_header).groupBy(*keys).agg(F.min(row).alias("_header"))
    return join_written(rows, heads, keys).where(F.col(row) > F.col("_header")).drop("_header")


def take_while(rows: DataFrame, keys: Sequence[str], row: str, is_end: Column) -> DataFrame:
    """Rows before the first end row of their group, all rows where there is none."""
    cuts = rows.where(is_end).groupBy(*keys).agg(F.min(row).alias("_cut"))
    kept = join_written(rows, cuts, keys, "left")
    return kept.where(F.col("_cut").isNull() | (F.col(row) < F.col("_cut"))).drop("_cut")


def header_rows(cells: DataFrame) -> DataFrame:
    """Header row of each sheet.

    The top row counts if any of its cells contains a header word; otherwise the first row one
    of whose first three cells is exactly a header phrase.  Sheets with neither drop out.
    """
    text = lower_strip("value")
    top = F.min("row_idx")
    at_top = F.min(F.when(contains_any(text, presets.TOP_HEADER_WORDS), F.col("row_idx")))
    exact = F.min(
        F.when((F.col("col_idx") < 3) & text.isin(presets.HEADER_PHRASES), F.col("row_idx"))
    )
    found = cells.groupBy(*SHEET).agg(top.alias("top"), at_top.alias("at_top"), exact.alias("exact"))
    header = F.when(F.col("at_top") == F.col("top"), F.col("top")).otherwise(F.col("exact"))
    return found.select(*SHEET, header.alias("header_row")).where(F.col("header_row").isNotNull())


def header_class(c: Column | str) -> Column:
    return classify_by_words(
        c, {"variable": presets.VARIABLE_WORDS, "descripcion": presets.DESCRIPTION_WORDS}
    )


def value_columns(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Positions of the variable and the description column of each sheet.

    The first column of each class counts; without both classes the first two columns stand in.
    Sheets of one column drop out.
    """
    head = join_written(cells, headers, SHEET).where(F.col("row_idx") == F.col("header_row"))
    kind = header_class("value")
    spots = head.groupBy(*SHEET, "header_row").agg(
        F.min(F.when(kind == "variable", F.col("col_idx"))).alias("v"),
        F.min(F.when(kind == "descripcion", F.col("col_idx"))).alias("d"),
    )
    widths = cells.groupBy(*SHEET).agg(F.max("col_idx").alias("last"), F.min("col_idx").alias("first"))
    both = F.col("v").isNotNull() & F.col("d").isNotNull()
    return (
        spots.join(widths, SHEET)
        .where(F.col("last") > F.col("first"))
        .select(
            *SHEET,
            "header_row",
            F.when(both, F.col("v")).otherwise(F.col("first")).alias("v"),
            F.when(both, F.col("d")).otherwise(F.col("first") + 1).alias("d"),
        )
    )


def first_two_columns(cells: DataFrame, keys: Sequence[str], row: str = "row_idx") -> DataFrame:
    """Rows of headerless sheets: the first column is the variable, the second its description."""
    at = lambda i: F.max(F.when(F.col("col_idx") == i, F.col("value")))
    return (
        cells.where(F.col("col_idx").isin(0, 1))
        .groupBy(*keys, row)
        .agg(at(0).alias("variable"), at(1).alias("descripcion"))
    )


def sheet_context(prefixes: Sequence[str]) -> Column:
    """``origin_level_year_sheet``; a level in the sheet name wins over the file name's."""
    level, year = file_facts("file", prefixes)
    return template("origin", override_by_words("sheet", presets.LEVELS, level), year, "sheet")


def declared_place(origin: Column | str, origins: Sequence[str]) -> Column:
    """Place of an origin in the declared order; origins that are not declared come last."""
    found = F.array_position(F.array(*[F.lit(o) for o in origins]), F.col(origin) if isinstance(origin, str) else origin)
    return F.when(found > 0, found).otherwise(len(origins) + 1)


def glossary_rows(cells: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """(variable, descripcion, contexto, place) rows of every sheet, cut at its first blank variable.

    ``place`` is the reading order: origins as declared, files by name, sheets as in the
    workbook, rows from the top.
    """
    if "sheet_idx" not in cells.columns:
        cells = cells.withColumn("sheet_idx", F.lit(0))
    wanted = drop_index_sheets(cells)
    spots = value_columns(wanted, header_rows(wanted))
    inside = join_written(wanted, spots, SHEET).where(
        (F.col("row_idx") > F.col("header_row")) & F.col("col_idx").isin(F.col("v"), F.col("d"))
    )
    rows = written(
        inside.groupBy(*SHEET, "row_idx").agg(
            F.max(F.when(F.col("col_idx") == F.col("v"), F.col("value"))).alias("variable"),
            F.max(F.when(F.col("col_idx") == F.col("d"), F.col("value"))).alias("descripcion"),
            F.min("sheet_idx").alias("sheet_idx"),
        )
    )
    name = lower_strip("variable")
    blank = F.col("variable").isNull() | (name == "") | (F.lower("variable") == "nan")
    return (
        take_while(rows, SHEET, "row_idx", blank)
        .where(~name.isin("", "nan"))
        .select(
            name.alias("variable"),
            "descripcion",
            sheet_context(prefixes).alias("contexto"),
            F.struct(declared_place("origin", prefixes).alias("at"), "origin", "file", "sheet_idx", "sheet", "row_idx").alias("place"),
        )
    )


def consolidate_glossary(
    rows: DataFrame,
    variable: str = "variable",
    description: str = "descripcion",
    context: str = "contexto",
    order_by: Sequence[str] = ("place",),
    default: str = presets.NO_DESCRIPTION,
) -> DataFrame:
    """One row per variable: its first real description and the sorted list of its contexts.

    Repeated (variable, context) pairs are folded before the list is built, so a variable that
    fills much of the table costs one row per context.
    """
    pairs = rows.groupBy(variable, context).agg(
        F.min_by(
            F.struct(F.nullif(F.col(description), F.lit("")).alias("text"), F.struct(*order_by).alias("at")),
            F.when(F.nullif(F.col(description), F.lit("")).isNotNull(), F.struct(*order_by)),
        ).alias("first")
    )
    return pairs.groupBy(variable).agg(
        first_valid("first.text", ["first.at"], default).alias(description),
        F.array_join(F.sort_array(F.collect_list(context)), ", ").alias("archivos_presentes"),
    )


def split_by_mark(glossary: DataFrame, marks: Sequence[str], column: str = "archivos_presentes") -> dict[str, DataFrame]:
    """One overlapping subset per mark; a variable of several origins is in each of them."""
    return {mark: glossary.where(contains_ignore_case(column, mark)) for mark in marks}
