"""Glossary sheets of many workbooks to one dictionary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from panelflow.functions.text import strip_infix
from panelflow.operators.sheets import consolidate_glossary, glossary_rows, split_by_mark
from panelflow.presets import LEVELS


@dataclass
class Dictionary:
    table: DataFrame
    parts: dict[str, DataFrame]


def build_dictionary(cells: DataFrame, origins: Sequence[str], generic: bool = False) -> Dictionary:
    """Dictionary of all sheets in a cell table, whole and split by origin.

    With ``generic`` the level is dropped from variable names, so that one variable of four
    levels is one entry.
    """
    rows = glossary_rows(cells, origins)
    if generic:
        rows = rows.withColumn("variable", strip_infix("variable", LEVELS))
    table = consolidate_glossary(rows).orderBy("variable")
    return Dictionary(table, split_by_mark(table, origins))
