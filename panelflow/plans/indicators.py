"""Yearly indicator files, wide or long, to one wide table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelflow.functions.filenames import base_name, is_main_file, level_of_folder, parent_folder, year_in
from panelflow.functions.text import to_number
from panelflow.operators.cleaning import cleaning_audit, nullify
from panelflow.operators.columns import by_alias, coerce, conform
from panelflow.operators.reshape import code_of, detail_to_wide, keep_last, merge_details, stack_tables, widen
from panelflow.operators.sized import written
from panelflow.plans.scores import PLACE, Consolidated, placed_nowhere
from panelflow.presets import (
    DETAIL_PAIRS,
    INDICATOR_ALIASES,
    INDICATOR_SCHEMA,
    INDICATORS,
    NUMERIC_INDICATOR_CODES,
    PANEL_KEYS,
    TEXT_INDICATOR_CODES,
)
from panelflow.sources.delimited import QUARANTINE, read_delimited
from panelflow.sources.discover import bare_path, list_files, paths_where


def _wide(frame: DataFrame) -> DataFrame:
    """One layout brought to the indicator schema, with the place of each row.

    Pivoting is per file: the same key in two files gives two rows, and the later file wins
    when keys are made unique.
    """
    name = base_name("_path")
    frame = nullify(frame, [c for c in frame.columns if c not in PLACE], stripped=False)
    year = year_in(name)
    # A file that tells its year nowhere still has one row per entity and level.
    no_year = [] if "agno" in frame.columns else ["agno"]
    if "agno" in frame.columns:
        year = F.coalesce(year, coerce(F.col("agno"), frame.schema["agno"].dataType, INDICATOR_SCHEMA["agno"].dataType))
    frame = frame.withColumns({"curso": level_of_folder(parent_folder("_path")), "agno": year})
    context = [c for c in INDICATOR_SCHEMA.names if c not in (*PANEL_KEYS, *INDICATORS)]
    wide = widen(
        frame,
        [*PANEL_KEYS, "_path"],
        TEXT_INDICATOR_CODES,
        NUMERIC_INDICATOR_CODES,
        context,
        ["_block", "_row"],
        no_year,
    )
    for column in ("_block", "_row"):
        if column not in wide.columns:
            wide = wide.withColumn(column, F.lit(0).cast("bigint"))
    return conform(wide, INDICATOR_SCHEMA, PLACE)


def add_details(indicators: DataFrame, details: DataFrame) -> DataFrame:
    """Indicator table with one column per sub-dimension.

    ``details`` is a long table of the panel keys, ``ind``, ``dim`` and ``prom``.
    """
    coded = details.select(
        *PANEL_KEYS, code_of("ind").alias("ind"), code_of("dim").alias("dim"), to_number("prom").alias("prom")
    )
    wide = detail_to_wide(coded, PANEL_KEYS, "ind", "dim", "prom", DETAIL_PAIRS)
    return merge_details(indicators, wide, PANEL_KEYS)


def indicator_files(spark: SparkSession, folder: str) -> DataFrame:
    """The main files in the level folders."""
    root = "/" + bare_path(folder).strip("/")
    grandparent = F.regexp_replace("path", r"/[^/]+/[^/]+$", "")
    return list_files(spark, folder).where(grandparent.endswith(root) & is_main_file("name"))


def read_indicators(spark: SparkSession, paths: Sequence[str], encoding: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All wide rows of some indicator files with their places, and the quarantine table."""
    reading = read_delimited(spark, paths, by_alias(INDICATOR_ALIASES), encoding)
    if not reading.frames:
        return placed_nowhere(spark, INDICATOR_SCHEMA), reading.quarantine if paths else spark.createDataFrame([], QUARANTINE)
    return stack_tables([_wide(f) for f in reading.frames]), reading.quarantine


def finish_indicators(stacked: DataFrame) -> DataFrame:
    """One row per key, the last file wins."""
    return keep_last(stacked, PANEL_KEYS, PLACE).select(*INDICATOR_SCHEMA.names)


def consolidate_indicators(spark: SparkSession, folder: str, encoding: str | None = None) -> Consolidated:
    """Indicator table of the main files in the level folders, one row per key, last file wins.

    The table is written once; its audit reads it there.
    """
    stacked, quarantine = read_indicators(spark, paths_where(indicator_files(spark, folder), F.lit(True)), encoding)
    table = written(finish_indicators(stacked))
    filled = F.lit(True)
    for measure in INDICATORS:
        filled = filled & F.col(measure).isNotNull()
    audit = cleaning_audit(table, [("all indicators present", filled)])
    return Consolidated(table, audit, quarantine)
