"""Yearly score files to one table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from panelflow.functions.filenames import base_name, is_entity_file, level_in, year_in
from panelflow.operators.cleaning import cleaning_audit, nullify
from panelflow.operators.columns import by_regex, conform, default_column
from panelflow.operators.reshape import keep_last, stack_tables
from panelflow.operators.sized import written
from panelflow.presets import PANEL_KEYS, SCORE_RENAMES, SCORE_SCHEMA, SCORE_TARGETS
from panelflow.sources.delimited import QUARANTINE, read_delimited
from panelflow.sources.discover import list_files, paths_where

PLACE = ["_path", "_block", "_row"]


@dataclass
class Consolidated:
    table: DataFrame
    audit: DataFrame
    quarantine: DataFrame


def stacked_scores(frames: list[DataFrame], prefix: str = "") -> DataFrame:
    """Frames of any year brought to the score schema; key columns a file lacks come from its name."""
    ready = []
    for frame in frames:
        name = base_name("_path")
        frame = nullify(frame, [c for c in frame.columns if c not in PLACE], stripped=False)
        frame = default_column(frame, "curso", level_in(name, prefix))
        frame = default_column(frame, "agno", year_in(name))
        ready.append(conform(frame, SCORE_SCHEMA, PLACE))
    return stack_tables(ready)


def score_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files that hold scores."""
    return list_files(spark, folder).where(is_entity_file("name"))


def read_scores(spark: SparkSession, paths: Sequence[str], prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """All rows of some score files with their places, and the quarantine table."""
    reading = read_delimited(spark, paths, by_regex(SCORE_RENAMES))
    if not reading.frames:
        return placed_nowhere(spark, SCORE_SCHEMA), reading.quarantine if paths else spark.createDataFrame([], QUARANTINE)
    return stacked_scores(reading.frames, prefix), reading.quarantine


def placed_nowhere(spark: SparkSession, schema: StructType) -> DataFrame:
    """No rows of a schema, with places."""
    place = StructType([StructField("_path", StringType()), StructField("_block", LongType()), StructField("_row", LongType())])
    return stack_tables([], spark, StructType([*schema.fields, *place.fields]))


def finish_scores(stacked: DataFrame, dedup: str | None = None) -> DataFrame:
    """Rows with both targets, of each key the last one if asked."""
    table = stacked.dropna(how="any", subset=SCORE_TARGETS)
    if dedup == "last":
        table = keep_last(table, PANEL_KEYS, PLACE)
    return table.select(*SCORE_SCHEMA.names)


def consolidate_scores(
    spark: SparkSession, folder: str, prefix: str = "", dedup: str | None = None
) -> Consolidated:
    """Score table of all entity files below a folder; rows without both targets are dropped.

    ``dedup="last"`` keeps one row per key; by default repeated keys stay.  The stacked rows are written
    once; table and audit read them there, and no file again.
    """
    stacked, quarantine = read_scores(spark, paths_where(score_files(spark, folder), F.lit(True)), prefix)
    stacked = written(stacked)
    complete = F.lit(True)
    for target in SCORE_TARGETS:
        complete = complete & F.col(target).isNotNull()
    audit = cleaning_audit(stacked, [("targets present", complete)])
    return Consolidated(finish_scores(stacked, dedup), audit, quarantine)
