"""Records of delimited files whose quoted fields hold line breaks, found without reading a file in one task.

A file is read line by line, in splits.  A line with an odd number of quotes changes whether the text is inside
quotes.  The odd lines of each split are counted; sums over the splits of a file say in which state
each split begins, and sums within a split say it for each line.  Lines that begin outside quotes begin a
record; the others belong to the record before, across the border of a split too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelflow.operators.sized import join_written, written
from panelflow.sources.discover import file_path, literal_path, outside_quotes

QUOTED = "\x01"


def _text(encoding: str) -> Column:
    value = F.col("value")
    return value if encoding == "UTF-8" else F.decode(value.cast("binary"), encoding)


def quoted_records(spark: SparkSession, paths: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """(path, block, row, record) of every record of files that are well formed; see ``record_facts``.  A written table.

    ``block`` and ``row`` are those of its first line and order the records of a file.  A record's text is as in the
    file, line breaks included, without the one that ends it.  Empty lines outside quotes are no records.
    A window holds the lines of one split; only records of several lines are grouped, so a
    task never holds more than a split or a record.
    """
    lines = spark.read.option("lineSep", "\n").text([literal_path(p) for p in paths]).select(
        file_path().alias("path"), F.col("_metadata.file_block_start").alias("block"), _text(encoding).alias("line")
    )
    lines = lines.withColumn("row", F.monotonically_increasing_id())
    odd = (F.length("line") - F.length(F.replace("line", F.lit('"')))) % 2
    lines = lines.withColumn("odd", odd)
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = lines.groupBy("path", "block").agg(F.sum("odd").alias("odds")).select(
        "path", "block", (F.coalesce(F.sum("odds").over(earlier), F.lit(0)) % 2).alias("state")
    )
    within = Window.partitionBy("path", "block").orderBy("row")
    before = F.col("state") + F.sum("odd").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("odd")
    placed = join_written(lines, states, ["path", "block"]).withColumn("outside", before % 2 == 0)
    placed = placed.withColumn("number", F.count_if("outside").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    alone = F.col("outside") & (F.col("odd") == 0)
    whole = placed.where(alone).select("path", "block", "row", F.col("line").alias("record"))

    parts = placed.where(~alone)
    # Lines before the first record of a split go to the last record of an earlier one.
    last = placed.groupBy("path", "block").agg(F.max("number").alias("records")).select(
        "path", "block", F.last(F.when(F.col("records") > 0, F.struct(F.col("block").alias("in"), "records")), True).over(earlier).alias("owner")
    )
    begun = parts.where("number > 0").select("path", "block", "number", F.struct("block", "row", "line").alias("part"))
    carried = join_written(parts.where("number = 0"), last, ["path", "block"]).select(
        "path", F.col("owner.in").alias("block"), F.col("owner.records").alias("number"), F.struct("block", "row", "line").alias("part")
    )
    joined = begun.unionByName(carried).groupBy("path", "block", "number").agg(F.sort_array(F.collect_list("part")).alias("parts")).select(
        "path", "block", F.col("parts")[0]["row"].alias("row"), F.array_join(F.col("parts")["line"], "\n").alias("record")
    )
    # Written, as the splits of a later scan could be others than those whose states were counted.
    return written(whole.unionByName(joined).withColumn("record", F.regexp_replace("record", r"\r\z", "")).where("record <> ''"))


def record_facts(records: DataFrame, separator: str) -> DataFrame:
    """(path, fields, clean) of each file: the most fields in a record, and whether all quotes are where they belong.

    In a file that is not clean a quote stands within an unquoted field, or text after a closing one, or a
    quoted field never ends, or a carriage return ends a line; then the records are not to be relied on.
    """
    marked = F.regexp_replace("record", '"[^"]*"', QUOTED)
    mark = "\\" + separator
    clean = (
        ~marked.rlike(f'[^{mark}{QUOTED}]{QUOTED}|{QUOTED}[^{mark}{QUOTED}]|"')
        & ~marked.contains("\r")
        & ~F.col("record").contains(QUOTED)
    )
    rest = outside_quotes(F.col("record"))
    fields = F.length(rest) - F.length(F.replace(rest, F.lit(separator))) + 1
    return records.groupBy("path").agg(F.max(fields).alias("fields"), F.bool_and(clean).alias("clean"))


def parsed(records: DataFrame, separator: str, columns: int) -> DataFrame:
    """Fields ``_c0`` and so on of each record, all text, then ``_path``, ``_block`` and ``_row``."""
    schema = ", ".join(f"_c{i} string" for i in range(columns))
    options = {"sep": separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}
    fields = F.from_csv(F.regexp_replace("record", "^﻿", ""), schema, options)
    return records.select(
        fields.alias("fields"), F.col("path").alias("_path"), F.col("block").alias("_block"), F.col("row").alias("_row")
    ).select("fields.*", "_path", "_block", "_row")
