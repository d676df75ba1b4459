"""Which files there are, and what each looks like."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelflow.functions.filenames import base_name, parent_folder
from panelflow.functions.text import first_delimiter


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, folder) of every file below a folder, empty ones too.  Nothing is read.

    The listing is the one Spark makes on the driver for any read of the folder.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).inputFiles()
    paths = spark.createDataFrame([(unquote(p),) for p in found], "path string")
    return paths.select("path", base_name("path").alias("name"), parent_folder("path").alias("folder"))


def file_states(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified) of every file below a folder, by tasks; no file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.col("path"), F.col("length"), F.col("modificationTime").alias("modified"))


def bare(path: Column | str) -> Column:
    """``bare_path`` of a column."""
    return F.regexp_replace(path, r"^[a-zA-Z][\w+.-]*:(//[^/]*)?", "")


def bare_path(path: str) -> str:
    """A path without scheme and host: listings and metadata spell those differently."""
    return re.sub(r"^[a-zA-Z][\w+.-]*:(//[^/]*)?", "", path)


def literal_path(path: str) -> str:
    """A path whose glob characters stand for themselves."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def paths_where(files: DataFrame, keep: Column) -> list[str]:
    """Sorted distinct paths of the files that pass a test on their name."""
    return [r["path"] for r in files.where(keep).select("path").distinct().orderBy("path").collect()]


def file_path() -> Column:
    """Path of the file a row comes from, as the file system spells it: the metadata is URL-encoded."""
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return F.url_decode(encoded)


def outside_quotes(text: Column) -> Column:
    """A text without its quoted stretches."""
    return F.regexp_replace(text, '"[^"]*"', "")


def profile_files(spark: SparkSession, paths: Sequence[str], encoding: str | None = None) -> DataFrame:
    """One row per non-empty file: header line, delimiter, encoding, field counts, line breaks in quotes.

    One pass over the bytes.  A file whose bytes are all valid UTF-8 is UTF-8, any other is
    Latin-1, unless the encoding is given.  A line with an odd number of quotes begins or ends a quoted
    field with a line break; in files without such a line every record is a line, and fields are
    counted outside quotes, so that a line with too many can be reported.  The validity flags are collected as a set (of at most two): with a collecting aggregate present
    Spark keeps the header text in a hash map instead of sorting all lines by file.
    """
    lines = spark.read.text([literal_path(p) for p in paths]).select(
        file_path().alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value"),
    )
    lines = lines.withColumn("row", F.monotonically_increasing_id())
    text = F.make_valid_utf8("value")
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"')))
    unquoted = F.when(quotes > 0, outside_quotes(text)).otherwise(text)
    counts = [
        (F.length(unquoted) - F.length(F.replace(unquoted, F.lit(mark))) + 1).alias(f"fields_{i}")
        for i, mark in enumerate("|;,")
    ]
    filled = F.trim(text) != ""
    facts = (
        lines.select(
            "path", "block", "row", "value", F.is_valid_utf8("value").alias("utf8"), filled.alias("filled"), (quotes % 2).alias("odd"), *counts
        )
        .groupBy("path")
        .agg(
            F.min_by("value", F.when(F.col("filled"), F.struct("block", "row"))).alias("header"),
            (~F.array_contains(F.collect_set("utf8"), F.lit(False))).alias("utf8"),
            F.max("odd").alias("odd"),
            *[F.max(f"fields_{i}").alias(f"widest_{i}") for i in range(3)],
        )
    )
    detected = F.when(F.col("utf8"), F.lit("UTF-8")).otherwise(F.lit("ISO-8859-1"))
    name = F.lit(encoding) if encoding else detected
    raw = F.col("header").cast("binary")
    decoded = F.when(name == "UTF-8", F.col("header")).otherwise(F.decode(raw, encoding or "ISO-8859-1"))
    known = facts.where(F.col("header").isNotNull()).select(
        "path",
        F.regexp_replace(decoded, "^\ufeff", "").alias("header"),
        name.alias("encoding"),
        (F.col("odd") == 1).alias("multiline"),
        *[f"widest_{i}" for i in range(3)],
    )
    separator = first_delimiter("header")
    widest = F.when(separator == "|", F.col("widest_0")).when(separator == ";", F.col("widest_1")).otherwise(F.col("widest_2"))
    return known.select("path", "header", "encoding", "multiline", separator.alias("separator"), widest.alias("widest"))
