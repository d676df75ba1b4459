"""Writers.  Spark writes a folder of files and makes missing folders itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from panelflow.presets import PANEL_KEYS


BOM = "\ufeff"


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", bom: bool = False) -> None:
    """Comma, header, UTF-8.

    With ``bom`` every file starts with a byte order mark: Spark has no option for it, but the
    mark can be the first character of the header.
    """
    if bom:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    df.write.mode(mode).option("encoding", "UTF-8").option("quote", '"').option("escape", '"').csv(path, header=True)


def write_panel(df: DataFrame, path: str, by: Sequence[str] = ("agno", "curso"), mode: str = "overwrite") -> None:
    """Parquet in one folder per year and level, so later reads prune by both.

    Rows are brought together by folder first, so a folder gets a few files and not one per task;
    a folder with much of the table is split again.
    """
    df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str] = PANEL_KEYS, buckets: int = 64, mode: str = "overwrite") -> None:
    """A table of the session's catalog, dealt and sorted by the panel key once and for all.

    Tables with the same keys and number of buckets are joined, audited and brought to one row per key without a
    shuffle.  Rows are brought together by bucket before they are written, so a bucket is one file.
    """
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def write_listings(blocks: DataFrame, path: str, doc: str, mode: str = "overwrite") -> None:
    """Text: the files in name order hold the listings, document after document, page after page.

    A document may go on in the next file; there is no folder per document, of which there may be millions.
    """
    in_order = blocks.repartitionByRange(doc, "page_no").sortWithinPartitions(doc, "page_no")
    in_order.select("block").write.mode(mode).text(path)
