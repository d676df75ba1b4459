"""Registration of queries and helpers that both texts of a query share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelflow.functions.text import BLANKS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of the tables under its own name, with its SQL twin."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


# Sums add up in another order in each engine, so floats are compared on a grid.  The grid is
# shifted a little: averages of cents fall exactly halfway between its points otherwise.


def grid(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * float(10**digits) + 0.501) / float(10**digits)


def sql_grid(expression: str, digits: int = 6) -> str:
    return f"floor(({expression}) * 1e{digits} + 0.501) / 1e{digits}"


def file_names(orders: DataFrame) -> DataFrame:
    """Orders with a file name made of priority, year and key."""
    return orders.withColumn(
        "file_name",
        F.concat(
            F.lit("scores"),
            F.substring("o_orderpriority", 1, 1),
            F.lit("m"),
            F.year("o_orderdate").cast("string"),
            F.when(F.col("o_orderkey") % 3 == 0, "_dim").otherwise("_rbd"),
            F.lit(".csv"),
        ),
    )


SQL_FILE_NAMES = """(
  SELECT *, concat('scores', substr(o_orderpriority, 1, 1), 'm', year(o_orderdate),
                   CASE WHEN o_orderkey % 3 = 0 THEN '_dim' ELSE '_rbd' END, '.csv') AS file_name
  FROM orders)"""

SQL_BLANKS = "concat(" + ", ".join(f"chr({ord(c)})" for c in BLANKS) + ")"
