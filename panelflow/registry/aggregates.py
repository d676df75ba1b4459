"""Group aggregates and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelflow.functions import text as tx
from panelflow.operators import profiling as op
from panelflow.operators.ranks import exact_quantiles
from panelflow.registry.base import Tables, grid, query, sql_grid
from panelflow.registry.filters import SQL_HOLED_CUSTOMERS, holed_customers

SIX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "net"]
SEGMENTS = ["HOUSEHOLD", "FURNITURE", "BUILDING", "MACHINERY", "AUTOMOBILE"]


def six_columns(t: Tables) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.withColumn("net", net).select(*SIX)


SQL_SIX = "(SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem)"


@query(f"""
SELECT l_returnflag, l_linestatus, {sql_grid('sum(l_quantity)', 2)} AS sum_qty, {sql_grid('avg(l_discount)')} AS avg_disc,
       min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price, count(*) AS n
FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag, l_linestatus
""")
def group_multi_agg(t: Tables) -> DataFrame:
    return (
        t.lineitem.where(F.col("l_returnflag").isNotNull())
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            grid(F.sum("l_quantity"), 2).alias("sum_qty"),
            grid(F.avg("l_discount")).alias("avg_disc"),
            F.min("l_extendedprice").alias("min_price"),
            F.max("l_extendedprice").alias("max_price"),
            F.count(F.lit(1)).alias("n"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(*) - count({c}) AS nulls FROM {SQL_HOLED_CUSTOMERS}"
        for c in ("c_custkey", "segment", "balance", "nation", "c_name")
    )
)
def null_counts(t: Tables) -> DataFrame:
    return op.null_counts(holed_customers(t))


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS value, count(*) AS rows FROM lineitem GROUP BY {c}"
        for c in ("l_returnflag", "l_linestatus", "l_linenumber")
    )
)
def distinct_values(t: Tables) -> DataFrame:
    return op.distinct_values(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("SELECT count(*) AS n_rows, 6 AS n_columns FROM orders")
def shape(t: Tables) -> DataFrame:
    return op.shape(t.orders)


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, count({c}) AS n, {sql_grid(f'quantile_cont({c}, 0.05)')} AS p05,
            {sql_grid(f'quantile_cont({c}, 0.25)')} AS p25, {sql_grid(f'quantile_cont({c}, 0.5)')} AS p50,
            {sql_grid(f'quantile_cont({c}, 0.75)')} AS p75, {sql_grid(f'quantile_cont({c}, 0.95)')} AS p95 FROM {SQL_SIX}"""
        for c in ("l_quantity", "l_extendedprice", "net")
    )
)
def quantiles(t: Tables) -> DataFrame:
    q = exact_quantiles(six_columns(t), ["l_quantity", "l_extendedprice", "net"], [0.05, 0.25, 0.5, 0.75, 0.95])
    names = ["p05", "p25", "p50", "p75", "p95"]
    return q.select("variable", "n", *[grid(F.get("q", F.lit(i))).alias(c) for i, c in enumerate(names)])


def _sql_describe(c: str) -> str:
    two = lambda e: f"round_even(({e}) * 100.0::DOUBLE, 0) / 100.0::DOUBLE"
    return f"""SELECT '{c}' AS variable, count({c}) AS count, {two(f'avg({c})')} AS mean, {two(f'stddev_samp({c})')} AS std,
        {two(f'min({c})')} AS min, {two(f'quantile_cont({c}, 0.25)')} AS p25, {two(f'quantile_cont({c}, 0.5)')} AS p50,
        {two(f'quantile_cont({c}, 0.75)')} AS p75, {two(f'max({c})')} AS max
    FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM {SQL_SIX})"""


@query(" UNION ALL ".join(_sql_describe(c) for c in SIX))
def describe_columns(t: Tables) -> DataFrame:
    return op.describe(six_columns(t), SIX)


@query(
    _sql_describe("l_quantity")
    + " UNION ALL SELECT 'no_values', 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL"
    + " UNION ALL " + _sql_describe("net")
)
def describe_with_nulls(t: Tables) -> DataFrame:
    """A column without a value keeps its row."""
    return op.describe(six_columns(t).withColumn("no_values", F.lit(None).cast("double")), ["l_quantity", "no_values", "net"])


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS var_a, '{b}' AS var_b, {sql_grid(f'corr({a}, {b})')} AS r FROM {SQL_SIX}" for a in SIX for b in SIX
    )
)
def correlation_matrix(t: Tables) -> DataFrame:
    return op.correlations(six_columns(t), SIX).select("var_a", "var_b", grid("r").alias("r"))


def sql_histogram(values: str, digits: int = 6) -> str:
    """Histogram of a one-column relation ``x``, written with bin edges only."""
    return f"""
WITH v AS ({values}), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
edges AS (SELECT b, lo + b * ((hi - lo) / 40) AS bin_lo, CASE WHEN b = 39 THEN hi ELSE lo + (b + 1) * ((hi - lo) / 40) END AS bin_hi
          FROM e, range(40) r(b)),
counted AS (SELECT b, count(*) AS n FROM v, edges
            WHERE x >= bin_lo AND (x < bin_hi OR (b = 39 AND x <= bin_hi)) GROUP BY b)
SELECT edges.b + 1 AS bin, {sql_grid('bin_lo', digits)} AS bin_lo, {sql_grid('bin_hi', digits)} AS bin_hi, coalesce(n, 0) AS rows
FROM edges LEFT JOIN counted ON edges.b = counted.b"""


def gridded_histogram(bins: DataFrame, digits: int = 6) -> DataFrame:
    return bins.select("bin", grid("bin_lo", digits).alias("bin_lo"), grid("bin_hi", digits).alias("bin_hi"), "rows")


@query(sql_histogram("SELECT value AS x FROM events"))
def histogram_40(t: Tables) -> DataFrame:
    return gridded_histogram(op.histogram(t.events, "value", 40))


def _sql_box(table: str, category: str, column: str, more: str = "") -> str:
    return f"""
WITH q AS (SELECT {category}, quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.5) AS median,
                  quantile_cont({column}, 0.75) AS q3 FROM {table} GROUP BY {category}),
f AS (SELECT v.{category}, {column} AS x, q1, median, q3,
             {column} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS near
      FROM {table} v JOIN q ON v.{category} = q.{category})
SELECT {category}, count(*) AS rows, {sql_grid('any_value(q1)')} AS q1, {sql_grid('any_value(median)')} AS median,
       {sql_grid('any_value(q3)')} AS q3, {sql_grid('least(min(x) FILTER (WHERE near), any_value(q1))')} AS whisker_lo,
       {sql_grid('greatest(max(x) FILTER (WHERE near), any_value(q3))')} AS whisker_hi,
       count(*) FILTER (WHERE NOT near) AS outliers{more}
FROM f GROUP BY {category}"""


def _gridded_box(boxes: DataFrame, category: str) -> DataFrame:
    floats = ["q1", "median", "q3", "whisker_lo", "whisker_hi"]
    return boxes.select(category, "rows", *[grid(c).alias(c) for c in floats], "outliers")


@query(_sql_box("events", "event_type", "value"))
def box_stats(t: Tables) -> DataFrame:
    return _gridded_box(op.box_stats(t.events, "event_type", "value"), "event_type")


@query(
    _sql_box(
        "customer",
        "c_mktsegment",
        "c_acctbal",
        ", CAST(list_position(['HOUSEHOLD', 'FURNITURE', 'BUILDING', 'MACHINERY', 'AUTOMOBILE'], c_mktsegment) AS INTEGER) AS place",
    )
)
def box_stats_ordered(t: Tables) -> DataFrame:
    boxes = _gridded_box(op.box_stats(t.customer, "c_mktsegment", "c_acctbal"), "c_mktsegment")
    return boxes.withColumn("place", tx.rank_of("c_mktsegment", SEGMENTS)).orderBy("place")


@query("""
SELECT least(min(l_quantity), min(l_linenumber)) AS lo, greatest(max(l_quantity), max(l_linenumber)) AS hi FROM lineitem
""")
def joint_range(t: Tables) -> DataFrame:
    return op.joint_range(t.lineitem, "l_quantity", "l_linenumber")


@query(f"SELECT {sql_grid('avg(value)')} AS mean, {sql_grid('stddev_pop(value)')} AS std FROM events")
def mean_popstd(t: Tables) -> DataFrame:
    return op.spread(t.events, "value").select(grid("mean").alias("mean"), grid("std").alias("std"))
