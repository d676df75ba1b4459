"""Scalar functions, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelflow.functions import text as tx
from panelflow.functions.numbers import round_to
from panelflow.operators import modelling
from panelflow.presets import GROUP_LABELS
from panelflow.registry.base import Tables, query

PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query(r"""
SELECT event_id, CASE WHEN regexp_matches(trim(raw), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$')
                      THEN TRY_CAST(trim(raw) AS DOUBLE) END AS number
FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '*' WHEN event_id % 11 = 0 THEN ' ' WHEN event_id % 13 = 0 THEN '5d'
        WHEN event_id % 17 = 0 THEN 'NaN' WHEN event_id % 19 = 0 THEN ' 1.5e2 '
        ELSE CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) END AS raw FROM events)
""")
def coerce_numeric(t: Tables) -> DataFrame:
    key = F.col("event_id")
    raw = (
        F.when(key % 7 == 0, "*")
        .when(key % 11 == 0, " ")
        .when(key % 13 == 0, "5d")
        .when(key % 17 == 0, "NaN")
        .when(key % 19 == 0, " 1.5e2 ")
        .otherwise(F.floor(F.col("value") * 100).cast("string"))
    )
    return t.events.select("event_id", tx.to_number(raw).alias("number"))


@query(r"""
SELECT c_custkey, TRY_CAST(raw AS INTEGER) AS number
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE regexp_extract(c_name, '(\d+)$', 1) END AS raw FROM customer)
""")
def coerce_int(t: Tables) -> DataFrame:
    digits = F.regexp_extract("c_name", r"(\d+)$", 1)
    raw = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat(F.lit(" "), digits, F.lit(".0 ")))
    return t.customer.select("c_custkey", tx.to_integer(raw).alias("number"))


@query("""
SELECT l_orderkey, l_linenumber, coalesce(map {'A': 'accepted', 'R': 'returned'}[l_returnflag], l_returnflag) AS flag FROM lineitem
""")
def recode_keep_unmapped(t: Tables) -> DataFrame:
    labels = {"A": "accepted", "R": "returned"}
    return t.lineitem.select("l_orderkey", "l_linenumber", tx.recode("l_returnflag", labels).alias("flag"))


@query("""
SELECT p_partkey, CAST(p_size AS VARCHAR) AS code,
       coalesce(map {'1': 'Bajo', '2': 'Medio bajo', '3': 'Medio', '4': 'Medio alto', '5': 'Alto'}[CAST(p_size AS VARCHAR)],
                CAST(p_size AS VARCHAR)) AS label
FROM part
""")
def canonical_code(t: Tables) -> DataFrame:
    size = F.col("p_size")
    raw = F.when(F.col("p_partkey") % 2 == 0, size.cast("double").cast("string")).otherwise(size.cast("string"))
    code = tx.canonical_code(raw)
    return t.part.select("p_partkey", code.alias("code"), tx.recode(code, GROUP_LABELS).alias("label"))


@query("SELECT doc_id, lower(concat(source, '/', lang)) AS name FROM documents")
def lower_trim(t: Tables) -> DataFrame:
    padded = F.concat(F.lit("\t "), F.upper("source"), F.lit("/"), F.col("lang"), F.lit("  \n"))
    return t.documents.select("doc_id", tx.lower_strip(padded).alias("name"))


@query("""
SELECT o_orderkey, concat('scores_', o_orderstatus, '_', year(o_orderdate), '_', o_orderpriority) AS context FROM orders
""")
def concat_template(t: Tables) -> DataFrame:
    context = tx.template(F.lit("scores"), "o_orderstatus", F.year("o_orderdate").cast("string"), "o_orderpriority")
    return t.orders.select("o_orderkey", context.alias("context"))


@query("""
SELECT l_orderkey, l_linenumber, round_even(l_extendedprice * (1 - l_discount) * 10.0::DOUBLE, 0) / 10.0::DOUBLE AS net FROM lineitem
""")
def round_values(t: Tables) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", round_to(net, 1).alias("net"))


@query("""
SELECT c_custkey, abs(c_acctbal) AS size, CASE WHEN c_acctbal > 0 THEN 'positive' ELSE 'negative' END AS sign FROM customer
""")
def sign_class(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.abs("c_acctbal").alias("size"), tx.sign_class("c_acctbal").alias("sign"))


@query("SELECT c_custkey, c_acctbal, abs(c_acctbal) AS size FROM customer ORDER BY size DESC, c_custkey")
def rank_by_abs(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_acctbal", F.abs("c_acctbal").alias("size"))
    return modelling.rank_by_abs(rows, "c_acctbal", "c_custkey")


@query("""
SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal > 0 THEN 'positive' ELSE 'negative' END AS sign
FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 5
""")
def top_k_abs(t: Tables) -> DataFrame:
    return modelling.top_effects(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 5)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def head_5(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey").limit(5)


@query("""
SELECT o_orderpriority, count(*) AS rows,
       CAST(list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority) AS INTEGER) AS place
FROM orders GROUP BY o_orderpriority
""")
def ordered_category(t: Tables) -> DataFrame:
    counts = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("place", tx.rank_of("o_orderpriority", PRIORITIES)).orderBy("place")
