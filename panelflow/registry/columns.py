"""Schema and column operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from panelflow.functions import text as tx
from panelflow.functions.filenames import file_facts, level_in, level_of_folder, year_in
from panelflow.operators import columns as op
from panelflow.operators.sheets import first_two_columns
from panelflow.registry.base import SQL_FILE_NAMES, Tables, file_names, query
from panelflow.registry.ingest import SQL_CELLS, conversation_cells


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def normalize_names(t: Tables) -> DataFrame:
    messy = t.customer.toDF("﻿C_CUSTKEY", " C_Name", "c_NationKey ", "C_ACCTBAL\t", "c_MktSegment")
    return op.normalize_names(messy)


@query("""
SELECT l_orderkey, l_linenumber AS line_no, l_quantity, l_extendedprice AS price, l_discount FROM lineitem
""")
def regex_rename(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    return op.regex_rename(rows, {r"L_LINE\w+": "line_no", r"l_extended\w+": "price", r"quantity": "never"})


@query("""
SELECT o_orderkey AS rbd, o_custkey AS customer, o_orderstatus AS status, o_totalprice AS total, o_orderpriority
FROM orders
""")
def alias_rename(t: Tables) -> DataFrame:
    return op.alias_rename(
        t.orders.drop("o_orderdate"),
        {"o_orderkey": "rbd", "o_custkey": "customer", "o_orderstatus": "status", "o_totalprice": "total"},
    )


@query("SELECT p_partkey, p_name AS label, p_size AS size FROM part")
def dup_columns_first(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_name", "p_size", "p_type", "p_retailprice")
    return op.settle_names(rows, ["p_partkey", "Label", "size", "label ", "SIZE"])


@query("""
SELECT p_partkey,
       CASE WHEN contains(v, 'ring') OR contains(v, 'small') THEN 'variable'
            WHEN contains(v, 'widget') OR contains(v, 'red') THEN 'descripcion' ELSE v END AS class
FROM (SELECT p_partkey, lower(trim(concat(' ', upper(p_name), ' '))) AS v FROM part)
""")
def classify_by_substring(t: Tables) -> DataFrame:
    header = F.concat(F.lit(" "), F.upper("p_name"), F.lit(" "))
    classes = {"variable": ["ring", "small"], "descripcion": ["widget", "red"]}
    return t.part.select("p_partkey", tx.classify_by_words(header, classes).alias("class"))


@query("""
SELECT s_suppkey AS key, s_name AS name, CAST(s_nationkey AS BIGINT) AS nation, CAST(NULL AS VARCHAR) AS segment,
       CAST(NULL AS INTEGER) AS rank, s_acctbal AS balance
FROM supplier
""")
def whitelist_null_fill(t: Tables) -> DataFrame:
    schema = T.StructType([
        T.StructField("key", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("nation", T.LongType()),
        T.StructField("segment", T.StringType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("balance", T.DoubleType()),
    ])
    renames = {"s_suppkey": "key", "s_name": "name", "s_nationkey": "nation", "s_acctbal": "balance"}
    return op.conform(op.alias_rename(t.supplier, renames), schema)


@query(r"""
SELECT o_orderkey, o_orderstatus, lower(nullif(regexp_extract(file_name, '(1m|2m|3m|4m|5m)\d{4}', 1), '')) AS curso
FROM """ + SQL_FILE_NAMES)
def default_column(t: Tables) -> DataFrame:
    rows = file_names(t.orders)
    rows = op.default_column(rows, "o_orderstatus", F.lit("unused"))
    rows = op.default_column(rows, "curso", level_in("file_name", "scores", ["1m", "2m", "3m", "4m", "5m"]))
    return rows.select("o_orderkey", "o_orderstatus", "curso")


@query(r"""
SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(file_name, '(20\d{2})', 1), '') AS INTEGER) AS agno
FROM """ + SQL_FILE_NAMES)
def year_from_text(t: Tables) -> DataFrame:
    return file_names(t.orders).select("o_orderkey", year_in("file_name").alias("agno"))


@query(r"""
SELECT o_orderkey, nullif(regexp_extract(file_name, 'scores(2m|4m)\d{4}', 1), '') AS curso FROM """ + SQL_FILE_NAMES)
def level_from_text(t: Tables) -> DataFrame:
    return file_names(t.orders).select("o_orderkey", level_in("file_name", "SCORES", ["2m", "4m"]).alias("curso"))


@query("""
SELECT o_orderkey,
       coalesce(map {'2': '2m', '4': '4b', '6': '6b', '8': '8b', '2m': '2m', '4b': '4b', '6b': '6b', '8b': '8b'}[lower(f)],
                lower(f)) AS curso
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN concat(substr(o_orderpriority, 1, 1), 'B')
                              ELSE substr(o_orderpriority, 1, 1) END AS f FROM orders)
""")
def normalize_level(t: Tables) -> DataFrame:
    digit = F.substring("o_orderpriority", 1, 1)
    folder = F.when(F.col("o_orderstatus") == "P", F.concat(digit, F.lit("B"))).otherwise(digit)
    return t.orders.select("o_orderkey", level_of_folder(folder).alias("curso"))


@query(r"""
SELECT o_orderkey, 'scores' AS origin,
       coalesce(nullif(regexp_extract(file_name, 'scores([2468]m)?(\d{4})', 1), ''), 'general') AS curso,
       coalesce(nullif(regexp_extract(file_name, 'scores([2468]m)?(\d{4})', 2), ''),
                nullif(regexp_extract(file_name, '\d{4}'), ''), 'desconocido') AS agno
FROM """ + SQL_FILE_NAMES)
def filename_metadata(t: Tables) -> DataFrame:
    level, year = file_facts("file_name", ["scores"], "[2468]m")
    return file_names(t.orders).select("o_orderkey", F.lit("scores").alias("origin"), level.alias("curso"), year.alias("agno"))


@query("""
SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') THEN 'red' WHEN contains(lower(p_name), 'bolt') THEN 'bolt'
                       WHEN contains(lower(p_name), 'old') THEN 'old' ELSE lower(p_type) END AS curso
FROM part
""")
def override_by_contains(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", tx.override_by_words(F.upper("p_name"), ["red", "bolt", "old"], F.lower("p_type")).alias("curso")
    )


@query("SELECT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem")
def project(t: Tables) -> DataFrame:
    return t.lineitem.select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


@query(f"""
SELECT conv_id, row_idx, max(value) FILTER (WHERE col_idx = 0) AS variable, max(value) FILTER (WHERE col_idx = 1) AS descripcion
FROM {SQL_CELLS} GROUP BY conv_id, row_idx
""")
def positional_fallback(t: Tables) -> DataFrame:
    return first_two_columns(conversation_cells(t), ["conv_id"])


@query("""
SELECT c_custkey, regexp_replace(v, '(2m|4b|6b|8b)(_|$)', '\\2', 'g') AS variable
FROM (SELECT c_custkey, concat('prom_', lower(c_mktsegment),
        CASE c_custkey % 5 WHEN 0 THEN '2m' WHEN 1 THEN '4b' WHEN 2 THEN '6b' WHEN 3 THEN '8b' ELSE '' END,
        CASE WHEN c_nationkey % 2 = 0 THEN '_rbd' ELSE '' END) AS v FROM customer)
""")
def strip_infix(t: Tables) -> DataFrame:
    level = F.element_at(F.array(*[F.lit(x) for x in ("2m", "4b", "6b", "8b", "")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    grain = F.when(F.col("c_nationkey") % 2 == 0, "_rbd").otherwise("")
    name = F.concat(F.lit("prom_"), F.lower("c_mktsegment"), level, grain)
    return t.customer.select("c_custkey", tx.strip_infix(name, ["2m", "4b", "6b", "8b"]).alias("variable"))
