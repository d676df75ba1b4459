"""Scans, sheets as cells, page listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from panelflow.functions.filenames import is_main_file
from panelflow.functions import text as tx
from panelflow.operators.columns import conform
from panelflow.operators.paging import assemble_pages as assemble
from panelflow.operators.reshape import stack_tables
from panelflow.operators.sheets import melt_cells
from panelflow.registry.base import SQL_BLANKS, SQL_FILE_NAMES, Tables, file_names, query


@query(f"""
SELECT o_orderkey, file_name FROM {SQL_FILE_NAMES}
WHERE regexp_matches(lower(file_name), '\\.(csv|txt)$') AND NOT regexp_matches(lower(file_name), '_dim|niveles|subdim')
""")
def file_name_filter(t: Tables) -> DataFrame:
    return file_names(t.orders).where(is_main_file("file_name")).select("o_orderkey", "file_name")


@query("""
SELECT doc_id, CASE WHEN contains(line, '|') THEN '|' WHEN contains(line, ';') THEN ';' ELSE ',' END AS sep
FROM (SELECT doc_id, split_part(text, chr(10), 1) AS line FROM documents)
""")
def sniff_delimiter(t: Tables) -> DataFrame:
    line = F.substring_index("text", "\n", 1)
    return t.documents.select("doc_id", tx.first_delimiter(line).alias("sep"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_extendedprice FROM lineitem")
def scan_parquet(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")


def conversation_cells(t: Tables) -> DataFrame:
    return melt_cells(t.conversations, ["conv_id"], "turn", [F.col("role"), F.length("text")])


SQL_CELLS = """(
  SELECT conv_id, turn AS row_idx, 0 AS col_idx, role AS value FROM conversations
  UNION ALL
  SELECT conv_id, turn, 1, CAST(length(text) AS VARCHAR) FROM conversations)"""


@query(f"SELECT conv_id, row_idx, col_idx, value FROM {SQL_CELLS}")
def cell_table_scan(t: Tables) -> DataFrame:
    return conversation_cells(t)


@query("""
SELECT n_nationkey, n_name, letter FROM nation JOIN region ON r_regionkey = n_regionkey
JOIN (VALUES ('A'), ('Z')) v(letter) ON starts_with(r_name, letter)
""")
def stack_of_found(t: Tables) -> DataFrame:
    """One table per region of a letter, stacked; for a letter without regions that is the empty table."""
    schema = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType())])
    stacks = []
    for letter in ("A", "Z"):
        keys = [r["r_regionkey"] for r in t.region.where(F.col("r_name").startswith(letter)).collect()]
        frames = [conform(t.nation.where(F.col("n_regionkey") == k), schema) for k in keys]
        stacks.append(stack_tables(frames, t.spark, schema).withColumn("letter", F.lit(letter)))
    return stack_tables(stacks)


@query(f"""
SELECT c_custkey,
       CASE WHEN trim(raw, {SQL_BLANKS}) IN ('', 'NA', 'N/A', 'NULL', 'null', 'NaN', 'nan', 'None', 'n/a', '<NA>')
            THEN NULL ELSE raw END AS segment
FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'NA' WHEN c_custkey % 7 = 0 THEN ' '
                             WHEN c_custkey % 11 = 0 THEN 'None' WHEN c_custkey % 13 = 0 THEN ' nan '
                             ELSE c_mktsegment END AS raw FROM customer)
""")
def null_tokens(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    raw = (
        F.when(key % 5 == 0, "NA")
        .when(key % 7 == 0, " ")
        .when(key % 11 == 0, "None")
        .when(key % 13 == 0, " nan ")
        .otherwise(F.col("c_mktsegment"))
    )
    return t.customer.select("c_custkey", tx.null_tokens(raw).alias("segment"))


@query(f"""
WITH pages_in AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page_no, CASE WHEN turn % 3 = 2 THEN '  ' ELSE text END AS text FROM conversations),
totals AS (SELECT conv_id, count(*) AS pages FROM pages_in GROUP BY conv_id),
blocks AS (
  SELECT p.conv_id, page_no, pages,
         concat('## --- SLIDE ', page_no, ' / ', pages, ' ---', chr(10), chr(10),
                coalesce(nullif(trim(text, {SQL_BLANKS}), ''), '_(sin texto extraíble — slide visual)_'), chr(10)) AS block
  FROM pages_in p JOIN totals t ON p.conv_id = t.conv_id)
SELECT conv_id, page_no, pages,
       concat(CASE WHEN page_no = 1 THEN concat('# Extracción de Presentación PDF', chr(10), chr(10)) ELSE '' END, block) AS block
FROM blocks
""")
def assemble_pages(t: Tables) -> DataFrame:
    """Pages whose own numbers begin at 0 and leave gaps are numbered by position."""
    text = F.when(F.col("turn") % 3 == 2, "  ").otherwise(F.col("text"))
    pages = t.conversations.select("conv_id", (F.col("turn") * 3).alias("page"), text.alias("text"))
    return assemble(pages, "conv_id", "page", "text")
