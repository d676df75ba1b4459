"""Filters, predicates and the cleaning audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelflow.functions import text as tx
from panelflow.operators import cleaning as op
from panelflow.operators import sheets
from panelflow.registry.base import Tables, query

EVENT_TARGETS = {"view": "view", "click": "click", "purchase": "purchase", "signup": "signup"}


def holed_orders(t: Tables) -> DataFrame:
    """Orders with nulls: the given tables have none."""
    return t.orders.select(
        "o_orderkey",
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("total"),
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderpriority")).alias("priority"),
    )


SQL_HOLED_ORDERS = """(
  SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status,
         CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS total,
         CASE WHEN o_custkey % 3 <> 0 THEN o_orderpriority END AS priority
  FROM orders)"""


def holed_customers(t: Tables) -> DataFrame:
    return t.customer.select(
        "c_custkey",
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_nationkey") != 7, F.col("c_nationkey")).alias("nation"),
        "c_name",
    )


SQL_HOLED_CUSTOMERS = """(
  SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment,
         CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS balance,
         CASE WHEN c_nationkey <> 7 THEN c_nationkey END AS nation, c_name
  FROM customer)"""


@query(f"SELECT * FROM {SQL_HOLED_ORDERS} WHERE status IS NOT NULL AND total IS NOT NULL")
def dropna_subset(t: Tables) -> DataFrame:
    return holed_orders(t).dropna(how="any", subset=["status", "total"])


@query(f"""
SELECT * FROM {SQL_HOLED_CUSTOMERS} WHERE segment IS NOT NULL AND balance IS NOT NULL AND nation IS NOT NULL
""")
def dropna_all(t: Tables) -> DataFrame:
    return holed_customers(t).dropna()


@query("""
SELECT event_id, event_type AS target, value FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup')
""")
def drop_unmapped(t: Tables) -> DataFrame:
    coded = t.events.select("event_id", tx.map_code("event_type", EVENT_TARGETS).alias("target"), "value")
    return coded.where(F.col("target").isNotNull())


@query("""
SELECT event_id, value FROM events,
  (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)
""")
def iqr_filter(t: Tables) -> DataFrame:
    return op.drop_outliers(t.events.select("event_id", "value"), ["value"])


@query("""
WITH a AS (SELECT l_returnflag, l_extendedprice * l_quantity AS volume, l_extendedprice, l_quantity FROM lineitem),
f1 AS (SELECT quantile_cont(volume, 0.25) AS q1, quantile_cont(volume, 0.75) AS q3 FROM a),
b AS (SELECT a.* FROM a, f1 WHERE volume BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
f2 AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM b),
c AS (SELECT b.* FROM b, f2 WHERE l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
f3 AS (SELECT quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3 FROM c)
SELECT l_returnflag, count(*) AS kept FROM c, f3
WHERE l_quantity BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY l_returnflag
""")
def iqr_filter_sequential(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_returnflag", (F.col("l_extendedprice") * F.col("l_quantity")).alias("volume"), "l_extendedprice", "l_quantity"
    )
    kept = op.drop_outliers(rows, ["volume", "l_extendedprice", "l_quantity"])
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("kept"))


@query("""
SELECT doc_id, lower(trim(raw)) AS variable
FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN '  ' WHEN source = 'src3' THEN ' NaN ' ELSE concat(' ', upper(source)) END AS raw
      FROM documents)
WHERE lower(trim(raw)) NOT IN ('', 'nan')
""")
def drop_blank_strings(t: Tables) -> DataFrame:
    raw = (
        F.when(F.col("lang") == "en", "  ")
        .when(F.col("source") == "src3", " NaN ")
        .otherwise(F.concat(F.lit(" "), F.upper("source")))
    )
    return op.drop_blank_texts(t.documents.select("doc_id", raw.alias("variable")), "variable")


@query(f"""
SELECT count(*) FILTER (WHERE segment IS NOT NULL AND balance IS NOT NULL AND nation IS NOT NULL AND c_name IS NOT NULL) AS complete,
       count(*) AS total
FROM {SQL_HOLED_CUSTOMERS}
""")
def complete_case_count(t: Tables) -> DataFrame:
    return op.complete_cases(holed_customers(t), ["segment", "balance", "nation", "c_name"])


@query("""
SELECT doc_id, file, sheet
FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN concat('~$', source, '.xlsx') ELSE concat(source, '.xlsx') END AS file,
             CASE WHEN source = 'src1' THEN 'Índice' WHEN source = 'src2' THEN 'INDICE 2' ELSE lang END AS sheet
      FROM documents)
WHERE NOT starts_with(file, '~$') AND NOT contains(lower(sheet), 'ndice')
""")
def exclude_contains(t: Tables) -> DataFrame:
    name = F.concat("source", F.lit(".xlsx"))
    cells = t.documents.select(
        "doc_id",
        F.when(F.col("lang") == "de", F.concat(F.lit("~$"), name)).otherwise(name).alias("file"),
        F.when(F.col("source") == "src1", "Índice").when(F.col("source") == "src2", "INDICE 2").otherwise(F.col("lang")).alias("sheet"),
    )
    return sheets.drop_index_sheets(cells)


@query("""
SELECT conv_id, turn, role, c.text FROM conversations c
JOIN (SELECT conv_id, min(turn) AS head FROM conversations WHERE role = 'user' GROUP BY conv_id) h USING (conv_id)
WHERE turn > head
""")
def skip_until_header(t: Tables) -> DataFrame:
    return sheets.skip_until(t.conversations, ["conv_id"], "turn", F.col("role") == "user")


@query("""
SELECT conv_id, turn, role, c.text FROM conversations c
LEFT JOIN (SELECT conv_id, min(turn) AS cut FROM conversations WHERE role = 'assistant' GROUP BY conv_id) h USING (conv_id)
WHERE cut IS NULL OR turn < cut
""")
def take_while(t: Tables) -> DataFrame:
    return sheets.take_while(t.conversations, ["conv_id"], "turn", F.col("role") == "assistant")


@query("""
SELECT p_partkey, p_name FROM part WHERE coalesce(contains(lower(nullif(upper(p_name), 'RED RING')), 'red'), false)
""")
def contains_filter(t: Tables) -> DataFrame:
    name = F.nullif(F.upper("p_name"), F.lit("RED RING"))
    return t.part.where(tx.contains_ignore_case(name, "Red")).select("p_partkey", "p_name")


@query("""
WITH f AS (SELECT l_returnflag, l_extendedprice, l_quantity, l_discount, l_linestatus FROM lineitem),
s AS (SELECT count(*) AS n0,
        count(*) FILTER (WHERE l_quantity >= 5) AS n1,
        count(*) FILTER (WHERE l_quantity >= 5 AND l_returnflag <> 'N') AS n2,
        count(*) FILTER (WHERE l_quantity >= 5 AND l_returnflag <> 'N' AND l_extendedprice < 90000) AS n3 FROM f)
SELECT 1 AS step_no, 'enough units' AS step, n0 AS rows_in, n1 AS rows_out, n0 - n1 AS removed FROM s
UNION ALL SELECT 2, 'flag known', n1, n2, n1 - n2 FROM s
UNION ALL SELECT 3, 'price in range', n2, n3, n2 - n3 FROM s
""")
def cleaning_audit(t: Tables) -> DataFrame:
    return op.cleaning_audit(
        t.lineitem,
        [
            ("enough units", F.col("l_quantity") >= 5),
            ("flag known", F.nullif(F.col("l_returnflag"), F.lit("N")).isNotNull()),
            ("price in range", F.col("l_extendedprice") < 90000),
        ],
    )
