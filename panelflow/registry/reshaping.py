"""Pivots, dedup, unions and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelflow.functions import text as tx
from panelflow.operators import reshape as op
from panelflow.operators import sheets
from panelflow.registry.base import Tables, grid, query, sql_grid
from panelflow.registry.filters import EVENT_TARGETS

MEASURES = ["view", "click", "purchase", "signup"]


def long_events(t: Tables) -> DataFrame:
    """Events as a long indicator file: some values missing, some context missing."""
    return t.events.select(
        "user_id",
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.concat(F.lit(" "), F.upper("event_type")).alias("ind"),
        F.when(F.col("event_type") == "view", "1.0")
        .when(F.col("event_type") == "click", "2")
        .when(F.col("event_type") == "purchase", "3")
        .when(F.col("event_type") == "signup", "4")
        .otherwise("9")
        .alias("id_indicador"),
        F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("prom"),
        F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("props"),
        "ts",
        "event_id",
    )


SQL_LONG_EVENTS = """(
  SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type,
         CASE WHEN event_id % 4 <> 0 THEN value END AS prom,
         CASE WHEN event_id % 3 <> 0 THEN props END AS props, ts, event_id
  FROM events WHERE event_type <> 'error')"""

SQL_WIDE_EVENTS = f"""
SELECT user_id, day, {', '.join(f'{sql_grid(m)} AS {m}' for m in MEASURES)}, props
FROM (
  SELECT user_id, day,
         avg(prom) FILTER (WHERE event_type = 'view') AS view, avg(prom) FILTER (WHERE event_type = 'click') AS click,
         avg(prom) FILTER (WHERE event_type = 'purchase') AS purchase, avg(prom) FILTER (WHERE event_type = 'signup') AS signup,
         arg_min(props, (ts, event_id)) FILTER (WHERE props IS NOT NULL) AS props
  FROM {SQL_LONG_EVENTS} GROUP BY user_id, day
  HAVING count(prom) > 0)
"""


def _gridded(wide: DataFrame) -> DataFrame:
    return wide.select("user_id", "day", *[grid(m).alias(m) for m in MEASURES], "props")


@query(SQL_WIDE_EVENTS)
def long_to_wide(t: Tables) -> DataFrame:
    rows = long_events(t).drop("id_indicador")
    return _gridded(op.widen(rows, ["user_id", "day"], EVENT_TARGETS, {}, ["props"], ["ts", "event_id"]))


@query(SQL_WIDE_EVENTS)
def long_to_wide_numeric_codes(t: Tables) -> DataFrame:
    rows = long_events(t).drop("ind")
    codes = {"1": "view", "2": "click", "3": "purchase", "4": "signup"}
    return _gridded(op.widen(rows, ["user_id", "day"], {}, codes, ["props"], ["ts", "event_id"]))


@query(f"""
SELECT user_id, target, {sql_grid('avg(value)')} AS mean_value
FROM (SELECT user_id, value, map {{'view': 'browse', 'click': 'browse', 'purchase': 'buy', 'signup': 'join'}}[event_type] AS target
      FROM events)
WHERE target IS NOT NULL GROUP BY user_id, target
""")
def map_codes_null_on_miss(t: Tables) -> DataFrame:
    codes = {"view": "browse", "click": "browse", "purchase": "buy", "signup": "join"}
    coded = t.events.select("user_id", tx.map_code("event_type", codes).alias("target"), "value")
    means = op.mean_by_key(coded.where(F.col("target").isNotNull()), ["user_id", "target"], "value", "mean_value")
    return means.select("user_id", "target", grid("mean_value").alias("mean_value"))


@query(f"SELECT user_id, event_type, {sql_grid('avg(value)')} AS mean_value FROM events GROUP BY user_id, event_type")
def mean_by_key(t: Tables) -> DataFrame:
    means = op.mean_by_key(t.events, ["user_id", "event_type"], "value", "mean_value")
    return means.select("user_id", "event_type", grid("mean_value").alias("mean_value"))


@query("""
SELECT user_id, arg_min(props, (ts, event_id)) FILTER (WHERE event_type <> 'error') AS first_props,
       arg_min(value, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS first_purchase
FROM events GROUP BY user_id
""")
def first_non_null(t: Tables) -> DataFrame:
    props = F.when(F.col("event_type") != "error", F.col("props"))
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    order = ["ts", "event_id"]
    return t.events.groupBy("user_id").agg(
        op.first_filled(props, order).alias("first_props"), op.first_filled(bought, order).alias("first_purchase")
    )


@query("""
SELECT source, coalesce(arg_min(lang, doc_id) FILTER (WHERE lang <> 'en'), 'none') AS first_lang
FROM documents GROUP BY source
""")
def first_valid_or_default(t: Tables) -> DataFrame:
    lang = F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
    return t.documents.groupBy("source").agg(op.first_valid(lang, ["doc_id"], "none").alias("first_lang"))


@query("""
SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey
""")
def listagg_distinct(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_nationkey").agg(op.sorted_distinct("c_mktsegment").alias("segments"))


@query(f"""
SELECT n_name, c_custkey, c_name, n_regionkey
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_name <> 'NATION_3') ON c_nationkey = n_nationkey
""")
def left_join_context(t: Tables) -> DataFrame:
    context = t.nation.where("n_name <> 'NATION_3'").withColumnRenamed("n_nationkey", "nation")
    rows = t.customer.select("c_custkey", "c_name", F.col("c_nationkey").alias("nation"))
    return op.attach_context(rows, context, ["nation"]).select("n_name", "c_custkey", "c_name", "n_regionkey")


@query(f"""
WITH per_order AS (
  SELECT l_orderkey, count(*) AS lines, {sql_grid('sum(l_quantity)', 2)} AS quantity,
         {sql_grid('avg(l_extendedprice)', 4)} AS mean_price, max(l_linestatus) AS status
  FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS orderkey, coalesce(nullif(o_orderstatus, 'P'), p.status) AS status, o_totalprice, lines, quantity, mean_price
FROM orders JOIN per_order p ON o_orderkey = l_orderkey
""")
def panel_inner_join(t: Tables) -> DataFrame:
    per_order = t.lineitem.groupBy(F.col("l_orderkey").alias("orderkey")).agg(
        F.count(F.lit(1)).alias("lines"),
        grid(F.sum("l_quantity"), 2).alias("quantity"),
        grid(F.avg("l_extendedprice"), 4).alias("mean_price"),
        F.max("l_linestatus").alias("status"),
    )
    orders = t.orders.select(
        F.col("o_orderkey").alias("orderkey"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"), "o_totalprice"
    )
    return op.panel_join(orders, per_order, ["orderkey"], check=["left"])


@query(f"""
WITH main AS (
  SELECT user_id, {', '.join(f"{sql_grid(f'avg(value) FILTER (WHERE event_type = {chr(39)}{m}{chr(39)})')} AS {m}" for m in MEASURES)}
  FROM events GROUP BY user_id),
b AS (SELECT user_id, event_type, value, CASE WHEN hour(ts) < 12 THEN 'am' ELSE 'pm' END AS band FROM events),
d AS (SELECT user_id, {sql_grid("avg(value) FILTER (WHERE event_type = 'view' AND band = 'am')")} AS dim_view_am,
             {sql_grid("avg(value) FILTER (WHERE event_type = 'view' AND band = 'pm')")} AS dim_view_pm,
             {sql_grid("avg(value) FILTER (WHERE event_type = 'click' AND band = 'am')")} AS dim_click_am
      FROM b GROUP BY user_id)
SELECT main.*, dim_view_am, dim_view_pm, dim_click_am FROM main LEFT JOIN d ON main.user_id = d.user_id
""")
def merge_subdimensions(t: Tables) -> DataFrame:
    pairs = [("view", "am"), ("view", "pm"), ("click", "am")]
    banded = t.events.withColumn("band", F.when(F.hour("ts") < 12, "am").otherwise("pm"))
    main = t.events.groupBy("user_id").agg(
        *[grid(F.avg(F.when(F.col("event_type") == m, F.col("value")))).alias(m) for m in MEASURES]
    )
    details = op.detail_to_wide(banded, ["user_id"], "event_type", "band", "value", pairs)
    details = details.select("user_id", *[grid(c).alias(c) for c in details.columns if c != "user_id"])
    return op.merge_details(main, details, ["user_id"])


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
""")
def duplicate_keys(t: Tables) -> DataFrame:
    return op.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("""
SELECT c_custkey AS key, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier
""")
def union_by_name(t: Tables) -> DataFrame:
    customers = t.customer.toDF("key", "name", "nationkey", "acctbal", "segment")
    suppliers = t.supplier.toDF("key", "name", "nationkey", "acctbal")
    return op.stack_tables([customers, suppliers])


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS place FROM lineitem)
WHERE place = 1
""")
def dedup_keep_last(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"
    )
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    return op.keep_last(rows, ["l_orderkey", "l_linenumber"], order).drop("l_shipdate")


ORIGINS = ["src7", "src12", "src3", "src19", "src0"]  # declared, not alphabetical


@query(f"""
SELECT lang AS variable, coalesce(first(descripcion ORDER BY place, source, doc_id) FILTER (WHERE descripcion <> ''), 'Sin descripción') AS descripcion,
       string_agg(DISTINCT source, ', ' ORDER BY source) AS archivos_presentes
FROM (SELECT doc_id, lang, source, coalesce(list_position({ORIGINS}, source), 99) AS place,
             CASE WHEN lang = 'es' OR doc_id % 2 = 0 THEN '' ELSE text END AS descripcion FROM documents)
GROUP BY lang
""")
def glossary_consolidate(t: Tables) -> DataFrame:
    """The first real description, in the declared order of origins."""
    note = F.when((F.col("lang") == "es") | (F.col("doc_id") % 2 == 0), "").otherwise(F.col("text"))
    rows = t.documents.select(
        sheets.declared_place("source", ORIGINS).alias("place"), "source", "doc_id",
        F.col("lang").alias("variable"), F.col("source").alias("contexto"), note.alias("descripcion"),
    )
    return sheets.consolidate_glossary(rows, order_by=["place", "source", "doc_id"])


@query("""
SELECT p_partkey, p_name, 'red' AS part_of FROM part WHERE contains(lower(p_name), 'red')
UNION ALL
SELECT p_partkey, p_name, 'ring' FROM part WHERE contains(lower(p_name), 'ring')
""")
def overlapping_split(t: Tables) -> DataFrame:
    halves = sheets.split_by_mark(t.part.select("p_partkey", "p_name"), ["red", "ring"], "p_name")
    return op.stack_tables([half.withColumn("part_of", F.lit(mark)) for mark, half in halves.items()])
