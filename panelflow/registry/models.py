"""Split, scaling, regression, cross-validation and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelflow.operators import modelling as op
from panelflow.operators.absorbed import fit_absorbed
from panelflow.operators.profiling import histogram, joint_range, scatter, scatter_cells
from panelflow.operators.ranks import contiguous_folds
from panelflow.operators.reshape import panel_join
from panelflow.operators.sized import written
from panelflow.plans.analysis import fit_and_compare
from panelflow.registry.aggregates import gridded_histogram, sql_histogram
from panelflow.registry.base import Tables, grid, query, sql_grid

SALT = "42/"

NUMERIC = ["quantity", "discount", "tax"]
CATEGORICAL = ["c_mktsegment", "o_orderstatus", "o_orderpriority"]
TARGETS = ["price", "o_totalprice"]
LABELS = {
    "c_mktsegment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "o_orderstatus": ["F", "O", "P"],
    "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
}


def sql_is_test(key: str) -> str:
    return f"CAST('0x' || substr(md5(concat('{SALT}', {key})), 1, 8) AS BIGINT) % 100 < 20"


def line_key() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


SQL_LINE_KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def split_lines(t: Tables) -> DataFrame:
    return op.holdout_split(t.lineitem, line_key(), salt=SALT)


SQL_LINES = f"(SELECT *, {sql_is_test(SQL_LINE_KEY)} AS is_test FROM lineitem)"

SQL_LINE_FIT = f"""(
  SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept
  FROM {SQL_LINES} WHERE NOT is_test)"""

SQL_SCORED = f"""(
  SELECT l_extendedprice AS y, intercept + slope * l_quantity AS predicted FROM {SQL_LINES}, {SQL_LINE_FIT} WHERE is_test)"""


def scored_lines(t: Tables) -> DataFrame:
    lines = split_lines(t).select("l_quantity", F.col("l_extendedprice").alias("y"), "is_test")
    line_fit = op.simple_fit(lines.where("not is_test"), "l_quantity", "y")
    return op.simple_predict(lines.where("is_test"), line_fit, "l_quantity")


@query(f"SELECT event_id, {sql_is_test('event_id')} AS is_test FROM events")
def holdout_split(t: Tables) -> DataFrame:
    return op.holdout_split(t.events.select("event_id"), "event_id", salt=SALT)


@query(f"""
SELECT l_orderkey, l_linenumber, {sql_grid('(l_quantity - m1) / s1')} AS z_quantity, {sql_grid('(l_tax - m2) / s2')} AS z_tax, is_test
FROM {SQL_LINES}, (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_tax) AS m2, stddev_pop(l_tax) AS s2
                   FROM {SQL_LINES} WHERE NOT is_test)
""")
def zscore(t: Tables) -> DataFrame:
    scaled = op.zscore(split_lines(t), ["l_quantity", "l_tax"], train=~F.col("is_test"))
    return scaled.select(
        "l_orderkey", "l_linenumber", grid("z_l_quantity").alias("z_quantity"), grid("z_l_tax").alias("z_tax"), "is_test"
    )


@query(f"""
SELECT l_orderkey, l_linenumber, is_test, CAST(f = 'A' AS INTEGER)::DOUBLE AS f_A, CAST(f = 'R' AS INTEGER)::DOUBLE AS f_R
FROM (SELECT l_orderkey, l_linenumber, is_test, CASE WHEN l_returnflag = 'N' AND NOT is_test THEN 'A' ELSE l_returnflag END AS f
      FROM {SQL_LINES})
""")
def one_hot(t: Tables) -> DataFrame:
    flag = F.when((F.col("l_returnflag") == "N") & ~F.col("is_test"), "A").otherwise(F.col("l_returnflag"))
    lines = split_lines(t).select("l_orderkey", "l_linenumber", "is_test", flag.alias("f"))
    return op.one_hot(lines, "f", train=~F.col("is_test")).drop("f")


@query(f"""
SELECT {sql_grid('regr_slope(l_extendedprice, l_quantity)')} AS slope,
       {sql_grid('regr_intercept(l_extendedprice, l_quantity)', 4)} AS intercept, count(*) AS n
FROM lineitem
""")
def ols_simple(t: Tables) -> DataFrame:
    line = op.simple_fit(t.lineitem, "l_quantity", "l_extendedprice")
    return line.select(grid("slope").alias("slope"), grid("intercept", 4).alias("intercept"), "n")


def lines_with_orders(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity", "l_extendedprice")
    return lines.join(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")


def _sql_within(category: str) -> str:
    return f"""
WITH p AS (SELECT l_quantity AS x, l_extendedprice AS y, {category} FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT {category}, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM p GROUP BY {category}),
s AS (SELECT regr_slope(y - my, x - mx) AS slope FROM p JOIN m ON p.{category} = m.{category}),
e AS (SELECT {category}, n, slope, my - slope * mx AS effect FROM m, s)"""


@query(_sql_within("o_orderstatus") + f"""
SELECT o_orderstatus, n, {sql_grid('slope')} AS slope, {sql_grid('effect', 4)} AS effect,
       {sql_grid('effect - (SELECT avg(effect) FROM e)', 4)} AS coefficient FROM e
""")
def ols_within_category(t: Tables) -> DataFrame:
    effects = op.within_category_fit(lines_with_orders(t), "l_quantity", "l_extendedprice", "o_orderstatus")
    return effects.select(
        "o_orderstatus",
        "n",
        grid("slope").alias("slope"),
        grid("effect", 4).alias("effect"),
        grid("coefficient", 4).alias("coefficient"),
    )


@query(_sql_within("o_orderpriority") + f""",
c AS (SELECT o_orderpriority AS term, effect - (SELECT avg(effect) FROM e) AS coefficient FROM e)
SELECT term, {sql_grid('coefficient', 4)} AS coefficient, CASE WHEN coefficient > 0 THEN 'positive' ELSE 'negative' END AS sign
FROM c ORDER BY abs(coefficient) DESC, term LIMIT 5
""")
def top_effects(t: Tables) -> DataFrame:
    effects = op.within_category_fit(lines_with_orders(t), "l_quantity", "l_extendedprice", "o_orderpriority")
    top = op.top_effects(effects.withColumnRenamed("o_orderpriority", "term"))
    return top.select("term", grid("coefficient", 4).alias("coefficient"), "sign")


@query(f"""
SELECT l_orderkey, l_linenumber, {sql_grid('intercept + slope * l_quantity', 4)} AS predicted FROM lineitem, {SQL_LINE_FIT}
""")
def predict_simple(t: Tables) -> DataFrame:
    lines = split_lines(t)
    line_fit = op.simple_fit(lines.where("not is_test"), "l_quantity", "l_extendedprice")
    scored = op.simple_predict(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), line_fit, "l_quantity")
    return scored.select("l_orderkey", "l_linenumber", grid("predicted", 4).alias("predicted"))


@query(f"""
SELECT count(*) AS n, {sql_grid('avg(abs(y - predicted))', 4)} AS mae, {sql_grid('sqrt(avg((y - predicted) * (y - predicted)))', 4)} AS rmse,
       {sql_grid('1 - sum((y - predicted) * (y - predicted)) / (var_pop(y) * count(*))')} AS r2
FROM {SQL_SCORED}
""")
def regression_metrics(t: Tables) -> DataFrame:
    m = op.regression_metrics(scored_lines(t), "y", "predicted")
    return m.select("n", grid("mae", 4).alias("mae"), grid("rmse", 4).alias("rmse"), grid("r2").alias("r2"))


@query(sql_histogram(f"SELECT y - predicted AS x FROM {SQL_SCORED}", 4))
def residual_histogram(t: Tables) -> DataFrame:
    # Written once: the range and the counts are two passes over it.
    residuals = written(op.residuals(scored_lines(t), "y", "predicted").select("residual"))
    return gridded_histogram(histogram(residuals, "residual", 40), 4)


@query(f"""
WITH s AS {SQL_SCORED}
SELECT {sql_grid('y', 2)} AS y, {sql_grid('predicted', 4)} AS predicted, {sql_grid('lo', 2)} AS line_lo, {sql_grid('hi', 2)} AS line_hi
FROM s, (SELECT least(min(y), min(predicted)) AS lo, greatest(max(y), max(predicted)) AS hi FROM s)
""")
def actual_vs_predicted(t: Tables) -> DataFrame:
    scored = written(scored_lines(t).select("y", "predicted"))
    ends = joint_range(scored, "y", "predicted").select(F.struct("lo", "hi").alias("ends")).scalar()
    ranged = scored.withColumn("ends", ends)
    return ranged.select(
        grid("y", 2).alias("y"),
        grid("predicted", 4).alias("predicted"),
        grid("ends.lo", 2).alias("line_lo"),
        grid("ends.hi", 2).alias("line_hi"),
    )


FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS indicator, CAST({c} AS DOUBLE) AS x, l_extendedprice AS y FROM lineitem" for c in FEATURES))
def scatter_long(t: Tables) -> DataFrame:
    return scatter(t.lineitem, FEATURES, "l_extendedprice")


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS indicator, CAST(floor({c} / {w}::DOUBLE) AS BIGINT) AS x_cell,
            CAST(floor(l_extendedprice / 5000.0::DOUBLE) AS BIGINT) AS y_cell, count(*) AS rows FROM lineitem GROUP BY ALL"""
        for c, w in (("l_quantity", 5.0), ("l_linenumber", 1.0))
    )
)
def scatter_binned(t: Tables) -> DataFrame:
    return scatter_cells(t.lineitem, ["l_quantity", "l_linenumber"], "l_extendedprice", {"l_quantity": 5.0, "l_linenumber": 1.0}, 5000.0)


@query("SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders")
def kfold_assign(t: Tables) -> DataFrame:
    return contiguous_folds(t.orders.select("o_orderkey"), ["o_orderkey"], 5)


@query("SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS INTEGER) AS fold FROM orders")
def kfold_text_order(t: Tables) -> DataFrame:
    """Folds of an order that a text column leads."""
    return contiguous_folds(t.orders.select("o_orderpriority", "o_orderkey"), ["o_orderpriority", "o_orderkey"], 5).drop("o_orderpriority")


def sql_fold_r2(rows: str, x: str, y: str) -> str:
    """(fold, r2) of a one-feature line fitted on the other folds of a relation with ``fold``."""
    return f"""
  SELECT f.fold, 1 - sum((r.{y} - f.a - f.b * r.{x}) * (r.{y} - f.a - f.b * r.{x})) / (var_pop(r.{y}) * count(*)) AS r2
  FROM (SELECT k AS fold, regr_slope({y}, {x}) AS b, regr_intercept({y}, {x}) AS a
        FROM {rows}, range(5) g(k) WHERE fold <> k GROUP BY k) f
  JOIN {rows} r ON r.fold = f.fold GROUP BY f.fold"""


@query(f"""
WITH o AS (SELECT o_custkey, o_totalprice, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders)
SELECT CAST(fold AS INTEGER) AS fold, 'o_totalprice' AS target, {sql_grid('r2')} AS r2 FROM ({sql_fold_r2('o', 'o_custkey', 'o_totalprice')})
""")
def kfold_r2_simple(t: Tables) -> DataFrame:
    scores = op.cross_validate(t.orders, ["o_custkey"], [], ["o_totalprice"], ["o_orderkey"], 5)
    return scores.select("fold", "target", grid("r2").alias("r2"))


# ------------------------------------------------------------------ the joined panel


def order_panel(t: Tables) -> DataFrame:
    """One row per order: two targets, three numeric and three categorical features.

    Lines are folded to their order before the join, and the join reuses that partitioning.
    """
    per_order = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("quantity"),
        F.avg("l_discount").alias("discount"),
        F.avg("l_tax").alias("tax"),
        F.sum("l_extendedprice").alias("price"),
    )
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    panel = panel_join(orders, per_order, ["o_orderkey"], check=())
    segments = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return panel.join(segments, "o_custkey")


SQL_PANEL = f"""(
  SELECT o_orderkey, quantity, discount, tax, price, o_totalprice, c_mktsegment, o_orderstatus, o_orderpriority,
         {sql_is_test('o_orderkey')} AS is_test, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold
  FROM orders
  JOIN (SELECT l_orderkey, sum(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_tax) AS tax,
               sum(l_extendedprice) AS price FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey)"""


def _sql_design() -> tuple[str, list[tuple[str, str]]]:
    """Design row in SQL (last label of each category left out) and its (kind, term) names."""
    cells, names = ["1.0::DOUBLE"], [("", "(intercept)")]
    for i, c in enumerate(NUMERIC):
        cells.append(f"({c} - m{i}) / s{i}")
        names.append(("#", c))
    for c in CATEGORICAL:
        for label in LABELS[c][:-1]:
            cells.append(f"CAST({c} = '{label}' AS INTEGER)::DOUBLE")
            names.append((c, f"{c}_{label}"))
    return ", ".join(cells), names


def sql_normal_equations(models: str) -> str:
    """CTEs that solve the normal equations of every model by elimination.

    ``models`` is a relation (model, keep condition over the panel alias p) already joined: it
    yields rows (model, v) with v the design row followed by both targets.
    """
    _, names = _sql_design()
    p = len(names)
    return f"""
gram AS (SELECT model, i, j, sum(v[i] * v[j]) AS e FROM ({models}), range(1, {p + 1}) a(i), range(1, {p + 3}) b(j) GROUP BY model, i, j),
lines AS (SELECT model, i, list(e ORDER BY j) AS line FROM gram GROUP BY model, i),
start AS (SELECT model, list(line ORDER BY i) AS m FROM lines GROUP BY model),
solved AS (
  SELECT model, 1 AS k, m FROM start
  UNION ALL
  SELECT model, k + 1, list_transform(m, lambda line, i: CASE WHEN i = k
      THEN list_transform(line, lambda x: x / line[k])
      ELSE list_transform(line, lambda x, j: x - line[k] * m[k][j] / m[k][k]) END)
  FROM solved WHERE k <= {p}),
beta AS (SELECT model, list_transform(m, lambda line: line[{p + 1}]) AS b1, list_transform(m, lambda line: line[{p + 2}]) AS b2
         FROM solved WHERE k = {p + 1})"""


def _sql_rows(train: str) -> str:
    cells, _ = _sql_design()
    stats = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(NUMERIC))
    return f"""
panel AS (SELECT * FROM {SQL_PANEL}),
stats AS (SELECT {stats}, avg(price) AS y1, avg(o_totalprice) AS y2 FROM panel WHERE {train}),
design AS (SELECT is_test, fold, price - y1 AS t1, o_totalprice - y2 AS t2, [{cells}] AS x,
                  [{cells}, price - y1, o_totalprice - y2] AS v FROM panel, stats)"""


def _sql_coefficients() -> str:
    _, names = _sql_design()
    rows = [(i, kind, term) for i, (kind, term) in enumerate(names, 1)]
    rows += [("NULL", c, f"{c}_{LABELS[c][-1]}") for c in CATEGORICAL]
    values = ", ".join(f"({i}, '{kind}', '{term}')" for i, kind, term in rows)
    terms = [term for _, term in names[: 1 + len(NUMERIC)]] + [f"{c}_{v}" for c in CATEGORICAL for v in LABELS[c]]
    places = ", ".join(f"'{term}'" for term in terms)
    return f"""
WITH RECURSIVE {_sql_rows('NOT is_test')}, {sql_normal_equations("SELECT 0 AS model, v FROM design WHERE NOT is_test")},
named AS (SELECT CAST(i AS INTEGER) AS i, kind, term FROM (VALUES {values}) n(i, kind, term)),
raw AS (
  SELECT 'price' AS target, kind, term, coalesce(b1[i], 0.0) AS c, y1 AS y FROM named, beta, stats
  UNION ALL SELECT 'o_totalprice', kind, term, coalesce(b2[i], 0.0), y2 FROM named, beta, stats),
means AS (SELECT target, kind, avg(c) AS mean FROM raw WHERE kind NOT IN ('', '#') GROUP BY target, kind),
shift AS (SELECT target, sum(mean) AS total FROM means GROUP BY target)
SELECT r.target, CAST(list_position([{places}], term) - 1 AS INTEGER) AS position, term,
       {sql_grid("CASE WHEN r.kind = '' THEN c + y + total WHEN r.kind = '#' THEN c ELSE c - mean END", 3)} AS coefficient
FROM raw r LEFT JOIN means m ON r.target = m.target AND r.kind = m.kind JOIN shift s ON r.target = s.target"""


@query(_sql_coefficients())
def coefficient_table(t: Tables) -> DataFrame:
    train = written(op.holdout_split(order_panel(t), "o_orderkey", salt=SALT).where("not is_test"))
    models = op.fit(train, NUMERIC, CATEGORICAL, TARGETS)
    table = op.coefficient_table(t.spark, models)
    return table.select("target", "position", "term", grid("coefficient", 3).alias("coefficient"))


@query(f"""
WITH RECURSIVE {_sql_rows('NOT is_test')}, {sql_normal_equations("SELECT 0 AS model, v FROM design WHERE NOT is_test")},
scored AS (SELECT 'price' AS target, t1 + y1 AS y, list_dot_product(x, b1) + y1 AS p FROM design, beta, stats WHERE is_test
           UNION ALL SELECT 'o_totalprice', t2 + y2, list_dot_product(x, b2) + y2 FROM design, beta, stats WHERE is_test)
SELECT target, count(*) AS n, {sql_grid('avg(p)', 3)} AS mean_predicted, {sql_grid('avg(abs(y - p))', 4)} AS mae,
       {sql_grid('sqrt(avg((y - p) * (y - p)))', 4)} AS rmse, {sql_grid('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')} AS r2
FROM scored GROUP BY target
""")
def ols_multi(t: Tables) -> DataFrame:
    split = written(op.holdout_split(order_panel(t), "o_orderkey", salt=SALT))
    models = op.fit(split.where("not is_test"), NUMERIC, CATEGORICAL, TARGETS)
    scored = split.where("is_test")
    rows = scored.select(
        F.explode(F.array(*[
            F.struct(F.lit(m.target).alias("target"), F.col(m.target).alias("y"), m.prediction().alias("p")) for m in models
        ])).alias("s")
    ).select("s.*")
    e = F.col("y") - F.col("p")
    return rows.groupBy("target").agg(
        F.count(F.lit(1)).alias("n"),
        grid(F.avg("p"), 3).alias("mean_predicted"),
        grid(F.avg(F.abs(e)), 4).alias("mae"),
        grid(F.sqrt(F.avg(e * e)), 4).alias("rmse"),
        grid(1 - F.sum(e * e) / (F.var_pop("y") * F.count(F.lit(1)))).alias("r2"),
    )


def _gridded_comparison(table: DataFrame) -> DataFrame:
    return table.select("metric", *[grid(c, 4).alias(c) for c in TARGETS])


def _sql_simple_metrics(y: str) -> str:
    return f"""
  SELECT avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2
  FROM (SELECT {y} AS y, a + b * quantity AS p FROM panel,
          (SELECT regr_slope({y}, quantity) AS b, regr_intercept({y}, quantity) AS a FROM panel WHERE NOT is_test) WHERE is_test)"""


@query(f"""
WITH panel AS (SELECT * FROM {SQL_PANEL}),
m1 AS ({_sql_simple_metrics('price')}), m2 AS ({_sql_simple_metrics('o_totalprice')}),
c1 AS (SELECT avg(r2) AS r2 FROM ({sql_fold_r2('panel', 'quantity', 'price')})),
c2 AS (SELECT avg(r2) AS r2 FROM ({sql_fold_r2('panel', 'quantity', 'o_totalprice')}))
SELECT 'MAE' AS metric, {sql_grid('m1.mae', 4)} AS price, {sql_grid('m2.mae', 4)} AS o_totalprice FROM m1, m2
UNION ALL SELECT 'RMSE', {sql_grid('m1.rmse', 4)}, {sql_grid('m2.rmse', 4)} FROM m1, m2
UNION ALL SELECT 'R2', {sql_grid('m1.r2', 4)}, {sql_grid('m2.r2', 4)} FROM m1, m2
UNION ALL SELECT 'R2_CV', {sql_grid('c1.r2', 4)}, {sql_grid('c2.r2', 4)} FROM c1, c2
""")
def compare_models(t: Tables) -> DataFrame:
    done = fit_and_compare(order_panel(t), ["quantity"], [], TARGETS, "o_orderkey", ["o_orderkey"], salt=SALT)
    return _gridded_comparison(done.comparison)


def _sql_r2(y: str, p: str) -> str:
    return f"1 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) * count(*))"


@query(f"""
WITH RECURSIVE {_sql_rows('true')},
{sql_normal_equations("SELECT -1 AS model, v FROM design WHERE NOT is_test UNION ALL SELECT k, v FROM design, range(5) g(k) WHERE fold <> k")},
test AS (SELECT t1, t2, list_dot_product(x, b1) AS p1, list_dot_product(x, b2) AS p2 FROM design JOIN beta ON model = -1 WHERE is_test),
folds AS (SELECT avg(r1) AS r1, avg(r2) AS r2 FROM (
  SELECT fold, {_sql_r2('t1', 'p1')} AS r1, {_sql_r2('t2', 'p2')} AS r2
  FROM (SELECT fold, t1, t2, list_dot_product(x, b1) AS p1, list_dot_product(x, b2) AS p2 FROM design JOIN beta ON model = fold)
  GROUP BY fold))
SELECT 'MAE' AS metric, {sql_grid('avg(abs(t1 - p1))', 4)} AS price, {sql_grid('avg(abs(t2 - p2))', 4)} AS o_totalprice FROM test
UNION ALL SELECT 'RMSE', {sql_grid('sqrt(avg((t1 - p1) * (t1 - p1)))', 4)}, {sql_grid('sqrt(avg((t2 - p2) * (t2 - p2)))', 4)} FROM test
UNION ALL SELECT 'R2', {sql_grid(_sql_r2('t1', 'p1'), 4)}, {sql_grid(_sql_r2('t2', 'p2'), 4)} FROM test
UNION ALL SELECT 'R2_CV', {sql_grid('r1', 4)}, {sql_grid('r2', 4)} FROM folds
""")
def compare_targets_full(t: Tables) -> DataFrame:
    """The whole analysis on the joined panel: all features, both targets, hold-out and folds."""
    done = fit_and_compare(order_panel(t), NUMERIC, CATEGORICAL, TARGETS, "o_orderkey", ["o_orderkey"], salt=SALT)
    return _gridded_comparison(done.comparison)


@query(f"""
WITH g AS (SELECT l_partkey, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem GROUP BY l_partkey),
b AS (SELECT sum((l_quantity - mx) * (l_extendedprice - my)) / sum((l_quantity - mx) * (l_quantity - mx)) AS slope FROM lineitem JOIN g USING (l_partkey)),
e AS (SELECT l_partkey, slope, my - slope * mx AS raw FROM g, b)
SELECT l_partkey, {sql_grid("raw - avg(raw) OVER ()", 3)} AS effect, {sql_grid("slope", 3)} AS slope, {sql_grid("avg(raw) OVER ()", 3)} AS intercept FROM e
""")
def fit_many_labels(t: Tables) -> DataFrame:
    """Price by quantity and part, one effect per part: labels beyond what a one-hot design holds."""
    model = fit_absorbed(t.lineitem, ["l_quantity"], ["l_partkey"], "l_extendedprice")
    return model.effects.select(
        F.substring("label", 2, 30).cast("bigint").alias("l_partkey"),
        grid("effect", 3).alias("effect"),
        grid(F.lit(model.numeric["l_quantity"]), 3).alias("slope"),
        grid(F.lit(model.intercept), 3).alias("intercept"),
    )
