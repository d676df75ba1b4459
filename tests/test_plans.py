"""What the physical plans must and must not contain."""

from __future__ import annotations

import pytest

from panelflow.registry import QUERIES

NAMES = sorted(QUERIES)


@pytest.fixture
def tables(monkeypatch, plan):
    """Plans of the frames that a query writes while it is built."""
    from pyspark.sql.classic.dataframe import DataFrame
    from pyspark.sql.readwriter import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet

    def watched(self, path, *args, **options):
        if "/table-" in path:
            plans.append(plan(DataFrame(self._df._jdf, self._df.sparkSession)))
        return write(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    return plans


@pytest.mark.parametrize("name", NAMES)
def test_no_python_and_no_cross_join(spark, small, plan, name, tables):
    text = "\n".join([plan(QUERIES[name](spark, small)), *tables])
    for node in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


def test_columns_are_pruned_and_filters_pushed(spark, small, plan):
    text = plan(QUERIES["iqr_filter"](spark, small))
    assert "ReadSchema: struct<event_id:bigint,value:double>" in text
    assert "GreaterThanOrEqual(value" in text and "LessThanOrEqual(value" in text
    text = plan(QUERIES["dropna_subset"](spark, small))
    assert "o_orderdate" not in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_extendedprice:double,l_returnflag:string>" in plan(
        QUERIES["scan_parquet"](spark, small)
    )


def test_one_shuffle_for_pivot_with_context(spark, small, plan):
    text = plan(QUERIES["long_to_wide"](spark, small))
    assert text.count("\n(") and text.count("Exchange (") == 1


def test_grouped_lines_keep_their_partitioning_for_the_join(spark, small, plan):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["panel_inner_join"](spark, small))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange (") == 2


def test_hidden_plans_are_seen_and_pruned(spark, small, tables):
    QUERIES["kfold_text_order"](spark, small)
    assert any("ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in text for text in tables)
