"""Every registered query against its SQL twin."""

from __future__ import annotations

import pytest
from oracle import compare, connect

from panelflow.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, small, con, name):
    assert name in ORACLES
    assert compare(QUERIES[name](spark, small), con, ORACLES[name]) is None


QUANTILES = ["quantiles", "describe_columns", "describe_with_nulls", "iqr_filter", "iqr_filter_sequential", "box_stats", "box_stats_ordered"]


@pytest.mark.parametrize("name", QUANTILES)
def test_bracketed_quantiles_equal_sql(spark, small, con, name, monkeypatch):
    from panelflow.operators import cleaning, profiling, ranks

    for function in (ranks.exact_quantiles, profiling.describe, profiling.box_stats, cleaning.tukey_fence, cleaning.drop_outliers):
        small_limits = tuple({ranks.PERCENTILE_ROWS: 0, ranks.ONE_TASK_ROWS: 500}.get(v, v) if isinstance(v, int) else v for v in function.__defaults__)
        monkeypatch.setattr(function, "__defaults__", small_limits)
    assert compare(QUERIES[name](spark, small), con, ORACLES[name]) is None
