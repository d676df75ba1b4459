"""Intermediate tables go when their scope ends."""

from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F
from test_sources import indicator_lines, put, score_files

from panelflow.operators.sized import scratch, shared_folder, written
from panelflow.plans.analysis import clean_panel, fit_and_compare
from panelflow.plans.glossary import build_dictionary
from panelflow.plans.indicators import consolidate_indicators
from panelflow.plans.scores import consolidate_scores


def tables(spark):
    return set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/table-*"))


def test_each_plan_leaves_no_table_behind(spark, tmp_path):
    before = tables(spark)
    score_files(tmp_path)
    put(f"{tmp_path}/i/4/ind2020.csv", indicator_lines("text", False))
    cells = spark.createDataFrame([("s", "f", "a", r, c, v) for r, line in enumerate([["variable", "label"], ["x", "y"]]) for c, v in enumerate(line)],
                                  "origin string, file string, sheet string, row_idx int, col_idx int, value string")
    panel = spark.range(300).select(
        F.col("id").alias("rbd"), *[F.lit("1").alias(c) for c in ("cod_grupo", "cod_depe2", "cod_rural_rbd")],
        (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 23).cast("double").alias("t"),
    )
    plans = [
        lambda: consolidate_scores(spark, f"{tmp_path}/s", "scores").table,
        lambda: consolidate_indicators(spark, f"{tmp_path}/i").table,
        lambda: build_dictionary(cells, ["s"]).table,
        lambda: fit_and_compare(clean_panel(panel, ["t"]), ["a"], ["cod_grupo"], ["t"], "rbd", ["rbd"]).comparison,
    ]
    made = 0
    for i, plan in enumerate(plans):
        with scratch(spark):
            plan().write.parquet(f"{tmp_path}/out/{i}")
            made += len(tables(spark) - before)
        assert tables(spark) == before
        assert spark.read.parquet(f"{tmp_path}/out/{i}").count() > 0
    assert made > 2


def test_tables_go_on_failure_and_inner_scopes_end_first(spark):
    before = tables(spark)
    with pytest.raises(RuntimeError), scratch(spark):
        written(spark.range(3))
        with scratch(spark):
            written(spark.range(4))
            assert len(tables(spark) - before) == 2
        assert len(tables(spark) - before) == 1
        raise RuntimeError
    assert tables(spark) == before


def test_a_cleaned_panel_reads_its_sources_once(spark, tmp_path, plan):
    rows = spark.range(200).select(F.lit("1").alias("cod_grupo"), F.lit("1").alias("cod_depe2"), F.lit("2").alias("cod_rural_rbd"),
                                   *[(F.col("id") % m).cast("double").alias(f"t{m}") for m in (7, 11)])
    rows.write.parquet(f"{tmp_path}/source")
    source = spark.read.parquet(f"{tmp_path}/source")
    cleaned = clean_panel(source, ["t7", "t11"])
    assert f"{tmp_path}/source" not in plan(cleaned) and "/table-" in plan(cleaned)
