"""Jobs from folder to table: full, by what changed, and as commands."""

from __future__ import annotations

import glob
import os

import pytest
from test_sources import indicator_lines, put

from panelflow.__main__ import run
from panelflow.operators.reshape import keep_last, panel_join
from panelflow.operators.sized import scratch
from panelflow.plans.indicators import consolidate_indicators
from panelflow.plans.refresh import indicator_job, refresh, score_job
from panelflow.plans.scores import consolidate_scores
from panelflow.presets import PANEL_KEYS
from panelflow.sources.sinks import write_bucketed

HEAD = ["rbd", "agno", "prom_mate_rbd", "prom_lect_rbd"]


def score_file(root, name, rows):
    put(f"{root}/in/{name}_rbd.csv", [HEAD, *rows], ";")


def parts_of(out):
    return {os.path.dirname(f).split("table/")[1]: f for f in glob.glob(f"{out}/table/*/*/*.parquet")}


def rows_of(df):
    return sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


@pytest.fixture
def scores(tmp_path):
    score_file(tmp_path, "scores2m2016", [[1, 2016, 250, 240], [2, 2016, 230, 220]])
    score_file(tmp_path, "scores4b2017", [[1, 2017, 1, 2], [1, 2017, 3, 4]])
    score_file(tmp_path, "scores4bmore2017", [[9, 2017, 7, 8], [9, 2018, 7, 8]])
    return tmp_path


def check(spark, root):
    with scratch(spark):
        full = consolidate_scores(spark, f"{root}/in", "scores", "last").table
        assert rows_of(spark.read.parquet(f"{root}/out/table")) == rows_of(full)


def test_only_the_touched_year_and_level_is_written_again(spark, scores):
    go = lambda: refresh(spark, f"{scores}/in", f"{scores}/out", score_job("scores", "last"))
    with scratch(spark):
        first = go()
        assert (first.changed, first.gone, first.reread) == (3, 0, 0)
        check(spark, scores)
        before = parts_of(f"{scores}/out")
        assert go().changed == 0 and parts_of(f"{scores}/out") == before

        score_file(scores, "scores2m2017", [[5, 2017, 9, 9]])
        done = go()
        after = parts_of(f"{scores}/out")
        assert (done.changed, done.reread, done.parts) == (1, 0, 1)
        assert {k: f for k, f in after.items() if k in before} == before and len(after) == len(before) + 1
        check(spark, scores)

        score_file(scores, "scores4b2017", [[1, 2017, 5, 6], [2, 2017, 5, 6], [3, 2017, 1, 1]])
        done = go()
        assert (done.changed, done.parts) == (1, 1)
        check(spark, scores)

        os.remove(f"{scores}/in/scores2m2016_rbd.csv")
        done = go()
        assert (done.changed, done.gone, done.parts) == (0, 1, 1)
        assert not any("agno=2016" in k for k in parts_of(f"{scores}/out"))
        check(spark, scores)
        assert go().parts == 0


def test_neighbours_of_a_changed_file_are_read_again(spark, tmp_path):
    score_file(tmp_path, "a4b2017", [[1, 2017, 1, 1], [2, 2017, 1, 1]])
    score_file(tmp_path, "b4b2017", [[2, 2017, 2, 2], [3, 2017, 2, 2]])
    score_file(tmp_path, "c4b2019", [[2, 2019, 2, 2]])
    put(f"{tmp_path}/in/broken4b2017_rbd.csv", [HEAD, [1, 2, 3, 4, 5, 6]], ";")
    with scratch(spark):
        go = lambda: refresh(spark, f"{tmp_path}/in", f"{tmp_path}/out", score_job("", "last"))
        done = go()
        assert done.changed == 4 and done.quarantine.count() == 1
        os.remove(f"{tmp_path}/in/b4b2017_rbd.csv")
        done = go()
        assert (done.gone, done.reread, done.parts) == (1, 1, 1)
        assert rows_of(spark.read.parquet(f"{tmp_path}/out/table")) == rows_of(consolidate_scores(spark, f"{tmp_path}/in", "", "last").table)
        assert go().changed == 0


def test_indicators_by_what_changed(spark, tmp_path):
    for year, shape in ((2019, "wide"), (2020, "text")):
        put(f"{tmp_path}/in/4/ind{year}.csv", indicator_lines(shape, False))
    with scratch(spark):
        go = lambda: refresh(spark, f"{tmp_path}/in", f"{tmp_path}/out", indicator_job())
        assert go().parts == 2
        put(f"{tmp_path}/in/8/ind2020.csv", indicator_lines("numeric", True), "|", "latin-1")
        assert go().parts == 1
        assert rows_of(spark.read.parquet(f"{tmp_path}/out/table")) == rows_of(consolidate_indicators(spark, f"{tmp_path}/in").table)


def test_table_and_audit_read_no_file_again(spark, scores, plan):
    put(f"{scores}/ind/4/ind2019.csv", indicator_lines("wide", False))
    with scratch(spark):
        for done in (consolidate_scores(spark, f"{scores}/in", "scores", "last"), consolidate_indicators(spark, f"{scores}/ind")):
            for frame in (done.table, done.audit):
                assert "parquet" in plan(frame) and "Scan csv" not in plan(frame) and "Scan text" not in plan(frame)


def test_commands(spark, scores):
    put(f"{scores}/ind/4/ind2017.csv", indicator_lines("wide", False))
    run(spark, ["scores", f"{scores}/in", f"{scores}/s", "--prefix", "scores", "--dedup", "last", "--csv"])
    assert spark.read.csv(f"{scores}/s/table", header=True).count() == 5
    assert [tuple(r)[2:4] for r in spark.read.csv(f"{scores}/s/audit", header=True).collect()] == [("6", "6")]
    run(spark, ["scores", f"{scores}/in", f"{scores}/t", "--prefix", "scores", "--dedup", "last", "--changed"])
    run(spark, ["indicators", f"{scores}/ind", f"{scores}/i"])
    assert spark.read.parquet(f"{scores}/t/table").count() == 5 and spark.read.parquet(f"{scores}/i/table").count() == 2
    cells = spark.createDataFrame([("s", "f2016", "a", r, c, v) for r, line in enumerate([["variable", "label"], ["x", "y"]]) for c, v in enumerate(line)],
                                  "origin string, file string, sheet string, row_idx int, col_idx int, value string")
    cells.write.parquet(f"{scores}/cells")
    run(spark, ["glossary", f"{scores}/cells", f"{scores}/g", "--origins", "s"])
    assert spark.read.csv(f"{scores}/g/dictionary", header=True).count() == 1


def test_bucketed_panels_join_and_settle_without_a_shuffle(spark, plan):
    rows = [(k % 50, 2016 + k % 3, "4b", float(k)) for k in range(200)]
    try:
        write_bucketed(spark.createDataFrame(rows, "rbd int, agno int, curso string, a double"), "panel_a", buckets=4)
        write_bucketed(spark.createDataFrame(sorted({r[:3] for r in rows}), "rbd int, agno int, curso string").selectExpr("*", "rbd * 2 AS b"), "panel_b", buckets=4)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        last = keep_last(spark.table("panel_a"), PANEL_KEYS, ["a"])
        joined = panel_join(last, spark.table("panel_b"), PANEL_KEYS, check=["right"])
        assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
        want = {r[:3]: r[3] for r in rows}
        assert {tuple(r[c] for c in PANEL_KEYS): r["a"] for r in joined.collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS panel_a")
        spark.sql("DROP TABLE IF EXISTS panel_b")
