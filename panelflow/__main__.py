"""The jobs as commands: a folder in, tables out.

``python -m panelflow scores IN OUT`` (or ``spark-submit`` with this file) writes OUT/table, OUT/audit and
OUT/quarantine; so does ``indicators``.  With ``--changed`` only new and changed files are read, and only their years
and levels written again.  ``glossary`` takes a table of cells (parquet), ``analysis`` the tables of the first two.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from panelflow.operators.sized import scratch
from panelflow.plans.analysis import LABELS, clean_panel, fit_and_compare, join_panel
from panelflow.plans.glossary import build_dictionary
from panelflow.plans.indicators import consolidate_indicators
from panelflow.plans.refresh import indicator_job, refresh, score_job
from panelflow.plans.scores import Consolidated, consolidate_scores
from panelflow.presets import INDICATORS, PANEL_KEYS, SCORE_TARGETS
from panelflow.sources.sinks import write_csv, write_panel


def _options(arguments: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="panelflow", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("scores", "indicators"):
        job = jobs.add_parser(name)
        job.add_argument("folder")
        job.add_argument("out")
        job.add_argument("--csv", action="store_true", help="one CSV table in place of parquet folders by year and level")
        job.add_argument("--changed", action="store_true", help="read only what changed since the last run")
    jobs.choices["scores"].add_argument("--prefix", default="", help="what stands before the level in file names")
    jobs.choices["scores"].add_argument("--dedup", choices=["last"], help="keep one row per key")
    jobs.choices["indicators"].add_argument("--encoding", help="of all files; by default it is found for each")
    glossary = jobs.add_parser("glossary")
    glossary.add_argument("cells")
    glossary.add_argument("out")
    glossary.add_argument("--origins", nargs="+", required=True, help="in the order in which their descriptions count")
    glossary.add_argument("--generic", action="store_true", help="one entry for a variable of all levels")
    analysis = jobs.add_parser("analysis")
    analysis.add_argument("scores")
    analysis.add_argument("indicators")
    analysis.add_argument("out")
    return parser.parse_args(arguments)


def _save(done: Consolidated, options: argparse.Namespace) -> None:
    if options.csv:
        write_csv(done.table, f"{options.out}/table")
    else:
        write_panel(done.table, f"{options.out}/table")
    write_csv(done.audit, f"{options.out}/audit")
    write_csv(done.quarantine, f"{options.out}/quarantine")


def _analyse(scores: DataFrame, indicators: DataFrame, out: str) -> None:
    cleaned = clean_panel(join_panel(scores, indicators), SCORE_TARGETS)
    done = fit_and_compare(cleaned, INDICATORS, list(LABELS), SCORE_TARGETS, key="rbd", order_by=PANEL_KEYS)
    write_csv(done.comparison, f"{out}/comparison")
    write_csv(done.coefficients, f"{out}/coefficients")


def run(spark: SparkSession, arguments: Sequence[str] | None = None) -> None:
    options = _options(arguments)
    with scratch(spark):
        if options.job in ("scores", "indicators") and options.changed:
            job = score_job(options.prefix, options.dedup) if options.job == "scores" else indicator_job(options.encoding)
            done = refresh(spark, options.folder, options.out, job)
            print(f"{done.changed} files new or changed, {done.gone} gone, {done.reread} read again, {done.parts} years and levels written")
            if done.quarantine is not None:
                write_csv(done.quarantine, f"{options.out}/quarantine")
        elif options.job == "scores":
            _save(consolidate_scores(spark, options.folder, options.prefix, options.dedup), options)
        elif options.job == "indicators":
            _save(consolidate_indicators(spark, options.folder, options.encoding), options)
        elif options.job == "glossary":
            done = build_dictionary(spark.read.parquet(options.cells), options.origins, options.generic)
            write_csv(done.table, f"{options.out}/dictionary", bom=True)
            for origin, part in done.parts.items():
                write_csv(part, f"{options.out}/{origin}", bom=True)
        else:
            _analyse(spark.read.parquet(options.scores), spark.read.parquet(options.indicators), options.out)


if __name__ == "__main__":
    session = SparkSession.builder.appName("panelflow").getOrCreate()
    run(session)
    session.stop()
