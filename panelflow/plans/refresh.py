"""Consolidation that reads only what changed.

A target folder holds ``table``, in one folder per year and level, and ``manifest``: which file, of which size and
time, gave rows to which year and level.  A run compares the files there are with the manifest, reads new
and changed ones, and with them the unchanged ones that share a year and level with a file that came, changed or
went.  Only those years and levels are written again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelflow.operators.sized import drop_folder, written
from panelflow.plans.indicators import finish_indicators, indicator_files, read_indicators
from panelflow.plans.scores import finish_scores, read_scores, score_files
from panelflow.sources.discover import bare, file_states

PARTS = ("agno", "curso")
MANIFEST = "path string, length long, modified timestamp, agno int, curso string, empty boolean"


@dataclass(frozen=True)
class Job:
    """Which files count, how some of them are read (rows with places, quarantine), and what is made of the rows.

    What is made of a year and level depends on its own rows alone.
    """

    files: Callable[[SparkSession, str], DataFrame]
    read: Callable[[SparkSession, Sequence[str]], tuple[DataFrame, DataFrame]]
    finish: Callable[[DataFrame], DataFrame]


def score_job(prefix: str = "", dedup: str | None = "last") -> Job:
    return Job(score_files, partial(read_scores, prefix=prefix), partial(finish_scores, dedup=dedup))


def indicator_job(encoding: str | None = None) -> Job:
    return Job(indicator_files, partial(read_indicators, encoding=encoding), finish_indicators)


@dataclass
class Refreshed:
    """Files read, and years and levels written again; the quarantine of the files read."""

    changed: int
    gone: int
    reread: int
    parts: int
    quarantine: DataFrame | None = None


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _same(columns: Sequence[str], left: DataFrame, right: DataFrame):
    test = F.lit(True)
    for c in columns:
        test = test & left[c].eqNullSafe(right[c])
    return test


def refresh(spark: SparkSession, folder: str, target: str, job: Job) -> Refreshed:
    """Bring ``target`` up to date with the files below ``folder``.

    The table is written before the manifest, so a run that was cut off is repeated by the next one.  Paths of
    the files to read pass through the driver, one line of facts each, as with every reading by layout.
    """
    table, manifest = f"{target.rstrip('/')}/table", f"{target.rstrip('/')}/manifest"
    old = written(spark.read.schema(MANIFEST).parquet(manifest) if _there(spark, manifest) else spark.createDataFrame([], MANIFEST))
    wanted = job.files(spark, folder).select(bare("path").alias("bare"))
    now = written(file_states(spark, folder).withColumn("bare", bare("path")).join(wanted, "bare", "left_semi").drop("bare"))
    known = old.select("path", "length", "modified").distinct()
    changed = written(now.join(known, _same(("path", "length", "modified"), now, known), "left_anti"))
    gone = written(known.join(now, "path", "left_anti"))
    paths = [r["path"] for r in changed.select("path").orderBy("path").collect()]
    lost = gone.count()
    if not paths and not lost:
        return Refreshed(0, 0, 0, 0)

    fresh, quarantine = job.read(spark, paths)
    fresh = written(fresh)
    before = old.where("NOT empty").join(changed.select("path").union(gone.select("path")), "path", "left_semi")
    touched = written(fresh.select(*PARTS).union(before.select(*PARTS)).distinct())
    staying = old.join(changed.select("path").union(gone.select("path")), "path", "left_anti")
    near = staying.where("NOT empty").join(touched, _same(PARTS, staying, touched), "left_semi").select("path").distinct()
    neighbours = [r["path"] for r in near.orderBy("path").collect()]
    rest, _ = job.read(spark, neighbours)
    rows = written(fresh.unionByName(rest.join(touched, _same(PARTS, rest, touched), "left_semi"), allowMissingColumns=True))
    result = written(job.finish(rows))
    result.hint("rebalance", *PARTS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(table)
    filled = result.select(*PARTS).distinct()
    for part in touched.join(filled, _same(PARTS, touched, filled), "left_anti").collect():  # years and levels that lost all rows
        drop_folder(spark, f"{table}/" + "/".join(f"{c}={'__HIVE_DEFAULT_PARTITION__' if part[c] is None else part[c]}" for c in PARTS))

    origin = fresh.select(bare("_path").alias("bare"), *PARTS).distinct().withColumn("empty", F.lit(False))
    noted = changed.withColumn("bare", bare("path")).join(origin, "bare", "left").withColumn("empty", F.coalesce("empty", F.lit(True)))
    renewed = written(staying.unionByName(noted.select(*staying.columns)))
    renewed.write.mode("overwrite").parquet(manifest)
    return Refreshed(len(paths), lost, len(neighbours), touched.count(), quarantine)
