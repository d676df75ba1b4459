"""Intermediate tables in the shared folder, and joins with sides of unknown size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only for local runs."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="panelflow-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


_scope: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables written inside, at the end or on failure.

    Results are lazy and read those tables, so build and save a result within one scope::

        with scratch(spark):
            write_panel(clean_panel(join_panel(scores, indicators), targets), path)

    Without a scope the tables stay until someone deletes them from the shared folder.
    """
    mine: list[str] = []
    outer = _scope.set(mine)
    try:
        yield
    finally:
        _scope.reset(outer)
        for path in mine:
            _delete(spark, path)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder for a table or for files of one's own; ``scratch`` bounds its life too."""
    path = f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    if (tables := _scope.get()) is not None:
        tables.append(path)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete such a folder before its scope ends."""
    _delete(spark, path)


def written(df: DataFrame) -> DataFrame:
    """The same rows read back from a table in the shared folder.

    They are computed once, survive lost executors, have no lineage, and their size is known to
    the planner from their files.  ``scratch`` bounds the table's life.
    """
    return written_at(df)[0]


def written_at(df: DataFrame) -> tuple[DataFrame, str]:
    """Such a table, and its folder for ``drop_folder`` once nothing reads it any more."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


BATCH_BYTES = 2 << 20


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Jobs run inside pass rows to Python in Arrow batches of about ``size`` bytes.

    Spark's own bound of 10,000 rows is 25 MB of middling texts, which a task holds several times over: as vectors and
    as a stream in the executor, and as arrays and their copies in Python.  The batch of a long text is that text.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def join_written(df: DataFrame, side: DataFrame, on: Sequence[str] | Column, how: str = "inner") -> DataFrame:
    """Join a large frame with an aggregate ``side`` of unknown size.

    The side is written first, so Spark plans with its real size: below
    ``spark.sql.autoBroadcastJoinThreshold`` it is broadcast, the large frame is not shuffled and
    a hot key costs nothing; above it both sides are shuffled and the adaptive skew join splits
    the hot partitions.
    """
    return df.join(written(side), on if isinstance(on, Column) else list(on), how)
