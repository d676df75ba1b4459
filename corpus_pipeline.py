"""From raw documents to packed training sequences, in stages that each write their result.

Every stage but the last returns the columns of ``documents``.  The first three decide by doc_id: rows
that share an id stay if any of them is to stay, and rows without an id, which cannot be told apart, all stay.
Null texts count as empty; empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelflow.llm.exact_dedup import exact_dedup
from panelflow.llm.jaccard import jaccard_components
from panelflow.llm.packing import pack
from panelflow.llm.suffix_dedup import remove_repeats
from panelflow.llm.toxicity import score_toxicity
from panelflow.operators.sized import drop_folder, new_folder, scratch, small_batches, written


def only(docs: DataFrame, verdicts: DataFrame, stays: Column) -> DataFrame:
    """Documents but for those ids of which no row of ``verdicts`` stays."""
    gone = verdicts.groupBy("doc_id").agg(F.bool_or(stays).alias("stays")).filter("NOT stays").select("doc_id")
    return docs.join(written(gone), "doc_id", "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the labelled examples call toxic."""
    with small_batches(spark):
        scores = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        return only(docs, scores, F.col("predicted") == 0)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are the same but for white space, the longest stays."""
    with small_batches(spark):
        return only(docs, exact_dedup(docs), F.col("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8) the smallest id stays."""
    with small_batches(spark):
        return only(docs, jaccard_components(docs), F.col("doc_id") == F.col("component_id"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the byte strings of 50 and more that an earlier document has.

    n_chars follows the text; a document of which nothing but white space is left goes.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = remove_repeats(docs, as_text=True, carry=[*others, "n_chars"])
    left = cut.filter((F.col("n_removed") == 0) | F.col("kept").rlike("[^ \t\n\x0b\x0c\r]"))
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("rest.n_chars"))}
    return left.select(*[(new[c] if c in new else F.col("rest")[c]).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of byte tokens."""
    return pack(docs, F.octet_length("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: Trained scores, components and window covers: SQL says none of them; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = new_folder(spark, "pipeline"), None
    for name, stage in STAGES:
        with scratch(spark):  # a stage's own tables go when its result is written
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            drop_folder(spark, f"{folder}/{before}")
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
    return docs
