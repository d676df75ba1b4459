"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Each text gets a SHA-256 of its bytes without ASCII white space; its first 64 bits are the
   fingerprint.  Rows are cut into runs of at most ``RUN`` rows.
2. A run sorts its distinct fingerprints and sends each owner (a range of fingerprints) one Golomb-coded
   piece; the owner answers with one bit per fingerprint: does another run have it?
3. Only rows with that bit, or with a fingerprint that their own run repeats, are suspects.  Their texts are shuffled and grouped by the bytes
   themselves, so a hot text is folded in the map tasks and equality is decided by bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from panelflow.llm import golomb
from panelflow.llm.texts import BLANK, buffers
from panelflow.operators.sized import written

RUN_BITS = 19  # a run has at most 2**19 rows
OWNER_ROWS = 1 << 20  # fingerprints that one owner holds, about


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANK.decode(), "")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = buffers(batch.column("text"))
        whole = memoryview(data)
        digests = [
            hashlib.sha256(bytes(whole[a:b]).translate(None, BLANK)).digest() for a, b in zip(bounds[:-1], bounds[1:])
        ]
        chars = pc.utf8_length(batch.column("text").fill_null("")).cast(pa.int64())
        head = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)[:, :8]
        marks = np.ascontiguousarray(head).view(">u8").ravel().astype(np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), chars, pa.array(digests, pa.binary()), pa.array(marks)],
            names=["doc_id", "row", "n_chars", "sha", "mark"],
        )


def _owner(marks: np.ndarray, owners: int) -> np.ndarray:
    """Ranges of the upper 32 bits, so that a sorted run is cut into one piece per owner."""
    return ((marks >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def _range(owner: int, owners: int) -> tuple[int, int]:
    first = (-((-owner << 32) // owners)) << 32
    return first, ((-((-(owner + 1) << 32) // owners)) << 32) - first


_PIECES = pa.schema([("run", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32()), ("unary", pa.binary()), ("rest", pa.binary())])
_ANSWERS = pa.schema([("run", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("bits", pa.binary())])


def _marks(rows: pa.Table) -> np.ndarray:
    return rows.column("mark").to_numpy().astype(np.int64).view(np.uint64)


def duplicated(thin: DataFrame, owners: int) -> DataFrame:
    """Rows of ``thin`` (run, mark, ...) whose mark occurs more than once, by the exchange."""

    def send(key: tuple, rows: pa.Table) -> pa.Table:
        marks = np.unique(_marks(rows))
        cuts = np.searchsorted(_owner(marks, owners), np.arange(owners + 1, dtype=np.uint64))
        out = []
        for owner in np.flatnonzero(np.diff(cuts)).tolist():
            piece = marks[cuts[owner] : cuts[owner + 1]]
            k, unary, rest = golomb.encode(piece, *_range(owner, owners))
            out.append({"run": key[0].as_py(), "owner": owner, "n": len(piece), "k": k, "unary": unary, "rest": rest})
        return pa.Table.from_pylist(out, schema=_PIECES)

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        start, pieces = _range(key[0].as_py(), owners)[0], table.to_pylist()
        marks = [golomb.decode(p["n"], start, p["k"], p["unary"], p["rest"]) for p in pieces]
        values, counts = np.unique(np.concatenate(marks), return_counts=True)
        repeated = values[counts > 1]
        bits = [np.packbits(np.isin(m, repeated)).tobytes() for m in marks]
        return pa.Table.from_pylist([{"run": p["run"], "owner": p["owner"], "n": p["n"], "bits": b} for p, b in zip(pieces, bits)], schema=_ANSWERS)

    def receive(rows: pa.Table, answers: pa.Table) -> pa.Table:
        _, back, counts = np.unique(_marks(rows), return_inverse=True, return_counts=True)
        bits = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]) for a in sorted(answers.to_pylist(), key=lambda a: a["owner"])]
        elsewhere = np.concatenate([*bits, np.zeros(0, np.uint8)]).astype(bool)
        return rows.select(["doc_id", "sha"]).filter(pa.array((elsewhere | (counts > 1))[back]))

    marks = thin.select("run", "mark")
    pieces = marks.groupBy("run").applyInArrow(send, "run long, owner int, n int, k int, unary binary, rest binary")
    answers = pieces.groupBy("owner").applyInArrow(answer, "run long, owner int, n int, bits binary")
    kind = thin.schema["doc_id"].dataType.simpleString()
    return thin.select("run", "doc_id", "sha", "mark").groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(receive, f"doc_id {kind}, sha binary")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_rows: int = OWNER_ROWS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after deleting ASCII white space; null counts as empty,
    and all empty texts are one group.  The row with the most code points stays, then the one with
    the smallest id (a null id counts as largest).  Rows that share an id and a text are one
    document: they all count in group_size and are kept or dropped together.  Other columns of the
    input play no part, whatever their names.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    thin = written(
        plain.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
            _fingerprints, f"doc_id {kind}, row long, n_chars long, sha binary, mark long"
        ).withColumn("run", F.shiftright("row", RUN_BITS))
    )
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-thin.count() // owner_rows))
    suspects = written(duplicated(thin, owners))
    texts = (
        plain.join(suspects.select(F.col("doc_id").alias("suspect")), F.col("doc_id").eqNullSafe(F.col("suspect")), "left_semi")
        .withColumn("normal", normalised(F.col("text")))
        .select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "normal")
    )
    first = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"))
    groups = (
        texts.groupBy("normal")
        .agg(F.count("*").alias("group_size"), F.min(first).alias("first"))
        .filter("group_size > 1")
        .select(F.unhex(F.sha2("normal", 256)).alias("sha"), "group_size", F.col("first.doc_id").alias("keep_id"))
    )
    found = thin.select("doc_id", "sha").join(written(groups), "sha", "left")
    grouped = F.col("group_size").isNotNull()
    return found.select(
        "doc_id",
        F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (~grouped | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
