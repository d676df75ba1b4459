"""I-Match fingerprints: hashes of randomised subsets of a document's terms of middling rarity."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelflow.llm.texts import blocks, mix, squeezed, stretched, word_hashes
from panelflow.operators.sized import written

RUN_TERMS = 2_000_000  # terms of blocks counted together
BAND = (0.12, 0.85)  # of ln(N / df) / ln(N): 0 is a term of all documents, 1 a term of one
DRAWS = 16  # lexicon subsets of each rate
RATES = tuple(2.0 ** -(1 + 2 * k) for k in range(6))
_SALTS = mix(np.arange(101, 101 + DRAWS, dtype=np.uint64))
_LIMITS = np.array([int(r * 2.0**64) for r in RATES], np.uint64)


def _terms(words: np.ndarray) -> np.ndarray:
    return np.unique(words)


def band_of_lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> tuple[np.ndarray, int]:
    """The terms within the band, sorted, and the number of documents.

    Every distinct 64-bit term is counted over all documents, first within runs of blocks.  Only
    terms of the band come to the driver: at the rare end each occurs in documents ** (1 - band[1]) of them at least.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0

        def flush() -> pa.RecordBatch:
            terms, at = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
            df = np.bincount(at, np.concatenate([c for _, c in found]), minlength=len(terms))
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(df.astype(np.int64))], names=["term", "df"])

        for batch in batches:
            for _, _, data, bounds in blocks(batch.column("text")):
                words, rows = word_hashes(data, bounds)
                own = [np.zeros(0, np.uint64), *[_terms(words[a:b]) for a, b in zip(rows[:-1], rows[1:])]]
                found.append(np.unique(np.concatenate(own), return_counts=True))
                held += len(found[-1][0])
                if held > RUN_TERMS:
                    yield flush()
                    found, held = [], 0
        if held:
            yield flush()

    documents = docs.count()
    least, most = documents ** (1 - band[1]), documents ** (1 - band[0])
    counted = docs.select("text").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    inside = counted.filter((F.col("df") >= least) & (F.col("df") <= most)).select("term").toArrow()
    return np.sort(inside.column("term").to_numpy().view(np.uint64)), documents


def _within(terms: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Which of the sorted ``terms`` are among the sorted ``inside``."""
    at = np.searchsorted(inside, terms)
    at[at == len(inside)] = 0
    return inside[at] == terms if len(inside) else np.zeros(len(terms), bool)


def fingerprint(words: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """DRAWS x RATES numbers of 16 bits; 0 where no term falls into a subset.

    The distinct terms within the band are taken, or all terms if none is; a term belongs to a
    subset if its salted hash is below the rate, and a subset's number is a hash of the sorted members.
    """
    terms = _terms(words)
    kept = terms[_within(terms, inside)]
    kept = kept if len(kept) else terms
    if not len(kept):
        return np.zeros((DRAWS, len(RATES)), np.uint16)
    draws = np.sort(mix(kept[None, :] ^ _SALTS[:, None]), axis=1)
    sums = np.zeros((DRAWS, len(kept) + 1), np.uint64)
    np.cumsum(mix(draws + np.uint64(1)), axis=1, out=sums[:, 1:])
    members = np.stack([np.searchsorted(d, _LIMITS) for d in draws])
    value = mix(np.take_along_axis(sums, members, axis=1) + members.astype(np.uint64))
    return np.where(members > 0, value % np.uint64(65535) + np.uint64(1), 0).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The largest share of equal subsets among the rates at which at least half the subsets have terms.

    Without such a rate it is the share over all subsets that have terms; two fingerprints without any are alike.
    """
    some = (a > 0) | (b > 0)
    if not some.any():
        return 1.0
    same = (a == b) & some
    present = some.sum(axis=0)
    use = present * 2 >= DRAWS
    if use.any():
        return float((same.sum(axis=0)[use] / present[use]).max())
    return float(same.sum() / present.sum())


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many first characters of the following text, or all it has."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter] if quarter else text


def fingerprint_documents(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next larger id; after the last comes the first, and a
    single document follows itself.  Repeated ids are ordered by a hash of their text and then its
    packed bytes, null ids come first; null texts count as empty.  Documents are dealt by ranges of id, so a task needs of
    the others only the first document of the next range, and those are looked up by range.
    """
    inside, _ = band_of_lexicon(docs, band)
    packed = docs.sparkSession.sparkContext.broadcast(inside)  # 8 bytes a term of the band
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    plain = plain.mapInArrow(_squeeze, f"doc_id {kind}, tie long, text binary")  # half of what the shuffle's own codec leaves
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = plain.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    shape = (
        f"part int, role string, doc_id {kind}, text string, n_chars long, edited_sha256 binary, "
        "fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    )

    def closed(inside: np.ndarray, doc, text: str, own: np.ndarray, following: str, next_print: np.ndarray) -> dict:
        changed = edited(text, following)
        other = own if changed == text else _prints(inside, [changed])[0]
        return {
            "doc_id": doc, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed.encode()).digest(),
            "fingerprint": own.tobytes(), "edited_fingerprint": other.tobytes(),
            "near_edited": likeness(own, other), "near_next": likeness(own, next_print),
        }

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        lexicon = packed.value
        last, out = None, []
        for batch in batches:
            ids, column = batch.column("doc_id").to_pylist(), stretched(batch.column("text"))
            for first, end, data, bounds in blocks(column):
                words, rows = word_hashes(data, bounds)
                texts = column.slice(first, end - first).to_pylist()
                for k, text in enumerate(texts):
                    own = fingerprint(words[rows[k] : rows[k + 1]], lexicon)
                    if last is None:
                        out.append({"role": "first", "text": text, "fingerprint": own.tobytes()})
                    else:
                        out.append(closed(lexicon, *last, text, own) | {"role": "done"})
                    last = (ids[first + k], text, own)
                yield _rows(out, part, shape_of)
                out = []
        if last is not None:
            yield _rows([{"role": "last", "doc_id": last[0], "text": last[1], "fingerprint": last[2].tobytes()}], part, shape_of)

    def link(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = packed.value
        for batch in pairs:
            out = []
            for r in batch.to_pylist():
                own, following = (np.frombuffer(r[c], np.uint16).reshape(DRAWS, -1) for c in ("fingerprint", "next_fingerprint"))
                out.append(closed(lexicon, r["doc_id"], r["text"], own, r["next_text"], following) | {"role": "done"})
            yield _rows(out, 0, shape_of)

    from pyspark.sql.pandas.types import to_arrow_schema

    shape_of = to_arrow_schema(docs.sparkSession.createDataFrame([], shape).schema)
    rows = written(ordered.mapInArrow(walk, shape))
    parts = sorted(r["part"] for r in rows.filter("role = 'last'").select("part").collect())  # one number per range
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    ends = rows.filter("role = 'last'").select("part", "doc_id", "text", "fingerprint").join(after, "part")
    heads = rows.filter("role = 'first'").select(
        F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint")
    )
    linked = ends.join(heads, "next_part").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(link, shape)
    return rows.filter("role = 'done'").unionByName(linked).select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), squeezed(batch.column("text"))], names=["doc_id", "tie", "text"])


def _prints(inside: np.ndarray, texts: list[str]) -> list[np.ndarray]:
    out = []
    for _, _, data, bounds in blocks(pa.array(texts, pa.string())):
        words, rows = word_hashes(data, bounds)
        out += [fingerprint(words[a:b], inside) for a, b in zip(rows[:-1], rows[1:])]
    return out


def _rows(rows: list[dict], part: int, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"part": part} | r for r in rows], schema=schema)
