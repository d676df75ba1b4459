"""Log probabilities of texts under a language model learned from the other part of the corpus.

A token is a word or a text's end.  The model mixes two shares of a token: its add-one
share of all training tokens, and the product of the shares of its subword ids, each the class's share by
a causal self-attention model (``attention``) times the id's share of its class by counts.

1. A run of documents becomes one row: its distinct words, with how often training documents have them and
   their subword ids, the order of the words, and windows of ids to learn from.
2. Runs send owners (ranges of word hashes) their words' counts; owners add them up and answer.
3. Training goes in rounds: tasks learn from their windows, each from the same parameters, and the
   parameters are averaged by windows.  Every id of every training document is learned once.
4. Runs meet their words' totals and are scored in overlapping windows; the mixing weight is the one that suits all
   training documents best, a token's own occurrence left out of its count.

Counts cover all training tokens.  What goes through the driver is bounded by the tokenizer's vocabulary.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelflow.llm import attention
from panelflow.llm.exact_dedup import _owner
from panelflow.llm.texts import blocks, run_hashes, word_hashes
from panelflow.operators.sized import written

RUN_BYTES = 6 << 20
OWNER_WORDS = 2 << 20  # words that one owner counts, about
WORDS_KEPT = 96 << 20  # bytes of words and ids that a worker remembers
CLASSES = 128
LEARN_ONE_IN = 1  # all of them
ROUNDS = 3
MIXTURES = (0.05, 0.15, 0.3, 0.5)
BEGIN, END = 1, 2  # ids of the tokenizer
END_HASH = int(run_hashes(np.frombuffer(b"\n", np.uint8), np.array([0]), np.array([1]))[0])  # no word has a line break
PAD = 65535


def pack(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(raw: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.Codec("zstd", 1).decompress(raw[8:], size, asbytes=True) if size else b"", kind)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    out = np.arange(int(ends[-1]) if len(ends) else 0)
    out += np.repeat(starts - (ends - sizes), sizes)
    return out


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, a place of each, and the number of each place's value; no stable sort, which takes longer."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(values)]
    back = np.empty(len(values), np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[new], order[new], back


class Pieces:
    """Subword ids of words; a worker encodes a word it remembers only once."""

    def __init__(self, path: str):
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_file=path)
        if self.encoder.vocab_size() >= PAD:
            raise ValueError(f"{path}: more than {PAD - 1} ids")
        self.known: dict[int, bytes] = {}
        self.size = 0

    def __call__(self, hashes: np.ndarray, lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one word after the other, and how many each has."""
        names = hashes.tolist()
        found = list(map(self.known.get, names))
        new = [k for k, ids in enumerate(found) if ids is None]
        if new:
            first, sizes = starts[new], (ends - starts)[new] + 1
            raw = np.append(lower, np.uint8(10))[ragged(first, sizes)]
            raw[np.cumsum(sizes) - 1] = 10  # no word has a line break
            words = raw[:-1].tobytes().decode().split("\n")
            coded = [ids or [0] for ids in self.encoder.encode(words, num_threads=1)]
            places = (2 * np.cumsum([0, *map(len, coded)])).tolist()
            packed = np.fromiter(chain.from_iterable(coded), np.uint16, places[-1] >> 1).tobytes()
            if self.size > WORDS_KEPT:
                self.known, self.size = {}, 0
            for k, a, b in zip(new, places, places[1:]):
                found[k] = self.known[names[k]] = packed[a:b]
            self.size += 150 * len(new) + places[-1]
        return np.frombuffer(b"".join(found), np.uint16), np.fromiter(map(len, found), np.int64, len(found)) >> 1


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@dataclass
class Run:
    """Ids of a run's texts, one text after the other, ``BEGIN`` before each."""

    flat: np.ndarray
    begins: np.ndarray
    lengths: np.ndarray
    per_word: np.ndarray

    def windows(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in ``flat``, number of positions, and first scored position of the windows of some texts."""
        text, first, scored = attention.starts_of(self.lengths[texts])
        return self.begins[texts][text] + first, np.minimum(self.lengths[texts][text] - first, attention.WINDOW), scored - first

    def lessons(self, texts: np.ndarray) -> np.ndarray:
        """Windows one after the other that have each id of some texts once."""
        counts = -(-self.lengths[texts] // attention.WINDOW)
        at = ragged(np.zeros(len(texts), np.int64), counts) * attention.WINDOW
        return self.cut(np.repeat(self.begins[texts], counts) + at, np.minimum(np.repeat(self.lengths[texts], counts) - at, attention.WINDOW))

    def cut(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of windows, the one before their first position included; ``PAD`` after a text's end."""
        k = np.arange(attention.WINDOW + 1)
        return np.where(k <= sizes[:, None], self.flat[at[:, None] + k], np.uint16(PAD))


def lay_out(stream: np.ndarray, token_ends: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> Run:
    """From the order of words, each text's end in it, and the ids of the distinct words."""
    per_word = sizes[stream]
    run = ids[ragged((np.cumsum(sizes) - sizes)[stream], per_word)]
    ends = np.concatenate([[0], np.cumsum(per_word)])[token_ends]
    lengths = np.diff(ends, prepend=0)
    flat = np.concatenate([np.insert(run, ends - lengths, np.uint16(BEGIN)), np.full(attention.WINDOW, PAD, np.uint16)])
    return Run(flat, np.cumsum(lengths + 1) - (lengths + 1), lengths, per_word)


def _tokenise(path: str, learn_one_in: int, schema: pa.Schema) -> Callable:
    """Runs of documents as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, end, data, bounds in blocks(batch.column("text"), RUN_BYTES):
                words, rows, starts, ends, lower = word_hashes(data, bounds, places=True)
                held = batch.column("held_out").slice(first, end - first).to_numpy(zero_copy_only=False).astype(bool)
                token_ends = rows[1:] + np.arange(1, end - first + 1)
                hashes, one, stream = distinct(np.insert(words, rows[1:], np.uint64(END_HASH)))
                at_end = int(np.searchsorted(hashes, np.uint64(END_HASH)))
                own = np.delete(one, at_end)  # a place of each word, ends counted
                own -= np.searchsorted(token_ends, own, "right")  # and not counted
                ids, sizes = pieces(path)(np.delete(hashes, at_end), lower, starts[own], ends[own])
                before = int(sizes[:at_end].sum())
                ids, sizes = np.concatenate([ids[:before], np.array([END], np.uint16), ids[before:]]), np.insert(sizes, at_end, 1)
                trains = np.repeat(~held, np.diff(token_ends, prepend=0))
                laid = lay_out(stream, token_ends, sizes, ids)
                row = {
                    "run": number, "words": len(hashes), "doc_ids": batch.column("doc_id").slice(first, end - first).to_pylist(), "held_out": pack(held),
                    "ends": pack(token_ends), "stream": pack(stream.astype(np.uint32)), "hashes": pack(hashes),
                    "trained": pack(np.bincount(stream[trains], minlength=len(hashes)).astype(np.uint32)), "sizes": pack(sizes.astype(np.uint32)), "ids": pack(ids),
                    "lessons": pack(laid.lessons(np.flatnonzero(~held))[number % learn_one_in :: learn_one_in]),
                }
                yield pa.RecordBatch.from_pylist([row], schema=schema)
                number += 1

    return run


_ASKED = pa.schema([("owner", pa.int32()), ("run", pa.int64()), ("hashes", pa.binary()), ("trained", pa.binary())])
_ANSWERS = pa.schema([("run", pa.int64()), ("owner", pa.int32()), ("counts", pa.binary()), ("known", pa.int64())])


def _ask(owners: int) -> Callable:
    """One row per run and owner: distinct words, sorted by hash, and how often training documents of the run have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, trained = unpack(row["hashes"], "u8"), unpack(row["trained"], "u4")
                cuts = np.searchsorted(_owner(hashes, owners), np.arange(owners + 1, dtype=np.uint64))
                pieces = [(o, slice(cuts[o], cuts[o + 1])) for o in np.flatnonzero(np.diff(cuts)).tolist()]
                yield pa.RecordBatch.from_pylist([{"owner": o, "run": row["run"], "hashes": hashes[k].tobytes(), "trained": pack(trained[k])} for o, k in pieces], schema=_ASKED)

    return run


def _add_up(key: tuple, table: pa.Table) -> pa.Table:
    """An owner's answers: the totals in each run's order; the first says how many words are known."""
    rows = table.to_pylist()
    asked = [np.frombuffer(r["hashes"], "u8") for r in rows]
    words, back = np.unique(np.concatenate(asked), return_inverse=True)
    totals = np.bincount(back, weights=np.concatenate([unpack(r["trained"], "u4") for r in rows]), minlength=len(words)).astype(np.uint64)
    begin, out = 0, []
    for k, (row, hashes) in enumerate(zip(rows, asked)):
        out.append({"run": row["run"], "owner": row["owner"], "counts": pack(totals[back[begin : begin + len(hashes)]]), "known": 0 if k else int((totals > 0).sum())})
        begin += len(hashes)
    return pa.Table.from_pylist(out, schema=_ANSWERS)


def _count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training occurrences of each id; id -1 stands for all tokens."""
    ids, tokens = np.zeros(PAD, np.int64), 0
    for batch in batches:
        for row in batch.to_pylist():
            trained = unpack(row["trained"], "u4")
            tokens += int(trained.sum())
            ids += np.bincount(unpack(row["ids"], "u2"), weights=np.repeat(trained, unpack(row["sizes"], "u4")), minlength=PAD).astype(np.int64)
    seen = np.flatnonzero(ids)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(ids[seen], tokens))], names=["id", "n"])


@dataclass
class Model:
    """What tasks need to learn and to score; its size depends on the tokenizer and the constants alone."""

    params: attention.Params
    row_of: np.ndarray  # row of the embedding of each id; 0 for ids no training document has, and for PAD
    class_of: np.ndarray
    within: np.ndarray  # log10 of an id's share of its class

    @staticmethod
    def of(counts: dict[int, int], vocabulary: int, classes: int) -> Model:
        """Classes of about the same mass by falling count; frequent ids are alone in theirs."""
        mass = np.ones(PAD + 1)
        mass[vocabulary:] = 0
        for name, n in counts.items():
            mass[name] += n
        order = np.argsort(-mass[:vocabulary], kind="stable")
        class_of, left, number, filled = np.zeros(PAD + 1, np.int64), mass.sum(), 0, 0.0
        for name in order.tolist():
            if filled and number < classes - 1 and filled + mass[name] / 2 >= left / (classes - number):
                left, number, filled = left - filled, number + 1, 0.0
            class_of[name] = number
            filled += mass[name]
        total = np.bincount(class_of, weights=mass, minlength=classes)
        within = np.zeros(PAD + 1)
        within[:vocabulary] = np.log10(mass[:vocabulary] / total[class_of[:vocabulary]])
        row_of = np.zeros(PAD + 1, np.int64)
        known = sorted({*counts, BEGIN})
        row_of[known] = np.arange(1, len(known) + 1)
        params = attention.fresh(len(known) + 1, classes)
        params["out"][-1] = np.log(np.maximum(total, 1e-9) / total.sum())
        return Model(params, row_of, class_of, within)


_BLOCK = 4096
_PARTS = pa.schema([("name", pa.string()), ("block", pa.int32()), ("lane", pa.int64()), ("values", pa.binary()), ("windows", pa.int64())])
_PARTS_SQL = "name string, block int, lane long, values binary, windows long"


def _learn(shared: Broadcast, number: int, rounds: int) -> Callable:
    """One task's parameters after its lessons of this round, weighted by their number, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        learner = attention.Learner(model.params)
        for batch in batches:
            for row in batch.to_pylist():
                lessons = unpack(row["lessons"], "u2").reshape(-1, attention.WINDOW + 1)[number::rounds]
                lessons = lessons[np.random.default_rng(row["run"]).permutation(len(lessons))]
                learner.learn(model.row_of[lessons[:, :-1]], model.class_of[lessons[:, 1:]], lessons[:, 1:] != PAD)
        if learner.windows:
            lane = TaskContext.get().partitionId() // 64
            rows = []
            for name, values in learner.params.items():
                flat = values.ravel().astype(np.float64) * learner.windows
                rows += [{"name": name, "block": k, "lane": lane, "values": flat[k * _BLOCK : (k + 1) * _BLOCK].tobytes(), "windows": learner.windows} for k in range(-(-len(flat) // _BLOCK))]
            yield pa.RecordBatch.from_pylist(rows, schema=_PARTS)

    return run


def _sum_parts(key: tuple, table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    total = sum(np.frombuffer(r["values"], np.float64) for r in rows)
    return pa.Table.from_pylist([{"name": rows[0]["name"], "block": rows[0]["block"], "lane": -1, "values": total.tobytes(), "windows": sum(r["windows"] for r in rows)}], schema=_PARTS)


def _averaged(model: Model, parts: DataFrame) -> None:
    """The mean of all tasks' parameters by windows; sums go over at most 64 tasks, then over their groups."""
    sums = parts.groupBy("name", "block", "lane").applyInArrow(_sum_parts, _PARTS_SQL).groupBy("name", "block").applyInArrow(_sum_parts, _PARTS_SQL)
    found: dict[str, dict[int, np.ndarray]] = {}
    for row in sums.collect():  # as many numbers as the model has
        found.setdefault(row.name, {})[row.block] = np.frombuffer(row["values"], np.float64) / row.windows
    for name, parts_of in found.items():
        model.params[name] = np.concatenate([parts_of[k] for k in sorted(parts_of)]).astype(np.float32).reshape(model.params[name].shape)


def log10_attention(model: Model, run: Run) -> np.ndarray:
    """log10 of the share of every id of a run's texts, in order."""
    at, size, scored = run.windows(np.arange(len(run.lengths)))
    ends = np.cumsum(size - scored)
    out, room = np.empty(int(ends[-1])), attention.Room()
    k = np.arange(attention.WINDOW)
    # all windows but a text's first have their first positions as context alone
    for skip, these in ((0, np.flatnonzero(scored == 0)), (attention.OVERLAP, np.flatnonzero(scored))):
        for batch in attention.batches(len(these)):
            part = these[batch]
            ids = run.cut(at[part], size[part])
            mask = (k >= scored[part, None]) & (k < size[part, None])
            wanted = ids[:, 1:]
            shares = attention.log_shares(model.params, model.row_of[ids[:, :-1]], model.class_of[wanted], mask, room, skip)
            sizes = size[part] - scored[part]
            out[ragged(ends[part] - sizes, sizes)] = shares + model.within[wanted[mask]]
    return out


def _score(shared: Broadcast, tokens: int, known: int, mixtures: Sequence[float], schema: pa.Schema) -> Callable:
    size = math.log10(tokens + known + 1)

    def run(left: pa.Table, answers: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        row, model = left.to_pylist()[0], shared.value
        counts = np.concatenate([unpack(r["counts"], "u8") for r in sorted(answers.to_pylist(), key=lambda r: r["owner"])]).astype(np.float64)
        stream, ends, held = unpack(row["stream"], "u4"), unpack(row["ends"], "i8"), unpack(row["held_out"], "?")
        laid = lay_out(stream, ends, unpack(row["sizes"], "u4").astype(np.int64), unpack(row["ids"], "u2"))
        word = np.add.reduceat(log10_attention(model, laid), np.cumsum(laid.per_word) - laid.per_word)
        begins = np.concatenate([[0], ends[:-1]])
        per_text = lambda x: np.add.reduceat(x, begins)
        base = (np.log10(counts + 1) - size)[stream]
        attended, plain = 10.0**word, 10.0**base
        without = (np.maximum(counts, 1) / max(1, tokens + known))[stream]  # a training token without itself
        mixed = np.stack([per_text(np.log10((1 - g) * plain + g * attended)) for g in mixtures], 1)
        fit = np.stack([np.where(held, 0, per_text(np.log10((1 - g) * without + g * attended))) for g in mixtures], 1)
        lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
        return pa.Table.from_arrays(
            [
                pa.array(row["doc_ids"], schema.field("doc_id").type), pa.array(held), pa.array(ends - begins), pa.array(per_text((counts > 0)[stream].astype(np.int64))),
                pa.array(np.full(len(ends), tokens)), pa.array(per_text(base)), lists(mixed), lists(fit),
            ],
            schema=schema,
        )

    return run


def score_texts(
    docs: DataFrame, tokenizer_file: str, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
    classes: int = CLASSES, learn_one_in: int = LEARN_ONE_IN, rounds: int = ROUNDS, mixtures: Sequence[float] = MIXTURES,
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A-Z are lower-cased; tokens are the words between ASCII white space, and one end per text, so a null or empty
    text is its end alone.  ``base_score`` adds up log10 of the add-one shares of the tokens among those of the rows that
    ``held_out`` is not true for (a null counts as not held out); ``n_known`` tokens are among these.
    ``score`` is log10 of the text's probability under the model, which learns from the same rows.  Repeated and null
    ids are rows like any other; other columns of the input play no part; equal texts have equal scores but for the
    last digits.  Whole texts are read, of any length; a text is held by one task.  Without training rows
    every token has the base share 1.  ``tokenizer_file`` is a sentencepiece file that every executor can open.

    The model learns from every id of every training row; ``learn_one_in`` above 1 leaves windows out, for quick trials.
    Words are known by 64-bit hashes.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    kind, id_type = plain.schema["doc_id"].dataType.simpleString(), to_arrow_type(plain.schema["doc_id"].dataType)
    packed = ("held_out", "ends", "stream", "hashes", "trained", "sizes", "ids", "lessons")
    schema = pa.schema([("run", pa.int64()), ("words", pa.int64()), ("doc_ids", pa.list_(id_type)), *[(c, pa.binary()) for c in packed]])
    runs = written(plain.mapInArrow(_tokenise(tokenizer_file, learn_one_in, schema), f"run long, words long, doc_ids array<{kind}>, {', '.join(f'{c} binary' for c in packed)}"))

    words = runs.agg(F.sum("words")).first()[0] or 0
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // OWNER_WORDS))
    asked = runs.select("run", "hashes", "trained").mapInArrow(_ask(owners), "owner int, run long, hashes binary, trained binary")
    answers = written(asked.groupBy("owner").applyInArrow(_add_up, "run long, owner int, counts binary, known long"))
    known = answers.agg(F.sum("known")).first()[0] or 0

    counts = runs.select("trained", "sizes", "ids").mapInArrow(_count_ids, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    by_id = {r.id: r.n for r in counts.collect()}  # at most the vocabulary of the tokenizer
    tokens = by_id.pop(-1, 0)
    model = Model.of(by_id, pieces(tokenizer_file).encoder.vocab_size(), classes)
    for number in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        _averaged(model, runs.select("run", "lessons").mapInArrow(_learn(shared, number, rounds), _PARTS_SQL))
        shared.destroy()

    shared = spark.sparkContext.broadcast(model)
    out = pa.schema([
        ("doc_id", id_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()),
        ("mixed", pa.list_(pa.float64())), ("fit", pa.list_(pa.float64())),
    ])
    scored = written(
        runs.select("run", "doc_ids", "held_out", "ends", "stream", "sizes", "ids").groupBy("run").cogroup(answers.select("run", "owner", "counts").groupBy("run")).applyInArrow(
            _score(shared, tokens, known, tuple(mixtures), out),
            f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, mixed array<double>, fit array<double>",
        )
    )
    shared.destroy()
    totals = scored.agg(F.array(*[F.sum(F.col("fit")[k]) for k in range(len(mixtures))]).alias("fit")).first()[0]
    best = max(range(len(mixtures)), key=lambda k: totals[k] or 0.0)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.col("mixed")[best].alias("score"))
