"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and the first five bytes of longer words.  All terms of a text count, with inverse
document frequencies over all documents; terms that labelled toxic rows use significantly more
than clean ones (likelihood ratio) weigh ``LIFT`` times as much.  The index holds the whole vectors
of a bounded sample of labelled rows: at most ``PER_CLASS`` of each class, by a hash of their id.
Its vocabulary is that of the sample; the other terms of a text can meet no example, but count in
the text's length, with their own document frequencies, which are joined to them afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelflow.llm.texts import blocks, mix, word_hashes
from panelflow.operators.sized import written

PER_CLASS = 5_000
LIFT = 4.0
NEIGHBOURS = 15
BLOCK_ROWS = 128
DENSE = 2_048  # terms of the most examples, kept as columns of matrices; all others as lists of examples
BATCH = 256  # texts searched together
POSTINGS = 500_000  # entries of lists read together
THRESHOLD = 0.7
PREFIX = 5
G_LEAST = 10.83  # likelihood ratio of one degree of freedom at p = 0.001
_SALT = np.uint64(0x2545F4914F6CDD1D)


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0)) != 1


def term_counts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Distinct terms, their counts and the number of words, text by text."""
    for _, _, data, bounds in blocks(column):
        words, rows, heads = word_hashes(data, bounds, letters=True, prefix=PREFIX)
        heads = mix(heads ^ _SALT)
        for a, b in zip(rows[:-1], rows[1:]):
            terms, counts = np.unique(np.concatenate([words[a:b], heads[a:b]]), return_counts=True)
            yield terms, counts, int(b - a)


def _places(terms: np.ndarray, lexicon: np.ndarray, first: np.ndarray, bits: int) -> np.ndarray:
    """Places of terms in the sorted lexicon, or -1; ``first`` has the first place by the terms' upper bits."""
    out = np.full(len(terms), -1, np.int64)
    bucket = (terms >> np.uint64(64 - bits)).astype(np.int64)
    place, end = first[bucket], first[bucket + 1]
    left = np.flatnonzero(place < end)
    while len(left):
        at = place[left]
        hit = lexicon[at] == terms[left]
        out[left[hit]] = at[hit]
        place[left] += 1
        left = left[~hit & (at + 1 < end[left])]
    return out


def _counted(of: np.ndarray, values: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's bounds among the distinct values of all, these values, and how often they occur."""
    by = np.lexsort((values, of))
    of, values = of[by], values[by]
    heads = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (values[1:] != values[:-1])])) if len(of) else np.zeros(0, np.int64)
    return np.searchsorted(of[heads], np.arange(texts + 1)), values[heads], np.diff(np.append(heads, len(of)))


def _split(column: pa.Array, lexicon: np.ndarray) -> Iterator[tuple[np.ndarray, tuple, tuple]]:
    """By block of texts: their numbers of words, their terms as places in the sorted ``lexicon``, and their other terms."""
    bits = min(20, max(1, len(lexicon).bit_length()))
    first = np.searchsorted(lexicon, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    first = np.append(first, len(lexicon))
    for _, _, data, bounds in blocks(column):
        words, rows, heads = word_hashes(data, bounds, letters=True, prefix=PREFIX)
        terms = np.concatenate([words, mix(heads ^ _SALT)])
        of = np.tile(np.repeat(np.arange(len(rows) - 1), np.diff(rows)), 2)
        place = _places(terms, lexicon, first, bits)
        hit = place >= 0
        pairs = np.sort(of[hit] << 32 | place[hit])
        heads = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
        cuts = np.searchsorted(pairs[heads], np.arange(len(rows)) << 32)
        known = cuts, pairs[heads] & 0xFFFFFFFF, np.diff(np.append(heads, len(pairs)))
        yield np.diff(rows), known, _counted(of[~hit], terms[~hit], len(rows) - 1)


def known_terms(column: pa.Array, lexicon: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Places in the sorted ``lexicon`` of a text's terms, their counts and the number of words."""
    for words, (cuts, places, counts), _ in _split(column, lexicon):
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            yield places[a:b], counts[a:b], int(words[k])


@dataclass
class Examples:
    """Labelled examples as unit vectors in blocks of alike rows."""

    ids: np.ndarray
    toxic: np.ndarray
    idf: np.ndarray  # by term, lifted
    bounds: np.ndarray  # of each row among the terms and weights of all rows
    terms: np.ndarray
    weights: np.ndarray
    slope: tuple[float, float] = (0.0, 0.0)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "lists"} | {"terms": self.row_terms(slice(None))}

    def row_terms(self, part: slice) -> np.ndarray | None:
        """The terms of the rows' entries; a prepared index holds their ranks in place of them."""
        if self.terms is None and hasattr(self, "lists"):
            return self.lists.order[self.lists.ranked[part]]
        return None if self.terms is None else self.terms[part]

    def vector(self, terms: np.ndarray, counts: np.ndarray, rest: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """A text's terms and weights at a length of 1; ``rest`` is what terms outside the index add to its square."""
        weights = (1 + np.log(np.maximum(counts, 1))) * self.idf[terms]
        norm = np.sqrt((weights**2).sum() + rest)
        return terms, weights / norm if norm else weights

    def prepared(self) -> SimpleNamespace:
        """The index made from the rows, once a process: matrices of frequent terms with each block's largest weights, lists of all others."""
        if not hasattr(self, "lists"):
            n, terms = len(self.ids), len(self.idf)
            counts = np.bincount(self.terms, minlength=terms)
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(terms, np.int32)
            rank[order] = np.arange(terms, dtype=np.int32)  # frequent terms lie together in ``room``
            often = np.sort(order[:DENSE])
            column = np.full(terms, -1, np.int64)
            column[often] = np.arange(len(often))
            row = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.bounds))
            at = column[self.terms]
            matrix = np.zeros((n, len(often)), np.float32)
            matrix[row[at >= 0], at[at >= 0]] = self.weights[at >= 0]
            rare = np.flatnonzero(at < 0)
            rare = rare[np.argsort(self.terms[rare], kind="stable")]
            counts[often] = 0
            heads = np.arange(0, n, BLOCK_ROWS)
            self.lists = SimpleNamespace(
                column=column, matrix=matrix, heads=heads, most=np.maximum.reduceat(matrix, heads, axis=0).T.copy(), rows=row[rare].astype(np.int64), weights=self.weights[rare].astype(np.float32),
                first=np.cumsum(counts) - counts, counts=counts, by_id=np.argsort(self.ids, kind="stable"), room=np.zeros(terms), rank=rank, order=order.astype(np.int32), ranked=rank[self.terms],
            )
            self.terms = None
        return self.lists

    def nearest(self, at: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k rows of largest cosine, exactly; of equal ones those with the smaller ids."""
        return self.nearest_all([(at, weights)], k, [skip])[0]

    def nearest_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, skips: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of many texts."""
        out = []
        for s in range(0, len(queries), BATCH):
            out += self._nearest(queries[s : s + BATCH], k, skips[s : s + BATCH] if skips else [-1] * len(queries[s : s + BATCH]))
        return out

    def _nearest(self, queries: list, k: int, skips: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Cosines in single precision, rare terms first; then those that may be among the k largest in double.

        A block is left out when its largest rare part and its bound from the largest weights of the
        frequent terms stay below the k-th cosine of the text's most promising block.  ``share`` is 1 less twice the
        largest relative error of such sums of positive numbers.
        """
        x, n = self.prepared(), len(self.ids)
        cosine, dense = np.zeros((len(queries), n), np.float32), np.zeros((len(queries), x.matrix.shape[1]), np.float32)
        of = np.repeat(np.arange(len(queries)), [len(at) for at, _ in queries])
        terms, own = (np.concatenate([q[c] for q in queries]) for c in (0, 1))
        column = x.column[terms]
        often = column >= 0
        dense[of[often], column[often]] = own[often]
        share = 1 - 1.2e-7 * (np.bincount(of[often], minlength=len(queries)) + 8)
        of, rare, own = of[~often], terms[~often], own[~often]
        sizes = x.counts[rare]
        ends = np.cumsum(sizes)
        upto = np.concatenate([[0], ends])[np.searchsorted(of, np.arange(len(queries) + 1))]  # postings of the queries before each
        q = 0
        while q < len(queries):
            last = max(q + 1, int(np.searchsorted(upto, upto[q] + POSTINGS, "right")) - 1)
            some = slice(*np.searchsorted(of, [q, last]))
            if (count := int(upto[last] - upto[q])):
                lists = np.arange(count) + np.repeat(x.first[rare[some]] - (ends[some] - sizes[some] - upto[q]), sizes[some])
                rows = x.rows[lists] + np.repeat((of[some] - q) * n, sizes[some])
                parts = x.weights[lists] * np.repeat(own[some], sizes[some])
                cosine[q:last] = np.bincount(rows, parts, minlength=(last - q) * n).reshape(last - q, n)
            q = last
        for q, row in enumerate(skips):
            if row >= 0:
                cosine[q, row] = -4
        bound = (dense @ x.most + np.maximum.reduceat(cosine, x.heads, axis=1)) * 1.001
        best = bound.argmax(axis=1)
        todo = np.zeros(bound.shape, bool)
        todo[np.arange(len(queries)), best] = True
        done = np.zeros(bound.shape, bool)
        for last in (False, True):
            for b, head in enumerate(x.heads):
                who, rows = np.flatnonzero(todo[:, b]), slice(head, min(n, head + BLOCK_ROWS))
                if len(who):
                    cosine[who, rows] += dense[who] @ x.matrix[rows].T
            done |= todo
            if not last:
                floor = np.full(len(queries), -1.0)
                for q, head in enumerate(x.heads[best]):
                    own = cosine[q, head : head + BLOCK_ROWS]
                    if len(own) >= k:
                        floor[q] = np.partition(own, len(own) - k)[len(own) - k]
                todo = (bound >= (floor * share - 2e-9)[:, None]) & ~done
        cosine[~np.repeat(done, np.diff(np.append(x.heads, n)), axis=1)] = -2
        least = np.partition(cosine, n - k, axis=1)[:, n - k] * share - 2e-9 if n > k else np.full(len(queries), -1.0)
        return [self._exact(at, weights, k, cosine[q], least[q]) for q, (at, weights) in enumerate(queries)]

    def _exact(self, at: np.ndarray, weights: np.ndarray, k: int, cosine: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        x = self.prepared()
        some = np.flatnonzero((cosine >= least) & (cosine > 0))
        x.room[x.rank[at]] = weights
        got = np.array([np.dot(x.room.take(x.ranked[a:b]), self.weights[a:b]) for a, b in zip(self.bounds[some].tolist(), self.bounds[some + 1].tolist())], float)
        x.room[x.rank[at]] = 0
        none = x.by_id[cosine[x.by_id] == 0][:k] if least <= 0 else x.by_id[:0]
        rows, sims = np.concatenate([some, none]), np.round(np.concatenate([got, np.zeros(len(none))]), 9)
        order = np.lexsort((self.ids[rows], -sims))[:k]
        return rows[order], sims[order]

    def vote(self, rows: np.ndarray, sims: np.ndarray) -> float:
        """Share of toxic neighbours, weighted by the inverse of their distance."""
        closeness = 1 / (1.02 - np.minimum(sims, 1))
        return float((closeness * self.toxic[rows]).sum() / closeness.sum())

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope[0] * vote + self.slope[1]))))


def _calibrated(votes: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """A logistic curve of votes, by Newton's method on smoothed labels."""
    ones, zeros = (weights * toxic).sum(), (weights * (1 - toxic)).sum()
    goal = np.where(toxic > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.column_stack([votes, np.ones_like(votes)])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (weights * (goal - p)) - 1e-3 * w)
        w = w + np.clip(step, -5, 5)
        if abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _alike(matrix: np.ndarray, groups: int = 16, rounds: int = 4) -> np.ndarray:
    """An order of rows in which alike ones are near each other: by the nearest of a few means."""
    means = matrix[np.linspace(0, len(matrix) - 1, groups).astype(int)]
    for _ in range(rounds):
        near = matrix @ means.T
        own = near.argmax(axis=1)
        means = np.stack([matrix[own == g].sum(axis=0) for g in range(groups)])
        means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    return np.lexsort((-near[np.arange(len(matrix)), own], own))


def _votes(made: Examples, rows: np.ndarray, out: np.ndarray, k: int) -> np.ndarray:
    """The votes on examples themselves, with those marked in ``out`` left out."""
    queries = [(made.row_terms(slice(a, b)), made.weights[a:b]) for a, b in zip(made.bounds[rows], made.bounds[rows + 1])]
    return np.array([made.vote(*x) for x in made.nearest_all(queries, k, [int(r) if o else -1 for r, o in zip(rows, out)])])


def index(
    ids, toxic, vectors: list[tuple], df: np.ndarray, documents: int, k: int = NEIGHBOURS, share: tuple[float, float] = (1.0, 1.0),
    lift: np.ndarray | float = 1.0, votes: Callable = _votes,
) -> Examples:
    """Blocks of alike examples, and the curve from votes with each example left out once.

    Of examples with one vector the k + 1 smallest ids are indexed: no query's nearest can hold
    another.  ``share`` is what an example of class 0 and 1 stands for among all labelled rows,
    ``lift`` by how much each term weighs more than by its document frequency, ``votes`` what asks
    for the votes of all examples.
    """
    idf = (np.log((1 + documents) / (1 + df)) + 1) * lift
    ids, toxic = np.asarray(ids, np.int64), np.asarray(toxic, float)
    made = Examples(ids, toxic, idf, np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0))
    unit = [made.vector(*v)[1] for v in vectors]
    alike: dict[bytes, list[int]] = {}
    for i in np.argsort(ids, kind="stable"):
        alike.setdefault(hashlib.sha256(vectors[i][0].astype(np.int32).tobytes() + np.round(unit[i], 9).tobytes()).digest(), []).append(int(i))
    kept = np.array([i for same in alike.values() for i in same[: k + 1]], np.int64)
    often = np.zeros(len(idf), np.int64)
    for i in kept:
        often[vectors[i][0]] += 1
    column = np.full(len(idf), -1, np.int64)
    often = np.argsort(-often, kind="stable")[:DENSE]
    column[often] = np.arange(len(often))
    matrix = np.zeros((len(kept), len(often)), np.float32)
    for r, i in enumerate(kept):
        at = column[vectors[i][0]]
        matrix[r, at[at >= 0]] = unit[i][at >= 0]
    kept = kept[_alike(matrix)]
    del matrix
    made.ids, made.toxic, made.bounds = ids[kept], toxic[kept], np.cumsum([0, *[len(unit[i]) for i in kept]])
    made.terms, made.weights = np.concatenate([vectors[i][0].astype(np.int32) for i in kept]), np.concatenate([unit[i] for i in kept])
    if len(ids) > 1:
        place = {int(i): r for r, i in enumerate(kept)}
        spare = [same for same in alike.values() if len(same) > k + 1]
        rows = np.concatenate([np.arange(len(kept)), [place[same[0]] for same in spare]]).astype(np.int64)
        got = votes(made, rows, np.arange(len(rows)) < len(kept), k)
        got = np.concatenate([got[: len(kept)], np.repeat(got[len(kept) :], [len(same) - k - 1 for same in spare])])
        truth = np.concatenate([made.toxic, toxic[np.array([i for same in spare for i in same[k + 1 :]], np.int64)]])
        made.slope = _calibrated(got, truth, np.where(truth > 0, share[1], share[0]))
    return made


def _labelled(labels: DataFrame) -> DataFrame:
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & learnable(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )


def _sampled(labelled: DataFrame, per_class: int) -> DataFrame:
    """Up to ``per_class`` ids of each class, those of the smallest hashes."""
    of = lambda c: labelled.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return of(0).unionByName(of(1))


def _explode_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for toxic, (terms, _, _) in zip(batch.column("toxic").to_pylist(), term_counts(batch.column("text"))):
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms.view(np.int64)), pa.array(np.full(len(terms), toxic, np.int32))], names=["term", "toxic"]
            )


def vocabulary(sample: DataFrame, least_docs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all terms of the sample, and by how much each weighs more than by its document frequency.

    Lifted are terms in at least ``least_docs`` rows that toxic rows use over twice as often and
    whose likelihood ratio is significant.  Without rows of both classes there are no terms.
    """
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return np.zeros(0, np.uint64), np.zeros(0)
    counts = sample.mapInArrow(_explode_terms, "term long, toxic int").groupBy("term").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("c")
    )
    found = counts.toArrow()  # bounded as the sample is
    terms, a, c = (found.column(x).to_numpy() for x in ("term", "a", "c"))
    order = np.argsort(terms.view(np.uint64))
    terms, a, c = terms.view(np.uint64)[order], a[order].astype(float), c[order].astype(float)
    cell = lambda o, e: o * np.log(np.where(o > 0, o, 1) / np.where(o > 0, e, 1))
    p = (a + c) / (n1 + n0)
    g = 2 * (cell(a, n1 * p) + cell(c, n0 * p) + cell(n1 - a, n1 * (1 - p)) + cell(n0 - c, n0 * (1 - p)))
    return terms, np.where((a + c >= least_docs) & (a / n1 > 2 * c / n0) & (np.round(g, 6) >= G_LEAST), LIFT, 1.0)


def document_frequencies(docs: DataFrame, lexicon: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and the number of documents: all of them count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(lexicon) + 1, np.int64), 0
        for batch in batches:
            for words, (_, places, _), _ in _split(batch.column("text"), lexicon):
                df[:-1] += np.bincount(places, minlength=len(lexicon))
                n += len(words)
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "df"])

    rows = docs.select("text").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    total = np.zeros(len(lexicon) + 1, np.int64)
    total[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return total[:-1], int(total[-1])


def score_toxicity(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, k: int = NEIGHBOURS, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, neighbours, similarities.

    ``labels`` has doc_id and toxic; labels of held-out ids are never read, ids labelled twice
    count as toxic if either label says so, null labels are skipped.  Null and empty texts and
    texts without a word have no neighbours and get the score of no toxic vote; every other text
    is searched for, and examples without a common term have the similarity 0.  Without labels of both
    classes, or without a word in them, every score is 0.  Neighbours are the ids of the examples that
    voted, nearest first, ties by the smaller id.  Other columns of the tables play no part.
    """
    spark = docs.sparkSession
    plain = docs.select("doc_id", "text")
    labelled = _labelled(labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")))
    chosen = _sampled(labelled, per_class)
    # at most 2 * per_class ids; of an id's texts the smallest in byte order is the example
    sample = written(plain.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")))
    lexicon, lift = vocabulary(sample)
    made, shared, documents = None, None, 0
    if len(lexicon):
        df, documents = document_frequencies(plain, lexicon)
        rows = sample.mapInArrow(_known(lexicon), "doc_id long, toxic int, terms array<int>, counts array<int>").toArrow().combine_chunks().sort_by("doc_id")
        ids, classes = rows.column("doc_id").to_numpy(), rows.column("toxic").to_numpy()
        vectors = [(t.values.to_numpy(), c.values.to_numpy()) for t, c in zip(rows.column("terms"), rows.column("counts"))]
        there = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        share = tuple(there.get(c, 0) / max(1, int((classes == c).sum())) for c in (0, 1))
        del rows

        def votes(examples: Examples, rows: np.ndarray, out: np.ndarray, k: int) -> np.ndarray:
            nonlocal shared
            shared = spark.sparkContext.broadcast((lexicon, examples))
            asked = spark.createDataFrame(pa.table({"row": rows, "out": out, "at": np.arange(len(rows))})).repartition(spark.sparkContext.defaultParallelism)
            got = asked.mapInArrow(_voter(shared, k), "at long, vote double").toArrow().sort_by("at")
            return got.column("vote").to_numpy()

        made = index(ids, classes, vectors, df, documents, k, share, lift, votes)
        del vectors
        made.terms = made.weights = None  # the workers have them
        vars(made).pop("lists", None)
    if shared is None:
        shared = spark.sparkContext.broadcast((lexicon, made))
    kind = plain.schema["doc_id"].dataType.simpleString()
    found = plain.mapInArrow(
        _searcher(shared, k), f"row long, doc_id {kind}, square double, near array<int>, cosines array<double>, terms array<long>, counts array<int>"
    )
    if made is None:
        lengths = found.withColumn("rest", F.lit(0.0))
    else:
        found = written(found)
        shared.destroy()
        pairs = found.select("row", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("row", "x.terms", "x.counts")
        df = pairs.groupBy("terms").agg(F.count("*").alias("df"))
        weight = (1 + F.log("counts")) * (F.log((1 + F.lit(documents)) / (1 + F.col("df"))) + 1)
        rest = pairs.join(df, "terms").groupBy("row").agg(F.sum(weight * weight).alias("rest"))
        lengths = found.join(rest, "row", "left")
    scored = lengths.select("doc_id", "square", "near", "cosines", F.coalesce("rest", F.lit(0.0)).alias("rest")).mapInArrow(
        _scorer(made and spark.sparkContext.broadcast((made.ids, made.toxic, made.slope))), f"doc_id {kind}, score double, neighbours array<long>, similarities array<double>"
    )
    return scored.select(
        "doc_id",
        (~learnable(F.col("doc_id"))).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
        "neighbours",
        "similarities",
    )


def _lists(bounds, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))


def _known(lexicon: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for words, (cuts, places, counts), _ in _split(batch.column("text"), lexicon):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(words)).cast(pa.int64()),
                        batch.column("toxic").slice(at, len(words)),
                        _lists(cuts, places.astype(np.int32)),
                        _lists(cuts, counts.astype(np.int32)),
                    ],
                    names=["doc_id", "toxic", "terms", "counts"],
                )
                at += len(words)

    return run


def _searcher(shared, k: int) -> Callable:
    """By text: its nearest rows with the cosines of its known terms, the square of their length, and its other terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lexicon, made = shared.value
        row, nobody = TaskContext.get().partitionId() << 40, (np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            at = 0
            for words, (cuts, places, counts), (ends, terms, times) in _split(batch.column("text"), lexicon):
                n = len(words)
                square, found = np.zeros(n), [nobody] * n
                if made is not None:
                    weights = (1 + np.log(counts)) * made.idf[places]
                    square = np.diff(np.concatenate([[0.0], np.cumsum(weights**2)])[cuts])
                    full = np.flatnonzero(np.diff(cuts) > 0)
                    queries = [made.vector(places[cuts[t] : cuts[t + 1]], counts[cuts[t] : cuts[t + 1]]) for t in full]
                    for t, x in zip(full, made.nearest_all(queries, k)):
                        found[t] = x
                    strange = made.prepared().by_id[:k]
                    for t in np.flatnonzero((words > 0) & (np.diff(cuts) == 0)):
                        square[t], found[t] = 0.0, (strange, np.zeros(len(strange)))
                else:
                    ends, terms, times = ends * 0, terms[:0], times[:0]
                near = np.cumsum([0, *[len(r) for r, _ in found]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)), batch.column("doc_id").slice(at, n), pa.array(square),
                        _lists(near, np.concatenate([r for r, _ in found]).astype(np.int32)), _lists(near, np.concatenate([s for _, s in found])),
                        _lists(ends, terms.view(np.int64)), _lists(ends, times.astype(np.int32)),
                    ],
                    names=["row", "doc_id", "square", "near", "cosines", "terms", "counts"],
                )
                row, at = row + n, at + n

    return run


def _voter(shared, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, made = shared.value
        for batch in batches:
            rows, out = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "out"))
            yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array(_votes(made, rows, out, k), pa.float64())], names=["at", "vote"])

    return run


def _scorer(curve) -> Callable:
    """Cosines of whole vectors, neighbours' ids, and the score of their vote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = curve and Examples(*curve.value[:2], *[np.zeros(0)] * 4, curve.value[2])
        for batch in batches:
            square, rest = (batch.column(c).to_numpy() for c in ("square", "rest"))
            shrink = np.sqrt(square / np.maximum(square + rest, 1e-300))
            scores, near, alike = [], [], []
            for rows, cosines, s in zip(batch.column("near").to_pylist(), batch.column("cosines").to_pylist(), shrink):
                sims = np.round(np.array(cosines) * s, 9)
                scores.append(0.0 if made is None else made.score(made.vote(rows, sims) if rows else 0.0))
                near.append([] if made is None else made.ids[rows].tolist() if rows else [])
                alike.append(sims.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(near, pa.list_(pa.int64())), pa.array(alike, pa.list_(pa.float64()))],
                names=["doc_id", "score", "neighbours", "similarities"],
            )

    return run
