"""Exact Jaccard join of word n-gram sets, with signature trees.

1. Every text becomes the set of its shingle hashes; equal sets are one node from here on.
2. A set linked to another shares at least ``least_shared`` of its shingles with it, so a
   set of which too many shingles occur nowhere else is out.  That is counted by an exchange of
   Golomb-coded hashes between runs of rows and owners of hash ranges; a run sends a hash once,
   however many of its rows have it.  First on the smallest hashes of all sets, then on all
   hashes of the sets that are left.
3. In any order of all hashes, two linked sets share one of their first n - least_shared + 1
   hashes.  Rare ones come first (by the number of runs that sent a hash, which the second exchange
   answers for every hash), so that neither a common passage nor a shingle that a few unlinked texts share by chance
   is a key before those of the true partners.  Hashes no other set has are no keys.  Connected components
   over these keys ("clusters") cut no link, and each cluster is joined by itself.
4. A cluster's block of sets is one task's signature tree: nodes hold the OR of their members' token
   bitmaps, their range of sizes and their largest surplus of tokens over bits; a dual traversal
   drops pairs of nodes whose largest possible overlap is too small, and those that are already
   of one component.  What is left is decided on the sets themselves.
   A cluster above the bound of a block is dealt over several; then the sets outside its largest
   component visit every block, so that any two sets not yet in one component meet.  They come in
   chunks of like sizes, bounded as blocks are: a task holds one block's sets of such sizes and one chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelflow.llm import golomb
from panelflow.llm.components import components
from panelflow.llm.texts import blocks, mix, shingle_hashes, word_hashes
from panelflow.operators.sized import drop_folder, written, written_at

WORDS = 5
PERCENT = 80
RUN_BITS = 12  # a run has at most 2**12 rows
BLOCK_TOKENS = 1_500_000  # hashes in one tree, about
ARITY = 8
SLICE = 4096  # pairs of nodes looked at together
BITMAP_BYTES = 8 << 20
PIVOTS = 8
MOST_RUNS = 255  # hashes of more runs count as equally common
SPOT_BITS = 24  # of the table that says which ids may be suspects
SHORT = np.uint64(24)  # bits dropped from hashes in the first, coarse exchange


def least_shared(n, percent: int = PERCENT):
    """The fewest shingles that a set of n shares with any set it is linked to."""
    return -(-n * percent // 100)


def linked(overlap, a, b, percent: int = PERCENT):
    return 100 * overlap >= percent * (a + b - overlap)


def sampled(tokens: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The smallest hashes: twice what may be missing, so that at least half of them must be shared."""
    n = len(tokens)
    return tokens[: min(n, max(1, 2 * (n - least_shared(n, percent))))]


def identity(tokens: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    salted = [mix(tokens ^ np.uint64(s)).sum(dtype=np.uint64) + np.uint64(len(tokens)) for s in (0x51ED270B, 0xB5297A4D)]
    return mix(np.array(salted, np.uint64)).tobytes()


def _sets(words: int, percent: int, whole: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, bounds in blocks(batch.column("text")):
                hashes, rows = word_hashes(data, bounds)
                sizes, nodes, kept = [], [], []
                for a, b in zip(rows[:-1], rows[1:]):
                    tokens = shingle_hashes(hashes[a:b], words)
                    sizes.append(len(tokens))
                    nodes.append(identity(tokens) if len(tokens) else None)
                    kept.append(tokens.tobytes() if whole else _pack(sampled(tokens, percent)))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(first, end - first) for c in batch.schema.names if c != "text"],
                        pa.array(sizes, pa.int32()), pa.array(nodes, pa.binary()), pa.array(kept, pa.binary()),
                    ],
                    names=[*[c for c in batch.schema.names if c != "text"], "n", "node", "tokens"],
                )

    return run


def _pack(tokens: np.ndarray) -> bytes:
    """Sorted hashes in 40 bits each."""
    return np.ascontiguousarray((tokens >> SHORT).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 5, 8), np.uint8)
    wide[:, 3:] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return wide.view(">u8").ravel().astype(np.uint64) << SHORT


def _exchanged(sets: DataFrame, owners: int, packed: bool, finish: Callable, shape: str) -> DataFrame:
    """What ``finish`` says of each run's rows.  ``sets``: run, tokens and what else ``finish`` needs.

    Runs and owners exchange distinct sorted hashes, Golomb-coded, and in how many runs each of them is.
    ``finish`` gets the rows, how many tokens each has and, for all tokens one after the other, the
    token, the number of runs and the number of the run's own rows that have it.
    """
    read = _unpack if packed else lambda blob: np.frombuffer(blob, np.uint64)
    step = -(-(1 << 64) // owners)

    def tokens_of(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parts = [read(t) for t in rows["tokens"]]
        sizes = np.array([len(p) for p in parts], np.int64)
        values, places, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        return values, places, counts, sizes

    def cut(values: np.ndarray) -> np.ndarray:
        inner = np.array([o * step for o in range(1, owners)], np.uint64)
        return np.concatenate([[0], np.searchsorted(values, inner), [len(values)]])

    def send(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = tokens_of(rows)[0]
        cuts, out = cut(values), []
        for o in np.flatnonzero(np.diff(cuts)):
            piece = values[cuts[o] : cuts[o + 1]]
            if packed:
                out.append((key[0], int(o), len(piece), *golomb.encode((piece - np.uint64(int(o) * step)) >> SHORT, 0, step >> int(SHORT))))
            else:
                out.append((key[0], int(o), len(piece), *golomb.encode(piece, int(o) * step, step)))
        return pd.DataFrame(out, columns=["run", "owner", "n", "k", "unary", "rest"])

    def answer(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        marks = [golomb.decode(p.n, 0, p.k, p.unary, p.rest) if packed else golomb.decode(p.n, int(key[0]) * step, p.k, p.unary, p.rest) for p in pieces.itertuples()]
        ordered = np.sort(np.concatenate(marks))
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        runs = np.diff(np.append(heads, len(ordered)))
        several = runs > 1
        repeated, often = ordered[heads[several]], np.minimum(runs[several], MOST_RUNS).astype(np.uint8)
        answers = []
        for m in marks:
            found = np.ones(len(m), np.uint8)
            if len(repeated):
                at = np.minimum(np.searchsorted(repeated, m), len(repeated) - 1)
                same = repeated[at] == m
                found[same] = often[at[same]]
            answers.append(pa.compress(found.tobytes(), codec="zstd", asbytes=True))
        return pd.DataFrame({"run": pieces["run"], "owner": pieces["owner"], "n": pieces["n"], "runs": answers})

    def receive(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = [field.split()[0] for field in shape.split(", ")]
        if not len(rows):
            return pd.DataFrame({name: [] for name in names})
        values, places, counts, sizes = tokens_of(rows)
        runs = [np.frombuffer(pa.decompress(a.runs, decompressed_size=a.n, codec="zstd", asbytes=True), np.uint8) for a in answers.sort_values("owner").itertuples()]
        return finish(rows, sizes, values[places], np.concatenate(runs)[places], counts[places])

    pieces = sets.groupBy("run").applyInPandas(send, "run long, owner int, n int, k int, unary binary, rest binary")
    answers = pieces.groupBy("owner").applyInPandas(answer, "run long, owner int, n int, runs binary")
    return sets.groupBy("run").cogroup(answers.groupBy("run")).applyInPandas(receive, shape)


def _shared(sizes: np.ndarray, runs: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How many of each row's tokens another row has."""
    ends, stops = np.concatenate([[0], np.cumsum((runs > 1) | (own > 1))]), np.cumsum(sizes)
    return ends[stops] - ends[stops - sizes]


def shared_counts(sets: DataFrame, owners: int) -> DataFrame:
    """row, shared: how many of a row's packed tokens occur in another row.  ``sets``: run, row, tokens."""

    def finish(rows: pd.DataFrame, sizes: np.ndarray, tokens: np.ndarray, runs: np.ndarray, own: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"row": rows["row"].to_numpy(), "shared": _shared(sizes, runs, own)})

    return _exchanged(sets.select("run", "row", "tokens"), owners, True, finish, "row long, shared long")


def keyed(sets: DataFrame, owners: int, percent: int) -> DataFrame:
    """node, n, tokens, keys of the sets that may be linked with another one.  ``sets``: run, node, tokens.

    Keys are those of the first n - least_shared + 1 tokens, the rarest first, that another set has.
    """

    def finish(rows: pd.DataFrame, sizes: np.ndarray, tokens: np.ndarray, runs: np.ndarray, own: np.ndarray) -> pd.DataFrame:
        out, stops = [], np.cumsum(sizes)
        left = sizes - _shared(sizes, runs, own) <= sizes - least_shared(sizes, percent)
        for k in np.flatnonzero(left).tolist():
            of = slice(stops[k] - sizes[k], stops[k])
            n = int(sizes[k])
            first = np.lexsort((tokens[of], runs[of]))[: n - least_shared(n, percent) + 1]
            first = first[(runs[of][first] > 1) | (own[of][first] > 1)]
            out.append((rows["node"].iat[k], n, rows["tokens"].iat[k], tokens[of][first].tobytes()))
        return pd.DataFrame(out, columns=["node", "n", "tokens", "keys"])

    return _exchanged(sets.select("run", "node", "tokens"), owners, False, finish, "node binary, n int, tokens binary, keys binary")


class Tree:
    """Signature tree over sets (sorted hashes), in the order of their smallest hashes."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, guests: np.ndarray | None = None):
        """``labels``: sets of one component so far; ``guests``: only pairs of a guest and another set matter."""
        order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i])))
        self.order = np.array(order, np.int64)
        self.sets = [sets[i] for i in order]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        width = 1 << int(np.clip(int(2 * np.median(self.sizes)).bit_length(), 9, 15))
        bits = np.zeros((len(sets), width // 64), np.uint64)
        for k, s in enumerate(self.sets):
            places = np.unique(s >> np.uint64(64 - (width.bit_length() - 1)))
            np.bitwise_or.at(bits[k], (places >> np.uint64(6)).astype(np.int64), np.uint64(1) << (places & np.uint64(63)))
        surplus = self.sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.parent = np.arange(len(sets))
        first: dict = {}
        for k, label in enumerate(labels[self.order]):
            self.parent[k] = first.setdefault(label, k)
        self.levels = [(bits, self.sizes, self.sizes, surplus)]
        side = None if guests is None else guests[self.order]
        self.sides = None if side is None else [(side, ~side)]
        while len(self.levels[-1][0]) > ARITY:
            b, low, high, extra = self.levels[-1]
            heads = np.arange(0, len(b), ARITY)
            self.levels.append((np.bitwise_or.reduceat(b, heads), np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads), np.maximum.reduceat(extra, heads)))
            if self.sides:
                self.sides.append(tuple(np.logical_or.reduceat(x, heads) for x in self.sides[-1]))

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return int(k)

    def union(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)

    def test(self, a: int, b: int, percent: int) -> None:
        if self.root(a) != self.root(b):
            x, y = (self.sets[a], self.sets[b]) if self.sizes[a] < self.sizes[b] else (self.sets[b], self.sets[a])
            if 100 * len(x) >= percent * len(y):
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                if linked(int((y[at] == x).sum()), len(x), len(y), percent):
                    self.union(a, b)

    def near(self, percent: int) -> None:
        """Link neighbours under a few orders first: copies end up in one component and are then pruned."""
        for salt in (0, 0x9E3779B9, 0x7F4A7C15, 0x1CE4E5B9):
            keys = [int((s if not salt else mix(s ^ np.uint64(salt))).min()) for s in self.sets]
            line = sorted(range(len(keys)), key=lambda k: (keys[k], self.sizes[k]))
            for a, b in zip(line, line[1:]):
                if keys[a] == keys[b] and (not self.sides or self.sides[0][0][a] != self.sides[0][0][b]):
                    self.test(a, b, percent)

    def whole(self) -> list[np.ndarray]:
        """By level and node: the component of all its sets, or -1."""
        roots = self.parent
        while not np.array_equal(roots, roots[roots]):
            roots = roots[roots]
        self.parent, out = roots.copy(), [roots]
        for _ in self.levels[1:]:
            heads = np.arange(0, len(roots), ARITY)
            low, high = np.minimum.reduceat(roots, heads), np.maximum.reduceat(roots, heads)
            roots = np.where((low == high) & (low >= 0), low, -1)
            out.append(roots)
        return out

    def possible(self, level: int, x: np.ndarray, y: np.ndarray, whole: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of nodes may hold a pair of linked sets of different components."""
        bits, low, high, extra = self.levels[level]
        fits = (100 * high[x] >= percent * low[y]) & (100 * high[y] >= percent * low[x])
        fits &= (whole[x] != whole[y]) | (whole[x] < 0)
        if level == 0:
            fits &= x != y
        if self.sides:
            guest, host = self.sides[level]
            fits &= (guest[x] & host[y]) | (host[x] & guest[y])
        step = max(1, BITMAP_BYTES // (8 * bits.shape[1]))
        found = np.flatnonzero(fits)
        for s in range(0, len(found), step):
            at = found[s : s + step]
            most = np.bitwise_count(bits[x[at]] & bits[y[at]]).sum(axis=1).astype(np.int64) + np.minimum(extra[x[at]], extra[y[at]])
            fits[at] = (100 + percent) * most >= percent * (low[x[at]] + low[y[at]])
        return fits

    def join(self, percent: int) -> None:
        """Dual traversal from the root, depth first in slices of node pairs, so that few pairs are held at once."""
        self.near(percent)
        top = len(self.levels) - 1
        stack = [(top, *np.triu_indices(len(self.levels[top][0])))]
        one, two = (g.ravel() for g in np.meshgrid(np.arange(ARITY), np.arange(ARITY), indexing="ij"))
        while stack:
            level, x, y = stack.pop()
            if len(x) > SLICE:
                stack.append((level, x[SLICE:], y[SLICE:]))
                x, y = x[:SLICE], y[:SLICE]
            fits = self.possible(level, x, y, self.whole()[level], percent)
            x, y = x[fits], y[fits]
            if not level:
                for a, b in zip(x.tolist(), y.tolist()):
                    self.test(a, b, percent)
            elif len(x):
                n = len(self.levels[level - 1][0])
                x, y = (x[:, None] * ARITY + one).ravel(), (y[:, None] * ARITY + two).ravel()
                good = (x < n) & (y < n) & (x <= y)
                stack.append((level - 1, x[good], y[good]))


def _join_block(percent: int) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(t, np.uint64) for t in rows["tokens"]]
        nodes = rows["node"].tolist()
        guests = rows["guest"].to_numpy(bool) if "guest" in rows else None
        tree = Tree(sets, np.array([bytes(x) for x in rows["label"]], object), guests)
        tree.join(percent)
        out = [(nodes[tree.order[k]], nodes[tree.order[tree.root(k)]]) for k in range(len(sets))]
        return pd.DataFrame([x for x in out if x[0] != x[1]], columns=["a", "b"])

    return run


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Rows link when 100 * intersection >= percent * union of their shingle sets; component_id is the
    smallest id reachable.  Null and empty texts and texts without words have no shingles and are linked with
    nothing; a text of fewer words than a shingle is one shingle.  Equal texts and repeated rows are
    linked; null ids take part and get the smallest id that is not null.  Other columns play no part.  Shingles are
    compared by 64-bit hashes, whole sets by 128 bits.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    coarse, coarse_at = written_at(
        plain.withColumn("row", F.monotonically_increasing_id())
        .mapInArrow(_sets(words, percent, False), f"doc_id {kind}, row long, n int, node binary, tokens binary")
        .withColumn("run", F.shiftright("row", RUN_BITS))
    )
    every = written(coarse.select("doc_id", "row", "n", "node", (F.length("tokens") / 5).alias("taken")))
    filled = every.filter("n > 0")
    need = -F.floor(-F.col("n") * percent / 100).cast("int")
    shared = shared_counts(coarse.filter("n > 0"), partitions)
    maybe = written(filled.join(shared, "row").filter(F.col("taken") - F.col("shared") <= F.col("n") - need).select("doc_id"))
    drop_folder(spark, coarse_at)
    sets = _suspects(plain, maybe).select("text").mapInArrow(_sets(words, percent, True), "n int, node binary, tokens binary").filter("n > 0")
    sets, sets_at = written_at(sets.groupBy("node").agg(F.first("tokens").alias("tokens")).withColumn("run", F.shiftright(F.monotonically_increasing_id(), RUN_BITS - 2)))
    left = written(keyed(sets, partitions, percent))
    drop_folder(spark, sets_at)
    keys = left.select("keys", "node").mapInArrow(_unfolded, "token long, node binary")
    sets = left.drop("keys")
    pivots = keys.groupBy("token").agg(F.min("node").alias("b"), F.count("*").alias("c")).filter("c > 1").select("token", "b")
    stars = written(keys.select("token", F.col("node").alias("a")).join(pivots, "token").filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("c")))
    clusters = written(components(stars.select("a", "b")))
    links = _joined(sets, stars, clusters, percent, block_tokens, spark)
    labels = components(links)
    groups = filled.groupBy("node").agg(F.min("doc_id").alias("low"))
    named = groups.join(labels, "node", "left").select("node", "low", F.coalesce("label", "node").alias("label"))
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    members = written(named.select("node", "label").join(lowest, "label").select("node", "component_id"))
    return every.select("doc_id", "n", "node").join(members, "node", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _suspects(plain: DataFrame, maybe: DataFrame) -> DataFrame:
    """Rows whose doc_id ``maybe`` has, null ones included.

    A table of bits by the ids' hashes, of a size that does not grow, keeps most other texts out of the exchange by id.
    """
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << SPOT_BITS))
    bit = "shiftleft(1L, cast(spot & 63 AS int))"
    spots = maybe.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).alias("cell")).agg(F.bit_or(F.expr(bit)).alias("bits"))
    seen = plain.withColumn("spot", spot).join(F.broadcast(spots), F.shiftright("spot", 6) == F.col("cell")).filter(F.expr(f"bits & {bit} <> 0"))
    ids = maybe.select(F.col("doc_id").alias("m")).distinct()  # a semi-join would be planned below the join with the bits
    return seen.join(ids, F.col("doc_id").eqNullSafe(F.col("m"))).select("doc_id", "text")


def _unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each key of a set."""
    for batch in batches:
        blobs = batch.column("keys").to_pylist()
        nodes = np.repeat(np.arange(len(blobs)), [len(b) // 8 for b in blobs])
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(blobs), np.int64)), batch.column("node").take(pa.array(nodes, pa.int64()))], names=["token", "node"])


def _joined(sets: DataFrame, stars: DataFrame, clusters: DataFrame, percent: int, block_tokens: int, spark) -> DataFrame:
    """Links (a, b) that connect the same sets as all links do."""
    sized = sets.join(clusters, "node").select("node", "n", "tokens", F.col("label").alias("cluster"))
    counts = sized.groupBy("cluster").agg(F.ceil(F.sum("n") / block_tokens).alias("parts"))
    dealt = written(sized.join(counts, "cluster").withColumn("part", F.pmod(F.xxhash64("node"), "parts")))
    block = ["cluster", "part"]
    plain = dealt.withColumn("label", F.col("node"))
    degree = stars.groupBy(F.col("b").alias("node")).agg(F.sum("c").alias("degree"))
    large = dealt.filter("parts > 1")
    best = (
        large.join(degree, "node").groupBy("cluster", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("draw"))
        .agg(F.max(F.struct("degree", "node")).alias("best")).select("cluster", F.col("best.node").alias("node"))
    )
    pivots = large.join(best, ["cluster", "node"], "left_semi")
    guests = pivots.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).filter("at <> part").withColumn("part", F.col("at"))
    columns = [*block, "node", "label", "tokens"]
    first = plain.select(columns).union(guests.withColumn("label", F.col("node")).select(columns))
    shape = "a binary, b binary"
    links = written(first.groupBy(*block).applyInPandas(_join_block(percent), shape))
    if large.isEmpty():
        return links
    labels = components(links)
    labelled = written(large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    biggest = labelled.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max(F.struct("count", "label")).alias("m")).select("cluster", F.col("m.label").alias("main"))
    marked = labelled.join(biggest, "cluster")
    rank = F.floor(F.log("n") / math.log(100.000001 / percent)).cast("long")  # linked sets are at most one rank apart
    guests = marked.filter("label <> main").withColumn("rank", rank)
    chunks = written(guests.groupBy("cluster", "rank").agg(F.ceil(F.sum("n") / block_tokens).alias("chunks")))
    group = [*block, "rank", "chunk"]
    elsewhere = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    visits = (
        guests.join(chunks, ["cluster", "rank"]).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(7)), "chunks"))
        .withColumn("at", elsewhere).filter("at <> part").withColumn("part", F.col("at"))
    )
    hosts = (
        marked.withColumn("rank", F.explode(F.array(rank - 1, rank, rank + 1))).join(chunks, ["cluster", "rank"])
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    )
    of = lambda frame, guest: frame.select(*group, "node", "label", "tokens", F.lit(guest).alias("guest"))
    met = of(hosts, False).union(of(visits, True)).groupBy(*group).applyInPandas(_join_block(percent), shape)
    return written(links.union(met).union(labelled.filter("label <> node").select(F.col("node").alias("a"), F.col("label").alias("b"))))
