"""Variable-capacity best-fit packing of documents into training sequences."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelflow.operators.sized import written

CAPACITIES = (1024, 2048, 4096, 8192, 16384)
GROUP_PIECES = 50_000  # pieces that one task packs together, about


def cost(capacity: int, overhead: int = 64, attention: int = 65_536) -> float:
    """What a sequence of this length costs: its tokens, a fixed share, and attention over them."""
    return capacity + overhead + capacity * capacity / attention


def best_fit(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[list[int], list[int]]:
    """Bin of each piece and capacity of each bin; ``sizes`` are sorted, largest first.

    A piece goes to the open bin it leaves least room in.  If it fits in none, the bin size opens
    that costs least per token, counting as its contents what is still to be placed.  Every
    permitted length is tried as the largest to open; the cheapest outcome counts, after
    each bin has been taken down to the smallest permitted length that holds its contents.
    """
    permitted = sorted(capacities)
    left_after = np.cumsum(np.asarray(sizes[::-1], np.int64))[::-1]
    best: tuple[float, list[int], list[int]] | None = None
    for top in permitted:
        if sizes and top < sizes[0]:
            continue
        openable = [c for c in permitted if c <= top]
        room: list[tuple[int, int]] = []  # (free, bin), sorted
        used: list[int] = []
        bins: list[int] = []
        for k, size in enumerate(sizes):
            at = bisect_left(room, (size, -1))
            if at < len(room):
                free, number = room.pop(at)
            else:
                free = min((c for c in openable if c >= size), key=lambda c: (cost(c) / max(1, min(c, int(left_after[k]))), c))
                number = len(used)
                used.append(0)
            used[number] += size
            bins.append(number)
            if free > size:
                insort(room, (free - size, number))
        final = [permitted[bisect_left(permitted, u)] for u in used]
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = total, bins, final
    return (best[1], best[2]) if best else ([], [])


def pack(docs: DataFrame, length: Column, id_col: str = "doc_id", capacities: Sequence[int] = CAPACITIES, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: bin_id, capacity, filled, doc_id, piece, n_pieces, position, n_tokens.

    A document longer than the largest capacity is cut into pieces of that length and a
    rest, all placed; a document of length 0 or null is one piece of 0 tokens, placed like any other,
    so every input row is in the result.  Pieces are dealt by a hash of (id, piece, length) into groups of about
    ``group_pieces``, each packed by one task, so work and memory of a task are bounded and a hot length or id
    spreads.  A null id, repeated rows and equal lengths are ordered by (length, id, piece), which
    makes the packing a function of the rows alone.  Bin ids are "group-number".
    """
    top = max(capacities)
    tokens = F.greatest(F.coalesce(length, F.lit(0)).cast("long"), F.lit(0))
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    pieces = (
        docs.select(F.col(id_col).alias("doc_id"), tokens.alias("tokens"))
        .withColumn("n_pieces", F.greatest(F.ceil(F.col("tokens") / top), F.lit(1)).cast("long"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_pieces") - 1)))
        .withColumn("n_tokens", F.least(F.col("tokens") - F.col("piece") * top, F.lit(top)))
        .select("doc_id", "piece", "n_pieces", "n_tokens")
    )
    pieces = written(pieces)
    groups = max(1, -(-pieces.count() // group_pieces))
    permitted = tuple(capacities)

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("n_pieces", "ascending")])
        sizes = rows.column("n_tokens").to_numpy()
        bins, final = best_fit(sizes.tolist(), permitted)
        bins = np.asarray(bins, np.int64)
        by = np.argsort(bins, kind="stable")
        heads = np.flatnonzero(np.diff(bins[by], prepend=-1))
        before = np.cumsum(sizes[by]) - sizes[by]
        position = np.empty_like(sizes)
        position[by] = before - np.repeat(before[heads], np.diff(heads, append=len(by)))
        columns = {
            "bin_id": pa.array([f"{key[0].as_py()}-{b}" for b in bins]),
            "capacity": pa.array(np.asarray(final, np.int64)[bins]),
            "filled": pa.array(np.add.reduceat(sizes[by], heads)[bins]),
            **{c: rows.column(c) for c in ("doc_id", "piece", "n_pieces")},
            "position": pa.array(position),
            "n_tokens": rows.column("n_tokens"),
        }
        return pa.table(columns)

    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(groups)))
    return dealt.groupBy("deal").applyInArrow(
        fill,
        f"bin_id string, capacity long, filled long, doc_id {kind}, piece long, n_pieces long, position long, n_tokens long",
    )
