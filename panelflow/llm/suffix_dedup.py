"""Removal of long byte strings that a document with a smaller id already has.

A window is a string of ``WIDTH`` bytes within a document.  It is placed by its smallest gram hash, so equal
windows have equal keys wherever they stand; windows in a row with one key are a segment.

1. Documents are dealt into runs.  Runs and owners exchange their distinct keys, Golomb-coded,
   and learn which occur in more than one document.
2. A run sends each distinct segment with such a key once, with the smallest and largest id it
   has there, to the shard of the key: hot passages are folded before the shuffle.
3. A shard folds equal segments.  Where a key has different segments, windows whose hash no other window
   of the shard has are their own; over the stretches of all others it builds suffix
   arrays in parts of bounded size; common prefixes of ``WIDTH`` or more make groups of equal windows, each with its
   smallest id.  A key spread over several parts is merged by binary search between their sorted windows.
4. Runs get back, per segment, which windows a smaller id has, and remove the bytes these cover.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelflow.llm import golomb
from panelflow.llm.suffixes import common_prefixes, suffix_array
from panelflow.llm.texts import _BASE, _CODE, _powers, blocks, mix

WIDTH = 50
GRAM = 16
RUN_BYTES = 3 << 20
BLOCK_BYTES = 1 << 18  # of a run's texts worked on together
PART_BYTES = 2 << 20
HASHED_BYTES = 1 << 18  # of a shard's texts hashed together
NO_ID = np.iinfo(np.int64).max


def segments(data: np.ndarray, bounds: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Key, first window, number of windows, content hash and row of each segment of several texts."""
    n = len(data)
    if n < width:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none.view(np.uint64), none
    up, down = _powers(_BASE, room := 1 << max(19, n.bit_length())), _powers(pow(_BASE, -1, 1 << 64), room)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE[data] * up[:n], out=sums[1:])
    low = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    span, grams = 1, width - gram + 1
    while span * 2 <= grams:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < grams:
        low = np.minimum(low[: len(low) - (grams - span)], low[grams - span :])
    long = np.flatnonzero(np.diff(bounds) >= width)
    change = np.zeros(len(low) + 1, np.int8)
    change[bounds[long]] += 1
    change[bounds[long + 1] - width + 1] -= 1
    valid = np.cumsum(change[:-1], dtype=np.int8) > 0
    same = np.zeros(len(low), bool)
    same[1:] = valid[1:] & valid[:-1] & (low[1:] == low[:-1])
    starts = np.flatnonzero(valid & ~same)
    ends = np.flatnonzero(valid & ~np.append(same[1:], False)) + 1
    content = mix((sums[ends + width - 1] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return low[starts], starts, ends - starts, content, np.searchsorted(bounds, starts, "right") - 1


def _ids(table: pa.Table) -> np.ndarray:
    """Ids as whole numbers; a null one counts as the largest."""
    return table.column("doc_id").combine_chunks().cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _text(table: pa.Table) -> pa.Array:
    column = table.column("text").combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def _own_keys(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a run, sorted, and whether more than one id of the run has each."""
    ids, keys, docs = _ids(table), [], []
    for first, end, data, bounds in blocks(_text(table), BLOCK_BYTES):
        key, _, _, _, row = segments(data, bounds, width)
        keys.append(key)
        docs.append(ids[first:end][row])
    keys, docs = np.concatenate([*keys, np.zeros(0, np.uint64)]), np.concatenate([*docs, np.zeros(0, np.int64)])
    by = np.argsort(keys, kind="stable")
    keys, docs = keys[by], docs[by]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    several = np.minimum.reduceat(docs, heads) != np.maximum.reduceat(docs, heads) if len(heads) else np.zeros(0, bool)
    return keys[heads], several


def _send(owners: int, width: int) -> Callable:
    step = -(-(1 << 40) // owners)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys = np.unique(_own_keys(table, width)[0] >> np.uint64(24))
        cuts = np.searchsorted(keys, np.arange(owners + 1, dtype=np.uint64) * np.uint64(step))
        out = []
        for o in np.flatnonzero(np.diff(cuts)).tolist():
            piece = keys[cuts[o] : cuts[o + 1]]
            k, unary, rest = golomb.encode(piece, o * step, step)
            out.append({"run": key[0].as_py(), "owner": o, "n": len(piece), "k": k, "unary": unary, "rest": rest})
        return pa.Table.from_pylist(out, schema=_PIECES)

    return run


_PIECES = pa.schema([("run", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32()), ("unary", pa.binary()), ("rest", pa.binary())])
_ANSWERS = pa.schema([("run", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("bits", pa.binary())])
_SEGMENTS = pa.schema([("shard", pa.int32()), ("run", pa.int64()), *[(c, pa.binary()) for c in ("key", "windows", "content", "low", "high", "text")]])
_VERDICTS = pa.schema([("run", pa.int64()), *[(c, pa.binary()) for c in ("content", "first", "end", "low")]])


def _answer(owners: int) -> Callable:
    step = -(-(1 << 40) // owners)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        marks = [golomb.decode(r["n"], key[0].as_py() * step, r["k"], r["unary"], r["rest"]) for r in rows]
        every = np.sort(np.concatenate(marks))
        twice = every[1:][every[1:] == every[:-1]]
        out = []
        for r, m in zip(rows, marks):
            at = np.minimum(np.searchsorted(twice, m), max(0, len(twice) - 1))
            out.append({"run": r["run"], "owner": r["owner"], "n": r["n"], "bits": np.packbits(twice[at] == m if len(twice) else np.zeros(len(m), bool)).tobytes()})
        return pa.Table.from_pylist(out, schema=_ANSWERS)

    return run


def _offer(shards: int, width: int) -> Callable:
    """Distinct segments of a run whose key another document has, by shard."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _SEGMENTS.empty_table()
        keys, several = _own_keys(table, width)
        coarse, back = np.unique(keys >> np.uint64(24), return_inverse=True)
        bits = [np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]) for r in sorted(answers.to_pylist(), key=lambda r: r["owner"])]
        shared = keys[several | np.concatenate([*bits, np.zeros(0, np.uint8)]).astype(bool)[back]] if len(coarse) else keys
        ids, found, texts, base = _ids(table), [], [], 0
        for first, end, data, bounds in blocks(_text(table), BLOCK_BYTES):
            key, start, windows, content, row = segments(data, bounds, width)
            at = np.minimum(np.searchsorted(shared, key), max(0, len(shared) - 1))
            use = np.flatnonzero(shared[at] == key) if len(shared) else np.zeros(0, np.int64)
            _, once = np.unique(content[use], return_index=True)
            lengths = np.zeros(len(use), np.int64)
            lengths[once] = windows[use][once] + width - 1
            texts.append(data[_spread(start[use][once], lengths[once])])
            offsets = np.full(len(use), -1, np.int64)
            offsets[once] = base + np.cumsum(lengths[once]) - lengths[once]
            base += int(lengths.sum())
            found.append((key[use], windows[use], content[use], ids[first:end][row[use]], offsets))
        key, windows, content, docs, offsets = (np.concatenate(x) for x in zip(*found))
        if not len(key):
            return _SEGMENTS.empty_table()
        text = np.concatenate(texts)
        by = np.lexsort((offsets < 0, content, key % np.uint64(shards)))
        key, windows, content, docs, offsets = key[by], windows[by], content[by], docs[by], offsets[by]
        heads = np.flatnonzero(np.concatenate([[True], content[1:] != content[:-1]]))
        low, high = np.minimum.reduceat(docs, heads), np.maximum.reduceat(docs, heads)
        key, windows, content, offsets = key[heads], windows[heads], content[heads], offsets[heads]
        shard = (key % np.uint64(shards)).astype(np.int64)
        out, number = [], table.column("run")[0].as_py()
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            i = slice(cuts[s], cuts[s + 1])
            body = text[_spread(offsets[i], windows[i] + width - 1)]
            out.append(
                {"shard": s, "run": number, "key": key[i].tobytes(), "windows": _shrunk(windows[i]), "content": content[i].tobytes(),
                 "low": _shrunk(low[i]), "high": _shrunk(high[i]), "text": _shrunk(body)}
            )
        return pa.Table.from_pylist(out, schema=_SEGMENTS)

    return run


def _shrunk(values: np.ndarray) -> bytes:
    """Neighbouring segments share most of their bytes, so they are packed before the shuffle."""
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _grown(blob: bytes, size: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True), kind)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the lengths, one after the other."""
    total = np.cumsum(lengths)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(starts - (total - lengths), lengths)


def window_owners(text: np.ndarray, starts: np.ndarray, windows: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of segments lying one after the other in ``text``: group, and by group the smallest id and one place.

    Groups are numbered in the order of their windows' bytes.
    """
    order = suffix_array(text, width)
    group = np.cumsum(common_prefixes(text, order) < width) - 1
    by_place = np.empty(len(text), np.int64)
    by_place[order] = group
    places = _spread(starts, windows)
    used, numbers = np.unique(by_place[places], return_inverse=True)
    least = np.full(len(used), NO_ID, np.int64)
    np.minimum.at(least, numbers, np.repeat(low, windows))
    one = np.zeros(len(used), np.int64)
    one[numbers] = places
    return numbers, least, one


def least_ids(text: np.ndarray, key: np.ndarray, windows: np.ndarray, low: np.ndarray, width: int, part_bytes: int = PART_BYTES) -> np.ndarray:
    """The smallest id that has each window of the segments, which are sorted by key.

    Segments are cut into parts of bounded size, each with a suffix array of its own.  Parts that
    have a key in common are merged: their sorted windows are searched in each other's.
    """
    lengths = windows + width - 1
    ends = np.cumsum(lengths)
    part = (ends - lengths) // part_bytes
    out = np.empty(int(windows.sum()), np.int64)
    stops = np.cumsum(windows)
    known: list[tuple[np.ndarray, np.ndarray]] = []
    waiting: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for a, b in zip(heads, np.append(heads[1:], len(key))):
        begin = ends[a] - lengths[a]
        own = text[begin : ends[b - 1]]
        numbers, least, one = window_owners(own, ends[a:b] - lengths[a:b] - begin, windows[a:b], low[a:b], width)
        if a and key[a] != key[a - 1]:
            known, waiting = [], _settle(out, known, waiting)
        shared = (a > 0 and key[a] == key[a - 1]) or (b < len(key) and key[b] == key[b - 1])
        at = int(stops[a] - windows[a])
        if shared:
            strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(own, width)[one]).view(f"S{width}").ravel()
            known.append((strings, least))
            waiting.append((at, numbers, strings, least))
        else:
            out[at : at + len(numbers)] = least[numbers]
    _settle(out, known, waiting)
    return out


def window_hashes(text: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows that begin at ``starts``, which are sorted; equal windows have equal ones."""
    out = np.empty(len(starts), np.uint64)
    room = 1 << max(19, (HASHED_BYTES + width).bit_length())
    up, down = _powers(_BASE, room), _powers(pow(_BASE, -1, 1 << 64), room)
    for first in range(0, len(text), HASHED_BYTES):
        these = slice(*np.searchsorted(starts, [first, first + HASHED_BYTES]))
        data, at = text[first : first + HASHED_BYTES + width], starts[these] - first
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODE[data] * up[: len(data)], out=sums[1:])
        out[these] = mix((sums[at + width] - sums[at]) * down[at])
    return out


def repeated_ids(text: np.ndarray, key: np.ndarray, windows: np.ndarray, low: np.ndarray, width: int, part_bytes: int = PART_BYTES) -> np.ndarray:
    """``least_ids``, which looks only at stretches of windows whose hash occurs twice: no other can equal another window.

    Whole keys are looked at together, up to about ``HASHED_BYTES``, or one key if it has more.
    """
    lengths = windows + width - 1
    ends, stops = np.cumsum(lengths), np.cumsum(windows)
    out = np.empty(int(stops[-1]), np.int64)
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    number = (ends - lengths)[heads] // HASHED_BYTES
    heads = heads[np.concatenate([[True], number[1:] != number[:-1]])]
    for a, b in zip(heads, np.append(heads[1:], len(key))):
        own = text[ends[a] - lengths[a] : ends[b - 1]]
        segment = np.repeat(np.arange(a, b), windows[a:b])
        places = _spread(np.cumsum(lengths[a:b]) - lengths[a:b], windows[a:b])
        found = low[segment]
        hashes = window_hashes(own, places, width)
        ordered = np.sort(hashes)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            again = twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes
            first = again & np.concatenate([[True], ~again[:-1] | (segment[1:] != segment[:-1])])
            counts = np.diff(np.append(np.flatnonzero(first[again]), np.count_nonzero(again)))
            of, begin = segment[first], places[first]
            found[again] = least_ids(own[_spread(begin, counts + width - 1)], key[of], counts, low[of], width, part_bytes)
        out[stops[a] - windows[a] : stops[b - 1]] = found
    return out


def _settle(out: np.ndarray, known: list, waiting: list) -> list:
    """Binary search of each part's windows in those of all parts it shares a key with."""
    for at, numbers, strings, least in waiting:
        least = least.copy()
        for others, theirs in known:
            place = np.minimum(np.searchsorted(others, strings), len(others) - 1)
            hit = others[place] == strings
            least[hit] = np.minimum(least[hit], theirs[place[hit]])
        out[at : at + len(numbers)] = least[numbers]
    return []


def _judge(width: int, part_bytes: int) -> Callable:
    """What each run must know of its segments: ranges of windows and the smallest id that has them."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        read = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])
        keys, content = read("key", np.uint64), read("content", np.uint64)
        windows, low, high = (np.concatenate([_grown(r[c], len(r["key"]), np.int64) for r in rows]) for c in ("windows", "low", "high"))
        counts = [len(r["key"]) // 8 for r in rows]
        sizes = np.add.reduceat(windows + width - 1, np.cumsum([0, *counts[:-1]]))
        text = np.concatenate([_grown(r["text"], int(n), np.uint8) for r, n in zip(rows, sizes)])
        source = np.repeat(np.arange(len(rows)), [len(r["key"]) // 8 for r in rows])
        offsets = np.cumsum(windows + width - 1) - (windows + width - 1)
        by = np.lexsort((content, keys))
        keys, windows, content, low, high, source, offsets = (x[by] for x in (keys, windows, content, low, high, source, offsets))
        heads = np.flatnonzero(np.concatenate([[True], content[1:] != content[:-1]]))
        distinct = np.cumsum(np.concatenate([[True], content[1:] != content[:-1]])) - 1
        least = np.minimum.reduceat(low, heads)
        dkey, dwindows, doffsets = keys[heads], windows[heads], offsets[heads]
        first_of_key = np.concatenate([[True], dkey[1:] != dkey[:-1]])
        contested = ~(first_of_key & np.append(first_of_key[1:], True))
        piece_of, a, b, who = [np.flatnonzero(~contested)], [np.zeros((~contested).sum(), np.int64)], [dwindows[~contested]], [least[~contested]]
        c = np.flatnonzero(contested)
        if len(c):
            body = text[_spread(doffsets[c], dwindows[c] + width - 1)]
            owners = repeated_ids(body, dkey[c], dwindows[c], least[c], width, part_bytes)
            segment = np.repeat(c, dwindows[c])
            change = np.flatnonzero(np.concatenate([[True], (owners[1:] != owners[:-1]) | (segment[1:] != segment[:-1])]))
            inside = np.arange(len(owners)) - np.repeat(np.cumsum(dwindows[c]) - dwindows[c], dwindows[c])
            piece_of.append(segment[change])
            a.append(inside[change])
            b.append(inside[np.append(change[1:], len(owners)) - 1] + 1)
            who.append(owners[change])
        piece_of, a, b, who = (np.concatenate(x) for x in (piece_of, a, b, who))
        sort = np.argsort(piece_of, kind="stable")
        piece_of, a, b, who = piece_of[sort], a[sort], b[sort], who[sort]
        starts = np.searchsorted(piece_of, distinct)
        counts = np.searchsorted(piece_of, distinct, "right") - starts
        take = _spread(starts, counts)
        entry = np.repeat(np.arange(len(distinct)), counts)
        matters = who[take] < high[entry]
        take, entry = take[matters], entry[matters]
        order = np.argsort(source[entry], kind="stable")
        take, entry = take[order], entry[order]
        cuts = np.searchsorted(source[entry], np.arange(len(rows) + 1))
        out = []
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            t, e = take[cuts[s] : cuts[s + 1]], entry[cuts[s] : cuts[s + 1]]
            out.append({"run": rows[s]["run"], "content": content[e].tobytes(), "first": a[t].astype(np.int32).tobytes(), "end": b[t].astype(np.int32).tobytes(), "low": who[t].tobytes()})
        return pa.Table.from_pylist(out, schema=_VERDICTS)

    return run


def _finish(width: int, as_text: bool, id_type: pa.DataType, rest: pa.DataType | None) -> Callable:
    shape = pa.schema(
        [("doc_id", id_type), *([("rest", rest)] if rest else []), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string() if as_text else pa.binary())]
    )

    def run(table: pa.Table, verdicts: pa.Table) -> pa.Table:
        if not table.num_rows:
            return shape.empty_table()
        rows = verdicts.to_pylist()
        read = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows] or [np.zeros(0, kind)])
        content, a, b, low = read("content", np.uint64), read("first", np.int32).astype(np.int64), read("end", np.int32).astype(np.int64), read("low", np.int64)
        by = np.argsort(content, kind="stable")
        content, a, b, low = content[by], a[by], b[by], low[by]
        ids, sizes, removed, spans, kept = _ids(table), [], [], [], []
        for first, end, data, bounds in blocks(_text(table), BLOCK_BYTES):
            _, start, _, mark, row = segments(data, bounds, width)
            left = np.searchsorted(content, mark)
            counts = np.searchsorted(content, mark, "right") - left
            piece, seg = _spread(left, counts), np.repeat(np.arange(len(mark)), counts)
            smaller = low[piece] < ids[first:end][row[seg]]
            piece, seg = piece[smaller], seg[smaller]
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, start[seg] + a[piece], 1)
            np.add.at(change, start[seg] + b[piece] + width - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            whole = data.tobytes()
            for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                mine = gone[p:q]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
                body = whole[p:q] if not len(edges) else data[p:q][~mine].tobytes()
                sizes.append(q - p)
                removed.append(int(mine.sum()))
                spans.append([{"first": x, "end": y} for x, y in edges.reshape(-1, 2).tolist()])
                kept.append(body.decode("utf-8", "ignore") if as_text else body)
        same = [table.column(c).combine_chunks() for c in shape.names if c in ("doc_id", "rest")]
        return pa.table([*same, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, shape.field("spans").type), pa.array(kept, shape.field("kept").type)], schema=shape)

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, as_text: bool = False,
    run_bytes: int = RUN_BYTES, part_bytes: int = PART_BYTES, carry: Sequence[str] = ()
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, spans, kept; with ``carry`` also rest, a struct of those columns.

    Every byte covered by a string of ``width`` bytes that also starts in a document with a
    smaller id goes; all strings are judged on the input.  ``spans`` are the maximal removed
    stretches, ``kept`` the other bytes, or with ``as_text`` the text they make (a character of which a part
    goes, goes).  Null texts count as empty; ids are whole numbers, a null one counts as the largest, and rows with
    equal ids remove nothing from each other.  Texts below ``width`` bytes stay as they are; other columns play no part.
    Windows are compared by their bytes or, within equal segments, by 64-bit hashes of key and contents.
    """
    spark = docs.sparkSession
    from pyspark.sql.pandas.types import to_arrow_type

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.struct(*carry).alias("rest")] if carry else []))
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs, shards = max(4 * partitions, -(-total // run_bytes)), max(partitions, -(-total // (4 * run_bytes)))
    dealt = plain.withColumn("run", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(runs)))
    by_run = dealt.groupBy("run")  # one exchange of the texts, used three times
    pieces = by_run.applyInArrow(_typed(_send(shards, width)), "run long, owner int, n int, k int, unary binary, rest binary")
    answers = pieces.groupBy("owner").applyInArrow(_typed(_answer(shards)), "run long, owner int, n int, bits binary")
    blobs = "key binary, windows binary, content binary, low binary, high binary, text binary"
    offers = by_run.cogroup(answers.groupBy("run")).applyInArrow(_typed2(_offer(shards, width)), f"shard int, run long, {blobs}")
    verdicts = offers.groupBy("shard").applyInArrow(_typed(_judge(width, part_bytes)), "run long, content binary, first binary, end binary, low binary")
    kind = plain.schema["doc_id"].dataType
    rest = plain.schema["rest"].dataType if carry else None
    shape = f"doc_id {kind.simpleString()}, {f'rest {rest.simpleString()}, ' if rest else ''}n_bytes long, n_removed long, spans array<struct<first:long,end:long>>, kept {'string' if as_text else 'binary'}"
    return by_run.cogroup(verdicts.groupBy("run")).applyInArrow(_typed2(_finish(width, as_text, to_arrow_type(kind), to_arrow_type(rest) if rest else None)), shape)


def _typed(function: Callable) -> Callable:
    def of_group(key: tuple, table: pa.Table) -> pa.Table:
        return function(key, table)

    return of_group


def _typed2(function: Callable) -> Callable:
    def of_groups(left: pa.Table, right: pa.Table) -> pa.Table:
        return function(left, right)

    return of_groups
