"""Exact order statistics without a global sort.

A quantile over 10^12 rows needs neither a sort of the column nor a map of its distinct values.
A mergeable sketch brackets each wanted rank; the next pass counts what lies below the bracket
and looks only inside it.  Every pass is one scan with partial aggregation.  Once a bracket
holds no more rows than one task should sort, the distinct values inside it are counted and the
rank is read off.  Ties collapse to one row before the shuffle, so a value that fills a third of
the table is no burden.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F, types as T

from panelflow.operators.sized import join_written, written

GRID = 1000
CELLS = 4096  # of equal width, a first look at a whole column
SKETCH_ACCURACY = 10_000
# A bracket spans three grid cells; the sketch may be off by its accuracy at both ends.
SHARE_KEPT = 3 / GRID + 2 / SKETCH_ACCURACY

# Up to this many rows per group Spark's percentile is quick and its map small.
PERCENTILE_ROWS = 100_000
ONE_TASK_ROWS = 1_000_000
# Brackets are about a hundred bytes each; those of this many series are sure to be small.
FEW_SERIES = 10_000


GRID_POINTS = " ".join(str(i / GRID) for i in range(GRID + 1))


def _sketch(x: Column) -> Column:
    """Values at evenly spaced ranks.  The ranks are one text constant: a thousand literals slow planning."""
    return F.percentile_approx(x, F.split(F.lit(GRID_POINTS), " ").cast("array<double>"), SKETCH_ACCURACY)


@dataclass
class Look:
    """First look at some series: rows and sketch of each, how many series, rows of the largest."""

    table: DataFrame
    series: int
    largest: int


def first_look(series: DataFrame, keys: Sequence[str]) -> Look:
    sizes = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _sketch(F.col("x")).alias("grid"))
    seen = Observation()
    table = written(sizes.observe(seen, F.count(F.lit(1)).alias("series"), F.max("n").alias("largest")))
    return Look(table, seen.get["series"], seen.get["largest"] or 0)


@dataclass(frozen=True)
class Spot:
    """A wanted place in a series: two neighbouring 0-based ranks, over the columns of the look."""

    r0: Column
    r1: Column

    @staticmethod
    def at(rank: int) -> Spot:
        return Spot(F.lit(rank).cast("bigint"), F.lit(rank).cast("bigint"))

    @staticmethod
    def between(place: Column) -> Spot:
        return Spot(F.floor(place), F.ceil(place))


def _cell(rank: Column, rows: Column) -> Column:
    return F.floor(F.try_divide(rank, rows) * GRID).cast("int")


def _state_columns(spots: int) -> list[str]:
    return [f"{name}{i}" for i in range(spots) for name in ("lo", "hi", "r0_", "r1_")]


def _first_brackets(look: Look, spots: Sequence[Spot], keys: list[str]) -> DataFrame:
    """One row per series with the bracket of each spot: the sketch's cell and one more to each side."""
    columns = []
    for i, spot in enumerate(spots):
        lo = F.get("grid", F.greatest(_cell(spot.r0, F.col("n")) - 1, F.lit(0)))
        hi = F.get("grid", F.least(_cell(spot.r1, F.col("n")) + 2, F.lit(GRID)))
        columns += [lo.alias(f"lo{i}"), hi.alias(f"hi{i}"), spot.r0.alias(f"r0_{i}"), spot.r1.alias(f"r1_{i}")]
    return look.table.select(*keys, *columns)


def _with_brackets(series: DataFrame, state: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Rows next to their brackets; the brackets of few series are broadcast by their known number."""
    return series.join(F.broadcast(state), keys) if rows <= FEW_SERIES else join_written(series, state, keys)


def _tighten(series: DataFrame, state: DataFrame, spots: int, keys: list[str], rows: int) -> tuple[DataFrame, int]:
    """Narrower brackets, and the most rows that lay strictly inside one before.

    Rows below a bracket and on its ends are counted exactly; only values strictly inside are
    sketched, so ties on the ends do not stop it from shrinking.
    """
    x = F.col("x")
    counts = []
    for i in range(spots):
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        strict = (x > lo) & (x < hi)
        counts += [
            F.count_if(x <= lo).alias(f"upto_lo{i}"),
            F.count_if(strict).alias(f"inside{i}"),
            _sketch(F.when(strict, x)).alias(f"grid{i}"),
        ]
    kept = [F.max(c).alias(c) for c in _state_columns(spots)]
    seen = Observation()
    widest = F.max(F.greatest(F.lit(0), *[F.col(f"inside{i}") for i in range(spots)])).alias("widest")
    measured = written(_with_brackets(series, state, keys, rows).groupBy(*keys).agg(*kept, *counts).observe(seen, widest))
    columns = []
    for i in range(spots):
        lo, hi, inside = F.col(f"lo{i}"), F.col(f"hi{i}"), F.col(f"inside{i}")
        ahead0, ahead1 = (F.col(f"{r}_{i}") - F.col(f"upto_lo{i}") for r in ("r0", "r1"))
        new_lo = F.get(f"grid{i}", F.greatest(_cell(ahead0, inside) - 1, F.lit(0)))
        new_hi = F.get(f"grid{i}", F.least(_cell(ahead1, inside) + 2, F.lit(GRID)))
        columns += [
            F.when(ahead0 < 0, lo).when(ahead0 >= inside, hi).otherwise(new_lo).alias(f"lo{i}"),
            F.when(ahead1 >= inside, hi).when(ahead1 < 0, lo).otherwise(new_hi).alias(f"hi{i}"),
            f"r0_{i}",
            f"r1_{i}",
        ]
    return measured.select(*keys, *columns), seen.get["widest"] or 0


def _read_off(series: DataFrame, state: DataFrame, spots: int, keys: list[str], rows: int) -> DataFrame:
    """Values at both ranks of each spot, from the counted distinct values inside the brackets.

    Rows outside all brackets are counted by the gap they lie in: the number of brackets that
    begin at or below them.  A gap's rows come after the values in brackets that began before.
    After counting, the rows of a series are few and stay together.
    """
    x = F.col("x")
    inside, gap = F.lit(False), F.lit(0)
    for i in range(spots):
        inside = inside | x.between(F.col(f"lo{i}"), F.col(f"hi{i}"))
        gap = gap + (x >= F.col(f"lo{i}")).cast("int")
    counted = (
        _with_brackets(series, state, keys, rows)
        .groupBy(*keys, gap.alias("gap"), F.when(inside, x).alias("v"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .repartition(*keys)
    )
    so_far = F.sum("copies").over(
        Window.partitionBy(*keys).orderBy("gap", F.col("v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    )
    running = _with_brackets(counted.withColumn("upto", so_far), state, keys, rows)
    reached = lambda rank: F.min(F.when(F.col("upto") > F.col(rank), F.struct("upto", "v", "copies")))
    found = running.groupBy(*keys).agg(
        *[reached(f"{r}_{i}").alias(f"{r}_{i}") for i in range(spots) for r in ("r0", "r1")]
    )
    lost = F.raise_error(F.lit("a rank fell outside its bracket"))
    rows_out = []
    for i in range(spots):
        first, second = F.col(f"r0_{i}"), F.col(f"r1_{i}")
        v0 = F.when(first["v"].isNull() | second["v"].isNull(), lost).otherwise(first["v"])
        rows_out.append(
            F.struct(
                F.lit(i).alias("i"),
                v0.alias("v0"),
                second["v"].alias("v1"),
                first["copies"].alias("ties"),
                (first["upto"] - first["copies"]).alias("before"),
            )
        )
    return found.select(*keys, F.array(*rows_out).alias("spots"))


def select_ranks(
    series: DataFrame, look: Look, spots: Sequence[Spot], keys: Sequence[str], one_task_rows: int = ONE_TASK_ROWS
) -> DataFrame:
    """Exact values at the wanted ranks of the non-null ``x`` of each series, one row per series.

    ``spots`` holds, in the asked order, the values ``v0`` and ``v1``, the number of rows that
    tie with ``v0`` and of rows ``before`` them.
    """
    keys = list(keys)
    state = _first_brackets(look, spots, keys)
    bound = look.largest * SHARE_KEPT
    while bound * len(spots) > one_task_rows:
        state, inside = _tighten(series, state, len(spots), keys, look.series)
        bound = inside * SHARE_KEPT
    return _read_off(series, state, len(spots), keys, look.series)


def as_series(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per (row, column) with a non-null double ``x``; NaN counts as missing.

    Columns go by their position ``sid``: an integer key is cheaper to join and group on.
    """
    pairs = [F.struct(F.lit(i).alias("sid"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)]
    long = df.select(*by, F.explode(F.array(*pairs)).alias("pair")).select(*by, "pair.sid", "pair.x")
    return long.where(F.col("x").isNotNull() & ~F.isnan("x"))


def missing(c: Column | str) -> Column:
    """A column as double; NaN is a missing value, like null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.cast("double"), F.lit(None))


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    percentile_rows: int = PERCENTILE_ROWS,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Linearly interpolated quantiles, exact at any size.

    Returns ``by`` columns, ``variable``, ``n`` and the array ``q`` in the order of ``probs``: one
    row for every column of every group, with ``n`` = 0 and a null ``q`` where all values are
    missing.  Groups of moderate size use Spark's own ``percentile``, larger ones are bracketed; both give
    the same rows.  Null groups are left out.
    """
    by = list(by)
    for column in by:
        df = df.where(F.col(column).isNotNull())
    if not by:
        spans = _spans(df, columns)
        if max((s.n for s in spans), default=0) <= percentile_rows:
            return _by_percentile(df, columns, probs, by)
        found = _by_cells(df, columns, probs, spans, one_task_rows)
        return found if found is not None else _by_brackets(df, columns, probs, by, _wide_look(df, columns), one_task_rows)
    most = F.greatest(F.lit(0), *[F.count(missing(c)) for c in columns])
    seen = Observation()
    large = F.count_if(F.col("rows_of_largest") > percentile_rows)
    sizes = written(
        df.groupBy(*by).agg(most.alias("rows_of_largest")).observe(seen, large.alias("large"), F.count(F.lit(1)).alias("groups"))
    )
    if not seen.get["large"]:
        return _by_percentile(df, columns, probs, by)
    big = None
    if seen.get["large"] < seen.get["groups"]:
        sized = join_written(df, sizes, by)
        of = lambda test: sized.where(test).drop("rows_of_largest")
        df, big = of(F.col("rows_of_largest") <= percentile_rows), of(F.col("rows_of_largest") > percentile_rows)
    parts = _by_brackets(df if big is None else big, columns, probs, by, None, one_task_rows)
    return parts if big is None else _by_percentile(df, columns, probs, by).unionByName(parts)


@dataclass(frozen=True)
class Span:
    """Rows with a value, smallest and largest value of a column."""

    n: int
    low: float | None
    high: float | None

    def cell(self, x: Column) -> Column:
        """One of ``CELLS`` cells of equal width; never falls as x rises, as none of its steps does."""
        if self.low == self.high:
            return F.when(x.isNotNull(), 0)
        part = (x - F.lit(self.low)) / F.lit(self.high - self.low) * CELLS
        return F.when(x.isNotNull(), F.least(F.floor(part), F.lit(CELLS - 1)).cast("int"))

    @property
    def finite(self) -> bool:
        return not self.n or math.isfinite(self.high - self.low)


def _spans(df: DataFrame, columns: Sequence[str]) -> list[Span]:
    x = [missing(c) for c in columns]
    row = df.agg(*[F.struct(F.count(c), F.min(c), F.max(c)).alias(f"s{i}") for i, c in enumerate(x)]).first()
    return [Span(*row[f"s{i}"]) for i in range(len(columns))]


def _by_cells(df: DataFrame, columns: Sequence[str], probs: Sequence[float], spans: Sequence[Span], one_task_rows: int) -> DataFrame | None:
    """Quantiles of whole columns: rows per cell are counted, and only cells that hold a wanted rank are looked into.

    Two plain scans, no sketch; what reaches the driver are at most ``CELLS`` counts a column and two values a
    quantile.  None if a wanted cell holds more rows than one task should sort, as in very skewed columns.
    """
    if not all(span.finite for span in spans):
        return None
    cells = [span.cell(missing(c)) if span.n else F.lit(None).cast("int") for c, span in zip(columns, spans)]
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("sid"), c.alias("cell")) for i, c in enumerate(cells)]))
    counted = df.select(pairs.alias("p")).where("p.cell IS NOT NULL").groupBy("p.sid", "p.cell").agg(F.count(F.lit(1)).alias("n"))
    sizes: dict[int, dict[int, int]] = {}
    for row in counted.collect():
        sizes.setdefault(row["sid"], {})[row["cell"]] = row["n"]
    places = {(i, k): p * (span.n - 1) for i, span in enumerate(spans) if span.n for k, p in enumerate(probs)}
    wanted: dict[tuple[int, int], set[int]] = {}
    for (i, _), place in places.items():
        for rank in {math.floor(place), math.ceil(place)}:
            cell, offset = _range_of(sizes[i], rank)
            if sizes[i][cell] > one_task_rows:
                return None
            wanted.setdefault((i, cell), set()).add(offset)
    inside = [
        F.when(c.isin([cell for j, cell in wanted if j == i]), F.struct(F.lit(i).alias("sid"), c.alias("cell"), missing(name).alias("x")))
        for i, (name, c) in enumerate(zip(columns, cells)) if spans[i].n
    ]
    if not inside:
        return df.sparkSession.createDataFrame([(c, 0, None) for c in columns], "variable string, n long, q array<double>")
    values = df.select(F.explode(F.array(*inside)).alias("p")).where("p IS NOT NULL").groupBy("p.sid", "p.cell", "p.x").agg(F.count(F.lit(1)).alias("copies"))
    upto = F.sum("copies").over(Window.partitionBy("sid", "cell").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranks = df.sparkSession.createDataFrame([(i, cell, r) for (i, cell), all_ranks in wanted.items() for r in sorted(all_ranks)], "sid int, cell int, rank long")
    hits = values.withColumn("upto", upto).join(F.broadcast(ranks), ["sid", "cell"]).where("rank < upto AND rank >= upto - copies")
    found = {(r["sid"], r["cell"], r["rank"]): r["x"] for r in hits.select("sid", "cell", "rank", "x").collect()}

    def at(i: int, rank: int) -> float:
        return found[(i, *_range_of(sizes[i], rank))]

    rows = []
    for i, (name, span) in enumerate(zip(columns, spans)):
        q = []
        for k in range(len(probs)) if span.n else ():
            place = places[i, k]
            low, high = at(i, math.floor(place)), at(i, math.ceil(place))
            q.append(low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high)
        rows.append((name, span.n, q if span.n else None))
    return df.sparkSession.createDataFrame(rows, "variable string, n long, q array<double>")


def _wide_look(df: DataFrame, columns: Sequence[str]) -> Look:
    """First look at whole columns in one row of aggregates, without a row per value."""
    cells = [F.struct(F.lit(i).alias("sid"), F.count(missing(c)).alias("n"), _sketch(missing(c)).alias("grid")) for i, c in enumerate(columns)]
    row = df.agg(*[c.alias(f"s{i}") for i, c in enumerate(cells)])
    table = written(row.select(F.explode(F.array(*row.columns)).alias("s")).select("s.*"))
    largest = table.agg(F.max("n")).first()[0] or 0
    return Look(table.where("n > 0"), len(columns), largest)


def _by_brackets(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: list[str], look: Look | None, one_task_rows: int
) -> DataFrame:
    keys = [*by, "sid"]
    series = as_series(df, columns, by)
    look = look or first_look(series, keys)
    places = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    found = select_ranks(series, look, [Spot.between(h) for h in places], keys, one_task_rows)
    at = lambda i, v: F.get("spots", F.lit(i))[v]
    values = []
    for i, place in enumerate(places):
        low, high = at(i, "v0"), at(i, "v1")
        values.append(F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high))
    known = found.join(look.table.select(*keys, "n"), keys).select(*keys, "n", F.array(*values).alias("q"))
    sids = F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1))).alias("sid")
    every = df.groupBy(*by).agg(F.count(F.lit(1))).select(*by, sids) if by else df.sparkSession.range(1).select(sids)
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("sid"))
    return every.join(known, keys, "left").select(
        *by, name.alias("variable"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "q"
    )


def _by_percentile(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: list[str]) -> DataFrame:
    cuts = F.array(*[F.lit(float(p)) for p in probs])
    wide = df.groupBy(*by).agg(*[
        F.struct(F.lit(c).alias("variable"), F.count(missing(c)).alias("n"), F.percentile(missing(c), cuts).alias("q")).alias(f"s{i}")
        for i, c in enumerate(columns)
    ])
    rows = F.explode(F.array(*[F.col(f"s{i}") for i in range(len(columns))]))
    return wide.select(*by, rows.alias("s")).select(*by, "s.variable", "s.n", "s.q")


NOT_TOTAL = "order {} is not total: rows that tie lie on both sides of rank {}"


def _numeric_cut(
    df: DataFrame, order_by: Sequence[str], rank: int, found: tuple[Any, int, int], one_task_rows: int
) -> tuple[Any, ...]:
    """Order key of the row at a rank, given the value of its first column.

    Later columns are looked at only among the rows that tie so far, and only if the rank is not
    the first of them.
    """
    value, ties, before = found
    if rank == before:
        return (value,)
    rest, later = rank - before, list(order_by[1:])
    if not later:
        raise ValueError(NOT_TOTAL.format(list(order_by), rank))
    tied = df.where(F.col(order_by[0]) == F.lit(value)).select(*later)
    if ties <= one_task_rows:
        names = [f"o{i}" for i in range(len(later))]
        here = tied.select(F.lit(0).alias("range"), *[F.col(c).alias(n) for c, n in zip(later, names)])
        return (value, *_numbered(here, names, later, {rest: (0, rest)})[rest])
    return (value, *_cuts(tied, later, [rest], None, one_task_rows)[0])


def _numbered(dealt: DataFrame, names: list[str], order_by: Sequence[str], wanted: Mapping[int, tuple[int, int]]) -> dict[int, tuple[Any, ...]]:
    """Order keys by wanted rank; ``wanted`` says in which range of ``dealt`` and at which place there.

    Only ranges that hold a wanted row are numbered, each by one task; a row per rank reaches the driver.
    """
    ranges = sorted({r for r, _ in wanted.values()})
    places = Window.partitionBy("range").orderBy(*names)
    key = F.struct(*names)
    here = dealt.where(F.col("range").isin(ranges)).select(
        "range", *names, (F.row_number().over(places) - 1).alias("place"), (F.lag(key).over(places) == key).alias("tied")
    )
    hit = reduce(lambda a, b: a | b, [(F.col("range") == r) & (F.col("place") == p) for r, p in sorted(set(wanted.values()))])
    rows = {(row["range"], row["place"]): row for row in here.where(hit).collect()}
    for rank, spot in wanted.items():
        if rows[spot]["tied"]:
            raise ValueError(NOT_TOTAL.format(list(order_by), rank))
    return {rank: tuple(rows[spot][n] for n in names) for rank, spot in wanted.items()}


def _range_cuts(df: DataFrame, order_by: Sequence[str], ranks: Sequence[int], one_task_rows: int) -> list[tuple[Any, ...]]:
    """Order keys of the rows at some ranks, for columns of any type.

    The keys are dealt by ranges of the whole order, so a value that fills a third of the table is
    split by the columns after it, and rows per range are counted.  A range that holds a wanted row and
    more rows than one task should number is dealt again, on its own, until it is small enough; what
    reaches the driver are one count per range and one key per rank.
    """
    names = [f"o{i}" for i in range(len(order_by))]
    keys = df.select(*[F.col(c).alias(n) for c, n in zip(order_by, names)])
    found: dict[int, tuple[Any, ...]] = {}
    # (rows to deal, wanted ranks and their places among these rows)
    todo: list[tuple[DataFrame, dict[int, int]]] = [(keys, {rank: rank for rank in ranks})]
    while todo:
        rows, wanted = todo.pop()
        dealt, sizes = _dealt(rows, names)
        near: dict[int, tuple[int, int]] = {}
        deeper: dict[int, dict[int, int]] = {}
        for rank, place in wanted.items():
            part, offset = _range_of(sizes, place)
            if sizes[part] <= one_task_rows:
                near[rank] = part, offset
            else:
                deeper.setdefault(part, {})[rank] = offset
        if near:
            found |= _numbered(dealt, names, order_by, near)
        for part, inside in deeper.items():
            rest = dealt.where(F.col("range") == part).select(*names)
            if sizes[part] == sum(sizes.values()):  # few different keys, maybe one: take the ends off
                more, inside = _peeled(rest, names, order_by, sizes[part], inside)
                found |= more
                if not inside[1]:
                    continue
                rest, inside = inside
            todo.append((rest, inside))
    return [found[rank] for rank in ranks]


def _peeled(
    rows: DataFrame, names: list[str], order_by: Sequence[str], count: int, wanted: Mapping[int, int]
) -> tuple[dict[int, tuple[Any, ...]], tuple[DataFrame, dict[int, int]]]:
    """Keys of the wanted ranks that lie on the smallest or largest key; the rows between and the places wanted there."""
    key = F.struct(*names)
    ends = rows.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    at = lambda row: reduce(lambda a, b: a & b, [F.col(n) == F.lit(row[n]).cast(rows.schema[n].dataType) for n in names])
    low, high = at(ends["low"]), at(ends["high"])
    seen = rows.agg(F.count_if(low).alias("low"), F.count_if(high).alias("high")).first()
    first_high = max(count - seen["high"], 0)
    found, between = {}, {}
    for rank, place in wanted.items():
        if place < seen["low"] or place >= first_high:
            if place not in (0, first_high):
                raise ValueError(NOT_TOTAL.format(list(order_by), rank))
            found[rank] = tuple(ends["low" if place < seen["low"] else "high"])
        else:
            between[rank] = place - seen["low"]
    return found, (rows.where(~low & ~high), between)


def _dealt(rows: DataFrame, names: list[str]) -> tuple[DataFrame, dict[int, int]]:
    """Rows with the number of their range of the order, and the rows of each range."""
    ranges = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(rows.repartitionByRange(ranges, *names).withColumn("range", F.spark_partition_id()))
    return dealt, {r["range"]: r["count"] for r in dealt.groupBy("range").count().collect()}


def _range_of(sizes: Mapping[int, int], place: int) -> tuple[int, int]:
    """The range that holds the row at a place, and its place there."""
    for part in sorted(sizes):
        if place < sizes[part]:
            return part, place
        place -= sizes[part]
    raise IndexError(place)


def _is_number(df: DataFrame, column: str) -> bool:
    """Whether the sketch takes the column."""
    return isinstance(df.schema[column].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))


def _cuts(
    df: DataFrame, order_by: Sequence[str], ranks: Sequence[int], look: Look | None, one_task_rows: int
) -> list[tuple[Any, ...]]:
    if not _is_number(df, order_by[0]):
        return _range_cuts(df, order_by, ranks, one_task_rows)
    series = _ordered(df, order_by[0])
    spots = [Spot.at(rank) for rank in ranks]
    [found] = select_ranks(series, look or first_look(series, ["k"]), spots, ["k"], one_task_rows).collect()
    return [
        _numeric_cut(df, order_by, rank, (row["v0"], row["ties"], row["before"]), one_task_rows)
        for rank, row in zip(ranks, found["spots"])
    ]


def _ordered(df: DataFrame, column: str) -> DataFrame:
    """An order column as the one series ``k`` = 0."""
    one = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col(column).alias("x"))))
    return df.select(one.alias("pair")).select("pair.*")


def fold_starts(n: int, folds: int) -> list[int]:
    """0-based first rank of each fold but the first; the first n mod k folds hold one more."""
    size, extra = divmod(n, folds)
    return [i * size + min(i, extra) for i in range(1, folds)]


def fold_cuts(
    df: DataFrame, order_by: Sequence[str], folds: int, one_task_rows: int = ONE_TASK_ROWS
) -> list[tuple[Any, ...]]:
    """Order-key values at which the second and later folds begin.

    The order columns hold no nulls and order the rows totally.  Numbers, dates and timestamps are
    bracketed; any other type, first or as a tie-breaker, is found by ranges, at any size.
    """
    look = n = None
    void = [F.count_if(F.col(c).isNull()).alias(f"void{i}") for i, c in enumerate(order_by)]
    if _is_number(df, order_by[0]):
        seen = df.agg(F.count(F.lit(1)).alias("n"), *void, _sketch(F.col(order_by[0])).alias("grid"))
        table = written(seen.select(F.lit(0).alias("k"), "*"))
        counts = table.drop("grid").first()
        look = Look(table.select("k", "n", "grid"), 1, counts["n"])
    else:
        counts = df.agg(F.count(F.lit(1)).alias("n"), *void).first()
    for i, column in enumerate(order_by):
        if counts[f"void{i}"]:
            raise ValueError(f"order column {column} holds {counts[f'void{i}']} nulls")
    n = counts["n"]
    starts = [s for s in fold_starts(n, folds) if s < n]
    return _cuts(df, order_by, starts, look, one_task_rows) if starts else []


def contiguous_folds(
    df: DataFrame,
    order_by: Sequence[str],
    folds: int = 5,
    name: str = "fold",
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Number contiguous, equally sized blocks of the declared order, from 0.

    Only the block starts are looked up; rows then compare themselves with them, so the table is
    neither sorted nor shuffled.
    """
    fold = F.lit(0)
    for cut in fold_cuts(df, order_by, folds, one_task_rows):
        columns = order_by[: len(cut)]
        here = F.struct(*[F.col(c) for c in columns])
        there = F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(columns, cut)])
        fold = fold + (here >= there).cast("int")
    return df.withColumn(name, fold)
