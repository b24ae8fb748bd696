"""Ordered per-entity work that survives an entity holding a large share of all rows.

A window function puts every row of one partition key into one task. Here entities are counted first. When
none has more than ``max_rows`` rows, the plan is the plain window. Otherwise such heavy entities are cut along
their order into pieces of about ``max_rows`` rows; windows run per (entity, piece), and what crosses a
piece border (the running maximum so far, the last known value, the count so far, the next row) is carried by a
small table with one row per piece.

* Counting is one map-side-combined pass over the keys. ``sized_by`` lets a caller count the raw
  rows an expensive frame was derived from, which bound its own rows.
* Borders are places (order value and tie-break columns together) taken at equal steps from a sample of a heavy key's different
  places, chosen by their hash. So they follow the density of the values, whatever their type, and crowds of null, infinite
  or tied order values are cut along the tie-break. Places compare as in a window: nulls first, NaN last.
* A level makes at most ``FAN`` pieces of a key, from at most about ``FAN * SAMPLED`` places. Pieces above twice ``max_rows`` are cut again,
  unless all their rows have one place: such rows have no order, and a window would not tell them apart either.
* The hash makes borders the same in every run. They are written to the shared folder, once, and read back by the plans
  that need them; they have at most 2 N / max_rows entries, and Spark decides by size whether to broadcast them.
* Rows with equal places always share a piece. Without ``ties`` peers are therefore never separated.
* The shuffle on (entity, piece) is asked for explicitly. A frame that arrives partitioned by entity alone,
  say from a join, would satisfy the window too and leave a heavy entity in one task.

Null keys form a group of their own, as in a window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import takewhile

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from bedside.sources.shared import keep_in, shared_folder

PIECE = "__piece"
MAX_ROWS = 1_000_000
#: Pieces a level makes of a key at most, sampled places per piece, borders compared at once, levels.
FAN, SAMPLED, CHUNK, LEVELS = 256, 32, 16, 7
_LEVEL_BITS = FAN.bit_length() - 1
_HASHES = 1 << 40


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def present(*columns: str) -> Column:
    """All given columns are known, in a form that reaches the scan."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Pieces:
    """Rows of a frame with the partitioning their windows should use."""

    rows: DataFrame
    keys: tuple[str, ...]
    cut: bool

    @property
    def by(self) -> tuple[str, ...]:
        return (*self.keys, PIECE) if self.cut else self.keys

    def window(self, *order: str | Column) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*order)

    def with_column(self, name: str, column: Column) -> Pieces:
        return replace(self, rows=self.rows.withColumn(name, column))

    def carry(
        self,
        per_piece: dict[str, Column],
        over_pieces: Callable[[WindowSpec], dict[str, Column]],
        spread: bool = True,
    ) -> Pieces:
        """Add to each row what the other pieces of its key hold, null for keys that are not cut.

        ``per_piece`` are aggregates of one piece; ``over_pieces`` gets the window of a key's pieces in order.
        ``spread=False`` says the rows already are partitioned by (key, piece), by an earlier carry.
        """
        w = Window.partitionBy(*self.keys).orderBy(PIECE)
        carried = over_pieces(w)
        if not self.cut:
            return replace(self, rows=self.rows.withColumns({name: F.lit(None) for name in carried}))
        held = self.rows.filter(F.col(PIECE).isNotNull()).groupBy(*self.by)
        held = held.agg(*[c.alias(name) for name, c in per_piece.items()])
        held = held.select(*self.by, *[c.alias(name) for name, c in carried.items()])
        rows = self.rows.repartition(*self.by) if spread else self.rows
        return replace(self, rows=_lookup(rows, held, self.by))

    def result(self, *columns: str | Column) -> DataFrame:
        """The rows without the bookkeeping, or the given columns."""
        return self.rows.select(*columns) if columns else self.rows.drop(PIECE)


def cut_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Column,
    max_rows: int | None = MAX_ROWS,
    sized_by: DataFrame | None = None,
    ties: Sequence[str | Column] = (),
) -> Pieces:
    """Cut the heavy keys of ``df`` along ``order`` and ``ties``; ``sized_by`` has the same keys and order to measure instead.

    Only ties that are given by name, ascending, and that ``sized_by`` has as well, help to cut.
    Without ``max_rows`` no key is heavy and nothing is counted.
    """
    keys = tuple(keys)
    if max_rows is None:
        return Pieces(df, keys, False)
    sized = df if sized_by is None else sized_by
    counts = sized.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > max_rows)
    if counts.isEmpty():
        return Pieces(df, keys, False)

    usable = takewhile(lambda t: isinstance(t, str) and t in sized.columns, ties)
    place = F.struct(*[_col(c).alias(f"c{i}") for i, c in enumerate((order, *usable))])
    keep = keep_in(shared_folder(df.sparkSession))
    heavy = keep("heavy", counts)
    rows = _lookup(sized, heavy, keys).filter(F.col("__n").isNotNull()).drop("__n")
    out, by, level = df, keys, 0
    while level < LEVELS:
        full = keep(f"full_{level}", _full(rows, by, place, max_rows if level == 0 else 2 * max_rows))
        if full.isEmpty():
            break
        borders = keep(f"borders_{level}", _borders(rows, by, place, full, max_rows, level))
        out, rows = (_numbered(part, by, place, borders, level) for part in (out, rows))
        by, level = (*keys, PIECE), level + 1
    return Pieces(out, keys, level > 0)


def limit_for(sized: DataFrame, keys: Sequence[str], max_rows: int | None = MAX_ROWS) -> int | None:
    """``max_rows`` if some key of ``sized`` has more rows, else None: one count for several steps on these keys.

    Finer keys, and frames derived from these rows, are covered too.
    """
    if max_rows is None:
        return None
    heavy = sized.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > max_rows)
    return None if heavy.isEmpty() else max_rows


def _full(rows: DataFrame, by: Sequence[str], place: Column, limit: int) -> DataFrame:
    """Rows and different places of every group with more than ``limit`` rows that can be cut."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.approx_count_distinct(place).alias("__places"))
    return sizes.filter((F.col("__n") > limit) & (F.col("__places") > 1))


def _borders(rows: DataFrame, by: Sequence[str], place: Column, full: DataFrame, max_rows: int, level: int) -> DataFrame:
    """For every full group its borders in chunks, ascending; a border is the first place of a piece."""
    pieces = F.least(F.ceil(F.col("__n") / F.lit(max_rows)), F.lit(FAN)).cast("int")
    share = F.least(pieces * F.lit(SAMPLED) / F.col("__places"), F.lit(1.0))
    drawn = F.pmod(F.xxhash64(place, F.lit(level)), F.lit(_HASHES)) < share * F.lit(_HASHES)
    sample = _lookup(rows, full, by).filter(F.col("__n").isNotNull() & drawn)
    sample = sample.groupBy(*by).agg(F.first("__n").alias("__n"), F.sort_array(F.collect_set(place)).alias("__sample"))
    steps = F.sequence(F.lit(1), pieces - 1)
    taken = F.transform(steps, lambda i: F.get("__sample", F.floor(i * F.size("__sample") / pieces).cast("int")))
    borders = sample.select(*by, F.array_distinct(taken).alias("__b"))
    chunks = F.sequence(F.lit(0), F.floor((F.size("__b") - 1) / CHUNK).cast("int"))
    return borders.select(*by, F.transform(chunks, lambda c: F.slice("__b", c * CHUNK + 1, F.lit(CHUNK))).alias("__borders"))


def _numbered(rows: DataFrame, by: Sequence[str], place: Column, borders: DataFrame, level: int) -> DataFrame:
    """``rows`` with the piece each lies in; pieces of earlier levels keep their order."""
    upto = lambda places: F.size(F.filter(places, lambda b: b <= place))
    chunk = upto(F.transform("__borders", lambda c: F.get(c, F.lit(0))))
    inner = F.when(chunk > 0, (chunk - 1) * CHUNK + upto(F.get("__borders", chunk - 1))).otherwise(0)
    inner = F.when(F.col("__borders").isNotNull(), inner).cast("long")
    if level:
        inner = F.shiftleft(F.col(PIECE), _LEVEL_BITS) + F.coalesce(inner, F.lit(0))
    return _lookup(rows, borders, by).withColumn(PIECE, inner).drop("__borders")


def _lookup(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left lookup in a table of heavy keys or their pieces, matching null keys too."""
    renamed = small.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return df.join(renamed, match, "left").drop(*[f"__k_{k}" for k in keys])


def add_row_number(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Column,
    ties: Sequence[str | Column],
    name: str,
    max_rows: int | None = MAX_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """``row_number`` over ``keys`` by ``order`` then ``ties`` (BIGINT, from 1); global without keys."""
    cut = cut_rows(df, keys, order, max_rows, sized_by, ties)
    cut = cut.carry({"__n": F.count(F.lit(1))}, lambda w: {"__seen": F.sum("__n").over(before(w))})
    number = F.row_number().over(cut.window(_col(order), *ties)).cast("long")
    return cut.with_column(name, number + F.coalesce("__seen", F.lit(0))).result().drop("__seen")


def add_running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Column,
    sums: dict[str, str],
    max_rows: int | None = MAX_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Inclusive running sums ``{output: input}`` along ``order``, whose values are unique per key."""
    cut = cut_rows(df, keys, order, max_rows, sized_by)
    cut = cut.carry(
        {f"__s_{out}": F.sum(src) for out, src in sums.items()},
        lambda w: {f"__c_{out}": F.sum(f"__s_{out}").over(before(w)) for out in sums},
    )
    w = upto(cut.window(_col(order)))
    for out, src in sums.items():
        cut = cut.with_column(out, F.sum(src).over(w) + F.coalesce(f"__c_{out}", F.lit(0)))
    return cut.result().drop(*[f"__c_{out}" for out in sums])


def add_next(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: dict[str, str],
    ties: Sequence[str] = (),
    max_rows: int | None = MAX_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Values ``{output: input}`` of the following row, null on the last one."""
    return _add_neighbour(df, keys, order, columns, ties, max_rows, sized_by, F.min_by, F.lead)


def add_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: dict[str, str],
    ties: Sequence[str] = (),
    max_rows: int | None = MAX_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Values ``{output: input}`` of the preceding row, null on the first one."""
    return _add_neighbour(df, keys, order, columns, ties, max_rows, sized_by, F.max_by, F.lag)


def _add_neighbour(df, keys, order, columns, ties, max_rows, sized_by, edge, move) -> DataFrame:
    """``edge`` picks the row of a piece its neighbour piece looks at, ``move`` steps to the neighbour."""
    row = F.struct(*[F.col(src).alias(out) for out, src in columns.items()])
    place = F.struct(F.col(order), *[F.col(t) for t in ties])
    cut = cut_rows(df, keys, order, max_rows, sized_by, ties)
    cut = cut.carry({"__edge": edge(row, place)}, lambda w: {"__edge": move("__edge").over(w)})
    cut = cut.with_column("__near", F.coalesce(move(row).over(cut.window(order, *ties)), F.col("__edge")))
    return cut.result(*df.columns, *[F.col(f"__near.{out}").alias(out) for out in columns])
