"""Sums and distinct counts over ranges of a clock, and sums of all that came
before, in linear time and with hot keys split.

A sliding frame sums its whole range anew for every row, and a window that is
keyed by a hot key is one task.

``in_range`` sweeps instead: a row's number holds from its clock until it leaves
the range, so what holds at a clock is a running sum of what comes and goes.  The
clock is cut in cells as wide as the longest range.  What holds across the edge
of a cell is added anew at the start of the next, so every (key, cell) stands
alone and a hot key is as many groups as ranges fit into its time.  Of an item's
rows in a stretch of one range only the first and last matter, as it holds
throughout between them; these are found by aggregation, so an item that fills
its key is a few rows.

``sums_before`` and ``value_before`` look back without bound, in two levels: the
sums of all cells of a key before a row's are a small table, the rest is a
window inside the cell.  Cells are as many as their width fits into the time of
the data, so they grow with it.  Where many rows share a clock (dates), ``ties``
cuts the rows of one clock value by the tie instead.

Rows without a clock are in no range, and neither precede nor follow others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600 * 1_000_000


@dataclass(frozen=True)
class Measure:
    """Over the rows of a key whose clock is at most ``span`` before a row's
    (its peers included): the sum of a number, or, of an item, how many distinct
    ones.  Numbers must be whole or decimal, so that what is taken away is what
    was added."""

    span: int
    number: Column | None = None
    item: str | None = None


def exact(value: Column) -> Column:
    """A double as a decimal of 15 places."""
    return value.cast("decimal(28,15)")


def _cell_of(at: Column, width: int) -> Column:
    """Whole cells of this width before a clock; exact, below zero too."""
    return ((at - F.pmod(at, F.lit(width))) / width).cast("long")


def in_range(df: DataFrame, keys: list[str], measures: dict[str, Measure], us: str = "us") -> DataFrame:
    """df with a column for each measure; rows without a clock are left out."""
    rows = df.filter(F.col(us).isNotNull())
    width = max(m.span for m in measures.values()) + 1
    numbers = {n: m for n, m in measures.items() if m.item is None}
    kinds = dict(rows.select(*[m.number.alias(n) for n, m in numbers.items()]).dtypes)
    kinds |= {n: "bigint" for n in measures if n not in numbers}
    kept = [c for c in df.columns if c not in keys]

    def moving(rows: DataFrame, events: list[tuple[Column, Column, dict[str, Column]]], row: Column | None) -> DataFrame:
        """Every row once for each event (cell, clock, what comes or goes); the
        first one carries the row itself.  Cases of a number, as an array of
        whole events would make code too long to be compiled."""

        def case(values: list[Column | None], kind: str) -> Column:
            out = F.lit(None).cast(kind)
            for k, v in reversed(list(enumerate(values))):
                out = out if v is None else F.when(F.col("_k") == k, v.cast(kind)).otherwise(out)
            return out

        numbered = rows.withColumn("_k", F.explode(F.array(*map(F.lit, range(len(events))))))
        return numbered.select(
            *keys, case([e[0] for e in events], "bigint").alias("_cell"), case([e[1] for e in events], "bigint").alias("_at"),
            *[case([e[2].get(n) for e in events], kinds[n]).alias(n) for n in measures],
            *([] if row is None else [F.when(F.col("_k") == 0, row).alias("_row")]),
        )

    def carried(began: Column, ends: Column, deltas: dict[str, Column], cells: int) -> list[tuple[Column, Column, dict[str, Column]]]:
        """What holds at the start of each later cell, so many at most, and what
        goes at the end."""
        first, last = _cell_of(began, width), _cell_of(ends, width)
        later = [(first + k, (first + k) * width, {n: F.when(first + k <= last, d) for n, d in deltas.items()}) for k in range(1, cells)]
        return [*later, (last, ends, {n: -d for n, d in deltas.items()})]

    def comes(at: Column, deltas: dict[str, Column]) -> tuple[Column, Column, dict[str, Column]]:
        return _cell_of(at, width), at, deltas

    # a row comes with its numbers and stays to be returned; no range is wider than a cell
    plain = rows.withColumns({f"_number {n}": m.number for n, m in numbers.items()})
    own = {n: F.col(f"_number {n}") for n in numbers}
    events = [comes(F.col(us), own)]
    for span in sorted({m.span for m in numbers.values()}):
        events += carried(F.col(us), F.col(us) + span + 1, {n: own[n] for n, m in numbers.items() if m.span == span}, 2)
    moves = [moving(plain, events, F.struct(*[F.col(c) for c in kept]))]
    for n, m in measures.items():
        if m.item is None:
            continue
        stretch = _cell_of(F.col(us), m.span + 1)
        met = rows.filter(F.col(m.item).isNotNull()).groupBy(*keys, F.col(m.item).alias("_item"), stretch.alias("_stretch")).agg(F.min(us).alias("_first"), F.max(us).alias("_last"))
        after = F.lead("_first").over(Window.partitionBy(*keys, "_item").orderBy("_stretch"))
        # the item's next stretch takes over, or nobody does; both are two cells wide at most
        met = met.withColumn("_ends", F.least(F.col("_last") + m.span + 1, after))
        one = {n: F.lit(1)}
        moves.append(moving(met, [comes(F.col("_first"), one), *carried(F.col("_first"), F.col("_ends"), one, 3)], None))
    upto = Window.partitionBy(*keys, "_cell").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    swept = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), moves).withColumns({n: F.coalesce(F.sum(n).over(upto), F.lit(0)) for n in measures}).filter("_row is not null")
    return swept.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns], *measures)


_PLACE = ["_cell", "_part"]


def _placed(df: DataFrame, us: str, tie: str, width: int, ties: int | None) -> DataFrame:
    """df with its place: rows in an earlier (cell, part) come before those in a
    later one in order of (clock, tie)."""
    zero = F.lit(0).cast("long")
    if ties is None:
        return df.withColumns({"_cell": _cell_of(F.col(us), width), "_part": zero})
    return df.withColumns({"_cell": F.col(us).cast("long"), "_part": _cell_of(F.col(tie), ties)})


def sums_before(df: DataFrame, keys: list[str], sums: dict[str, Column], us: str = "us", tie: str = "event_id", width: int = HOUR, ties: int | None = None) -> DataFrame:
    """df with sums over the rows of the key before each, in order of (clock,
    tie); 0 where there is none.  No keys: over all rows, whose cells are then
    ordered in one task, one row a cell."""
    rows = df.withColumns({f"_value {name}": value for name, value in sums.items()})
    cut = _placed(rows, us, tie, width, ties)
    inside = Window.partitionBy(*keys, *_PLACE).orderBy(us, tie).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy(*_PLACE).rowsBetween(Window.unboundedPreceding, -1)
    by_cell = cut.groupBy(*keys, *_PLACE).agg(*[F.sum(f"_value {name}").alias(name) for name in sums])
    bases = by_cell.select(*[F.col(k).alias(f"_key {k}") for k in keys], *[F.col(c).alias(f"_of{c}") for c in _PLACE], *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_base {name}") for name in sums])
    out = cut.withColumns({name: F.coalesce(F.sum(f"_value {name}").over(inside), F.lit(0)) for name in sums})
    out = out.join(bases, _same(keys))
    return out.select(*df.columns, *[(F.col(name) + F.col(f"_base {name}")).alias(name) for name in sums])


def _same(keys: list[str]) -> Column:
    place = [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in _PLACE]
    return reduce(Column.__and__, [*[F.col(k).eqNullSafe(F.col(f"_key {k}")) for k in keys], *place])


def value_before(df: DataFrame, keys: list[str], column: str, name: str, us: str = "us", tie: str = "event_id", width: int = HOUR, ties: int | None = None) -> DataFrame:
    """df with the value of a column in the row of the key before each."""
    cut = _placed(df, us, tie, width, ties)
    # wrapped, as a null value is not a missing row
    inside = F.lag(F.struct(column)).over(Window.partitionBy(*keys, *_PLACE).orderBy(us, tie))
    last = cut.groupBy(*keys, *_PLACE).agg(F.max_by(F.struct(column), F.struct(us, tie)).alias("_last"))
    before = F.lag("_last").over(Window.partitionBy(*keys).orderBy(*_PLACE))
    bases = last.select(*[F.col(k).alias(f"_key {k}") for k in keys], *[F.col(c).alias(f"_of{c}") for c in _PLACE], before.alias("_before"))
    out = cut.withColumn("_lag", inside).join(bases, _same(keys))
    return out.select(*df.columns, F.coalesce("_lag", "_before")[column].alias(name))
