"""How a long table of (symbol, date) rows is laid out for ordered computations.

No task ever sorts a whole symbol.  Two bounded groups are used instead:

* a *year* of one symbol: (symbol, date) is unique, so it has at most 366 rows.  Everything that
  runs from the first row of a series (row numbers, on-balance volume, exponential means, forward
  fill) is computed inside the year and completed with a carry-in from a small table that has one
  row per (symbol, year);
* a *block* of ``BLOCK_ROWS`` consecutive rows of one symbol plus the neighbouring rows that its
  window frames reach into.  All bounded frames are computed inside blocks, so a very long series is
  spread over many tasks and each row is copied at most ``1 + reach / BLOCK_ROWS`` times.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from itertools import zip_longest

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.sinks import staged

BLOCK_ROWS = 2048

_YEAR = "_year"
_BLOCK = "_block"


class Frames:
    """Window specifications inside one block."""

    def __init__(self, *keys: str, order: str = "pos"):
        self.order = Window.partitionBy(*keys).orderBy(order)

    def last(self, rows: int):
        """The current row and the ``rows - 1`` rows before it."""
        return self.order.rowsBetween(1 - rows, 0)

    def so_far(self):
        """All rows of the block up to the current one."""
        return self.order.rowsBetween(Window.unboundedPreceding, 0)


def years(*keys: str):
    """Window over the yearly summary rows of one symbol."""
    return Window.partitionBy(*keys).orderBy(_YEAR)


def by_year(df: DataFrame) -> DataFrame:
    return df.withColumn(_YEAR, F.year("date"))


def join_year_summary(df: DataFrame, summary: DataFrame) -> DataFrame:
    """Bring per-(symbol, year) values back to the rows; the size of the summary decides the join."""
    return df.join(summary, ["symbol", _YEAR])


def in_year():
    return Window.partitionBy("symbol", _YEAR).orderBy("date")


def so_far():
    return in_year().rowsBetween(Window.unboundedPreceding, 0)


def sizes_before(summary: DataFrame, size: str = "_n") -> DataFrame:
    """Add the number of rows in earlier years and in the whole series to a yearly summary."""
    earlier = years("symbol").rowsBetween(Window.unboundedPreceding, -1)
    return summary.withColumns(
        {
            "_before": F.coalesce(F.sum(size).over(earlier), F.lit(0)),
            "n_rows": F.sum(size).over(Window.partitionBy("symbol")),
        }
    )


def with_positions(df: DataFrame) -> DataFrame:
    """Add ``pos`` (1 for the first row of a symbol) and ``n_rows`` (rows of the symbol)."""
    rows = by_year(df)
    sizes = rows.groupBy("symbol", _YEAR).agg(F.count(F.lit(1)).alias("_n"))
    return (
        join_year_summary(rows, sizes_before(sizes).drop("_n"))
        .withColumn("pos", F.col("_before") + F.row_number().over(in_year()))
        .drop("_before", _YEAR)
    )


def without_positions(df: DataFrame) -> DataFrame:
    return df.drop("pos", "n_rows")


def laid_out(bars: DataFrame, name: str = "bars") -> DataFrame:
    """Bars stored once, year by year of each symbol in order of date, with ``pos`` and ``n_rows``.

    The source is read once.  Operators find the positions in the table: a side table of one row per
    (symbol, year), made from two narrow columns, completes the places inside the year, and nothing is
    shuffled again for them.  A date that a symbol has twice is an error.
    """
    rows = by_year(bars).withColumns(
        {
            "_place": F.row_number().over(in_year()),
            "_twice": F.coalesce(F.lag("date").over(in_year()) == F.col("date"), F.lit(False)),
        }
    )
    stored = staged(rows, name)
    sizes = stored.groupBy("symbol", _YEAR).agg(
        F.max("_place").cast("long").alias("_n"), F.count_if(F.col("_twice")).alias("_twice")
    )
    sizes = staged(sizes, f"{name}-years")
    if not sizes.filter(F.col("_twice") > 0).isEmpty():
        raise ValueError("a symbol has two bars of one date")
    placed = join_year_summary(stored.drop("_twice"), sizes_before(sizes.drop("_twice")).drop("_n"))
    return placed.withColumn("pos", F.col("_before") + F.col("_place")).drop("_before", "_place", _YEAR)


def over_blocks(
    df: DataFrame,
    stages: Callable[[Frames], list[dict[str, Column]]],
    back: int,
    ahead: int = 0,
    block_rows: int | None = None,
) -> DataFrame:
    """Add window columns in blocks that also hold ``back`` rows before and ``ahead`` rows after.

    ``stages(frames)`` lists the columns to add; each stage may read the columns of earlier ones.
    Columns whose name starts with an underscore are dropped at the end.
    """
    keep = "pos" in df.columns
    rows = df if keep else with_positions(df)
    size = F.lit(block_rows or BLOCK_ROWS)

    def block_of(row: Column) -> Column:
        return F.floor(row / size)

    index = F.col("pos") - 1
    first = block_of(F.greatest(index - ahead, F.lit(0)))
    last = block_of(F.least(index + back, F.col("n_rows") - 1))
    done = rows.withColumn(_BLOCK, F.explode(F.sequence(first, last)))
    # The shuffle that the windows need anyway; naming it keeps blocks of one symbol apart even where
    # an earlier join has already brought each symbol into one task.
    done = done.repartition("symbol", _BLOCK)
    for columns in stages(Frames("symbol", _BLOCK)):
        done = done.withColumns(columns)
    done = done.filter(block_of(index) == F.col(_BLOCK))
    helpers = [c for c in done.columns if c.startswith("_")]
    done = done.drop(*helpers)
    return done if keep else without_positions(done)


def merged(lists: list[list[dict[str, Column]]]) -> list[dict[str, Column]]:
    """Stages of several operators as one list; a column that two of them need is computed once."""
    out, known = [], set()
    for stage in zip_longest(*lists, fillvalue={}):
        columns = {n: c for part in stage for n, c in part.items() if n not in known}
        known |= columns.keys()
        out.append(columns)
    return out


def windowed(back, ahead=0):
    """Turn ``stages(frames, ...)`` into ``operator(bars, ...)`` that runs them over blocks.

    ``back`` and ``ahead`` are row counts, or functions of the operator's keyword arguments.
    """

    def wrap(stages):
        def reach(rule, kwargs):
            return rule(**kwargs) if callable(rule) else rule

        @wraps(stages)
        def operator(bars: DataFrame, *, block_rows: int | None = None, **kwargs) -> DataFrame:
            return in_one_pass(bars, [(operator, kwargs)], block_rows)

        operator.stages = stages
        operator.back = lambda **kwargs: reach(back, kwargs)
        operator.ahead = lambda **kwargs: reach(ahead, kwargs)
        return operator

    return wrap


def in_one_pass(bars: DataFrame, operators, block_rows: int | None = None) -> DataFrame:
    """Run several windowed operators, each with its keyword arguments, in one pass over the blocks."""
    return over_blocks(
        bars,
        lambda frames: merged([op.stages(frames, **kwargs) for op, kwargs in operators]),
        max(op.back(**kwargs) for op, kwargs in operators),
        max(op.ahead(**kwargs) for op, kwargs in operators),
        block_rows,
    )
