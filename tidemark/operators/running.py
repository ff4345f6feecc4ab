"""Values that depend on the whole history of a series: exponential means, MACD, OBV, forward fill.

They are computed inside each (symbol, year) group and completed with a carry-in.  The carry-ins come
from a summary with one row per (symbol, year), scanned year by year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.fixed import EMA_SPANS, MACD_SPANS
from tidemark.series import _YEAR, by_year, join_year_summary, so_far, without_positions, years


class _Decay:
    """Weights of an exponential mean with the given span: gain ``a`` and decay ``r = 1 - a``.

    The methods return SQL text; ``steps`` and ``rows`` are SQL texts of whole numbers.
    """

    def __init__(self, span: int):
        self.span = span
        self.gain = 2.0 / (span + 1.0)
        self.rate = 1.0 - self.gain

    def power(self, steps: str) -> str:
        return f"pow({self.rate!r}D, {steps})"

    def local(self, value: str) -> str:
        """Mean since the start of the year with nothing carried in; ``_k`` counts from 1."""
        if self.rate == 0.0:
            return value
        scaled = f"sum({value} * pow({self.rate!r}D, -_k)) OVER {_SO_FAR}"
        return f"{self.gain!r}D * {self.power('_k')} * {scaled}"


_IN_YEAR = "(PARTITION BY symbol, _year ORDER BY date)"
_SO_FAR = "(PARTITION BY symbol, _year ORDER BY date ROWS UNBOUNDED PRECEDING)"
_EARLIER = "(PARTITION BY symbol ORDER BY _year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_YEARS = "(PARTITION BY symbol ORDER BY _year)"


def _chained(first: _Decay, second: _Decay, steps: str) -> str:
    """Weight that a value gets ``steps`` rows later after passing both means."""
    if first.rate == second.rate:
        return f"({first.power(steps)} * ({steps} + 1) * {first.gain * second.gain!r}D)"
    scale = first.gain * second.gain / (second.rate - first.rate)
    later = f"{steps} + 1"
    return f"({second.power(later)} - {first.power(later)}) * {scale!r}D"


def _drift(first: _Decay, second: _Decay, rows: str) -> str:
    """What a carry-in of the first mean adds to the second mean after ``rows`` rows."""
    if first.rate == second.rate:
        return f"({first.power(rows)} * {rows} * {second.gain!r}D)"
    scale = second.gain * first.rate / (second.rate - first.rate)
    return f"({second.power(rows)} - {first.power(rows)}) * {scale!r}D"


def _texts(columns: dict[str, str]) -> dict[str, Column]:
    return {name: F.expr(text) for name, text in columns.items()}


def running_columns(
    bars: DataFrame,
    spans=EMA_SPANS,
    macd=None,
    obv: bool = False,
    value: str = "close",
) -> DataFrame:
    """Add EMA_<span>, MACD columns and OBV as asked, with ``pos`` and ``n_rows``, in one pass."""
    means = {span: _Decay(span) for span in spans}
    if macd:
        fast, slow, signal = (_Decay(span) for span in macd)
        for decay in (fast, slow):
            means.setdefault(decay.span, decay)
    moved = (
        f"coalesce(signum({value} - lag({value}) OVER {_IN_YEAR}) * volume, 0D)" if obv else "0D"
    )
    rows = by_year(without_positions(bars))

    # One row per (symbol, year): what this year adds to each running value.
    counted = rows.withColumns(
        _texts(
            {
                "_left": f"count(1) OVER (PARTITION BY symbol, _year) - row_number() OVER {_IN_YEAR}",
                "_move": moved,
            }
        )
    )
    added = {"_n": "count(1)", "_first": f"min_by({value}, date)"}
    for span, decay in means.items():
        added[f"_e{span}"] = f"sum({value} * {decay.power('_left')} * {decay.gain!r}D)"
    if macd:
        weight = f"{_chained(fast, signal, '_left')} - {_chained(slow, signal, '_left')}"
        added["_signal"] = f"sum({value} * ({weight}))"
    if obv:
        added |= {
            "_moved": "sum(_move)",
            "_last": f"max_by({value}, date)",
            "_first_volume": "min_by(volume, date)",
        }
    summary = counted.groupBy("symbol", _YEAR).agg(
        *[column.alias(name) for name, column in _texts(added).items()]
    )

    # Scan the years of each symbol in order; a symbol has one row per calendar year.
    scan = {
        "_before": f"coalesce(sum(_n) OVER {_EARLIER}, 0)",
        "n_rows": "sum(_n) OVER (PARTITION BY symbol)",
    }
    wanted = ["_before", "n_rows"]
    if means:
        state = [f"_e{span}" for span in means] + (["_signal"] if macd else [])
        scan["_history"] = f"collect_list(struct(_n, {', '.join(state)})) OVER {_EARLIER}"
        scan["_start"] = f"first(_first) OVER {_YEARS}"
    if obv:
        step = f"_first - lag(_last) OVER {_YEARS}"
        scan["_gap"] = f"coalesce(signum({step}) * _first_volume, 0D)"
    carried = summary.withColumns(_texts(scan))
    carry = {}
    if means:
        begin = [f"_start AS _e{span}" for span in means] + (["0D AS _signal"] if macd else [])
        grown = [
            f"past._e{span} * {decay.power('year._n')} + year._e{span} AS _e{span}"
            for span, decay in means.items()
        ]
        if macd:
            grown.append(
                f"past._signal * {signal.power('year._n')} + year._signal"
                f" + past._e{fast.span} * {_drift(fast, signal, 'year._n')}"
                f" - past._e{slow.span} * {_drift(slow, signal, 'year._n')} AS _signal"
            )
        carry["_carry"] = (
            f"aggregate(_history, struct({', '.join(begin)}),"
            f" (past, year) -> struct({', '.join(grown)}))"
        )
    if obv:
        carry["_obv_before"] = f"coalesce(sum(_moved + _gap) OVER {_EARLIER}, 0D) + _gap"
    carried = carried.withColumns(_texts(carry)).select("symbol", _YEAR, *wanted, *carry)
    out = join_year_summary(rows, carried)

    # Complete every row with the carry-in of its year.
    out = out.withColumns(_texts({"_k": f"row_number() OVER {_IN_YEAR}", "_move": moved}))
    columns = {"pos": "_before + _k"}
    for span, decay in means.items():
        columns[f"EMA_{span}"] = f"{decay.local(value)} + {decay.power('_k')} * _carry._e{span}"
    if obv:
        columns["OBV"] = f"_obv_before + sum(_move) OVER {_SO_FAR}"
    out = out.withColumns(_texts(columns))
    helpers = ["_k", "_move", "_before", _YEAR, *carry]
    if macd:
        out = out.withColumn("MACD", F.col(f"EMA_{fast.span}") - F.col(f"EMA_{slow.span}"))
        line = f"{signal.local('MACD')} + {signal.power('_k')} * _carry._signal"
        out = out.withColumn("MACD_Signal", F.expr(line))
        out = out.withColumn("MACD_Hist", F.col("MACD") - F.col("MACD_Signal"))
        helpers += [f"EMA_{d.span}" for d in (fast, slow) if d.span not in spans]
    return out.drop(*helpers)


def ema(bars: DataFrame, spans=EMA_SPANS, value: str = "close") -> DataFrame:
    """Exponential mean that starts at the first value, for each span."""
    return running_columns(bars, spans=spans, value=value).drop("pos", "n_rows")


def macd(bars: DataFrame, spans=MACD_SPANS) -> DataFrame:
    """Difference of two exponential means, its own exponential mean, and the gap between them."""
    return running_columns(bars, spans=[], macd=spans).drop("pos", "n_rows")


def obv(bars: DataFrame) -> DataFrame:
    """Running sum of volume signed by the direction of the close."""
    return running_columns(bars, spans=[], obv=True).drop("pos", "n_rows")


def forward_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace NULLs by the last earlier value of the same symbol; leading NULLs stay."""
    rows = by_year(df)
    last_known = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(f"_{c}") for c in columns
    ]
    earlier = years("symbol").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy("symbol", _YEAR)
        .agg(*last_known)
        .select(
            "symbol",
            _YEAR,
            *[F.last(f"_{c}", ignorenulls=True).over(earlier).alias(f"_{c}") for c in columns],
        )
    )
    out = join_year_summary(rows, carried)
    filled = {
        c: F.coalesce(F.last(c, ignorenulls=True).over(so_far()), F.col(f"_{c}")) for c in columns
    }
    return out.withColumns(filled).drop(_YEAR, *[f"_{c}" for c in columns])
