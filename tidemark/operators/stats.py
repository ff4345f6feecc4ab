"""Descriptive statistics per symbol: profile, moments, histogram, quantile plot, correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.fixed import NORMAL_CENTRE, NORMAL_FAR, NORMAL_TAIL, VALUE_COLUMNS
from tidemark.functions.numeric import sample_kurtosis, sample_skewness
from tidemark.operators.candles import daily_return
from tidemark.sources.sinks import staged


def percent_returns(bars: DataFrame) -> DataFrame:
    """Daily change of the close in percent, without the first row of each symbol."""
    rows = daily_return(bars).withColumn("ret_pct", F.col("Daily_Return") * 100)
    return rows.select("symbol", "date", "ret_pct").dropna(subset=["ret_pct"])


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(keys, columns, name, value)


# ---- profile and completeness ----------------------------------------------------------------


def profile(bars: DataFrame) -> DataFrame:
    """First and last date, row count and column count of each symbol."""
    columns = len([c for c in bars.columns if c not in ("symbol", "date")])
    return bars.groupBy("symbol").agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("n_bars"),
        F.lit(columns).alias("n_columns"),
    )


def column_types(df: DataFrame) -> DataFrame:
    """Name, position and type of every column, derived from the schema of the table."""
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.lit(t).alias("type"))
        for i, (n, t) in enumerate(df.dtypes)
    ]
    one = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return one.select(F.inline(F.array(*entries)), "n_rows")


def missing_counts(df: DataFrame, columns=None) -> DataFrame:
    """Number of NULLs in each column of each symbol."""
    columns = columns or VALUE_COLUMNS
    counts = df.groupBy("symbol").agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return unpivot(counts, ["symbol"], columns, "column", "missing")


def completeness(df: DataFrame, columns=None) -> DataFrame:
    """Percent of filled cells of each symbol."""
    columns = columns or VALUE_COLUMNS
    gaps = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))
    cells = F.count(F.lit(1)) * len(columns)
    return df.groupBy("symbol").agg(((1 - F.try_divide(gaps, cells)) * 100).alias("completeness"))


def head(bars: DataFrame, rows: int = 5) -> DataFrame:
    """The first rows of each symbol: a bounded top-k aggregate, no sort of the series."""
    values = [c for c in bars.columns if c != "symbol"]
    firsts = F.array_sort(F.collect_list(F.struct("date", *[c for c in values if c != "date"])))
    # Per year at most 366 rows meet; of each year only the first ``rows`` go on.
    per_year = bars.groupBy("symbol", F.year("date").alias("_year")).agg(
        F.slice(firsts, 1, rows).alias("_rows")
    )
    earliest = F.slice(F.array_sort(F.flatten(F.collect_list("_rows"))), 1, rows)
    return per_year.groupBy("symbol").agg(earliest.alias("_rows")).select("symbol", F.inline("_rows"))


def describe(df: DataFrame, columns=None) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles (interpolated) and maximum of each column.

    Quartiles come from exact ranks, so no task holds the values of a whole column of a symbol.
    """
    columns = columns or VALUE_COLUMNS
    long = unpivot(df.select("symbol", "date", *columns), ["symbol", "date"], columns, "column", "v")
    keyed = long.dropna(subset=["v"]).withColumn("key", F.struct("symbol", "column"))
    ranked = with_rank(keyed.select("key", "date", "v"), "v", "key")

    def quantile(share):
        place = (F.col("n_ranked") - 1) * share
        below = F.floor(place)
        weight = F.when(F.col("rank") - 1 == below, 1 - (place - below)).when(
            F.col("rank") - 1 == below + 1, place - below
        )
        return F.sum(F.col("v") * F.coalesce(weight, F.lit(0.0)))

    rows = ranked.groupBy("key").agg(
        F.count("v").alias("count"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        quantile(0.25).alias("q25"),
        quantile(0.5).alias("q50"),
        quantile(0.75).alias("q75"),
        F.max("v").alias("max"),
    )
    return rows.select("key.symbol", "key.column", *[c for c in rows.columns if c != "key"])


# ---- returns -----------------------------------------------------------------------------------


def moments(returns: DataFrame, value: str = "ret_pct") -> DataFrame:
    """Mean, deviation, bias-corrected skewness and excess kurtosis, with their reading."""
    out = returns.groupBy("symbol").agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        sample_skewness(value).alias("skewness"),
        sample_kurtosis(value).alias("kurtosis"),
    )
    return out.withColumns(
        {
            "skew_label": F.when(F.col("skewness") > 0, "Right-skewed").otherwise("Left-skewed"),
            "tail_label": F.when(F.col("kurtosis") > 3, "Fat tails").otherwise("Normal tails"),
            "shape_label": F.when(
                F.abs("skewness") < 0.5, "Approximately normal"
            ).otherwise("Deviates from normal"),
        }
    )


def histogram(returns: DataFrame, bins: int = 50, value: str = "ret_pct") -> DataFrame:
    """Equal-width bins between minimum and maximum of each symbol; empty bins are kept."""
    limits = returns.groupBy("symbol").agg(
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
    )
    limits = limits.withColumn("_width", (F.col("_max") - F.col("_min")) / bins)
    place = F.floor(F.try_divide(F.col(value) - F.col("_min"), F.col("_width")))
    counts = (
        returns.join(limits.select("symbol", "_min", "_width"), "symbol")
        .groupBy("symbol", F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = limits.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    return frame.join(counts, ["symbol", "bin"], "left").select(
        "symbol",
        "bin",
        (F.col("_min") + F.col("bin") * F.col("_width")).alias("low_edge"),
        F.coalesce("n", F.lit(0)).alias("count"),
        "mean",
        "std",
    )


# ---- ranks and quantile plot -------------------------------------------------------------------

#: Rows that are put in order together, about, and cuts of one step at most.
RANK_ROWS, RANK_CUTS = 4096, 1023


def with_rank(df: DataFrame, value: str, key: str = "symbol", rows: int = RANK_ROWS) -> DataFrame:
    """Position of every row in the ascending order of ``value`` inside its key, and the row count.

    A key of more than ``rows`` rows is cut at approximate quantiles (a mergeable sketch), as many as its
    size asks for; parts that are still too large are cut again, until none is.  Rows are numbered inside
    the parts and the sizes of the lower parts are added, so no task sorts a whole key.  A value that
    many rows share is a cut itself; its rows are numbered year by year, which the calendar bounds.
    """
    kind = "array<struct<below:int,on:boolean,year:int>>"
    placed = df.withColumn("_cut", F.expr(f"cast(array() as {kind})"))
    while True:
        sizes = staged(placed.groupBy(key, "_cut").agg(F.count(F.lit(1)).alias("_n")), "rank-parts")
        last = F.try_element_at("_cut", F.lit(-1))
        full = sizes.filter((F.col("_n") > rows) & ~F.coalesce(last["on"], F.lit(False)))
        most = full.agg(F.max("_n")).first()[0]
        if most is None:
            break
        cuts = min(RANK_CUTS, 2 * -(-most // rows))
        points = F.array(*[F.lit((i + 1) / (cuts + 1)) for i in range(cuts)])
        found = placed.join(full.select(key, "_cut"), [key, "_cut"]).groupBy(key, "_cut")
        found = found.agg(F.coalesce(F.percentile_approx(value, points, 40 * cuts), F.array()).alias("_cuts"))
        placed = placed.join(staged(found, "rank-cuts"), [key, "_cut"], "left")
        # Missing values count as a value that rows share.
        on = F.coalesce(F.array_contains("_cuts", F.col(value)), F.lit(True))
        place = F.struct(
            F.size(F.filter("_cuts", lambda c: c < F.col(value))).alias("below"),
            on.alias("on"),
            F.when(on, F.year("date")).otherwise(0).alias("year"),
        )
        deeper = F.concat("_cut", F.array(place).cast(kind))
        placed = placed.withColumn("_cut", F.when(F.col("_cuts").isNotNull(), deeper).otherwise(F.col("_cut")))
        placed = staged(placed.drop("_cuts"), "ranked")
    order = Window.partitionBy(key).orderBy("_cut")
    lower = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        key,
        "_cut",
        F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_lower"),
        F.sum("_n").over(Window.partitionBy(key)).alias("n_ranked"),
    )
    inside = Window.partitionBy(key, "_cut").orderBy(value, "date")
    ranked = placed.join(offsets, [key, "_cut"])
    return ranked.withColumn("rank", F.col("_lower") + F.row_number().over(inside)).drop("_cut", "_lower")


def _fraction(coefficients, x: Column) -> Column:
    """Quotient of two polynomials, given by their coefficients, lowest power first."""

    def polynomial(values):
        out = F.lit(values[-1])
        for v in values[-2::-1]:
            out = out * x + v
        return out

    return polynomial(coefficients[0]) / polynomial(coefficients[1])


def normal_quantile(p: Column) -> Column:
    """Quantile of the standard normal distribution; NULL outside (0, 1)."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    outer = F.when(r <= 5, _fraction(NORMAL_TAIL, r - 1.6)).otherwise(_fraction(NORMAL_FAR, r - 5))
    out = F.when(F.abs(q) <= 0.425, q * _fraction(NORMAL_CENTRE, 0.180625 - q * q)).otherwise(F.signum(q) * outer)
    return F.when((p > 0) & (p < 1), out)


def plotting_position(rank: Column, n: Column) -> Column:
    """Median of the order statistic of a uniform sample (Filliben's estimate)."""
    last = F.pow(F.lit(0.5), F.lit(1.0) / n)
    return (
        F.when(rank == n, last)
        .when(rank == 1, 1 - last)
        .otherwise((rank - 0.3175) / (n + 0.365))
    )


def quantile_plot(returns: DataFrame, value: str = "ret_pct") -> DataFrame:
    """Ordered values against normal quantiles."""
    ranked = with_rank(returns, value)
    position = plotting_position(F.col("rank"), F.col("n_ranked").cast("double"))
    return ranked.select(
        "symbol",
        "rank",
        F.col(value).alias("ordered"),
        position.alias("position"),
        normal_quantile(position).alias("theoretical"),
    )


def quantile_line(points: DataFrame) -> DataFrame:
    """Least-squares line through a quantile plot."""
    return points.groupBy("symbol").agg(
        F.regr_slope("ordered", "theoretical").alias("slope"),
        F.regr_intercept("ordered", "theoretical").alias("intercept"),
        F.corr("ordered", "theoretical").alias("r"),
    )


# ---- correlation -------------------------------------------------------------------------------


def target_correlations(features: DataFrame, names: list[str], target: str = "Target") -> DataFrame:
    """Absolute correlation of every feature with the label, from one aggregate over the rows."""
    wide = features.groupBy("symbol").agg(*[F.abs(F.corr(c, target)).alias(c) for c in names])
    return unpivot(wide, ["symbol"], names, "feature", "abs_corr")


def top_correlations(features: DataFrame, names: list[str], top: int = 30) -> DataFrame:
    """The features with the highest absolute correlation with the label."""
    # Features that are multiples of each other tie up to rounding noise; the name decides then.
    strength = F.round("abs_corr", 9).desc_nulls_last()
    order = Window.partitionBy("symbol").orderBy(strength, "feature")
    ranked = target_correlations(features, names).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= top)
