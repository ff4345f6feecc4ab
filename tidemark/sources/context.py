"""Market context series and company facts, and their joins to bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.fixed import (
    COMPANY_NUMBERS,
    COMPANY_TEXT_DEFAULTS,
    RETURN_WHEN_EMPTY,
    VIX_WHEN_EMPTY,
)
from tidemark.functions.numeric import change
from tidemark.operators.running import forward_fill


def read_series(context: DataFrame, series: str, name: str | None = None) -> DataFrame:
    """One context series (date, <name>) from a table (date, series, close)."""
    rows = context.filter(F.col("series") == series)
    return rows.select("date", F.col("close").alias(name or series))


def series_returns(series: DataFrame, column: str, name: str) -> DataFrame:
    """Change of a context series on its own calendar.

    The value before a row comes from its year, or for the first value of a year from a table with one
    row per year.
    """
    rows = series.withColumn("_year", F.year("date"))
    known = rows.filter(F.col(column).isNotNull())
    ends = known.groupBy("_year").agg(F.max_by(column, "date").alias("_end"))
    # Each year with the last value of the latest earlier year that has one.
    earlier = ends.select(F.col("_year").alias("_from"), "_end")
    carried = (
        rows.select("_year").distinct().join(earlier, F.col("_from") < F.col("_year"))
        .groupBy("_year").agg(F.max_by("_end", "_from").alias("_carry"))
    )
    in_year = Window.partitionBy("_year").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.last(column, ignorenulls=True).over(in_year), F.col("_carry"))
    joined = rows.join(carried, "_year", "left")
    return joined.select("date", change(column, before).alias(name))


def join_context(bars: DataFrame, vix: DataFrame, sp500: DataFrame) -> DataFrame:
    """Add VIX (exact date, then filled forward per symbol) and SP500_Return (missing is 0).

    A wholly empty VIX source gives a constant; otherwise leading gaps stay NULL.  Both series are
    reduced to one row per date; Spark chooses the join by their measured size.
    """
    vix = vix.groupBy("date").agg(F.max("VIX").alias("VIX"))
    joined = forward_fill(bars.join(vix, "date", "left"), ["VIX"])
    known = vix.agg(F.count(F.lit(1)).alias("n")).scalar()
    joined = joined.withColumn(
        "VIX", F.when(known == 0, F.lit(VIX_WHEN_EMPTY)).otherwise(F.col("VIX"))
    )
    sp500 = sp500.groupBy("date").agg(F.max("SP500").alias("SP500"))
    returns = series_returns(sp500, "SP500", "SP500_Return")
    joined = joined.join(returns, "date", "left")
    return joined.withColumn(
        "SP500_Return", F.coalesce("SP500_Return", F.lit(RETURN_WHEN_EMPTY))
    ).dropna(how="all", subset=[c for c in joined.columns if c not in ("symbol", "date")])


def orders_context(spark: SparkSession, directory: str) -> DataFrame:
    """Context table from orders: mean order value in cents by day, one series per priority."""
    orders = spark.read.parquet(f"{directory}/orders.parquet")
    named = F.when(F.col("o_orderpriority") == "1-URGENT", "VIX").when(
        F.col("o_orderpriority") == "2-HIGH", "SP500"
    ).otherwise(F.col("o_orderpriority"))
    return (
        orders.groupBy(F.col("o_orderdate").cast("date").alias("date"), named.alias("series"))
        .agg(F.avg(F.floor(F.col("o_totalprice") * 100).cast("double")).alias("close"))
    )


def company_facts(symbols: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts for every symbol; a missing name is the symbol, other missing texts are N/A."""
    have = set(facts.columns)
    columns = [F.coalesce(F.col("longName"), F.col("symbol")).alias("longName")]
    columns += [
        (F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d)).alias(c)
        for c, d in COMPANY_TEXT_DEFAULTS.items()
    ]
    columns += [
        (F.col(c) if c in have else F.lit(None)).cast("double").alias(c) for c in COMPANY_NUMBERS
    ]
    return symbols.select("symbol").join(facts, "symbol", "left").select("symbol", *columns)


def lineitem_facts(spark: SparkSession, directory: str) -> DataFrame:
    """Company facts computed from order lines; returned lines (R) give symbols without facts."""
    lines = spark.read.parquet(f"{directory}/lineitem.parquet")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    cents = F.when(flag != "R", F.floor(F.col("l_extendedprice") * 100).cast("double"))
    units = F.when(flag != "R", F.floor("l_quantity").cast("double"))
    totals = (
        lines.groupBy(flag.alias("flag"), status.alias("status"))
        .agg(
            F.sum(cents).alias("cents"),
            F.sum(units).alias("units"),
            F.max(cents).alias("top"),
            F.min(cents).alias("bottom"),
        )
    )
    mean = F.try_divide("cents", F.col("units") * 100)
    is_open = (F.col("status") == "O") & (F.col("flag") != "R")
    return totals.select(
        F.concat("flag", "status").alias("symbol"),
        F.when(F.col("flag") == "A", F.concat(F.lit("Company "), "flag", "status")).alias("longName"),
        F.when(is_open, "Open orders").alias("sector"),
        F.when(is_open, F.concat(F.lit("Lines "), "flag")).alias("industry"),
        F.when(is_open, "buy").alias("recommendationKey"),
        F.col("cents").alias("marketCap"),
        F.when(is_open, F.try_divide("top", "units")).alias("trailingPE"),
        F.try_divide("top", F.col("bottom")).alias("forwardPE"),
        F.when(F.col("flag") == "N", F.lit(0.0)).otherwise(mean / 1000).alias("priceToBook"),
        F.when(is_open, F.try_divide("bottom", "top")).alias("dividendYield"),
        F.when(is_open, mean / 500).otherwise(F.when(F.col("flag") != "R", 1.0)).alias("beta"),
        (F.col("top") / 100).alias("fiftyTwoWeekHigh"),
        (F.col("bottom") / 100).alias("fiftyTwoWeekLow"),
        F.when(is_open, F.col("units")).alias("averageVolume"),
        mean.alias("currentPrice"),
        F.when(is_open, mean * 1.25).alias("targetMeanPrice"),
        mean.alias("trailingEps"),
    )
