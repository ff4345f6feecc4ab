"""Reading daily bars: stored tables, CSV snapshots, wide files, and bars built from single trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.fixed import BAR_COLUMNS, DEFAULT_HISTORY_DAYS, UNIVERSE, VALUE_COLUMNS

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType(), False),
        T.StructField("date", T.DateType(), False),
        *[T.StructField(c, T.DoubleType(), True) for c in VALUE_COLUMNS],
    ]
)

SNAPSHOT_SCHEMA = T.StructType(
    [
        T.StructField("Date", T.DateType()),
        *[T.StructField(c.capitalize(), T.DoubleType()) for c in VALUE_COLUMNS],
        *[T.StructField(c, T.DoubleType()) for c in ("MA5", "MA20", "Target")],
    ]
)


class NoData(ValueError):
    """Raised when a request selects no bars."""


def in_range(bars: DataFrame, symbols=None, start=None, end=None) -> DataFrame:
    """Bars of the given symbols with start <= date < end; the filters reach the file scan."""
    if symbols is not None:
        bars = bars.filter(F.col("symbol").isin(list(symbols)))
    if start is not None:
        bars = bars.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.filter(F.col("date") < F.lit(end).cast("date"))
    return bars


def no_nan(bars: DataFrame) -> DataFrame:
    """NaN becomes NULL, and rows without a close are dropped."""
    clean = {
        c: F.when(~F.isnan(c), F.col(c)) for c in VALUE_COLUMNS if c in bars.columns
    }
    return bars.withColumns(clean).dropna(subset=["close"])


def read_bars(
    spark: SparkSession, path: str, symbols=None, start=None, end=None, must_exist: bool = False
) -> DataFrame:
    """Stored bars (Parquet), restricted to symbols and dates."""
    bars = in_range(spark.read.parquet(path), symbols, start, end)
    bars = no_nan(bars.select(*BAR_COLUMNS))
    if must_exist and bars.isEmpty():
        raise NoData(f"no bars for {symbols} from {start} to {end}")
    return bars


def read_snapshot(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """A CSV snapshot with a header; only the five price columns are kept.

    ``symbol`` names the series; without it the directory has to be partitioned by symbol.
    """
    schema = SNAPSHOT_SCHEMA
    if symbol is None:
        schema = T.StructType([*schema.fields, T.StructField("symbol", T.StringType())])
    rows = spark.read.schema(schema).option("header", True).csv(path)
    if symbol is not None:
        rows = rows.withColumn("symbol", F.lit(symbol))
    prices = [F.col(c.capitalize()).alias(c) for c in VALUE_COLUMNS]
    return no_nan(rows.select("symbol", F.col("Date").alias("date"), *prices))


def from_wide(wide: DataFrame, symbols, separator: str = "_") -> DataFrame:
    """Columns named <Field><separator><symbol> beside a Date column, turned into long bars."""
    per_symbol = [
        F.struct(
            F.lit(s).alias("symbol"),
            *[
                F.col(f"`{c.capitalize()}{separator}{s}`").cast("double").alias(c)
                for c in VALUE_COLUMNS
            ],
        )
        for s in symbols
    ]
    long = wide.select(F.col("Date").alias("date"), F.inline(F.array(*per_symbol)))
    return no_nan(long.select(*BAR_COLUMNS))


def bars_from_trades(trades: DataFrame) -> DataFrame:
    """Daily bars from rows (symbol, date, order, price, size); ``order`` is unique in a bar.

    The aggregate has fixed-width buffers only, so it runs as a hash aggregate with a partial step
    before the shuffle: a symbol with very many trades sends one row per day and task.
    """
    return trades.groupBy("symbol", "date").agg(
        F.min_by("price", "order").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "order").alias("close"),
        F.sum("size").alias("volume"),
    )


def lineitem_trades(lineitem: DataFrame) -> DataFrame:
    """Order lines read as trades: the flags name the symbol, the unit price in cents is the price."""
    ticks = F.floor(F.try_divide(F.col("l_extendedprice") * 100, F.col("l_quantity")))
    # One number, so that the hash aggregate has buffers of fixed width; keys it cannot hold are an error.
    high = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("decimal(19,0)")
    low = (F.col("l_partkey") * 100_000_000 + F.col("l_suppkey")).cast("decimal(19,0)")
    fits = F.col("l_linenumber").between(0, 7) & F.col("l_suppkey").between(0, 99_999_999)
    fits &= F.col("l_partkey").between(0, 9_999_999_999) & F.col("l_orderkey").between(0, 1 << 59)
    order = high * F.lit("1000000000000000000").cast("decimal(19,0)") + low
    order = F.when(F.coalesce(fits, F.lit(True)), order).otherwise(F.raise_error("order key out of range"))
    return lineitem.select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        F.col("l_shipdate").cast("date").alias("date"),
        order.alias("order"),
        ticks.cast("double").alias("price"),
        F.col("l_quantity").alias("size"),
    )


def lineitem_bars(spark: SparkSession, directory: str) -> DataFrame:
    return bars_from_trades(lineitem_trades(spark.read.parquet(f"{directory}/lineitem.parquet")))


def universe(spark: SparkSession) -> DataFrame:
    """The symbols offered by default."""
    return spark.createDataFrame(UNIVERSE, "symbol string, label string")


def in_universe(bars: DataFrame, symbols: DataFrame) -> DataFrame:
    """Bars whose symbol stands in a table of symbols."""
    return bars.join(symbols.select("symbol"), "symbol", "left_semi")


def default_range(last_day=None):
    """Default request range as columns: five years up to today or the given day."""
    end = F.current_date() if last_day is None else last_day
    return F.date_sub(end, DEFAULT_HISTORY_DAYS), end


def recent(bars: DataFrame, days: int = DEFAULT_HISTORY_DAYS) -> DataFrame:
    """Bars of the last ``days`` days before each symbol's own last bar."""
    ends = bars.groupBy("symbol").agg(F.max("date").alias("_end"))
    kept = bars.join(ends, "symbol").filter(F.col("date") >= F.date_sub("_end", days))
    return kept.drop("_end")
