"""Key figures of each symbol and the company fact sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.fixed import TRADING_DAYS
from tidemark.functions.numeric import sign_flag
from tidemark.functions.text import (
    arrow,
    market_cap,
    money,
    number_or_missing,
    percentage,
    plain_or_missing,
    rating,
    signed_percent,
    two_digits,
    whole,
)
from tidemark.series import with_positions


def last_rows(bars: DataFrame, rows: int = TRADING_DAYS) -> DataFrame:
    """The last ``rows`` rows of each symbol."""
    placed = with_positions(bars).filter(F.col("pos") > F.col("n_rows") - rows)
    return placed.withColumn("from_end", F.col("n_rows") - F.col("pos") + 1).drop("pos", "n_rows")


def year_range(bars: DataFrame) -> DataFrame:
    """Highest high and lowest low of the last 252 rows."""
    return last_rows(bars).groupBy("symbol").agg(
        F.max("high").alias("high_52w"), F.min("low").alias("low_52w")
    )


def key_figures(bars: DataFrame) -> DataFrame:
    """Last close, change against the row before, 52-week range and last volume.

    A symbol with one row is compared with itself.
    """
    at = {n: F.col("from_end") == n for n in (1, 2)}
    out = last_rows(bars).groupBy("symbol").agg(
        F.max("date").alias("last_date"),
        F.max(F.when(at[1], F.col("close"))).alias("close"),
        F.max(F.when(at[2], F.col("close"))).alias("_before"),
        F.max(F.when(at[1], F.col("volume"))).alias("volume"),
        F.max("high").alias("high_52w"),
        F.min("low").alias("low_52w"),
    )
    out = out.withColumn("prev_close", F.coalesce("_before", "close")).drop("_before")
    change = F.try_divide(F.col("close") - F.col("prev_close"), F.col("prev_close")) * 100
    return out.withColumn("change_pct", change).withColumn("direction", sign_flag("change_pct"))


def key_figure_texts(figures: DataFrame, facts: DataFrame, best: DataFrame | None = None):
    """Key figures as display texts; ``best`` adds (symbol, model, RMSE) of the best model."""
    facts = facts.select("symbol", "marketCap", "trailingPE")
    rows = figures.join(facts, "symbol", "left")
    texts = {
        "current_price": money("close"),
        "price_note": arrow("change_pct"),
        "one_day_change": signed_percent("change_pct"),
        "change_note": F.concat(F.lit("vs prev close "), money("prev_close")),
        "high_52w_text": money("high_52w"),
        "low_52w_text": money("low_52w"),
        "volume_text": whole("volume"),
        "market_cap": market_cap("marketCap"),
        "pe_ratio": plain_or_missing("trailingPE"),
    }
    if best is not None:
        rows = rows.join(best.select("symbol", "model", "RMSE"), "symbol", "left")
        texts["best_model"] = F.split("model", " ")[0]
        texts["best_note"] = F.concat(F.lit("RMSE $"), two_digits("RMSE"))
    return rows.select("symbol", "direction", *[c.alias(n) for n, c in texts.items()])


def fact_sheet(facts: DataFrame) -> DataFrame:
    """Company facts as display texts; missing or zero numbers are N/A."""
    beta = F.col("beta")
    texts = {
        "market_cap": market_cap("marketCap"),
        "trailing_pe": number_or_missing("trailingPE"),
        "forward_pe": number_or_missing("forwardPE"),
        "price_to_book": number_or_missing("priceToBook"),
        "eps": number_or_missing("trailingEps", "$"),
        "dividend_yield": percentage("dividendYield"),
        "beta_text": number_or_missing("beta"),
        "beta_flag": F.coalesce(beta > 1.5, F.lit(False)),
        "high_52w": plain_or_missing("fiftyTwoWeekHigh", "$"),
        "low_52w": plain_or_missing("fiftyTwoWeekLow", "$"),
        "target_price": number_or_missing("targetMeanPrice", "$"),
        "analyst_rating": rating("recommendationKey"),
    }
    return facts.select(
        "symbol", "longName", "sector", "industry", *[c.alias(n) for n, c in texts.items()]
    )
