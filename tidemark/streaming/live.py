"""The live source: single ticks folded into bars, on a stored table or on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars_from_ticks(ticks: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Bars of rows (symbol, ts, price, size) per symbol and time window.

    Ticks of one instant follow each other by ``event_id`` where there is one, then by price and size.

    On a stream a bar is final once the watermark, ``late`` behind the newest tick, has passed its end;
    the state holds one small row per open bar.
    """
    rows = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    ties = [c for c in ("event_id", "price", "size") if c in ticks.columns]
    order = F.struct("ts", *ties)
    grouped = rows.groupBy("symbol", F.window("ts", every).alias("_window")).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("size").alias("volume"),
    )
    return grouped.select(
        "symbol", F.col("_window.start").alias("ts"), "open", "high", "low", "close", "volume"
    )


def event_ticks(events: DataFrame) -> DataFrame:
    """Events read as ticks: the type names the symbol, each event has size one."""
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"),
        F.lit(1.0).alias("size"),
    )


def write_live(bars: DataFrame, path: str, checkpoint: str):
    """Append final bars to a Parquet table; call with a streaming result of ``bars_from_ticks``."""
    return (
        bars.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .format("parquet")
        .option("path", path)
        .trigger(availableNow=True)
        .start()
    )
