"""Writing bars, intermediate tables and text reports."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.fixed import VALUE_COLUMNS
from tidemark.session import shared_folder


def write_bars(bars: DataFrame, path: str, form: str = "parquet") -> None:
    """One directory per symbol, so that a reader of few symbols skips the rest.

    Rows are brought together by (symbol, year) first: a writing task holds few open files, and a very
    long series is written by many tasks.
    """
    placed = bars.repartition("symbol", F.year("date"))
    writer = placed.sortWithinPartitions("symbol", "date").write.mode("overwrite")
    writer.partitionBy("symbol").format(form).option("header", True).save(path)


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """Training snapshot as CSV with a header; one directory per symbol."""
    named = snapshot.select(
        "symbol",
        *[F.col(c).alias(c.capitalize()) for c in ("date", *VALUE_COLUMNS)],
        "MA5",
        "MA20",
        "Target",
    )
    placed = named.repartition("symbol", F.year("Date")).sortWithinPartitions("symbol", "Date")
    placed.write.mode("overwrite").partitionBy("symbol").option("header", True).csv(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Intermediate results (bars, indicators, predictions, metrics, ...), one Parquet table each."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, names, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


_SCOPES: list[list[str]] = []
#: Name under which a staged table keeps its place.
_PATH = "_staged_path"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several jobs need to the shared folder, and read it back.

    The table outlives lost executors and cuts the lineage.  It stays until `released`, until the `stages` scope it was
    written in ends, or until the folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    """Through Spark's file system, which is not the driver's."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def released(df: DataFrame) -> None:
    """Delete a table that `staged` returned, when its last reader is done; other tables are left alone."""
    path = getattr(df, _PATH, None)
    if path is not None:
        _delete(df.sparkSession, path)


@contextmanager
def stages(spark: SparkSession):
    """Staged tables written inside are deleted at the end; take out what has to last by writing it elsewhere."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _delete(spark, path)


def write_report(report: DataFrame, path: str) -> None:
    """A text report per symbol, in one directory per symbol."""
    rows = report.select("symbol", F.col("report").alias("value"))
    rows.write.mode("overwrite").partitionBy("symbol").text(path)
