"""The summary of a data set per symbol, as a table and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StructType

from tidemark.operators import seasonality, stats
from tidemark.plans.features import feature_names

TOP_FEATURES = 5


def summary_table(
    bars: DataFrame,
    features: DataFrame,
    facts: DataFrame | None = None,
    best: DataFrame | None = None,
) -> DataFrame:
    """One row per symbol: extent, quality, return moments, best features, weekdays, best model."""
    returns = stats.percent_returns(bars)
    names = feature_names(features)
    top = stats.top_correlations(features, names, TOP_FEATURES)
    ranked = top.groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct("rank", "feature", "abs_corr"))).alias("top_features")
    )
    out = (
        stats.profile(bars)
        .join(stats.completeness(bars), "symbol")
        .join(stats.moments(returns), "symbol", "left")
        .join(seasonality.weekday_effect(seasonality.weekday_means(returns)), "symbol", "left")
        .join(ranked, "symbol", "left")
        .withColumn("n_features", F.lit(len(names)))
    )
    if facts is not None:
        out = out.join(facts.select("symbol", "longName"), "symbol", "left")
    if best is not None:
        out = out.join(best, "symbol", "left")
    return out


def _shown(value: Column, kind: DataType) -> Column:
    """A value as text: doubles with four digits, structs field by field, lists as one line an entry."""
    if isinstance(kind, DoubleType):
        return F.when(value.isNotNull(), F.format_string("%.4f", value))
    if isinstance(kind, StructType):
        return F.concat_ws(" ", *[_shown(value[f.name], f.dataType) for f in kind.fields])
    return value.cast("string")


def report_text(table: DataFrame) -> DataFrame:
    """The summary as a text: a line ``column = value`` for every column that has a value, in table order.

    A list gives one line for each of its entries.
    """
    lines = []
    for field in table.schema.fields:
        label, kind = F.lit(f"{field.name} = "), field.dataType
        if isinstance(kind, ArrayType):
            entries = F.transform(field.name, lambda e: F.concat(label, _shown(e, kind.elementType)))
            lines.append(F.when(F.size(field.name) > 0, F.array_join(entries, "\n")))
        else:
            lines.append(F.concat(label, _shown(F.col(field.name), kind)))
    return table.select("symbol", F.concat_ws("\n", *lines).alias("report"))
