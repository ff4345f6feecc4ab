"""Tables written on the way: how long they stay, and bars laid out once."""

import datetime
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.util import SCHEMA, walk
from tidemark.operators import averages, running
from tidemark.series import laid_out, with_positions
from tidemark.session import shared_folder
from tidemark.sources.bars import bars_from_trades, lineitem_trades
from tidemark.sources.sinks import released, staged, stages


def folders(spark):
    return {p.name for p in Path(shared_folder(spark).removeprefix("file:")).iterdir() if "-" in p.name}


def test_tables_of_a_scope_go_with_it(spark):
    before = folders(spark)
    kept = staged(spark.range(5), "kept")
    with stages(spark):
        inner = staged(kept.filter("id > 1"), "inner")
        with stages(spark):
            staged(inner, "innermost")
            assert len(folders(spark) - before) == 3
        assert len(folders(spark) - before) == 2 and inner.count() == 3
    assert len(folders(spark) - before) == 1 and kept.count() == 5
    with pytest.raises(ZeroDivisionError), stages(spark):
        staged(kept, "lost")
        1 / 0
    assert len(folders(spark) - before) == 1
    released(kept.filter("id > 2"))
    assert kept.count() == 5
    released(kept)
    assert folders(spark) == before


def test_only_staged_tables_are_released(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "own"))
    released(spark.read.parquet(str(tmp_path / "own")))
    assert spark.read.parquet(str(tmp_path / "own")).count() == 3


def test_bars_laid_out_once(spark):
    bars = spark.createDataFrame(pd.concat([walk("A", 900, 1), walk("B", 30, 2), walk("C", 1, 3)]), SCHEMA)
    placed = laid_out(bars)
    want = {(r.symbol, r.date): (r.pos, r.n_rows) for r in with_positions(bars).collect()}
    assert {(r.symbol, r.date): (r.pos, r.n_rows) for r in placed.collect()} == want
    for operator, column in ((averages.sma, "SMA_20"), (running.ema, "EMA_20")):
        one, other = ({(r.symbol, r.date): r[column] for r in operator(t).collect()} for t in (bars, placed))
        assert one == other
    plan = averages.sma(placed)._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan and plan.count("Window") <= 4
    with pytest.raises(ValueError, match="two bars of one date"):
        laid_out(bars.unionByName(bars.limit(1)))
    assert laid_out(bars.limit(0)).count() == 0


def test_order_keys_out_of_range_are_an_error(spark):
    day = datetime.datetime(2020, 1, 1)
    schema = (
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    )
    good = [(1, 7, 5, 99_999_999, 10.0, 1.0, "A", "F", day), (2, 0, 5, 1, 20.0, 1.0, "A", "F", day)]
    bar = bars_from_trades(lineitem_trades(spark.createDataFrame(good, schema))).first()
    assert (bar.open, bar.close, bar.volume) == (1000.0, 2000.0, 2.0)
    for bad in ((1, 8, 5, 1), (1, 1, 5, 100_000_000), (1, 1, 10**10, 1)):
        table = spark.createDataFrame([(*bad, 10.0, 1.0, "A", "F", day)], schema)
        with pytest.raises(Exception, match="order key out of range"):
            bars_from_trades(lineitem_trades(table)).agg(F.sum("open")).collect()
