"""Market regimes: features of each day, K-means of every symbol at once, silhouette and elbow.

K-means runs as passes over all days: days are packed into tiles, a task returns the sums of its tile
for every candidate (symbol, k, restart), Spark adds them up to new centres.  All candidates of all
symbols move in the same pass; only the centres are kept between passes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.fixed import (
    ELBOW_RANGE,
    KMEANS_RESTARTS,
    RATIO_GUARD,
    REGIME_COUNT,
    REGIME_LABELS,
    REGIME_MIN_ROWS,
    SEED,
)
from tidemark.functions.numeric import full_window, ratio
from tidemark.operators import candles, momentum, volatility
from tidemark.operators.cleaning import enough_rows
from tidemark.series import in_one_pass, windowed, with_positions
from tidemark.sources.sinks import released, staged

BASE_FEATURES = ["Daily_Return", "HV_5", "HV_21", "Volume_Ratio", "RSI_14", "BB_Pct"]
TOLERANCE = 1e-4
# Rows of one symbol whose distances to another such tile are computed together.
TILE_ROWS = 1024


@windowed(back=lambda full=False: 20)
def _volume_ratio(frames, full=False):
    """Volume ratio for tables that lack it; ``full`` needs a full window."""
    frame = frames.last(20)
    mean = full_window(F.avg("volume"), "volume", frame, 20) if full else F.avg("volume").over(frame)
    return [{"_mean_volume": mean}, {"Volume_Ratio": ratio("volume", F.col("_mean_volume") + RATIO_GUARD)}]


def regime_features(
    rows: DataFrame, dashboard: bool = False, block_rows: int | None = None
) -> DataFrame:
    """Features that describe the market of each day; rows with a NULL are dropped.

    Columns that the table already has are taken over.  VIX and SP500_Return are used if present.  The
    ``dashboard`` form never uses SP500_Return, needs a full window for a missing volume ratio, and
    leaves RSI and band position out if they are missing.
    """
    have = set(rows.columns)
    operators = [
        (candles.daily_return, {}),
        (volatility.full_window_vol, {"prefix": "HVF_"}),
    ]
    if "Volume_Ratio" not in have:
        operators.append((_volume_ratio, {"full": dashboard}))
    if not dashboard:
        if "RSI_14" not in have:
            operators.append((momentum.rsi, {"windows": [14]}))
        if "BB_Pct" not in have:
            operators.append((volatility.bollinger, {}))
    known = rows.drop("Daily_Return")
    out = in_one_pass(known, operators, block_rows)
    columns = {
        "Daily_Return": F.col("Daily_Return") * 100,
        "HV_5": F.col("HVF_5"),
        "HV_21": F.col("HVF_21"),
    }
    for c in ("Volume_Ratio", "RSI_14", "BB_Pct"):
        if c in out.columns:
            columns[c] = F.col(c)
    if "VIX" in have:
        columns["VIX"] = F.col("VIX")
    if "SP500_Return" in have and not dashboard:
        columns["SP500_Return"] = F.col("SP500_Return") * 100
    chosen = out.select("symbol", "date", "close", *[c.alias(n) for n, c in columns.items()])
    return chosen.dropna(how="any", subset=list(columns))


def regime_columns(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in ("symbol", "date", "close")]


def scaled_points(features: DataFrame, names: list[str], keep=()) -> DataFrame:
    """Features of each symbol scaled to mean 0 and population deviation 1, as one array ``x``."""
    moments = features.groupBy("symbol").agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in names],
        *[F.stddev_pop(c).alias(f"_dev_{c}") for c in names],
    )
    scaled = [
        F.coalesce(F.try_divide(F.col(c) - F.col(f"_mean_{c}"), F.col(f"_dev_{c}")), F.lit(0.0))
        for c in names
    ]
    return features.join(moments, "symbol").select(
        "symbol", "date", "close", *names, *keep, F.array(*scaled).alias("x")
    )


def point_tiles(points: DataFrame, labels=()) -> DataFrame:
    """Days of each symbol packed into tiles of at most ``TILE_ROWS`` rows.

    A tile has its dates, the coordinates of all its days in one flat array, and its labels.
    """
    placed = with_positions(points)
    tile = F.floor((F.col("pos") - 1) / TILE_ROWS).cast("int").alias("tile")
    tiles = placed.groupBy("symbol", tile).agg(
        # In order of date, so that draws by position repeat.
        F.array_sort(F.collect_list(F.struct("date", "x", *labels))).alias("rows"),
        F.ceil(F.max("n_rows") / TILE_ROWS).cast("int").alias("n_tiles"),
    )

    def part(name):
        return F.transform("rows", lambda r: r[name])

    return tiles.select(
        "symbol",
        "tile",
        "n_tiles",
        part("date").alias("dates"),
        F.flatten(part("x")).alias("x"),
        *[part(c).alias(c) for c in labels],
    )


def _matrix(flat, count: int) -> np.ndarray:
    return np.asarray(flat, dtype=float).reshape(count, -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` and ``b``, one coordinate at a time."""
    total = np.zeros((len(a), len(b)))
    for p, q in zip(a.T, b.T):
        gap = p[:, None] - q[None, :]
        total += gap * gap
    return total


def _draws(dimensions: int, seed: int):
    """Per tile and candidate: the day that wins the tile's race to be the next centre.

    Every day draws an exponential time, divided by its squared distance from the centres there are.
    The first arrival of all tiles is then a day picked with odds proportional to that distance.
    """

    def run(batches):
        for batch in batches:
            out = []
            columns = (batch[c] for c in ("symbol", "tile", "x", "candidates"))
            for symbol, tile, flat, candidates in zip(*columns):
                days = np.asarray(flat, dtype=float).reshape(-1, dimensions)
                name = zlib.crc32(symbol.encode())
                for candidate in candidates:
                    k, restart = candidate["k"], candidate["run"]
                    centres = np.array([list(c) for c in candidate["centres"]], dtype=float)
                    if len(centres) == k:
                        continue
                    random = np.random.default_rng([seed, k, restart, len(centres), int(tile), name])
                    time = random.exponential(size=len(days))
                    weight = _squares(days, centres).min(1) if len(centres) else np.ones(len(days))
                    arrival = np.divide(time, weight, out=np.full(len(days), np.inf), where=weight > 0)
                    first = np.lexsort((time, arrival))[0]
                    out.append((symbol, k, restart, arrival[first], time[first], days[first].tolist()))
            yield pd.DataFrame(out, columns=["symbol", "k", "run", "arrival", "time", "day"])

    return run


def first_centres(tiles: DataFrame, dimensions: int, ks, restarts: int, seed: int) -> DataFrame:
    """First centres of every candidate (symbol, k, restart): spread-out picks among all days.

    Each pass gives all candidates their next centre; tiles send one day per candidate.  With fewer
    different days than centres, days repeat.
    """
    none = F.array().cast("array<array<double>>")
    made = tiles.select("symbol").distinct()
    made = made.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
    made = made.withColumn("run", F.explode(F.array(*[F.lit(r) for r in range(restarts)])))
    made = made.withColumn("centres", none)
    schema = "symbol string, k int, run int, arrival double, time double, day array<double>"
    for _ in range(max(ks)):
        packed = made.groupBy("symbol").agg(F.collect_list(F.struct("k", "run", "centres")).alias("candidates"))
        asked = tiles.join(packed, "symbol").select("symbol", "tile", "x", "candidates")
        drawn = asked.mapInPandas(_draws(dimensions, seed), schema).groupBy("symbol", "k", "run").agg(
            F.min_by("day", F.struct("arrival", "time")).alias("day")
        )
        more = F.when(F.col("day").isNotNull(), F.concat("centres", F.array("day"))).otherwise(F.col("centres"))
        before = made
        made = staged(
            made.join(drawn, ["symbol", "k", "run"], "left").select("symbol", "k", "run", more.alias("centres")),
            "first-centres",
        )
        released(before)
    return made


def _moves(dimensions: int):
    """Per tile and candidate: size, cost and sums of the days nearest to each centre."""
    names = [f"x{i}" for i in range(dimensions)]

    def run(batches):
        for batch in batches:
            keys, values = [], []
            for symbol, flat, candidates in zip(batch["symbol"], batch["x"], batch["candidates"]):
                days = np.asarray(flat, dtype=float).reshape(-1, dimensions)
                for candidate in candidates:
                    centres = np.array([list(c) for c in candidate["centres"]], dtype=float)
                    distance = _squares(days, centres)
                    near = distance.argmin(1)
                    cost = distance[np.arange(len(days)), near]
                    for c in np.unique(near):
                        mine = near == c
                        keys.append((symbol, candidate["k"], candidate["run"], int(c), int(mine.sum())))
                        values.append([cost[mine].sum(), *days[mine].sum(0)])
            out = pd.DataFrame(keys, columns=["symbol", "k", "run", "cluster", "n"])
            out[["cost", *names]] = np.array(values).reshape(len(keys), dimensions + 1)
            yield out

    return run


def _nearest_days(tiles: DataFrame, candidates: DataFrame, dimensions: int) -> DataFrame:
    """Size, cost and mean of the days nearest to every centre; tiles send sums, not days."""
    packed = candidates.groupBy("symbol").agg(
        F.collect_list(F.struct("k", "run", "centres")).alias("candidates")
    )
    columns = [f"x{i}" for i in range(dimensions)]
    schema = "symbol string, k int, run int, cluster int, n long, cost double, "
    partial = tiles.join(packed, "symbol").select("symbol", "x", "candidates")
    partial = partial.mapInPandas(
        _moves(dimensions), schema + ", ".join(f"{c} double" for c in columns)
    )
    return partial.groupBy("symbol", "k", "run", "cluster").agg(
        F.sum("cost").alias("cost"),
        F.array(*[F.sum(c) / F.sum("n") for c in columns]).alias("centre"),
    )


def fit_kmeans(
    points: DataFrame,
    dimensions: int,
    ks=(REGIME_COUNT,),
    restarts: int = KMEANS_RESTARTS,
    seed: int = SEED,
    max_passes: int | None = None,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Best of ``restarts`` runs per symbol and k: (symbol, k, inertia, centres).

    Candidates whose centres have stopped moving leave the passes; passes go on until all have.  A
    number of passes is an argument; candidates that still move after it are an error.
    """
    tiles = staged(point_tiles(points), "regime-tiles")
    start = first_centres(tiles, dimensions, ks, restarts, seed)
    candidates = staged(start.withColumn("shift", F.lit(float("inf"))), "centres")
    released(start)
    passes = 0
    while not (moving := candidates.filter(F.col("shift") > tolerance)).isEmpty():
        if passes == max_passes:
            raise RuntimeError(f"centres still move after {passes} passes")
        passes += 1
        near = _nearest_days(tiles, moving, dimensions)
        new = near.groupBy("symbol", "k", "run").agg(
            F.map_from_entries(F.collect_list(F.struct("cluster", "centre"))).alias("_new")
        )
        # A centre that lost all its days stays where it is.
        moved = moving.join(new, ["symbol", "k", "run"]).select(
            "symbol",
            "k",
            "run",
            F.col("centres").alias("_old"),
            F.transform("centres", lambda c, i: F.coalesce(F.col("_new")[i], c)).alias("centres"),
        )
        steps = F.flatten(
            F.zip_with(
                "_old", "centres", lambda a, b: F.zip_with(a, b, lambda p, q: (p - q) * (p - q))
            )
        )
        shift = F.aggregate(steps, F.lit(0.0), lambda total, v: total + v)
        moved = moved.withColumn("shift", shift).drop("_old")
        # Each table holds all candidates, so the one before it is done with.
        before = candidates
        candidates = staged(moved.unionByName(before.filter(F.col("shift") <= tolerance)), "centres")
        released(before)
    final = candidates.drop("shift")
    costs = _nearest_days(tiles, final, dimensions).groupBy("symbol", "k", "run").agg(
        F.sum("cost").alias("inertia")
    )
    best = F.min_by(F.struct("inertia", "centres"), F.struct("inertia", "run")).alias("b")
    scored = final.join(costs, ["symbol", "k", "run"])
    return scored.groupBy("symbol", "k").agg(best).select("symbol", "k", "b.*")


def _nearest(centres, x):
    """Number of the nearest centre."""

    def distance(c):
        squares = F.zip_with(c, x, lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0.0), lambda total, v: total + v)

    return F.array_min(
        F.transform(centres, lambda c, i: F.struct(distance(c).alias("d"), i.alias("cluster")))
    )["cluster"]


def label_points(points: DataFrame, models: DataFrame) -> DataFrame:
    """Cluster of every day under the best model of each k, one row per day and k."""
    rows = points.join(models.select("symbol", "k", "centres"), "symbol")
    return rows.withColumn("cluster", _nearest(F.col("centres"), F.col("x"))).drop("centres")


def by_mean_return(labelled: DataFrame, value: str = "Daily_Return") -> DataFrame:
    """Renumber the clusters of each symbol by mean return, best first, and name them."""
    means = labelled.groupBy("symbol", "cluster").agg(F.avg(value).alias("_mean"))
    order = Window.partitionBy("symbol").orderBy(F.col("_mean").desc(), "cluster")
    names = F.create_map(*[F.lit(v) for pair in REGIME_LABELS.items() for v in pair])
    regimes = means.select(
        "symbol", "cluster", (F.row_number().over(order) - 1).alias("regime")
    )
    out = labelled.join(regimes, ["symbol", "cluster"]).drop("cluster")
    return out.withColumn("regime_label", names[F.col("regime")])


def regime_means(labelled: DataFrame, value: str = "Daily_Return") -> DataFrame:
    return labelled.groupBy("symbol", "regime").agg(F.avg(value).alias("mean_return"))


def regime_statistics(labelled: DataFrame) -> DataFrame:
    """Days, share of days and means of each regime, with the extremes of the return."""
    stats = labelled.groupBy("symbol", "regime").agg(
        F.count(F.lit(1)).alias("days"),
        F.round(F.avg("Daily_Return"), 4).alias("mean_return"),
        F.round(F.avg("HV_21"), 4).alias("mean_hv21"),
        F.round(F.avg("RSI_14"), 2).alias("mean_rsi"),
        F.round(F.max("Daily_Return"), 2).alias("max_return"),
        F.round(F.min("Daily_Return"), 2).alias("min_return"),
    )
    total = F.sum("days").over(Window.partitionBy("symbol"))
    return stats.withColumn("share_pct", F.round(F.col("days") / total * 100, 1))


def regime_centres(labelled: DataFrame, names: list[str]) -> DataFrame:
    """Centre of each regime in original units: the mean of its days."""
    return labelled.groupBy("symbol", "regime").agg(*[F.avg(c).alias(c) for c in names])


# ---- silhouette ----------------------------------------------------------------------------------


def _distance_sums(labels: list[str]):
    """For each day of two tiles: sums of distances to the other tile's days by their label.

    The distances of a pair of tiles are computed once and added up both ways.
    """

    def side(symbol, name, dates, own, distances, other):
        clusters = np.unique(other)
        member = (other[:, None] == clusters[None, :]).astype(float)
        return pd.DataFrame(
            {
                "symbol": symbol,
                "date": np.repeat(dates, len(clusters)),
                "labelling": name,
                "own": np.repeat(own, len(clusters)),
                "cluster": np.tile(clusters, len(dates)),
                "total": (distances @ member).ravel(),
                "members": np.tile(member.sum(0).astype(int), len(dates)),
            }
        )

    def run(batches):
        for batch in batches:
            parts = []
            for row in batch.itertuples(index=False):
                dates, others = np.asarray(row.dates), np.asarray(row.other_dates)
                a, b = _matrix(row.x, len(dates)), _matrix(row.other_x, len(others))
                distances = np.sqrt(_squares(a, b))
                for name in labels:
                    own, other = np.asarray(getattr(row, name)), np.asarray(getattr(row, f"other_{name}"))
                    parts.append(side(row.symbol, name, dates, own, distances, other))
                    if row.tile != row.other_tile:
                        parts.append(side(row.symbol, name, others, other, distances.T, own))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return run


def silhouette_values(points: DataFrame, labels: list[str]) -> DataFrame:
    """Exact Euclidean silhouette value of every day for each labelling column.

    The measure needs each day's mean distance to every cluster of its symbol.  Days are packed into
    tiles; a task takes two tiles of one symbol, each pair of tiles once, and returns one sum per day and
    cluster for both, so pairs of days are never rows.  Tiles meet by (symbol, tile number), which spreads a long symbol over many
    tasks; a symbol has at most one day per date, which bounds the number of its tiles.
    """
    # Read from both sides of the join below.
    tiles = staged(point_tiles(points.select("symbol", "date", "x", *labels), labels), "label-tiles")
    other = tiles.select(
        "symbol",
        F.col("tile").alias("other_tile"),
        F.col("x").alias("other_x"),
        F.col("dates").alias("other_dates"),
        *[F.col(c).alias(f"other_{c}") for c in labels],
    )
    meets = F.explode(F.sequence(F.col("tile"), F.col("n_tiles") - 1)).alias("other_tile")
    paired = tiles.select("symbol", "tile", "dates", "x", *labels, meets).join(other, ["symbol", "other_tile"])
    sums = paired.mapInPandas(
        _distance_sums(labels),
        "symbol string, date date, labelling string, own int, cluster int, total double, members long",
    )
    clusters = sums.groupBy("symbol", "date", "labelling", "own", "cluster").agg(
        F.sum("total").alias("total"), F.sum("members").alias("members")
    )
    is_own = F.col("own") == F.col("cluster")
    values = clusters.groupBy("symbol", "date", "labelling").agg(
        F.max(F.when(is_own, F.try_divide("total", F.col("members") - 1))).alias("a"),
        F.min(F.when(~is_own, F.col("total") / F.col("members"))).alias("b"),
        F.max(F.when(is_own, F.col("members"))).alias("own_members"),
    )
    score = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    alone = F.col("own_members") == 1
    return values.select(
        "symbol",
        "date",
        "labelling",
        F.when(F.col("b").isNull(), None)
        .when(alone, 0.0)
        .otherwise(F.coalesce(score, F.lit(0.0)))
        .alias("silhouette"),
    )


def silhouette(points: DataFrame, labels: list[str]) -> DataFrame:
    """Mean silhouette of each symbol and labelling."""
    values = silhouette_values(points, labels)
    return values.groupBy("symbol", "labelling").agg(F.avg("silhouette").alias("silhouette"))


def elbow(points: DataFrame, models: DataFrame, ks=ELBOW_RANGE) -> DataFrame:
    """Inertia and silhouette for every k; the distances are computed once for all k."""
    wide = label_points(points, models).groupBy("symbol", "date").pivot("k", list(ks)).agg(F.first("cluster"))
    names = {str(k): f"k{k}" for k in ks}
    labelled = points.select("symbol", "date", "x").join(
        wide.withColumnsRenamed(names), ["symbol", "date"]
    )
    scores = silhouette(labelled, list(names.values()))
    scores = scores.withColumn("k", F.substring("labelling", 2, 2).cast("int"))
    return models.select("symbol", "k", "inertia").join(
        scores.select("symbol", "k", "silhouette"), ["symbol", "k"]
    )


def run_regimes(rows: DataFrame, with_elbow: bool = True, **options) -> dict[str, DataFrame]:
    """Features, labelled days, statistics, centres, silhouette and elbow as named tables."""
    # Each later step reads its input more than once, so the steps are stored.
    features = staged(regime_features(rows, **options), "regime-features")
    features = enough_rows(features, REGIME_MIN_ROWS)
    names = regime_columns(features)
    points = staged(scaled_points(features, names), "regime-points")
    ks = sorted({REGIME_COUNT, *(ELBOW_RANGE if with_elbow else ())})
    models = staged(fit_kmeans(points, len(names), ks), "regime-models")
    chosen = label_points(points, models.filter(F.col("k") == REGIME_COUNT)).drop("k")
    labelled = staged(by_mean_return(chosen), "regimes")
    tables = {
        "features": features,
        "labels": labelled.drop("x"),
        "stats": regime_statistics(labelled),
        "centres": regime_centres(labelled, names),
        "silhouette": silhouette(labelled, ["regime"]),
        "models": models,
    }
    if with_elbow:
        tables["elbow"] = elbow(points, models)
    return tables
