"""Chronological splits, validation folds, metrics, residuals and the choice of the best model.

Prediction tables are long: (symbol, date, model, split, y, yhat).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.fixed import MAPE_GUARD, METRIC_NAMES, MODEL_NAMES
from tidemark.functions.numeric import sign_flag
from tidemark.series import over_blocks, with_positions

TEST_SIZE = 0.2
FOLDS = 5


def with_segments(rows: DataFrame, test_size: float = TEST_SIZE, folds: int = FOLDS) -> DataFrame:
    """Add ``split`` (train or test) and ``segment`` to the rows of each symbol.

    The training part is cut, in order of time, into segment 0 and ``folds`` equal segments 1..folds;
    the test part is segment ``folds + 1``.  Fold t is trained on the segments up to t and validated
    on segment t + 1, which is the expanding-window scheme.
    """
    index, n = F.col("pos") - 1, F.col("n_rows")
    out = with_positions(rows)
    out = out.withColumn("_train", F.floor(n * F.lit(1 - test_size)))
    out = out.withColumn("_size", F.floor(F.col("_train") / (folds + 1)))
    out = out.withColumn("_start", F.col("_train") - folds * F.col("_size"))
    later = F.floor(F.try_divide(index - F.col("_start"), F.col("_size"))) + 1
    segment = (
        F.when(index >= F.col("_train"), folds + 1)
        .when((index < F.col("_start")) | (F.col("_size") == 0), 0)
        .otherwise(later)
    )
    split = F.when(index < F.col("_train"), "train").otherwise("test")
    out = out.withColumns({"split": split, "segment": segment.cast("int")})
    return out.drop("_train", "_size", "_start", "pos", "n_rows")


def fold_sizes(segmented: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Rows and date limits of the training and validation part of every fold."""
    sizes = segmented.groupBy("symbol", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last")
    )
    fold = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold")
    roles = sizes.select("*", fold).withColumn(
        "role",
        F.when(F.col("segment") <= F.col("fold"), "train").when(
            F.col("segment") == F.col("fold") + 1, "valid"
        ),
    )
    return (
        roles.filter(F.col("role").isNotNull())
        .groupBy("symbol", "fold", "role")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    )


def baseline_predictions(segmented: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Predictions that repeat a column of the feature table, one model name per column."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(c).alias("yhat")) for m, c in columns.items()]
    )
    return segmented.select(
        "symbol", "date", "split", "segment", F.col("Target").alias("y"), F.inline(pairs)
    )


def _r2():
    unexplained = F.sum(F.pow(F.col("y") - F.col("yhat"), 2))
    return 1 - F.try_divide(unexplained, F.var_pop("y") * F.count("y"))


def with_steps(predictions: DataFrame) -> DataFrame:
    """Add whether the predicted change has the sign of the actual change, in order of date."""
    one_series = predictions.withColumn("symbol", F.struct("symbol", "model"))

    def stages(frames):
        def step(c):
            return F.signum(F.col(c) - F.lag(c).over(frames.order))

        return [{"same_direction": (step("y") == step("yhat")).cast("double")}]

    out = over_blocks(one_series, stages, back=1)
    return out.withColumn("symbol", F.col("symbol.symbol"))


def metrics(predictions: DataFrame) -> DataFrame:
    """RMSE, MAE, R2, MAPE and direction accuracy of the test rows, one row per symbol and model."""
    error = F.col("y") - F.col("yhat")
    test = with_steps(predictions.filter(F.col("split") == "test"))
    return test.groupBy("symbol", "model").agg(
        F.sqrt(F.avg(F.pow(error, 2))).alias("RMSE"),
        F.avg(F.abs(error)).alias("MAE"),
        _r2().alias("R2"),
        (F.avg(F.abs(F.try_divide(error, F.col("y") + MAPE_GUARD))) * 100).alias("MAPE"),
        (F.avg("same_direction") * 100).alias("Direction_Acc"),
    )


def metrics_long(wide: DataFrame) -> DataFrame:
    return wide.unpivot(["symbol", "model"], METRIC_NAMES, "metric", "value")


def fold_scores(predictions: DataFrame) -> DataFrame:
    """R2 of every validation fold; needs ``fold``, ``y`` and ``yhat``."""
    return predictions.groupBy("symbol", "model", "fold").agg(_r2().alias("r2"))


def summary(wide: DataFrame, scores: DataFrame) -> DataFrame:
    """Metrics with mean and population deviation of the fold scores, rounded to four digits."""
    folds = scores.groupBy("symbol", "model").agg(
        F.avg("r2").alias("CV_R2_Mean"), F.stddev_pop("r2").alias("CV_R2_Std")
    )
    numbers = [*METRIC_NAMES, "CV_R2_Mean", "CV_R2_Std"]
    joined = wide.join(folds, ["symbol", "model"], "left")
    return joined.select("symbol", "model", *[F.round(c, 4).alias(c) for c in numbers])


def score_distribution(scores: DataFrame) -> DataFrame:
    """Minimum, quartiles and maximum of the fold scores of each model."""
    q = F.percentile("r2", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = scores.groupBy("symbol", "model").agg(
        F.min("r2").alias("low"), q.alias("q"), F.max("r2").alias("high")
    )
    return out.select(
        "symbol",
        "model",
        "low",
        F.col("q")[0].alias("q25"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q75"),
        "high",
    )


def registry_rank(model: str = "model"):
    """Place of a model in the registry; unknown names come last."""
    place = F.array_position(F.array(*[F.lit(n) for n in MODEL_NAMES]), F.col(model))
    return F.when(place == 0, len(MODEL_NAMES) + 1).otherwise(place)


def best_models(wide: DataFrame) -> DataFrame:
    """The model with the lowest RMSE of each symbol; ties go to registry order, then name."""
    order = F.struct("RMSE", registry_rank(), "model")
    row = F.min_by(F.struct("model", "RMSE", "MAE", "R2", "MAPE", "Direction_Acc"), order)
    return wide.groupBy("symbol").agg(row.alias("b")).select("symbol", "b.*")


def best_predictions(predictions: DataFrame, best: DataFrame) -> DataFrame:
    """Test rows of the best model of each symbol."""
    chosen = best.select("symbol", "model")
    return predictions.filter(F.col("split") == "test").join(chosen, ["symbol", "model"], "left_semi")


def residual_sigma(predictions: DataFrame) -> DataFrame:
    """Population deviation of the test residuals of each symbol and model."""
    test = predictions.filter(F.col("split") == "test")
    return test.groupBy("symbol", "model").agg(
        F.stddev_pop(F.col("y") - F.col("yhat")).alias("sigma")
    )


def residual_bands(predictions: DataFrame, width: float = 1.0) -> DataFrame:
    """Test residuals with sign and a band of ``width`` deviations around the prediction."""
    rows = predictions.filter(F.col("split") == "test")
    rows = rows.join(residual_sigma(predictions), ["symbol", "model"])
    return rows.select(
        "symbol",
        "date",
        "model",
        "y",
        "yhat",
        (F.col("y") - F.col("yhat")).alias("residual"),
        sign_flag(F.col("y") - F.col("yhat")).alias("sign"),
        "sigma",
        (F.col("yhat") - F.col("sigma") * width).alias("lower"),
        (F.col("yhat") + F.col("sigma") * width).alias("upper"),
    )


def scatter_limits(predictions: DataFrame) -> DataFrame:
    """Ends of the diagonal of an actual-against-predicted plot."""
    test = predictions.filter(F.col("split") == "test")
    return test.groupBy("symbol", "model").agg(
        F.least(F.min("y"), F.min("yhat")).alias("low"),
        F.greatest(F.max("y"), F.max("yhat")).alias("high"),
        F.count(F.lit(1)).alias("n"),
    )


def timeline(predictions: DataFrame, forecast: DataFrame) -> DataFrame:
    """Training actuals, test actuals with predictions and band, and future rows in one table."""
    bands = residual_bands(predictions).select(
        "symbol", "date", "model", F.lit("test").alias("segment"), "y", "yhat", "lower", "upper"
    )
    train = predictions.filter(F.col("split") == "train").select(
        "symbol", "date", "model", F.lit("train").alias("segment"), "y", "yhat"
    )
    future = forecast.select(
        "symbol", "date", "model", F.lit("forecast").alias("segment"), "yhat", "lower", "upper"
    )
    return train.unionByName(bands, allowMissingColumns=True).unionByName(
        future, allowMissingColumns=True
    )


def first_rows(rows: DataFrame, count: int) -> DataFrame:
    """The first ``count`` rows of each series by date."""
    placed = with_positions(rows)
    return placed.filter(F.col("pos") <= count).drop("pos", "n_rows")
