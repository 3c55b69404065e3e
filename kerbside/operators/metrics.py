"""Forecast and classification quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbside.functions.time import as_col
from kerbside.operators.stats import quantiles


def abs_error(actual: Column | str, pred: Column | str) -> Column:
    return F.abs(as_col(actual) - as_col(pred))


def error_metrics(df: DataFrame, actual: str = "demand", pred: str = "prediction") -> DataFrame:
    """MAE, RMSE and median absolute error."""
    err = df.select(abs_error(actual, pred).cast("double").alias("e"))
    med = quantiles(err, [], "e", {"MedAE": 0.5}).select("MedAE")
    return err.agg(
        F.avg("e").alias("MAE"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("RMSE"),
    ).withColumn("MedAE", med.scalar())


def regression_report(
    df: DataFrame, actual: str, pred: str, by: Sequence[str] = (), baseline: str | None = None
) -> DataFrame:
    """MAE, MSE, RMSE, R2 and means, optionally the RMSE gain over a baseline in percent."""
    y, p = F.col(actual).cast("double"), F.col(pred).cast("double")
    rows = df.where(y.isNotNull() & p.isNotNull())
    out = rows.groupBy(*by).agg(
        F.avg(F.abs(y - p)).alias("MAE"),
        F.avg((y - p) * (y - p)).alias("MSE"),
        F.var_pop(y).alias("_var"),
        F.avg(y).alias("mean_actual"),
        F.avg(p).alias("mean_pred"),
        *([F.sqrt(F.avg((y - F.col(baseline)) * (y - F.col(baseline)))).alias("_base")] if baseline else []),
    )
    out = out.withColumns({"RMSE": F.sqrt("MSE"), "R2": 1 - F.try_divide(F.col("MSE"), F.col("_var"))})
    if baseline:
        out = out.withColumn("improvement_pct", F.try_divide(F.col("_base") - F.col("RMSE"), F.col("_base")) * 100)
    return out.drop("_var", "_base")


def confusion(df: DataFrame, by: Sequence[str], target: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Row-normalised confusion matrix cells."""
    cells = df.groupBy(*by, F.col(target).cast("int").alias("target"), (F.col(score) > threshold).cast("int").alias("pred")).agg(
        F.count("*").alias("n")
    )
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "target")))


def classification_report(df: DataFrame, by: Sequence[str], target: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Precision, recall and F1 of the positive class, and accuracy."""
    actual, hit = F.col(target) == 1, F.col(score) > threshold
    tp, fp = F.count_if(actual & hit), F.count_if(~actual & hit)
    fn, n = F.count_if(actual & ~hit), F.count("*")
    return df.groupBy(*by).agg(
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.try_divide(F.count_if(actual == hit), n).alias("accuracy"),
    )


def daily_mae(preds: DataFrame, key: str = "Series_ID", ts: str = "timestamp", actual: str = "demand", pred: str = "prediction") -> DataFrame:
    return preds.groupBy(key, F.to_date(ts).alias("day")).agg(F.avg(abs_error(actual, pred)).alias("mae"))


def series_mae(preds: DataFrame, key: str = "Series_ID", **cols) -> DataFrame:
    """Mean over the days of the daily MAE of each series."""
    return daily_mae(preds, key, **cols).groupBy(key).agg(F.avg("mae").alias("mae"))


def nested_mae(preds: DataFrame, key: str = "Series_ID", **cols) -> DataFrame:
    """Mean and median over the series of the mean daily MAE."""
    per_series = series_mae(preds, key, **cols)
    med = quantiles(per_series, [], "mae", {"m": 0.5}).select("m")
    return per_series.agg(F.count("*").alias("series"), F.avg("mae").alias("mean_mae")).withColumn("median_mae", med.scalar())


def error_vs_volume(preds: DataFrame, key: str = "Series_ID", actual: str = "demand", pred: str = "prediction") -> DataFrame:
    return (
        preds.groupBy(key)
        .agg(F.avg(abs_error(actual, pred)).alias("mae"), F.avg(actual).alias("mean_demand"))
        .withColumn("relative_error", F.col("mae") / (F.col("mean_demand") + 0.1) * 100)
    )


def worst_series(preds: DataFrame, k: int = 5, key: str = "Series_ID", actual: str = "demand", pred: str = "prediction") -> DataFrame:
    return (
        preds.groupBy(key).agg(F.avg(abs_error(actual, pred)).alias("mae")).orderBy(F.desc("mae"), key).limit(k)
    )


def mean_std_error(preds: DataFrame, actual: str = "demand", pred: str = "prediction") -> DataFrame:
    e = abs_error(actual, pred)
    return preds.agg(F.avg(e).alias("mean_error"), F.stddev_samp(e).alias("std_error"))


def with_residuals(df: DataFrame, label: str, pred: str, sigma: str) -> DataFrame:
    return df.withColumn("residual", (F.col(label) - F.col(pred)) * F.col(sigma))


def residual_mae(df: DataFrame, label: str, pred: str, sigma: str) -> DataFrame:
    return with_residuals(df, label, pred, sigma).agg(F.avg(F.abs("residual")).alias("mae"))


def pinball_loss(df: DataFrame, actual: str, quantile_cols: dict[float, str]) -> DataFrame:
    """Mean quantile loss per level and their sum."""
    out = []
    for q, c in quantile_cols.items():
        e = F.col(actual) - F.col(c)
        out.append(F.avg(F.greatest(q * e, (q - 1) * e)).alias(f"loss_p{round(q * 100)}"))
    losses = df.agg(*out)
    return losses.withColumn("loss", sum((F.col(c) for c in losses.columns), F.lit(0.0)))


def smape(df: DataFrame, actual: str, pred: str) -> DataFrame:
    """Symmetric percentage error; rows where both are zero count as no error."""
    a, p = F.col(actual), F.col(pred)
    term = F.coalesce(F.try_divide(2 * F.abs(a - p), F.abs(a) + F.abs(p)), F.lit(0.0))
    return df.agg(F.avg(term).alias("smape"))


def huber(df: DataFrame, actual: str, pred: str, delta: float = 0.2) -> DataFrame:
    e = abs_error(actual, pred)
    return df.agg(F.avg(F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))).alias("huber"))
