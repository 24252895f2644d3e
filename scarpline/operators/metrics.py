"""Classification metrics over prediction tables; only class-pair counts are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(
    predictions: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    by: list[str] | None = None,
) -> DataFrame:
    return predictions.groupBy(
        *(by or []), F.col(label).alias("label"), F.col(prediction).alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def weighted_f1(
    predictions: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    by: list[str] | None = None,
) -> DataFrame:
    """F1 per class weighted by support, one row per ``by`` group (one row without ``by``)."""
    by = by or []
    pairs = confusion(predictions, label, prediction, by)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = pairs.select(*by, F.inline(F.array(
        F.struct(F.col("label").cast("double").alias("class"), F.col("n").alias("support"),
                 F.lit(0).cast("long").alias("claimed"), hit.alias("tp")),
        F.struct(F.col("prediction").cast("double").alias("class"),
                 F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("claimed"), F.lit(0).cast("long").alias("tp")),
    )))
    per_class = sides.groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("claimed").alias("claimed"),
        F.sum("tp").alias("tp"),
    )
    f1 = F.coalesce(
        F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("claimed")), F.lit(0.0)
    )
    scored = per_class.select(*by, "support", (F.col("support") * f1).alias("part"))
    return scored.groupBy(*by).agg((F.sum("part") / F.sum("support")).alias("f1_weighted"))


def accuracy(
    predictions: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    by: list[str] | None = None,
) -> DataFrame:
    hit = (F.col(label) == F.col(prediction)).cast("double")
    return predictions.groupBy(*(by or [])).agg(F.avg(hit).alias("accuracy"))


def cv_summary(folds: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """Mean and population deviation of the fold scores."""
    return folds.groupBy(*(by or [])).agg(
        F.avg(score).alias("cv_score"), F.stddev_pop(score).alias("cv_std")
    )
